"""Nearest vectors by dot product: a stated query set against all rows, in one scan of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

#: Rows that a task compares at once, and query vectors that it holds beside them.
CHUNK, BLOCK = 65_536, 2_048


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, vec_id, score, rank``: best first, ties by vec_id; a vector is no neighbour of itself.

    Queries are written once to the shared folder. Every task reads them in blocks beside a chunk of its rows and
    keeps the best k of the chunk per query, so nothing is collected or broadcast and rows are scanned once.
    """
    asked = written(vectors.where(is_query).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "queries")
    files = asked.inputFiles()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = rows.mapInArrow(_search(files, k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column("embedding").combine_chunks()
    flat = np.asarray(lists.flatten())
    return np.asarray(table.column("vec_id")), flat.reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def _search(files: list[str], k: int):
    def blocks():
        import pyarrow.dataset as ds

        for file in files:
            path = file.removeprefix("file://")
            source = ds.dataset(path if path == file or path.startswith("/") else file, format="parquet")
            for batch in source.to_batches(columns=["vec_id", "embedding"], batch_size=BLOCK):
                if len(batch):
                    yield _matrix(pa.Table.from_batches([batch]))

    def best_of(held: list[pa.RecordBatch]):
        ids, rows = _matrix(pa.Table.from_batches(held))
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        for names, queries in blocks():
            scores = queries @ rows.T
            scores[names[:, None] == ids[None, :]] = -np.inf
            # Rows are in the order of their ids, so a stable sort settles ties.
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            told = np.take_along_axis(scores, best, axis=1).ravel()
            kept = np.isfinite(told)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])[kept]), pa.array(ids[best].ravel()[kept]), pa.array(told[kept])], ["query_id", "vec_id", "score"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= CHUNK:
                yield from best_of(held)
                held, n = [], 0
        if n:
            yield from best_of(held)

    return run


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def rerank(coarse: DataFrame, vectors: DataFrame, scorer: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """``query_id, vec_id, score, rank``: the coarse neighbours of each query by a second, dearer score of both vectors."""
    side = lambda key, name: vectors.select(F.col("vec_id").alias(key), F.col("embedding").alias(name))
    rows = coarse.select("query_id", "vec_id").join(side("query_id", "asked"), "query_id").join(side("vec_id", "held"), "vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = rows.select("query_id", "vec_id", F.round(scorer(F.col("asked"), F.col("held")), 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
