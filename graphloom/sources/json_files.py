"""JSON sources and sinks: lines with their numbers, lists, a graph directory, nested contexts, traces."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class InputError(ValueError):
    """An input that breaks its contract; the message names place and fault."""


def require_path(path: str, directory: bool = False) -> str:
    """The path if it exists and is of that kind. Paths with a scheme are left to Spark."""
    if "://" not in path and not (os.path.isdir(path) if directory else os.path.exists(path)):
        beside = os.path.join(os.path.dirname(os.path.dirname(path)), "planner_queries", os.path.basename(path))
        raise InputError(f"{path}: no such {'folder' if directory else 'file'}" + (f"; is {beside} meant?" if os.path.exists(beside) else ""))
    return path


#: What ends a line besides the line feed and the carriage return.
LINE_ENDS = "[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of every line, numbered from 0 over the file in order.

    Rows are numbered inside each partition; one row per partition carries where it begins.
    """
    n = F.monotonically_increasing_id()
    cut = spark.read.text(require_path(path)).select(F.explode(F.split("value", LINE_ENDS)).alias("value"))
    lines = cut.select(F.shiftright(n, 33).alias("part"), n.bitwiseAND((1 << 33) - 1).alias("at"), "value")
    sizes = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    return lines.join(begins, "part").select((F.col("begin") + F.col("at")).alias("line_no"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with ``line_no``; blank lines are skipped but keep their number, a broken line is an error with its place."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = lines.select("line_no", "value", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    bad = rows.where(F.col("r").isNull() | F.col("r._broken").isNotNull()).agg(F.min("line_no")).first()[0]
    if bad is not None:
        raise InputError(f"{path}:{bad + 1}: no valid JSON object")
    return rows.select("line_no", "r.*").drop("_broken")


def read_json_list(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON list, or of the list under ``data``; items that are no objects are left out.

    Such a file is one value and is read by one task; its items are told apart there and parsed wherever they land. Without a
    ``schema`` (DDL) it is inferred from all items.
    """
    text = spark.read.text(require_path(path), wholetext=True)
    items = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "data array<string>")["data"])
    rows = text.select(F.explode(items).alias("item")).where(F.ltrim("item").startswith("{"))
    if schema is None:
        return spark.read.json(rows.rdd.map(lambda r: r[0]))
    return rows.select(F.from_json("item", schema).alias("r")).select("r.*")


def read_graph_directory(spark: SparkSession, path: str, namespace: str) -> dict[str, DataFrame]:
    """entities, triples, title_triples and title_entities of a folder of JSON lines.

    Ids become ``namespace:id``; a triple's id is its place and never changes. The last row of a
    repeated title wins. Missing fields and references to unknown ids are errors.
    """
    at = lambda name: os.path.join(require_path(path, directory=True), f"{name}.jsonl")
    key = lambda c: F.concat(F.lit(f"{namespace}:"), c.cast("string"))
    e = read_json_lines(spark, at("entities"), "id long, name string, type string, aliases array<string>")
    t = read_json_lines(spark, at("triples"), "h long, head long, r string, relation string, t long, tail long, title string, evidence string")
    t = t.select("line_no", F.coalesce("h", "head").alias("h"), F.coalesce("r", "relation").alias("relation"), F.coalesce("t", "tail").alias("t"), "title", "evidence")
    for rows, test, name in ((e, "id is null or name is null", "entities"), (t, "h is null or relation is null or t is null", "triples")):
        if (bad := rows.where(test).agg(F.min("line_no")).first()[0]) is not None:
            raise InputError(f"{at(name)}:{bad + 1}: a required field is missing")
    if (lost := t.select(F.explode(F.array("h", "t")).alias("id")).join(e, "id", "left_anti").first()) is not None:
        raise InputError(f"{at('triples')}: unknown entity {lost[0]}")
    out = {
        "entities": e.select(key(F.col("id")).alias("entity_id"), F.col("name").alias("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.col("id").alias("upstream_id"), F.col("type").alias("entity_type")),
        "triples": t.select(F.col("line_no").cast("string").alias("triple_id"), F.col("line_no").alias("upstream_index"), key(F.col("h")).alias("head_id"), "relation", key(F.col("t")).alias("tail_id"), F.lit(True).alias("active"), "title", F.col("evidence").alias("quote"), (F.col("evidence").isNull() | F.col("title").isNull()).alias("ambiguous")),
    }
    for name, field, ids in (("title2triples", "triple_idxs", t.select(F.col("line_no").alias("x"))), ("title2entities", "entity_ids", e.select(F.col("id").alias("x")))):
        m = read_json_lines(spark, at(name), f"title string, {field} array<long>").groupBy("title").agg(F.max_by(field, "line_no").alias("ids"))
        m = m.select("title", F.posexplode("ids").alias("pos", "x"))
        if (lost := m.join(ids, "x", "left_anti").first()) is not None:
            raise InputError(f"{at(name)}: unknown id {lost['x']}")
        out["title_triples" if field == "triple_idxs" else "title_entities"] = m.select("title", "pos", (F.col("x").cast("string") if field == "triple_idxs" else key(F.col("x"))).alias("id"))
    return out


def example_id(df: DataFrame) -> Column:
    """The first of ``id``, ``_id``, ``qid`` that the table has."""
    for c in ("id", "_id", "qid"):
        if c in df.columns:
            return F.col(c).cast("string")
    raise InputError("no id, _id or qid")


def sentences(rows: DataFrame, key: str, context: str) -> DataFrame:
    """``key, doc_index, title, sent_index, sentence`` of a nested context in JSON.

    An item is ``[title, [sentence, ...]]``, ``[title, sentence]`` or an object with a title and
    ``sentences``, ``sents`` or ``text``. Other items are skipped but keep their place.
    """
    items = rows.select(key, F.posexplode(F.from_json(context, "array<string>")).alias("doc_index", "item")).where("item is not null")
    pair = F.from_json("item", "array<string>")
    rest = pair[1]
    many = lambda text: F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    o = F.from_json("item", "title string, sentences array<string>, sents array<string>, text string")
    as_object = F.trim("item").startswith("{")
    title = F.trim(F.when(as_object, o["title"]).otherwise(pair[0]))
    told = F.when(as_object, F.coalesce(o["sentences"], o["sents"], F.when(o["text"].isNotNull(), many(o["text"])))).when((F.size(pair) == 2) & rest.isNotNull(), many(rest))
    return items.select(key, "doc_index", title.alias("title"), F.posexplode(told).alias("sent_index", "sentence")).where("sentence is not null")


def append_trace(events: DataFrame, path: str) -> None:
    """Trace events as JSON lines beside those of earlier runs."""
    events.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def synthetic_cohort(spark: SparkSession, n: int) -> DataFrame:
    """n questions, each with a decoy edge at an even place and the real one after it."""
    q = spark.range(n).select(F.format_string("q%04d", "id").alias("question_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("real"), "id")
    return q.select("question_id", (F.col("id") * 2 + F.col("real")).alias("upstream_index"), F.concat(F.lit("syn:"), (F.col("id") * 2).cast("string")).alias("head_id"), F.when(F.col("real") == 1, "member of").otherwise("met").alias("relation"), F.concat(F.lit("syn:"), (F.col("id") * 2 + 1).cast("string")).alias("tail_id"), (F.col("real") == 1).alias("real"))


def cohort_audit(cohort: DataFrame) -> DataFrame:
    """``question_id, n_edges, n_real, real_index, ok``: one decoy and one real edge each, the real one after it with the same ends."""
    real = F.when(F.col("real"), F.col("upstream_index"))
    decoy = F.when(~F.col("real"), F.col("upstream_index"))
    each = cohort.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("real").alias("n_real"), F.min(real).alias("real_index"), F.min(decoy).alias("decoy_index"), F.countDistinct("head_id", "tail_id").alias("n_ends"))
    return each.select("question_id", "n_edges", "n_real", "real_index", F.coalesce((F.col("n_edges") == 2) & (F.col("n_real") == 1) & (F.col("real_index") == F.col("decoy_index") + 1) & (F.col("n_ends") == 1), F.lit(False)).alias("ok"))
