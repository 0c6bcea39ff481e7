"""Sources mixed to target weights of the total size, small ones repeated up to a cap.

The total is the largest at which every source that has both a target and documents can fill its
share without exceeding its cap; targets without documents give theirs up in proportion. Each
source then has its expected number of copies per document: the whole part is certain, the
fraction is an inclusion probability.

Method: Pareto order sampling. Inclusion probabilities within a source are proportional to a power of
a document's size, by default to its size itself: documents whose share reaches 1 are certain, and the
factor of the others is solved exactly so that the expected size is the remaining one. A document's rank is
the odds of its random number over the odds of its inclusion probability (0 for a certain one), and of each
source the documents of lowest rank are taken until its remaining size is met, as near as one document
allows. The random number is a hash of seed and document, so the sample is the same at any parallelism.

Plan: sizes are summed per source, then per source and size (one row per number of tokens that occurs),
then per source and rank interval; the interval in which a source's size is met is the only one that is
sorted, 1 / BINS of its documents. The plan, the ranks and that interval of each source are written once and read
by what follows. No source is ever gathered in one task, nothing is collected,
and whether a small side is broadcast is left to its measured size.

Edge cases: documents without a source, without tokens, or of a source without a target have no
row. Repeated document keys are sampled alike. A target of 0, a null target or a cap below 1
takes no documents. No documents at all give an empty mix and a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.session import written

BINS = 4096
SEED = 17


def mix_plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """What each target source contributes; one row per row of ``targets``."""
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = targets.select("source", "target_share", F.col("max_repeats").cast("long").alias("max_repeats")).distinct().join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    rows = rows.withColumn("live", F.coalesce((F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1), F.lit(False)))
    most = F.min(F.when(F.col("live"), F.col("available") * F.col("max_repeats") / F.col("target_share")))
    whole, most = rows.agg(F.sum(F.when(F.col("live"), F.col("target_share")))).scalar(), rows.agg(most).scalar()
    rows = rows.withColumns({"whole": whole, "size": most}).withColumn("size", F.col("size") * F.col("whole"))
    size = F.col("size") if total is None else F.least(F.lit(float(total)), F.col("size"))
    rows = rows.withColumn("goal", F.when(F.col("live"), size * F.col("target_share") / F.col("whole")).otherwise(0.0))
    epochs = F.when(F.col("live"), F.col("goal") / F.col("available")).otherwise(0.0)
    certain = F.floor(epochs + 1e-9)
    return rows.select("source", "target_share", "max_repeats", "available", "goal", certain.cast("long").alias("certain"), F.greatest(F.lit(0.0), F.col("goal") - certain * F.col("available")).alias("need"))


def inclusion(docs: DataFrame, size_power: float) -> DataFrame:
    """``source, factor, sure_above`` for documents with ``need``: those of more tokens are certain, the others
    have the probability factor * n_tokens ** size_power, and the expected size is ``need``."""
    n = F.col("n_tokens").cast("double")
    each = docs.groupBy("source", "n_tokens").agg(F.sum(n).alias("t"), F.sum(F.pow(n, F.lit(size_power)) * n).alias("w"), F.max("need").alias("need"))
    upto = W.partitionBy("source").orderBy("n_tokens")
    above = F.sum("t").over(W.partitionBy("source")) - F.sum("t").over(upto)
    each = each.withColumn("factor", (F.col("need") - above) / F.sum("w").over(upto))
    fits = each.where(F.col("factor") * F.pow(n, F.lit(size_power)) <= 1)
    return fits.groupBy("source").agg(F.max_by("factor", "n_tokens").alias("factor"), F.max("n_tokens").alias("sure_above"))


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, size_power: float = 1.0, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with their ``copies``, report of shares reached) for ``sizes`` with columns
    ``doc_id, source, n_tokens``, which should be a written table: it is read several times."""
    sizes = sizes.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    plan = written(mix_plan(sizes, targets, total), "mix-plan")
    docs = sizes.join(plan.where("goal > 0").select("source", "certain", "need"), "source")
    docs = docs.join(inclusion(docs.where("need > 0"), size_power), "source", "left")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(2.0**53)
    chance = F.col("factor") * F.pow(F.col("n_tokens").cast("double"), F.lit(size_power))
    rank = F.when((F.col("n_tokens") > F.col("sure_above")) | (chance >= 1), 0.0).otherwise((u / (1 - u)) / (chance / (1 - chance)))
    docs = written(docs.withColumn("rank", rank), "mix-ranks").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.lit(BINS) * F.col("rank") / (1 + F.col("rank")))).cast("int"))
    upto = W.partitionBy("source").orderBy("bin")
    bins = docs.where("rank is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"), F.max("need").alias("need")).withColumn("through", F.sum("t").over(upto))
    edges = bins.where("through > need").groupBy("source").agg(F.min("bin").alias("edge"), F.min_by(F.col("through") - F.col("t"), "bin").alias("before"))
    docs = docs.join(written(edges, "mix-edges"), "source", "left")
    sure = docs.where("rank is not null and (edge is null or bin < edge)").withColumn("taken", F.lit(1))
    edge = docs.where("bin = edge")
    reached = F.col("before") + F.sum("n_tokens").over(W.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("taken", (reached - F.col("n_tokens") / 2 <= F.col("need")).cast("int"))
    rest = docs.where("rank is null or bin > edge").withColumn("taken", F.lit(0))
    chosen = sure.unionByName(edge).unionByName(rest).select("doc_id", "source", "n_tokens", (F.col("certain") + F.col("taken")).alias("copies")).where("copies > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.col("goal").alias("goal_tokens"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("used_tokens", "n_copies", "most_copies")],
    )
    every = report.agg(F.greatest(F.lit(1), F.sum("used_tokens"))).scalar()
    return chosen, report.withColumn("reached_share", F.col("used_tokens") / every)
