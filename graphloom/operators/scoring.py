"""Scores of finished runs against gold, and reports over methods.

Gold: ``question_id, group, answer, bridge, successor`` (structs of head, relation and tail, or null), ``support_quotes,
support_triple_ids``. It meets results here for the first time. A run without any proof has no precision, and
coverage says how many have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.score import exact_match, token_f1
from graphloom.operators.visits import chain
from graphloom.session import unsent

#: Methods that are compared, baseline first, and what is compared.
PAIRS = [("core00", "core11"), ("core11", "simple_bind"), ("core11", "cog_controlled"), ("core11", "iterative_text")]
PAIRED_FIELD = "successor_acquired"


def score_cases(outcomes: DataFrame, branches: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per run: answer scores, whether bridge and successor were acquired, support, precision and number of proofs."""
    pair = F.struct(F.col("head_name").alias("head"), "relation", F.col("tail_name").alias("tail"))
    told = chain(branches).groupBy("run_id").agg(F.collect_list(pair).alias("pairs"), F.concat_ws(" ", F.collect_list("quote")).alias("quotes"))
    ids = branches.select("run_id", F.explode(F.transform("proofs", lambda p: p["triple_id"])).alias("id")).groupBy("run_id").agg(F.collect_set("id").alias("ids"))
    kind = "array<struct<head:string,relation:string,tail:string>>"
    rows = outcomes.join(unsent(gold.withColumnRenamed("answer", "gold")), "question_id").join(unsent(told), "run_id", "left").join(unsent(ids), "run_id", "left")
    rows = rows.withColumns({"pairs": F.coalesce(F.col("pairs").cast(kind), F.array().cast(kind)), "quotes": F.coalesce("quotes", F.lit("")), "ids": F.coalesce("ids", F.array().cast("array<string>"))})
    has = lambda field: F.coalesce(F.exists("pairs", lambda p: same(p, F.col(field))), F.lit(False))

    def same(p: Column, wanted: Column) -> Column:
        return wanted.isNotNull() & (p["head"] == wanted["head"]) & (p["relation"] == wanted["relation"]) & (p["tail"] == wanted["tail"])

    hit = lambda p: F.coalesce(same(p, F.col("bridge")), F.lit(False)) | F.coalesce(same(p, F.col("successor")), F.lit(False))
    counted = (F.size("pairs") > 0) & (F.col("bridge").isNotNull() | F.col("successor").isNotNull())
    precision = F.when(counted, F.size(F.filter("pairs", hit)) / F.size("pairs"))
    support = F.forall("support_quotes", lambda q: F.contains("quotes", q)) & (F.size(F.array_except("support_triple_ids", "ids")) == 0)
    return rows.select(
        "run_id", "question_id", "preset", "group", "status", "answer", exact_match(F.col("gold"), F.col("answer")).alias("exact_match"), token_f1(F.col("gold"), F.col("answer")).alias("token_f1"),
        has("bridge").alias("bridge_acquired"), has("successor").alias("successor_acquired"), support.alias("complete_support"), precision.alias("proof_precision"), F.size("pairs").alias("proof_count"),
        precision.isNotNull().alias("precision_coverage"), "uncertain",
    )


def method_report(scores: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return scores.groupBy("preset").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("token_f1"), 6).alias("mean_f1"), share("successor_acquired").alias("successor_rate"), F.round(F.avg("proof_precision"), 6).alias("mean_proof_precision"), share("precision_coverage").alias("precision_coverage"),
    )


def failure_counts(scores: DataFrame) -> DataFrame:
    return scores.where("status <> 'COMPLETE'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def paired_report(scores: DataFrame, pairs: list[tuple[str, str]] = PAIRS, field: str = PAIRED_FIELD) -> DataFrame:
    """Mean difference between two methods on the questions that both have; a missing value leaves its question out of the mean only."""
    held = scores.select("question_id", "preset", F.col(field).cast("double").alias("value"))
    roles = F.explode(F.array(*[F.struct(F.lit(a).alias("baseline"), F.lit(b).alias("other")) for a, b in pairs])).alias("x")
    sides = held.select("*", roles).select("*", "x.*").where("preset in (baseline, other)")
    of = lambda role: F.max(F.when(F.col("preset") == F.col(role), F.col("value")))
    both = sides.groupBy("question_id", "baseline", "other").agg(of("baseline").alias("a"), of("other").alias("b"), F.countDistinct("preset").alias("n_held")).where("n_held = 2")
    return both.groupBy("baseline", "other").agg(F.lit(field).alias("field"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_delta"))
