"""What revoking a variable takes from a branch: every variable that depends on it, their bindings and proofs.

A variable depends on another if the plan writes it from there, or if a proof that stands on the
binding of the other produces it. Both form pairs, as many as a branch has pairs of variables, and the
closure runs inside the row: each step adds a variable or nothing, so as many steps as pairs suffice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = "array<struct<reads:string,writes:string>>"


def revocations(branches: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Per branch and variable that is bound or produced there: doomed variables, dropped bindings, revoked proofs.

    ``dependencies`` holds ``question_id, reads, writes`` of the plans. A binding that proofs stand on
    but the branch does not hold counts as a variable under its own id. Proofs that are invalid already show
    what depends on what, but are not revoked again.
    """
    texts = F.array().cast("array<string>")
    bound = F.map_filter(F.coalesce("bindings", F.map_from_arrays(texts, F.array()).cast(branches.schema["bindings"].dataType)), lambda k, v: v.isNotNull())
    proofs = F.filter(F.coalesce("accepted_evidence", F.array().cast(branches.schema["accepted_evidence"].dataType)), lambda e: e.isNotNull())
    rows = branches.select("question_id", "branch_id", bound.alias("bound"), proofs.alias("proofs"))
    plans = dependencies.groupBy("question_id").agg(F.collect_set(F.struct("reads", "writes")).cast(PAIRS).alias("planned"))
    rows = rows.join(plans, "question_id", "left")
    ids = F.transform(F.map_entries("bound"), lambda b: F.struct(b["value"]["binding_id"].alias("id"), b["key"].alias("name")))
    stands = F.array_distinct(F.transform(F.filter("proofs", lambda e: e["parent_binding_id"].isNotNull() & e["produces_variable"].isNotNull()), lambda e: F.struct(e["parent_binding_id"].alias("id"), e["produces_variable"].alias("writes"))))
    rows = rows.withColumn("ids", ids).withColumn("stands", stands)
    absent = F.array_except(F.filter(F.transform("proofs", lambda e: e["parent_binding_id"]), lambda x: x.isNotNull()), F.transform("ids", lambda b: b["id"]))
    rows = rows.withColumn("absent", absent).withColumn("ids", F.concat("ids", F.transform("absent", lambda x: F.struct(x.alias("id"), x.alias("name")))))
    shown = F.flatten(F.transform("ids", lambda b: F.transform(F.filter("stands", lambda s: s["id"] == b["id"]), lambda s: F.struct(b["name"].alias("reads"), s["writes"].alias("writes")))))
    rows = rows.withColumn("pairs", F.array_union(F.coalesce("planned", F.array().cast(PAIRS)), shown.cast(PAIRS)))
    made = F.filter(F.transform("proofs", lambda e: e["produces_variable"]), lambda v: v.isNotNull())
    rows = rows.withColumn("variable", F.explode(F.array_union(F.array_union(F.map_keys("bound"), made), F.col("absent"))))
    step = lambda doomed, _: F.array_union(doomed, F.transform(F.filter("pairs", lambda p: F.array_contains(doomed, p["reads"])), lambda p: p["writes"]))
    rows = rows.withColumn("lost", F.aggregate("pairs", F.array("variable"), step))
    rows = rows.withColumn("gone", F.transform(F.filter("ids", lambda b: F.array_contains("lost", b["name"])), lambda b: b["id"]))
    live = F.filter("proofs", lambda e: ~e["invalidated"])
    stood = lambda e: F.coalesce(F.array_contains("lost", e["produces_variable"]), F.lit(False)) | F.coalesce(F.array_contains("gone", e["parent_binding_id"]), F.lit(False))
    revoked = F.transform(F.filter(live, stood), lambda e: e["proof_id"])
    listed = lambda names: F.array_join(F.array_sort(names), ",")
    dropped = F.filter(F.map_keys("bound"), lambda k: F.array_contains("lost", k))
    return rows.select("question_id", "branch_id", "variable", listed("lost").alias("doomed"), listed(dropped).alias("dropped"), revoked.alias("revoked"), F.size(live).alias("n_proofs"))
