"""Graph closure of compiled plans for whole sets of questions.

The state of a question's branch is one row: bindings of variables, constraints proven, proofs, reasons. The
constraints of one rank are answered together for all questions by joins with the edges on the
end that is bound; only the first supported edge of each constraint counts, and it is found by
an aggregate that combines on the map side, so a hub's edges never stand in one task. As a
constraint depends only on lower ranks, one pass over the ranks reaches the fixpoint.

What is asked of the graph is asked once: branches that ask the same (ends, variants, switch) share one row
of the join, so many branches at one hub cost its edges once.

Tables: constraints (``CONSTRAINT``; for a constant the name, for a variable its ``?name``), names
(``entity_id, norm``), edges (``triple_id, ord, head_id, tail_id, tail_literal, relation, active, quotes, located``, and
where they are known ``head_name, tail_name, quote, sent_index``) and forced edges (``question_id, cid,
triple_id, pos``), which are tried instead, in their order, where an entity is asked for.

Edge cases: a name of no or of several entities answers nothing (reason ``AMBIGUOUS_ENTITY`` for
several). A variable bound to a literal waits. An accepted edge without the end that is asked
for leaves the constraint open, and no further edge is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import norm_name
from graphloom.functions.verify import graph_verdict
from graphloom.plans.compiler import Plan, topo_ranks
from graphloom.session import unsent, written

CONSTRAINT = (
    "question_id string, cid string, idx int, rank int, head_kind string, head string, head_value string, tail_kind string, tail string, tail_value string, "
    "relation string, variants array<string>, terminal boolean, depends_on array<string>, reads array<string>, writes array<string>"
)
PROOF = (
    "array<struct<cid:string,kind:string,triple_id:string,head_id:string,tail_id:string,tail_literal:string,head_name:string,relation:string,tail_name:string,"
    "quote:string,sent_index:int,produces:string,produced:string,parent:string,reason:string,n_rejected:bigint,invalidated:boolean>>"
)
BINDINGS = "map<string,struct<id:string,literal:string>>"
#: Verdicts on an edge that refuse it, and the decision that each stands for.
REFUSED = {"DIRECTION_MISMATCH": "UNKNOWN", "RELATION_MISMATCH": "UNKNOWN", "SOURCE_UNLOCATABLE": "UNKNOWN", "GRAPH_SOURCE_REJECT": "CONFLICT"}
TEXTS = "array<string>"


def constraint_rows(question_id: str, plan: Plan) -> list[tuple]:
    ranks = topo_ranks(plan)
    reads = lambda c: list(dict.fromkeys(t.text for t in (c.head, c.tail) if t.kind == "variable" and t.text not in c.writes))
    return [
        (question_id, c.cid, n, ranks[c.cid], c.head.kind, c.head.text, c.head.value, c.tail.kind, c.tail.text, c.tail.value, c.relation, list(c.variants), c.terminal, list(c.depends_on), reads(c), list(c.writes))
        for n, c in enumerate(plan.constraints)
    ]


def blank_state() -> dict[str, Column]:
    """The columns of a branch that knows nothing yet."""
    none = F.array().cast(TEXTS)
    return {"bindings": F.map_from_arrays(none, F.array()).cast(BINDINGS), "proofs": F.array().cast(PROOF), "reasons": none, "decisions": none}


def start(constraints: DataFrame) -> DataFrame:
    rows = constraints.select("question_id").distinct()
    return rows.select("question_id", F.concat("question_id", F.lit("/b0")).alias("branch_id"), *[c.alias(n) for n, c in blank_state().items()])


def resolved(constraints: DataFrame, names: DataFrame) -> DataFrame:
    """Constants looked up once: the one entity of a name, and how many have it."""
    known = names.groupBy("norm").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("id"))
    out = constraints
    for end in ("head", "tail"):
        k = unsent(known.select(F.col("norm").alias(f"{end}_norm"), F.col("n").alias(f"{end}_n"), F.col("id").alias(f"{end}_const")))
        norm = F.when(F.col(f"{end}_kind") == "entity", norm_name(F.col(end)))
        out = out.withColumn(f"{end}_norm", norm).join(k, f"{end}_norm", "left").drop(f"{end}_norm")
    return out


def closure(state: DataFrame, constraints: DataFrame, names: DataFrame, edges: DataFrame, forced: DataFrame | None = None, verify: bool | Column = True) -> DataFrame:
    """The state after every constraint that the graph can answer is answered. ``verify`` may be a column of the
    state; constraints may come ``resolved``, and further columns of the state are carried along."""
    table = constraints if "head_n" in constraints.columns else unsent(written(resolved(constraints, names), "constraints"))
    top = table.agg(F.max("rank")).first()[0]
    for rank in range(0, (top if top is not None else -1) + 1):
        state = unsent(written(_step(state, table.where(F.col("rank") == rank), edges, forced, verify), "state"))
    return state


def ends(end: str) -> tuple[Column, Column]:
    """(entity id of a bound end, whether the end is an open variable) of a state row joined with a resolved constraint."""
    bound = F.col("bindings")[F.col(end)]
    constant = F.when(F.col(f"{end}_n") == 1, F.col(f"{end}_const"))
    return F.when(F.col(f"{end}_kind") == "variable", bound["id"]).when(F.col(f"{end}_kind") == "entity", constant), (F.col(f"{end}_kind") == "variable") & bound.isNull()


def vague() -> Column:
    """A constant end that several entities bear."""
    return (F.coalesce("head_n", F.lit(0)) > 1) | (F.coalesce("tail_n", F.lit(0)) > 1)


def proven(cid: Column) -> Column:
    return F.exists("proofs", lambda p: (p["cid"] == cid) & ~p["invalidated"])


def parent_of(reads: Column) -> Column:
    """The first variable read that is bound."""
    return F.try_element_at(F.filter(reads, lambda v: F.col("bindings")[v].isNotNull()), F.lit(1))


def shape_of() -> Column:
    (h, h_open), (t, t_open) = ends("head"), ends("tail")
    return (
        F.when(vague(), "ambiguous").when(h.isNotNull() & t_open, "from_head").when(t.isNotNull() & h_open, "from_tail")
        .when(h.isNotNull() & t.isNotNull(), "both").when(h.isNotNull() & (F.col("tail_kind") == "literal"), "literal")
        .when(t.isNotNull() & (F.col("head_kind") == "literal"), "literal_head").otherwise("wait")
    )


def _step(state: DataFrame, constraints: DataFrame, edges: DataFrame, forced: DataFrame | None, verify: bool | Column) -> DataFrame:
    checked = F.lit(verify) if isinstance(verify, bool) else verify
    rows = state.join(unsent(constraints), "question_id").where(~proven(F.col("cid")))
    h, t, shape = ends("head")[0], ends("tail")[0], shape_of()
    asked = rows.select("question_id", "branch_id", "cid", "head", "tail", "head_value", "tail_value", "variants", parent_of(F.col("reads")).alias("parent"), h.alias("h"), t.alias("t"), shape.alias("shape"), checked.alias("checked"))
    told = F.when(F.col("shape") == "literal", F.col("tail")).when(F.col("shape") == "literal_head", F.col("head"))
    asked = asked.withColumn("told", told).withColumn("ask", F.to_json(F.struct("shape", "h", "t", "told", "variants", "checked")))
    nil = F.lit(None).cast("string")
    if forced is None:
        asked = asked.withColumn("given", F.lit(False))
    else:
        asked = asked.join(unsent(forced.select("question_id", "cid", F.lit(True).alias("has")).distinct()), ["question_id", "cid"], "left")
        free = F.when(F.col("shape") == "from_head", F.col("tail_value")).when(F.col("shape") == "from_tail", F.col("head_value"))
        asked = asked.withColumn("given", F.coalesce(F.col("has") & (free == "entity"), F.lit(False))).drop("has")
        asked = asked.withColumn("ask", F.when(F.col("given"), F.to_json(F.struct("ask", "question_id", "cid"))).otherwise(F.col("ask")))
    asked = unsent(written(asked, "asked"))
    each = asked.where("shape not in ('ambiguous', 'wait')")
    asks = each.select("ask", "shape", "h", "t", "told", "variants", "checked", "given").distinct()
    for name, kind in (("head_name", "string"), ("tail_name", "string"), ("quote", "string"), ("sent_index", "int")):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(None).cast(kind))
    e = unsent(edges).where("active").select("triple_id", "ord", "head_id", "tail_id", "tail_literal", F.col("relation").alias("edge_relation"), "quotes", "located", "head_name", "tail_name", "quote", "sent_index")
    by_head = asks.where("not given and shape in ('from_head', 'both', 'literal')").join(e, F.col("h") == F.col("head_id"))
    by_head = by_head.where("shape = 'from_head' or (shape = 'both' and tail_id = t) or (shape = 'literal' and tail_literal = told)")
    by_tail = asks.where("not given and shape in ('from_tail', 'literal_head')").join(e, F.col("t") == F.col("tail_id"))
    by_tail = by_tail.where("shape = 'from_tail' or tail_literal = told")
    pool = by_head.unionByName(by_tail).withColumn("pos", F.lit(None).cast("int"))
    if forced is not None:
        wanted = each.where("given").select("ask", "question_id", "cid").distinct().join(forced, ["question_id", "cid"]).select("ask", "triple_id", "pos")
        pool = pool.unionByName(asks.where("given").join(wanted, "ask").join(e, "triple_id").select(*pool.columns))
    right = (F.col("h").isNull() | (F.col("head_id") == F.col("h"))) & (F.col("t").isNull() | F.coalesce(F.col("tail_id") == F.col("t"), F.lit(False)))
    pool = pool.withColumn("v", graph_verdict(right, F.col("edge_relation"), F.col("variants"), F.col("quotes"), F.col("located"), F.col("pos").isNotNull(), F.col("checked")))
    place = F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), F.col("ord"), F.col("triple_id").alias("tie"))
    ok = F.col("v.decision") == "SUPPORTED"
    edge = F.struct("triple_id", "head_id", "tail_id", "tail_literal", "head_name", F.col("edge_relation").alias("relation"), "tail_name", "quote", "sent_index", F.col("v.reason").alias("reason"))
    best = pool.groupBy("ask").agg(
        F.min(F.when(ok, place)).alias("first"), F.min_by(edge, F.when(ok, place)).alias("edge"),
        *[F.min(F.when(~ok & (F.col("v.reason") == r), place)).alias(r) for r in REFUSED],
    )
    before = lambda r: F.col(r).isNotNull() & (F.col("first").isNull() | (F.col(r) < F.col("first")))
    none = F.array().cast(TEXTS)
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    best = unsent(best).select(
        "ask", "first", "edge", some(F.array(*[F.when(before(r), F.lit(r)) for r in REFUSED])).alias("refused"),
        some(F.array(*[F.when(before(r), F.lit(d)) for r, d in REFUSED.items()])).alias("refusals"),
    )
    earlier = pool.select("ask", place.alias("place")).join(best.where("size(refused) > 0").select("ask", "first"), "ask").where("place < first").groupBy("ask").agg(F.count(F.lit(1)).alias("n_rejected"))
    got = asked.join(best, "ask", "left").join(unsent(earlier), "ask", "left")
    literal = (F.col("shape") == "from_head") & (F.col("tail_value") == "literal")
    pair = lambda a, b: F.struct(a.alias("id"), b.alias("literal"))
    value = F.when(literal, pair(nil, F.nullif(F.col("edge.tail_literal"), F.lit("")))).when(F.col("shape") == "from_head", pair(F.col("edge.tail_id"), nil)).when(F.col("shape") == "from_tail", pair(F.col("edge.head_id"), nil))
    got = got.withColumn("value", value).withColumn("variable", F.when(F.col("shape") == "from_head", F.col("tail")).when(F.col("shape") == "from_tail", F.col("head"))).withColumn("spelled", F.when(literal, F.col("edge.tail_literal")).otherwise(F.col("told")))
    produced = F.coalesce("value.id", "value.literal")
    done = F.col("first").isNotNull() & (F.col("variable").isNull() | produced.isNotNull())
    proof = F.struct(
        "cid", F.lit("GRAPH").alias("kind"), "edge.triple_id", "edge.head_id", F.when(F.col("spelled").isNull(), F.col("edge.tail_id")).alias("tail_id"), F.col("spelled").alias("tail_literal"), "edge.head_name", "edge.relation",
        F.coalesce("spelled", "edge.tail_name", "edge.tail_literal").alias("tail_name"), "edge.quote", "edge.sent_index", F.col("variable").alias("produces"), produced.alias("produced"), "parent", "edge.reason",
        F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), F.lit(False).alias("invalidated"),
    )
    reason = F.when(F.col("shape") == "ambiguous", F.array(F.lit("AMBIGUOUS_ENTITY"))).otherwise(F.concat(F.coalesce("refused", none), some(F.array("edge.reason"))))
    decided = F.concat(F.coalesce("refusals", none), F.when(F.col("first").isNotNull(), F.array(F.lit("SUPPORTED"))).otherwise(none))
    # At most one row per constraint of a plan: these lists are as long as a plan.
    news = got.groupBy("branch_id").agg(
        F.collect_list(F.when(done & F.col("variable").isNotNull(), F.struct("variable", "value"))).alias("bound"),
        F.array_sort(F.collect_list(F.when(done, proof))).alias("proven"), F.array_distinct(F.flatten(F.collect_list(reason))).alias("why"), F.array_distinct(F.flatten(F.collect_list(decided))).alias("decided"),
    )
    carried = [c for c in state.columns if c not in ("question_id", "branch_id", "bindings", "proofs", "reasons", "decisions")]
    out = state.join(unsent(news), "branch_id", "left")
    return out.select(
        "question_id", "branch_id",
        F.map_concat("bindings", F.map_from_entries(F.coalesce("bound", F.array().cast("array<struct<variable:string,value:struct<id:string,literal:string>>>")))).alias("bindings"),
        F.concat("proofs", F.coalesce("proven", F.array()).cast(PROOF)).alias("proofs"),
        F.array_union("reasons", F.coalesce("why", none)).alias("reasons"), F.array_union("decisions", F.coalesce("decided", none)).alias("decisions"), *carried,
    )
