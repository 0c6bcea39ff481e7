import pytest

from graphloom.operators import closure as C
from graphloom.plans.compiler import compile_plan

NAMES = [("book", "星河"), ("book", "《星河》"), ("lin", "林岚"), ("uni", "明川大学"), ("city", "临江市"), ("twin1", "双名"), ("twin2", "双名")]
EDGES = [
    ("t1", 1, "book", "lin", None, "作者", True, "《星河》的作者是林岚。", True), ("t0", 0, "book", "hai", None, "作者", False, "作者", True), ("t2", 2, "lin", "uni", None, "毕业于", True, "林岚没有毕业于明川大学", True),
    ("t3", 3, "lin", "uni", None, "毕业于", True, "林岚毕业于明川大学", True), ("t4", 4, "uni", "city", None, "位于", True, "明川大学位于临江市。", True), ("t5", 5, "lin", None, "1980", "出生于", True, "林岚出生于1980", True),
    ("t6", 6, "uni", "hai", None, "位于", True, None, False),
]


def p(h, r, t, **k):
    return {"head": h, "relation": r, "tail": t, **k}


PLANS = {
    "chain": [p("?u", "位于", "?c"), p("?a", "毕业于", "?u"), p("《星河》", "作者", "?a")], "both": [p("星河", "作者", "林岚")], "twin": [p("双名", "作者", "?x")],
    "literal": [p("林岚", "出生于", "?litx", tail_kind="LITERAL")], "check_literal": [p("林岚", "出生于", "lit:1980")], "back": [p("?x", "位于", "临江市")], "none": [p("星河", "位于", "?x")], "forced": [p("明川大学", "位于", "?x")],
}


@pytest.fixture(scope="module")
def run(spark):
    rows = [r for q, plan in PLANS.items() for r in C.constraint_rows(q, compile_plan(plan))]
    constraints = spark.createDataFrame(rows, C.CONSTRAINT)
    names = spark.createDataFrame(NAMES, "entity_id string, norm string")
    edges = spark.createDataFrame(EDGES, "triple_id string, ord long, head_id string, tail_id string, tail_literal string, relation string, active boolean, quotes string, located boolean")
    forced = spark.createDataFrame([("forced", "c0", "t6", 0), ("forced", "c0", "t4", 1)], "question_id string, cid string, triple_id string, pos int")
    return {v: {r.question_id: r for r in C.closure(C.start(constraints), constraints, names, edges, forced, verify=v).collect()} for v in (True, False)}


def test_chain(run):
    r = run[True]["chain"]
    assert {k: v.id for k, v in r.bindings.items()} == {"?a": "lin", "?u": "uni", "?c": "city"}
    assert [(x.triple_id, x.n_rejected) for x in r.proofs] == [("t1", 0), ("t3", 1), ("t4", 0)]


def test_unverified_takes_the_first_edge(run):
    assert [x.triple_id for x in run[False]["chain"].proofs] == ["t1", "t2", "t4"]


def test_other_shapes(run):
    got = run[True]
    assert [x.triple_id for x in got["both"].proofs] == ["t1"] and got["twin"].reasons == ["AMBIGUOUS_ENTITY"] and not got["twin"].proofs
    assert got["literal"].bindings["?litx"].literal == "1980" and [x.triple_id for x in got["check_literal"].proofs] == ["t5"]
    assert got["back"].bindings["?x"].id == "uni" and not got["none"].proofs and "GRAPH_SOURCE_REJECT" in got["none"].reasons


def test_forced_order(run):
    assert run[True]["forced"].bindings["?x"].id == "city" and run[True]["forced"].proofs[0].n_rejected == 1
    assert run[False]["forced"].bindings["?x"].id == "hai"
