from graphloom.operators import revoke
from graphloom.plans.compiler import compile_plan, dependencies

BRANCH = "question_id string, branch_id string, bindings map<string,struct<binding_id:string>>, accepted_evidence array<struct<proof_id:string,parent_binding_id:string,produces_variable:string,invalidated:boolean>>"


def test_revocation_reaches_all_that_depends(spark):
    proofs = [("p0", None, "?a", False), ("p1", "i-a", "?b", False), ("p2", "i-b", "?c", False), ("p3", "i-b", None, True), ("p4", None, "?d", False), None, ("p5", "i-d", None, False), ("p6", "i-z", "?c", False)]
    rows = [("q", "b0", {"?a": ("i-a",), "?b": ("i-b",), "?c": ("i-c",), "?d": ("i-d",), "?e": None}, proofs), ("q", "b1", None, None), ("r", "b0", {"?a": ("i-a",)}, None)]
    plans = spark.createDataFrame([("q", "?d", "?e"), ("r", "?a", "?b")], "question_id string, reads string, writes string")
    got = {(r.question_id, r.branch_id, r.variable): (r.doomed, r.dropped, r.revoked, r.n_proofs) for r in revoke.revocations(spark.createDataFrame(rows, BRANCH), plans).collect()}
    assert got == {
        ("q", "b0", "?a"): ("?a,?b,?c", "?a,?b,?c", ["p0", "p1", "p2", "p6"], 6), ("q", "b0", "?b"): ("?b,?c", "?b,?c", ["p1", "p2", "p6"], 6), ("q", "b0", "?c"): ("?c", "?c", ["p2", "p6"], 6),
        ("q", "b0", "?d"): ("?d,?e", "?d", ["p4", "p5"], 6), ("q", "b0", "i-z"): ("?c,i-z", "?c", ["p2", "p6"], 6), ("r", "b0", "?a"): ("?a,?b", "?a", [], 0),
    }


def test_dependencies_of_a_plan():
    triple = lambda h, t: {"head": h, "relation": "r", "tail": t}
    assert dependencies(compile_plan([triple("x", "?a"), triple("?a", "?b")])) == {("?a", "?b")}
