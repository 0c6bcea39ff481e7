import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import flatten as N

TREES = st.recursive(st.none() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=25)


@given(TREES)
def test_intervals_contain_exactly_what_lies_below(tree):
    nodes = sorted(N.label(tree, frozenset()), key=lambda n: n[0])
    assert [n[0] for n in nodes] == list(range(len(nodes)))
    for a in nodes:
        below = {b[0] for b in nodes if a[0] < b[0] <= a[1]}
        grown = {a[0]}
        for b in nodes:
            if b[2] in grown:
                grown.add(b[0])
        assert below == grown - {a[0]}


def _found(spark, *texts):
    df = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "id string, phase2_json string")
    return {(r.rec_key, r.path) for r in N.evidence_nodes(df, [N.PHASE2_CHILD]).where("kind = 'object'").collect()}


def test_shapes(spark):
    spelled = json.dumps([{}, None, 3])
    got = _found(
        spark,
        '{"triples_evidence": [null, {"candidate_evidences": [{"a": 1}, null, "x", {}]}]}',
        '{"triples_evidence": {"candidate_evidences": {"a": 1}}}',
        json.dumps({"triples_evidence": json.dumps([{"candidate_evidences": spelled}])}),
        '{"triples_evidence": [{"candidate_evidences": "none"}, {"candidate_evidences": 5}, {}]}',
        '{"triples_evidence": [{"candidate_evidences": [{}]}',
        '{"triples_evidence": NaN}',
        None,
        "[]",
    )
    path = "triples_evidence/{}/candidate_evidences/{}".format
    assert got == {("0", path(1, 0)), ("0", path(1, 3)), ("1", path(0, 0)), ("2", path(0, 0))}


def test_branches(spark):
    inner = "array<struct<proof_id:string,source:struct<quote:string>>>"
    rows = [("q", "b", [("p", ("x",)), None, ("r", None)], {"?a/b": ("n",), "?c": None}), ("q", "b", [("p", ("x",)), None, ("r", None)], {"?a/b": ("n",), "?c": None}), ("q", "c", None, {}), ("q", "d", [], None)]
    df = spark.createDataFrame(rows, f"question_id string, branch_id string, accepted_evidence {inner}, bindings map<string,struct<name:string>>")
    none = spark.createDataFrame([], "id string, phase2_json string")
    got = sorted((r.rec_key, r.child_path) for r in N.child_objects(none, df).collect())
    assert got == [("q/b", "accepted_evidence/0"), ("q/b", "accepted_evidence/0/source"), ("q/b", "accepted_evidence/2"), ("q/b", "bindings/?a/b")]


def test_long_array_half_surrogates_and_links(spark):
    body = json.dumps({"triples_evidence": [{"candidate_evidences": [{"t": "\ud800"}] * 30_000}]})
    df = spark.createDataFrame([("1", body), ("1", body)], "id string, phase2_json string")
    kinds = ["triples_evidence/*", N.PHASE2_CHILD]
    linked = N.linked(N.evidence_nodes(df, kinds), {kinds[1]: kinds[0]})
    assert linked.count() == 30_000 and linked.where("parent_path = 'triples_evidence/0'").count() == 30_000
    assert N.evidence_nodes(df).where(F.col("node_type").endswith("/t")).distinct().count() == 30_000


def test_deliveries_of_one_key_with_other_bodies_do_not_mix(spark):
    bodies = [json.dumps({"triples_evidence": [{"candidate_evidences": [{}] * n}, {"candidate_evidences": [{}]}]}) for n in (3, 1)]
    df = spark.createDataFrame([("1", b) for b in bodies + bodies], "id string, phase2_json string")
    got = sorted((r.parent_path, r.place) for r in N.linked(N.evidence_nodes(df), {N.PHASE2_CHILD: N.PHASE2_PARENT}).collect())
    place = "candidate_evidences/{}".format
    assert got == [("triples_evidence/0", place(n)) for n in (0, 0, 1, 2)] + [("triples_evidence/1", place(0))] * 2


def test_depth_and_numbers_beyond_the_library(spark):
    deep = '{"triples_evidence": [{"candidate_evidences": [{"a": ' + "[" * 60_000 + "]" * 60_000 + '}, {"n": ' + "9" * 5_000 + "}]}]}"
    assert len(_found(spark, deep, deep[:-1], '{"triples_evidence": [{"candidate_evidences": [{"n": ' + "9" * 5_000 + "}]}]}")) == 3


@given(TREES)
def test_the_deep_reader_agrees_with_the_library(tree):
    text = json.dumps(tree, indent=1)
    assert N._parsed_deep(text) == (tree, True)
    for broken in (text + "]", text[:-1] + ",", "[" + text):
        assert N._parsed_deep(broken)[1] == N.parsed(broken)[1]


def test_empty(spark):
    assert N.evidence_nodes(spark.createDataFrame([], "id string, phase2_json string")).count() == 0
