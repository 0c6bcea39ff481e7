from pyspark.sql import functions as F

from graphloom.functions import score, verify
from graphloom.operators import audit, graph
from graphloom.plans.compiler import compile_plan, dependencies, parse_term, topo_ranks


def p(head, relation, tail, **more):
    return {"head": head, "relation": relation, "tail": tail, **more}


CHAIN = [p("book", "author", "?a"), p("?a", "studied at", "?u"), p("?u", "lies in", "?c")]


def test_terms():
    assert parse_term("?x").kind == "variable" and parse_term("lit:5").text == "5" and parse_term("x").kind == "entity"
    assert parse_term("?y", "LITERAL").value == "literal" and parse_term("y", "VARIABLE").text == "?y"


def test_chain_ranks_and_successors():
    plan = compile_plan(CHAIN)
    assert plan.supported and plan.answer == "?c" and topo_ranks(plan) == {"c0": 0, "c1": 1, "c2": 2}
    assert [c.terminal for c in plan.constraints] == [False, False, True]
    assert dependencies(plan) == {("?a", "?u"), ("?u", "?c")}


def test_order_does_not_matter():
    plan = compile_plan(CHAIN[::-1])
    assert plan.producers["?a"] == "c2" and plan.constraints[0].terminal and plan.answer == "?c"


def test_refusals():
    assert compile_plan([]).reason == "PLAN_EMPTY"
    assert compile_plan([p("?a", "r", "?b")]).reason == "PLAN_CYCLE"
    assert compile_plan([p("?a", "r", "?b"), p("?b", "r", "?a")]).reason == "PLAN_CYCLE"
    assert compile_plan([p("x", "r", "?a"), p("y", "r", "?a")]).reason == "PLAN_AMBIGUOUS_WRITER"
    assert compile_plan([p("x", "r", "y")]).answer is None and compile_plan([p("x", "r", "y")]).supported


def test_checks(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()[0]

    lit, arr = F.lit, lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(verify.span_ok(lit("林岚毕业"), lit(0), lit(2), lit("林岚"))) and not one(verify.span_ok(lit("ab"), lit(1), lit(3), lit("b"))) and not one(verify.span_ok(lit("ab"), lit(-1), lit(1), lit("a")))
    assert not one(verify.span_ok(lit("ab"), lit(1), lit(1), lit("")))
    assert one(verify.relation_matches(lit("Studied  at"), arr("studied at X"))) and not one(verify.relation_matches(lit("x"), arr(" "))) and one(verify.relation_matches(lit(""), arr("r")))
    assert one(verify.negation_before_cue(lit("林岚没有毕业于"), arr("毕业于"))) and not one(verify.negation_before_cue(lit("没有在很久很久很久以前的时候毕业于"), arr("毕业于")))
    assert one(verify.qualifier_conflict(lit("访问学者"), lit("x"))) and not one(verify.qualifier_conflict(lit("访问学者"), lit("访问学者")))
    assert one(verify.names_match(lit(" ALPHA  b"), arr("Alpha B"))) and not one(verify.names_match(lit(None).cast("string"), arr("a")))


def test_scores(spark):
    rows = [("Abc", "a-b c", True, 1.0), ("abc", None, False, 0.0), (None, "x", None, None), ("aab", "ab", False, 0.8), ("!!", "x", False, None), ("", "", True, None)]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "g string, t string")
    got = df.select(score.exact_match(F.col("g"), F.col("t")), F.round(score.token_f1(F.col("g"), F.col("t")), 6)).collect()
    assert [tuple(r) for r in got] == [(e, f) for _, _, e, f in rows]


def test_links(spark):
    e = spark.createDataFrame([("1", "Alpha", ["A", None, " "], "X"), ("2", "Beta", ["a"], "X"), ("2", "Beta", ["a"], "X")], "entity_id string, canonical_name string, aliases array<string>, entity_type string")
    names = graph.entity_names(graph.entity_table(e))
    s = spark.createDataFrame([("Alpha",), ("ALPHA",), ("a",), ("zz",), (None,)], "surface string")
    got = {r.surface: (r.reason, r.entity_id) for r in graph.link_surfaces(s, names).collect()}
    assert got == {"Alpha": ("EXACT_NAME", "1"), "ALPHA": ("ALIAS_UNIQUE", "1"), "a": ("AMBIGUOUS_ENTITY", None), "zz": ("UNLINKABLE", None)}


def test_first_accepted(spark):
    df = spark.createDataFrame([("g", 3, True, "c"), ("g", 1, False, "a"), ("g", 2, True, "b"), ("h", 1, False, "x")], "k string, i long, ok boolean, v string")
    assert [tuple(r) for r in graph.first_accepted(df, ["k"], F.col("i"), F.col("ok"), ["v"]).select("k", "v", "n_rejected").collect()] == [("g", "b", 1)]


def test_secrets_and_gold(spark):
    assert audit.blanked('{"a": [{"API_KEY": 1,"b": 2}], "my_token": {"x": ["y", {}]}, "z" : "token"}') == '{"a": [{"API_KEY": "[redacted]","b": 2}], "my_token": "[redacted]", "z" : "token"}'
    assert audit.blanked('{"pass\\u0077ord": "a \\" b", "q": 1}') == '{"pass\\u0077ord": "[redacted]", "q": 1}' and audit.blanked("token {") == "token {" and audit.blanked('"token"') == '"token"'
    rows = spark.createDataFrame([(1, '{"secret": [1]}'), (2, None), (3, "plain"), (4, '{"k": 1}'), (5, "[" * 30_000 + '{"token": 1}' + "]" * 30_000)], "n int, t string")
    assert {r.n: r.t for r in audit.scrub(rows, "t").collect()} == {1: '{"secret": "[redacted]"}', 2: None, 3: "plain", 4: '{"k": 1}', 5: "[" * 30_000 + '{"token": "[redacted]"}' + "]" * 30_000}
    df = spark.createDataFrame([("1", "x")], "id string, answer string")
    assert audit.public_view(df).columns == ["id"]
    try:
        audit.refuse_gold(df)
    except ValueError as e:
        assert "answer" in str(e)
    else:
        raise AssertionError


def test_gold_is_split_off_and_the_last_row_wins(spark):
    rows = spark.createDataFrame([("1", "q", ["a", None, "b"], 1, "x"), ("1", "q", ["c"], 2, "x"), ("2", "r", None, 1, "x")], "id string, question string, answers array<string>, at int, supporting_facts string")
    public, gold = audit.split_gold(rows, "id", "at", "answers")
    assert public.columns == ["id", "question", "at"] and {r.id: r.answer for r in gold.collect()} == {"1": "c", "2": None}
