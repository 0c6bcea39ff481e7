import json

import pytest

from graphloom.sources import json_files as S
from graphloom.sources import model as M
from graphloom.streaming.trace_counts import event_counts


def _lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_lines_numbers_blanks_and_faults(spark, tmp_path):
    p = _lines(tmp_path / "a.jsonl", {"a": 1}, "", {"a": 3})
    assert [tuple(r) for r in S.read_json_lines(spark, p, "a long").orderBy("line_no").collect()] == [(0, 1), (2, 3)]
    with pytest.raises(S.InputError, match=":2: "):
        S.read_json_lines(spark, _lines(tmp_path / "b.jsonl", {"a": 1}, "{oops", {"a": 2}), "a long")
    with pytest.raises(S.InputError):
        S.require_path(str(tmp_path / "none"))


def test_other_line_ends(spark, tmp_path):
    p = tmp_path / "ends.jsonl"
    p.write_text('{"a": 1}\u2028{"a": 2}\x85\n{"a": 3}\r\n{"a": 4}', encoding="utf-8")
    assert [tuple(r) for r in S.read_json_lines(spark, str(p), "a long").orderBy("line_no").collect()] == [(0, 1), (1, 2), (3, 3), (4, 4)]


def test_lists_leave_out_what_is_no_object(spark, tmp_path):
    p = tmp_path / "mixed.json"
    p.write_text(json.dumps([{"id": "1"}, 5, None, [1], "x", {"id": "2", "y": {"z": 1}}]))
    assert sorted(r.id for r in S.read_json_list(spark, str(p)).collect()) == ["1", "2"] == sorted(r.id for r in S.read_json_list(spark, str(p), "id string").collect())


def test_settings(tmp_path):
    from graphloom.plans.settings import read_settings

    p = tmp_path / "s.yaml"
    p.write_text("engine:\n  preset: simple_bind\n  verify_text: false\n  max_steps: 7\n")
    got = read_settings(str(p))
    assert (got["method"], got["verify_text"], got["verify_graph"], got["max_steps"], got["max_active"]) == ("simple_slot", False, True, 7, 3)
    for body in ("- 1", "engine: 3", "max_steps: many", "max_step: 3", "preset: none", "verify_text: 1"):
        p.write_text(body)
        with pytest.raises(S.InputError):
            read_settings(str(p))


def test_judgments(spark):
    rows = [("1", '{"decision": "supported"}'), ("2", '{"decision": "maybe"}'), ("3", "no json"), ("4", None)]
    got = {r.id: (r.decision, r.reason) for r in M.judgments(spark.createDataFrame(rows, "id string, content string"), ["id"], "content").collect()}
    assert got == {"1": ("SUPPORTED", "MODEL_SUPPORTED"), **{k: ("UNKNOWN", "MODEL_PARSE_ERROR") for k in "234"}}


def test_lists(spark, tmp_path):
    for n, body in enumerate(([{"id": "1"}, {"id": "2"}], {"data": [{"id": "1"}, {"id": "2"}]})):
        p = tmp_path / f"{n}.json"
        p.write_text(json.dumps(body))
        df = S.read_json_list(spark, str(p))
        assert sorted(r[0] for r in df.select(S.example_id(df)).collect()) == ["1", "2"]


def _graph(path, **other):
    files = {
        "entities": [{"id": 0, "name": "Alpha", "type": "P"}, {"id": 1, "name": "Beta", "aliases": ["B"]}], "triples": [{"h": 0, "r": "met", "t": 1}, {"head": 0, "relation": "member of", "tail": 1, "title": "Alpha", "evidence": "x"}],
        "title2triples": [{"title": "Alpha", "triple_idxs": [0]}, {"title": "Alpha", "triple_idxs": [1, 0]}], "title2entities": [{"title": "Alpha", "entity_ids": [0, 1]}],
    }
    for name, rows in (files | other).items():
        _lines(path / f"{name}.jsonl", *rows)
    return str(path)


def test_graph_directory(spark, tmp_path):
    g = S.read_graph_directory(spark, _graph(tmp_path), "kg")
    assert [(r.triple_id, r.head_id, r.relation, r.tail_id, r.ambiguous) for r in g["triples"].orderBy("upstream_index").collect()] == [("0", "kg:0", "met", "kg:1", True), ("1", "kg:0", "member of", "kg:1", False)]
    assert [r.id for r in g["title_triples"].orderBy("pos").collect()] == ["1", "0"]
    with pytest.raises(S.InputError, match="unknown entity 9"):
        S.read_graph_directory(spark, _graph(tmp_path, triples=[{"h": 0, "r": "met", "t": 9}]), "kg")
    with pytest.raises(S.InputError, match="unknown id 7"):
        S.read_graph_directory(spark, _graph(tmp_path, title2entities=[{"title": "x", "entity_ids": [7]}]), "kg")
    with pytest.raises(S.InputError, match="required"):
        S.read_graph_directory(spark, _graph(tmp_path, entities=[{"id": 0}]), "kg")


def test_sentences(spark):
    context = [[" T ", ["a", "b"]], ["U", "c"], "bad", {"title": "V", "sents": ["d"]}, {"title": "W", "text": "e"}, ["only title"], {"title": "X", "sentences": ["f"]}]
    df = spark.createDataFrame([("q", json.dumps(context)), ("r", None), ("s", "no json")], "id string, context string")
    got = sorted(tuple(r)[1:] for r in S.sentences(df, "id", "context").collect())
    assert got == [(0, "T", 0, "a"), (0, "T", 1, "b"), (1, "U", 0, "c"), (3, "V", 0, "d"), (4, "W", 0, "e"), (6, "X", 0, "f")]


def test_trace_appends_and_cohort(spark, tmp_path):
    df = spark.createDataFrame([("q", 0, "plan")], "question_id string, i int, event string")
    for _ in range(2):
        S.append_trace(df, str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 2
    c = S.synthetic_cohort(spark, 20)
    assert c.count() == 40 and c.where("real and upstream_index % 2 = 1").count() == 20


class Fake:
    def __init__(self, *answers):
        self.answers = list(answers)

    def post(self, url, headers, body):
        return self.answers.pop(0)


def _ok(text, **more):
    return 200, {"choices": [{"message": {"content": text}}], **more}


def test_client():
    c = M.Client(Fake((500, {}), (500, {}), _ok("x", usage={"prompt_tokens": 5, "completion_tokens": 2})), "u", "k", "m")
    assert c.complete("s", "u") == "x" and c.calls == 3 and c.tokens == 7 and not c.estimated
    c = M.Client(Fake((401, {}), _ok("x")), "u", "k", "m")
    with pytest.raises(M.ModelUnavailable):
        c.complete("s", "u")
    assert c.calls == 1
    c = M.Client(Fake(_ok("abc")), "u", "k", "m", max_calls=1)
    assert c.complete("s", "u") == "abc" and c.estimated and c.tokens == 6
    with pytest.raises(M.BudgetSpent):
        c.complete("s", "u")
    with pytest.raises(M.ModelUnavailable):
        M.Client(Fake(), "u", "", "m").complete("s", "u")


def test_relations(spark):
    rows = [{"passage_id": "p", "quote": "b", "head": "H"}, {"passage_id": "p", "quote": "z"}, {"passage_id": "x", "quote": "b"}, {"passage_id": "p", "quote": ""}, 5, [1]]
    answers = spark.createDataFrame([("q", json.dumps({"relations": rows})), ("r", "not-json"), ("s", '{"relations": 1}'), ("t", '{"relations": []}'), ("u", None)], "id string, content string")
    shown = spark.createDataFrame([("q", "p", "abc"), ("q", "p", "abc"), ("r", "p", "abc")], "id string, passage_id string, raw_text string")
    got = sorted((r.id, -1 if r.pos is None else r.pos, r.status, r.char_start, r.char_end) for r in M.read_relations(answers, "id", "content", shown).collect())
    assert got == [("q", 0, "LOCATED", 1, 2), ("q", 1, "NOT_IN_TEXT", 0, 1), ("q", 2, "DROPPED_PASSAGE", None, None), ("q", 3, "DROPPED_PASSAGE", None, None), ("q", 4, "DROPPED_ROW", None, None), ("q", 5, "DROPPED_ROW", None, None), *[(k, -1, "PARSE_ERROR", None, None) for k in "rsu"]]


def test_ask(spark):
    def make():
        return M.Client(Fake(*[_ok("yes")] * 2), "u", "k", "m", max_calls=2)

    df = spark.createDataFrame([(n, "hi") for n in range(3)], "id long, prompt string").coalesce(1)
    assert sorted((r.content or "", r.fault or "") for r in M.ask(df, make, "id", "s", "prompt").collect()) == [("", "BudgetSpent"), ("yes", ""), ("yes", "")]


def test_stream_counts_equal_table_counts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    q = event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, event_counts(events).collect()))
