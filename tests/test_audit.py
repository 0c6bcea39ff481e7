import json

from graphloom.operators import audit

TRIPLES = [("7", 7, "ns:1", "member of", "ns:2", None), ("8", 8, None, None, None, '{"head": "NS:1 ", "relation": "Member Of", "tail": "ns:2"}')]
UNITS = [("q", 0, 0, "A", "x of y."), ("q", 0, 1, "A", "again of y."), ("q", 1, 0, "B", "x of y.")]


def _kg(n, head=1, tail=2, relation="member of"):
    return {"kg_triple_id": n, "head_entity_id": head, "tail_entity_id": tail, "relation": relation}


RECORD = {"triples_evidence": [
    {"query_triple_index": 0, "kg_triples": [_kg(7), _kg(8), _kg(9), _kg(7, head=2), _kg(8, tail=1), _kg(7, relation="owner of"), _kg(7, head=5), 3, _kg(7, head=None)],
     "candidate_evidences": [
         {"title": "A", "paragraph_idx": 0, "sent_idx": 0, "evidence": "x of y"}, {"title": "A", "paragraph_idx": 0, "sent_idx": 1, "evidence": "x of y"}, {"evidence": "x of y"},
         {"title": "C", "context": "x of y"}, {"title": "B", "evidence": "", "context": "x of y"}, {"sent_idx": 0, "evidence": "x of y"}]},
    {"query_triple_index": 3, "candidate_evidences": [{"sent_idx": 9, "evidence": "x"}]}, "text", {"query_triple_index": -1},
]}


def test_phase2_issues(spark):
    phase2 = spark.createDataFrame([("q", json.dumps(RECORD)), ("bad", "{"), ("none", None)], "id string, phase2_json string")
    triples = spark.createDataFrame(TRIPLES, "triple_id string, upstream_index long, head_id string, relation string, tail_id string, raw_record string")
    entities = spark.createDataFrame([(1,), (2,), (None,)], "upstream_id int")
    units = spark.createDataFrame(UNITS, "question_id string, doc_index int, sent_index int, title string, raw_text string")
    got = sorted((r.question_id, r.path, r.severity, r.message) for r in audit.phase2_issues(phase2, triples, entities, units).collect())
    kg, told = "triples_evidence/0/kg_triples/", "triples_evidence/0/candidate_evidences/"
    hard = [
        (kg + "2", "kg triple id missing"), (kg + "3", "kg triple head mismatch"), (kg + "4", "kg triple tail mismatch"), (kg + "5", "kg triple relation mismatch"),
        (kg + "6", "kg triple head mismatch"), (kg + "6", "kg entity id missing"), (kg + "7", "kg triple is not an object"), (told + "1", "sentence index does not locate quote"),
        ("triples_evidence/2", "query index out of range"), ("triples_evidence/3", "query index out of range"),
    ]
    soft = [(told + "2", "quote in multiple spans"), (told + "3", "quote unlocated"), (told + "5", "quote in multiple spans")]
    want = [("q", p, "hard", m) for p, m in hard] + [("q", p, "soft", m) for p, m in soft] + [(q, "triples_evidence", "hard", "no triples evidence") for q in ("bad", "none")]
    # Index 3 is in range of four triples, and its quote has no sentence 9.
    want.append(("q", "triples_evidence/1/candidate_evidences/0", "hard", "sentence index does not locate quote"))
    assert got == sorted(want)
