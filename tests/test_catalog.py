"""Small worlds with a known end, all answered in one run: each has its own people, told apart by a tag on every name."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import closure as C
from graphloom.operators import visits as V
from graphloom.plans.compiler import compile_plan

#: People, edges, patterns and sentences of the worlds.
NAMES = {"book": ["星河", "《星河》", "小说《星河》"], "lin": ["林岚"], "uni": ["明川大学", "明川大"], "city": ["临江市"], "hai": ["海川大学"], "haicity": ["海川市"], "u3": ["北泽大学"], "c3": ["北泽市"], "u4": ["南泽大学"], "c4": ["南泽市"]}
PEOPLE = ["book", "lin", "uni", "city", "hai", "haicity"]
WORD = re.compile("|".join(sorted({n.strip("《》小说") for v in NAMES.values() for n in v}, key=len, reverse=True)))
AUTHOR, GRAD, LOC = "《星河》的作者是林岚。", "林岚毕业于明川大学，后来在海川大学任教。", "明川大学位于临江市。"
EDGES = {
    "author": (0, "book", "lin", None, "作者", AUTHOR), "loc": (1, "uni", "city", None, "位于", LOC), "teach": (2, "lin", "hai", None, "任教", "林岚在海川大学任教。"), "hai_loc": (3, "hai", "haicity", None, "位于", "海川大学位于海川市。"),
    "short": (9, "book", "city", None, "位于", "星河位于临江市。"), "year": (8, "lin", None, "1980", "出生年份", "林岚出生年份是1980。"), "u3": (5, "u3", "c3", None, "位于", "北泽大学位于北泽市。"), "u4": (6, "u4", "c4", None, "位于", "南泽大学位于南泽市。"),
}
PLAN = [{"head": "《星河》", "relation": "作者", "relation_variants": ["作者", "作者是"], "tail": "?author"}, {"head": "?author", "relation": "毕业于", "relation_variants": ["毕业于", "毕业"], "tail": "?university"}, {"head": "?university", "relation": "位于", "tail": "?city"}]
PERSON = [{"head": "?person", "relation": "毕业于", "tail": "明川大学"}, {"head": "?person", "relation": "居住", "tail": "?city"}]
CHECK = [{"head": "《星河》", "relation": "作者", "tail": "林岚"}]
YEAR = [PLAN[0], {"head": "?author", "relation": "出生年份", "tail": "?year", "tail_kind": "LITERAL"}]
NEG, CO, QUAL, HAI, ALIAS, PLAIN = "林岚没有毕业于明川大学。", "名单上有林岚、明川大学。", "林岚毕业于明川大学预科班。", "林岚毕业于海川大学。", "林岚毕业于明川大。", "林岚毕业于明川大学。"
BASE = ("author", "loc")


def read(text, tail="明川大学", head="林岚", at=0, **more):
    """A sentence with the candidate read from it."""
    return {"text": text, "head": head, "tail": tail, "at": at, "visible": True, "bad": False, **more}


def case(*sentences, edges=BASE, plan=PLAN, people=PEOPLE, forced=None, **settings):
    return {"sentences": sentences, "edges": edges, "plan": plan, "people": people, "forced": forced, "settings": settings}


BOTH = (read(GRAD), read(HAI, "海川大学"))
WORLDS = {
    "normal_missing_edge": case(read(GRAD)), "text_binding_disabled": case(read(GRAD), text_binding=False), "no_reentry": case(read(GRAD), reentry=False),
    "relation_confusion": case(read(GRAD), edges=(*BASE, "teach", "hai_loc"), forced="teach"), "relation_confusion_no_graph_check": case(read(GRAD), edges=(*BASE, "teach", "hai_loc"), forced="teach", verify_graph=False),
    "conflict_negation": case(read(NEG)), "negation_without_text_check": case(read(NEG), verify_text=False), "name_cooccurrence": case(read(CO)),
    "same_name_ambiguous": case(read(GRAD), edges=("loc",), plan=PERSON, people=["lin", "lin", "uni", "city"]), "unlinkable": case(read(GRAD), edges=("author",), people=["book", "lin", "city"]),
    "successor_missing_edge": case(read(GRAD), edges=("author",)), "bridge_text_clipped": case(read(GRAD, visible=False)), "branch_contradiction": case(*BOTH, edges=(*BASE, "hai_loc")), "incompatible_partial": case(*BOTH),
    "parent_revoke": case(read(GRAD), revoke="?author"), "budget_exhausted": case(read(GRAD), max_steps=1), "competing_branch_unfinished": case(*BOTH, edges=(*BASE, "hai_loc"), max_steps=3),
    "reverse_direction": case(read(GRAD, "林岚", "明川大学")), "qualifier_mismatch": case(read(QUAL)), "invalid_span": case(read(GRAD, bad=True)), "alias_unique": case(read(ALIAS, "明川大")),
    "duplicate_sentence_position": case(read(PLAIN, silent=True), read(PLAIN, at=1)), "short_wrong_path": case(read(GRAD), edges=(*BASE, "short")),
    "score_does_not_override_verification": case(read(NEG, "海川大学"), read(GRAD)), "both_endpoints_known": case(edges=("author",), plan=CHECK), "literal_not_entity": case(edges=("author", "year"), plan=YEAR),
    "branch_cap_truncation": case(*BOTH, read("林岚毕业于北泽大学。", "北泽大学"), read("林岚毕业于南泽大学。", "南泽大学"), edges=(*BASE, "hai_loc", "u3", "u4"), people=[*PEOPLE, "u3", "c3", "u4", "c4"], max_relations=4),
    "plan_cycle": case(plan=[{"head": "?a", "relation": "关联", "tail": "?b"}, {"head": "?b", "relation": "关联", "tail": "?a"}], edges=(), people=[]), "both_endpoints_unknown": case(plan=[{"head": "?a", "relation": "关联", "tail": "?b"}], edges=(), people=[]),
    "plan_ambiguous_writer": case(plan=[{"head": "《星河》", "relation": "作者", "tail": "?author"}, {"head": "林岚", "relation": "笔名", "tail": "?author"}], edges=(), people=[]),
    # Presets beyond the cases above.
    "simple_slot": case(read(NEG), method="simple_slot"), "cog_notebook": case(read(QUAL), method="cog_notebook", verify_graph=False), "judged": case(read(NEG)), "one_link": case(read(GRAD), people=[*PEOPLE, "uni"], max_links=1),
    "iterative_text": case(read(GRAD), read(LOC, "临江市", "明川大学", visible=False, cid="c2", predicate="位于"), edges=("author",), method="iterative_text", reentry=False),
    "requeued": case(read(GRAD, cid="c9"), plan=[*PLAN, {"head": "?author", "relation": "合著", "tail": "?friend"}, {"head": "?friend", "relation": "位于", "tail": "?place"}]),
}
#: status, answer, codes or decisions that must be there, and what the replayed chain holds and lacks.
WANT = {
    "normal_missing_edge": ("COMPLETE", "临江市", [], ["GRAPH 星河 作者 林岚", "TEXT 林岚 毕业于 明川大学", "GRAPH 明川大学 位于 临江市"], []), "text_binding_disabled": ("EXHAUSTED", None, ["TEXT_BINDING_DISABLED"], [], ["TEXT", "位于"]),
    "no_reentry": ("EXHAUSTED", None, ["REENTRY_DISABLED"], ["TEXT 林岚 毕业于 明川大学"], ["位于"]), "relation_confusion": ("COMPLETE", "临江市", ["CONFLICT", "SUPPORTED", "GRAPH_SOURCE_REJECT"], [], ["海川大学"]),
    "relation_confusion_no_graph_check": ("COMPLETE", "海川市", [], ["GRAPH 林岚 任教 海川大学"], ["TEXT"]), "conflict_negation": ("EXHAUSTED", None, ["CONFLICT", "NEGATION"], [], ["TEXT"]),
    "negation_without_text_check": ("COMPLETE", "临江市", ["SUPPORTED", "TEXT_PROGRAMMATIC_ACCEPT"], [], []), "name_cooccurrence": ("EXHAUSTED", None, ["UNKNOWN", "COOCCURRENCE"], [], ["TEXT"]), "same_name_ambiguous": ("EXHAUSTED", None, ["AMBIGUOUS_ENTITY"], [], ["TEXT"]),
    "unlinkable": ("EXHAUSTED", None, ["UNLINKABLE"], [], ["TEXT"]), "successor_missing_edge": ("EXHAUSTED", None, ["NO_SUCCESSOR_EVIDENCE"], ["TEXT 林岚 毕业于 明川大学"], ["位于"]), "bridge_text_clipped": ("EXHAUSTED", None, ["NO_TEXT_CANDIDATE"], [], ["TEXT"]),
    "branch_contradiction": ("AMBIGUOUS", None, [], ["GRAPH 海川大学 位于 海川市"], []), "incompatible_partial": ("COMPLETE", "临江市", ["NO_SUCCESSOR_EVIDENCE"], [], []), "parent_revoke": ("INVALIDATED", None, ["REVOKED"], [], ["作者"]),
    "budget_exhausted": ("BUDGET_EXHAUSTED", None, ["BUDGET_EXHAUSTED"], ["GRAPH 星河 作者 林岚"], ["TEXT"]), "competing_branch_unfinished": ("COMPLETE", "临江市", ["BUDGET_EXHAUSTED"], [], []), "reverse_direction": ("EXHAUSTED", None, ["UNKNOWN", "DIRECTION_MISMATCH"], [], ["TEXT"]),
    "qualifier_mismatch": ("EXHAUSTED", None, ["QUALIFIER_MISMATCH"], [], ["TEXT"]), "invalid_span": ("EXHAUSTED", None, ["INVALID_SPAN"], [], ["TEXT"]), "alias_unique": ("COMPLETE", "临江市", ["ALIAS_UNIQUE"], [], []), "duplicate_sentence_position": ("COMPLETE", "临江市", [], [], []),
    "short_wrong_path": ("COMPLETE", "临江市", [], ["GRAPH 明川大学 位于 临江市"], ["GRAPH 星河 位于 临江市"]), "score_does_not_override_verification": ("COMPLETE", "临江市", ["CONFLICT", "SUPPORTED"], [], ["海川大学"]),
    "both_endpoints_known": ("COMPLETE", None, [], ["GRAPH 星河 作者 林岚"], []), "literal_not_entity": ("COMPLETE", "1980", [], ["GRAPH 林岚 出生年份 1980"], []), "branch_cap_truncation": ("AMBIGUOUS", None, ["FORK_TRUNCATED"], [], []),
    "plan_cycle": ("PLAN_UNSUPPORTED", None, ["PLAN_CYCLE"], [], []), "both_endpoints_unknown": ("PLAN_UNSUPPORTED", None, ["PLAN_CYCLE"], [], []), "plan_ambiguous_writer": ("PLAN_UNSUPPORTED", None, ["PLAN_AMBIGUOUS_WRITER"], [], []),
    "simple_slot": ("COMPLETE", "临江市", ["SIMPLE_SLOT"], [], []), "cog_notebook": ("COMPLETE", "临江市", ["COG_NOTEBOOK"], [], []), "judged": ("COMPLETE", "临江市", ["MODEL_SUPPORTED"], [], []), "one_link": ("COMPLETE", "临江市", ["EXACT_NAME"], [], []),
    "iterative_text": ("COMPLETE", "临江市", ["REENTRY_DISABLED"], ["TEXT 林岚 毕业于 明川大学", "TEXT 明川大学 位于 临江市"], []), "requeued": ("EXHAUSTED", None, ["NO_TEXT_CANDIDATE"], ["GRAPH 星河 作者 林岚"], ["TEXT"]),
}


@pytest.fixture(scope="module")
def world(spark):
    names, edges, constraints, plans, units, cands, forced, runs = [], [], [], [], [], [], [], []
    for n, (cid, w) in enumerate(WORLDS.items()):
        tag = lambda x, n=n: None if x is None else WORD.sub(lambda m: f"{m[0]}{n:02}号", x)
        for m, e in enumerate(w["people"]):
            twin = "x" if e in w["people"][:m] else ""
            names += [(f"{n}:{e}{twin}", tag(x), tag(x), tag(NAMES[e][0])) for x in NAMES[e]]
        for e in w["edges"]:
            ord_, h, t, literal, relation, quote = EDGES[e]
            edges.append((f"{n}:{e}", ord_, f"{n}:{h}", t and f"{n}:{t}", literal, relation, True, tag(quote), True, tag(NAMES[h][0]), t and tag(NAMES[t][0]), tag(quote), 0))
        plan = compile_plan([p | {"head": tag(p["head"]), "tail": tag(p["tail"])} for p in w["plan"]])
        constraints += C.constraint_rows(cid, plan)
        plans.append((cid, plan.answer, plan.reason))
        units.append((cid, f"{n}:a", 0, 0, True, tag(AUTHOR)))
        first = "c0" if w["plan"] is PERSON else "c1"
        for m, s in enumerate(w["sentences"]):
            text = tag(s["text"])
            units.append((cid, f"{n}:{m}", 2 + m, s["at"], s["visible"], text))
            if not s.get("silent"):
                cands.append((cid, s.get("cid", first), m, f"{n}:{m}", tag(s["head"]), s.get("predicate", "毕业于"), tag(s["tail"]), 0, 1 if s["bad"] else len(text), text))
        if w["forced"]:
            forced.append((cid, "c1", f"{n}:{w['forced']}", 0))
        base = {"method": "relation_commit", "text_binding": True, "reentry": True, "verify_text": True, "verify_graph": True, "revoke": None} | V.LIMITS | w["settings"]
        runs.append((cid, cid, "own", *[base[c.split()[0]] for c in V.SETTINGS.split(", ")[3:]]))
    make = spark.createDataFrame
    tables = {
        "runs": make(runs, V.SETTINGS), "constraints": make(constraints, C.CONSTRAINT), "names": make(names, "entity_id string, name string, norm string, canonical string"),
        "edges": make(edges, "triple_id string, ord long, head_id string, tail_id string, tail_literal string, relation string, active boolean, quotes string, located boolean, head_name string, tail_name string, quote string, sent_index int"),
        "units": make(units, "question_id string, passage_id string, doc_index int, sent_index int, visible boolean, raw_text string"),
        "candidates": make(cands, "question_id string, cid string, pos int, passage_id string, head_surface string, predicate string, tail_surface string, char_start int, char_end int, quote string"),
        "forced": make(forced, "question_id string, cid string, triple_id string, pos int"),
        "judged": make([("judged", "c1", 0, "SUPPORTED", "MODEL_SUPPORTED"), ("invalid_span", "c1", 0, "SUPPORTED", "MODEL_SUPPORTED")], "question_id string, cid string, pos int, decision string, reason string"),
    }
    branches = V.written(V.execute(**tables), "branches")
    told = V.outcomes(branches, tables["runs"], make(plans, "question_id string, answer string, reason string"), tables["names"]).collect()
    chains = {}
    for r in V.chain(branches).collect():
        chains.setdefault(r.run_id, []).append(r)
    return {r.run_id: r for r in told}, chains, branches.collect(), tables


def _plain(x):
    return re.sub(r"\d\d号", "", x or "")


@pytest.mark.parametrize("cid", WORLDS)
def test_case(world, cid):
    told, chains, _, _ = world
    got, (status, answer, codes, held, lacking) = told[cid], WANT[cid]
    assert (got.status, _plain(got.answer) or None) == (status, answer), got
    assert not set(codes) - set(got.reasons) - set(got.decisions), got
    lines = [f"{p.kind} {_plain(p.head_name)} {p.relation} {_plain(p.tail_name)}" for p in chains.get(cid, [])]
    assert not set(held) - set(lines), lines
    assert not [x for x in lacking if any(x in line for line in lines)], lines


def test_what_the_cases_say_beside_their_answer(world):
    told, chains, branches, tables = world
    assert [k for k, r in told.items() if r.uncertain] == [k for k in told if k in ("incompatible_partial", "competing_branch_unfinished")]
    assert sorted(map(_plain, told["branch_contradiction"].answers)) == ["临江市", "海川市"] and len(told["branch_cap_truncation"].answers) == 3
    assert any(p.kind == "TEXT" and p.sent_index == 1 for p in chains["duplicate_sentence_position"])
    literal = next(p for p in chains["literal_not_entity"] if p.tail_literal)
    assert literal.tail_id is None and literal.produces == "?year"
    of = {}
    for b in branches:
        of.setdefault(b.run_id, []).append(b)
    assert all(not b.bindings and all(p.invalidated for p in b.proofs if p.produces) for b in of["parent_revoke"])
    assert any("?university" in b.bindings for b in of["no_reentry"]) and not any("?university" in b.bindings for b in of["unlinkable"])
    for b in of["branch_contradiction"] + of["incompatible_partial"]:
        ends = {_plain(x) for p in b.proofs for x in (p.head_name, p.tail_name)}
        assert not {"临江市", "海川市"} <= ends and not {"临江市", "海川大学"} <= ends
    assert all(p.parent in (None, "?author", "?university") for b in branches for p in b.proofs) and {p.cid: p.parent for p in chains["normal_missing_edge"]} == {"c0": None, "c1": "?author", "c2": "?university"}


def test_followup_counts_bindings_and_relation(spark):
    units = spark.createDataFrame([("q", f"u{n}", n, 0, t) for n, t in enumerate(["nothing", "Lin here", "Lin studied at", "studied at"])], "question_id string, passage_id string, doc_index int, sent_index int, raw_text string")
    asked = spark.createDataFrame([("q", "b", "c0", ["Lin", "Lin", "", None], "studied at"), ("q", "b", "c1", ["Lin"], None), ("q", "b", None, [], None)], "question_id string, branch_id string, cid string, names array<string>, relation string")
    got = {c: [(r.passage_id, r.score) for r in sorted(V.followed(asked, units, 3).collect(), key=lambda r: r.rank) if r.cid == c] for c in ("c0", "c1", None)}
    assert got == {"c0": [("u2", 6), ("u1", 4), ("u3", 2)], "c1": [("u1", 2), ("u2", 2), ("u0", 0)], None: [("u0", 0), ("u1", 0), ("u2", 0)]}


def test_presets_by_question(spark):
    runs = V.runs_of(spark.createDataFrame([("q",), ("q",), ("r",)], "question_id string"), ["core11", "cog_controlled"], max_steps=5)
    got = {r.run_id: r for r in runs.collect()}
    assert sorted(got) == ["q/cog_controlled", "q/core11", "r/cog_controlled", "r/core11"] and not got["q/cog_controlled"].verify_graph and got["q/core11"].max_steps == 5 and got["q/core11"].text_top_k == 8
    assert runs.schema.simpleString() == spark.createDataFrame([], V.SETTINGS).schema.simpleString()


def test_a_retriever_decides_what_is_read(world):
    """With one sentence to read, order takes the author's, a retriever the one that says what is asked."""
    tables = dict(world[3])
    one = {"runs": tables["runs"].where("run_id = 'normal_missing_edge'").withColumn("text_top_k", F.lit(1))}
    plain = V.execute(**(tables | one)).where("parent_id is not null").count()

    def by_cue(pool):
        return pool.withColumn("score", F.contains("raw_text", F.lit("毕业")).cast("int"))

    assert plain == 0 and V.execute(**(tables | one), retriever=by_cue).where("parent_id is not null").count() == 1
    rows = tables["units"].sparkSession.createDataFrame([("a b", "A  b c"), ("a", "z"), ("", "")], "query string, raw_text string")
    assert [round(r.score, 3) for r in V.lexical_retriever(rows).collect()] == [0.667, 0.0, 0.0]
