"""Whole sets of questions answered under any settings: closure in the graph, recovery from text, forks, a shared budget.

A run is a question under one preset. Its branches stand in a queue; a visit takes the first branch of
every run at once, so the order inside a run is exactly that of a queue while all runs advance together.
A visit costs one step: the graph is closed (of children only where re-entry is allowed), and a branch whose
constraints are all proven is complete. If not, another step pays for one recovery: the first open constraint
with all it depends on proven, a known entity at one end and an open entity variable at the other is read from
the question's sentences; candidates are verified and linked, and every one that holds forks a child, as
long as the queue has room. A branch without children is queued again while another constraint is left to try.
Attempts are counted for the run, by constraint and what is bound. A run out of steps ends with its queue.

As a run has at most ``max_steps`` visits, so has the loop; each reads and writes short tables of live
branches only. What is ranked inside a question are its sentences, and inside a branch the candidates of one
constraint, of which the first ``max_relations`` are verified.

Tables: runs (``SETTINGS``), plans (``question_id, answer, reason``), those of ``closure`` with names as ``entity_id, name,
norm, canonical``, units (``question_id, passage_id, doc_index, sent_index, visible, raw_text``) and candidates
(``question_id, cid, pos, passage_id, head_surface, predicate, tail_surface, char_start, char_end, quote``). ``judged``
(``question_id, cid, pos, decision, reason``) holds verdicts of a model; they replace those of the rules where span and
direction are right and texts are verified.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import norm_name
from graphloom.functions.verify import names_match, span_ok, text_verdict
from graphloom.operators.audit import refuse_gold
from graphloom.operators.closure import PROOF, TEXTS, blank_state, closure, ends, parent_of, proven, resolved, shape_of, vague
from graphloom.session import unsent, written

SETTINGS = (
    "run_id string, question_id string, preset string, method string, text_binding boolean, reentry boolean, verify_text boolean, verify_graph boolean, "
    "max_steps int, max_active int, max_recoveries int, text_top_k int, max_relations int, max_links int, revoke string"
)
LIMITS = {"max_steps": 32, "max_active": 3, "max_recoveries": 1, "text_top_k": 8, "max_relations": 3, "max_links": 3}
#: Name, method, text binding, re-entry, verify text, verify graph.
PRESETS = [
    ("core00", "relation_commit", False, False, False, True),
    ("core01", "relation_commit", False, False, True, True),
    ("core10", "relation_commit", True, True, False, True),
    ("core11", "relation_commit", True, True, True, True),
    ("simple_bind", "simple_slot", True, True, True, True),
    ("cog_controlled", "cog_notebook", True, True, True, False),
    ("iterative_text", "iterative_text", True, False, True, True),
    ("no_reentry", "relation_commit", True, False, True, True),
    ("verify_graph_off", "relation_commit", True, True, True, False),
]
#: Places in a queue that one visit can give out.
VISIT = 1_000_000


def runs_of(questions: DataFrame, presets: list[str], **limits: int) -> DataFrame:
    """Every question under each preset, with the default limits where none are given."""
    chosen = [p for p in PRESETS if p[0] in presets]
    told = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("preset", "method", "text_binding", "reentry", "verify_text", "verify_graph"), p)]) for p in chosen])).alias("p")
    rows = questions.select("question_id").distinct().select("question_id", told).select(F.concat_ws("/", "question_id", "p.preset").alias("run_id"), "question_id", "p.*")
    return rows.select("*", *[F.lit(limits.get(k, v)).alias(k) for k, v in LIMITS.items()], F.lit(None).cast("string").alias("revoke"))


def followed(asked: DataFrame, units: DataFrame, k: int | str) -> DataFrame:
    """The first ``k`` units (a number or a column) of each branch and constraint by two points for every bound name (``names``) and for the ``relation`` that they hold."""
    held = F.size(F.filter("names", lambda n: n.isNotNull() & (n != "") & F.contains("raw_text", n)))
    told = F.coalesce((F.col("relation") != "") & F.contains("raw_text", "relation"), F.lit(False)).cast("int")
    w = Window.partitionBy("question_id", "branch_id", "cid").orderBy(F.desc("score"), "doc_index", "sent_index", "passage_id")
    return asked.join(units, "question_id").withColumn("score", (held + told) * 2).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (F.col(k) if isinstance(k, str) else k))


#: Takes rows with ``query`` and ``raw_text`` and gives them a ``score``.
Retriever = Callable[[DataFrame], DataFrame]


def lexical_retriever(pool: DataFrame) -> DataFrame:
    """Sentences by the share of words that they have in common with what is asked."""
    words = lambda x: F.array_distinct(F.filter(F.split(norm_name(F.col(x)), " "), lambda w: w != ""))
    both = F.size(F.array_union(words("query"), words("raw_text")))
    return pool.withColumn("score", F.when(both > 0, F.size(F.array_intersect(words("query"), words("raw_text"))) / both).otherwise(0.0))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _some(a):
    return F.filter(a, lambda x: x.isNotNull())


def _with_codes(df: DataFrame, *codes) -> DataFrame:
    return df.withColumn("reasons", F.array_union("reasons", _some(F.array(*codes))))


def execute(runs: DataFrame, constraints: DataFrame, names: DataFrame, edges: DataFrame, units: DataFrame, candidates: DataFrame, forced: DataFrame | None = None, judged: DataFrame | None = None, retriever: Retriever | None = None) -> DataFrame:
    """Finished branches of every run whose question has constraints, with ``status`` and ``seq``, the visit that ended them.

    A ``retriever`` ranks the sentences instead of their order or the bound names.
    """
    for rows in (runs, constraints, names, edges, units, candidates):
        refuse_gold(rows)
    names = unsent(written(names, "names"))
    needed = constraints.select("question_id", F.explode("depends_on").alias("cid")).distinct().withColumn("needed", F.lit(True))
    asked = unsent(written(resolved(constraints.join(unsent(needed), ["question_id", "cid"], "left").withColumn("needed", F.coalesce("needed", F.lit(False))), names), "asked"))
    total = asked.groupBy("question_id").agg(F.countDistinct("cid").alias("n_constraints"))
    called = unsent(written(names.groupBy("entity_id").agg(F.collect_set("norm").alias("called"), F.min("canonical").alias("canonical")), "called"))
    # Every visit and rank reads the edges, every recovery units and candidates; they are made once, so no plan repeats how.
    edges, units, candidates = written(edges.where("active"), "edges"), unsent(written(units, "units")), unsent(written(candidates, "candidates"))
    reading = (units, candidates, called, names, judged, retriever)
    live = runs.join(total, "question_id").select(
        *[c.split()[0] for c in SETTINGS.split(", ")], "n_constraints", F.concat("run_id", F.lit("/b0")).alias("branch_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"), *[c.alias(n) for n, c in blank_state().items()],
    )
    live = unsent(written(live, "live"))
    ledger = live.select("run_id", F.lit(0).alias("steps"), F.array().cast(TEXTS).alias("tried"))
    columns, finished, visit = live.columns, [], 0

    def ends_with(df: DataFrame, status: str) -> DataFrame:
        return df.select(*columns).withColumns({"status": F.lit(status), "seq": F.lit(visit)})

    while not live.isEmpty():
        first = live.groupBy("run_id").agg(F.min("place").alias("place"), (F.count(F.lit(1)) - 1).alias("n_waiting"))
        heads = unsent(written(live.join(first, ["run_id", "place"]).join(ledger, "run_id"), "heads"))
        waiting = live.join(heads.select("run_id", "place"), ["run_id", "place"], "left_anti")
        paid = heads.where("steps < max_steps").withColumn("steps", F.col("steps") + 1)
        closing = F.col("parent_id").isNull() | F.col("reentry")
        closed = closure(paid.where(closing), asked, names, edges, forced, F.col("verify_graph"))
        closed = unsent(written((_note_successors(closed, asked) if visit else closed).unionByName(paid.where(~closing).select(*closed.columns)), "closed"))
        whole = (F.size(F.array_distinct(F.transform(F.filter("proofs", lambda p: ~p["invalidated"]), lambda p: p["cid"]))) >= F.col("n_constraints")) & consistent()
        finished.append(ends_with(closed.where(whole), "COMPLETE"))
        open_ = closed.where(~whole)
        trying = open_.where("steps < max_steps").withColumn("steps", F.col("steps") + 1)
        spent = heads.where("steps >= max_steps").select(*columns).unionByName(open_.where("steps >= max_steps").select(*columns))
        broke = unsent(spent.select("run_id").distinct())
        cut = spent.unionByName(waiting.join(broke, "run_id", "left_semi").select(*columns))
        finished.append(ends_with(_with_codes(cut, F.lit("BUDGET_EXHAUSTED")), "BUDGET_EXHAUSTED"))
        steps, queued = closed.where(whole).select("run_id", "steps", "tried"), [waiting.join(broke, "run_id", "left_anti").select(*columns)]
        if not trying.isEmpty():
            parents, children = _recovered(trying, asked, reading, visit)
            finished.append(ends_with(_with_codes(parents.where("forked"), F.lit("FORKED")), "FORKED"))
            finished.append(ends_with(parents.where("not forked and not again"), "EXHAUSTED"))
            again = parents.where("not forked and again").withColumn("place", F.lit((visit + 1) * VISIT).cast("long"))
            queued += [again.select(*columns), children.select(*columns)]
            steps = steps.unionByName(parents.select("run_id", "steps", "tried"))
        live = unsent(written(_union(queued), "live"))
        ledger = unsent(written(steps, "ledger"))
        visit += 1
    out = _union(finished) if finished else ends_with(live, "EXHAUSTED")
    return out if runs.where("revoke is not null").isEmpty() else _revoked(out, constraints)


def consistent():
    """Every proof that counts agrees with what its variable is bound to."""

    def agrees(p):
        bound = F.col("bindings")[p["produces"]]
        return p["produces"].isNull() | p["invalidated"] | F.coalesce(F.coalesce(bound["id"], bound["literal"]) == p["produced"], F.lit(False))

    return F.forall("proofs", agrees)


def _note_successors(closed: DataFrame, asked: DataFrame) -> DataFrame:
    """Children with an open constraint that reads a bound variable and could be asked of the graph."""
    rows = closed.where("parent_id is not null").join(asked, "question_id").where(~proven(F.col("cid")) & F.exists("reads", lambda v: F.col("bindings")[v].isNotNull()))
    dead = rows.where(shape_of().isin("from_head", "from_tail")).select("branch_id", F.lit("NO_SUCCESSOR_EVIDENCE").alias("dead")).distinct()
    return _with_codes(closed.join(unsent(dead), "branch_id", "left"), F.col("dead")).drop("dead")


def _recovered(trying: DataFrame, asked: DataFrame, reading: tuple, visit: int) -> tuple[DataFrame, DataFrame]:
    """(branches with ``forked``, ``again`` and what the run has ``tried``, children)."""
    signature = F.array_join(F.array_sort(F.transform(F.map_entries("bindings"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"]["id"], e["value"]["literal"])))), ";")
    rows = trying.join(asked, "question_id").where(~proven(F.col("cid")))
    rows = rows.where(F.when(F.col("terminal"), F.col("method") == "iterative_text").otherwise(F.col("needed")) & F.forall("depends_on", proven))
    rows = rows.withColumn("key", F.concat_ws("|", "cid", signature)).withColumn("n_tried", F.size(F.filter("tried", lambda k: k == F.col("key")))).where("n_tried < max_recoveries")
    shape = shape_of()
    forward = shape == "from_head"
    rows = rows.withColumn("forward", forward).withColumn("vague", vague())
    rows = rows.withColumn("fit", (forward & (F.col("tail_value") == "entity")) | ((shape == "from_tail") & (F.col("head_value") == "entity")))
    order = F.struct("rank", "idx", "cid")
    bound = F.when(F.col("forward"), ends("head")[0]).otherwise(ends("tail")[0])
    pick = F.struct("cid", "key", "forward", "relation", "variants", bound.alias("bound_id"), F.when(F.col("forward"), F.col("tail")).otherwise(F.col("head")).alias("variable"), parent_of(F.col("reads")).alias("parent"))
    each = rows.groupBy("branch_id").agg(
        F.min_by(pick, F.when(F.col("fit"), order)).alias("pick"), F.collect_list(F.struct("key", "fit", "n_tried")).alias("ready"),
        F.max("vague").alias("some_vague"), F.max(~F.col("fit") & ~F.col("vague")).alias("some_unfit"),
    )
    burned = F.transform(F.filter("ready", lambda r: ~r["fit"] | (r["key"] == F.col("pick.key"))), lambda r: r["key"])
    left = F.exists("ready", lambda r: r["n_tried"] + F.when(~r["fit"] | (r["key"] == F.col("pick.key")), 1).otherwise(0) < F.col("max_recoveries"))
    none = F.array().cast(TEXTS)
    state = trying.join(unsent(each), "branch_id", "left").withColumns({"tried": F.concat("tried", F.coalesce(burned, none)), "again": F.coalesce(left, F.lit(False))})
    state = _with_codes(state, F.when(F.col("some_vague"), "AMBIGUOUS_ENTITY"), F.when(F.col("some_unfit"), "NOT_RECOVERABLE"))
    state = unsent(written(state.drop("ready", "some_vague", "some_unfit"), "state"))
    verdicts = unsent(written(_verdicts(state.where("pick is not null"), *reading), "verdicts"))
    told = verdicts.groupBy("branch_id").agg(
        F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"), F.array_distinct(F.flatten(F.collect_list("decided"))).alias("decided"), F.count_if("born").alias("kids"),
    )
    parents = state.join(told, "branch_id", "left")
    nothing = F.when(F.col("pick").isNotNull() & F.col("codes").isNull(), F.array(F.lit("NO_TEXT_CANDIDATE"))).otherwise(none)
    parents = parents.withColumns({
        "reasons": F.array_union("reasons", F.coalesce("codes", nothing)), "decisions": F.array_union("decisions", F.coalesce("decided", none)), "forked": F.coalesce(F.col("kids") > 0, F.lit(False)),
    })
    born = state.join(verdicts.where("born"), "branch_id")
    nil = F.lit(None).cast("string")
    head, tail = F.when(F.col("forward"), F.col("bound_id")).otherwise(F.col("linked")), F.when(F.col("forward"), F.col("linked")).otherwise(F.col("bound_id"))
    reason = F.when(F.col("method").isin("simple_slot", "cog_notebook"), F.upper("method")).otherwise("TEXT_COMMIT")
    proof = F.struct(
        F.col("pick.cid").alias("cid"), F.lit("TEXT").alias("kind"), nil.alias("triple_id"), head.alias("head_id"), tail.alias("tail_id"), nil.alias("tail_literal"), F.col("head_surface").alias("head_name"), F.col("predicate").alias("relation"),
        F.col("tail_surface").alias("tail_name"), "quote", "sent_index", F.col("pick.variable").alias("produces"), F.col("linked").alias("produced"), F.col("pick.parent").alias("parent"), reason.alias("reason"), F.lit(0).cast("long").alias("n_rejected"), F.lit(False).alias("invalidated"),
    )
    fact = F.map_from_arrays(F.array("pick.variable"), F.array(F.struct(F.col("linked").alias("id"), nil.alias("literal"))))
    children = born.withColumns({
        "parent_id": F.col("branch_id"), "branch_id": F.concat_ws(".", "branch_id", F.col("nth").cast("string")), "depth": F.col("depth") + 1, "place": F.lit((visit + 1) * VISIT).cast("long") + F.col("nth"),
        "bindings": F.map_concat("bindings", fact), "proofs": F.concat("proofs", F.array(proof).cast(PROOF)), "decisions": F.array_union("decisions", "decided"),
        "reasons": F.array_union(F.array_union("reasons", _some(F.array("note", reason))), F.when(F.col("reentry"), none).otherwise(F.array(F.lit("REENTRY_DISABLED")))),
    })
    return parents, children


def _verdicts(asking: DataFrame, units: DataFrame, candidates: DataFrame, called: DataFrame, names: DataFrame, judged: DataFrame | None, retriever: Retriever | None) -> DataFrame:
    """Candidates of each branch's constraint that are examined, in order: codes, decisions, and whether a child is ``born``."""
    settings = ["method", "text_binding", "verify_text", "max_relations", "max_links", "max_active", "n_waiting", "text_top_k"]
    target = asking.select("question_id", "branch_id", "bindings", (F.col("parent_id").isNotNull() & (F.col("method") == "iterative_text")).alias("follows"), "pick.*", *settings)
    units = unsent(units.join(target.select("question_id").distinct(), "question_id", "left_semi"))
    w = Window.partitionBy("question_id").orderBy("doc_index", "sent_index", "passage_id")
    top = units.where("visible").withColumn("rank", F.row_number().over(w))
    place = ["branch_id", "passage_id", "doc_index", "sent_index", "raw_text"]
    plain = target.where("not follows").select("question_id", "branch_id", "text_top_k").join(top, "question_id").where("rank <= text_top_k").select(*place)
    bound = target.where("follows").select("branch_id", F.explode(F.map_values("bindings")).alias("b")).join(called, F.col("b.id") == F.col("entity_id"), "left")
    bound = bound.groupBy("branch_id").agg(F.collect_list(F.coalesce("canonical", "b.literal")).alias("names"))
    after = target.where("follows").select("question_id", "branch_id", "cid", "relation", "text_top_k").join(bound, "branch_id", "left").withColumn("names", F.coalesce("names", F.array().cast(TEXTS)))
    if retriever is None:
        passages = plain.unionByName(followed(after, units, "text_top_k").select(*place))
    else:
        bearer = called.select(F.col("entity_id").alias("bound_id"), F.col("canonical").alias("bearer"))
        asks = target.join(bearer, "bound_id", "left").select("question_id", "branch_id", "text_top_k", "follows", F.when(F.col("forward"), F.concat_ws(" ", "bearer", "relation")).otherwise(F.concat_ws(" ", "relation", "bearer")).alias("query"))
        pool = asks.join(units, "question_id").where("follows or visible")
        best = Window.partitionBy("branch_id").orderBy(F.desc("score"), "doc_index", "sent_index", "passage_id")
        passages = retriever(pool).withColumn("rank", F.row_number().over(best)).where("rank <= text_top_k").select(*place)
    rows = target.join(candidates, ["question_id", "cid"]).join(unsent(passages), ["branch_id", "passage_id"])
    mine = Window.partitionBy("branch_id")
    rows = rows.withColumns({"nth": F.row_number().over(mine.orderBy("pos", "passage_id")), "n_found": F.count(F.lit(1)).over(mine)}).where("nth <= max_relations")
    rows = rows.join(called.select(F.col("entity_id").alias("bound_id"), "called"), "bound_id", "left")
    known = F.when(F.col("forward"), F.col("head_surface")).otherwise(F.col("tail_surface"))
    rows = rows.withColumn("surface", F.when(F.col("forward"), F.col("tail_surface")).otherwise(F.col("head_surface")))
    span = span_ok(F.col("raw_text"), F.col("char_start"), F.col("char_end"), F.col("quote"))
    rows = rows.withColumn("v", text_verdict(span, names_match(known, F.coalesce("called", F.array().cast(TEXTS))), F.col("quote"), F.col("relation"), F.col("variants"), F.col("verify_text")))
    sound = ~F.col("v.reason").isin("INVALID_SPAN", "DIRECTION_MISMATCH")
    if judged is not None:
        told = judged.select("question_id", "cid", "pos", F.struct("decision", "reason").alias("judgment"))
        rows = rows.join(unsent(told), ["question_id", "cid", "pos"], "left").withColumn("v", F.when(sound & F.col("verify_text") & F.col("judgment").isNotNull(), F.col("judgment")).otherwise(F.col("v")))
    loose = F.col("method").isin("simple_slot", "cog_notebook") & sound & (F.col("surface") != "") & F.contains("quote", "surface")
    rows = rows.withColumn("v", F.when(loose, F.struct(F.lit("SUPPORTED").alias("decision"), F.upper("method").alias("reason"))).otherwise(F.col("v")))
    rows = rows.withColumn("supported", F.col("v.decision") == "SUPPORTED")
    # Names are looked up for what is supported alone; more bearers than max_links look like that many.
    links = link_notes(rows.where("supported").select("surface"), names)
    rows = rows.join(unsent(links), "surface", "left")
    seen = F.least("n_matches", "max_links")
    note = F.when(F.col("supported"), F.when(F.coalesce("n_matches", F.lit(0)) == 0, "UNLINKABLE").when(seen > 1, "AMBIGUOUS_ENTITY").when(F.col("exact"), "EXACT_NAME").otherwise("ALIAS_UNIQUE"))
    rows = rows.withColumn("note", note).withColumn("joined", F.coalesce(F.col("note").isin("EXACT_NAME", "ALIAS_UNIQUE"), F.lit(False)))
    rows = rows.withColumn("accepted", F.col("joined") & F.col("text_binding")).withColumn("n_accepted", F.sum(F.col("accepted").cast("int")).over(mine.orderBy("nth")))
    room = F.col("max_active") - F.col("n_waiting")
    rows = rows.where(F.col("n_accepted") - F.col("accepted").cast("int") <= F.greatest(F.lit(0), room)).withColumn("born", F.col("accepted") & (F.col("n_accepted") <= room))
    codes = F.array(
        F.col("v.reason"), F.col("note"), F.when(F.col("joined") & ~F.col("text_binding"), "TEXT_BINDING_DISABLED"), F.when(F.col("accepted") & ~F.col("born"), "FORK_TRUNCATED"),
        F.when(F.col("n_found") > F.col("max_relations"), "RELATION_TRUNCATED"),
    )
    return rows.select("branch_id", "bound_id", "forward", "linked", "head_surface", "predicate", "tail_surface", "quote", "sent_index", "note", "born", F.col("n_accepted").alias("nth"), _some(codes).alias("codes"), _some(F.array("v.decision", "note")).alias("decided"))


def link_notes(surfaces: DataFrame, names: DataFrame) -> DataFrame:
    """``surface, n_matches, linked, exact`` of every distinct surface: the first entity that bears it, and whether it is spelled as its main name."""
    s = surfaces.where("surface is not null").distinct().withColumn("norm", norm_name(F.col("surface")))
    one = F.min(F.struct("entity_id", "canonical"))
    hits = s.join(names, "norm", "left").groupBy("surface").agg(F.countDistinct("entity_id").alias("n_matches"), one.alias("one"))
    return hits.select("surface", "n_matches", F.col("one.entity_id").alias("linked"), (F.col("one.canonical") == F.col("surface")).alias("exact"))


def _revoked(branches: DataFrame, constraints: DataFrame) -> DataFrame:
    """Branches of runs that revoke a variable: it falls with all that depends on it."""
    pair = F.explode(F.flatten(F.transform("reads", lambda r: F.transform("writes", lambda x: F.struct(r.alias("reads"), x.alias("writes")))))).alias("p")
    pairs = constraints.select("question_id", pair).groupBy("question_id").agg(F.collect_set("p").alias("pairs"))
    rows = branches.join(unsent(pairs), "question_id", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<reads:string,writes:string>>")))
    hit = F.col("revoke").isNotNull() & (F.col("bindings")[F.col("revoke")].isNotNull() | F.exists("proofs", lambda p: F.coalesce(p["produces"] == F.col("revoke"), F.lit(False))))
    step = lambda doomed, _: F.array_union(doomed, F.transform(F.filter("pairs", lambda p: F.array_contains(doomed, p["reads"])), lambda p: p["writes"]))
    doomed = F.aggregate("pairs", F.array("revoke"), step)
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("doomed", F.when(F.col("hit"), doomed).otherwise(F.array().cast(TEXTS)))
    lost = lambda p: F.coalesce(F.array_contains("doomed", p["produces"]), F.lit(False)) | F.coalesce(F.array_contains("doomed", p["parent"]), F.lit(False))
    falls = lambda p: p.withField("invalidated", p["invalidated"] | lost(p)).withField("reason", F.when(lost(p), "REVOKED").otherwise(p["reason"]))
    rows = rows.withColumns({
        "proofs": F.when(F.col("hit"), F.transform("proofs", falls)).otherwise(F.col("proofs")), "bindings": F.map_filter("bindings", lambda k, _: ~F.array_contains("doomed", k)),
        "reasons": F.when(F.col("hit"), F.array_union("reasons", F.array(F.lit("REVOKED")))).otherwise(F.col("reasons")), "status": F.when(F.col("hit") & (F.col("status") != "FORKED"), "INVALIDATED").otherwise(F.col("status")),
    })
    return rows.drop("pairs", "hit", "doomed")


def outcomes(branches: DataFrame, runs: DataFrame, plans: DataFrame, names: DataFrame) -> DataFrame:
    """One row per run: status, answer, all answers in order of completion, whether it is uncertain, and every code.

    Forked branches have no say. One answer is complete, several are ambiguous; a complete check has no answer. An answer is
    uncertain where the budget ended another branch or live branches bind a variable differently.
    """
    canonical = unsent(names.groupBy("entity_id").agg(F.min("canonical").alias("canonical")))
    plans = unsent(plans)
    usable = branches.where("status <> 'FORKED'").join(plans.select("question_id", F.col("answer").alias("variable")), "question_id")
    bound = F.col("bindings")[F.col("variable")]
    done = (F.col("status") == "COMPLETE") & consistent() & (F.col("variable").isNull() | bound.isNotNull())
    usable = usable.select("run_id", "status", "seq", "bindings", "variable", done.alias("done"), F.when(done, bound["id"]).alias("answer_id"), F.when(done, bound["literal"]).alias("answer_literal"))
    told = usable.join(canonical, F.col("answer_id") == F.col("entity_id"), "left").withColumn("told", F.coalesce("canonical", "answer_id", "answer_literal"))
    values = told.where("told is not null").groupBy("run_id", "told").agg(F.min("seq").alias("seq")).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "told"))), lambda a: a["told"]).alias("answers"))
    live = usable.where("status <> 'INVALIDATED'").select("run_id", F.explode(F.map_entries("bindings")).alias("b")).select("run_id", F.col("b.key").alias("name"), F.coalesce("b.value.id", F.concat(F.lit("lit:"), F.col("b.value.literal"))).alias("value"))
    competing = live.groupBy("run_id", "name").agg(F.countDistinct("value").alias("n")).groupBy("run_id").agg((F.max("n") > 1).alias("competing"))
    each = usable.groupBy("run_id").agg(F.max("done").alias("done"), F.max(F.col("status") == "BUDGET_EXHAUSTED").alias("cut"), F.max(F.col("status") == "INVALIDATED").alias("fell"))
    codes = branches.groupBy("run_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("decisions")))).alias("decisions"))
    rows = runs.select("run_id", "question_id", "preset").join(plans.select("question_id", "answer", F.col("reason").alias("refused")), "question_id").withColumnRenamed("answer", "variable")
    for told in (each, values, competing, codes):
        rows = rows.join(unsent(told), "run_id", "left")
    none = F.array().cast(TEXTS)
    n = F.when(F.col("answers").isNull(), 0).otherwise(F.size("answers"))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(F.col("refused").isNotNull(), "PLAN_UNSUPPORTED").when(on("done") & F.col("variable").isNull(), "COMPLETE").when(n > 1, "AMBIGUOUS").when(n == 1, "COMPLETE")
        .when(on("fell"), "INVALIDATED").when(on("cut"), "BUDGET_EXHAUSTED").otherwise("EXHAUSTED")
    )
    return rows.select(
        "run_id", "question_id", "preset", status.alias("status"), F.when(n == 1, F.col("answers")[0]).alias("answer"), F.coalesce("answers", none).alias("answers"), ((n == 1) & (on("cut") | on("competing"))).alias("uncertain"),
        F.coalesce("reasons", _some(F.array("refused"))).alias("reasons"), F.coalesce("decisions", none).alias("decisions"),
    )


def chain(branches: DataFrame) -> DataFrame:
    """Proofs of branches that are not forked and were not revoked, one row each: the replay of a run."""
    rows = branches.where("status <> 'FORKED'").select("run_id", "question_id", "preset", "branch_id", "status", F.posexplode("proofs").alias("at", "p"))
    return rows.where("not p.invalidated").select("run_id", "question_id", "preset", "branch_id", "status", "at", "p.*")
