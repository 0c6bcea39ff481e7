"""Queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import score, verify
from graphloom.functions.text import bare, norm_name
from graphloom.operators import audit, closure, flatten, graph, orphans, revoke, scoring, vectors, visits
from graphloom.plans import compiler, workload
from graphloom.session import table, unsent
from graphloom.sources import json_files, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FLAGSHIP = "q28_successor_reentry"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _graph_faults(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All references of the graph, and those to records that are missing or orphaned."""
    triples, titles = table(spark, sf_dir, "triples"), table(spark, sf_dir, "title_triples")
    refs = orphans.graph_references(triples, titles)
    return refs, orphans.orphan_cascade(refs, orphans.graph_lives(table(spark, sf_dir, "entities"), table(spark, sf_dir, "core_entities"), triples))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct ones of the cascade."""
    return _graph_faults(spark, sf_dir)[1].where("depth = 0").select("src_table", "src_key", "ref_field", "ref_pos")


@query
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and month of loading: references, those without a record, those that inherit the fault, records with
    an orphan reference, and records that only inherit one."""
    refs, found = _graph_faults(spark, sf_dir)
    month = F.date_format("as_of", "yyyy-MM").alias("period")
    every = refs.groupBy("src_table", month).agg(F.count(F.lit(1)).alias("n_refs"))
    faults = found.groupBy("src_table", month).agg(F.count_if(F.col("depth") == 0).alias("n_orphan_refs"), F.count_if(F.col("depth") > 0).alias("n_inherited_refs"))
    records = orphans.orphan_records(found).groupBy(F.col("rec_table").alias("src_table"), month).agg(F.count_if(F.col("depth") == 0).alias("n_direct_records"), F.count_if(F.col("depth") > 0).alias("n_inherited_records"))
    counts = ["n_orphan_refs", "n_inherited_refs", "n_direct_records", "n_inherited_records"]
    return every.join(faults, ["src_table", "period"], "left").join(records, ["src_table", "period"], "left").select("src_table", "period", "n_refs", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.child_objects(table(spark, sf_dir, "phase2_records"), table(spark, sf_dir, "branch_states"))


@query
def p3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate evidences, each with the triple it lies in."""
    nodes = flatten.evidence_nodes(table(spark, sf_dir, "phase2_records"), [flatten.PHASE2_CHILD, flatten.PHASE2_PARENT])
    rows = flatten.linked(nodes, {flatten.PHASE2_CHILD: flatten.PHASE2_PARENT}).where("kind = 'object'")
    return rows.select("rec_key", "path", "pos", "parent_path", "parent_pos").distinct()


@query
def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of accepted evidence, each with the evidence it lies in."""
    kinds = {"accepted_evidence/*/source": "accepted_evidence/*"}
    rows = flatten.linked(flatten.branch_nodes(table(spark, sf_dir, "branch_states"), [*kinds, *kinds.values()]), kinds).where("kind = 'object'")
    return rows.select("rec_key", "path", "parent_path", "parent_pos", "place").distinct()


# Graph access over the evidence tables.


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_table(table(spark, sf_dir, "triples"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_names(graph.entity_table(table(spark, sf_dir, "core_entities"), table(spark, sf_dir, "entities")))


@query
def q01_norm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("entity_id", "norm").distinct()


@query
def q02_match_surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "candidates").select(F.col("head_surface").alias("surface"))
    return graph.link_surfaces(s, _names(spark, sf_dir)).select("surface", "n_matches")


@query
def q03_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.side(_edges(spark, sf_dir), "head_key")


@query
def q04_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.side(_edges(spark, sf_dir), "tail_key")


def _title_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "title_triples").select("map_row", F.posexplode("triple_ids").alias("pos", "triple_id")).where("triple_id is not null")


@query
def q05_mask_active_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each title entry, and those still active once deleted triples are masked."""
    triples = table(spark, sf_dir, "triples").select("triple_id", "active", "deleted_at")
    live = graph.mask(triples.select("triple_id", "active"), triples.where("deleted_at is not null"))
    ids = _title_ids(spark, sf_dir).join(live, "triple_id", "left")
    return ids.groupBy("map_row").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.coalesce("active", F.lit(False))).alias("n_active"))


@query
def q06_forced_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title's ids in their given order, those only that exist and are active."""
    live = table(spark, sf_dir, "triples").where("active").select("triple_id")
    given = _title_ids(spark, sf_dir).join(live, "triple_id").groupBy("map_row").agg(F.array_sort(F.collect_list(F.struct("pos", "triple_id"))).alias("x"))
    return given.select("map_row", F.array_join(F.transform("x", lambda x: x["triple_id"]), ",").alias("ids"))


@query
def q07_both_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).where("active and head_key is not null and tail_key is not null")
    return e.groupBy("head_key", "tail_key").agg(F.count(F.lit(1)).alias("n_edges"), F.min("upstream_index").alias("first_index"))


@query
def q08_entity_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).where("active and head_key is not null and tail_literal is not null")
    return e.groupBy("head_key", "tail_literal").agg(F.count(F.lit(1)).alias("n_edges"), F.min("upstream_index").alias("first_index"))


@query
def q09_shape_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each candidate's ends resolve; ambiguity on either end wins."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", "head_surface", "tail_surface").distinct()
    sides = c.select(F.explode(F.array("head_surface", "tail_surface")).alias("surface"))
    n = graph.link_surfaces(sides, _names(spark, sf_dir)).select("surface", "n_matches")
    h = n.select(F.col("surface").alias("head_surface"), F.col("n_matches").alias("h"))
    t = n.select(F.col("surface").alias("tail_surface"), F.col("n_matches").alias("t"))
    rows = c.join(h, "head_surface", "left").join(t, "tail_surface", "left").fillna(0, ["h", "t"])
    shape = F.when((F.col("h") > 1) | (F.col("t") > 1), "ambiguous").when((F.col("h") == 1) & (F.col("t") == 1), "both_entity").when((F.col("h") == 1) | (F.col("t") == 1), "one_entity_one_var").otherwise("wait")
    return rows.select("candidate_id", shape.alias("shape"))


@query
def q10_first_supported_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per head and relation the first edge with a source that can be located, and how many came before it."""
    e = _edges(spark, sf_dir).where("active and head_key is not null and relation is not null")
    located = F.coalesce(F.exists("sources", lambda s: s["quote"].isNotNull() & s["title"].isNotNull()), F.lit(False))
    return graph.first_accepted(e.withColumn("ok", located), ["head_key", "relation"], F.col("upstream_index"), F.col("ok"), ["triple_id"]).select("head_key", "relation", "triple_id", "n_rejected")


@query
def q11_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core entities through 'funded by' and then 'supplied by', the first edge of each hop."""
    e = _edges(spark, sf_dir).where("active and head_key is not null and tail_key is not null")
    hop = lambda r: e.where(F.col("relation") == r).groupBy("head_key").agg(F.min_by("tail_key", "upstream_index").alias("tail_key"))
    start = table(spark, sf_dir, "core_entities").select(bare(F.col("entity_id")).alias("head_key")).distinct()
    one = start.join(hop("funded by"), "head_key").select("head_key", F.col("tail_key").alias("middle"))
    return one.join(hop("supplied by").withColumnRenamed("head_key", "middle").withColumnRenamed("tail_key", "answer"), "middle", "left").select("head_key", "middle", "answer")


@query
def q13_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, e = graph.entity_table(table(spark, sf_dir, "core_entities"), table(spark, sf_dir, "entities")), _edges(spark, sf_dir)
    known = entities.select(bare(F.col("entity_id")).alias("k")).distinct()
    ends = e.select(F.explode(F.array("head_key", "tail_key")).alias("k")).where("k is not null")
    one = lambda name, rows: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("issue"), "n")
    repeated = entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = [one("dangling_end", ends.join(known, "k", "left_anti")), one("id_with_two_records", repeated), one("null_head", e.where("head_key is null")), one("tail_missing", e.where("tail_key is null and tail_literal is null")), one("tail_twice", e.where("tail_key is not null and tail_literal is not null"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def q22_verify_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every edge for the first word of its relation, checks on and off, forced and not; an edge without a head has no direction."""
    e = _edges(spark, sf_dir).where("relation is not null")
    sources = F.col("sources")
    quotes = F.concat_ws(" ", F.transform(sources, lambda s: s["quote"]))
    located = F.coalesce(F.exists(sources, lambda s: s["quote"].isNotNull() & s["title"].isNotNull()), F.lit(False))
    variants = F.array(F.substring_index("relation", " ", 1), F.lit("Located  in"))
    ways = F.explode(F.array(*[F.struct(F.lit(c).alias("checked"), F.lit(f).alias("forced")) for c in (True, False) for f in (True, False)])).alias("w")
    v = verify.graph_verdict(F.col("head_key").isNotNull(), F.col("relation"), variants, quotes, located, F.col("w.forced"), F.col("w.checked"))
    return e.select("*", ways).select("triple_id", "w.checked", "w.forced", v.alias("v")).select("triple_id", "checked", "forced", "v.decision", "v.reason")


@query
def q51_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "core_entities").unionByName(table(spark, sf_dir, "entities"))
    return graph.fingerprint(*graph.graph_lines(entities, table(spark, sf_dir, "triples"), table(spark, sf_dir, "title_triples")))


@query
def q57_link_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("candidate_id", F.col("tail_surface").alias("surface")).distinct()
    return c.join(graph.link_surfaces(c, _names(spark, sf_dir)), "surface").groupBy("reason").agg(F.count(F.lit(1)).alias("n_candidates"))


# Questions over the sales graph: customers lack edges that sentences still tell.


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.customers(spark, sf_dir).where("masked")


def _run(spark: SparkSession, sf_dir: str, *presets: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, branches, gold) of every customer's question under each preset."""
    t = workload.tables(spark, sf_dir)
    runs = orphans.written(visits.runs_of(t["plans"], list(presets)), "runs")
    branches = orphans.written(visits.execute(runs, t["constraints"], t["names"], t["edges"], t["units"], t["candidates"]), "branches")
    return visits.outcomes(branches, runs, t["plans"], t["names"]), branches, t["gold"]


def _answered(spark: SparkSession, sf_dir: str, *presets: str) -> DataFrame:
    """Status, answer, the kinds of proofs that lead to it, and all codes, per customer and preset."""
    outcomes, branches, _ = _run(spark, sf_dir, *presets)
    path = visits.chain(branches).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cid", "kind"))), lambda x: x["kind"]), ",").alias("path"))
    rows = outcomes.join(unsent(path), "run_id", "left")
    return rows.select(F.col("question_id").cast("long").alias("c_custkey"), "preset", "status", "answer", F.coalesce("path", F.lit("")).alias("path"), F.array_join("reasons", ",").alias("reasons"))


@query
def q12_three_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through their customer and its nation to the region, by edges alone."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = workload.customers(spark, sf_dir).where("not masked").select("c_custkey", F.col("nation").alias("n_name"), F.col("region").alias("r_name"))
    return o.join(c, "c_custkey").select("o_orderkey", "n_name", "r_name")


@query
def q18_relation_cue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a triple's relation agrees with the predicate of a candidate of the same spelling or a part of it, and whether its sources' quotes hold it."""
    e = _edges(spark, sf_dir).where("relation is not null")
    quotes = F.concat_ws(" ", F.transform("sources", lambda s: s["quote"]))
    variants = F.array(F.substring_index("relation", " ", 1), F.lit("located  in"), F.lit(" "))
    return e.select("triple_id", verify.relation_matches(F.col("relation"), F.array(F.lit("Funded  by"), F.lit(" "))).alias("fits"), verify.cue_in_text(quotes, variants).alias("cue"))


@query
def q19_negation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("c_custkey", verify.negation_before_cue(F.col("quote"), F.array(F.lit(workload.CUE))).alias("negated"))


@query
def q20_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array("name")
    return _claims(spark, sf_dir).select("c_custkey", verify.qualifier_conflict(F.col("quote"), F.lit(workload.CUE)).alias("conflict"), verify.names_match(F.col("head_surface"), names).alias("direction"))


@query
def q21_verify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every candidate's quote in its unit, its predicate as the cue and its head as the bound name, checks on and off."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", "passage_id", "char_start", "char_end", "quote", "predicate_surface", "head_surface").distinct()
    u = table(spark, sf_dir, "text_units").select("passage_id", "raw_text").distinct()
    rows = c.join(u, "passage_id").select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("checked"))
    span = verify.span_ok(F.col("raw_text"), F.col("char_start"), F.col("char_end"), F.col("quote"))
    held = F.coalesce(F.contains(norm_name(F.col("quote")), norm_name(F.col("head_surface"))), F.lit(False))
    v = verify.text_verdict(span, held, F.col("quote"), F.col("predicate_surface"), F.array(F.substring_index("predicate_surface", " ", 1)), F.col("checked"))
    return rows.select("candidate_id", "checked", v.alias("v")).select("candidate_id", "checked", "v.decision", "v.reason")


@query
def q27_text_commit_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that commit a nation read from text, with the sentence that proves it."""
    branches = _run(spark, sf_dir, "core11")[1].where("parent_id is not null")
    proof = F.filter("proofs", lambda p: p["kind"] == "TEXT")[0]
    return branches.select(F.col("question_id").cast("long").alias("c_custkey"), F.col("bindings")["?nation"]["id"].alias("bound"), proof["quote"].alias("quote"), "depth")


@query
def q28_successor_reentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's region; a customer's missing hop is recovered from text and the graph goes on from there."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(_answered(spark, sf_dir, "core11"), "c_custkey").select("o_orderkey", "status", "answer", "path", "reasons")


@query
def q29_no_reentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir, "no_reentry")


@query
def q30_core_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir, "core00", "core01", "core10", "core11").groupBy("preset", "status", "path", "reasons").agg(F.count(F.lit(1)).alias("n"))


@query
def q31_simple_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir, "simple_bind")


@query
def q32_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notebook of the loose method: what it asks, every sentence it reads, and each judgment with its analysis."""
    t = workload.tables(spark, sf_dir)
    branches = _run(spark, sf_dir, "cog_controlled")[1]
    entry = lambda df, kind, text: df.select(F.col("question_id").cast("long").alias("c_custkey"), F.lit(kind).alias("kind"), text.alias("text"))
    graph_only = F.exists("proofs", lambda p: (p["cid"] == "c0") & (p["kind"] == "GRAPH"))
    asked = branches.where(F.col("parent_id").isNull() & ~graph_only).select("question_id")
    query_ = t["candidates"].where("cid = 'c0'").join(t["constraints"].where("cid = 'c0'").select("question_id", "head", "relation"), "question_id").join(asked, "question_id", "left_semi")
    facts = t["units"].where("visible").join(asked, "question_id", "left_semi")
    made = branches.where("parent_id is not null").withColumn("p", F.filter("proofs", lambda p: p["reason"] == "COG_NOTEBOOK")[0]).where("p is not null")
    parts = [
        entry(query_, "followup_query", F.concat_ws(" ", "head", "relation")), entry(facts, "fact", F.col("raw_text")), entry(made, "judgment", F.concat_ws(" ", "p.produces", "p.relation", "p.tail_name")),
        entry(made, "analysis", F.concat(F.lit("bound "), "p.produces", F.lit(" to "), "p.tail_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def q33_iterative_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir, "iterative_text", "verify_graph_off").groupBy("preset", "status", "path", "reasons").agg(F.count(F.lit(1)).alias("n"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_cases(*_run(spark, sf_dir, *[p[0] for p in visits.PRESETS]))


@query
def q45_method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per preset: questions, mean F1, how often the successor was acquired, mean precision of proofs and how many have one."""
    return scoring.method_report(_scored(spark, sf_dir))


@query
def q45b_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.failure_counts(_scored(spark, sf_dir))


@query
def q45c_score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.score_cases(*_run(spark, sf_dir, "core11", "no_reentry"))
    return rows.withColumn("c_custkey", F.col("question_id").cast("long")).drop("run_id", "question_id")


@query
def q46_paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference between pairs of presets on the same questions."""
    return scoring.paired_report(_scored(spark, sf_dir))


# Plans, branches, proofs and texts of the evidence tables.


PLAN_ROW = "question_id string, cid string, relation string, rank int, terminal boolean, answer string, reason string"


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query triples of every question, in order, as one JSON list per question."""
    kinds = ["triples_evidence/*/query_triple"]
    leaves = [f"{kinds[0]}/{c}" for c in ("head", "relation", "tail")]
    nodes = flatten.evidence_nodes(table(spark, sf_dir, "phase2_records"), leaves).where("kind = 'text'")
    at = F.split("path", "/")
    rows = nodes.select(F.col("rec_key").alias("question_id"), at[1].cast("int").alias("n"), at[3].alias("field"), "value").distinct()
    wide = rows.groupBy("question_id", "n").pivot("field", ["head", "relation", "tail"]).agg(F.min("value")).where("head is not null and tail is not null")
    return wide.groupBy("question_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n", "head", "relation", "tail")))).alias("patterns"))


def _compile_batches(batches):
    import json

    import pandas as pd

    for pdf in batches:
        out = []
        for qid, patterns in zip(pdf["question_id"], pdf["patterns"]):
            plan = compiler.compile_plan(json.loads(patterns))
            ranks = compiler.topo_ranks(plan)
            out += [(qid, c.cid, c.relation, ranks[c.cid], c.terminal, plan.answer, None) for c in plan.constraints] or [(qid, None, None, None, None, None, plan.reason)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN_ROW.split(", ")]).astype({"rank": "Int32"})


@query
def q14_plan_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _patterns(spark, sf_dir).mapInPandas(_compile_batches, PLAN_ROW)
    return plans.groupBy("question_id").agg(F.count("cid").alias("n_constraints"), F.max("answer").alias("answer"), F.max("reason").alias("reason"))


@query
def q15_topo_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).mapInPandas(_compile_batches, PLAN_ROW).where("cid is not null").select("question_id", "cid", "rank", "terminal")


def _constraint_batches(batches):
    import json

    import pandas as pd

    columns = [c.split()[0] for c in closure.CONSTRAINT.split(", ")]
    for pdf in batches:
        yield pd.DataFrame([r for qid, patterns in zip(pdf["question_id"], pdf["patterns"]) for r in closure.constraint_rows(qid, compiler.compile_plan(json.loads(patterns)))], columns=columns)


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Constraints of every question's own plan, names and edges of the evidence graph."""
    constraints = orphans.written(_patterns(spark, sf_dir).mapInPandas(_constraint_batches, closure.CONSTRAINT), "plans")
    entities = graph.entity_table(table(spark, sf_dir, "core_entities"), table(spark, sf_dir, "entities"))
    main = entities.groupBy(bare(F.col("entity_id")).alias("entity_id")).agg(F.min("canonical_name").alias("canonical"))
    names = graph.entity_names(entities).select(bare(F.col("entity_id")).alias("entity_id"), "name", "norm").distinct().join(main, "entity_id")
    quotes = F.concat_ws(" ", F.transform("sources", lambda x: x["quote"]))
    located = F.coalesce(F.exists("sources", lambda x: x["quote"].isNotNull() & x["title"].isNotNull()), F.lit(False))
    told = F.try_element_at("sources", F.lit(1))
    edges = _edges(spark, sf_dir).select(
        "triple_id", F.col("upstream_index").alias("ord"), F.col("head_key").alias("head_id"), F.col("tail_key").alias("tail_id"), "tail_literal", "relation", "active", quotes.alias("quotes"), located.alias("located"), told["quote"].alias("quote"), told["sent_index"].alias("sent_index"),
    )
    of = lambda side: main.select(F.col("entity_id").alias(f"{side}_id"), F.col("canonical").alias(f"{side}_name"))
    return constraints, names, edges.join(of("head"), "head_id", "left").join(of("tail"), "tail_id", "left")


@query
def q62_plan_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's own plan answered from the evidence graph with its edges verified: what is proven, bound and why not more."""
    constraints, names, edges = _planned(spark, sf_dir)
    done = closure.closure(closure.start(constraints), constraints, names, edges)
    return done.select("question_id", F.size("proofs").alias("n_proofs"), F.size("bindings").alias("n_bound"), F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


@query
def q62b_closure_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with verification of edges off: every edge whose relation fits is taken."""
    constraints, names, edges = _planned(spark, sf_dir)
    done = closure.closure(closure.start(constraints), constraints, names, edges, verify=False)
    return done.select("question_id", F.size("proofs").alias("n_proofs"), F.size("bindings").alias("n_bound"), F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


def _answers_of_plans(spark: SparkSession, sf_dir: str, *presets: str) -> DataFrame:
    constraints, names, edges = _planned(spark, sf_dir)
    c = table(spark, sf_dir, "candidates").select("question_id", F.col("constraint_id").alias("cid"), F.struct("retrieval_rank", "candidate_id").alias("pos"), "passage_id", "head_surface", F.col("predicate_surface").alias("predicate"), "tail_surface", "char_start", "char_end", "quote").distinct()
    plans = orphans.written(_patterns(spark, sf_dir).mapInPandas(_compile_batches, PLAN_ROW).groupBy("question_id").agg(F.max("answer").alias("answer"), F.max("reason").alias("reason")), "answers")
    runs = orphans.written(visits.runs_of(plans, list(presets)), "runs")
    branches = orphans.written(visits.execute(runs, constraints, names, edges, _visible(spark, sf_dir), c), "branches")
    out = visits.outcomes(branches, runs, plans, names)
    return out.select("question_id", "preset", "status", "answer", "uncertain", F.array_join("reasons", ",").alias("reasons"))


@query
def q63_answer_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plans under the default preset and with edges unverified."""
    return _answers_of_plans(spark, sf_dir, "core11", "verify_graph_off")


@query
def q63b_iterative_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plans with terminal hops read from the question's own sentences as well."""
    return _answers_of_plans(spark, sf_dir, "iterative_text")


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per branch; re-delivered rows are identical, so any of them stands for all."""
    cols = ["question_id", "branch_id"]
    b = table(spark, sf_dir, "branch_states")
    return b.withColumn("body", F.to_json(F.struct(*[c for c in b.columns if c not in cols]))).dropDuplicates([*cols, "body"]).drop("body")


def _proofs(b: DataFrame) -> DataFrame:
    return b.select("question_id", "branch_id", "status", F.explode("accepted_evidence").alias("e")).where("e is not null").select("question_id", "branch_id", "status", F.col("e").dropFields("branch_id").alias("e")).select("question_id", "branch_id", "status", "e.*")


@query
def q16_ready_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending constraints of each branch that no active proof answers."""
    proven = F.transform(F.filter(F.coalesce("accepted_evidence", F.array()), lambda e: e.isNotNull() & ~e["invalidated"]), lambda e: e["constraint_id"])
    b = _branches(spark, sf_dir)
    pending = F.filter("pending_constraints", lambda c: c.isNotNull())
    empty = F.array().cast("array<string>")
    ready = F.array_except(F.coalesce(pending, empty), F.when(F.col("accepted_evidence").isNull(), empty).otherwise(proven))
    return b.select("question_id", "branch_id", F.size(ready).alias("n_ready"), F.array_min(ready).alias("first_ready"))


@query
def q17_span_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("candidate_id", "passage_id", "char_start", "char_end", "quote").distinct()
    u = table(spark, sf_dir, "text_units").select("passage_id", "raw_text").distinct()
    return c.join(u, "passage_id").select("candidate_id", verify.span_ok(F.col("raw_text"), F.col("char_start"), F.col("char_end"), F.col("quote")).alias("ok"))


TOP_K = 8


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_units").select("question_id", "passage_id", "doc_index", "sent_index", "visible", "raw_text").distinct()


@query
def q23_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first visible units of every question."""
    w = Window.partitionBy("question_id").orderBy("doc_index", "sent_index", "passage_id")
    return _visible(spark, sf_dir).where("visible").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_K).select("question_id", "passage_id", "rank")


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of every constraint of a question; the first variant stands for one that is missing."""
    row = "triples_evidence/*"
    kinds = [f"{row}/query_triple_index", f"{row}/query_triple/relation", f"{row}/query_triple/relation_variants/*"]
    nodes = flatten.evidence_nodes(table(spark, sf_dir, "phase2_records"), kinds)
    of = lambda n: F.when(F.col("node_type") == kinds[n], F.col("value"))
    told = F.coalesce(F.nullif(F.max(of(1)), F.lit("")), F.min_by(of(2), F.when(F.col("node_type") == kinds[2], F.col("pos"))))
    rows = nodes.groupBy(F.col("rec_key").alias("question_id"), F.split("path", "/")[1].alias("n")).agg(F.max(of(0)).alias("given"), told.alias("relation"))
    return rows.groupBy("question_id", F.concat(F.lit("c"), F.coalesce("given", "n")).alias("cid")).agg(F.min_by("relation", F.col("n").cast("int")).alias("relation"))


@query
def q23b_followup_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every branch and pending constraint by the names bound and the relation that they hold, hidden units included."""
    names = F.transform(F.filter(F.map_values("bindings"), lambda x: x.isNotNull()), lambda x: x["canonical_name"])
    asked = F.array_distinct(F.filter("pending_constraints", lambda c: c.isNotNull()))
    b = _branches(spark, sf_dir).select("question_id", "branch_id", F.coalesce(names, F.array().cast("array<string>")).alias("names"), F.explode_outer(asked).alias("cid"))
    return visits.followed(b.join(_relations(spark, sf_dir), ["question_id", "cid"], "left"), _visible(spark, sf_dir), TOP_K).select("question_id", "branch_id", "cid", "passage_id", "score", "rank")


@query
def q23c_lexical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("candidate_id", "passage_id", "quote").distinct()
    u = table(spark, sf_dir, "text_units").select("passage_id", "raw_text").distinct()
    words = lambda x: F.array_distinct(F.filter(F.split(norm_name(x), " "), lambda w: w != ""))
    q, r = words(F.col("quote")), words(F.col("raw_text"))
    both = F.size(F.array_union(q, r))
    return c.join(u, "passage_id").select("candidate_id", F.round(F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, r)) / both), 6).alias("score"))


@query
def q26_relation_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that are verified: the first three of each constraint of a branch."""
    c = table(spark, sf_dir, "candidates").select("question_id", "constraint_id", "branch_id", "candidate_id", "retrieval_rank").distinct()
    w = Window.partitionBy("question_id", "constraint_id", "branch_id").orderBy("retrieval_rank", "candidate_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 3").select("candidate_id", "place")


@query
def q25_candidate_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers read back, a broken one where the tail is missing and an item that is no object where the head is: place of each quote, or why it is dropped."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", "passage_id", "quote", "head_surface", "tail_surface").distinct()
    item = F.to_json(F.struct("passage_id", "quote", F.col("head_surface").alias("head")))
    item = F.when(F.trim(F.coalesce("head_surface", F.lit(""))) == "", F.lit('"no object"')).otherwise(item)
    content = F.concat(F.lit('{"relations": ['), item, F.when(F.col("tail_surface").isNull(), "").otherwise("]}"))
    shown = c.select("candidate_id", "passage_id").join(table(spark, sf_dir, "text_units").select("passage_id", "raw_text").distinct(), "passage_id")
    read = model.read_relations(c.select("candidate_id", content.alias("content")), "candidate_id", "content", shown)
    return read.select("candidate_id", "pos", "status", "char_start", "char_end")


@query
def q34_fork_cap_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of every branch and those beyond the cap of active branches."""
    b = _branches(spark, sf_dir)
    kids = b.where("parent_branch_id is not null").groupBy("question_id", F.col("parent_branch_id").alias("branch_id")).agg(F.count(F.lit(1)).alias("n_children"))
    room = F.greatest(F.lit(0), F.coalesce("budget.max_active_branches", F.lit(3)))
    return b.join(kids, ["question_id", "branch_id"]).select("question_id", "branch_id", "n_children", F.greatest(F.lit(0), F.col("n_children") - room).cast("long").alias("n_truncated"))


@query
def q35_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a question from its branches: distinct answers to the plan's variable, then revoked, then cut by the budget; uncertain
    where a branch stayed unfinished or branches bind a variable differently."""
    b = _branches(spark, sf_dir).where(~F.array_contains(F.coalesce("reason_codes", F.array().cast("array<string>")), "FORKED"))
    plans = _patterns(spark, sf_dir).mapInPandas(_compile_batches, PLAN_ROW).groupBy("question_id").agg(F.max("answer").alias("variable"))
    b = b.join(plans, "question_id", "left")
    bound = F.when(F.col("bindings").isNotNull() & F.col("variable").isNotNull(), F.col("bindings")[F.col("variable")])
    done = (F.col("status") == "COMPLETE") & (F.col("variable").isNull() | bound.isNotNull())
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    each = b.groupBy("question_id").agg(
        F.countDistinct(F.when(done, bound["canonical_name"])).alias("n_answers"), F.max(F.when(done, bound["canonical_name"])).alias("answer"), F.max(done & F.col("variable").isNull()).alias("checked"),
        has("INVALIDATED").alias("fell"), has("BUDGET_EXHAUSTED").alias("cut"), F.count(F.lit(1)).alias("n_branches"),
    )
    live = b.where("status <> 'INVALIDATED'").select("question_id", F.explode("bindings").alias("name", "v")).where("v is not null")
    value = F.coalesce("v.entity_id", F.concat(F.lit("lit:"), "v.canonical_name"))
    competing = live.groupBy("question_id", "name").agg(F.countDistinct(value).alias("n")).groupBy("question_id").agg((F.max("n") > 1).alias("competing"))
    n = F.col("n_answers")
    status = F.when(F.col("checked"), "COMPLETE").when(n > 1, "AMBIGUOUS").when(n == 1, "COMPLETE").when(F.col("fell"), "INVALIDATED").when(F.col("cut"), "BUDGET_EXHAUSTED").otherwise("EXHAUSTED")
    one = ~F.col("checked") & (n == 1)
    return each.join(competing, "question_id", "left").select("question_id", status.alias("status"), F.when(one, F.col("answer")).alias("answer"), (one & (F.col("cut") | F.coalesce("competing", F.lit(False)))).alias("uncertain"), "n_branches")


def _dependency_batches(batches):
    import json

    import pandas as pd

    for pdf in batches:
        yield pd.DataFrame([(qid, *pair) for qid, patterns in zip(pdf["question_id"], pdf["patterns"]) for pair in compiler.dependencies(compiler.compile_plan(json.loads(patterns)))], columns=["question_id", "reads", "writes"])


@query
def q36_revoke_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What revoking each variable of a branch takes from it, through all that depends on it."""
    plans = _patterns(spark, sf_dir).mapInPandas(_dependency_batches, "question_id string, reads string, writes string")
    rows = revoke.revocations(_branches(spark, sf_dir), plans)
    return rows.select("question_id", "branch_id", "variable", "doomed", "dropped", F.size("revoked").alias("n_revoked"), F.array_join(F.array_sort("revoked"), ",").alias("revoked"), "n_proofs")


@query
def q37_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps spent before each branch of a question, and whether its own still fit."""
    w = Window.partitionBy("question_id").orderBy("depth", "branch_id")
    b = _branches(spark, sf_dir).select("question_id", "branch_id", "depth", F.coalesce("budget.steps_used", F.lit(0)).alias("used"), F.coalesce("budget.max_steps", F.lit(32)).alias("most"))
    spent = F.coalesce(F.sum("used").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.select("question_id", "branch_id", spent.cast("long").alias("steps_before"), (spent + F.col("used") <= F.col("most")).alias("fits"))


@query
def q38_active_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every branch that are not invalidated, by acquisition."""
    live = F.filter("accepted_evidence", lambda e: e.isNotNull() & ~e["invalidated"])
    chain = F.transform(F.array_sort(F.transform(live, lambda e: F.struct(e["acquisition_order"], e["proof_id"].alias("id")))), lambda s: s["id"])
    return _branches(spark, sf_dir).select("question_id", "branch_id", F.array_join(F.coalesce(chain, F.array().cast("array<string>")), ",").alias("chain"))


@query
def q39_reason_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a question's branches, each at its first place in the order of branches."""
    r = _branches(spark, sf_dir).select("question_id", "depth", "branch_id", F.posexplode("reason_codes").alias("pos", "r")).where("r is not null")
    first = r.groupBy("question_id", "r").agg(F.min(F.struct("depth", "branch_id", "pos")).alias("at"))
    return first.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]), ",").alias("reasons"))


@query
def q40_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("candidate_id", score.exact_match(F.col("gold"), F.col("told")).alias("em"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's tail against the true answer of its question."""
    gold = table(spark, sf_dir, "phase2_records").select(F.col("id").alias("question_id"), F.col("ground_truth_answer").alias("gold")).distinct()
    return table(spark, sf_dir, "candidates").select("candidate_id", "question_id", F.col("tail_surface").alias("told")).distinct().join(gold, "question_id")


@query
def q41_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("candidate_id", F.round(score.token_f1(F.col("gold"), F.col("told")), 6).alias("f1"))


@query
def q42_proof_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each branch's active proofs whose ends an edge of the graph joins."""
    p = _proofs(_branches(spark, sf_dir).where(~F.array_contains(F.coalesce("reason_codes", F.array().cast("array<string>")), "FORKED"))).where("not invalidated")
    p = p.select("question_id", "branch_id", bare(F.col("head_entity_id")).alias("head_key"), bare(F.col("tail_entity_id")).alias("tail_key"))
    gold = _edges(spark, sf_dir).where("head_key is not null and tail_key is not null").select("head_key", "tail_key").distinct().withColumn("hit", F.lit(1))
    return p.join(gold, ["head_key", "tail_key"], "left").groupBy("question_id", "branch_id").agg(F.count(F.lit(1)).alias("n_proofs"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("precision"))


@query
def q43_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active proofs with a source, and those whose quote stands in the unit named."""
    p = _proofs(_branches(spark, sf_dir)).where("not invalidated and source is not null").select("question_id", "branch_id", "proof_id", F.col("source.source_id").alias("source_id"), F.col("source.quote").alias("quote"))
    u = table(spark, sf_dir, "text_units").select(F.concat_ws(":", "data_version", "question_id", "doc_index", "sent_index").alias("source_id"), "raw_text").distinct()
    held = F.coalesce(F.max((F.contains("raw_text", "quote")).cast("int")), F.lit(0))
    each = p.join(u, "source_id", "left").groupBy("question_id", "branch_id", "proof_id", "source_id", "quote").agg(held.alias("held"))
    return each.groupBy("question_id", "branch_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("held").alias("n_supported"))


@query
def q44_cost_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as an event log: accesses, calls, failures and tokens."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    of = lambda t: F.count_if(F.col("event_type") == t)
    return e.groupBy("user_id").agg(of("view").alias("n_access"), of("click").alias("n_calls"), of("error").alias("n_errors"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


@query
def q47_quote_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the question that hold each candidate's quote: one is unique, none or several are ambiguous."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", "question_id", "quote").distinct().where("quote <> ''")
    hits = c.join(_visible(spark, sf_dir), "question_id").groupBy("candidate_id").agg(F.count_if(F.contains("raw_text", "quote")).alias("n_hits"))
    return hits.select("candidate_id", "n_hits", F.when(F.col("n_hits") == 1, "unique").when(F.col("n_hits") == 0, "unlocated").otherwise("multiple_spans").alias("issue"))


@query
def q48_sentence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document: how many and how long."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[.\n]+")).alias("s")).where("s <> ''")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("s")).alias("longest"), F.sum(F.length("s")).alias("n_chars"))


@query
def q48b_context_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of nested contexts, as question sets spell them: a title with its sentences, a single sentence or an object."""
    u = table(spark, sf_dir, "text_units").select("question_id", "doc_index", "title", "sent_index", "raw_text").distinct()
    docs = u.groupBy("question_id", "doc_index", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_index", "raw_text"))), lambda x: x["raw_text"]).alias("s"))
    spelled = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    title = F.coalesce(spelled(F.col("title")), F.lit("null"))
    item = F.when(F.size("s") == 1, F.concat(F.lit("["), title, F.lit(","), spelled(F.col("s")[0]), F.lit("]"))).when(F.col("doc_index") % 2 == 0, F.concat(F.lit("["), title, F.lit(","), F.to_json("s"), F.lit("]")))
    item = item.otherwise(F.concat(F.lit('{"title":'), title, F.lit(',"sentences":'), F.to_json("s"), F.lit("}")))
    contexts = docs.select("question_id", F.struct("doc_index", F.coalesce("title", F.lit("")).alias("t"), item.alias("item")).alias("d")).groupBy("question_id").agg(F.array_sort(F.collect_list("d")).alias("d"))
    context = F.concat(F.lit("["), F.array_join(F.transform("d", lambda d: d["item"]), ","), F.lit("]"))
    return json_files.sentences(contexts.select("question_id", context.alias("context")), "question_id", "context")


@query
def q50_gold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public side of every question; the gold column stays behind."""
    return audit.public_view(table(spark, sf_dir, "phase2_records")).select("id", "question", "received_at").distinct()


@query
def q50b_gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold side: the answer of the row that was received last."""
    rows = table(spark, sf_dir, "phase2_records").withColumn("answers", F.array("ground_truth_answer", F.nullif(F.substring_index("question", " ", 1), F.lit(""))))
    return audit.split_gold(rows.select("id", "answers", "received_at"), "id", "received_at", "answers")[1]


@query
def q49_localization_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of candidates and branches against the tables they name, by severity."""
    c = table(spark, sf_dir, "candidates").distinct()
    u = table(spark, sf_dir, "text_units").select("passage_id").distinct()
    b = table(spark, sf_dir, "branch_states").select("question_id", "branch_id").distinct()
    issue = lambda rows, severity, message: rows.select("question_id", F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    parts = [
        issue(c.join(u, "passage_id", "left_anti"), "hard", "unknown passage"),
        issue(c.join(b, ["question_id", "branch_id"], "left_anti"), "hard", "unknown branch"),
        issue(c.where("head_surface is null or trim(head_surface) = ''"), "soft", "blank head"),
        issue(c.where("char_start >= char_end"), "hard", "empty span"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("question_id", "severity", "message").agg(F.count(F.lit(1)).alias("n"))


@query
def q49b_evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of q49 and those of the evidence records against triples, entities and sentences."""
    known = table(spark, sf_dir, "core_entities").select("upstream_id").unionByName(table(spark, sf_dir, "entities").select("upstream_id"))
    found = audit.phase2_issues(table(spark, sf_dir, "phase2_records").select("id", "phase2_json").distinct(), table(spark, sf_dir, "triples"), known, table(spark, sf_dir, "text_units"))
    return q49_localization_audit(spark, sf_dir).unionByName(found.groupBy("question_id", "severity", "message").agg(F.count(F.lit(1)).alias("n")))


@query
def q49c_audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of every question by severity, and whether it passes."""
    questions = table(spark, sf_dir, "phase2_records").select(F.col("id").alias("question_id"))
    return audit.audit_records(questions, q49_localization_audit(spark, sf_dir).select("question_id", "severity", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))))


@query
def q49d_graph_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.graph_hints(table(spark, sf_dir, "phase2_records"))


@query
def q52_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which the sentences read for a candidate's constraint are kept: version, question, constraint, predicate, bindings,
    method, prompt, number of sentences, follow-up and retriever."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", "question_id", "constraint_id", "branch_id", "predicate_surface", "prompt_hash").distinct()
    bound = F.transform(F.filter(F.map_entries("bindings"), lambda e: e["value"].isNotNull()), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"]["entity_id"], e["value"]["canonical_name"])))
    b = _branches(spark, sf_dir).select("question_id", "branch_id", F.array_join(F.array_sort(F.coalesce(bound, F.array().cast("array<string>"))), ";").alias("signature"), (F.col("depth") > 0).alias("follows"))
    rows = c.join(b, ["question_id", "branch_id"], "left")
    key = F.concat_ws("|", F.lit("v1"), "question_id", "constraint_id", "predicate_surface", F.coalesce("signature", F.lit("")), F.lit("iterative_text"), "prompt_hash", F.lit(str(TOP_K)), F.coalesce("follows", F.lit(False)).cast("string"), F.lit("ordered"))
    return rows.select("candidate_id", F.sha2(key, 256).alias("cache_key"))


@query
def q52b_cache_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key is asked for, and how many of these need no search."""
    return q52_cache_key(spark, sf_dir).groupBy("cache_key").agg(F.count(F.lit(1)).alias("n_probes"), (F.count(F.lit(1)) - 1).alias("n_hits"))


@query
def q54_extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt for every constraint of a question that some branch has pending, with its first visible sentences."""
    pending = _branches(spark, sf_dir).select("question_id", F.explode("pending_constraints").alias("cid")).where("cid is not null").distinct()
    ask = F.concat_ws("/", "question_id", "cid")
    units = _visible(spark, sf_dir).select("question_id", "passage_id", "raw_text").distinct()
    top = q23_ordered_topk(spark, sf_dir).join(units, ["question_id", "passage_id"]).join(pending, "question_id").select(ask.alias("ask"), "rank", "passage_id", "raw_text")
    asked = pending.select(ask.alias("ask"), "cid", F.lit("funded by").alias("relation"), F.col("question_id").alias("bound"))
    return model.extraction_prompts(asked, top).select("ask", "prompt_hash", F.length("user").alias("token_bound"))


@query
def q53_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties under keys of all kinds, half of them nested, with the values of secret keys blanked."""
    key = F.element_at(F.array(*[F.lit(x) for x in ("k", "api_key", "K", "Token", "user_secret")]), (F.col("event_id") % 5 + 1).cast("int"))
    named = F.replace("props", F.lit('"k"'), F.concat(F.lit('"'), key, F.lit('"')))
    nested = F.when(F.col("event_id") % 2 == 0, named).otherwise(F.concat(F.lit('{"a": [1, '), named, F.lit('], "password": {"x": [2]}}')))
    return audit.scrub(table(spark, sf_dir, "events").select("event_id", nested.alias("props")), "props")


@query
def q55_scripted_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose passage is among the first visible units of their question."""
    top = q23_ordered_topk(spark, sf_dir).select("question_id", "passage_id")
    return table(spark, sf_dir, "candidates").select("candidate_id", "question_id", "passage_id").distinct().join(top, ["question_id", "passage_id"], "left_semi").select("candidate_id")


@query
def q58_binding_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir, "core01").groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query
def q59_no_successor_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound entities of each branch from which no active edge leads on."""
    bound = _branches(spark, sf_dir).select("question_id", "branch_id", F.explode(F.map_values("bindings")).alias("v")).where("v.entity_id is not null and not v.is_literal")
    bound = bound.select("question_id", "branch_id", bare(F.col("v.entity_id")).alias("head_key")).distinct()
    heads = _edges(spark, sf_dir).where("active and head_key is not null").select("head_key").distinct()
    return bound.join(heads, "head_key", "left_anti").select("question_id", "branch_id", "head_key")


@query
def q60_replay_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of each question that still count, over branches that are neither forked nor revoked, in the order in which they were acquired."""
    b = _branches(spark, sf_dir).where("status <> 'INVALIDATED'").where(~F.array_contains(F.coalesce("reason_codes", F.array().cast("array<string>")), "FORKED"))
    ids = F.array_sort(F.collect_list(F.struct("acquisition_order", "proof_id", "branch_id")))
    return _proofs(b).where("not invalidated").groupBy("question_id").agg(F.array_join(F.transform(ids, lambda x: x["proof_id"]), ",").alias("chain"), F.countDistinct("proof_id").alias("n_ids"))


@query
def q24_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors by dot product, for every query vector."""
    return vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=20)


@query
def q24b_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest by dot product ranked anew by a second score, here their cosine."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.rerank(vectors.top_k(rows, F.col("vec_id") % 100 == 0, k=20), rows, vectors.cosine, k=5)


@query
def q56_actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pending constraint of each branch, in the order given, that no active proof answers."""
    b = _branches(spark, sf_dir).where("pending_constraints is not null")
    proven = F.transform(F.filter("accepted_evidence", lambda e: e.isNotNull() & ~e["invalidated"]), lambda e: e["constraint_id"])
    open_ = F.filter("pending_constraints", lambda c: c.isNotNull() & ~F.coalesce(F.array_contains(proven, c), F.lit(False)))
    return b.select("question_id", "branch_id", F.try_element_at(open_, F.lit(1)).alias("cid")).where("cid is not null")


@query
def q61_synthetic_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made cohort of twenty questions and what its audit says."""
    return json_files.cohort_audit(json_files.synthetic_cohort(spark, 20))


@query
def q64_snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all entities with their upstream ids."""
    both = table(spark, sf_dir, "core_entities").select("entity_id", "upstream_id").unionByName(table(spark, sf_dir, "entities").select("entity_id", "upstream_id"))
    return both.where("upstream_id is not null").distinct()


@query
def q65_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that carry a candidate's title and hold its quote."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", "title", "quote").distinct().where("title is not null and quote <> ''")
    u = table(spark, sf_dir, "text_units").select("passage_id", "title", "raw_text").distinct()
    return c.join(u, "title").where(F.contains("raw_text", "quote")).select("candidate_id", "passage_id").distinct()


@query
def q66_usage_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every question's prompt at most, where no usage was reported."""
    r = table(spark, sf_dir, "phase2_records").select("id", "question").distinct()
    return r.select("id", F.greatest(F.lit(1), F.length("question")).alias("token_bound"))
