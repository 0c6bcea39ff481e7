"""Guards on inputs: gold columns stay out of inference, secrets stay out of logs."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import bare
from graphloom.operators.flatten import evidence_nodes, parsed
from graphloom.operators.orphans import triple_field
from graphloom.session import written

#: Columns that hold the truth of a question.
GOLD = {"answer", "ground_truth_answer", "gold_answer", "supporting_facts", "evidences", "gold_links", "missing_edges"}
#: Parts of keys whose values are secret.
SECRET = ("api_key", "authorization", "secret", "password", "token")


def public_view(questions: DataFrame) -> DataFrame:
    return questions.drop(*[c for c in questions.columns if c in GOLD])


def split_gold(questions: DataFrame, key: str, order: str, answers: str) -> tuple[DataFrame, DataFrame]:
    """(questions without gold columns, ``key, answer``): the row that comes last overrides earlier ones, several answers are joined."""
    told = F.array_join(F.filter(answers, lambda a: a.isNotNull()), " | ") if questions.schema[answers].dataType.typeName() == "array" else F.col(answers)
    gold = questions.groupBy(key).agg(F.max_by(told, order).alias("answer"))
    return public_view(questions.drop(answers)), gold


def refuse_gold(df: DataFrame) -> DataFrame:
    if found := sorted(GOLD & set(df.columns)):
        raise ValueError(f"gold columns in an inference input: {', '.join(found)}")
    return df


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s"{}\[\],:]+|\s+', re.S)


def blanked(text: str) -> str:
    """A JSON text with the value of every secret key replaced, at any depth; all else stays letter by letter.

    One walk over the tokens: only keys stand before a colon, and a value ends where its brackets close.
    """
    if not parsed(text)[1]:
        return text
    tokens = _TOKEN.findall(text)
    after = lambda n: next((m for m in range(n + 1, len(tokens)) if not tokens[m].isspace()), len(tokens))
    out, at = [], 0
    while at < len(tokens):
        colon = after(at) if tokens[at][0] == '"' else len(tokens)
        if colon < len(tokens) and tokens[colon] == ":" and any(s in json.loads(tokens[at]).lower() for s in SECRET):
            value = after(colon)
            out += [*tokens[at:value], '"[redacted]"']
            open_, at = 0, value
            while True:
                open_ += (tokens[at] in "{[") - (tokens[at] in "}]")
                at += 1
                if not open_:
                    break
        else:
            out.append(tokens[at])
            at += 1
    return "".join(out)


def _blank_batches(column: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pa.array([blanked(t) for t in batch.column(at).to_pylist()], pa.string()))

    return run


def scrub(df: DataFrame, column: str) -> DataFrame:
    """Rows with secret values blanked in a column of JSON texts; what is no JSON stays as it is.

    Only texts that spell a part of a secret key, escapes aside, leave the JVM.
    """
    doubtful = F.coalesce(F.lower(F.col(f"`{column}`")).rlike("|".join([*SECRET, r"\\u"])), F.lit(False))
    return df.where(~doubtful).unionByName(df.where(doubtful).mapInArrow(_blank_batches(column), df.schema))


ROW, KG, EVIDENCE = "triples_evidence/*", "triples_evidence/*/kg_triples/*", "triples_evidence/*/candidate_evidences/*"
FIELDS = {ROW: ["query_triple_index"], KG: ["kg_triple_id", "head_entity_id", "tail_entity_id", "relation"], EVIDENCE: ["title", "paragraph_idx", "sent_idx", "evidence", "context"]}


def _items(nodes: DataFrame, kind: str, depth: int) -> DataFrame:
    """One row per item of a list with its fields as text; ``is_object`` tells what the others are."""
    here = nodes.where(F.col("node_type").isin(kind, *[f"{kind}/{f}" for f in FIELDS[kind]]))
    fields = [F.max(F.when(F.col("node_type") == f"{kind}/{f}", F.col("value"))).alias(f) for f in FIELDS[kind]]
    numbers = [F.max(F.when((F.col("node_type") == f"{kind}/{f}") & (F.col("kind") == "number") & F.col("value").rlike(r"^-?\d+$"), F.col("value"))).try_cast("long").alias(f"{f}_int") for f in FIELDS[kind]]
    whole = F.max((F.col("node_type") == kind) & (F.col("kind") == "object")).alias("is_object")
    return here.groupBy(F.col("rec_key").alias("question_id"), F.substring_index("path", "/", depth).alias("path")).agg(whole, *fields, *numbers)


def _number(key: Column) -> Column:
    """The number of a bare key, which is its id without the namespace."""
    return F.regexp_extract(key, r"(\d+)$", 1).try_cast("long")


def phase2_issues(phase2: DataFrame, triples: DataFrame, entities: DataFrame, units: DataFrame) -> DataFrame:
    """Faults of evidence records against the tables they name: ``question_id, path, severity, message``.

    Ids of records carry no namespace, so ends agree by number; relations agree as bare text. The
    plan is not in the tables: a query index has to be below the number of the record's own triples.
    """
    types = [t for kind, fields in FIELDS.items() for t in (kind, *[f"{kind}/{f}" for f in fields])]
    nodes = written(evidence_nodes(phase2, types), "nodes")
    rows, kg, told = _items(nodes, ROW, 2), _items(nodes, KG, 4), _items(nodes, EVIDENCE, 4)
    issue = lambda df, severity, message: df.select("question_id", "path", F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))

    empty = phase2.select(F.col("id").alias("question_id")).distinct().join(rows.select("question_id").distinct(), "question_id", "left_anti").withColumn("path", F.lit("triples_evidence"))
    n = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_rows"))
    at = F.col("query_triple_index_int")
    rows = rows.join(n, "question_id").withColumn("in_range", F.coalesce((at >= 0) & (at < F.col("n_rows")), F.lit(False)))

    record = triples.select(F.col("upstream_index").cast("string").alias("kg_triple_id"), F.lit(True).alias("known"), _number(bare(triple_field("head_id"))).alias("head"), _number(bare(triple_field("tail_id"))).alias("tail"), bare(triple_field("relation")).alias("told_relation"))
    named = kg.where("is_object").join(record, "kg_triple_id", "left")
    found = named.where("known")
    differs = lambda item, held: item.isNotNull() & ~item.eqNullSafe(held)
    known = entities.select(F.col("upstream_id").cast("long").alias("number")).where("number is not null").distinct()
    ends = kg.where("is_object").select("question_id", "path", F.explode(F.array("head_entity_id_int", "tail_entity_id_int")).alias("number")).where("number is not null")

    # A fault of the index hides the evidences below, as their triple is not known.
    told = told.where("is_object").withColumn("row", F.substring_index("path", "/", 2)).join(rows.where("in_range").select("question_id", F.col("path").alias("row")), ["question_id", "row"])
    told = told.withColumn("quote", F.coalesce(F.nullif("evidence", F.lit("")), F.nullif("context", F.lit(""))))
    sentences = units.select("question_id", "doc_index", "sent_index", F.col("title").alias("unit_title"), "raw_text").distinct()
    agrees = lambda asked, held: asked.isNull() | F.coalesce(asked == held, F.lit(False))
    hit = agrees(F.col("paragraph_idx_int"), F.col("doc_index")) & agrees(F.col("sent_idx_int"), F.col("sent_index")) & agrees(F.nullif("title", F.lit("")), F.col("unit_title")) & (F.col("quote").isNull() | F.contains("raw_text", "quote"))
    located = told.join(sentences, "question_id").groupBy("question_id", "path", "sent_idx_int").agg(F.count_if(hit).alias("n_hits"))

    parts = [
        issue(empty, "hard", "no triples evidence"),
        issue(rows.where("not in_range"), "hard", "query index out of range"),
        issue(kg.where("not is_object"), "hard", "kg triple is not an object"),
        issue(named.where("known is null"), "hard", "kg triple id missing"),
        issue(found.where(differs(F.col("head_entity_id"), F.col("head").cast("string"))), "hard", "kg triple head mismatch"),
        issue(found.where(differs(F.col("tail_entity_id"), F.col("tail").cast("string"))), "hard", "kg triple tail mismatch"),
        issue(found.where(~bare(F.col("relation")).eqNullSafe(F.col("told_relation"))), "hard", "kg triple relation mismatch"),
        issue(ends.join(known, "number", "left_anti"), "hard", "kg entity id missing"),
        issue(located.where("sent_idx_int is not null and n_hits = 0"), "hard", "sentence index does not locate quote"),
        issue(located.where("sent_idx_int is null and n_hits = 0"), "soft", "quote unlocated"),
        issue(located.where("n_hits > 1"), "soft", "quote in multiple spans"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def audit_records(questions: DataFrame, issues: DataFrame) -> DataFrame:
    """``question_id, n_hard, n_soft, passed`` of every question: one passes without a hard issue (``question_id, severity``)."""
    of = lambda s: F.count_if(F.col("severity") == s)
    found = issues.groupBy("question_id").agg(of("hard").alias("n_hard"), of("soft").alias("n_soft"))
    rows = questions.select("question_id").distinct().join(found, "question_id", "left").fillna(0, ["n_hard", "n_soft"])
    return rows.withColumn("passed", F.col("n_hard") == 0)


def graph_hints(phase2: DataFrame) -> DataFrame:
    """Triples of the graph that a record names, each under its lasting id with its place among them; they are hints to
    look at, never bindings to accept. An item that is no object keeps no place."""
    nodes = evidence_nodes(phase2, [KG, *[f"{KG}/{f}" for f in FIELDS[KG]]])
    rows = _items(nodes, KG, 4).where("is_object")
    at = F.split("path", "/")
    order = Window.partitionBy("question_id").orderBy(at[1].cast("int"), at[3].cast("int"))
    return rows.withColumn("compact_index", F.row_number().over(order) - 1).select("question_id", "compact_index", "kg_triple_id", "head_entity_id", "tail_entity_id", "relation")
