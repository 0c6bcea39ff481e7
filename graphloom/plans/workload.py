"""The sales tables as a graph with missing edges and the sentences that still tell them.

A question asks for the region of a customer's nation. Customers with a negative balance lack their ``located in``
edge. What the sentence about a customer says depends on the market segment, so every outcome of verification
occurs, for edges (whose source it is) and for texts alike. That a nation lies in its region is an edge, and a hidden
sentence of each question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import norm_name
from graphloom.operators.closure import CONSTRAINT, constraint_rows
from graphloom.plans.compiler import compile_plan
from graphloom.session import table

CUE, NEXT = "located in", "in region"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, name, nation, region, masked`` and the claim read from text: quote, ends, span."""
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select("c_custkey", "c_nationkey", "n_regionkey", F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "c_mktsegment", (F.col("c_acctbal") < 0).alias("masked"))
    seg = F.col("c_mktsegment")
    quote = (
        F.when(seg == "AUTOMOBILE", F.concat("name", F.lit(" is not located in "), "nation", F.lit(".")))
        .when(seg == "FURNITURE", F.concat("name", F.lit(" and "), "nation", F.lit(" are listed.")))
        .when(seg == "MACHINERY", F.concat("name", F.lit(" is located in "), "nation", F.lit("(访问学者).")))
        .otherwise(F.concat("name", F.lit(" is located in "), "nation", F.lit(".")))
    )
    head = F.when(seg == "HOUSEHOLD", F.col("nation")).otherwise(F.col("name"))
    tail = F.when(seg == "HOUSEHOLD", F.col("name")).otherwise(F.col("nation"))
    return rows.select("*", quote.alias("quote"), head.alias("head_surface"), tail.alias("tail_surface"), F.lit(0).alias("char_start"), F.length(quote).alias("char_end"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """constraints, names, edges, units and candidates of every customer's question, and the plan of each."""
    c = customers(spark, sf_dir).withColumns({"question_id": F.col("c_custkey").cast("string"), "onward": F.concat("nation", F.lit(f" lies {NEXT} "), "region", F.lit("."))})
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    plan = compile_plan([{"head": "customer", "relation": CUE, "tail": "?nation"}, {"head": "?nation", "relation": NEXT, "tail": "?region"}])
    fields = [x.split()[0] for x in CONSTRAINT.split(", ")][1:]
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    patterns = F.explode(F.array(*[F.struct(*[lit(v).alias(k) for k, v in zip(fields, row[1:])]) for row in constraint_rows("any", plan)])).alias("p")
    constraints = c.select("question_id", "name", patterns).select("question_id", "name", "p.*").withColumn("head", F.when(F.col("head_kind") == "entity", F.col("name")).otherwise(F.col("head"))).drop("name")
    key = lambda kind, k: F.concat(F.lit(f"{kind}:"), k)
    named = lambda df, kind, k, name: df.select(key(kind, k).alias("entity_id"), F.col(name).alias("name"), norm_name(F.col(name)).alias("norm"), F.col(name).alias("canonical"))
    names = named(c, "C", F.col("c_custkey"), "name").unionByName(named(n, "N", F.col("n_nationkey"), "n_name")).unionByName(named(r, "R", F.col("r_regionkey"), "r_name"))
    nil = F.lit(None).cast("string").alias("tail_literal")
    first = c.where("not masked").select(
        key("c", F.col("c_custkey")).alias("triple_id"), F.col("c_custkey").cast("long").alias("ord"), key("C", F.col("c_custkey")).alias("head_id"), key("N", F.col("c_nationkey")).alias("tail_id"), nil, F.lit(CUE).alias("relation"),
        F.lit(True).alias("active"), F.col("quote").alias("quotes"), F.lit(True).alias("located"), F.col("name").alias("head_name"), F.col("nation").alias("tail_name"), "quote", F.lit(0).alias("sent_index"),
    )
    onward = F.concat("n_name", F.lit(f" lies {NEXT} "), "r_name", F.lit("."))
    second = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        key("n", F.col("n_nationkey")).alias("triple_id"), F.col("n_nationkey").cast("long").alias("ord"), key("N", F.col("n_nationkey")).alias("head_id"), key("R", F.col("r_regionkey")).alias("tail_id"), nil, F.lit(NEXT).alias("relation"),
        F.lit(True).alias("active"), onward.alias("quotes"), F.lit(True).alias("located"), F.col("n_name").alias("head_name"), F.col("r_name").alias("tail_name"), onward.alias("quote"), F.lit(0).alias("sent_index"),
    )
    unit = lambda no, visible, text: c.select("question_id", F.concat_ws("/", "question_id", F.lit(no)).alias("passage_id"), F.lit(no).alias("doc_index"), F.lit(0).alias("sent_index"), F.lit(visible).alias("visible"), F.col(text).alias("raw_text"))
    read = lambda cid, no, head, relation, tail, quote: c.select("question_id", F.lit(cid).alias("cid"), F.lit(no).alias("pos"), F.concat_ws("/", "question_id", F.lit(no)).alias("passage_id"), F.col(head).alias("head_surface"), F.lit(relation).alias("predicate"), F.col(tail).alias("tail_surface"), F.lit(0).alias("char_start"), F.length(quote).alias("char_end"), F.col(quote).alias("quote"))
    return {
        "constraints": constraints.select(*[x.split()[0] for x in CONSTRAINT.split(", ")]), "names": names, "edges": first.unionByName(second), "units": unit(0, True, "quote").unionByName(unit(1, False, "onward")),
        "candidates": read("c0", 0, "head_surface", CUE, "tail_surface", "quote").unionByName(read("c1", 1, "nation", NEXT, "region", "onward")),
        "plans": c.select("question_id", F.lit(plan.answer).alias("answer"), F.lit(None).cast("string").alias("reason")),
        "gold": c.select(
            "question_id", F.col("c_mktsegment").alias("group"), F.col("region").alias("answer"), F.struct(F.col("name").alias("head"), F.lit(CUE).alias("relation"), F.col("nation").alias("tail")).alias("bridge"),
            F.struct(F.col("nation").alias("head"), F.lit(NEXT).alias("relation"), F.col("region").alias("tail")).alias("successor"), F.array("quote").alias("support_quotes"), F.array(key("n", F.col("c_nationkey"))).alias("support_triple_ids"),
        ),
    }
