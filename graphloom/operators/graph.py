"""Graph access: names, edges, masks, links and greedy choice, as joins and aggregates.

Orders inside a group are never made by sorting the group: the first edge of a side comes from
``min_by``, which combines on the map side, so a head that holds a large part of all edges costs
one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import bare, norm_name
from graphloom.operators.orphans import triple_field


def entity_table(*tables: DataFrame) -> DataFrame:
    """Distinct entities of all tables; re-delivered rows and lives count once."""
    parts = [t.select("entity_id", "canonical_name", "aliases", "entity_type") for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def entity_names(entities: DataFrame) -> DataFrame:
    """``entity_id, name, norm`` for the canonical name and every alias that is not blank."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("entity_id", F.explode(names).alias("name")).withColumn("norm", norm_name(F.col("name")))
    return rows.where("norm <> ''").distinct()


def edge_table(triples: DataFrame) -> DataFrame:
    """Triples with their fields read from either form, ids as bare keys, relations normalised."""
    return triples.select(
        "triple_id", "upstream_index", "active", "sources", "title",
        bare(triple_field("head_id")).alias("head_key"), norm_name(triple_field("relation")).alias("relation"),
        bare(triple_field("tail_id")).alias("tail_key"), triple_field("tail_literal").alias("tail_literal"),
    )


def side(edges: DataFrame, key: str) -> DataFrame:
    """Active edges of each end: their number, the first and the last by place."""
    return edges.where(F.col("active") & F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_edges"), F.min("upstream_index").alias("first_index"), F.max("upstream_index").alias("last_index"))


def mask(edges: DataFrame, masked: DataFrame, key: str = "triple_id") -> DataFrame:
    """Edges with those of the mask inactive; ids never renumber."""
    m = masked.select(key).distinct().withColumn("_masked", F.lit(True))
    return edges.join(m, key, "left").withColumn("active", F.col("active") & F.col("_masked").isNull()).drop("_masked")


def first_accepted(edges: DataFrame, group: list[str], order: Column, accepted: Column, carry: list[str]) -> DataFrame:
    """Walks each group in order up to the first accepted edge: its columns and how many were rejected before."""
    best = edges.where(accepted).groupBy(*group).agg(F.min(F.struct(order.alias("ord"), *carry)).alias("b"))
    best = best.select(*group, *[F.col(f"b.{c}").alias(c) for c in carry], F.col("b.ord").alias("first_ord"))
    before = edges.select(*group, order.alias("ord")).join(best.select(*group, "first_ord"), group).where("ord < first_ord").groupBy(*group).agg(F.count(F.lit(1)).alias("n_rejected"))
    return best.join(before, group, "left").withColumn("n_rejected", F.coalesce("n_rejected", F.lit(0)).cast("long"))


def link_surfaces(surfaces: DataFrame, names: DataFrame) -> DataFrame:
    """``surface, n_matches, entity_id, reason`` of every distinct surface: linked only if one entity has the name."""
    s = surfaces.select("surface").where("surface is not null").distinct().withColumn("norm", norm_name(F.col("surface")))
    hits = s.join(names, "norm", "left").groupBy("surface").agg(F.countDistinct("entity_id").alias("n_matches"), F.min("entity_id").alias("one"), F.coalesce(F.max(F.col("name") == F.col("surface")), F.lit(False)).alias("exact"))
    reason = F.when(F.col("n_matches") == 0, "UNLINKABLE").when(F.col("n_matches") > 1, "AMBIGUOUS_ENTITY").when(F.col("exact"), "EXACT_NAME").otherwise("ALIAS_UNIQUE")
    return hits.select("surface", "n_matches", F.when(F.col("n_matches") == 1, F.col("one")).alias("entity_id"), reason.alias("reason"))


def fingerprint(*tables: DataFrame) -> DataFrame:
    """One checksum of tables of texts that does not depend on the order of rows and needs no gathering: the four words of
    every row's SHA-256, each summed over all rows. ``tables`` hold one column ``line``; repeated rows count."""
    lines = tables[0]
    for t in tables[1:]:
        lines = lines.unionByName(t)
    digest = F.sha2("line", 256)
    words = [F.conv(F.substring(digest, 1 + 16 * n, 16), 16, 10).cast("decimal(20,0)").alias(f"w{n}") for n in range(4)]
    sums = [F.coalesce(F.sum(f"w{n}"), F.lit(0)).cast("string") for n in range(4)]
    return lines.select(*words).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *sums).alias("checksum"))


def graph_lines(entities: DataFrame, triples: DataFrame, title_triples: DataFrame) -> list[DataFrame]:
    """What identifies a graph: names of its entities, its triples with their mask, its title map; no sources, no types."""
    text = lambda *columns: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]).alias("line")
    names = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.coalesce(x, F.lit("~"))))
    held = entities.select("entity_id", "canonical_name", F.when(F.col("aliases").isNotNull(), names("aliases")).alias("aliases")).distinct()
    return [
        held.select(text(F.lit("entity"), F.col("entity_id"), F.col("canonical_name"), F.col("aliases"))),
        triples.select(text(F.lit("triple"), *[F.col(c) for c in ("triple_id", "upstream_index", "head_id", "relation", "tail_id", "tail_literal", "raw_record", "active")])),
        title_triples.select(text(F.lit("title"), F.col("map_row"), F.col("title"), F.when(F.col("triple_ids").isNotNull(), names("triple_ids")))),
    ]
