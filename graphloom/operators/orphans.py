"""References to records that do not exist, direct and inherited.

A reference is direct-orphaned if no life of its target covers the moment at which the
referring row was loaded. A record that holds such a reference is an orphan itself, and
records that refer to it inherit the fault: the cascade follows the foreign keys downward,
one semi-join per step, until a step finds nothing new.

Plan: references are read once and written, as short rows that every step reads. Lives are reduced to one
interval per target and end before the shuffle; references and lives meet in one anti-join on the target. A key that holds a large part of all
references is spread over ``HOT_SALT`` parts and its few lives are repeated for each, so no
task holds all of them. Which keys are hot comes from an exact count with map-side
combining; at most ``1 / HOT_SHARE`` keys can be hot, which bounds what is broadcast.

Edge cases: a null target is no reference. A blank target is one, and an orphan unless a
record has the blank id. A referring row without a time sees no record, so its references
are orphans. A life without a start covers nothing. Empty tables give empty results.
Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import bare
from graphloom.session import written

HOT_SHARE = 1 / 64
HOT_SALT = 32

REFERENCE = ["src_table", "src_key", "ref_field", "ref_pos", "target_table", "target_key", "as_of"]
LIFE = ["target_table", "target_key", "alive_from", "alive_to"]


def references(
    df: DataFrame, src_table: str, src_key: Column, as_of: Column, fields: dict[str, tuple[str, Column]]
) -> DataFrame:
    """One row per reference. ``fields`` maps a field to its target table and column; an array
    column gives one reference per element that is not null, placed from 0."""
    kind = "array<struct<ref_field:string,ref_pos:int,target_table:string,target_key:string>>"

    def placed(field: str, target: str, column: Column) -> Column:
        if df.select(column.alias("c")).schema["c"].dataType.typeName() != "array":
            column = F.array(column)
        found = F.transform(column, lambda x, i: F.struct(F.lit(field), i.cast("int"), F.lit(target), x.cast("string")))
        return F.coalesce(found.cast(kind), F.array().cast(kind))

    parts = [placed(field, target, column) for field, (target, column) in fields.items()]
    every = F.filter(F.concat(*parts), lambda r: r["target_key"].isNotNull())
    rows = df.select(F.lit(src_table).alias("src_table"), src_key.cast("string").alias("src_key"), as_of.alias("as_of"), F.explode(every).alias("r"))
    return rows.select("src_table", "src_key", "r.*", "as_of").select(*REFERENCE)


def lives(df: DataFrame, target_table: str, key: Column, alive_from: Column, alive_to: Column) -> DataFrame:
    return df.select(F.lit(target_table).alias("target_table"), key.cast("string").alias("target_key"), alive_from.alias("alive_from"), alive_to.alias("alive_to"))


def hot_targets(refs: DataFrame) -> DataFrame:
    """Targets that hold more than HOT_SHARE of all references: at most 1 / HOT_SHARE rows."""
    counts = refs.groupBy("target_table", "target_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > counts.agg(F.sum("n")).scalar() * F.lit(HOT_SHARE)).select("target_table", "target_key")


def direct_orphans(refs: DataFrame, life_rows: DataFrame) -> DataFrame:
    """The references (columns ``REFERENCE``) whose target does not live at ``as_of``."""
    # Of the lives with one end, the earliest start covers all others.
    spans = life_rows.groupBy("target_table", "target_key", "alive_to").agg(F.min("alive_from").alias("alive_from"))
    hot = F.broadcast(hot_targets(refs)).withColumn("hot", F.lit(True))
    salt = F.pmod(F.xxhash64("src_table", "src_key"), F.lit(HOT_SALT)).cast("int")
    keyed = refs.join(hot, ["target_table", "target_key"], "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0))
    spread = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_SALT - 1))).otherwise(F.array(F.lit(0)))
    covering = spans.join(hot, ["target_table", "target_key"], "left").withColumn("salt", F.explode(spread))
    r, s = keyed.alias("r"), covering.alias("s")
    alive = (F.col("s.alive_from") <= F.col("r.as_of")) & (F.col("s.alive_to").isNull() | (F.col("s.alive_to") > F.col("r.as_of")))
    same = (F.col("r.target_table") == F.col("s.target_table")) & (F.col("r.target_key") == F.col("s.target_key")) & (F.col("r.salt") == F.col("s.salt"))
    return r.join(s, same & alive, "left_anti").select(*REFERENCE).dropDuplicates(["src_table", "src_key", "ref_field", "ref_pos"])


def orphan_cascade(refs: DataFrame, life_rows: DataFrame) -> DataFrame:
    """References to records that do not exist or are orphaned themselves: columns ``REFERENCE`` and ``depth``.

    Depth 0 is direct: no life of the target covers the reference. Depth n is inherited: the target is a record that
    holds a reference of depth n - 1, and none of less. Every reference comes out once, so cycles end.
    """
    key = ["src_table", "src_key", "ref_field", "ref_pos"]
    refs = written(refs, "references")
    frontier = written(direct_orphans(refs, life_rows).withColumn("depth", F.lit(0)), "orphans")
    found, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        records = frontier.select(F.col("src_table").alias("target_table"), F.col("src_key").alias("target_key")).distinct()
        step = refs.join(records, ["target_table", "target_key"], "left_semi").join(found.select(*key), key, "left_anti")
        frontier = written(step.select(*REFERENCE, F.lit(depth).alias("depth")).dropDuplicates(key), "orphans")
        found = found.unionByName(frontier)
    return found


def orphan_records(cascade: DataFrame) -> DataFrame:
    """``rec_table, rec_key, depth, as_of`` of every record with such a reference: its least depth, and when it was loaded."""
    of = cascade.groupBy(F.col("src_table").alias("rec_table"), F.col("src_key").alias("rec_key"))
    return of.agg(F.min("depth").alias("depth"), F.min("as_of").alias("as_of"))


RAW_FIELDS = "h string, head string, r string, relation string, t string, tail string, tail_literal string"
SPELLED = {"head_id": ("h", "head"), "relation": ("r", "relation"), "tail_id": ("t", "tail"), "tail_literal": ("tail_literal",)}


def triple_field(name: str) -> Column:
    """A triple's head_id, relation, tail_id or tail_literal, read from the unparsed JSON line where
    the row has one. A line that is no valid JSON object has nulls."""
    line = F.from_json("raw_record", RAW_FIELDS)
    return F.when(F.col("raw_record").isNull(), F.col(name)).otherwise(F.coalesce(*[line[n] for n in SPELLED[name]]))


def graph_references(triples: DataFrame, title_triples: DataFrame) -> DataFrame:
    of_triples = references(triples, "triples", F.col("triple_id"), F.col("loaded_at"), {c: ("entities", bare(triple_field(c))) for c in ("head_id", "tail_id")})
    of_titles = references(title_triples, "title_triples", F.col("map_row"), F.col("loaded_at"), {"triple_ids": ("triples", F.col("triple_ids"))})
    return of_triples.unionByName(of_titles)


def graph_lives(entities: DataFrame, core_entities: DataFrame, triples: DataFrame) -> DataFrame:
    both = entities.select("entity_id", "loaded_at", "deleted_at").unionByName(core_entities.select("entity_id", "loaded_at", "deleted_at"))
    return lives(both, "entities", bare(F.col("entity_id")), F.col("loaded_at"), F.col("deleted_at")).unionByName(lives(triples, "triples", F.col("triple_id"), F.col("loaded_at"), F.col("deleted_at")))
