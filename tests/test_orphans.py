from datetime import datetime as D

from pyspark.sql import functions as F

from graphloom.operators import orphans as O


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


REF = "src_table string, src_key string, ref_field string, ref_pos int, target_table string, target_key string, as_of timestamp"
LIFE = "target_table string, target_key string, alive_from timestamp, alive_to timestamp"


def test_lives_decide(spark):
    lives = _rows(spark, [("e", "a", D(2024, 1, 1), D(2024, 2, 1)), ("e", "a", D(2024, 3, 1), None), ("e", "b", D(2024, 1, 5), None), ("e", "b", D(2024, 1, 5), None)], LIFE)
    times = {"before": D(2023, 12, 1), "start": D(2024, 1, 1), "end": D(2024, 2, 1), "gap": D(2024, 2, 15), "again": D(2024, 4, 1)}
    refs = [("t", k, "f", 0, "e", "a", v) for k, v in times.items()] + [("t", "null time", "f", 0, "e", "a", None), ("t", "none", "f", 0, "e", "zz", D(2025, 1, 1)), ("t", "other table", "f", 0, "x", "a", D(2025, 1, 1))]
    found = {r.src_key for r in O.direct_orphans(_rows(spark, refs + refs, REF), lives).collect()}
    assert found == {"before", "end", "gap", "null time", "none", "other table"}


def test_hot_target_is_salted_and_right(spark):
    refs = spark.range(3000).select(F.lit("t").alias("src_table"), F.col("id").cast("string").alias("src_key"), F.lit("f").alias("ref_field"), F.lit(0).alias("ref_pos"), F.lit("e").alias("target_table"), F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("target_key"), F.when(F.col("id") < 500, F.lit("2023-01-01")).otherwise(F.lit("2025-01-01")).cast("timestamp").alias("as_of"))
    lives = _rows(spark, [("e", "hot", D(2024, 1, 1), None)], LIFE)
    assert [r.target_key for r in O.hot_targets(refs).collect()] == ["hot"]
    assert O.direct_orphans(refs, lives).count() == 1500


def test_references_keep_places_and_skip_nulls(spark):
    df = _rows(spark, [("1", ["x", None, "y"], "h", D(2024, 1, 1)), ("2", None, None, None)], "k string, ids array<string>, head string, at timestamp")
    got = O.references(df, "s", F.col("k"), F.col("at"), {"ids": ("t", F.col("ids")), "head": ("e", F.col("head"))}).collect()
    assert {(r.ref_field, r.ref_pos, r.target_table, r.target_key) for r in got} == {("ids", 0, "t", "x"), ("ids", 2, "t", "y"), ("head", 0, "e", "h")}


def test_cascade_depths_and_cycles(spark):
    def ref(a, b, pos=0):
        return ("r", a, "f", pos, "r", b, D(2024, 1, 1))

    refs = _rows(spark, [ref("a", "missing"), ref("b", "a"), ref("c", "b"), ref("d", "c"), ref("c", "d", 1), ref("z", "z")], REF)
    lives = _rows(spark, [("r", k, D(2023, 1, 1), None) for k in "abcdz"], LIFE)
    told = O.orphan_cascade(refs, lives)
    assert {(r.src_key, r.target_key): r.depth for r in told.collect()} == {("a", "missing"): 0, ("b", "a"): 1, ("c", "b"): 2, ("d", "c"): 3, ("c", "d"): 4}
    assert {r.rec_key: r.depth for r in O.orphan_records(told).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_empty(spark):
    refs, lives = _rows(spark, [], REF), _rows(spark, [], LIFE)
    assert O.direct_orphans(refs, lives).count() == 0 and O.orphan_cascade(refs, lives).count() == 0


def test_raw_records(spark):
    rows = [("1", None, None, None, None, '{"h": "A:1", "relation": "r", "t": null, "tail_literal": "5"}'), ("2", "x", "y", "z", None, None), ("3", None, None, None, None, "no json")]
    df = _rows(spark, rows, "k string, head_id string, relation string, tail_id string, tail_literal string, raw_record string")
    got = {r.k: tuple(r)[1:] for r in df.select("k", *[O.triple_field(c).alias(c) for c in O.SPELLED]).collect()}
    assert got == {"1": ("A:1", "r", None, "5"), "2": ("x", "y", "z", None), "3": (None,) * 4}


def test_shared_folder_is_asked_for_on_several_hosts():
    from graphloom.session import one_process

    assert one_process("local") and one_process("local[8]") and one_process("local[*, 4]")
    assert not any(one_process(m) for m in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://host"))
