import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions.text import bare
from graphloom.llm import dedupe, mixing, quality


def test_copies(spark):
    rows = [(5, "A:1", None), (1, "a 1", None), (2, "a1", ""), (3, None, None), (4, None, None), (6, "A:1", None), (7, "", "x"), (8, "--", "x"), (9, None, "x")]
    df = spark.createDataFrame(rows, "i long, h string, t string")
    form = {"h_": bare(F.col("h")), "t_": F.col("t")}
    assert {tuple(r) for r in dedupe.copies(df, ["h", "t"], form, "i").collect()} == {(1, 5), (1, 6), (3, 4), (7, 8)}
    groups = dedupe.canonical_groups(dedupe.raw_groups(df, ["h", "t"], "i"), form).collect()
    assert {r.keep_index: (r.n_copies, r.n_spellings) for r in groups} == {1: (3, 2), 2: (1, 1), 3: (2, 1), 7: (2, 2), 9: (1, 1)}
    assert dedupe.copies(df.limit(0), ["h", "t"], form, "i").count() == 0


def test_one_group_of_a_third(spark):
    df = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") < 1000, F.concat(F.lit("x"), F.repeat(F.lit("."), (F.col("id") % 50).cast("int")))).otherwise(F.col("id").cast("string")).alias("h"))
    got = dedupe.copies(df, ["h"], {"h_": bare(F.col("h"))}, "i")
    assert got.count() == 999 and got.where("keep_index <> 0").count() == 0


def _mix(spark, sizes, targets, **more):
    s = spark.createDataFrame(sizes, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    docs, report = mixing.mix(s, t, **more)
    return docs.collect(), {r.source: r for r in report.collect()}


def test_mix_reaches_shares_and_caps(spark):
    sizes = [(n, "big", 10 + n % 7) for n in range(3000)] + [(5000 + n, "small", 20) for n in range(30)] + [(9000, None, 50), (9001, "untargeted", 50), (9002, "big", 0)]
    docs, report = _mix(spark, sizes, [("big", 0.5, 1), ("small", 0.4, 4), ("absent", 0.1, 9), ("zero", 0.0, 1)])
    assert abs(report["big"].reached_share - 5 / 9) < 0.005 and abs(report["small"].reached_share - 4 / 9) < 0.005
    assert report["small"].most_copies == 4 and report["absent"].used_tokens == 0 and {r.source for r in docs} == {"big", "small"}
    assert sum(r.n_tokens * r.copies for r in docs) == sum(r.used_tokens for r in report.values())
    again, _ = _mix(spark, sizes[::-1], [("big", 0.5, 1), ("small", 0.4, 4), ("absent", 0.1, 9)])
    assert {tuple(r) for r in again} == {tuple(r) for r in docs}
    other, _ = _mix(spark, sizes, [("big", 0.5, 1), ("small", 0.4, 4)], seed=3)
    assert {tuple(r) for r in other} != {tuple(r) for r in docs}


def test_mix_fraction_and_size_power(spark):
    sizes = [(n, "a", 10) for n in range(1000)] + [(2000 + n, "b", 10 if n % 2 else 30) for n in range(500)]
    docs, report = _mix(spark, sizes, [("a", 0.5, 3), ("b", 0.5, 2)], total=15_000.0, size_power=1.0)
    assert abs(report["a"].used_tokens - 7500) <= 10 and abs(report["b"].used_tokens - 7500) <= 30
    large = sum(r.n_tokens == 30 for r in docs if r.source == "b")
    assert large > 0.6 * sum(r.source == "b" for r in docs)


def test_probabilities_add_up_to_the_size_with_certain_documents(spark):
    """A few documents so large that their share of the sample would exceed one."""
    sizes = spark.createDataFrame([(n, "s", 10_000 if n < 3 else 10 + n % 5, 40_000.0) for n in range(3000)], "doc_id long, source string, n_tokens long, need double")
    got = mixing.inclusion(sizes, 1.0).first()
    p = [1.0 if n > got.sure_above else got.factor * n for n in (r.n_tokens for r in sizes.collect())]
    assert got.sure_above == 14 and max(p) <= 1 and abs(sum(x * r.n_tokens for x, r in zip(p, sizes.collect())) - 40_000) < 1e-3
    docs, report = _mix(spark, [(r.doc_id, r.source, r.n_tokens) for r in sizes.collect()], [("s", 1.0, 1)], total=40_000.0)
    assert {0, 1, 2} <= {r.doc_id for r in docs} and abs(report["s"].used_tokens - 40_000) <= 14


def test_probabilities_differ_within_a_source(spark):
    sizes = [(n, "s", 10 if n % 2 else 30) for n in range(4000)]
    share = lambda docs: sum(r.n_tokens == 30 for r in docs) / len(docs)
    even, larger = _mix(spark, sizes, [("s", 1.0, 1)], total=20_000.0, size_power=0.0)[0], _mix(spark, sizes, [("s", 1.0, 1)], total=20_000.0)[0]
    assert abs(share(even) - 0.5) < 0.05 and abs(share(larger) - 0.75) < 0.05


def test_mix_nothing(spark):
    docs, report = _mix(spark, [], [("a", 1.0, 1)])
    assert docs == [] and report["a"].used_tokens == 0 and report["a"].reached_share == 0


def test_kinds_of_edge_texts(spark):
    prose = "It took me nine years to find you. Where is the letter?\n- Is this it? - No, it is not."
    rows = [(1, None), (2, ""), (3, " \n　"), (4, prose), (4, prose), (5, prose * 3000), (6, "1\n00:00:01,000 --> 00:00:02,000\n"), (7, "a;b;c\n1;2;3\n4;5;n/a"), (8, "• one box\n• Two Hats\n• the keys, 5"), (9, "dead " * 40), (10, "[music]")]
    df = spark.createDataFrame([(a, t, "x") for a, t in rows], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in quality.text_quality(df, keep=["doc_id"]).collect()}
    assert {k: r.kind for k, r in got.items()} == {1: None, 2: None, 3: None, 4: "prose", 5: "prose", 6: "prose", 7: "table", 8: "list", 9: "junk", 10: "prose"}
    assert got[6].n_words == 0 and got[1].n_words is None and got[4].profile_lang == "en" and got[4].stop_line_share == 1.0
    assert quality.text_quality(df.limit(0)).count() == 0


def test_wrong_encodings_are_read_again():
    for name in ("cp1251", "utf-8"):
        raw = "Дай мне лампу, пожалуйста.".encode(name)
        seen = raw.decode("latin-1" if name == "utf-8" else "cp1252")
        assert quality.repaired(seen) == "Дай мне лампу, пожалуйста."
    assert quality.repaired("Où est la clé ?") == "Où est la clé ?"


@pytest.mark.parametrize("d", ["/root/testdata/check_l", "/root/testdata/check_s"])
def test_labels_that_no_fit_has_seen(spark, d):
    """The profiles come from the labels of sf0.1; these tables hold other rows."""
    if not os.path.exists(d):
        pytest.skip("no such tables")
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/doc_labels.parquet").select("doc_id", F.col("kind").alias("label")), "doc_id")
    got = quality.text_quality(rows.select("doc_id", "text", "label"), keep=["label"]).select("label", "kind").where("kind is not null").collect()
    assert sum(r.kind == r.label for r in got) >= 0.99 * len(got) > 0


def test_profiles_are_those_of_the_fit(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_labels.parquet")
    held = docs.join(labels.select("doc_id", F.col("kind").alias("label")), "doc_id").where("trim(text) <> ''").orderBy("doc_id").collect()
    made = quality.fit([r.text for r in held], [r.label for r in held])
    own = quality.own_profiles()
    assert made.kinds == own.kinds and abs(made.lines - own.lines).max() < 1e-3 and abs(made.documents - own.documents).max() < 1e-3
    few = quality.fit_profiles(docs, labels, most=100)
    assert set(few.kinds) <= set(quality.KINDS) and len(few.lines) == len(few.speaks)


def test_kinds_follow_the_divergence(monkeypatch):
    texts = ["It took me nine years to find you.\nWhere is the letter?", "• one box\n• Two Hats\n• the keys, 5", "a;b;c\n1;2;3\n4;5;n/a"]
    assert quality.measure(texts)["kind"] == ["prose", "list", "table"]
    profiles = quality.own_profiles()
    turned = quality.Profiles(profiles.lines[::-1], profiles.speaks, profiles.documents, profiles.kinds)
    assert quality.measure(texts, turned)["kind"] != ["prose", "list", "table"]


@given(st.lists(st.lists(st.integers(0, 5), min_size=4, max_size=4).filter(any), min_size=1, max_size=5))
def test_divergence_equals_its_definition(rows):
    m = quality._shares(np.array(rows, np.float64))
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda p, q: np.where(p > 0, p * np.log2(p / q), 0).sum()
        want = [[(kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2 for q in m] for p in m]
    assert np.allclose(quality.divergence(m, m), want, atol=1e-9)


def test_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Is it?\n\n- no, 5\n"), (4, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.text_counts(df).collect()}
    assert got == {1: (None,) * 6, 2: (0, 0, None, None, None, None), 3: (3, 2, 2.0, 0.333333, 0.5, 1.0), 4: (1, 1, 100000.0, 0.0, 0.0, 0.0)}
