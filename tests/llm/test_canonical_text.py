from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import canonical_text as C

ALPHABET = "abceopxyABсеорАВшДéë́​ ，ａＢ　 中ο"


@settings(max_examples=300)
@given(st.text(ALPHABET, max_size=8), st.text(ALPHABET, max_size=8))
def test_form_is_a_function_of_looks(a, b):
    assert C.skeleton(C.table_form(a)) == C.skeleton(a)
    assert (C.skeleton(a) == C.skeleton(b)) == (C.table_form(a) == C.table_form(b))
    assert C.table_form(C.table_form(a)) == C.table_form(a)


def test_trie_free_and_paid_edits():
    t = C.Trie()
    for w, n in (("Shipping", 3), ("Shopping", 9), ("café", 1)):
        t.add(w, n)
    assert t.find("Ｓｈ​іpping") == "Shipping" and t.find("café") == "café" and t.find("cafe") is None and t.find("shipping") is None
    assert t.find("cafe", 1) == "café" and t.find("Shpping", 1) == "Shopping" and t.find("Shippings", 1) == "Shipping" and t.find("", 1) is None


def _find(spark, quotes, units):
    q = spark.createDataFrame([("c", str(n), 0, u, x) for n, (u, x) in enumerate(quotes)], "quote_kind string, owner_key string, quote_pos int, unit_key string, quote string")
    u = spark.createDataFrame([("c", *x) for x in units], "quote_kind string, unit_key string, raw_text string")
    return {int(r.owner_key) for r in C.hidden_quotes(q, u).collect()}


def test_quotes(spark):
    text = "Die \u0422\u00fcr v\u043en Cafe\u0301 \uff2e\uff4f\u00a05, x\u2007y"
    units = [("u", text), ("u", text), ("v", None), ("w", "abc"), ("w", "\u0430b\u0441")]
    quotes = [
        ("u", "T\u00fcr von"), ("u", "\u0422\u00fcr v\u043en"), ("u", "t\u00fcr von"), ("u", "Cafe "), ("u", "Caf\u00e9 No"), ("u", "5, x y"), ("u", ""), ("u", None), ("u", "\u200b"),
        ("v", "x"), ("nowhere", "x"), ("w", "abc"), ("w", "\u200babc"), ("u", "\u00fcr v"), ("u", "u\u0308r v"),
    ]
    assert _find(spark, quotes, units) == {0, 4, 5, 12, 14}


def test_against_skeletons_on_tables(spark, small):
    from graphloom.llm.queries import _quotes, _units, p2_found

    units = {}
    for k, u, t in _units(spark, small).collect():
        units.setdefault((k, u), set()).add(t)
    want = set()
    for k, o, p, u, q in _quotes(spark, small).collect():
        texts = units.get((k, u), ())
        if q and not any(q in t for t in texts) and C.skeleton(q) and any(C.skeleton(q) in C.skeleton(t) for t in texts):
            want.add((k, o, p))
    assert {tuple(r) for r in p2_found(spark, small).collect()} == want and want


def test_forms_of_texts(spark):
    rows = [("Ｓｈіp",), ("Ship",), (None,), ("",), ("\u200b",), ("Совет сo",), ("Совет со",), ("Ship" * 5000 + " ｘ",), ("ﬁne \U0001d400b",)]
    got = {r.text: r.form for r in C.canonical_texts(spark.createDataFrame(rows, "text string")).collect()}
    assert got["Ｓｈіp"] == "Ship" and got[None] is None and got[""] == "" and got["\u200b"] == "" and got["ﬁne \U0001d400b"] == "fine Ab"
    assert got["Совет сo"] == got["Совет со"] == "Совет со" and got["Ship" * 5000 + " ｘ"] == "Ship" * 5000 + " x"
    assert C.canonical_texts(spark.createDataFrame([], "text string")).count() == 0


def test_the_corpus_chooses_the_spelling(spark):
    """By the table alone every one of these would be Latin."""
    cyrillic, latin, mixed = "\u0440\u043e\u0440", "pop", "\u0440o\u0440"
    assert {C.table_form(w) for w in (cyrillic, latin, mixed)} == {latin}
    form = lambda *texts: {r.text: r.form for r in C.canonical_texts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert form(cyrillic, cyrillic, latin, mixed) == dict.fromkeys([cyrillic, latin, mixed], cyrillic)
    assert form(cyrillic, latin, latin, mixed) == dict.fromkeys([cyrillic, latin, mixed], latin)
    assert form(mixed) == {mixed: latin}
    told = {r.token: r.known for r in C.token_forms(spark.createDataFrame([(cyrillic,), ("\u0455x",)], "text string").union(spark.createDataFrame([(mixed,)], "text string"))).collect()}
    assert told == {mixed: True, "\u0455x": False}


def test_new_look_alikes():
    same = [("νοte", "vote"), ("հello", "hello"), ("\U0001d5b2hip", "Ship"), ("ﬃ", "ffi"), ("ｶﾞ", "ガ")]
    assert all(C.skeleton(a) == C.skeleton(b) for a, b in same)
    assert C.skeleton("²") != C.skeleton("2") and C.skeleton("e\u0301") == C.skeleton("é") != C.skeleton("e")
