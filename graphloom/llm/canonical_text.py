"""One form for text that looks the same: full-width forms, combining accents, zero-width and
unusual blanks, look-alike letters of other scripts.

Method: every token of the corpus is looked up in tries of the corpus' clean spellings by a weighted
edit automaton. Ignorable characters and look-alike letters cost nothing, any other edit costs 1; with
the budget of 0 a token reaches the spellings that look the same, or none: another letter or a missing
accent looks different. A clean spelling is composed, of one script and without ignorables or wide
forms. Of the clean spellings that look the same, the one that the corpus uses most is canonical (of
equals the first in order), for the others as well: a word that Russian texts spell in Cyrillic letters stays
Cyrillic, whatever a single text did to it. Tokens that reach no spelling are normalised by table.

All tokens that look the same take one form: they reach the same spellings, or the table maps their looks.

Plan: tokens are cut and counted in the JVM with map-side combining; distinct tokens are laid out by the
first letters and length of their bare looks, which free edits never change, and sorted, so a task
walks one small trie after the other and holds no more than the tokens of one such key. Only tokens
that change come back. A quote and its unit meet once, suspects are written under a number, and from there
on only that number and tokens are shuffled. No vocabulary is broadcast or collected.

Edge cases: a null text has a null form, an empty one the empty form. A text of ignorable
characters has the empty form. Blanks are not merged: two blanks look different from one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import written

#: Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝүѵАВЕЅІЈКМНОРСТХУԚԜҮѴ", "aeopcyxsijhdqwyvABESIJKMHOPCTXYQWYV"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳανρυ", "ABEZHIKMNOPTYXocjavpu"))
OTHERS = dict(zip("օսոհզցյՕՏՍԼɑɡ", "ounhqgjOSULag"))
LOOK_ALIKES = CYRILLIC | GREEK | OTHERS
#: Characters that leave no mark.
IGNORABLES = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Blanks other than the common one, line ends not among them.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"
#: Alphabets whose letters have look-alikes, with marks and ignorables: the letters of a token.
ALPHABETS = ("Latin", "Cyrillic", "Greek", "Armenian")
_BLOCKS = r"\p{M}\p{Cf}\x{115F}\x{1160}\x{2100}-\x{214F}\x{1D400}-\x{1D7FF}\x{FB00}-\x{FB06}"
LETTERS = "".join(rf"\p{{Is{a}}}" for a in ALPHABETS) + _BLOCKS


def _variants() -> dict[str, str]:
    """Wide, narrow and styled characters and ligatures by the plain ones they are drawn as."""
    told = {}
    for n in [*range(0x2100, 0x2150), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)]:
        kind, _, _ = unicodedata.decomposition(chr(n)).partition(" ")
        if kind in ("<wide>", "<narrow>", "<font>") or 0xFB00 <= n < 0xFB07:
            told[chr(n)] = unicodedata.normalize("NFKC", chr(n))
    return told


_VARIANTS = _variants()
_FOLD = {ord(c): "" for c in IGNORABLES} | {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in HYPHENS} | {ord(a): b for a, b in _VARIANTS.items()}
_LOOKS = {ord(a): b for a, b in LOOK_ALIKES.items()}
_TO_CYRILLIC = {ord(b): a for a, b in reversed(CYRILLIC.items())}


def skeleton(text: str) -> str:
    """The looks of a text: two texts look the same if their skeletons are equal."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(_FOLD)).translate(_LOOKS))


def table_form(token: str) -> str:
    """The token in the letters of one script: a function of its skeleton alone."""
    looks = unicodedata.normalize("NFD", skeleton(token))
    latin = any(c.isalpha() and c.isascii() and ord(c) not in _TO_CYRILLIC for c in looks)
    cyrillic = any("Ѐ" <= c <= "ԯ" for c in looks)
    return unicodedata.normalize("NFC", looks.translate(_TO_CYRILLIC) if cyrillic and not latin else looks)


@lru_cache(maxsize=10_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "NONE").split(" ")[0] if unicodedata.category(c)[0] == "L" else ""


def clean(token: str) -> bool:
    """A spelling as a careful writer leaves it: composed, of one script, nothing folded away."""
    return token.isascii() or token.translate(_FOLD) == token and unicodedata.is_normalized("NFC", token) and len({_script(c) for c in token} - {""}) < 2


@lru_cache(maxsize=200_000)
def _units(token: str) -> tuple[str, ...]:
    """Letters with their marks, in looks."""
    out: list[str] = []
    for c in unicodedata.normalize("NFD", token.translate(_FOLD)).translate(_LOOKS):
        if out and unicodedata.combining(c):
            out[-1] += c
        else:
            out.append(c)
    return tuple(out)


class Trie:
    """Clean spellings by the looks of their letters."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for unit in _units(word):
            node = node.setdefault(unit, {})
        node.setdefault("", []).append((-count, word))

    def find(self, token: str, budget: int = 0) -> str | None:
        """The nearest spelling within the budget: least cost, most frequent, first in order.

        The automaton's state at a trie node is the least cost of each number of units read.
        """
        units = _units(token)
        best: tuple | None = None
        stack = [(self.root, {n: n for n in range(min(budget, len(units)) + 1)})]
        while stack:
            node, costs = stack.pop()
            if "" in node and len(units) in costs:
                found = (costs[len(units)], *min(node[""]))
                best = found if best is None or found < best else best
            inner = node.items() if budget else [(u, node[u]) for u in {units[n] for n in costs if n < len(units)} if u in node]
            for unit, child in inner:
                if unit == "":
                    continue
                now: dict[int, int] = {}
                for n, cost in costs.items():
                    steps = [(n, cost + 1)]
                    if n < len(units):
                        steps.append((n + 1, cost + (units[n] != unit)))
                    for at, c in steps:
                        while c <= budget and c < now.get(at, budget + 1):
                            now[at] = c
                            at, c = at + 1, c + 1
                            if at > len(units):
                                break
                if now:
                    stack.append((child, now))
        return best[2] if best else None


def tokens(text: Column) -> Column:
    """The text cut into runs of letters of alphabets and what lies between; put together again they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)[{LETTERS}]+|[^{LETTERS}]+"), F.lit(0))


def _unusual(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7eÀ-ɏ]")


#: Letters that some other alphabet has as well; a spelling of these alone may stand for another one.
_SHARED = "".join(sorted(set(LOOK_ALIKES.values())))


def _open(token: Column) -> Column:
    """Tokens whose form may differ from themselves."""
    return _unusual(token) | token.rlike(f"^[{_SHARED}\\u00c0-\\u024f]+$")


def _bare_looks(token: Column) -> Column:
    """Looks without marks: free edits never change it, so it can choose the trie."""
    marked = {}
    for n in [*range(0xC0, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(n))
        if len(d) > 1 and not unicodedata.combining(d[0]):
            marked[chr(n)] = LOOK_ALIKES.get(d[0], d[0])
    one = {a: LOOK_ALIKES.get(b, b) for a, b in ((chr(n), b) for n, b in _FOLD.items()) if len(b) == 1}
    table = LOOK_ALIKES | marked | one
    drop = "".join(chr(n) for n, b in _FOLD.items() if not b)
    out = F.regexp_replace(token, r"\p{M}", "")
    for n, b in _FOLD.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(chr(n)), F.lit(b))
    return F.translate(out, "".join(table) + drop, "".join(table.values()))


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms of the tokens of one key after the other; the rows come sorted by key."""
    key, held = None, []

    def forms() -> pa.RecordBatch:
        trie = Trie()
        for token, n in held:
            if clean(token):
                trie.add(token, n)
        told = [(t, trie.find(t)) for t, _ in held]
        rows = [(t, table_form(t) if f is None else f, f is not None) for t, f in told]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.string(), pa.string(), pa.bool_()))], ["token", "form", "known"])

    for batch in batches:
        for now, token, n in zip(*(batch.column(c).to_pylist() for c in ("key", "token", "n"))):
            if now != key:
                if held:
                    yield forms()
                key, held = now, []
            held.append((token, n))
    if held:
        yield forms()


def token_forms(texts: DataFrame, text: str = "text") -> DataFrame:
    """``token, form, known`` of every token whose form differs from itself; ``known`` if a clean spelling was found."""
    counted = texts.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    bare = _bare_looks(F.col("token"))
    keyed = counted.where(_open(F.col("token"))).select(F.concat_ws(":", F.length(bare), F.left(bare, F.lit(3))).alias("key"), "token", "n")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_walk, "token string, form string, known boolean")


def _changed(rows: DataFrame, number: str, columns: list[str], forms: DataFrame) -> DataFrame:
    """``rows`` with ``m``, the forms of those of their tokens that change. ``number`` tells the rows apart."""
    each = rows.select(number, F.explode(F.array_distinct(F.filter(F.flatten(F.array(*[tokens(F.col(c)) for c in columns])), _open))).alias("token"))
    held = each.join(forms.select("token", "form"), "token").groupBy(number).agg(F.map_from_entries(F.collect_list(F.struct("token", "form"))).alias("m"))
    return rows.join(held, number, "left")


def _form(text: Column) -> Column:
    return F.when(F.col("m").isNull(), text).otherwise(F.array_join(F.transform(tokens(text), lambda t: F.coalesce(F.col("m")[t], t)), ""))


def canonical_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``text, form`` of every distinct text, nulls included. Spellings count as often as the rows hold them."""
    distinct = written(texts.select(F.col(text).alias("text")).distinct().withColumn("no", F.monotonically_increasing_id()), "texts")
    told = _changed(distinct.where("text is not null"), "no", ["text"], token_forms(texts, text)).select("text", _form(F.col("text")).alias("form"))
    return told.unionByName(distinct.where("text is null").select("text", F.col("text").alias("form")))


def form_looks(form: Column) -> Column:
    """The looks of canonical forms: Latin for every look-alike, also those with an accent."""
    table = dict(LOOK_ALIKES)
    for n in range(0x370, 0x590):
        looks = skeleton(chr(n))
        if looks != chr(n) and len(looks) == 1:
            table[chr(n)] = looks
    return F.translate(form, "".join(table), "".join(table.values()))


def hidden_quotes(quotes: DataFrame, units: DataFrame) -> DataFrame:
    """Quotes (``quote_kind, owner_key, quote_pos, unit_key, quote``) that are not in their unit
    (``quote_kind, unit_key, raw_text``) as they stand but look the same as a part of it.

    A unit that was delivered with several texts holds what any of them holds. Null and empty
    quotes, and quotes that leave no mark, are no cases.
    """
    keys = ["quote_kind", "owner_key", "quote_pos"]
    held = F.contains("raw_text", "quote")
    # A pair without any unusual character looks different unless it is the same.
    doubtful = ~held & (_unusual(F.col("quote")) | _unusual(F.col("raw_text")))
    pairs = quotes.where("quote <> ''").join(units.where("raw_text is not null").distinct(), ["quote_kind", "unit_key"])
    pairs = pairs.where(held | doubtful).select(*keys, held.alias("held"), *[F.when(~held, F.col(c)).alias(c) for c in ("quote", "raw_text")], F.monotonically_increasing_id().alias("no"))
    pairs = written(pairs, "pairs")
    forms = token_forms(quotes.select(F.col("quote").alias("text")).unionAll(units.select("raw_text")))
    told = _changed(pairs.where("not held"), "no", ["quote", "raw_text"], forms).select(*keys, _form(F.col("quote")).alias("quote"), _form(F.col("raw_text")).alias("raw_text"))
    # Forms agree on whole tokens. Where a quote may cut its first or last token, the forms of what
    # lies between must agree, and the looks of the whole settle the rest exactly.
    inner = F.regexp_replace("quote", f"^[{LETTERS}]+|[{LETTERS}]+$", "")
    looks, within = form_looks(F.col("quote")), form_looks(F.col("raw_text"))
    same = F.contains("raw_text", "quote") | (F.contains("raw_text", inner) & F.contains(within, looks))
    found = told.where((F.col("quote") != "") & same).select(*keys, F.lit(False).alias("held")).unionByName(pairs.where("held").select(*keys, "held"))
    return found.groupBy(*keys).agg(F.max("held").alias("held")).where("not held").select(*keys)
