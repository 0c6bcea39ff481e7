"""Statistics of a text's words, symbols and lines, and its nearest structural profile.

Method: cue numbers, times, markup and sound descriptions are taken off, and what remains is cut at line
ends and sentence ends. Every piece is a distribution over three sorts of events: the classes of its
characters, what its words are (function words of speech, function words of titles, repeated, written in
capitals, ...) and the classes of its first and last character. Pieces are compared with line profiles
by Jensen-Shannon divergence and take the nearest. A text is then a distribution over line profiles
and over the kinds they speak for, joined by the divergence of its function words to the nearest language's
prose; it is compared with document profiles, again by divergence, and takes the kind of the nearest.
Basic counts come alongside.

Profiles: ``profiles.json`` beside this module, made by ``fit`` from the 511 labelled documents of the
``sf0.1`` tables: centres of the pieces of each kind, then centres of the documents of each kind. ``fit_profiles``
makes them anew from any labelled sample, of which it takes ``SAMPLE`` documents at most; everything
else covers every text whole.

Plan: one pass over the texts where they are read, no shuffle; profiles travel with the code.

Edge cases: null, empty and blank texts have null statistics and no kind. A text of cues
without any content has zero words and the kind ``prose``. Repeated rows each have a result.
"""

from __future__ import annotations

import json
import pkgutil
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to a in is it you that he was for on are with as i his they be at one have this from or had by but not what all were we when your can said there an each which she do how their if will up about out then them these so some her would him has me my no who us please did what's it's don't".split(),
    "de": "der die das und in zu den ist nicht von sie mit dem ein eine es auf für im ich du wir er hat war bei nach auch wie noch nur was so aber wenn mir mich dich dir uns man doch als schon mehr da hier wo wer warum bitte nie alles dass ihr sein seine am vor".split(),
    "fr": "le la les de des du un une et à en est que qui ne pas ce je tu il elle nous vous on se dans pour sur avec plus au sont mais où si mon ma ton ta son sa ses y a été était tout rien jamais lui moi toi c'est n'est qu'il j'ai d'un l'a pourquoi il".split(),
    "es": "el la los las de del un una y a en es que no se lo le por con para su al más pero yo tú él ella nos me te mi tu está era si ya hay muy como todo nada nunca qué dónde quién porqué había estaba estábamos sin esto eso aquí antes después ese esa".split(),
    "ru": "и в не на я что он с как это а то все она так его но ты к у же вы за бы по ее мне было вот от меня о из ему теперь когда уже для нет до мы тебя их был была если мой ли мне где кто почему ну потом всё ещё её нас".split(),
}
#: Function words that stand in names and titles as well as in speech.
NOMINAL = {
    "en": "the of a an and to in on for with by from at my your his her our their its this that these those some one two all no".split(),
    "de": "der die das den dem des ein eine einen einem einer und in im am zu von vom mit für auf aus mein meine meinen dein sein seine unser ihr".split(),
    "fr": "le la les l de des du un une et à au aux en sur dans pour par avec mon ma mes ton ta tes son sa ses notre ce cette".split(),
    "es": "el la los las de del un una unos y a al en con por para mi tu su sus este ese esa esta".split(),
    "ru": "и в во на с со к у о от до из за по для без мой моя твой его её наш этот эта два один".split(),
}
KINDS = ["prose", "list", "table", "junk"]
#: Labelled documents that a fit takes at most, by the hash of their id.
SAMPLE = 5000
#: Line profiles and document profiles of each kind in a fit.
LINE_CENTRES = {"prose": 30, "list": 14, "table": 12, "junk": 28}
DOCUMENT_CENTRES = {"prose": 20, "list": 8, "table": 8, "junk": 14}
#: Shares of the three sorts of events in the distribution of a piece.
CHARACTERS, WORDS, ENDS = 0.5, 0.3, 0.2
#: Shares of the line profiles, of the kinds they speak for, and of prose divergence in the distribution of a text.
PROFILES, KIND_SHARES, PROSE = 0.5, 0.4, 0.1

_LINES = re.compile(r"[^\r\n\x85\u2028\u2029]+")
_CUE = re.compile(r"\s*(?:\d{1,6}|\d{1,2}:\d\d(?::\d\d)?[.,]\d{1,3}\s*-*[>→].*|\ufeff?WEBVTT.*|NOTE|STYLE|REGION)\s*$")
_MARK = re.compile(r"</?[a-zA-Z][^<>]*>|\{\\[^{}]*\}|[\ufeff\u200b-\u200f\u2060]")
_SOUND = re.compile(r"[\[(*♪♫][^\[\]()*♪♫]{2,60}[\])*♪♫]|[♪♫]")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
_STOP = re.compile(r"[.!?…。！？]['\"»”)\]]*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MOJI = re.compile(r"[ÐÑÃÂâ][\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")
_HIGH = re.compile(r"[À-ÿ¸¨]")

#: Characters that are classed at once.
WINDOW = 1 << 20

CLASSES = "vowel consonant letter upper digit blank gap stop quote comma delimiter colon bracket dash symbol broken".split()
ROLES = "speech nominal repeated capital small long none".split()
LONG = 14


def _class_of(c: str) -> str:
    for name, chars in (("blank", " \u00a0\u3000"), ("stop", ".!?…。！？"), ("quote", "'\"«»“”‘’„"), ("comma", ","), ("delimiter", "|;\t"), ("colon", ":"), ("bracket", "()[]{}<>"), ("dash", "-–—*•·‣▪◦●○■□➤►→»~+"), ("broken", "\ufffd¤¶¿§¬¦")):
        if c in chars:
            return name
    if 0x2580 <= ord(c) <= 0x259F or unicodedata.category(c)[0] == "C":
        return "broken"
    if c.isdigit():
        return "digit"
    if c.isalpha() or unicodedata.category(c)[0] == "M":
        base = unicodedata.normalize("NFD", c)[0].lower()
        if c.isupper():
            return "upper"
        return "vowel" if base in "aeiouyæøœаеёиоуыэюяіїє" else "consonant" if "a" <= base <= "z" or "а" <= base <= "я" or base in "ßñ" else "letter"
    return "symbol"


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """The class of every character below U+3100; those beyond are letters."""
    return np.array([*(CLASSES.index(_class_of(chr(n))) for n in range(0x3100)), CLASSES.index("letter")], np.int64)


@lru_cache(maxsize=1)
def _byte_of_letter() -> dict[int, int]:
    """The byte each character stands for in the Western code page, undefined bytes as they are."""
    table = {}
    for b in range(0x80, 0xA0):
        try:
            table[ord(bytes([b]).decode("cp1252"))] = b
        except UnicodeDecodeError:
            pass
    return table


def repaired(line: str) -> str:
    """A line read in the wrong encoding, read again in the right one; others as they are."""
    if _MOJI.search(line):
        try:
            return line.translate(_byte_of_letter()).encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    high = len(_HIGH.findall(line))
    if high > 3 and high > 0.6 * sum(c.isalpha() for c in line):
        try:
            again = line.translate(_byte_of_letter()).encode("latin-1").decode("cp1251")
            if all("а" <= c.lower() <= "я" or c.lower() == "ё" for c in again if ord(c) > 127 and c.isalpha()):
                return again
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return line


@lru_cache(maxsize=1)
def _words() -> tuple[dict[str, int], frozenset[str]]:
    """Function words numbered, and those that mark speech."""
    every = sorted({w for words in FUNCTION_WORDS.values() for w in words})
    nominal = {w for words in NOMINAL.values() for w in words}
    return {w: n for n, w in enumerate(every)}, frozenset(w for w in every if w not in nominal)


@lru_cache(maxsize=1)
def _prose_profiles() -> np.ndarray:
    """For each language, the shares of its function words in prose: falling with rank, as the
    words are listed by frequency, and one share for all other words."""
    number = _words()[0]
    out = np.zeros((len(FUNCTION_WORDS), len(number) + 1))
    for row, words in zip(out, FUNCTION_WORDS.values()):
        for rank, word in enumerate(dict.fromkeys(words)):
            row[number[word]] = 1 / (rank + 8)
        row *= 0.5 / row.sum()
        row[-1] = 0.5
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p to each row of q: 0 for equal, 1 for disjoint.

    Where q has nothing, an event adds half of its share in p; so only the events of q are walked.
    """
    t = np.ascontiguousarray(p.T)
    own = t * np.log2(np.maximum(t, 1e-30))
    out = np.empty((len(p), len(q)), t.dtype)
    whole = t.sum(0)
    for k, row in enumerate(q):
        at = np.flatnonzero(row > 0)
        mine = row[at].astype(t.dtype)
        m = t[at] + mine[:, None]
        out[:, k] = (whole + own[at].sum(0) - np.einsum("ij,ij->j", m, np.log2(m)) + (mine * np.log2(mine)).sum() + mine.sum()) / 2
    return out


def _shares(counts: np.ndarray, whole: float = 1.0) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    return np.divide(counts * np.float32(whole), total, out=np.zeros_like(counts), where=total > 0)


def pieces_of(text: str) -> list[tuple[str, bool]]:
    """What a text says, cut at line ends and sentence ends, and whether a piece ends its line."""
    out: list[tuple[str, bool]] = []
    for line in _LINES.findall(_MARK.sub("", text)):
        if _CUE.match(line):
            continue
        said = [p for p in _SENTENCE.split(_SOUND.sub(" ", repaired(line)).strip()) if p]
        out += [(p, False) for p in said[:-1]] + [(p, True) for p in said[-1:]]
    return out


@dataclass
class Events:
    """Distributions of pieces and what is counted in them."""

    shares: np.ndarray
    counts: np.ndarray  # words, letters in words, visible symbols, whether it ends in punctuation
    known: list[list[int]]  # numbers of the function words


def events_of(pieces: list[str]) -> Events:
    n, width = len(pieces), len(CLASSES)
    number, spoken = _words()
    roles, counts, known = np.zeros((n, len(ROLES)), np.float32), np.zeros((n, 4)), []
    for row, count, piece in zip(roles, counts, pieces):
        seen: set[str] = set()
        mine: list[int] = []
        for word in _WORD.findall(piece):
            w = word.lower()
            if (at := number.get(w)) is not None:
                mine.append(at)
            row[2 if w in seen else (0 if w in spoken else 1) if at is not None else 5 if len(w) > LONG else 3 if word[0].isupper() else 4] += 1
            seen.add(w)
            count[0] += 1
            count[1] += len(w)
        row[6] = not seen
        count[3] = _STOP.search(piece) is not None
        known.append(mine)
    table = _class_table()
    blank, gap = CLASSES.index("blank"), CLASSES.index("gap")
    classes = lambda text: table[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), len(table) - 1)]
    characters, edges = np.zeros((n, width), np.float32), np.zeros((n, 2 * width), np.float32)
    joined, owner, after_blank = "\n".join(pieces), 0, False
    for at in range(0, len(joined), WINDOW):
        text = joined[at : at + WINDOW]
        kind, ends = classes(text).copy(), np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) == 10
        is_blank = kind == blank
        before = np.concatenate([[after_blank], is_blank[:-1]])
        kind[is_blank & before] = gap
        own = np.cumsum(ends) - ends
        some = np.bincount((own * width + kind)[~ends], minlength=(own[-1] + 1) * width).reshape(-1, width)
        characters[owner : owner + len(some)] += some
        owner, after_blank = owner + int(ends.sum()), bool(is_blank[-1])
    edges[np.arange(n), classes("".join(p[0] for p in pieces))] = 1
    edges[np.arange(n), width + classes("".join(p[-1] for p in pieces))] = 1
    letters = [CLASSES.index(c) for c in ("vowel", "consonant", "letter", "upper")]
    blanks = [CLASSES.index(c) for c in ("blank", "gap")]
    counts[:, 2] = characters.sum(1) - characters[:, [*letters, *blanks, CLASSES.index("digit")]].sum(1)
    return Events(np.hstack([_shares(characters, CHARACTERS), _shares(roles, WORDS), _shares(edges, ENDS)]), counts, known)


@dataclass
class Profiles:
    lines: np.ndarray
    speaks: np.ndarray  # of each line profile, how far it speaks for each of KINDS
    documents: np.ndarray
    kinds: list[str]

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            rows = lambda m: [[round(float(v), 5) for v in r] for r in m]
            json.dump({"lines": rows(self.lines), "speaks": rows(self.speaks), "documents": rows(self.documents), "kinds": self.kinds}, f)

    @staticmethod
    def read(text: str | bytes) -> Profiles:
        told = json.loads(text)
        return Profiles(*(np.array(told[k], np.float32) for k in ("lines", "speaks", "documents")), told["kinds"])


@lru_cache(maxsize=1)
def own_profiles() -> Profiles:
    """Those that come with the package, also where it is shipped as an archive."""
    return Profiles.read(pkgutil.get_data("graphloom.llm", "profiles.json"))


def blank_text(text: str | None) -> bool:
    return text is None or not text.strip("\ufeff \t\r\n\u00a0\u3000\u200b")


class _Read:
    """The pieces of a run of texts, every distinct one measured once."""

    def __init__(self, texts: list[str | None]):
        self.n = len(texts)
        place: dict[str, int] = {}
        said, owner, ends = [], [], []
        for i, text in enumerate(texts):
            for piece, end in [] if blank_text(text) else pieces_of(text):
                said.append(place.setdefault(piece, len(place)))
                owner.append(i)
                ends.append(end)
        self.said, self.owner, self.ends = np.array(said, np.int64), np.array(owner, np.int64), np.array(ends, bool)
        self.events = events_of(list(place))
        width = len(_words()[0])
        own = np.array([i for i, p in zip(owner, said) for _ in self.events.known[p]], np.int64)
        word = np.array([w for p in said for w in self.events.known[p]], np.int64)
        self.used = np.bincount(own * (width + 1) + word, minlength=self.n * (width + 1)).reshape(self.n, width + 1).astype(np.float64)
        self.words = self.sums(0)
        self.used[:, -1] = self.words - self.used[:, :-1].sum(1)
        self.to_prose = divergence(_shares(self.used), _prose_profiles())
        self.to_prose[self.words == 0] = 1

    def sums(self, column: int, where: np.ndarray | None = None) -> np.ndarray:
        weights = self.events.counts[self.said, column] if len(self.said) else np.zeros(0)
        return np.bincount(self.owner, weights if where is None else weights * where, minlength=self.n)

    def nearest(self, lines: np.ndarray) -> np.ndarray:
        """The number of each piece's nearest line profile."""
        return divergence(self.events.shares, lines).argmin(1)[self.said] if len(self.said) else np.zeros(0, np.int64)

    def documents(self, lines: np.ndarray, speaks: np.ndarray) -> np.ndarray:
        """Each text as a distribution over line profiles, kinds and nearness to prose."""
        held = np.bincount(self.owner * len(lines) + self.nearest(lines), minlength=self.n * len(lines)).reshape(self.n, len(lines)).astype(np.float32)
        held = _shares(held)
        far = np.clip(self.to_prose.min(1, keepdims=True), 0, 1).astype(np.float32)
        return np.hstack([held * PROFILES, held @ speaks * KIND_SHARES, far * PROSE, (1 - far) * PROSE])


def measure(texts: list[str | None], profiles: Profiles | None = None) -> dict[str, list]:
    """The statistics of each text, as columns."""
    profiles = profiles or own_profiles()
    read, n = _Read(texts), len(texts)
    blank = np.array([blank_text(t) for t in texts], bool)
    words, letters, symbols = read.words, read.sums(1), read.sums(2)
    lines = np.bincount(read.owner, read.ends, minlength=n)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    nearest = divergence(read.documents(profiles.lines, profiles.speaks), profiles.documents).argmin(1) if n else []
    some = lambda values: [None if b else v for b, v in zip(blank.tolist(), values.tolist())]
    langs = list(FUNCTION_WORDS)
    return {
        "n_words": some(words.astype(int)),
        "n_lines": some(lines.astype(int)),
        "mean_word_length": some(share(letters, words)),
        "symbol_ratio": some(share(symbols, letters + symbols)),
        "stop_line_share": some(share(read.sums(3, read.ends), lines)),
        "common_word_share": some(share(words - read.used[:, -1], words)),
        "prose_divergence": some(read.to_prose.min(1)),
        "profile_lang": [None if b or w == 0 else langs[k] for b, w, k in zip(blank, words, read.to_prose.argmin(1))],
        "kind": [None if b else profiles.kinds[k] if some_line else "prose" for b, k, some_line in zip(blank, nearest, lines > 0)],
    }


def _centres(rows: np.ndarray, k: int, seed: int = 1, rounds: int = 25) -> np.ndarray:
    """At most k centres: spread-out rows first, then means of the rows nearest to each."""
    random = np.random.default_rng(seed)
    centres = rows[[random.integers(len(rows))]]
    far = divergence(rows, centres)[:, 0]
    while len(centres) < k and (far > 1e-6).any():
        chance = np.maximum(far, 0).astype(np.float64) ** 2
        centres = np.vstack([centres, rows[[random.choice(len(rows), p=chance / chance.sum())]]])
        far = np.minimum(far, divergence(rows, centres[-1:])[:, 0])
    for _ in range(rounds):
        nearest = divergence(rows, centres).argmin(1)
        centres = np.array([rows[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))], np.float32)
    return centres


def fit(texts: list[str], kinds: list[str]) -> Profiles:
    """Profiles of labelled texts; a kind without any is never assigned."""
    read = _Read(texts)
    kind = np.array(kinds)
    held = [k for k in KINDS if len(read.said) and (kind[read.owner] == k).any()]
    lines = np.vstack([_centres(read.events.shares[np.unique(read.said[kind[read.owner] == k])], LINE_CENTRES[k]) for k in held])
    near, whose = read.nearest(lines), kind[read.owner]
    told = np.array([[((near == n) & (whose == k)).sum() / max((whose == k).sum(), 1) for k in KINDS] for n in range(len(lines))], np.float32)
    speaks = _shares(told)
    documents = read.documents(lines, speaks)
    per_kind = {k: _centres(documents[kind == k], DOCUMENT_CENTRES[k]) for k in held}
    return Profiles(lines, speaks, np.vstack(list(per_kind.values())), [k for k, rows in per_kind.items() for _ in rows])


def fit_profiles(docs: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = SAMPLE) -> Profiles:
    """Profiles of a labelled sample of at most ``most`` documents, the same at any parallelism."""
    rows = labels.select(key, "kind").where(F.col("kind").isin(KINDS)).distinct().join(docs.select(key, "text"), key).where("trim(text) <> ''")
    sample = rows.orderBy(F.xxhash64(key), key).limit(most).collect()
    return fit([r["text"] for r in sample], [r["kind"] for r in sample])


#: Of a text as it stands: a word is a run of letters, a symbol is no letter, number, blank or control character.
WORD_RUN, NO_SYMBOL, STOP_END = r"\p{L}+", r"[\p{L}\p{M}\p{N}\p{Z}\p{C}]", r"[.!?…。！？][\"'»”)\]]*\s*$"


def text_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row with plain counts of its text as it stands, cues and markup included, without
    leaving the JVM. A null text has nulls, one without words or lines has shares of null."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    text = F.col(f"`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\p{Z}\p{C}]")))
    n, m = F.size(words), F.size(lines)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    symbols = F.length(F.regexp_replace(text, NO_SYMBOL, ""))
    common = F.size(F.filter(words, lambda w: F.lower(w).isin(sorted(_words()[0]))))
    share = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    stops = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(STOP_END))))
    told = {"n_words": n, "n_lines": m, "mean_word_length": share(letters, n), "symbol_ratio": share(symbols, symbols + letters), "stop_line_share": share(stops, m), "common_word_share": share(common, n)}
    return docs.select(*[F.col(f"`{c}`") for c in keep], *[F.when(text.isNotNull(), c).alias(name) for name, c in told.items()])


SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_lines")]
    + [T.StructField(n, T.DoubleType()) for n in ("mean_word_length", "symbol_ratio", "stop_line_share", "common_word_share", "prose_divergence")]
    + [T.StructField(n, T.StringType()) for n in ("profile_lang", "kind")]
)
NAMES = SCHEMA.fieldNames()
#: Texts that are measured together: at most so many, and so many bytes before the last.
RUN, RUN_BYTES = 500, 4_000_000


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(ends):
        passed = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + RUN, int(np.searchsorted(ends, passed + RUN_BYTES)) + 1))
        yield at, stop - at
        at = stop


def _runner(profiles: Profiles | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 2 + [pa.float64()] * 5 + [pa.string()] * 2
        for batch in batches:
            for at, size in _runs(batch.column("text")):
                part = batch.slice(at, size)
                made = measure(part.column("text").to_pylist(), profiles)
                arrays = [part.column(c) for c in part.schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(made[c], t) for c, t in zip(NAMES, kinds))], [*part.schema.names[:-1], *NAMES])

    return run


def text_quality(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, profiles: Profiles | None = None) -> DataFrame:
    """``keep`` columns of every row with the statistics of its text and its ``kind``."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    names = [f"k{n}" for n in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_runner(profiles), T.StructType([*(rows.schema[n] for n in names), *SCHEMA]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *NAMES)
