"""Encoding of a whole corpus with a byte-level BPE vocabulary.

Method: corpus-level merge replay. The corpus is reduced to its distinct words, every
word is laid out once as a chain of symbols, and an inverted index from symbol pair to
chain positions applies the merges in rank order, touching only the neighbours of each
merged place. Documents are then spelled from the finished words.

Plan:

1. one scan cuts every text into words and keeps the distinct words of each block: a run of
   neighbouring rows that begins anew after ``block_bytes`` of text, counted as the rows go by
   (no shuffle of texts, no scan for sizes);
2. the distinct words of the corpus are shuffled once and replayed, each in one task;
3. the finished words travel back to the blocks that hold them, and each block is
   spelled next to its own small dictionary (one shuffle of texts, into as many partitions
   as the number of blocks asks for, whatever the session's setting).

No dictionary of the corpus is ever broadcast or collected. A word occurs at most once
in each block, so no join key can hold more than one row per block.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import written

#: The word pattern that belongs to the byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_BYTES = 4_000_000
#: Blocks that a task spells on average.
TASK_BLOCKS = 2
#: Bytes of words that are replayed together.
REPLAY_BYTES = 2_000_000


class Vocabulary:
    """Symbols of the single bytes and the ranked merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        #: 255 is no byte of UTF-8 and stands between words.
        self.byte_ids = np.array([ids[c] for c in _byte_letters()], np.int64)
        self.byte_ids[255] = -1
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.left, self.right = ([ids[p[n]] for p in pairs] for n in (0, 1))
        self.new = [ids[a + b] for a, b in pairs]
        self.ranks = {a << 32 | b: rank for rank, (a, b) in reversed(list(enumerate(zip(self.left, self.right))))}
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.key_ranks = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)


def _byte_letters() -> list[str]:
    """The printable letter by which such vocabulary files write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    spare = (chr(256 + n) for n in range(256))
    return [letters[b] if b in letters else next(spare) for b in range(256)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _patterns():
    import re

    import regex

    # A word never continues over the step from a visible character to white space, so texts
    # are first cut there with the faster engine; only distinct pieces meet the full pattern,
    # which for ASCII the faster engine can say as well.
    cut = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+").findall
    ascii_words = re.compile(WORD_PATTERN.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII).findall
    any_words = regex.compile(WORD_PATTERN).findall
    return cut, lambda piece: ascii_words(piece) if piece.isascii() else any_words(piece)


def replay(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All merges in rank order over one inverted index of pairs: (ids of all words in a row,
    where each word begins and, last, the end)."""
    joined = b"\xff".join(word.encode("utf-8", "surrogatepass") for word in words) + b"\xff" if words else b""
    first = vocab.byte_ids[np.frombuffer(joined, np.uint8)]
    symbol = first.tolist()
    after = list(range(1, len(symbol) + 1))
    before = list(range(-1, len(symbol) - 1))

    # The index: for each rank, the places where its pair stands.
    places: dict[int, list[int]] = {}
    pairs = (first[:-1] << 32) | first[1:]
    slot = np.minimum(np.searchsorted(vocab.keys, pairs), len(vocab.keys) - 1)
    at = np.flatnonzero((vocab.keys[slot] == pairs) & (first[:-1] >= 0) & (first[1:] >= 0))
    rank = vocab.key_ranks[slot[at]]
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    bounds = np.flatnonzero(np.diff(rank, prepend=-1)) if len(rank) else np.array([], np.int64)
    for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(rank)]):
        places[int(rank[lo])] = at[lo:hi].tolist()
    queue = sorted(places)

    known, push, pop = vocab.ranks.get, heapq.heappush, heapq.heappop
    while queue:
        rank = pop(queue)
        where = places.pop(rank)
        where.sort()
        left, right, new = vocab.left[rank], vocab.right[rank], vocab.new[rank]
        for at in where:
            if symbol[at] != left or symbol[gone := after[at]] != right:
                continue
            symbol[at], symbol[gone] = new, -2
            after[at] = then = after[gone]
            before[then] = at
            if (beside := symbol[then]) >= 0 and (r := known(new << 32 | beside)) is not None:
                if r in places:
                    places[r].append(at)
                else:
                    places[r] = [at]
                    push(queue, r)
            if (prior := before[at]) >= 0 and (beside := symbol[prior]) >= 0 and (r := known(beside << 32 | new)) is not None:
                if r in places:
                    places[r].append(prior)
                else:
                    places[r] = [prior]
                    push(queue, r)
    last = np.array(symbol, np.int64)
    last = last[last != -2]
    ends = np.flatnonzero(last == -1) - np.arange(len(words))
    return last[last != -1].astype(np.int32), np.concatenate([[0], ends]).astype(np.int64)


def _blocked(block_bytes: int):
    """Adds ``block`` to rows with ``text``: each holds at most block_bytes before its last text.

    A rerun that reads rows in another order only costs lookups: words missing from a
    block's dictionary are replayed on the spot.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, passed = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
            ends = passed + np.cumsum(sizes)
            block = pa.array((task << 32) + (ends - sizes) // block_bytes)
            passed = int(ends[-1]) if len(ends) else passed
            yield pa.RecordBatch.from_arrays([*batch.columns, block], [*batch.schema.names, "block"])

    return run


def _block_words(block_bytes: int):
    cut, split = _patterns()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pieces = None, set()

        def words():
            found = set()
            for piece in pieces:
                found.update(split(piece))
            return pa.RecordBatch.from_pydict({"block": pa.array([block] * len(found), pa.int64()), "word": pa.array(list(found), pa.string())})

        for batch in _blocked(block_bytes)(batches):
            for now, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist()):
                if now != block:
                    if pieces:
                        yield words()
                    block, pieces = now, set()
                if text:
                    pieces.update(cut(text))
        if pieces:
            yield words()

    return run


def _replay_batches(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, waiting, size = vocabulary(path), [], 0

        def done():
            ids, begins = replay(waiting, vocab)
            return pa.RecordBatch.from_pydict({"word": pa.array(waiting, pa.string()), "ids": pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))})

        for batch in batches:
            for word in batch.column("word").to_pylist():
                waiting.append(word)
                size += len(word)
                if size >= REPLAY_BYTES:
                    yield done()
                    waiting, size = [], 0
        if waiting:
            yield done()

    return run


class _Pieces(dict):
    """Piece of text to its number; the ids of all pieces stand in a row in ``ids``."""

    def __init__(self, words: dict[str, np.ndarray], path: str):
        self.words, self.path, self.ids, self.begins = words, path, array("i"), [0]
        self.split = _patterns()[1]

    def __missing__(self, piece: str) -> int:
        for word in self.split(piece):
            if (ids := self.words.get(word)) is None:
                self.words[word] = ids = array("i", replay([word], vocabulary(self.path))[0].tobytes())
            self.ids += ids
        self.begins.append(len(self.ids))
        self[piece] = at = len(self.begins) - 2
        return at


def _spell(path: str, keep: list[str], count_only: bool):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        cut = _patterns()[0]
        lists = words.column("ids").combine_chunks()
        flat, begins = np.asarray(lists.values, np.int32), lists.offsets.to_pylist()
        known = {w: array("i", flat[a:b].tobytes()) for w, a, b in zip(words.column("word").to_pylist(), begins, begins[1:])}
        pieces = _Pieces(known, path)
        number, used, ends = pieces.__getitem__, array("i"), [0]
        for text in docs.column("text").to_pylist():
            if text:
                used.extend(map(number, cut(text)))
            ends.append(len(used))
        used = np.frombuffer(used, np.int32) if used else np.array([], np.int32)
        begins = np.array(pieces.begins, np.int64)
        lengths = np.diff(begins)[used] if len(used) else np.array([], np.int64)
        reached = np.concatenate([[0], np.cumsum(lengths)])
        bounds = reached[np.array(ends)]
        out = {name: docs.column(name) for name in keep}
        if count_only:
            out["n_tokens"] = pa.array(np.diff(bounds), pa.int64())
        else:
            ids = np.frombuffer(pieces.ids, np.int32) if pieces.ids else np.array([], np.int32)
            spelled = ids[np.repeat(begins[used] - reached[:-1], lengths) + np.arange(reached[-1])]
            out["ids"] = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(spelled)).cast(pa.list_(pa.int32()))
        return pa.table(out)

    return run


def encode_corpus(
    docs: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    tokenizer: str = DEFAULT_TOKENIZER,
    count_only: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns of every row with ``ids array<int>`` of its text, or ``n_tokens`` instead.

    No special tokens are added; text that spells one is plain text. A null or empty text has
    the empty list (0 tokens). Repeated rows each have their own result; other columns are
    ignored, whatever their names. ``tokenizer`` is the path of the vocabulary file on every node.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    text = F.col(f"`{text_col}`")
    names = [f"k{n}" for n in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], text.alias("text"))
    held = written(rows.select("text").mapInArrow(_block_words(block_bytes), "block long, word string"), "bpe-words")
    parts = max(1, -(-held.select("block").distinct().count() // TASK_BLOCKS))
    blocked = rows.mapInArrow(_blocked(block_bytes), T.StructType([*rows.schema, T.StructField("block", T.LongType())])).repartition(parts, "block")
    finished = held.select("word").distinct().mapInArrow(_replay_batches(tokenizer), "word string, ids array<int>")
    dictionary = held.join(finished, "word").select("block", "word", "ids").repartition(parts, "block")
    result = T.StructType([*(rows.schema[n] for n in names), T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])
    spelled = blocked.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(_spell(tokenizer, names, count_only), result)
    return spelled.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_tokens" if count_only else "ids")
