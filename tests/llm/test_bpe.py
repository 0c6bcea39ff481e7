import os

import pytest

from graphloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [
    None, "", " ", "\n", "a  b", "x \t y", "don't we'll 'S's5²5", "  a　　b", "a" * 3000, "<|endoftext|> tail", "\x1c\x1d!\x1ea\x1f ", "é́ é",
    " \n\n  \n x", "\x85\x85a", "12,345:67\n8 9  0", "Ǆǆ ꙮ 中文字1２３", "😀😀 👨‍👩‍👧", "'", "a'b's's", "﻿\x00", "00:01:02,345 --> 00:01:04,000\r\nHi.",
]


@pytest.fixture(scope="module")
def told():
    if not os.path.exists(bpe.DEFAULT_TOKENIZER):
        pytest.skip("no vocabulary file")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


def test_equals_public_library(spark, told):
    rows = [(n, t, "clash") for n, t in enumerate(TEXTS + TEXTS)]
    df = spark.createDataFrame(rows, "k0 long, text string, block string")
    got = bpe.encode_corpus(df, keep=["k0", "block"], block_bytes=200).collect()
    assert len(got) == len(rows) and {r.block for r in got} == {"clash"}
    assert {r.k0: list(r.ids) for r in got} == {n: told(t) for n, t, _ in rows}
    counts = bpe.encode_corpus(df, keep=["k0"], count_only=True).collect()
    assert {r.k0: r.n_tokens for r in counts} == {n: len(told(t)) for n, t, _ in rows}


def test_corpus_and_words_missing_from_a_dictionary(spark, told, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in bpe.encode_corpus(docs, keep=["doc_id"]).collect()} == {k: told(t) for k, t in texts.items()}
    import pyarrow as pa

    none = pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    out = bpe._spell(bpe.DEFAULT_TOKENIZER, [], False)(pa.table({"text": TEXTS}), none)
    assert out.column("ids").to_pylist() == [told(t) for t in TEXTS]


def test_empty_table(spark):
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
