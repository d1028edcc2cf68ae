"""Backtracking BPE against the library, by text and as a query."""

import hashlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import wordbpe
from tessera.llm.spm import model_path

PATH = model_path(wordbpe.MODEL)
ENCODER = wordbpe.encoder(PATH, wordbpe.character_classes())
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def own(texts):
    ids, bounds = ENCODER.encode_batch(texts)
    spelled = ENCODER.decode_batch(ids, bounds)
    return [(ids[s:e].tolist(), bytes(t).decode()) for s, e, t in zip(bounds[:-1], bounds[1:], spelled)]


HARD = ["", " ", "don't they'll 'sa !'s ''s 's's I'VE", "a<|endoftext|>b<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "é<|endoftext|>́", "İſΣς ǅ", "x1²½ٱ١", "\u0085a b c\x1cd", "漢字😀👩‍🚀", "x" * 3000, "ab" * 5000, "aaaa" * 99]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert own([text])[0] == library(text)


def test_batches_keep_texts_apart():
    texts = [None, *HARD, None, "the end", *HARD[::-1]]
    assert own(texts) == [library(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abtheing's 1!é\n", max_size=60)), max_size=5))
def test_any_texts(texts):
    assert own(texts) == [library(t) for t in texts]


def test_every_character_class():
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}! {chr(c)}{chr(c)}" for c in codes[k : k + 5000]) for k in range(0, len(codes), 5000)]
    assert own(texts) == [library(t) for t in texts]


def test_compatible_pairs_are_those_that_merges_leave():
    rng = np.random.default_rng(3)
    inner = [i for i, t in ENCODER.text.items() if ord(t[-1]) < 256]
    every = list(ENCODER.text)
    for a, b in zip(rng.choice(inner, 3000).tolist(), rng.choice(every, 3000).tolist()):
        assert ENCODER._compatible(a * ENCODER.radix + b) == (ENCODER.merged(ENCODER.text[a] + ENCODER.text[b]) == [a, b])


def test_query_equals_library(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = wordbpe.op12_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids, text = library(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_columns_and_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "the the", None), (4, "word " * 40_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").select("*", wordbpe.token_ids(F.col("text")).alias("ids"))
    found = df.select("doc_id", "n_tokens", "ids", wordbpe.decoded(F.col("ids")).alias("back"), wordbpe.encoding(F.col("text")).alias("e")).collect()
    for (doc_id, text, clash), r in zip(rows, found):
        ids, back = library(text)
        assert (r["doc_id"], r["n_tokens"], r["ids"], r["back"], r["e"]["n_tokens"]) == (doc_id, clash, ids, back, len(ids))
    assert df.where("doc_id = 7").select(wordbpe.encoding(F.col("text"))).count() == 0
