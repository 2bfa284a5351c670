import random

import pytest
import tiktoken

from quern.llm.tokenizer import PATTERN, TOKENIZERS, Encoder, encode_corpus, merge_long, merge_short, read_ranks


@pytest.fixture(scope="module")
def ranks():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return read_ranks(f.read())


def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_another_library(ranks):
    own, other = Encoder(ranks), reference(ranks)
    rng = random.Random(1)
    alphabet = list("ab é1 \n\t\r\x0b\x1c\x1f\x85\xa0 ​　᠎'sdtll½Ⅳ²日本ก้ा़!.👩‍🔬́﻿  ")
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 16)))
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and other.decode(ids) == text
    long = "word " * 3000 + "ą" * 5000 + " " * 999 + "<|endoftext|>"
    assert own.encode(long) == other.encode_ordinary(long)
    assert own.encode("") == own.encode(None) == []


def test_both_merges_agree(ranks):
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"abcen \xe3\x81\x82") for _ in range(rng.randint(1, 60)))
        assert merge_short(word, ranks) == merge_long(word, ranks)


def test_corpus(spark, ranks):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 30_000, "x"), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got == sorted((i, reference(ranks).encode_ordinary(t or "")) for i, t, _ in rows)
    assert encode_corpus(df.limit(0)).collect() == []
