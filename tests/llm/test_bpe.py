import random

import numpy as np
import pytest
import tiktoken

from tessera.llm import bpe, token_counts, vocab

from .conftest import AWKWARD, LONG


@pytest.fixture(scope="module")
def reference():
    v = vocab.load(vocab.DEFAULT_VOCAB)
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks={b: i for i, b in enumerate(v.bytes)}, special_tokens={})


def texts():
    rng = random.Random(3)
    parts = ["a", "b", " ", "\n", "é", "1", "'s", "!", " \n", "\t", "th", "日", "\x1c", " ", "  ", "don't", "'", "😀"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return made + ["", "  a", "a  b", " ", "x\n \ny", "a" * 3000, "ab" * 2000, " " * 99, LONG, "x" * 20_000, "the.\nThe the", "日本語" * 400]


def test_equal_to_another_implementation(reference):
    given = texts()
    counts = token_counts.count_texts(given)
    for text, encoded, count in zip(given, bpe.encode_texts(given), counts):
        want = reference.encode_ordinary(text)
        assert np.frombuffer(encoded, np.int32).tolist() == want
        assert count == len(want)


def test_small_store_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KEPT", 10)
    monkeypatch.setattr(token_counts, "KEPT", 10)
    for text in ("some words and more", "other words again", "some words"):
        assert np.frombuffer(bpe.encode_texts([text])[0], np.int32).tolist() == reference.encode_ordinary(text)
        assert token_counts.count_texts([text]) == [len(reference.encode_ordinary(text))]


def test_round_trip(spark, awkward, none):
    encoded = bpe.encode(awkward)
    rows = encoded.collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if r["tokens"] is None:
            assert r["n_tokens"] is None and r["exact"] is None
        else:
            assert r["exact"] and r["n_tokens"] == len(r["tokens"])
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([tuple(r) for r in bpe.decode(encoded).collect()], key=key) == sorted([(a[0], a[1]) for a in AWKWARD], key=key)
    assert bpe.encode(none).count() == 0 and token_counts.count_tokens(none).count() == 0
    counts = {(r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(awkward).collect()}
    assert counts == {(r["doc_id"], r["n_tokens"]) for r in rows}


def test_decode_errors(spark):
    df = spark.createDataFrame([(1, [72, None, 73]), (2, None), (3, [])], "doc_id long, tokens array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()}
    assert got[2] is None and got[3] == "" and len(got[1]) == 2
    v = vocab.load(vocab.DEFAULT_VOCAB)
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([v.size]), np.array([1]), v)


def test_another_vocabulary():
    path = vocab.DEFAULT_VOCAB.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    v = vocab.load(path)
    other = tiktoken.Encoding("multi", pat_str=vocab.PATTERN, mergeable_ranks={b: i for i, b in enumerate(v.bytes)}, special_tokens={})
    for text in ("größer et été", "naïve café 123", "日本語"):
        assert np.frombuffer(bpe.encode_texts([text], path)[0], np.int32).tolist() == other.encode_ordinary(text)
