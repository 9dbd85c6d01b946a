import random

import numpy as np

from tessera.llm import decontamination as dc

from .conftest import AWKWARD, document

RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
ITEMS = [" ".join(RNG.choice(VOCAB) for _ in range(n)) for n in (16, 20, 31, 45, 60)]


def noise(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def edited(text, share):
    out = []
    for w in text.split():
        r = RNG.random()
        out += [] if r < share / 3 else [RNG.choice(VOCAB)] if r < 2 * share / 3 else [w, RNG.choice(VOCAB)] if r < share else [w]
    return " ".join(out)


def align(a, b):
    """Plain Smith-Waterman score."""
    prev, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, prev[j - 1] + (dc.MATCH if x == y else dc.MISMATCH), prev[j] + dc.GAP, row[-1] + dc.GAP))
        best, prev = max(best, *row), row
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(40):
        item = rng.integers(0, 6, rng.integers(4, 30))
        texts = [rng.integers(-1, 6, rng.integers(1, 50)) for _ in range(6)]
        padded = np.full((6, max(map(len, texts))), -2)
        for row, t in zip(padded, texts):
            row[: len(t)] = t
        best, start, end = dc.smith_waterman(item, padded)
        for k, t in enumerate(texts):
            assert best[k] == align(item.tolist(), t.tolist())
            if best[k]:
                assert align(item.tolist(), t[start[k] : end[k]].tolist()) == best[k]


def test_against_brute_force(spark):
    docs = [noise(120) for _ in range(40)]
    docs += [f"{noise(30)} {i} {noise(30)}" for i in ITEMS] + [i.upper().replace(" ", ", ") for i in ITEMS]
    docs += [f"{noise(40)} {edited(i, s)} {noise(10)}" for i in ITEMS for s in (0.1, 0.2, 0.3) for _ in range(3)]
    docs += [f"{noise(200)} {ITEMS[0]} {noise(20)} {ITEMS[3]}"] + [ITEMS[2]] * 60  # thousands of copies don't make a seed too frequent
    df = spark.createDataFrame([document(i, t) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    want = {}
    for d, t in enumerate(docs):
        for i, item in enumerate(ITEMS):
            a = dc.words_of(item)
            share = align(a, dc.words_of(t)) / (dc.MATCH * len(a))
            if share >= dc.MIN_SCORE:
                want[d, i] = round(share, 6)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.leaks(df, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert np.mean([got[k] == want[k] for k in got]) >= 0.97
    planted = {(d, i) for (d, i), s in want.items() if s >= 0.75}
    assert planted <= set(got)
    left = {r["doc_id"] for r in dc.decontaminate(df, bench).collect()}
    assert left == set(range(len(docs))) - {d for d, _ in got} and set(range(40)) <= left
    # in parts of the benchmark, the same
    split = dc.matches(df, bench, item_bytes=300).groupBy("doc_id", "item_id").agg({"score": "max"}).collect()
    assert {(r[0], r[1]): r[2] for r in split} == got


def test_awkward(spark, awkward, none):
    plain = AWKWARD[0][1]
    bench = spark.createDataFrame([(1, plain), (2, None), (3, ""), (4, "too short"), (None, plain), (1, plain), (5, "x" * 1000)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.leaks(awkward, bench).collect()), key=str)
    assert got == sorted([(1, 1), (1, None), (2, 1), (2, None)], key=str)
    kept = dc.decontaminate(awkward, bench)
    assert kept.count() == len(AWKWARD) - 3 and kept.columns == awkward.columns
    assert dc.leaks(none, bench).count() == 0 and dc.decontaminate(none, bench).count() == 0
    empty = bench.where("false")
    assert dc.leaks(awkward, empty).count() == 0 and dc.decontaminate(awkward, empty).count() == len(AWKWARD)
    assert dc.leaks(awkward, bench.where("item_id = 4")).count() == 0


def test_single_edited_copies(spark):
    """One edited copy of each item, alone and beside verbatim ones; four words in a row are intact at most."""
    replaced = [" ".join("other" if k % 5 == 4 else w for k, w in enumerate(i.split())) for i in ITEMS]
    inserted = [" ".join(f"{w} other other" if k % 4 == 3 else w for k, w in enumerate(i.split())) for i in ITEMS]
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    for copies in (replaced, inserted):
        docs = [f"{noise(30)} {c} {noise(30)}" for c in copies]
        for verbatim in (0, 3):
            rows = [document(d, t) for d, t in enumerate(docs)] + [document(100 + k, i) for i in ITEMS for k in range(verbatim)]
            df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
            got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.leaks(df, bench).collect()}
            for d, text in enumerate(docs):
                item = dc.words_of(ITEMS[d])
                assert got.get((d, d)) == round(align(item, dc.words_of(text)) / (dc.MATCH * len(item)), 6)
