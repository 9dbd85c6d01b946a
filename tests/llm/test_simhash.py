import random

import numpy as np
import pytest

from tessera.llm import common, simhash

from .conftest import AWKWARD, LONG

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefghijklm") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def near(t, share=0.04):
    return " ".join(RNG.choice(VOCAB) if RNG.random() < share else w for w in t.split())


@pytest.fixture(scope="module")
def corpus():
    out = [text(RNG.randint(60, 300)) for _ in range(500)]
    for k in range(40):
        out += [near(out[k]) for _ in range(RNG.randint(1, 6))]
    out += [near(out[45]) for _ in range(150)] + [out[50]] * 120
    RNG.shuffle(out)
    return out


def brute(texts):
    """Components of all pairs within the radius, each as its members."""
    fp = simhash.fingerprint_texts(texts)
    i, j = np.nonzero(np.triu(simhash.hamming(fp, fp) <= simhash.RADIUS, 1))
    return simhash.forest(len(texts), i, j)


def test_recall_and_groups(spark, make, corpus):
    label = brute(corpus)
    gone = {r["doc_id"]: r["keeper_id"] for r in simhash.near_duplicates(make(corpus).repartition(4)).collect()}
    want = {d: int(label[d]) for d in range(len(corpus)) if label[d] != d}
    assert len(want) > 350
    assert set(gone) <= set(want)
    assert sum(gone.get(d) == k for d, k in want.items()) >= 0.95 * len(want)
    left = {r["doc_id"] for r in simhash.deduplicate(make(corpus)).collect()}
    assert left == set(range(len(corpus))) - set(gone)


def test_planted_copies_are_found(make):
    base = [text(250) for _ in range(30)]
    docs = base + [near(t, 0.03) for t in base] + base[:5]
    gone = {r["doc_id"] for r in simhash.near_duplicates(make(docs)).collect()}
    assert len(gone & set(range(30, 65))) >= 33 and not gone & set(range(30))


def random_prints(rng, n):
    return rng.integers(0, 1 << 64, (n, len(simhash.WORDS)), dtype=np.uint64)


def flipped(rng, fp, bits):
    mask = np.zeros((len(fp), simhash.BITS), np.uint8)
    for row, n in zip(mask, np.broadcast_to(bits, len(fp))):
        row[rng.choice(simhash.BITS, n, replace=False)] = 1
    return fp ^ np.packbits(mask, axis=1).view("<u8")


@pytest.mark.parametrize("dense", (10, 10_000))
def test_cells_against_all_pairs(monkeypatch, dense):
    """Groups of a cell: pairs at all distances, a ball of many copies, and chains that leave it."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "TILE", (16, 48))
    rng = np.random.default_rng(1)
    fp = random_prints(rng, 350)
    fp = np.concatenate([fp, flipped(rng, fp, rng.integers(0, 90, 350)), flipped(rng, np.repeat(fp[:1], 400, 0), rng.integers(0, 35, 400)), flipped(rng, np.repeat(fp[:1], 60, 0), rng.integers(50, 75, 60))])
    fp = fp[rng.permutation(len(fp))]
    table = simhash.hamming(fp, fp[:3]).astype(np.int16)
    i, j = simhash.near_in_cell(fp, table, simhash.RADIUS)
    a, b = np.nonzero(np.triu(simhash.hamming(fp, fp) <= simhash.RADIUS, 1))
    assert np.array_equal(simhash.forest(len(fp), i, j), simhash.forest(len(fp), a, b))
    assert (simhash.hamming(fp, fp)[i, j] <= simhash.RADIUS).all()
    if dense == 10:
        assert len(i) < len(a)  # copies of a leader aren't compared among themselves


def test_isolated_pairs_share_cells_whatever_the_number_of_pivots(spark):
    """Pairs at the radius, with the pivots of 10,000, 1 million and 10 million vertices."""
    rng = np.random.default_rng(6)
    a = random_prints(rng, 400)
    fp = np.concatenate([a, flipped(rng, a, simhash.RADIUS)]).view(np.int64).tolist()
    vertices = spark.createDataFrame([((n, 0), *row) for n, row in enumerate(fp)], f"v struct<id:long,key:long>, {simhash.LONGS}")
    for n in (10_000, 1_000_000, 10_000_000):
        pivots = random_prints(rng, int(8 * n**0.5))
        cells = {}
        for r in simhash._cells(vertices, pivots).select("pivot", "v.id").collect():
            cells.setdefault(r["id"], set()).add(r["pivot"])
        assert np.mean([not cells[k].isdisjoint(cells[k + 400]) for k in range(400)]) >= 0.97, n


def test_a_chain_reaches_beyond_the_radius(make):
    """Each version differs a little from the one before; the last is far from the first and goes all the same."""
    chain = [text(300)]
    for _ in range(12):
        words = chain[-1].split()
        for k in RNG.sample(range(300), 12):
            words[k] = RNG.choice(VOCAB)
        chain.append(" ".join(words))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(make(chain)).collect()}
    assert set(rows) == set(range(1, 13)) and {r["keeper_id"] for r in rows.values()} == {0}
    assert rows[12]["distance"] > simhash.RADIUS >= rows[1]["distance"]


def test_clashing_columns_and_repeated_rows(spark):
    """Rows that agree in id and text: the one whose columns as JSON come first, wherever it lies."""
    rows = [(1, "some words here", n, "k", 0, 0) for n in (5, 3, 9)] + [(2, "other text of words", 7, "k", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__key` long, key string, nth int, `a.b` int")
    for parts in (1, 3):
        kept = simhash.deduplicate(df.repartition(parts))
        assert kept.columns == df.columns
        assert sorted(r[2] for r in kept.collect()) == [3, 7]


def test_components(spark):
    v = "struct<id:long,key:long>"
    rng = random.Random(9)
    chain = [(n, n + 1) for n in range(60)]
    star = [(100, n) for n in range(101, 140)]
    loose = [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)]
    pairs = chain + star + loose + [(7, 7), (3, 4)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([((a, 0), (b, 0)) for a, b in pairs], f"a {v}, b {v}")
    got = {r["v"]["id"]: r["root"]["id"] for r in simhash.components(df).collect()}
    a, b = np.array(pairs).T
    label = simhash.forest(261, a, b)
    assert got == {n: int(label[n]) for n in range(261) if label[n] != n}
    assert simhash.components(df.where("false")).count() == 0


def test_awkward(spark, awkward, none):
    rows = sorted(((r["doc_id"], r["keeper_id"], r["distance"], r["n_rows"]) for r in simhash.near_duplicates(awkward).collect()), key=str)
    assert rows == sorted([(1, 1, 0, 1), (2, 1, 0, 1), (None, None, 0, 1), (5, 4, 0, 1)], key=str)
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((str(r["doc_id"]) for r in kept.collect()))
    assert ids == sorted(map(str, [1, 3, 3, None, 4, 6, 7, 8, 9, 10, -5]))
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0
    assert len(AWKWARD) == 15


def test_long_text_is_whole():
    a, b = simhash.fingerprint_texts([LONG, LONG + " " + " ".join(VOCAB * 8)])
    assert (a != b).any()
    assert (simhash.fingerprint_texts([LONG])[0] == a).all()


def test_shuffled_anti_join(spark, monkeypatch):
    df = spark.range(50).withColumnRenamed("id", "k")
    keys = spark.range(10).withColumnRenamed("id", "k")
    assert common.without(df, keys, "k").count() == 40
    monkeypatch.setattr(common, "BROADCAST_KEYS", 3)
    assert common.without(df, keys, "k").count() == 40


def test_work_at_six_gigabytes():
    """2.8 million fingerprints: with 8 * sqrt(n) pivots the cells held 6 * 10^11 pairs, more than there was time for."""
    n = 2_800_000
    pivots = simhash.pivot_count(n)
    pairs = (n * simhash.nearest(pivots)) ** 2 / (2 * pivots)
    assert pairs <= 3.5e11 and n * pivots <= 2e11
    assert [simhash.pivot_count(k) for k in (1, 5, 100)] == [1, 5, 80]


def test_isolated_pairs_share_cells_of_the_pivots_drawn(spark):
    rng = np.random.default_rng(7)
    a = random_prints(rng, 200)
    fp = np.concatenate([a, flipped(rng, a, simhash.RADIUS)]).view(np.int64).tolist()
    vertices = spark.createDataFrame([(n, *row) for n, row in enumerate(fp)], f"v long, {simhash.LONGS}")
    for n in (1_000_000, 10_000_000):
        pivots = random_prints(rng, simhash.pivot_count(n))
        cells = {}
        for r in simhash._cells(vertices, pivots).select("pivot", "v").collect():
            cells.setdefault(r["v"], set()).add(r["pivot"])
        assert np.mean([not cells[k].isdisjoint(cells[k + 200]) for k in range(200)]) >= 0.97, n


def test_cells_are_the_nearest_pivots(spark):
    rng = np.random.default_rng(8)
    fp, pivots = random_prints(rng, 300), random_prints(rng, 700)
    vertices = spark.createDataFrame([(n, *row) for n, row in enumerate(fp.view(np.int64).tolist())], f"v long, {simhash.LONGS}")
    table, got = simhash.hamming(fp, pivots), {}
    for r in simhash._cells(vertices, pivots).collect():
        assert r["dist"] == table[r["v"], r["pivot"]]
        got.setdefault(r["v"], []).append(r["dist"])
    near = simhash.nearest(700)
    assert all(sorted(got[n]) == sorted(table[n].tolist())[:near] for n in range(300))


def slow_fingerprint(t):
    """One text's bits, feature by feature."""
    words = simhash.WORD.findall(t.lower())
    code = lambda w: np.array([simhash.zlib.crc32(w.encode())], np.uint64)
    weight = lambda w: min(len(w), 10)
    features = [(code(w), 2 * weight(w)) for w in set(words)] + [(common.split_mix(code(a), 7) + code(b), weight(a) + weight(b)) for a, b in set(zip(words, words[1:]))]
    total = np.zeros(simhash.BITS)
    for h, w in features or [(np.array([simhash.zlib.crc32(t.encode()) | 1 << 40], np.uint64), 1)]:
        bits = np.unpackbits(np.stack([common.split_mix(h, k + 1) for k in range(4)], 1).astype("<u8").view(np.uint8))
        total += w * (2.0 * bits - 1)
    return np.packbits(total > 0).view("<u8")


def test_fingerprints_against_one_feature_at_a_time(monkeypatch):
    texts = ["", "!!!", "a", "a a a", "x" * 500, "über Straße 日本語", text(2000), *(text(RNG.randint(1, 60)) for _ in range(60)), " ".join(f"w{i:04}" for i in range(900))]
    want = np.stack([slow_fingerprint(t) for t in texts])
    assert (simhash.fingerprint_texts(texts) == want).all()
    assert (np.concatenate([simhash.fingerprint_texts([t]) for t in texts]) == want).all()
    monkeypatch.setattr(simhash, "BIT_BLOCK", 300)
    assert (simhash.fingerprint_texts(texts) == want).all()
    assert simhash.fingerprint_texts([]).shape == (0, 4)
