import duckdb
import numpy as np
import pytest

from tessera.llm import queries, topk


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = []
    for n in range(len(ids)):
        d = ((x - x[n]) ** 2).sum(1)
        order = [m for m in np.lexsort((ids, d)) if ids[m] != ids[n]][:k]
        out += [(int(ids[n]), r, int(ids[m]), round(float(np.sqrt(d[m])), 6)) for r, m in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_exact_over_shards(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 3
    x = np.concatenate([c + rng.normal(size=(60, 8)) * spread for c in centres])
    x[100:130] = x[0]  # ties
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = brute(rows, 6)
    for shard_rows, query_rows in ((10_000, 10_000), (150, 200), (60, 37)):
        got = sorted(map(tuple, topk.top_k(df, 6, shard_rows=shard_rows, query_rows=query_rows).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_tree():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1000, 5)), np.ones((700, 5))])
    root = topk.build(x, 64)
    rows = np.concatenate([n.rows for n in topk.leaves(root)])
    assert sorted(rows.tolist()) == list(range(1700))
    for n in topk.leaves(root):
        assert (n.low == x[n.rows].min(0)).all() and (n.high == x[n.rows].max(0)).all()
    assert topk.build(np.zeros((0, 3))) is None


def test_pruning_saves_work(monkeypatch):
    """Well-separated clusters: far leaves are never scanned."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(256, 4)) + 100 * k for k in range(16)])
    root, seen = topk.build(x), []
    best = topk.Best(10, 3)
    monkeypatch.setattr(topk.Best, "add", lambda self, rows, dist, ids, old=topk.Best.add: (seen.append(len(rows)), old(self, rows, dist, ids))[1])
    topk.search(root, x, np.arange(len(x)), x[:10], np.arange(10), best)
    assert sum(seen) <= 10 * 256 * 2


def test_awkward(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [9.0, 9.0]), (None, [1.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 0.0]), (10, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, x double")
    clean = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (10, [0.0, 2.0])]
    assert sorted(map(tuple, topk.top_k(df, 10).collect())) == brute(clean, 10)
    assert sorted(map(tuple, topk.top_k(df, 1, shard_rows=2, query_rows=1).collect())) == brute(clean, 1)
    assert topk.top_k(df.where("false"), 3).count() == 0 and topk.top_k(df.where("vec_id = 4"), 3).count() == 0
    assert topk.top_k(df.where("vec_id = 1"), 3).count() == 0


def test_some_queries_against_all_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    x[350:360] = x[0]  # ties
    rows = [(i - 100, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = [r for r in brute(rows, 5) if r[0] % 50 == 0]
    for shard_rows, query_rows in ((10_000, 10_000), (40, 3)):  # of 32 shards many have no query
        got = sorted(map(tuple, topk.top_k(df, 5, shard_rows=shard_rows, query_rows=query_rows, every=50).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) == 14 * 5
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    assert topk.top_k(df.where("vec_id % 50 <> 0"), 5, shard_rows=100, every=50).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    """Queries are the ids divisible by 50; as many as all rows make the cost quadratic."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = sorted(map(tuple, queries.op7_topk(spark, sf_dir).collect()))
    assert got == sorted(con.sql(queries.oracle_sql()["op7_topk"]).fetchall())
    ids = [r[0] for r in con.sql("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0").fetchall()]
    assert {g[0] for g in got} == set(ids) and len(got) == queries.NEIGHBOURS * len(ids)
