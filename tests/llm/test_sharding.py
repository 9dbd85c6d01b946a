from tessera.llm import sharding

from .conftest import AWKWARD


def brute(rows, shards):
    """Sorted sizes and shards by id, which equal rows can't change."""
    size = lambda t: len((t or "").encode())
    ordered = sorted(((i is not None, i or 0, size(t)) for i, t in rows))
    total, at, out = sum(s for *_, s in ordered), 0, []
    for known, i, s in ordered:
        out.append((i if known else None, s, at, 0 if not total else min(at * shards // total, shards - 1)))
        at += s
    return out


def test_against_brute_force(spark, awkward, sf_dir):
    for shards in (1, 3, 7, 100):
        got = sharding.shard(awkward, shards).orderBy("start_byte").collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(brute([(a[0], a[1]) for a in AWKWARD], shards), key=key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, sharding.shard(docs, 16, partitions=5).collect()))
    assert got == sorted(brute(rows, 16))
    totals, biggest = {}, max(n for _, n, _, _ in got)
    for _, n, _, s in got:
        totals[s] = totals.get(s, 0) + n
    target = sum(totals.values()) / 16
    assert all(abs(t - target) <= biggest for t in totals.values())


def test_nothing(spark, none, make):
    assert sharding.shard(none, 4).count() == 0
    assert {r["shard"] for r in sharding.shard(make([None, "", ""]), 4).collect()} == {0}
