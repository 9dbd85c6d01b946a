import numpy as np
import pyarrow as pa

from tessera.operators import similar


def test_pairs_against_brute_force():
    """Several tiles of sets and of words, repeated ids, words of one set."""
    rng = np.random.default_rng(0)
    sets = [sorted({f"w{x}" for x in rng.zipf(1.3, 30) % 9000} | {f"only{i}"}) for i in range(700)]
    sets[600] = sets[3]
    ids = [i if i != 650 else 3 for i in range(700)]
    got = similar.pairs(pa.table({"block": [0] * 700, "id": ids, "words": ["\n".join(s) for s in sets]}), 0.2).to_pylist()
    want = []
    for i in range(700):
        for j in range(i):
            n = len({*sets[i]} & {*sets[j]})
            value = n / (len(sets[i]) + len(sets[j]) - n)
            if value > 0.2 and ids[i] != ids[j]:
                want.append((min(ids[i], ids[j]), max(ids[i], ids[j]), value))
    assert len(want) > 100 and sorted(tuple(r.values()) for r in got) == sorted(want)
    assert similar.pairs(pa.table({"block": [0], "id": [1], "words": ["a"]}), 0.2).num_rows == 0


def test_jaccard_pairs_joins_nothing(spark, sf_dir):
    """A join of each hundred with itself intersected arrays pair by pair."""
    from tessera.queries import QUERIES

    assert "Join" not in QUERIES["jaccard_pairs"](spark, sf_dir)._jdf.queryExecution().toString()
