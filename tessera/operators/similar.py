"""Similar word sets within a group: common words of all pairs as matrix products."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

#: Sets, and words, of a matrix.
SETS, WORDS = 512, 4096


def common(row: np.ndarray, word: np.ndarray, a: range, b: range) -> np.ndarray:
    """How many words each of the sets a has in common with each of b.  word: sorted."""
    out = np.zeros((len(a), len(b)), np.float32)
    for s in range(0, int(word[-1]) + 1 if len(word) else 0, WORDS):
        at = slice(*np.searchsorted(word, [s, s + WORDS]))
        has = []
        for r in (a,) if a == b else (a, b):
            mine = (row[at] >= r.start) & (row[at] < r.stop)
            has.append(np.zeros((len(r), WORDS), np.float32))
            has[-1][row[at][mine] - r.start, word[at][mine] - s] = 1
        out += has[0] @ has[-1].T
    return out


def pairs(group: pa.Table, above: float) -> pa.Table:
    """(a, b, jaccard), a < b, of a group (.., id, words), words being distinct ones with line feeds between."""
    ids = group.column("id").to_numpy()
    sets = [w.split("\n") for w in group.column("words").to_pylist()]
    number: dict[str, int] = {}
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    word = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(sets)), np.int64, int(size.sum()))
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(word, minlength=1) > 1  # a word of one set is in no intersection
    keep = shared[word]
    word, row = (np.cumsum(shared) - 1)[word[keep]], row[keep]
    order = np.argsort(word, kind="stable")
    word, row = word[order], row[order]
    found: list[tuple[np.ndarray, ...]] = []
    tiles = [range(s, min(len(sets), s + SETS)) for s in range(0, len(sets), SETS)]
    for k, a in enumerate(tiles):
        for b in tiles[k:]:
            both = common(row, word, a, b).astype(float)
            jaccard = both / (size[a.start : a.stop, None] + size[None, b.start : b.stop] - both)
            i, j = np.nonzero(jaccard > above)
            i, j = i + a.start, j + b.start
            x, y, jaccard = ids[i], ids[j], jaccard[i - a.start, j - b.start]
            once = (x != y) & (i < j)
            found.append((np.minimum(x, y)[once], np.maximum(x, y)[once], jaccard[once]))
    return pa.table({k: np.concatenate([f[n] for f in found]) for n, k in enumerate(("a", "b", "jaccard"))})
