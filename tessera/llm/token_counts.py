"""Operator 10, token counts by rank-synchronous array merging.

Distinct pieces of a slice of texts lie end to end as one ragged array of symbols.  Each round
finds every sequence's lowest pair rank, merges all its pairs of that rank at once (from the
left where they overlap) and drops the sequences that have no pair left.  The count of a
text is the sum of the surviving symbols over its pieces, repeats included.

* Null text: null.  Empty text: 0.  Whole texts are counted, however long.
* Rows are counted one by one, so repeated rows and null ids pass through.
* Tables may be empty and may hold other columns of any name.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text
from tessera.llm.vocab import DEFAULT_VOCAB, NONE, Vocab, load

#: Pieces whose counts a worker keeps; beyond it the store starts anew (no effect on results).
KEPT = 800_000
_STORE: dict[str, dict[str, int]] = {}


def surviving(pretokens: list[bytes], vocab: Vocab) -> np.ndarray:
    """How many symbols each pre-token ends with."""
    n = len(pretokens)
    result = np.fromiter(map(len, pretokens), np.int64, n)
    live = np.flatnonzero(result > 1)
    symbols = vocab.byte_ids[np.frombuffer(b"".join([pretokens[i] for i in live]), np.uint8)]
    lengths = result[live]
    starts = np.cumsum(lengths) - lengths
    # The pair at p is (p, p+1); the last symbol of each sequence has none.
    pair = np.full(len(symbols), NONE, np.int32)
    inner = np.ones(len(symbols), bool)
    inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    pair[at] = vocab.pair_ranks(symbols[at], symbols[at + 1])
    while live.size:
        least = np.minimum.reduceat(pair, starts)
        done = least == NONE
        if done.any():
            result[live[done]] = lengths[done]
            keep = ~done
            wide = np.repeat(keep, lengths)
            symbols, pair = symbols[wide], pair[wide]
            live, lengths, least = live[keep], lengths[keep], least[keep]
            starts = np.cumsum(lengths) - lengths
            if not live.size:
                break
        chosen = pair == np.repeat(least, lengths)
        # Overlapping pairs of the same rank stand in a row: every second one from the left counts.
        if (chosen[1:] & chosen[:-1]).any():
            p = np.flatnonzero(chosen)
            fresh = np.ones(len(p), bool)
            fresh[1:] = p[1:] != p[:-1] + 1
            first = p[np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))]
            chosen[p[(p - first) % 2 == 1]] = False
        p = np.flatnonzero(chosen)
        owner = np.searchsorted(starts, p, "right") - 1
        symbols[p] = least[owner]
        keep = np.ones(len(symbols), bool)
        keep[p + 1] = False
        # Pairs to look up again: the merged symbol with what follows, and what precedes with it.
        stale = np.zeros(len(symbols), bool)
        stale[p] = True
        before = p - 1
        ok = before >= starts[owner]
        before = before[ok]
        stale[np.where(keep[before], before, before - 1)] = True
        symbols, pair, stale = symbols[keep], pair[keep], stale[keep]
        lengths = lengths - np.bincount(owner, minlength=len(lengths))
        starts = np.cumsum(lengths) - lengths
        ends = starts + lengths - 1
        stale[ends] = False
        at = np.flatnonzero(stale)
        pair[at] = vocab.pair_ranks(symbols[at], symbols[at + 1])
        pair[ends] = NONE
    return result


def count_texts(texts: list[str | None], path: str = DEFAULT_VOCAB) -> list[int | None]:
    vocab = load(path)
    store = _STORE.setdefault(path, {})
    if len(store) > KEPT:
        store.clear()
    pieces = [vocab.pieces(t) if t else [] for t in texts]
    new = list(set(chain.from_iterable(pieces)).difference(store))
    if new:
        split = [vocab.pretokens(p) for p in new]
        parts = [t for t in set(chain.from_iterable(split)) if t not in store]
        store.update(zip(parts, surviving([p.encode() for p in parts], vocab).tolist()))
        for p, ts in zip(new, split):
            if len(ts) > 1:
                store[p] = sum([store[t] for t in ts])
    get = store.__getitem__
    return [None if t is None else sum(map(get, ps)) for t, ps in zip(texts, pieces)]


def count_tokens(docs: DataFrame, vocab_path: str = DEFAULT_VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts = count_texts(piece.column("text").to_pylist(), vocab_path)
        return pa.record_batch([piece.column("id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_text(source, run, "doc_id long, n_tokens long")
