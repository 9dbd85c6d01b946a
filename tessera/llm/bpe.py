"""Operator 6, BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of symbols.  A segment tree holds, at the leaf of every symbol, the
rank of the pair it forms with the next living symbol, and in every node the least (rank,
position) below it.  Its root is the leftmost pair of lowest rank; a merge changes three
leaves, so costs three paths to the root.  It ends when the root says that no pair is left.
Short pre-tokens go through many trees at once, one numpy row each; long ones through a tree
of their own.

* Null text: null tokens, null count, null decoded text.  Empty text: no tokens, count 0.
* Rows are encoded one by one: repeated rows and null ids pass through; no text is cut short.
* Decoding is exact for every text, since all 256 bytes are tokens; ids that are negative or
  outside the vocabulary raise an error, null ids within a list are skipped, and bytes that
  aren't UTF-8 become U+FFFD.
* Tables may be empty and may hold other columns of any name.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text, utf8_buffer
from tessera.llm.vocab import DEFAULT_VOCAB, NONE, Vocab, load

#: Pieces whose tokens a worker keeps; beyond it the store starts anew (no effect on results).
KEPT = 600_000
#: Longer pre-tokens, in bytes, get a tree of their own.
WIDE = 64
_STORE: dict[str, dict[str, bytes]] = {}


def merge_long(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges of one long sequence, O(log n) each."""
    n = len(symbols)
    size = 1 << max(0, n - 1).bit_length()
    none = int(NONE)
    big = none * size * 2
    tree = [big] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        r = pairs.get(symbols[i] << 24 | symbols[i + 1], none)
        if r < none:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, r: int) -> None:
        k = size + i
        tree[k] = r * size + i if r < none else big
        k >>= 1
        while k:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
            k >>= 1

    while tree[1] < big:
        rank, i = divmod(tree[1], size)
        j = after[i]
        symbols[i] = rank
        after[i] = after[j]
        symbols[j] = -1
        put(j, none)
        if after[i] < n:
            before[after[i]] = i
            put(i, pairs.get(rank << 24 | symbols[after[i]], none))
        else:
            put(i, none)
        if before[i] >= 0:
            put(before[i], pairs.get(symbols[before[i]] << 24 | rank, none))
    return [s for s in symbols if s >= 0]


def merge_many(symbols: np.ndarray, vocab: Vocab) -> np.ndarray:
    """Merges of many sequences, one a row, padded with -1; the result keeps -1 where a symbol has gone.

    All rows take their next merge at once; rows that are done leave the work.
    """
    n, size = symbols.shape
    shift = size.bit_length() - 1
    big = np.int32(np.iinfo(np.int32).max)
    living = symbols >= 0
    count = living.sum(axis=1)
    col = np.arange(size, dtype=np.int32)
    after = np.broadcast_to(col + 1, (n, size)).copy()
    before = np.broadcast_to(col - 1, (n, size)).copy()
    tree = np.full((n, 2 * size), big, np.int32)
    r, c = np.nonzero(living[:, 1:])
    ranks = vocab.pair_ranks(symbols[r, c], symbols[r, c + 1])
    has = ranks < NONE
    tree[r[has], size + c[has]] = (ranks[has] << shift) + c[has]
    for level in range(shift - 1, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    rows = np.flatnonzero(tree[:, 1] < big)

    def put(rows: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
        k = at + size
        tree[rows, k] = np.where(ranks < NONE, (ranks << shift) + at, big)
        while k.size and k[0] > 1:
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    while rows.size:
        root = tree[rows, 1]
        i, rank = root & (size - 1), root >> shift
        j = after[rows, i]
        follow = after[rows, j]
        symbols[rows, i] = rank
        symbols[rows, j] = -1
        after[rows, i] = follow
        put(rows, j, np.full(len(rows), NONE, np.int32))
        inside = follow < count[rows]
        f = np.where(inside, follow, 0)
        before[rows[inside], f[inside]] = i[inside]
        put(rows, i, np.where(inside, vocab.pair_ranks(rank, symbols[rows, f]), NONE))
        lead = before[rows, i]
        has = lead >= 0
        if has.any():
            rr, ll = rows[has], lead[has]
            put(rr, ll, vocab.pair_ranks(symbols[rr, ll], rank[has]))
        rows = rows[tree[rows, 1] < big]
    return symbols


def encode_pretokens(pretokens: list[bytes], vocab: Vocab) -> list[bytes]:
    """Token ids, as the bytes of int32, of each pre-token."""
    out: list[bytes] = [b""] * len(pretokens)
    lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
    for i in np.flatnonzero(lengths > WIDE):
        raw = vocab.byte_ids[np.frombuffer(pretokens[i], np.uint8)].tolist()
        out[i] = np.array(merge_long(raw, vocab.pairs), np.int32).tobytes()
    size = 2
    while size <= WIDE:
        group = np.flatnonzero((lengths <= size) & (lengths > (size >> 1 if size > 2 else 0)))
        for start in range(0, len(group), 1 << 15):
            part = group[start : start + (1 << 15)]
            width = lengths[part]
            flat = vocab.byte_ids[np.frombuffer(b"".join([pretokens[i] for i in part]), np.uint8)]
            symbols = np.full((len(part), size), -1, np.int32)
            symbols[np.arange(size) < width[:, None]] = flat
            symbols = merge_many(symbols, vocab)
            keep = symbols >= 0
            flat, ends = symbols[keep], np.cumsum(keep.sum(axis=1)) * 4
            data, last = flat.tobytes(), 0
            for i, end in zip(part.tolist(), ends.tolist()):
                out[i] = data[last:end]
                last = end
        size *= 2
    return out


def learn(pieces: set[str], store: dict[str, bytes], vocab: Vocab) -> None:
    """Put the tokens of pieces not yet known, and of the pre-tokens they are made of, into the store."""
    new = list(pieces)
    split = [vocab.pretokens(p) for p in new]
    parts = [t for t in set(chain.from_iterable(split)) if t not in store]
    store.update(zip(parts, encode_pretokens([p.encode() for p in parts], vocab)))
    for p, ts in zip(new, split):
        if len(ts) > 1:
            store[p] = b"".join([store[t] for t in ts])


def encode_texts(texts: list[str | None], path: str = DEFAULT_VOCAB) -> list[bytes | None]:
    """Token ids, as the bytes of int32, of each text."""
    vocab = load(path)
    store = _STORE.setdefault(path, {})
    if len(store) > KEPT:
        store.clear()
    pieces = [vocab.pieces(t) if t else [] for t in texts]
    learn(set(chain.from_iterable(pieces)).difference(store), store, vocab)
    get = store.__getitem__
    return [None if t is None else b"".join(map(get, ps)) for t, ps in zip(texts, pieces)]


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocab: Vocab) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all sequences end to end, and each one's number of bytes."""
    if ids.size and (ids.min() < 0 or ids.max() >= vocab.size):
        raise ValueError(f"token ids must lie in 0 to {vocab.size - 1}")
    taken = vocab.arrow.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
    raw = np.frombuffer(taken.buffers()[2], np.uint8)[: offsets[-1]] if ids.size else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return raw, np.diff(offsets[ends])


def token_lists(encoded: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The Arrow list array, all ids, and the count of each text (0 for null)."""
    counts = np.fromiter((len(e) >> 2 if e else 0 for e in encoded), np.int64, len(encoded))
    ids = np.frombuffer(b"".join([e for e in encoded if e]), np.int32)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    mask = pa.array([e is None for e in encoded], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=mask), ids, counts


def encode(docs: DataFrame, vocab_path: str = DEFAULT_VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, n_tokens, exact): exact says that decoding the tokens gives the text's bytes again."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column("text")
        lists, ids, counts = token_lists(encode_texts(column.to_pylist(), vocab_path))
        raw, sizes = decode_ids(ids, counts, load(vocab_path))
        given, offsets = utf8_buffer(column)
        if len(raw) == len(given) and np.array_equal(sizes, np.diff(offsets)) and np.array_equal(raw, given):
            exact = np.ones(len(counts), bool)
        else:
            ends = np.concatenate([[0], np.cumsum(sizes)])
            exact = np.array([np.array_equal(raw[ends[k] : ends[k + 1]], given[offsets[k] : offsets[k + 1]]) for k in range(len(counts))])
        null = np.array(column.is_null().to_pylist(), bool)
        return pa.record_batch(
            [piece.column("id"), lists, pa.array(counts.astype(np.int32), pa.int32(), mask=null), pa.array(exact, pa.bool_(), mask=null)],
            names=["doc_id", "tokens", "n_tokens", "exact"],
        )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_text(source, run, "doc_id long, tokens array<int>, n_tokens int, exact boolean", limit=2 << 20)


def decode(encoded: DataFrame, vocab_path: str = DEFAULT_VOCAB, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) of tokens that `encode` made."""

    def run(batches):
        vocab = load(vocab_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                texts = []
                for ids in piece.column("tokens").to_pylist():
                    if ids is not None:
                        ids = np.array([i for i in ids if i is not None], np.int64)
                        ids = decode_ids(ids, np.array([len(ids)]), vocab)[0].tobytes().decode("utf-8", "replace")
                    texts.append(ids)
                yield pa.record_batch([piece.column("id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    source = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(tokens_col).cast("array<int>").alias("tokens"))
    return source.mapInArrow(run, "doc_id long, text string")
