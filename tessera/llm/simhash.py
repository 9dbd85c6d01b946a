"""Operator 9, SimHash near-duplicates through pivot distance tables.

Fingerprints have 256 bits: the sign of the weighted sum over a text's distinct words and word
pairs, longer words weighing more.  Two unrelated texts are within RADIUS with a chance of less
than 2^-70 as far as their bits are random, so billions of them aren't joined by accident.  Equal fingerprints are one vertex, however many documents
share it.  Reference fingerprints (pivots), about 1.73 * vertices^0.7 of them, are drawn by hash
from the vertices; the table of Hamming distances from each vertex to every pivot is computed
once.  By the triangle inequality near vertices have near rows in the table, so each vertex goes
to the cells of its nearest pivots, and only pairs that share a cell are looked at.  The more
pivots there are the more cells it takes to hold the recall: `nearest` says how many.  In a cell,
tiles of pairs whose rows differ by more than the radius in any kept coordinate are discarded, and
the survivors are verified by their Hamming distance.  Cells hold about vertices * nearest / pivots fingerprints,
so the work grows as a power of about 1.7; there is no cap on a cell or on a fingerprint's partners.
A cell of many copies of one text costs no more than a pass for each of its leaders: fingerprints
within the radius of a leader are one group already, and aren't compared among themselves.

Groups are the connected components of the verified pairs.  So a document may be further than
the radius from the keeper of its group, if others lie between; `distance` says how far it is.  The
keeper of a group is its row of least doc_id (null last), then least text hash.

* A null text has no fingerprint and is in no group.
* A text without a word is one feature: only equal texts share its fingerprint.  So all empty
  texts form one group.
* Repeated rows form a group like other copies: all but one of them go.  Where rows agree in id
  and text but not in other columns, the one stays whose columns as JSON come first.
* An empty table gives an empty result; other columns don't matter, whatever their names.

The search is exact but for pairs that share none of their nearest cells; its recall against
brute force is measured in the tests and is above 0.95.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, map_text, materialise, quoted, row_key, split_mix, without

#: 64-bit words of a fingerprint, as columns.
WORDS = ("f0", "f1", "f2", "f3")
BITS = 64 * len(WORDS)
#: Most bits in which near copies differ.
RADIUS = 56
#: Cells that a fingerprint is put in, at least; and how their number grows with that of the pivots.
NEAREST = 22
GROWTH = (3.5, 0.27)
#: Pivots: this times a power of the number of fingerprints, and 8 times its root at least.
PIVOTS = (1.73, 0.7)
#: Distances of fingerprints to pivots that are computed at once.
TABLE = 1 << 23
#: Coordinates of the pivot table that are kept in a cell.
COORDINATES = 16
#: Rows and columns of a piece of a cell whose pairs are looked at together.
TILE = (64, 1024)
#: Fingerprints of a cell from which leaders are looked for, and how many in a row may have few followers.
DENSE, MISSES = 1024, 8
LONGS = ", ".join(f"{w} long" for w in WORDS)
WORD = re.compile(r"\w+")
#: Features whose bits are counted at once.
BIT_BLOCK = 1 << 12


def _hashed_bits(hashes: np.ndarray) -> np.ndarray:
    """(n, BITS) bits, a byte each."""
    words = np.stack([split_mix(hashes, k + 1) for k in range(len(WORDS))], 1).astype("<u8")
    return np.unpackbits(words.view(np.uint8), axis=1)


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    """(n, len(WORDS)) uint64 fingerprints.

    The features of all texts are numbers (text, weight, word, next word) in one sorted array.
    Those of one text and weight lie together, and their bits are counted eight columns to an addition.
    """
    words = [WORD.findall(t.lower()) for t in texts]
    index = {w: i for i, w in enumerate(set(chain.from_iterable(words)))}
    none = len(index)  # stands for the next word where a feature is a single one
    wide = none.bit_length()
    if len(texts) > 1 and (len(texts) << 5).bit_length() + 2 * wide > 63:
        half = len(texts) // 2
        return np.concatenate([fingerprint_texts(texts[:half]), fingerprint_texts(texts[half:])])
    counts = np.fromiter(map(len, words), np.int64, len(words))
    code = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    crc = np.fromiter(map(zlib.crc32, map(str.encode, index)), np.uint64, none)
    size = np.minimum(np.fromiter(map(len, index), np.int64, none), 10)
    doc = np.repeat(np.arange(len(texts)), counts)
    inner = doc[:-1] == doc[1:]
    a, b = code[:-1][inner], code[1:][inner]
    single = ((doc << 5 | 2 * size[code]) << wide | code) << wide | none
    key = np.concatenate([single, ((doc[:-1][inner] << 5 | size[a] + size[b]) << wide | a) << wide | b])
    key.sort()
    key = key[_begins(key)]
    ones, total = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    left, right = split_mix(crc, 7), np.append(crc, np.uint64(0))
    for s in range(0, len(key), BIT_BLOCK):
        part = key[s : s + BIT_BLOCK]
        group, a, b = part >> 2 * wide, part >> wide & (1 << wide) - 1, part & (1 << wide) - 1
        at = np.union1d(_begins(group), np.arange(0, len(part), 255)[1:])  # so that no byte overflows
        count = np.add.reduceat(_hashed_bits(np.where(b == none, crc[a], left[a] + right[b])).view(np.uint64), at, axis=0).view(np.uint8)
        owner, weight = group[at] >> 5, group[at] & 31
        first = _begins(owner)
        ones[owner[first]] += np.add.reduceat(count * weight[:, None].astype(np.int32), first, axis=0)
        total[owner[first]] += np.add.reduceat(np.diff(np.append(at, len(part))) * weight, first)
    bits = 2 * ones > total[:, None]
    bare = np.flatnonzero(counts == 0)
    if len(bare):
        bits[bare] = _hashed_bits(np.array([zlib.crc32(texts[i].encode()) | 1 << 40 for i in bare], np.uint64))
    return np.packbits(bits, axis=1).view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fingerprint) of each row whose text isn't null; key is the row's hash."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprint_texts(piece.column("text").to_pylist()).view("<i8")
        return pa.record_batch([piece.column("id"), piece.column("key"), *(pa.array(f) for f in fp.T.copy())], names=["doc_id", "key", *WORDS])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")).where("text IS NOT NULL")
    return map_text(source, run, f"doc_id long, key long, {LONGS}")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs of two arrays of fingerprints."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def _fingerprints(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy() for k in WORDS], 1).view(np.uint64)


def pivot_count(fingerprints: int) -> int:
    """Pivots for so many fingerprints.

    The table costs fingerprints * pivots, the cells about (fingerprints * nearest)^2 / (2 * pivots).
    """
    return min(fingerprints, math.ceil(max(8 * fingerprints**0.5, PIVOTS[0] * fingerprints ** PIVOTS[1])))


def nearest(pivots: int) -> int:
    """Cells that a fingerprint is put in.

    Fitted to isolated pairs of random fingerprints at RADIUS, of which 0.99 share a cell with
    800 to 180,000 pivots.
    """
    return min(pivots, max(NEAREST, math.ceil(GROWTH[0] * pivots ** GROWTH[1])))


def _signs(fp: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 1 and -1, whose products are BITS less twice the distance."""
    signs = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1).astype(np.float32)
    signs *= 2
    signs -= 1
    return signs


def _cells(vertices: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(pivot, dist, v, fingerprint): each vertex in the cells of its nearest pivots, of equally near ones the last."""
    near, n = nearest(len(pivots)), len(pivots)
    step = max(1, min(128, TABLE // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, tie = _signs(pivots).T, np.linspace(0, 1, n, dtype=np.float32)
        for batch in batches:
            fp = _fingerprints(batch)
            for s in range(0, len(fp), step):
                table = _signs(fp[s : s + step]) @ signs
                table += tie
                least = np.partition(table, n - near, axis=1)[:, n - near]
                row, cell = np.nonzero(table >= least[:, None])
                dist = (BITS - np.floor(table[row, cell] / 2) * 2) / 2
                part = batch.select(["v", *WORDS]).take(pa.array(row + s))
                yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(dist.astype(np.int16)), *part.columns], names=["pivot", "dist", "v", *WORDS])

    kind = vertices.schema["v"].dataType.simpleString()
    return vertices.select("v", *WORDS).mapInArrow(run, f"pivot int, dist short, v {kind}, {LONGS}")


def followers(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint a number; those with the same one are within the radius of one leader.

    Leaders are drawn in order; a few with hardly any followers in a row end it, since the cell isn't dense then.
    """
    ball = np.arange(len(fp))
    rest, missed = ball, 0
    while len(rest) > DENSE and missed < MISSES:
        near = hamming(fp[rest[:1]], fp[rest])[0] <= radius
        ball[rest[near]] = rest[0]
        missed = missed + 1 if np.count_nonzero(near) * 64 < len(fp) else 0
        rest = rest[~near]
    return ball


def near_in_cell(fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i, j that join all fingerprints of a cell which pairs within the radius join.  table: distances to some pivots.

    A tile of pairs is discarded if the intervals of a coordinate are further apart than the radius.
    """
    ball = followers(fp, radius)
    order = np.lexsort((table[:, 0], ball))
    fp, table, ball = fp[order], table[order], ball[order]
    words = [np.ascontiguousarray(w) for w in fp.T]
    mixed, bits, sums = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, np.uint8)
    left, right = [order[np.searchsorted(ball, ball)]], [order]  # a leader and its followers
    for s in range(0, len(fp), TILE[0]):
        e = min(len(fp), s + TILE[0])
        low, high = table[s:e].min(0), table[s:e].max(0)
        for a in range(s, len(fp), TILE[1]):
            b = min(len(fp), a + TILE[1])
            if ball[s] == ball[b - 1]:  # one ball
                continue
            if max((table[a:b].min(0) - high).max(), (low - table[a:b].max(0)).max()) > radius:
                continue
            both, ones, apart = mixed[: e - s, : b - a], bits[: e - s, : b - a], sums[: e - s, : b - a]
            np.bitwise_count(np.bitwise_xor(words[0][s:e, None], words[0][None, a:b], out=both), out=apart)
            for w in words[1:-1]:  # 192 bits leave hardly any pair of unrelated texts
                np.add(apart, np.bitwise_count(np.bitwise_xor(w[s:e, None], w[None, a:b], out=both), out=ones), out=apart)
            at = np.flatnonzero(apart <= radius)
            i, j, d = at // (b - a) + s, at % (b - a) + a, apart.ravel()[at].astype(np.int16)
            near = d + np.bitwise_count(words[-1][i] ^ words[-1][j]) <= radius
            i, j = i[near], j[near]
            later = i < j
            left.append(order[i[later]])
            right.append(order[j[later]])
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vertices the least vertex of its component under the edges i, j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _edges(cells: DataFrame, pivots: np.ndarray, radius: int) -> DataFrame:
    """(a, b), a > b: a spanning forest of the near pairs of each cell."""
    refs = pivots[:COORDINATES]

    def solve(cell: pa.Table) -> pa.RecordBatch | None:
        fp = _fingerprints(cell)
        table = np.concatenate([cell.column("dist").to_numpy()[:, None], hamming(fp, refs)], 1)
        i, j = near_in_cell(fp, table, radius)
        label = forest(len(fp), i, j)
        child = np.flatnonzero(label != np.arange(len(fp)))
        if not len(child):
            return None
        v = cell.column("v").combine_chunks()
        return pa.record_batch([v.take(pa.array(child)), v.take(pa.array(label[child]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last cell, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot = batch.column("pivot").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            if held and held[0].column("pivot")[0].as_py() != pivot[0]:
                if (out := solve(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            for s, e in zip(cuts, cuts[1:]):
                held.append(batch.slice(s, e - s))
                if e < len(pivot):
                    if (out := solve(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
        if held and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    v = cells.schema["v"].dataType.simpleString()
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "pivot").sortWithinPartitions("pivot").mapInArrow(run, f"a {v}, b {v}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex that isn't the least of its component.

    Large-star and small-star steps alternate until nothing changes: each hangs every
    neighbour of a vertex on the least one, so paths halve.  Windows do it, so no list of
    neighbours is ever gathered in a row.
    """

    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = seen(edges)
    while state[0]:
        least = F.min("b").over(Window.partitionBy("a"))
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        large = both.select("a", "b", F.least("a", least).alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.select("a", "b", least.alias("m"))
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, "edges")
        now = seen(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def _order_id(column: str) -> Column:
    """Null ids come last."""
    return F.coalesce(F.col(column), F.lit((1 << 63) - 1))


def duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keeper_id, distance, n_rows, key) of all rows that go, repeated ones counted in n_rows.

    A row that is equal to its keeper is listed with the number of its further copies.
    """
    spark = docs.sparkSession
    rows = materialise(fingerprints(docs, id_col, text_col).groupBy("doc_id", "key", *WORDS).agg(F.count("*").alias("n")), "fingerprints")
    # A number for each fingerprint is shorter than the id and key of its first row.
    first = rows.groupBy(*WORDS).agg(F.min(F.struct(_order_id("doc_id").alias("id"), "key")).alias("top"))
    vertices = materialise(first.withColumn("v", F.monotonically_increasing_id()), "vertices")
    count = vertices.count()
    if not count:
        return spark.createDataFrame([], "doc_id long, keeper_id long, distance int, n_rows long, key long, is_keeper boolean")
    drawn = vertices.orderBy(F.xxhash64(*WORDS), *WORDS).limit(pivot_count(count)).select(*WORDS).collect()
    pivots = np.array([tuple(r) for r in drawn], np.int64).view(np.uint64)
    roots = components(_edges(_cells(vertices, pivots), pivots, radius))
    grouped = vertices.join(roots, "v", "left").select(*WORDS, "top", F.coalesce("root", "v").alias("group"))
    # The keeper's own fingerprint comes along for the distance.
    keepers = grouped.groupBy("group").agg(F.min(F.struct("top", *(F.col(w).alias(f"root_{w}") for w in WORDS))).alias("k"))
    named = grouped.drop("top").join(keepers, "group").select(*WORDS, F.col("k.top").alias("root"), *(f"k.root_{w}" for w in WORDS))
    found = rows.join(named, list(WORDS))
    is_keeper = (_order_id("doc_id") == F.col("root.id")) & (F.col("key") == F.col("root.key"))
    gone = found.withColumn("n_rows", F.when(is_keeper, F.col("n") - 1).otherwise(F.col("n"))).where("n_rows > 0")
    keeper = F.when(F.col("root.id") < (1 << 63) - 1, F.col("root.id"))
    distance = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"root_{w}"))) for w in WORDS)
    return gone.select("doc_id", keeper.alias("keeper_id"), distance.cast("int").alias("distance"), "n_rows", "key", is_keeper.alias("is_keeper"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keeper_id, distance, n_rows): one row for each document that a group can spare."""
    return duplicates(docs, radius, id_col, text_col).select("doc_id", "keeper_id", "distance", "n_rows")


def deduplicate(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group."""
    found = materialise(duplicates(docs, radius, id_col, text_col), "duplicates")
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    gone = found.where("NOT is_keeper").select(F.col("key").alias(key)).distinct()
    kept = without(keyed, gone, key)
    again = found.where("is_keeper").select(F.col("key").alias(key)).distinct()
    if not again.isEmpty():  # rows that are equal to their keeper: one of each stays
        nth = fresh(keyed, "nth")
        order = Window.partitionBy(key).orderBy(F.to_json(F.struct(*map(quoted, docs.columns))))
        single = keyed.join(again, key, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
        kept = without(kept, again, key).unionByName(single)
    return kept.select(*map(quoted, docs.columns))
