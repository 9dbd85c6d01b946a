"""Operator 3, benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Both sides are words, lower case, without punctuation.  One pass over the documents finds every
place where GRAM words in a row also stand in an item, and cuts out the passage around it: as
far to each side as an alignment that scores enough can reach.  A passage is dropped only where
its words, or the item's, can't reach the score in any order; all others are aligned with the
item, word against word, by Smith-Waterman (MATCH, MISMATCH, GAP).  The score is the best local
alignment as a share of the item aligned with itself; MIN_SCORE or more is a leak.

Every shared n-gram is a seed, so none is too frequent to serve, thousands of copies of an item
are all found, and a single edited copy needs GRAM intact words in a row, no more.  The items are
gathered on the driver in parts of at most ITEM_BYTES of text, one pass over the documents for
each part.

* An alignment without GRAM intact words in a row isn't found, whatever its score.
* Null and empty texts leak nothing.  Items of fewer than GRAM words, null ones too, match nothing:
  so few words are no evidence.
* Repeated documents, or several with the same id, give one row for each id and item: the best score.
  A null doc_id counts as one id.
* Items that are equal are reported each.  Whole texts are searched, however long.
* An empty table on either side gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, map_text, materialise, quoted, row_key, without

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Text of benchmark items that one pass looks for.
ITEM_BYTES = 32 << 20
#: Cells of one row of the matrices that are filled at a time.
CELLS = 1 << 18
WORD = re.compile(r"\w+")
OUT = "doc_id long, item_id long, score double, start_word int, end_word int"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Items:
    """Items as word numbers, and their n-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        listed = [(i, words_of(t)) for i, t in rows]
        listed = [(i, w) for i, w in listed if len(w) >= GRAM]
        self.ids = np.array([-1 if i is None else i for i, _ in listed], np.int64)
        self.null_id = np.array([i is None for i, _ in listed], bool)
        names = sorted(set(chain.from_iterable(w for _, w in listed)))
        self.number = {w: k for k, w in enumerate(names)}
        self.words = [np.array([self.number[w] for w in ws], np.int64) for _, ws in listed]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        grams = [self.codes(w) for w in self.words]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.codes_sorted, inverse = np.unique(flat, return_inverse=True)
        # occurrences of each n-gram: (item, place), those of n-gram g at first[g] to first[g + 1]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(inverse, kind="stable")
        self.item, self.place = item[order], place[order]
        self.first = np.searchsorted(inverse[order], np.arange(len(self.codes_sorted) + 1))

    def codes(self, words: np.ndarray) -> np.ndarray:
        """One number for each n-gram; exact, or mixed where the vocabulary is too large for 64 bits."""
        base = np.uint64(len(self.number) + 1)
        code = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(GRAM):
                code = code * base + words[k : len(words) - GRAM + 1 + k].astype(np.uint64)
        return code


def _highest(hit: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best that any run of words in each list can score, if each hit were a match and nothing else; no count is 0."""
    ends = np.cumsum(counts + 1)
    first = ends - counts - 1
    gain = np.zeros(ends[-1], np.int64)
    rest = np.ones(ends[-1], bool)
    rest[first] = False  # each list begins with a 0
    gain[rest] = np.where(hit, MATCH, max(MISMATCH, GAP))
    total = np.cumsum(gain)
    # each list lies far below the one before, so that the running minimum begins anew
    total -= np.repeat(np.arange(len(counts)) * (2 * MATCH * len(gain) + 1), counts + 1)
    return np.maximum.reduceat(total - np.minimum.accumulate(total), first)


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... up to counts[0] of them, then those of first[1]."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def passages(piece: pa.RecordBatch, items: Items, min_score: float = MIN_SCORE) -> pa.RecordBatch | None:
    """(doc_id, key, item, start, words) around each place that shares an n-gram with an item and may score enough."""
    texts = piece.column("text").to_pylist()
    words = [words_of(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    if total < GRAM:
        return None
    flat = np.fromiter(map(items.number.get, chain.from_iterable(words), repeat(-1)), np.int64, total)
    ends = np.cumsum(counts)
    known = flat >= 0
    run = known[: total - GRAM + 1].copy()
    for k in range(1, GRAM):
        run &= known[k : total - GRAM + 1 + k]
    at = np.flatnonzero(run)
    doc = np.searchsorted(ends, at, "right")
    inside = at + GRAM <= ends[doc]
    at, doc = at[inside], doc[inside]
    base = np.uint64(len(items.number) + 1)
    code = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            code = code * base + flat[at + k].astype(np.uint64)
    gram = np.minimum(np.searchsorted(items.codes_sorted, code), len(items.codes_sorted) - 1)
    hit = items.codes_sorted[gram] == code
    at, doc, gram = at[hit], doc[hit], gram[hit]
    if not len(at):
        return None
    # each hit times each occurrence of its n-gram among the items
    times = items.first[gram + 1] - items.first[gram]
    which = np.repeat(np.arange(len(at)), times)
    occ = np.repeat(items.first[gram], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    at, doc, item = at[which], doc[which], items.item[occ]
    lead = at - items.place[occ]  # where the item would begin
    order = np.lexsort((lead, item, doc))
    doc, item, lead = doc[order], item[order], lead[order]
    # hits whose beginnings lie within half an item of the one before share a passage
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lead[1:] - lead[:-1] > items.lengths[item[1:]] // 2 + 1)
    begin = np.flatnonzero(fresh)
    last = lead[np.append(begin[1:], len(lead)) - 1]
    doc, item, lead = doc[begin], item[begin], lead[begin]
    size = items.lengths[item]
    # words that the text has besides the item's cost a GAP each, and so many can be paid for
    slack = np.floor(size * MATCH * (1 - min_score) / -GAP).astype(np.int64) + 1
    s, t = np.maximum(ends[doc] - counts[doc], lead - slack), np.minimum(ends[doc], last + size + slack)
    # words of a passage that stand in the item, and of the item that stand in the passage
    width = np.int64(len(items.number) + 1)
    here = flat[_ranges(s, t - s)]
    has = np.repeat(np.arange(len(s)), t - s) * width + here
    has = np.unique(has[here >= 0])
    theirs = items.flat[_ranges(items.offsets[item], size)]
    need = np.repeat(np.arange(len(s)), size) * width + theirs
    there = has[np.minimum(np.searchsorted(has, need), len(has) - 1)] == need
    wanted = np.unique(need)
    mine = np.repeat(np.arange(len(s)), t - s) * width + here
    inside = (here >= 0) & (wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine)
    most = np.minimum(_highest(inside, t - s), _highest(there, size))
    keep = np.flatnonzero(most >= min_score * MATCH * size - 1e-9)
    if not len(keep):
        return None
    doc, item, s, t = doc[keep], item[keep], s[keep], t[keep]
    found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(t - s)]), pa.int32()), pa.array(flat[_ranges(s, t - s)], pa.int32()))
    return pa.record_batch(
        [piece.column("id").take(pa.array(doc)), piece.column("key").take(pa.array(doc)), pa.array(item, pa.int32()), pa.array(s - ends[doc] + counts[doc], pa.int32()), found],
        names=["doc_id", "key", "item", "start", "words"],
    )


def smith_waterman(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of an item with each row of texts (padded with -2): score, start, end.

    One row of the matrix for all texts at a time.  A gap along the text is a running maximum
    of (value + distance), so no inner loop is needed.  `origin` follows where the best path began.
    """
    n, width = texts.shape
    far = np.arange(width + 1) * -GAP
    prev, prev_from = np.zeros((n, width + 1), np.int64), np.broadcast_to(np.arange(width + 1), (n, width + 1)).copy()
    best, best_from, best_end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for word in item:
        step = np.where(texts == word, MATCH, MISMATCH)
        down, diag = prev[:, 1:] + GAP, prev[:, :-1] + step
        cell = np.zeros((n, width + 1), np.int64)
        origin = np.broadcast_to(np.arange(width + 1), (n, width + 1)).copy()
        take = np.maximum(down, diag)
        cell[:, 1:] = np.maximum(take, 0)
        origin[:, 1:] = np.where(take <= 0, origin[:, 1:], np.where(diag >= down, prev_from[:, :-1], prev_from[:, 1:]))
        lifted = cell + far
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width + 1), 0), axis=1)
        along = top - far > cell
        cell = np.where(along, top - far, cell)
        origin = np.where(along, np.take_along_axis(origin, source, 1), origin)
        at = cell.argmax(axis=1)
        better = cell[every, at] > best
        best = np.where(better, cell[every, at], best)
        best_from, best_end = np.where(better, origin[every, at], best_from), np.where(better, at, best_end)
        prev, prev_from = cell, origin
    return best, best_from, best_end


def _align(found: DataFrame, items: Items, min_score: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = batch.column("item").to_numpy()
            words = batch.column("words")
            start = batch.column("start").to_numpy()
            rows, score, lo, hi = [], [], [], []
            for it in np.unique(item).tolist():
                mine = sorted(np.flatnonzero(item == it).tolist(), key=lambda k: -len(words[k]))
                while mine:
                    n = max(1, CELLS // len(words[mine[0]]))
                    part, mine = mine[:n], mine[n:]
                    lists = [words[k].values.to_numpy() for k in part]
                    texts = np.full((len(part), len(lists[0])), -2, np.int64)
                    for r, w in enumerate(lists):
                        texts[r, : len(w)] = w
                    best, begin, end = smith_waterman(items.words[it], texts)
                    share = best / (MATCH * len(items.words[it]))
                    for r in np.flatnonzero(share >= min_score).tolist():
                        rows.append(part[r])
                        score.append(round(float(share[r]), 6))
                        lo.append(int(start[part[r]] + begin[r]))
                        hi.append(int(start[part[r]] + end[r]))
            if rows:
                take = pa.array(rows)
                ids = pa.array(items.ids[item[rows]], mask=items.null_id[item[rows]])
                yield pa.record_batch([batch.column("doc_id").take(take), batch.column("key").take(take), ids, pa.array(score, pa.float64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc_id", "key", "item_id", "score", "start_word", "end_word"])

    return found.mapInArrow(run, "doc_id long, key long, item_id long, score double, start_word int, end_word int")


def _parts(benchmark: DataFrame, item_id: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size, split by hash, so that no part is more than the driver can hold."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, key, item_id, score, start_word, end_word): all alignments of min_score or more."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")).where("text IS NOT NULL")
    out = spark.createDataFrame([], "doc_id long, key long, item_id long, score double, start_word int, end_word int")
    for rows in _parts(benchmark, item_id, item_text, item_bytes):
        items = Items(rows)
        if not items.words:
            continue
        given = spark.sparkContext.broadcast(items)  # bounded by item_bytes
        found = materialise(
            map_text(source, lambda piece, items: passages(piece, items, min_score), "doc_id long, key long, item int, start int, words array<int>", setup=lambda g=given: g.value),
            "passages",
        )
        out = out.unionByName(_align(found, items, min_score))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, **columns: str) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each document and item."""
    best = F.max(F.struct("score", -F.col("start_word"), "end_word")).alias("m")
    return matches(docs, benchmark, min_score, **columns).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.score", (-F.col("m.col2")).alias("start_word"), "m.end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a leak."""
    key = fresh(docs, "key")
    gone = materialise(matches(docs, benchmark, min_score, id_col, text_col).select(F.col("key").alias(key)).distinct(), "leaks")
    return without(docs.withColumn(key, row_key(id_col, text_col)), gone, key).select(*map(quoted, docs.columns))
