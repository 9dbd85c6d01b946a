"""Operator 8, LM scoring with a hashed maximum-entropy model.

The probability of a word is a product down a tree of classes of `width` branches a node: class,
member and type, each a softmax that is log-linear in hashed features of the context: the word
before, the two before, and the second before with the nearest skipped.  A node's bias is the
log of its share in the corpus.  The types are the most frequent words, one each, and width ** 2
buckets of all other words by hash; a softmax of the same form parts a bucket into `width`
leaves, and the distinct words that the corpus has in a leaf share its probability equally.  So
every word of the corpus has a probability, and they sum to 1.

The model grows with the corpus of n words: there are about 5 * n^0.45 types, and the hashed rows
are as many as the words.  So the weights are never in one place.  They are parted by context:
every position goes, with the two words before it, to the block of its context, BLOCK positions
or so, and there all features of that context live.  A block is trained by gradient steps over its
positions (AdaGrad, a step size for each row, in batches, in an order drawn by hash) and then
scores the same positions in sparse numpy batches: rows are gathered by feature, never a dense
feature vector.  Blocks train side by side, and what comes back is one sum for each task and
document.  A frequent word has as many blocks as its count calls for, parted by the word before
it, and where that is frequent too, by the document's content; so no block grows with the
corpus, and equal documents meet in the same blocks.

Which positions a block holds, their order and the model are functions of the corpus alone, so
scores don't depend on the partitioning.  Sent to every task: the types, about 30 bytes each, and
the words that occur more than BLOCK times, of which there are n / BLOCK at most.

Results: (doc_id, n_words, logprob, perplexity), natural logarithm, per whole text, rounded to
6 places.

* Null and empty texts, and texts without a word: 0 words, null logprob and perplexity.
* Repeated rows are trained on as often as they occur and get the same score.
* With no word in the whole corpus every score is null.
* An empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text, materialise, slices, split_mix, utf8_buffer

#: Taken off both ends of a word; what is nothing else stays as it is.
MARKS = ".,;:!?*&%$#|()[]{}<>\"'`~^_=+/\\-"
#: Types are about TYPES[0] * n ** TYPES[1].
TYPES = (5, 0.45)
#: Positions of a block, on average.
BLOCK = 1 << 16
#: Blocks that travel together, at most.
GROUP = 16
EPOCHS, BATCH, RATE = 1, 4096, 0.2
#: Levels of the tree down to a type; the one below parts the words of a bucket.
FEATURES, LEVELS = 3, 3
#: Score of what can't occur; scores are held below HIGHEST, so that exp stays finite.
NEVER, HIGHEST = np.float32(-40), np.float32(60)
_U = np.uint64


def tokenize(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of all words, end to end, and the number of words of each text.

    Words are what white space parts, lower case, without punctuation at their ends.
    """
    words = [t.lower().split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    code = {w: zlib.crc32((w.strip(MARKS) or w).encode()) for w in set(chain.from_iterable(words))}
    return np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum())), counts


def before(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code + 1 of the word before each, and of the one before that; 0 before the start of a text."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = []
    for k in (1, 2):
        w = np.zeros(len(codes), np.int64)
        w[k:] = codes[:-k] + 1
        w[place < k] = 0
        out.append(w)
    return out[0], out[1]


def contents(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for the words of each text, whatever their order."""
    ends = np.concatenate([np.zeros(1, _U), np.cumsum(split_mix(codes, 4))])
    stop = np.cumsum(counts)
    return split_mix(ends[stop] - ends[stop - counts], 6)


def coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, codes): a number for each row, and its word codes as the bytes of uint32, null for a null text."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        codes, counts = tokenize(piece.column("text").to_pylist())
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
        data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.astype("<u4").tobytes())])
        return pa.record_batch([piece.column("row"), piece.column("id"), data], names=["row", "doc_id", "codes"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialise(map_text(source, run, "row long, doc_id long, codes binary"), "codes")


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What tokenize returned."""
    raw, offsets = utf8_buffer(column)
    return np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), np.diff(offsets) >> 2


def counted(codes: DataFrame) -> DataFrame:
    """(code, n) of every word; code -1 is the start of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.record_batch([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            words, counts = unpack(batch.column("codes"))
            parts += [words, np.full(np.count_nonzero(counts), -1)]
            held += len(words)
            if held > 8_000_000:
                yield flush()
                parts, held = [], 0
        if held:
            yield flush()

    return materialise(codes.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "words")


def branches(total: int) -> int:
    """Branches of each node of the tree, for a corpus of so many words."""
    return max(4, round((TYPES[0] * total ** TYPES[1]) ** (1 / LEVELS)))


@dataclass
class Lexicon:
    """The types of a corpus, and the parting of its contexts."""

    width: int  # branches of a node
    codes: np.ndarray  # words that are a type, sorted
    number: np.ndarray  # their types
    prior: list[np.ndarray]  # a level's log shares, (nodes, width); the last one's nodes are the buckets
    inner: np.ndarray  # log P(word | leaf) of each leaf of the last level
    blocks: int
    hot: np.ndarray  # frequent words, +1, sorted
    parts: np.ndarray  # blocks of each

    @property
    def vocabulary(self) -> int:
        return vocabulary(self.width)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Of words that are a type: its number.  Of others: that of their leaf, beyond those of the vocabulary."""
        rare = self.vocabulary + leaf(codes, self.width)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.number[at], rare)

    def _parts(self, word: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(word), _U)
        at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
        return np.where(self.hot[at] == word, self.parts[at], 1).astype(_U)

    def block(self, b: np.ndarray, a: np.ndarray, content: np.ndarray) -> np.ndarray:
        """Where the positions with these words before them (b, and a before b) are trained."""
        if self.blocks == 1:
            return np.zeros(len(b), np.int64)
        own, other = self._parts(b), self._parts(a)
        spread = content % np.minimum(own, other)
        with np.errstate(over="ignore"):
            part = split_mix(a.astype(_U) + (spread << _U(40)), 21) % own
            return (split_mix(b.astype(_U) + (part << _U(40)), 22) % _U(self.blocks)).astype(np.int64)


def vocabulary(width: int) -> int:
    """Types that are a word; the last width ** 2 are buckets."""
    return width**LEVELS - width**2


def leaf(codes: np.ndarray, width: int) -> np.ndarray:
    """Of a rare word: bucket * width + branch of the bucket."""
    return (split_mix(codes, 9) % _U(width**3)).astype(np.int64)


def lexicon(words: DataFrame, block: int = BLOCK) -> Lexicon | None:
    """From the counts of all words; None without any."""
    total = words.where("code >= 0").agg(F.sum("n")).first()[0]
    if not total:
        return None
    width = branches(total)
    v, size = vocabulary(width), width**LEVELS
    top = words.where("code >= 0").orderBy(F.desc("n"), "code").limit(v)
    top = [tuple(r) for r in top.collect()]
    listed, n = (np.array(x, np.int64) for x in zip(*top))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width**3), np.int64)
        for batch in batches:
            at = leaf(batch.column("code").to_numpy(), width)
            sums[0] += np.bincount(at, minlength=width**3)
            sums[1] += np.bincount(at, batch.column("n").to_numpy(), minlength=width**3).astype(np.int64)
        some = np.flatnonzero(sums[0])
        yield pa.record_batch([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["leaf", "words", "n"])

    # what is no type: below the last one in the order of `top`
    last = top[-1]
    rest = words.where((F.col("code") >= 0) & ((F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("code") > last[0]))))
    leaves = rest.mapInArrow(tally, "leaf long, words long, n long").groupBy("leaf").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).collect()  # a row a leaf
    distinct, rare = np.zeros(width**3, np.int64), np.zeros(width**3, np.int64)
    for r in leaves:
        distinct[r["leaf"]], rare[r["leaf"]] = r["words"], r["n"]
    frequent = words.where(F.col("n") > block).collect()  # total / block rows at most
    frequent = sorted((r["code"] + 1, -(-r["n"] // block)) for r in frequent)
    hot, parts = (np.array([x[k] for x in frequent], np.int64) for k in (0, 1))
    return Lexicon(width, *tree(width, listed, n, distinct, rare), -(-total // block), hot, parts)


def tree(width: int, words: np.ndarray, n: np.ndarray, distinct: np.ndarray, rare: np.ndarray) -> tuple:
    """codes, number, prior and inner of a Lexicon.

    words: the most frequent ones in order, n: their counts, distinct and rare: words in each leaf, and how often they occur together.
    """
    count = np.zeros(width**LEVELS, np.int64)
    count[: len(n)] = n
    count[vocabulary(width) :] = rare.reshape(-1, width).sum(1)
    prior = []
    for level in range(1, LEVELS + 2):
        nodes = (count.reshape(-1, width ** (LEVELS - level)).sum(1) if level <= LEVELS else rare).reshape(-1, width)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.log(nodes / nodes.sum(1, keepdims=True))
        prior.append(np.where(nodes > 0, share, NEVER).astype(np.float32))
    order = np.argsort(words)
    return words[order], order.astype(np.int64), prior, -np.log(np.maximum(distinct, 1))


def pack(values: np.ndarray) -> bytes:
    """Small numbers that lie together take few bytes."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def grouped(blocks: int, partitions: int) -> int:
    """Blocks that travel together: enough groups for partitions of like size."""
    return max(1, min(GROUP, blocks // (4 * partitions)))


ROUTED = "part int, base long, n int, sizes binary, rows binary, b binary, a binary, word binary"


def routed(codes: DataFrame, lex, group: int = 1) -> DataFrame:
    """The positions of each slice of documents, by so many blocks in a row; sizes: positions of each.

    Every slice has positions for nearly every block, so there are as many pieces as slices times groups: single
    blocks would be too small to be worth a row each.  lex: a broadcast Lexicon.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lex.value
        for batch in batches:
            # numbers of rows are kept from a base, and those of different tasks are far apart
            task = batch.column("row").to_numpy() >> 31
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for piece in chain.from_iterable(slices(batch.slice(s, e - s), "codes", 8 << 20) for s, e in zip(cuts, cuts[1:])):
                words, counts = unpack(piece.column("codes"))
                if not len(words):
                    continue
                b, a = before(words, counts)
                row = np.repeat(piece.column("row").to_numpy(), counts)
                block = lexicon.block(b, a, np.repeat(contents(words, counts), counts))
                base = int(row.min())
                order = np.argsort(block.astype(np.uint16) if lexicon.blocks <= 1 << 16 else block, kind="stable")  # of 16 bits, in one pass
                block, row, b, a, number = block[order], row[order] - base, b[order], a[order], lexicon.numbers(words)[order]
                part = block // group
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                sizes = [np.bincount(block[s:e] % group, minlength=group).astype("<u4").tobytes() for s, e in parts]
                yield pa.record_batch(
                    [
                        pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(parts), base)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(sizes, pa.binary()),
                        *(pa.array([pack(x[s:e]) for s, e in parts], pa.binary()) for x in (row, b, a, number)),
                    ],
                    names=[c.split()[0] for c in ROUTED.split(", ")],
                )

    return codes.select("row", "codes").where("codes IS NOT NULL").mapInArrow(run, ROUTED)


def repeats_apart(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order drawn by hash in which equal positions lie far from each other, so that each has its own step;
    and for each place of it the first place of an equal position."""
    order = np.argsort(same, kind="stable")
    ordered = same[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(same) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(same)))
    nth = np.arange(len(same)) - np.repeat(first, times)
    with np.errstate(over="ignore"):
        drawn = np.argsort(split_mix(ordered + (nth.astype(_U) << _U(20)), 14), kind="stable")
    place = np.empty(len(same), np.int64)
    place[drawn] = np.arange(len(same))
    return order[drawn], np.repeat(place[first], times)[drawn]


class Level:
    """The softmax of one level of the tree, for the positions of a block that go down to it."""

    def __init__(self, prior: np.ndarray, context: list[np.ndarray], node: np.ndarray, target: np.ndarray, rows: int, seed: int):
        self.prior, self.node, self.target, self.n = prior, node, target, len(node)
        width, mask = prior.shape[1], _U(rows - 1)
        self.weights, self.squares = np.zeros((rows, width), np.float32), np.zeros(rows, np.float32)
        with np.errstate(over="ignore"):
            down = node.astype(_U) << _U(36)
            #: (FEATURES, n) rows of each position's features.
            self.at = np.stack([(split_mix(c + down, seed) & mask).astype(np.uint32) for c in context])
        self.room = [np.empty((min(BATCH, self.n) * FEATURES, width), np.float32) for _ in range(3)]
        self.ones = np.ones((width, 1), np.float32)

    def scores(self, batch: slice | np.ndarray) -> np.ndarray:
        """The bias and the rows of all features: a sparse product."""
        node = self.node[batch]
        z, part = self.room[0][: len(node)], self.room[1][: len(node)]
        np.take(self.prior, node, axis=0, out=z, mode="clip")
        for rows in self.at:
            np.take(self.weights, rows[batch], axis=0, out=part, mode="clip")
            z += part
        return np.clip(z, -HIGHEST, HIGHEST, out=z)

    def _sums(self, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows, and the sum of the gradients of each."""
        kind = np.uint32 if len(self.weights) * BATCH <= 1 << 32 else _U
        key = np.sort((at.astype(kind) * kind(BATCH) + np.arange(len(g), dtype=kind)).ravel())
        row, place = (key // kind(BATCH)).astype(np.int64), (key % kind(BATCH)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        times = np.diff(np.append(start, len(row)))
        total, part = self.room[1][: len(start)], self.room[2]
        np.take(g, place[start], axis=0, out=total, mode="clip")
        for k in range(1, 4):  # most rows occur a few times only
            more = np.flatnonzero(times > k)
            if not len(more):
                break
            total[more] += np.take(g, place[start[more] + k], axis=0, out=part[: len(more)], mode="clip")
        more = np.flatnonzero(times > 4)
        if len(more):
            size = times[more] - 4
            begin = np.cumsum(size) - size
            left = place[np.repeat(start[more] + 4 - begin, size) + np.arange(int(size.sum()))]
            total[more] += np.add.reduceat(np.take(g, left, axis=0, out=part[: len(left)], mode="clip"), begin, axis=0)
        return row[start], total

    def train(self, epochs: int = EPOCHS) -> None:
        whole = self.weights.view(f"V{4 * self.weights.shape[1]}")[:, 0]  # a row as one element
        for s in [*range(0, self.n, BATCH)] * epochs:
            batch = slice(s, s + BATCH)
            g, target = self.scores(batch), self.target[batch]
            np.exp(g, out=g)
            g *= 1 / (g @ self.ones)
            g[np.arange(len(g)), target] -= 1
            rows, total = self._sums(g, self.at[:, batch])
            step = self.squares[rows] + np.einsum("ij,ij->i", total, total) / total.shape[1]
            self.squares[rows] = step
            total *= (RATE / np.sqrt(step + np.float32(1e-4)))[:, None]
            new = np.take(self.weights, rows, axis=0, out=self.room[2][: len(rows)], mode="clip")
            new -= total
            whole[rows] = new.view(whole.dtype)[:, 0]

    def logprobs(self, which: np.ndarray) -> np.ndarray:
        """Natural log of the share that some positions have of their nodes."""
        out = np.zeros(len(which))
        for s in range(0, len(which), BATCH):
            batch = which[s : s + BATCH]
            z, target = self.scores(batch), self.target[batch]
            chosen = z[np.arange(len(z)), target].astype(np.float64)
            np.exp(z, out=z)
            out[s : s + BATCH] = chosen - np.log((z @ self.ones)[:, 0].astype(np.float64))
        return out


class Block:
    """Some contexts' positions, in the order of their training."""

    def __init__(self, lex: Lexicon, b: np.ndarray, a: np.ndarray, number: np.ndarray):
        self.lex, self.n = lex, len(b)
        self.rows = max(1 << 10, 1 << (max(1, self.n) - 1).bit_length())
        with np.errstate(over="ignore"):
            x, y = b.astype(_U), a.astype(_U)
            self.order, self.equal = repeats_apart(split_mix(split_mix(split_mix(x, 11) + y, 12) + number.astype(_U), 13))
            x, y = x[self.order], y[self.order]
            self.context = [split_mix(x, 1), split_mix(split_mix(x, 2) + y, 2), split_mix(y, 3)]
        self.number = number[self.order]

    def levels(self) -> Iterator[tuple[np.ndarray, Level]]:
        """Each level, untrained, and its positions.  No level needs another, so one at a time is in memory."""
        width, v = self.lex.width, self.lex.vocabulary
        rare = np.flatnonzero(self.number >= v)
        leaf = self.number[rare] - v
        kind = self.number.copy()
        kind[rare] = v + leaf // width
        for k in range(LEVELS):
            rest = width ** (LEVELS - 1 - k)
            yield np.arange(self.n), Level(self.lex.prior[k], self.context, kind // (rest * width), kind // rest % width, self.rows, 5 + k)
        if len(rare):
            yield rare, Level(self.lex.prior[LEVELS], [c[rare] for c in self.context], leaf // width, leaf % width, self.rows, 5 + LEVELS)

    def logprobs(self, epochs: int = EPOCHS) -> np.ndarray:
        """Natural log probability of each position's word, after training."""
        total = np.zeros(self.n)
        rare = np.flatnonzero(self.number >= self.lex.vocabulary)
        total[rare] = self.lex.inner[self.number[rare] - self.lex.vocabulary]
        single = self.equal == np.arange(self.n)  # equal positions have the same probability
        for where, level in self.levels():
            level.train(epochs)
            mine = np.flatnonzero(single[where])
            total[where[mine]] += level.logprobs(mine)
        out = np.empty(self.n)
        out[self.order] = total[self.equal]
        return out


#: Sums that a task of the training holds before it hands them on.
SUMS = 1 << 21


def block_scores(routes: DataFrame, lex) -> DataFrame:
    """(row, logprob): sums over the positions of a document that a task has seen."""

    def solve(held: list[dict], lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cuts = np.cumsum([np.frombuffer(h["sizes"], "<u4") for h in held], axis=1, dtype=np.int64)
        whole = {c: [unpacked(h[c], h["n"]) for h in held] for c in ("rows", "b", "a", "word")}
        for k in range(cuts.shape[1]):
            spans = [slice(x[k - 1] if k else 0, x[k]) for x in cuts]
            if any(s.stop > s.start for s in spans):
                row = np.concatenate([x[s] + h["base"] for x, s, h in zip(whole["rows"], spans, held)])
                b, a, number = (np.concatenate([x[s] for x, s in zip(whole[c], spans)]) for c in ("b", "a", "word"))
                yield row, Block(lexicon, b, a, number).logprobs()

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        row, logprob = (np.concatenate(x) for x in zip(*parts))
        rows, back = np.unique(row, return_inverse=True)
        return pa.record_batch([pa.array(rows), pa.array(np.bincount(back, logprob))], names=["row", "logprob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        pieces = chain.from_iterable(batch.to_pylist() for batch in batches)
        for piece in chain(pieces, [None]):
            if held and (piece is None or held[0]["part"] != piece["part"]):
                parts += solve(held, lex.value)
                held = []
                if piece is None or sum(len(p[0]) for p in parts) > SUMS:
                    yield summed(parts)
                    parts = []
            held.append(piece)

    n = int(routes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return routes.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part").mapInArrow(run, "row long, logprob double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, logprob, perplexity): the model is trained on docs, then scores them."""
    spark = docs.sparkSession
    table = coded(docs, id_col, text_col)
    lex = lexicon(counted(table), block)
    rows = table.select("row", "doc_id", F.coalesce(F.octet_length("codes") / 4, F.lit(0)).cast("long").alias("n_words"))
    if lex is None:
        return rows.select("doc_id", "n_words", F.lit(None).cast("double").alias("logprob"), F.lit(None).cast("double").alias("perplexity"))
    given = spark.sparkContext.broadcast(lex)
    group = grouped(lex.blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = block_scores(routed(table, given, group), given).groupBy("row").agg(F.sum("logprob").alias("logprob"))
    mean = F.col("logprob") / F.col("n_words")
    return rows.join(sums, "row", "left").select("doc_id", "n_words", F.round("logprob", 6).alias("logprob"), F.round(F.exp(-mean), 6).alias("perplexity"))
