"""Operator 2, quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes.  Each passage is encoded: square roots of hashed
byte-pair shares, shares of character kinds, and how concentrated they are.  A tanh layer
embeds it, gated attention (tanh times sigmoid) gives it a weight within its document, and
the weighted sum of the embeddings is scored by a logistic unit.  Only documents have labels;
the attention weights are learned from those.

Training takes a bounded sample of labelled documents, SAMPLE of them, drawn by the hash of
their id; scoring reads every passage of every document.  The label is `quality`; `toxic` isn't
used, since a toxic document may well be of high quality.

* Null and blank texts have nothing to score: score 0, rejected.
* Labels that are null, or that contradict each other for one document, or whose document isn't
  there, aren't learned from and don't count for the sample.
* With labels of one class only, or none, there is no model: score null, everything is kept.
* Rows are scored one by one, so repeated rows and null ids pass through with their own score.
* An empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text, position, slices, split_mix, utf8_buffer

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4000
PASSAGE = 1024
BUCKETS = 256
#: Documents that score less are rejected.
THRESHOLD = 0.5
HIDDEN, GATE = 32, 16
STEPS, BATCH, RATE, DECAY = 1500, 64, 3e-3, 1e-4
KINDS = 8

_PAIR = (split_mix(np.arange(1 << 16), 11) % np.uint64(BUCKETS)).astype(np.int64)
_KIND = np.full(256, 7, np.int64)
_KIND[128:] = 6
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,;:'\"()", b"!?")):
    _KIND[list(_set)] = _k
WIDTH = BUCKETS + KINDS + 3


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, one row each, and the number of passages of each text."""
    raw, offsets = utf8_buffer(column)
    sizes = np.diff(offsets)
    counts = -(-sizes // PASSAGE)
    n = int(counts.sum())
    if not n:
        return np.zeros((0, WIDTH), np.float32), counts
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(sizes[doc] - nth * PASSAGE, PASSAGE)
    at = np.repeat(np.arange(n), length)
    pair = _PAIR[(raw[:-1].astype(np.int64) << 8) | raw[1:]]
    inside = at[:-1] == at[1:]  # pairs across passages aren't counted, so neighbours don't matter
    bins = np.bincount((at[:-1] * BUCKETS + pair)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    share = bins / np.maximum(bins.sum(1, keepdims=True), 1)
    kinds = np.bincount(at * KINDS + _KIND[raw], minlength=n * KINDS).reshape(n, KINDS) / length[:, None]
    heavy = (share**2).sum(1)
    entropy = -(share * np.log(np.maximum(share, 1e-9))).sum(1)
    rest = np.stack([np.sqrt(heavy) * 4, entropy / 2 - 2, np.log1p(length) / 4], 1)
    return np.concatenate([np.sqrt(share) * 8, kinds * 4, rest], 1).astype(np.float32), counts


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0)


@dataclass
class Model:
    mean: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        """Scores of bags that have a passage each; counts are those of the bags, in order."""
        p = self.p
        h = np.tanh((x - self.mean) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        start = np.cumsum(counts) - counts
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, start), counts))
        a /= np.repeat(np.add.reduceat(a, start), counts)
        z = _sum_by(a[:, None] * h, counts)
        return 1 / (1 + np.exp(-(z @ p["v"] + p["c"]))), z, a, h, t, g

    def score(self, column: pa.Array) -> np.ndarray:
        x, counts = encode(column)
        out = np.zeros(len(counts))
        some = counts > 0
        if some.any():
            out[some] = self.forward(x, counts[some])[0]
        return out


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the logistic loss.  x: passages of all documents, counts: passages of each, none 0."""
    rng = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "v": (HIDDEN,), "c": (1,)}
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k in "WVUwv" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    model = Model(x.mean(0), p)
    start, step = np.cumsum(counts) - counts, 0
    while step < STEPS:
        order = rng.permutation(len(counts))
        for s in range(0, len(order), BATCH):
            bags = order[s : s + BATCH]
            c = counts[bags]
            rows = np.concatenate([np.arange(start[i], start[i] + counts[i]) for i in bags])
            xb = x[rows]
            y, z, a, h, t, g = model.forward(xb, c)
            d = ((y - labels[bags]) / len(bags)).astype(np.float32)
            grad = {"v": z.T @ d, "c": np.array([d.sum()], np.float32)}
            dz = np.repeat(d[:, None] * p["v"], c, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(_sum_by(a * da, c), c))
            grad["w"] = (t * g).T @ de
            dtg = de[:, None] * p["w"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad["W"], grad["b"] = (xb - model.mean).T @ dh, dh.sum(0)
            step += 1
            for k in p:
                gk = grad[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def training_set(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encoded passages, passages of each document, and its label, of the sample."""
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") > 0).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    ids = ids.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other")
    there = docs.select(F.col(id_col).cast("long").alias("id"))  # ids alone
    drawn = ids.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    y_of = {r["id"]: r["y"] for r in drawn}
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in y_of], "id long"))  # at most `sample` rows

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = encode(piece.column("text"))
        ends = np.cumsum(counts) * x.shape[1] * 2
        data = x.astype("<f2").tobytes()
        return pa.record_batch([piece.column("id"), pa.array([data[e - c * x.shape[1] * 2 : e] for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())], names=["id", "x"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(chosen, "id")
    got = sorted(map_text(source, run, "id long, x binary").collect(), key=lambda r: (r["id"], r["x"]))
    got = [r for r in got if r["x"]]
    counts = np.array([len(r["x"]) // (2 * WIDTH) for r in got], np.int64)
    x = np.frombuffer(b"".join([bytes(r["x"]) for r in got]), "<f2").astype(np.float32).reshape(-1, WIDTH)
    return x, counts, np.array([y_of[r["id"]] for r in got], np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    x, counts, y = training_set(docs, labels, sample, id_col, text_col)
    return train(x, counts, y) if len(set(y.tolist())) == 2 else None


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_passages, score, keep) of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column("text")
        sizes = np.diff(utf8_buffer(column)[1])
        count = pa.array((-(-sizes // PASSAGE)).astype(np.int32))
        if model is None:
            score, keep = pa.nulls(len(column), pa.float64()), pa.array(np.ones(len(column), bool))
        else:
            s = judged(column, model)
            score, keep = pa.array(s), pa.array(s >= threshold)
        return pa.record_batch([piece.column("id"), count, score, keep], names=["doc_id", "n_passages", "score", "keep"])

    return map_text(source, run, "doc_id long, n_passages int, score double, keep boolean")


def judged(column: pa.Array, model: Model) -> np.ndarray:
    """Scores, blank texts included."""
    s = model.score(column)
    blank = pc.or_kleene(pc.utf8_is_space(column), pc.equal(pc.binary_length(column), 0)).fill_null(True)
    s[blank.to_numpy(zero_copy_only=False).astype(bool)] = 0.0
    return s


def filter_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    if model is None:
        return docs
    where = position(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, where):
                kept = piece.filter(pa.array(judged(piece.column(where), model) >= threshold))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)
