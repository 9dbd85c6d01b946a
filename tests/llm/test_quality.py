import math

import numpy as np
import pyarrow as pa

from tessera.llm import quality

from .conftest import AWKWARD


def test_gradients():
    """The hand-written backward pass against finite differences, through one step of training."""
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(9, 6)), np.array([2, 3, 4]), np.array([1.0, 0.0, 1.0])
    model = quality.Model(np.zeros(6), {k: rng.normal(size=s) * 0.5 for k, s in {"W": (6, 5), "b": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "v": (5,), "c": (1,)}.items()})

    def loss():
        p = model.forward(x, counts)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    p = model.p
    out, z, a, h, t, g = model.forward(x, counts)
    d = (out - y) / 3
    dz = np.repeat(d[:, None] * p["v"], counts, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(quality._sum_by(a * da, counts), counts))
    dtg = de[:, None] * p["w"]
    grads = {"v": z.T @ d, "w": (t * g).T @ de, "V": h.T @ (dtg * g * (1 - t * t)), "U": h.T @ (dtg * t * g * (1 - g))}
    dh = (a[:, None] * dz + (dtg * g * (1 - t * t)) @ p["V"].T + (dtg * t * g * (1 - g)) @ p["U"].T) * (1 - h * h)
    grads["W"], grads["b"] = x.T @ dh, dh.sum(0)
    for k, grad in grads.items():
        for i in list(np.ndindex(p[k].shape))[:8]:
            old = p[k][i]
            p[k][i] = old + 1e-6
            up = loss()
            p[k][i] = old - 1e-6
            down = loss()
            p[k][i] = old
            assert abs((up - down) / 2e-6 - grad[i]) < 1e-6, (k, i)


def test_encoding_is_by_document():
    texts = ["ab" * 900, None, "", "The quick brown fox. " * 80, "é"]
    x, counts = quality.encode(pa.array(texts))
    assert counts.tolist() == [2, 0, 0, 2, 1]
    alone = np.concatenate([quality.encode(pa.array([t]))[0] for t in texts if t])
    assert np.array_equal(x, alone)


def brute(text, model):
    """One document, passage by passage and number by number."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    raw = (text or "").encode()
    if not (text or "").strip():
        return 0.0
    embedded, weights = [], []
    for at in range(0, len(raw), quality.PASSAGE):
        part = raw[at : at + quality.PASSAGE]
        bins, kinds = [0] * quality.BUCKETS, [0] * quality.KINDS
        for a, b in zip(part, part[1:]):
            bins[int(quality._PAIR[a * 256 + b])] += 1
        for c in part:
            kinds[int(quality._KIND[c])] += 1
        pairs = max(1, len(part) - 1)
        share = [n / pairs for n in bins]
        x = [math.sqrt(v) * 8 for v in share] + [n / len(part) * 4 for n in kinds]
        x += [math.sqrt(sum(v * v for v in share)) * 4, -sum(v * math.log(max(v, 1e-9)) for v in share) / 2 - 2, math.log1p(len(part)) / 4]
        x = [a - m for a, m in zip(x, model.mean.tolist())]
        h = [math.tanh(sum(a * w for a, w in zip(x, col)) + bias) for col, bias in zip(p["W"].T.tolist(), p["b"].tolist())]
        t = [math.tanh(sum(a * w for a, w in zip(h, col))) for col in p["V"].T.tolist()]
        g = [1 / (1 + math.exp(-sum(a * w for a, w in zip(h, col)))) for col in p["U"].T.tolist()]
        embedded.append(h)
        weights.append(math.exp(sum(a * b * w for a, b, w in zip(t, g, p["w"].tolist()))))
    z = [sum(w * h[k] for w, h in zip(weights, embedded)) / sum(weights) for k in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * v for a, v in zip(z, p["v"].tolist())) + float(p["c"][0]))))


def test_the_query_against_brute_force(spark, sf_dir, awkward):
    """Scores and verdicts of whole tables, recomputed document by document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    for table in (docs, awkward.select("doc_id", "text")):
        want = sorted(((r["doc_id"], brute(r["text"], model)) for r in table.collect()), key=str)
        got = sorted(((r["doc_id"], r["score"], r["keep"]) for r in quality.classify(table, model).collect()), key=str)
        assert len(got) == len(want)
        by_id = {}
        for i, y in want:
            by_id.setdefault(i, []).append(y)
        for i, y, keep in got:
            assert min(abs(y - w) for w in by_id[i]) < 1e-4 and keep == (y >= quality.THRESHOLD)


def test_blank_texts(make):
    model = quality.Model(np.zeros(quality.WIDTH, np.float32), {"W": np.zeros((quality.WIDTH, 2)), "b": np.ones(2), "V": np.ones((2, 2)), "U": np.ones((2, 2)), "w": np.ones(2), "v": np.ones(2), "c": np.ones(1)})
    texts = ["", None, " ", "\t\r\n", "\u3000\u00a0", " a", "\u3000.", "0"]
    rows = quality.classify(make(texts), model).orderBy("doc_id").collect()
    assert [r["keep"] for r in rows] == [bool(t and t.strip()) for t in texts]


def test_the_sample_is_of_documents_that_are_there(spark, make):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)] + [(1000 + i, 1, 0) for i in range(500)] + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make([f"text number {i} " * 9 for i in range(4)])
    _, counts, y = quality.training_set(docs, labels, 3)
    assert len(counts) == 3 and sorted(y.tolist()) == [0.0, 1.0, 1.0]  # 2 contradicts itself


def test_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = labels.where("doc_id % 3 = 0")
    rows = quality.classify(docs, model).join(held, "doc_id").collect()
    assert len(rows) > 100
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in rows]) >= 0.97
    assert np.mean([r["keep"] for r in rows if r["quality"] == 1]) >= 0.98
    kept = {r["doc_id"] for r in quality.filter_documents(docs, model).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in quality.classify(docs, model).where("keep").collect()}


def test_awkward(spark, awkward, none, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.classify(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(r["score"] is not None for r in rows)
    assert all(r["score"] == 0 and not r["keep"] for r in rows if r["doc_id"] in (3, 4, 5, 6))
    assert quality.filter_documents(awkward, model).columns == awkward.columns
    assert quality.classify(none, model).count() == 0 and quality.filter_documents(none, model).count() == 0
    # labels of one class, none, null, contradicting, or of documents that aren't there
    bad = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (8, 0, 0), (8, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(awkward, bad) is None and quality.fit(awkward, labels.where("false")) is None and quality.fit(none, labels) is None
    free = quality.classify(awkward, None).collect()
    assert all(r["score"] is None and r["keep"] for r in free)
    assert quality.filter_documents(awkward, None).count() == len(AWKWARD)
