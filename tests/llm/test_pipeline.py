import corpus_pipeline as cp
from tessera.llm import bpe, decontamination, pii, quality, queries, simhash

from .conftest import AWKWARD


def test_every_stage_takes_awkward_rows(spark, awkward, none, sf_dir):
    for name, stage in cp.STAGES:
        for docs in (awkward, none):
            out = stage(spark, docs, sf_dir)
            rows = out.collect()
            if name != "bpe":
                assert out.columns == docs.columns
            assert (len(rows) == 0) if docs is none else (len(rows) > 0)


def test_run_against_brute_force(spark, sf_dir):
    """The same decisions taken on the driver, without tables: fingerprints and alignments of all pairs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    keep = {r["doc_id"] for r in quality.classify(docs, model).where("keep").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in keep}
    ids = sorted(texts)
    fp = simhash.fingerprint_texts([texts[i] for i in ids])
    near = simhash.hamming(fp, fp) <= simhash.RADIUS
    label = simhash.forest(len(ids), *near.nonzero())
    ids = [i for n, i in enumerate(ids) if label[n] == n]
    items = [decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaked(words):
        grams = {tuple(words[k : k + 8]) for k in range(len(words))}
        return any(sum(tuple(i[k : k + 8]) in grams for k in range(len(i) - 7)) > len(i) // 2 for i in items)

    ids = [i for i in ids if not leaked(decontamination.words_of(texts[i]))]
    want = {i: pii.redacted(texts[i]) for i in ids}
    got = cp.run(spark, sf_dir)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(got).collect()} == want
    assert all(r["exact"] for r in got.collect())


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    found = queries.queries()
    assert "pipeline" in found and sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op")) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found) and cp.ORACLE_SQL is None and len(AWKWARD) == 15
