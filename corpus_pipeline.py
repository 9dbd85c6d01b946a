"""The corpus pipeline: from raw documents to token ids.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again before the next one.  All but the last return the
columns of documents.  Every stage works on all rows that the one before kept:

1. quality: the classifier is fitted on labelled rows among docs; what it rejects goes.
2. near_dedup: one document of each group of near copies stays, the one of least doc_id.
3. decontaminate: documents that hold a passage of a benchmark item go.
4. pii: spans of personal data are replaced by their kind in brackets, n_chars is set anew.
5. bpe: (doc_id, tokens, n_tokens, exact) of each remaining document.

* Null and blank texts are rejected by the classifier; without labels of both classes there is none, and
  they go through: a null text is in no group, leaks nothing, stays null and has null tokens.
* Repeated rows, and rows that agree in id and text, are copies: one stays.  Rows of one id with
  different texts are different documents.  A null doc_id is kept like any other.
* Ties: the copy of least doc_id stays, then of least text hash, then whose columns as JSON come first.
* An empty table gives an empty result.  Further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontamination, pii, quality, simhash
from tessera.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: A trained classifier, near copies and alignments can't be expressed in SQL; tests compare
#: run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
