"""Retrieval benchmark: a file of questions with what they should find, run through the service, against a saved baseline."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import analytics
from tessera.plans.search import Service
from tessera.sources import logs

QUESTIONS = "query string, category string, expect_files array<string>, expect_symbols array<string>"


def run(service: Service, questions: str, project: str | None = None, **options) -> DataFrame:
    """`analytics.query_metrics` of each line of a JSON file of QUESTIONS.

    All questions are searched in one job, so each one's latency is its share of that.
    """
    spark = service.store.spark
    asked = [r for r in spark.read.schema(QUESTIONS).json(questions).collect() if r["query"]]  # a file that somebody has written
    start = time.monotonic()
    options |= {} if project is None else {"project": project}
    found = service.search_codebase([r["query"] for r in asked], **options).where("NOT is_cross_file_ref")
    row = F.struct("rank", "filepath", "symbol_name", "score")
    nested = {r["query_id"]: r["rows"] for r in found.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).collect()}
    each = (time.monotonic() - start) * 1000 / max(1, len(asked))
    rows = []
    for n, r in enumerate(asked):
        got = nested.get(n, [])
        rows.append((n, r["category"] or "all", [x["filepath"] for x in got], [x["symbol_name"] or "" for x in got], r["expect_files"] or [], r["expect_symbols"] or [], got[0]["score"] if got else 0.0, each))
    schema = "query_id int, category string, files array<string>, symbols array<string>, expect_files array<string>, expect_symbols array<string>, top_score double, latency_ms double"
    return analytics.query_metrics(spark.createDataFrame(rows, schema))


def report(metrics: DataFrame, save: str | None = None, compare: str | None = None) -> dict:
    """Overall and by category, saved or compared on request; a baseline that isn't there compares with nothing."""
    metrics = metrics.persist()
    overall = analytics.metrics_overall(metrics).first().asDict()
    by_category = analytics.metrics_by_category(metrics)
    rows = sorted((r.asDict() for r in by_category.collect()), key=lambda r: r["category"])
    out = {"overall": overall, "by_category": rows}
    if compare and (then := logs.load_baseline(compare)):
        before = [(c, float(r["mrr"] or 0), float(r["avg_score"] or 0)) for c, r in then["by_category"].items()]
        delta = analytics.baseline_delta(by_category, metrics.sparkSession.createDataFrame(before, "category string, mrr double, avg_score double"))
        out["delta"] = sorted((r.asDict() for r in delta.collect()), key=lambda r: r["category"])
    if save:
        logs.save_baseline(save, overall, rows)
    metrics.unpersist()
    return out
