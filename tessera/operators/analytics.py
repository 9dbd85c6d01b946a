"""Search-log reports and retrieval metrics.

A log row has outcome, duration_ms, search_intent, results (array of structs with score, type,
tokens, file), used_tokens and the per-file counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT_INTENT, OUTCOMES


def outcomes(log: DataFrame, known: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """Count and share of all rows for each known outcome, 0 where none."""
    spark = log.sparkSession
    names = spark.createDataFrame([(o,) for o in known], "outcome string")
    counted = log.groupBy("outcome").agg(F.count("*").alias("c"))
    total = log.agg(F.count("*").alias("total"))
    joined = names.join(counted, "outcome", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("c", F.lit(0)).cast("long")
    return joined.select("outcome", n.alias("n"), F.when(F.col("total") > 0, F.round(n / F.col("total") * 100, 6)).otherwise(F.lit(0.0)).alias("pct"))


def _percentile(value: Column | str, p: float) -> Column:
    """Linear interpolation at (n - 1) * p; 0 over nothing."""
    return F.round(F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0)), 6)


def latency(log: DataFrame) -> DataFrame:
    d = F.col("duration_ms")
    return log.where(d.isNotNull()).agg(_percentile(d, 0.5).alias("p50"), _percentile(d, 0.95).alias("p95"), F.round(F.coalesce(F.max(d), F.lit(0)).cast("double"), 6).alias("max"), F.count("*").alias("n"))


def relevance(log: DataFrame) -> DataFrame:
    """Over rows with results: best score and mean of the first five, mean, p50 and p25."""
    scores = F.transform("results", lambda r: r["score"].cast("double"))
    five = F.slice(scores, 1, 5)
    df = log.where(F.size("results") > 0).select(scores[0].alias("top1"), (F.aggregate(five, F.lit(0.0), lambda s, x: s + x) / F.size(five)).alias("top5"))
    out = []
    for c in ("top1", "top5"):
        out += [F.round(F.avg(c), 6).alias(f"{c}_mean"), _percentile(c, 0.5).alias(f"{c}_p50"), _percentile(c, 0.25).alias(f"{c}_p25")]
    return df.agg(*out)


def efficiency(log: DataFrame) -> DataFrame:
    files = F.size(F.filter("results", lambda r: r["type"] == "file"))
    df = log.select("used_tokens", F.size("results").alias("n"), files.alias("f"))
    return df.agg(
        F.round(F.avg("used_tokens"), 6).alias("tokens_mean"),
        _percentile("used_tokens", 0.5).alias("tokens_p50"),
        F.max("used_tokens").alias("tokens_max"),
        F.round(F.avg("n"), 6).alias("returned_mean"),
        _percentile("n", 0.5).alias("returned_p50"),
        F.when(F.sum("n") > 0, F.round(F.sum("f") / F.sum("n") * 100, 6)).otherwise(F.lit(0.0)).alias("file_pct"),
    )


def control_counters(log: DataFrame, counters: tuple[str, ...]) -> DataFrame:
    """Total, and mean over all rows, of each counter; null counts as 0."""
    cols = []
    for c in counters:
        v = F.coalesce(F.col(c), F.lit(0))
        cols += [F.sum(v).cast("long").alias(f"{c}_total"), F.round(F.avg(v), 6).alias(f"{c}_mean")]
    return log.agg(*cols)


def intents(log: DataFrame) -> DataFrame:
    name = F.when(F.col("search_intent").isNull() | (F.col("search_intent") == ""), F.lit(DEFAULT_INTENT)).otherwise(F.col("search_intent"))
    return log.groupBy(name.alias("intent")).agg(F.count("*").alias("n"))


def file_hit(files: Column, expected: Column) -> Column:
    """A returned file equals or ends with an expected one, after / or \\."""
    ends = lambda f: F.exists(expected, lambda e: (f == e) | F.endswith(f, F.concat(F.lit("/"), e)) | F.endswith(f, F.concat(F.lit("\\"), e)))
    return F.exists(files, ends)


def query_metrics(df: DataFrame) -> DataFrame:
    """df: query_id, category, files, symbols, expect_files, expect_symbols, top_score, latency_ms.

    Without an expectation a hit is true and the reciprocal rank 1; the flags say whether there was one.
    """
    out = df
    for k in (1, 3, 5):
        out = out.withColumn(f"file_hit_{k}", (F.size("expect_files") == 0) | file_hit(F.slice("files", 1, k), F.col("expect_files")))
        # The lambda variables of nested functions need the outer one first.
        symbol = F.exists(F.slice("symbols", 1, k), lambda s: F.exists("expect_symbols", lambda e: F.contains(s, e)))
        out = out.withColumn(f"symbol_hit_{k}", (F.size("expect_symbols") == 0) | F.coalesce(symbol, F.lit(False)))
    flags = F.transform("files", lambda f: F.exists("expect_files", lambda e: (f == e) | F.endswith(f, F.concat(F.lit("/"), e)) | F.endswith(f, F.concat(F.lit("\\"), e))))
    first = F.array_position(flags, F.lit(True))
    rr = F.when(F.size("expect_files") == 0, F.lit(1.0)).when(first > 0, 1.0 / first).otherwise(F.lit(0.0))
    return out.withColumn("rr", rr).withColumn("has_files", F.size("expect_files") > 0)


def _metric_columns() -> list[Column]:
    own = lambda c: F.round(F.avg(F.when(F.col("has_files"), c)), 6)
    return [
        F.count("*").alias("queries"),
        *[own(F.col(f"file_hit_{k}").cast("double")).alias(f"hit_{k}") for k in (1, 3, 5)],
        own(F.col("rr")).alias("mrr"),
        F.round(F.avg("top_score"), 6).alias("avg_score"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    ]


def metrics_by_category(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("category").agg(*_metric_columns())


def metrics_overall(metrics: DataFrame) -> DataFrame:
    """From the queries, not from the categories' means."""
    return metrics.agg(*_metric_columns())


def baseline_delta(now: DataFrame, then: DataFrame) -> DataFrame:
    old = then.select("category", F.col("mrr").alias("__mrr"), F.col("avg_score").alias("__score"))
    return now.join(old, "category", "left").select("category", F.round(F.col("mrr") - F.col("__mrr"), 6).alias("mrr_delta"), F.round(F.col("avg_score") - F.col("__score"), 6).alias("avg_score_delta"))


def intent_contest(scores: DataFrame, k: int = 5, default: str = "default") -> DataFrame:
    """scores: query_id, intent, intent_no, score.  The intent with the best mean of its top k scores, lowest number on ties."""
    top = scores.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "intent").orderBy(F.desc("score")))).where(F.col("rn") <= k)
    mean = top.groupBy("query_id", "intent", "intent_no").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    best = F.max_by("intent", F.struct("mean_score", -F.col("intent_no"))).alias("winner")
    base = F.max(F.when(F.col("intent") == default, F.col("mean_score")))
    return mean.groupBy("query_id").agg(best, F.max("mean_score").alias("best_score"), F.round(F.max("mean_score") - base, 6).alias("delta"))
