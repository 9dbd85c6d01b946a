"""Search logs and baselines as JSON lines."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "seq long, ts string, tool string, query string, outcome string, reason string, duration_ms double, "
    "filters struct<chunk_type:string,directory:string,file_type:string,filepath:string,include_tests:boolean,language:string,project:string,query_mentions_tests:boolean,search_intent:string>, "
    "retrieval struct<candidates:long,above_similarity:long,passed_threshold:long,deduplicated_count:long,cut_count:long,tests_and_files_dropped:long,file_chunks_selected:long,similarity_threshold:double,fallback_used:boolean,per_file_budget_skipped:long,per_file_file_replaced:long,per_file_symbol_capped:long,test_filter_relaxed:boolean,threshold:double,top_score:double>, "
    "budget struct<max_results:long,max_tokens:long,returned_results:long,token_budget_exhausted:boolean,used_tokens:long>, "
    "results array<struct<file:string,lines:string,score:double,symbol:string,tokens:long,type:string>>, __bad string"
)


def read_log(spark: SparkSession, path: str, since: str | None = None, last: int | None = None) -> DataFrame:
    """Log rows; blank and malformed lines drop out.

    `since` keeps rows of that time or later, and drops those whose time can't be read; `last`
    then keeps the n latest, by the sequence number that the writer gives, or by time.
    """
    df = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    df = df.where("__bad IS NULL AND (ts IS NOT NULL OR outcome IS NOT NULL OR query IS NOT NULL)").drop("__bad")
    if since is not None:
        df = df.where(F.try_to_timestamp("ts") >= F.lit(since).cast("timestamp"))
    if last is not None:
        df = df.orderBy(F.desc_nulls_last("seq"), F.desc_nulls_last("ts"), F.xxhash64("query", "duration_ms")).limit(last)
    counted = ("per_file_budget_skipped", "per_file_file_replaced", "per_file_symbol_capped")
    return df.select("*", F.col("filters.search_intent").alias("search_intent"), F.col("budget.used_tokens").alias("used_tokens"), *(F.col(f"retrieval.{c}").alias(c) for c in counted))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_baseline(path: str, overall: dict, by_category: list[dict]) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps({"by_category": {r["category"]: r for r in by_category}, "overall": overall}, indent=2, sort_keys=True), "utf-8")


def load_baseline(path: str) -> dict | None:
    source = Path(path)
    return json.loads(source.read_text("utf-8")) if source.exists() else None
