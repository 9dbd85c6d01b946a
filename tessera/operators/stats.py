"""Statistics of the index: by language, by project, of quality, of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = (("function", "functions"), ("class", "classes"), ("method", "methods"), ("file", "file_chunks"), ("declaration", "declarations"))


def _type_counts() -> list[Column]:
    return [F.count_if(F.col("chunk_type") == t).alias(name) for t, name in TYPES]


def _joined(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.join(chunks.select("filepath", "chunk_id", "chunk_type", "token_count"), "filepath", "left")


def index_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """By language.  avg_loc is weighted by chunks, since the join repeats a file for each."""
    return (
        _joined(files, chunks)
        .groupBy("language")
        .agg(
            F.countDistinct("filepath").alias("total_files"),
            F.count("chunk_id").alias("total_chunks"),
            F.countDistinct("project_root").alias("total_projects"),
            F.round(F.avg("token_count")).alias("avg_tokens"),
            F.round(F.avg("loc")).alias("avg_loc"),
            *_type_counts(),
        )
    )


def index_totals(stats: DataFrame) -> DataFrame:
    """Over languages: files and chunks are added, projects are the largest count of any language."""
    return stats.agg(F.sum("total_files").alias("files"), F.sum("total_chunks").alias("chunks"), F.max("total_projects").alias("projects"))


def list_projects(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """total_loc counts a file once for each chunk; total_loc_exact once."""
    own = files.groupBy("project_id", "project_root").agg(F.sum("loc").alias("total_loc_exact"))
    wide = (
        _joined(files, chunks)
        .groupBy("project_id", "project_root")
        .agg(
            F.countDistinct("filepath").alias("file_count"),
            F.count("chunk_id").alias("chunk_count"),
            F.sum("loc").alias("total_loc"),
            F.array_sort(F.collect_set("language")).alias("languages"),
            *([F.max("last_indexed").alias("last_indexed")] if "last_indexed" in files.columns else []),
        )
    )
    return wide.join(own, ["project_id", "project_root"])


def project_stats(files: DataFrame, chunks: DataFrame, project: str) -> DataFrame:
    """By language, of one project; no rows if there is no such project."""
    return (
        _joined(files.where(F.col("project_id") == project), chunks)
        .groupBy("language")
        .agg(F.countDistinct("filepath").alias("files"), F.count("chunk_id").alias("chunks"), *_type_counts())
    )


def delete_counts(files: DataFrame, chunks: DataFrame, project: str) -> DataFrame:
    joined = _joined(files.where(F.col("project_id") == project), chunks)
    return joined.agg(F.countDistinct("filepath").alias("files"), F.count("chunk_id").alias("chunks"))


def quality_stats(chunks: DataFrame, files: DataFrame | None = None, project: str | None = None, low: int = 30, high: int = 600) -> DataFrame:
    """One row of counts.  A callable is "with signature" if it has a symbol name."""
    if files is not None and project is not None:
        chunks = chunks.join(files.where(F.col("project_id") == project).select("filepath"), "filepath")
    call = F.col("chunk_type").isin("function", "method")
    return chunks.agg(
        F.count_if(call).alias("callable_chunks"),
        F.count_if(call & F.col("symbol_name").isNotNull() & (F.col("symbol_name") != "")).alias("with_signature"),
        F.count_if(F.col("token_count") < low).alias("tiny_chunks"),
        F.count_if(F.col("token_count") > high).alias("oversized_chunks"),
        F.count_if(F.col("chunk_type") == "file").alias("file_chunks"),
        F.count("*").alias("total_chunks"),
    )


def quality_ratios(stats: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * 100, 6)).otherwise(F.lit(0.0))
    return stats.select(part("with_signature", "callable_chunks").alias("signature_pct"), part("file_chunks", "total_chunks").alias("file_chunk_pct"))


def list_books(books: DataFrame, passages: DataFrame) -> DataFrame:
    counts = passages.groupBy("book_id").agg(F.count("*").alias("n"))
    return books.join(counts, "book_id", "left").withColumn("chunk_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def fanout_rollup(parents: DataFrame, children: DataFrame, key: str, child_key: str, group: str, value: str) -> DataFrame:
    """Parents left-joined to children: distinct parents, children, the parent value as the join repeats it, and once."""
    slim = children.groupBy(child_key).agg(F.count("*").alias("__n"))  # so the join carries a row a key, not a row a child
    joined = parents.join(slim, parents[key] == slim[child_key], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return joined.groupBy(group).agg(
        F.countDistinct(key).alias("parents"),
        F.sum("__n").alias("children"),
        F.round(F.sum(F.col(value) * F.greatest("__n", F.lit(1))), 2).alias("value_repeated"),
        F.round(F.sum(value), 2).alias("value_once"),
    )
