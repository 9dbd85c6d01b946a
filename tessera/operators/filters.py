"""Filters, lookups and joins of the chunk tables.  A predicate is only built for a parameter that is given, so it reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings

LOOKUP_ROWS = 10


def resolve_directory(directory: str | None, project: str | None, root: str | None) -> str | None:
    """Absolute prefix, or None: the filter only exists for a directory of a project with a known root."""
    if not directory or not project or not root:
        return None
    return root.rstrip("/") + "/" + directory.strip("/")


def languages_of(file_type: str | None, settings: Settings = Settings()) -> tuple[str, ...] | None:
    return {"code": settings.code_languages, "docs": settings.docs_languages}.get(file_type or "")


def filter_chunks(
    df: DataFrame,
    *,
    directory: str | None = None,
    languages: tuple[str, ...] | list[str] | None = None,
    project: str | None = None,
    chunk_type: str | None = None,
    filepath: str | None = None,
    language: str | None = None,
) -> DataFrame:
    """Equality, list and prefix filters.  In `directory`, _ and % are wildcards, as in LIKE."""
    for column, value in (("filepath", filepath), ("chunk_type", chunk_type), ("language", language), ("project_id", project)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if languages is not None:
        df = df.where(F.col("language").isin(list(languages)))
    if directory is not None:
        df = df.where(F.col("filepath").like(directory + "%"))
    return df


def with_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with the columns of their file; chunks without a file row drop out."""
    keep = [c for c in files.columns if c == "filepath" or c not in chunks.columns]
    return chunks.join(files.select(*keep), "filepath")


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose file isn't known."""
    return chunks.join(files.select("filepath"), "filepath", "left_anti")


def chunks_of(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    return chunks.join(keys.select("filepath"), "filepath", "left_semi")


def symbol_lookup(
    chunks: DataFrame,
    files: DataFrame,
    names: list[str],
    project: str,
    exclude: list[str] | tuple[str, ...] = (),
    chunk_types: tuple[str, ...] | list[str] | None = None,
    limit: int = LOOKUP_ROWS,
) -> DataFrame:
    """Chunks of these exact symbols in a project, the shortest first.  No names: no rows."""
    df = with_files(chunks.where(F.col("symbol_name").isin(names) if names else F.lit(False)), files.where(F.col("project_id") == project))
    if exclude:
        df = df.where(~F.col("filepath").isin(list(exclude)))
    if chunk_types is not None:
        df = df.where(F.col("chunk_type").isin(list(chunk_types)))
    return df.orderBy("token_count", "chunk_id").limit(limit)


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("filepath") == path)


def project_root(files: DataFrame, project: str) -> str | None:
    row = files.where(F.col("project_id") == project).select(F.min("project_root").alias("r")).first()
    return row["r"] if row else None


def project_hashes(files: DataFrame, project: str) -> DataFrame:
    return files.where(F.col("project_id") == project).select("filepath", "file_hash")


def exists(df: DataFrame, column: str, value: object) -> bool:
    return not df.where(F.col(column) == value).isEmpty()


def sample_chunks(chunks: DataFrame, files: DataFrame, project: str, n: int, seed: int = 0) -> DataFrame:
    """n random chunks of a project, without whole files, Markdown and JSON; the same for a seed."""
    df = with_files(chunks.where(F.col("chunk_type") != "file"), files.where((F.col("project_id") == project) & ~F.col("language").isin("markdown", "json")))
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string"))), "chunk_id").limit(n)
