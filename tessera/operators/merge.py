"""Keyed merges, deletions and the comparison of disk and index.  Pure functions of tables; `sources.snapshots` commits them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an upsert changes of a file that is known.  Language, root and project stay those of its first owner.
UPDATED = ("file_hash", "last_indexed", "loc")


def upsert_files(current: DataFrame, incoming: DataFrame, updated: tuple[str, ...] = UPDATED, key: str = "filepath") -> DataFrame:
    """One row a key: new ones whole, known ones with only `updated` changed."""
    new = incoming.select(key, *[F.col(c).alias(f"__{c}") for c in incoming.columns if c != key], F.lit(True).alias("__new"))
    old = current.withColumn("__old", F.lit(True))
    joined = old.join(new, key, "full_outer")

    def pick(c: str):
        if c == key:
            return F.col(key)
        chosen = F.col("__new") if c in updated else F.col("__old").isNull()
        return F.when(F.coalesce(chosen, F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[pick(c) for c in current.columns])


def replace_chunks(current: DataFrame, incoming: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of the given files are replaced by the incoming ones."""
    return current.join(files.select("filepath").distinct(), "filepath", "left_anti").select(*current.columns).unionByName(incoming)


def delete_files(files: DataFrame, chunks: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given files."""
    keys = keys.select("filepath").distinct()
    return files.join(keys, "filepath", "left_anti"), chunks.join(keys, "filepath", "left_anti")


def delete_project(files: DataFrame, chunks: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    return delete_files(files, chunks, files.where(F.col("project_id") == project))


def prune_orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("filepath"), "filepath", "left_semi")


def sync_diff(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(filepath, state) of disk and index (filepath, file_hash): new, deleted, modified or unchanged.

    One full outer join.  A file on disk whose hash is null couldn't be read and is modified.
    """
    d = disk.select("filepath", F.col("file_hash").alias("disk_hash"), F.lit(True).alias("on_disk"))
    i = index.select("filepath", F.col("file_hash").alias("index_hash"), F.lit(True).alias("in_index"))
    state = (
        F.when(F.col("in_index").isNull(), "new")
        .when(F.col("on_disk").isNull(), "deleted")
        .when(F.col("disk_hash").isNull() | (F.col("disk_hash") != F.col("index_hash")), "modified")
        .otherwise("unchanged")
    )
    return d.join(i, "filepath", "full_outer").select("filepath", state.alias("state"))
