"""Source trees: a pruned walk on the driver, reading and hashing on the executors."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import IGNORED_NAMES, IGNORED_PARTS
from tessera.operators.chunking import language_of

LISTING = "filepath string, size long, mtime double, language string"


def collect_files(root: str, names: frozenset[str] = IGNORED_NAMES, parts: tuple[str, ...] = IGNORED_PARTS) -> list[tuple[str, int, float, str]]:
    """(path, size, mtime, language) of the files that are read; ignored directories aren't entered."""
    out = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in names)
        for name in sorted(files):
            language = language_of(name)
            if language and name not in names and not any(p in name for p in parts):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:  # gone since it was listed
                    continue
                out.append((path, stat.st_size, stat.st_mtime, language))
    return out


def list_files(spark: SparkSession, root: str, **rules) -> DataFrame:
    return spark.createDataFrame(collect_files(root, **rules), LISTING)


def _read(path: str) -> tuple[str | None, str | None, str | None]:
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError as e:
        return None, None, f"unreadable: {e.strerror}"
    try:
        return raw.decode("utf-8"), hashlib.sha256(raw).hexdigest(), None
    except UnicodeDecodeError:
        return None, hashlib.sha256(raw).hexdigest(), "not_utf8"


def read_files(listing: DataFrame, max_size_kb: int = 500) -> DataFrame:
    """The listing with content, file_hash and error; a file that is too large isn't opened."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(None, None, "file_too_large") if size / 1024 > max_size_kb else _read(path) for path, size in zip(pdf.filepath, pdf["size"])]
            yield pdf.assign(content=[r[0] for r in rows], file_hash=[r[1] for r in rows], error=[r[2] for r in rows])

    return listing.mapInPandas(run, LISTING + ", content string, file_hash string, error string")


def files_table(read: DataFrame, project_id: str, project_root: str) -> DataFrame:
    """Rows of the files table."""
    loc = F.size(F.split("content", "\n", -1)).cast("long")
    return read.where("error IS NULL").select(
        "filepath", "file_hash", "language", F.current_timestamp().alias("last_indexed"), loc.alias("loc"), F.lit(project_root).alias("project_root"), F.lit(project_id).alias("project_id")
    )
