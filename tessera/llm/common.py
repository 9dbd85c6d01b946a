"""What the operators share: reading tables, Arrow slices of bounded size, scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on.  It bounds a Python worker's memory, whatever
#: the number of rows that Spark puts in an Arrow batch.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as spark.checkpoint.dir names it.

    Where the setting is absent a temporary folder serves, and only in local mode, where
    driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the scratch folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def position(df: DataFrame, name: str | None) -> int | None:
    """Where the column is, None if there is none.  As in Spark, case doesn't matter unless the session says so."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = [k for k, c in enumerate(df.columns) if name is not None and (c == name or not exact and c.lower() == name.lower())]
    if len(found) > 1:
        raise ValueError(f"column {name} is ambiguous")
    return found[0] if found else None


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column by its name, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a row's id and text; rows with both equal share it (nulls included)."""
    return F.xxhash64(F.col(id_col), F.lit("|"), F.col(text_col))


#: Keys that an anti join may broadcast, 8 bytes each; more of them are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose key isn't in `keys`, a small materialised table of distinct 64-bit keys.

    The keys are counted: while they are few the texts stay where they are, beyond that
    both sides are shuffled.  Rows with a null key stay.
    """
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    else:
        keys = keys.hint("shuffle_hash")
    return df.join(keys, column, "left_anti")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with about `limit` bytes of text each, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = batch.column(column)
    lengths = np.asarray(pc.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_text(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    text_col: str = "text",
    limit: int = SLICE_BYTES,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """mapInArrow over slices of bounded text size.  `setup` runs once a task; its result is fn's 2nd argument."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for piece in slices(batch, text_col, limit):
                out = fn(piece, state) if setup else fn(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the n+1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def split_mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mixing of an integer array, the same on every machine."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
