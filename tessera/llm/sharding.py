"""Operator 4, sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Documents are laid out in the order of (doc_id, size, text hash), null ids first.  Document d
starts at byte start(d), the sum of all sizes before it, and goes to shard
floor(start(d) * shards / total).  So each shard is a contiguous range of that order and is
off its target by less than one document at either end.

* Null and empty texts have size 0 and lie where their neighbour starts.
* Rows equal in id and text are interchangeable; each is placed once.
* If all sizes are 0, everything is in shard 0.  An empty table gives an empty result.
* Only ids, sizes and hashes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

OUT = ("doc_id", "n_bytes", "start_byte", "shard")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, start_byte, shard) of every row."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.xxhash64(text_col).alias("tie"),
    )
    order = ["doc_id", "n_bytes", "tie"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The partition number is written with the rows: the ranges are drawn once, so that a task
    # that is run again can't see other ones.
    ranged = materialise(sized.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "sizes")
    totals = ranged.groupBy("part").agg(F.sum("n_bytes").alias("bytes")).orderBy("part").collect()  # one row a partition
    offsets, total = [], 0
    for t in totals:
        offsets.append((t["part"], total))
        total += t["bytes"]
    before = spark.createDataFrame(offsets or [(0, 0)], "part int, before long")
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("local", F.coalesce(F.sum("n_bytes").over(w), F.lit(0))).join(F.broadcast(before), "part")
    start = F.col("local") + F.col("before")
    cut = F.lit(0) if total == 0 else F.least(F.expr(f"CAST((CAST(start_byte AS DECIMAL(38,0)) * {int(shards)}) div {total} AS INT)"), F.lit(int(shards) - 1))
    return placed.withColumn("start_byte", start).withColumn("shard", cut.cast("int")).select(*OUT)


SQL = """
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, rowid AS r FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
), placed AS (
  SELECT doc_id, n_bytes,
         coalesce(sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte
  FROM sized
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(start_byte AS BIGINT) AS start_byte,
       CAST(CASE WHEN (SELECT sum(n_bytes) FROM sized) = 0 THEN 0
            ELSE least(floor(CAST(start_byte AS HUGEINT) * {shards} // (SELECT sum(n_bytes) FROM sized)), {shards} - 1) END AS INTEGER) AS shard
FROM placed
"""
