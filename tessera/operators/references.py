"""References between files: which types results name, and where those are declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import imported_symbols, type_refs
from tessera.operators.filters import with_files


def chunk_refs(df: DataFrame, signature: str = "signature", imports: str | None = "imports") -> DataFrame:
    """df with `refs`, the distinct names that a chunk's signature and imports mention."""
    named = F.coalesce(type_refs(signature), F.array().cast("array<string>"))
    if imports:
        named = F.array_union(named, F.coalesce(imported_symbols(imports), F.array().cast("array<string>")))
    return df.withColumn("refs", F.array_sort(named))


def ref_frequency(df: DataFrame) -> DataFrame:
    """(query_id, ref, n): in how many chunks each name occurs; the order is by n, then name."""
    return df.select("query_id", F.explode(F.array_distinct("refs")).alias("ref")).groupBy("query_id", "ref").agg(F.count("*").alias("n"))


def cross_file(results: DataFrame, chunks: DataFrame, files: DataFrame, project: str, max_tokens: int = 8000, max_chunks: int = 3, threshold: float = 0.7, overhead: int = 50, max_results: int | None = None) -> DataFrame:
    """Declarations that results (query_id, filepath, symbol_name, token_count, refs, start_line, end_line) refer to.

    A query that used `threshold` of its budget gets none.  Names that results already show are
    left out, and so are their files.  Of the 2 * max_chunks shortest, those are taken in
    order until max_chunks are there or the rest of the budget would be exceeded.

    A name may be declared anywhere and every query may ask for it, so only those of its shortest declarations
    are joined that a query can take, whichever files it leaves out.  max_results: results of a query at most;
    they are counted if it isn't given.
    """
    used = results.groupBy("query_id").agg(F.sum(F.col("token_count") + overhead).alias("used"))
    open_ = used.where(F.col("used") / max_tokens < threshold)
    names = ref_frequency(results).select("query_id", F.col("ref").alias("symbol_name"))
    shown = results.where("symbol_name IS NOT NULL AND symbol_name <> ''").select("query_id", "symbol_name").distinct()
    wanted = names.join(open_, "query_id").join(shown, ["query_id", "symbol_name"], "left_anti")
    declared = with_files(chunks.where(F.col("chunk_type").isin("declaration", "class")), files.where(F.col("project_id") == project))
    if max_results is None:
        max_results = results.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    # Of one file 2 * max_chunks are enough, and a query leaves out as many files as it has results.
    enough = 2 * max_chunks
    for keys, n in ((("symbol_name", "filepath"), enough), (("symbol_name",), enough * (max_results + 1))):
        shortest = Window.partitionBy(*keys).orderBy("token_count", "chunk_id")
        declared = declared.withColumn("nth", F.row_number().over(shortest)).where(F.col("nth") <= n).drop("nth")
    found = wanted.join(declared, "symbol_name").join(results.select("query_id", "filepath").distinct(), ["query_id", "filepath"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("token_count", "chunk_id")
    ranked = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * max_chunks)
    # The first that exceeds the budget ends it, and so does the count; costs only grow, so a running sum says both.
    running = F.sum(F.col("token_count") + overhead).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = ranked.withColumn("added", running).where((F.col("nth") <= max_chunks) & (F.col("added") <= F.lit(max_tokens) - F.col("used")))
    return fits.withColumn("score", F.lit(0.0)).withColumn("is_cross_file_ref", F.lit(True)).drop("used", "added")
