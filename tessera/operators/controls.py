"""Ranking controls as windows over (query_id, pos).

Input: rows with query_id, pos (rank order), filepath, chunk_type, score.  Each `mark_` function
narrows the boolean column ALIVE and keeps every row, so a chain of them is one pass over each
query's rows, and what each step dropped can be counted in the same pass.  The functions without
the prefix return the rows that are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import is_test_file


def _query():
    return Window.partitionBy("query_id")


def _by_file():
    return Window.partitionBy("query_id", "filepath")


ALIVE = "__alive"


def _left(df: DataFrame, mark: Callable[..., DataFrame], *options) -> DataFrame:
    """The rows that are alive after the step, with what columns it adds."""
    return mark(df.withColumn(ALIVE, F.lit(True)), *options).where(ALIVE).drop(ALIVE)


def _alive(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn(ALIVE, F.col(ALIVE) & F.coalesce(condition, F.lit(False)))


def _several() -> Column:
    """Whether the rows that are alive are of several files."""
    path = F.when(F.col(ALIVE), F.col("filepath"))
    return F.coalesce(F.min(path).over(_query()) != F.max(path).over(_query()), F.lit(False))


def _symbols() -> Column:
    """Whether the file has a row alive that is no file chunk."""
    return F.coalesce(F.max(F.when(F.col(ALIVE), F.col("chunk_type") != "file")).over(_by_file()), F.lit(False))


def _nth(window, condition: Column) -> Column:
    """How many rows up to this one, in rank order, meet the condition."""
    return F.count_if(condition).over(window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))


def mark_relative_threshold(df: DataFrame, factor: float = 0.75, floor: float = 0.4, fallback: int = 3) -> DataFrame:
    """score >= max(floor, factor * best); if none passes, the first `fallback` rows."""
    alive = F.col(ALIVE)
    limit = F.greatest(F.lit(floor), F.max(F.when(alive, F.col("score"))).over(_query()) * factor)
    marked = df.withColumn("__ok", alive & (F.col("score") >= limit))
    marked = marked.withColumn("__n", F.count_if("__ok").over(_query())).withColumn("__rn", F.row_number().over(_query().orderBy(F.desc(ALIVE), F.desc("score"), "pos")))
    return _alive(marked, F.col("__ok") | ((F.col("__n") == 0) & (F.col("__rn") <= fallback))).drop("__ok", "__n", "__rn")


def mark_file_chunk_cap(df: DataFrame, cap: int | None = 2) -> DataFrame:
    """At most `cap` chunks of type file; None is no cap, a negative one is 0."""
    if cap is None:
        return df
    file = F.col("chunk_type") == "file"
    return _alive(df.withColumn("__nth", _nth(_query(), F.col(ALIVE) & file)), ~file | (F.col("__nth") <= max(0, cap))).drop("__nth")


def mark_test_filter(df: DataFrame, include_tests: bool = False, cap: int | None = 2) -> DataFrame:
    """Without test files, then the file cap; where nothing is left, the cap on everything instead."""
    if include_tests:
        return mark_file_chunk_cap(df, cap).withColumn("test_filter_relaxed", F.lit(False))
    marked = df.withColumn("__test", is_test_file("filepath"))
    file = F.col("chunk_type") == "file"
    free = F.col(ALIVE) & ~F.col("__test") & (~file | (F.lit(True) if cap is None else F.lit(max(0, cap) > 0)))
    # something survives the drop and the cap if a row that is no test isn't a file chunk, or the cap lets one through
    marked = marked.withColumn("test_filter_relaxed", F.count_if(free).over(_query()) == 0)
    return mark_file_chunk_cap(_alive(marked, ~F.col("__test") | F.col("test_filter_relaxed")).drop("__test"), cap)


def mark_symbol_priority(df: DataFrame) -> DataFrame:
    """With several files: file chunks go where the file also has a symbol chunk."""
    marked = df.withColumn("__several", _several()).withColumn("__symbols", _symbols())
    return _alive(marked, ~(F.col("__several") & (F.col("chunk_type") == "file") & F.col("__symbols"))).drop("__several", "__symbols")


def mark_per_file_cap(df: DataFrame, cap: int = 5) -> DataFrame:
    """With several files: the first `cap` chunks of each, of any type."""
    marked = df.withColumn("__several", _several()).withColumn("__nth", _nth(_by_file(), F.col(ALIVE)))
    return _alive(marked, ~F.col("__several") | (F.col("__nth") <= cap)).drop("__several", "__nth")


def mark_per_file_controls(df: DataFrame, cap: int = 5) -> DataFrame:
    """Symbol priority, then the cap; whether there are several files is asked before the first."""
    marked = df.withColumn("__many", _several()).withColumn("__symbols", _symbols())
    marked = _alive(marked, ~(F.col("__many") & (F.col("chunk_type") == "file") & F.col("__symbols")))
    marked = marked.withColumn("__nth", _nth(_by_file(), F.col(ALIVE)))
    return _alive(marked, ~F.col("__many") | (F.col("__nth") <= cap)).drop("__many", "__symbols", "__nth")


def relative_threshold(df: DataFrame, factor: float = 0.75, floor: float = 0.4, fallback: int = 3) -> DataFrame:
    return _left(df, mark_relative_threshold, factor, floor, fallback)


def file_chunk_cap(df: DataFrame, cap: int | None = 2) -> DataFrame:
    return _left(df, mark_file_chunk_cap, cap)


def test_filter(df: DataFrame, include_tests: bool = False, cap: int | None = 2) -> DataFrame:
    return _left(df, mark_test_filter, include_tests, cap)


def symbol_priority(df: DataFrame) -> DataFrame:
    return _left(df, mark_symbol_priority)


def per_file_cap(df: DataFrame, cap: int = 5) -> DataFrame:
    return _left(df, mark_per_file_cap, cap)


def per_file_controls(df: DataFrame, cap: int = 5) -> DataFrame:
    return _left(df, mark_per_file_controls, cap)
