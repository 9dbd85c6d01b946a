"""Order-dependent steps over the few ranked rows of each query: de-duplication and the token budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.controls import ALIVE


def dedup_positions(rows: list[tuple[str, int, int, str, float]], text_limit: float = 0.85, line_limit: float = 0.25) -> list[int]:
    """Indices kept of (filepath, start, end, text, score) in rank order.

    A row that overlaps a kept one of its file by line_limit of either is dropped, or takes its
    place if its score is strictly higher; the first overlapping kept row decides.  Then a
    row whose words are more than text_limit like those of any kept text is dropped.  A
    row that was replaced stays away even if its successor is dropped.
    """
    kept: list[int] = []  # indices, in the order of keeping
    texts: dict[str, frozenset[str]] = {}
    for n, (path, start, end, text, score) in enumerate(rows):
        loser = None
        drop = False
        for m in kept:
            other = rows[m]
            if other[0] != path:
                continue
            shared = max(0, min(end, other[2]) - max(start, other[1]) + 1)
            sizes = [x for x in (end - start + 1, other[2] - other[1] + 1) if x > 0]
            if sizes and shared / min(sizes) >= line_limit:
                loser, drop = (m, False) if score > other[4] else (None, True)
                break
        if drop:
            continue
        if loser is not None:
            kept.remove(loser)
            texts.pop(rows[loser][3].strip().lower(), None)
        body = text.strip().lower()
        words = frozenset(body.split())
        if any(words and w and len(words & w) / len(words | w) > text_limit for w in texts.values()):
            continue
        kept.append(n)
        texts[body] = words
    return kept


def mark_duplicates(df: DataFrame, text_limit: float = 0.85, line_limit: float = 0.25) -> DataFrame:
    """ALIVE narrowed to the rows that survive.  One group is one query's candidates; whole rows pass through as Arrow."""
    alive = df.columns.index(ALIVE)

    def fold(group: pa.Table) -> pa.Table:
        taken = np.flatnonzero(group.column(ALIVE).to_numpy())
        taken = taken[np.argsort(group.column("pos").to_numpy()[taken], kind="stable")]
        rows = list(zip(*(group.column(c).take(pa.array(taken)).to_pylist() for c in ("filepath", "start_line", "end_line", "chunk_text", "score"))))
        kept = np.zeros(group.num_rows, bool)
        kept[taken[dedup_positions(rows, text_limit, line_limit)]] = True
        return group.set_column(alive, ALIVE, pa.array(kept))

    return df.groupBy("query_id").applyInArrow(fold, df.schema)


def deduplicate(df: DataFrame, text_limit: float = 0.85, line_limit: float = 0.25) -> DataFrame:
    """Rows (query_id, pos, filepath, start_line, end_line, chunk_text, score, ...) that survive."""
    return mark_duplicates(df.withColumn(ALIVE, F.lit(True)), text_limit, line_limit).where(ALIVE).drop(ALIVE)


def mark_token_budget(df: DataFrame, max_tokens: int = 8000, max_results: int = 8, file_ratio: float = 0.45, overhead: int = 50, per_file: bool = True) -> DataFrame:
    """Greedy assembly in rank order, with budget_used, budget_stopped, budget_skipped of its query.

    The total budget and the number of results stop it; a file's share only skips a row.  With
    one file there is no share.  A native fold over an array of each query's rows, made by a window.
    """
    file_budget = int(max_tokens * file_ratio)
    share = "cardinality(array_distinct(transform(__items, i -> i.filepath))) > 1" if per_file else "false"
    item = F.when(F.col(ALIVE), F.struct("pos", "filepath", F.col("token_count").cast("long").alias("tokens")))
    cost = f"(x.tokens + {overhead})"

    def state(total: str, stop: str, skipped: str, files: str, taken: str) -> str:
        return f"named_struct('total', {total}, 'stop', {stop}, 'skipped', {skipped}, 'files', {files}, 'taken', {taken})"

    position = df.schema["pos"].dataType.simpleString()
    keep = ("s.total", "s.stop", "s.skipped", "s.files", "s.taken")
    files = f"map_concat(map_filter(s.files, (k, v) -> k <> x.filepath), map(x.filepath, coalesce(s.files[x.filepath], 0L) + {cost}))"
    fold = f"""aggregate(__items, {state("0L", "false", "0L", "cast(map() as map<string,bigint>)", f"cast(array() as array<{position}>)")}, (s, x) ->
      CASE WHEN s.stop OR cardinality(s.taken) >= {max_results} THEN s
           WHEN s.total + {cost} > {max_tokens} THEN {state("s.total", "true", *keep[2:])}
           WHEN {share} AND coalesce(s.files[x.filepath], 0L) + {cost} > {file_budget} THEN {state("s.total", "s.stop", "s.skipped + 1L", *keep[3:])}
           ELSE {state(f"s.total + {cost}", "s.stop", "s.skipped", files, "array_append(s.taken, x.pos)")} END)"""
    whole = Window.partitionBy("query_id")
    # the fold runs once a query, on its first row; the others take it from there
    first = Window.partitionBy("query_id").orderBy("pos")
    marked = df.withColumn("__items", F.when(F.row_number().over(first) == 1, F.array_sort(F.collect_list(item).over(whole))))
    marked = marked.withColumn("__s", F.max(F.when(F.col("__items").isNotNull(), F.expr(fold).dropFields("files"))).over(whole)).drop("__items")
    marked = marked.withColumn(ALIVE, F.col(ALIVE) & F.array_contains("__s.taken", F.col("pos")))
    return marked.withColumns({"budget_used": F.col("__s.total"), "budget_stopped": F.col("__s.stop"), "budget_skipped": F.col("__s.skipped")}).drop("__s")


def token_budget(df: DataFrame, max_tokens: int = 8000, max_results: int = 8, file_ratio: float = 0.45, overhead: int = 50, per_file: bool = True) -> DataFrame:
    """The rows that the budget takes."""
    return mark_token_budget(df.withColumn(ALIVE, F.lit(True)), max_tokens, max_results, file_ratio, overhead, per_file).where(ALIVE).drop(ALIVE)
