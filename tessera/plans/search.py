"""The search plan: candidates, threshold, rerank, relative threshold, de-duplication, controls, budget, cross-file context.

Many queries run in one job: every row carries query_id.  Up to the candidates it is one
declarative plan over the index; after that each query has `retrieval_k` rows at most.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT_INTENT, INTENT_ALIASES, INTENTS, Settings
from tessera.functions.columns import format_result, mentions_tests, resolve_intent, word_set
from tessera.functions.embedding import Embedder, HashEmbedder, lexical_score
from tessera.operators import controls, folds, references, stats
from tessera.operators.filters import filter_chunks, languages_of, project_root, resolve_directory, with_files
from tessera.operators.search import is_small, search_book_chunks, vector_top_k_batch
from tessera.sources.logs import append_log
from tessera.sources.snapshots import Store

Reranker = Callable[[DataFrame], DataFrame]
RESULT = ("query_id", "rank", "filepath", "chunk_text", "chunk_type", "symbol_name", "start_line", "end_line", "score", "token_count", "is_cross_file_ref", "imports")


def lexical_reranker(df: DataFrame) -> DataFrame:
    """Adds `score` from `query` and `chunk_text`; any function of that form may take its place."""
    return df.withColumn("score", F.round(lexical_score(word_set("query"), word_set("chunk_text")), 6))


def candidates(chunks: DataFrame, files: DataFrame, queries: DataFrame, settings: Settings = Settings(), **filters) -> DataFrame:
    """The retrieval_k most similar chunks of each query, whatever their similarity."""
    pool = filter_chunks(with_files(chunks, files), **filters)
    return vector_top_k_batch(pool, queries.select("query_id", "query_vector"), settings.retrieval_k)


def resolve_budget(max_tokens: int | None, settings: Settings = Settings()) -> int:
    """The requested budget within its limits; None means the configured one."""
    top = settings.result_max_tokens
    return top if max_tokens is None else max(1 if top < 256 else 256, min(max_tokens, top))


#: What each step lets through, as boolean columns of `stages`, in order.
STEPS = ("above", "passed", "distinct", "capped", "controlled", "taken")


def stages(cands: DataFrame, queries: DataFrame, reranker: Reranker = lexical_reranker, settings: Settings = Settings(), include_tests: bool = False, max_file_chunks: int | None = 2, max_tokens: int | None = None) -> DataFrame:
    """All candidates, with a column for each of STEPS that says whether they are still there after it.

    Every step works on the same rows of a query, so candidates are computed once and shuffled once.
    """
    alive = F.col(controls.ALIVE)
    df = cands.drop("rank").join(F.broadcast(queries.select("query_id", "query")) if is_small(queries) else queries.select("query_id", "query"), "query_id")
    df = reranker(df).withColumn(controls.ALIVE, F.col("similarity") >= settings.similarity_threshold).withColumn("above", alive)
    df = df.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("above"), F.desc("score"), F.desc("similarity"), "chunk_id")))
    hierarchical = settings.hierarchical_assembly_enabled
    df = controls.mark_relative_threshold(df, settings.rerank_relative_factor, settings.rerank_score_floor).withColumn("passed", alive)
    df = folds.mark_duplicates(df).withColumn("distinct", alive)
    df = controls.mark_test_filter(df, include_tests, max_file_chunks).withColumn("capped", alive)
    df = (controls.mark_per_file_controls(df, settings.max_symbols_per_file) if hierarchical else df).withColumn("controlled", alive)
    df = folds.mark_token_budget(df, resolve_budget(max_tokens, settings), settings.rerank_top_k_output, settings.per_file_budget_ratio, per_file=hierarchical)
    return df.withColumnRenamed(controls.ALIVE, "taken")


def rank(cands: DataFrame, queries: DataFrame, reranker: Reranker = lexical_reranker, settings: Settings = Settings(), **options) -> DataFrame:
    """Reranked, filtered, assembled rows."""
    return stages(cands, queries, reranker, settings, **options).where("taken").drop(*STEPS)


def counters(queries: DataFrame, steps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, ...) what each step of `stages` let through and dropped, with outcome and reason, for the search log."""
    n = lambda step, name: F.count_if(step).alias(name)
    files = lambda step, name: F.count_if(F.col(step) & (F.col("chunk_type") == "file")).alias(name)
    # the budget's columns are the same in all rows of a query
    counted = steps.groupBy("query_id").agg(
        F.count("*").alias("candidates"), n("above", "above_similarity"), n("passed", "passed_threshold"), n("distinct", "deduplicated_count"), n("capped", "after_tests_and_cap"), n("controlled", "after_per_file"), n("taken", "returned_results"),
        files("distinct", "files_before"), files("capped", "file_chunks_selected"), files("controlled", "files_after"),
        F.max(F.when(F.col("above"), F.col("score"))).alias("top_score"), F.max(F.col("test_filter_relaxed") & F.col("capped")).alias("test_filter_relaxed"),
        *(F.max(F.when(F.col("taken"), F.col(c))).alias(name) for c, name in (("budget_used", "used_tokens"), ("budget_stopped", "token_budget_exhausted"), ("budget_skipped", "per_file_budget_skipped"))),
    )
    df = queries.select("query_id").join(counted, "query_id", "left")
    zero = [c for c in df.columns if c not in ("query_id", "top_score", "test_filter_relaxed", "token_budget_exhausted")]
    df = df.fillna(0, zero).fillna(0.0, ["top_score"]).fillna(False, ["test_filter_relaxed", "token_budget_exhausted"])
    threshold = F.greatest(F.lit(settings.rerank_score_floor), F.col("top_score") * settings.rerank_relative_factor)
    state = F.when(F.col("candidates") == 0, "no_candidates").when(F.col("above_similarity") == 0, "below_similarity_threshold").when(F.col("returned_results") == 0, "empty_after_budget").otherwise("ok")
    # Nothing was taken: because controls left nothing, because de-duplication did, or because the first chunk was too large.
    reason = F.when(F.col("after_per_file") > 0, "first_chunk_exceeded_budget").when(F.col("deduplicated_count") > 0, "no_results_after_controls").otherwise("no_results_after_dedup")
    return df.select(
        "query_id", "candidates", "above_similarity", "passed_threshold", "deduplicated_count", "returned_results", "used_tokens", "token_budget_exhausted", "per_file_budget_skipped", "test_filter_relaxed", "file_chunks_selected",
        F.bround("top_score", 4).alias("top_score"),
        F.bround(threshold, 4).alias("threshold"),
        ((F.col("above_similarity") > 0) & (F.col("top_score") < threshold)).alias("fallback_used"),
        (F.col("above_similarity") - F.col("passed_threshold")).alias("cut_count"),
        (F.col("deduplicated_count") - F.col("after_tests_and_cap")).alias("tests_and_files_dropped"),
        (F.col("file_chunks_selected") - F.col("files_after")).alias("per_file_file_replaced"),
        (F.col("after_tests_and_cap") - F.col("after_per_file") - F.col("file_chunks_selected") + F.col("files_after")).alias("per_file_symbol_capped"),
        state.alias("outcome"),
        F.when(state == "empty_after_budget", reason).alias("reason"),
    )


def search(chunks: DataFrame, files: DataFrame, queries: DataFrame, *, reranker: Reranker = lexical_reranker, settings: Settings = Settings(), **options) -> DataFrame:
    """queries (query_id, query, query_vector) to results, the most relevant first; cross-file context at the end with score 0."""
    return assembled(steps_of(chunks, files, queries, reranker=reranker, settings=settings, **options), chunks, files, settings=settings, **options)


def steps_of(
    chunks: DataFrame, files: DataFrame, queries: DataFrame, *, reranker: Reranker = lexical_reranker, settings: Settings = Settings(), include_tests: bool = False, max_file_chunks: int | None = 2, directory: str | None = None, max_tokens: int | None = None, file_type: str | None = None, **filters,
) -> DataFrame:
    """`stages` of the candidates that the filters let through."""
    project = filters.get("project")
    if directory:
        filters["directory"] = resolve_directory(directory, project, project_root(files, project) if project else None)
    filters["languages"] = languages_of(file_type, settings)
    cands = candidates(chunks, files, queries, settings, **filters)
    return stages(cands, queries, reranker, settings, include_tests=include_tests, max_file_chunks=max_file_chunks, max_tokens=max_tokens)


def assembled(steps: DataFrame, chunks: DataFrame, files: DataFrame, *, settings: Settings = Settings(), max_tokens: int | None = None, project: str | None = None, **_) -> DataFrame:
    """The rows that were taken, with cross-file context where a project is given."""
    taken = steps.where("taken").withColumn("is_cross_file_ref", F.lit(False))
    meta = "context_metadata" in chunks.columns
    imports = F.col("context_metadata.imports") if meta else F.lit(None).cast("array<string>")
    taken = taken.withColumn("imports", imports).withColumn("signature", F.col("context_metadata.signature") if meta else F.lit(None).cast("string"))
    columns = [c for c in RESULT if c != "rank"]
    out = taken.select(*columns, "pos")
    if settings.cross_file_assembly_enabled and project:
        budget = resolve_budget(max_tokens, settings)
        refs = references.chunk_refs(taken)
        more = references.cross_file(refs, chunks.drop("project_id"), files, project, budget, settings.cross_file_max_chunks, settings.cross_file_budget_threshold, max_results=settings.rerank_top_k_output)
        more = more.withColumn("imports", imports).withColumn("pos", F.lit(1_000_000) + F.col("nth"))
        out = out.unionByName(more.select(*columns, "pos"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return out.withColumn("rank", F.row_number().over(order)).select(*RESULT)


def outcome(queries: DataFrame, found: DataFrame, above: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, outcome) from the rows of each stage: no_candidates, below_similarity_threshold, empty_after_budget or ok."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    df = queries.select("query_id")
    for stage, name in ((found, "found"), (above, "above"), (results, "kept")):
        df = df.join(n(stage, name), "query_id", "left")
    state = F.when(F.col("found").isNull(), "no_candidates").when(F.col("above").isNull(), "below_similarity_threshold").when(F.col("kept").isNull(), "empty_after_budget").otherwise("ok")
    return df.select("query_id", state.alias("outcome"))


#: Filters that a log row names.
LOGGED = ("chunk_type", "directory", "file_type", "filepath", "include_tests", "language", "project")


def log_rows(queries: DataFrame, results: DataFrame, duration_ms: float, settings: Settings = Settings(), counted: DataFrame | None = None, tool: str | None = None, max_tokens: int | None = None, **filters) -> DataFrame:
    """Rows for the JSON log: one a query, with its results nested in rank order, and what `counters` counted."""
    result = F.struct(
        "rank",
        F.col("filepath").alias("file"),
        F.format_string("%d-%d", "start_line", "end_line").alias("lines"),
        F.bround("score", 4).alias("score"),
        F.col("symbol_name").alias("symbol"),
        F.col("token_count").alias("tokens"),
        F.col("chunk_type").alias("type"),
    )
    nested = results.groupBy("query_id").agg(F.array_sort(F.collect_list(result)).alias("r"), F.sum(F.col("token_count") + 50).alias("used"))
    df = queries.join(nested, "query_id", "left")
    listed = F.transform(F.coalesce("r", F.array()), lambda x: x.dropFields("rank"))
    intent = resolve_intent("search_intent") if "search_intent" in queries.columns else F.lit(DEFAULT_INTENT)
    asked = [F.lit(filters[c]).alias(c) for c in LOGGED if filters.get(c) is not None]
    budget = [F.lit(settings.rerank_top_k_output).alias("max_results"), F.lit(resolve_budget(max_tokens, settings)).alias("max_tokens"), F.size(listed).alias("returned_results"), F.coalesce("used", F.lit(0)).alias("used_tokens")]
    own = [F.when(F.col("r").isNull(), "empty_after_budget").otherwise("ok").alias("outcome")]
    if counted is not None:
        df = df.join(counted.drop("returned_results", "used_tokens"), "query_id")
        kept = ("candidates", "above_similarity", "passed_threshold", "deduplicated_count", "cut_count", "tests_and_files_dropped", "file_chunks_selected", "fallback_used", "per_file_budget_skipped", "per_file_file_replaced", "per_file_symbol_capped", "test_filter_relaxed", "threshold", "top_score")
        own = [F.col("outcome"), F.col("reason"), F.struct(*kept, F.lit(settings.similarity_threshold).alias("similarity_threshold")).alias("retrieval")]
        budget.append(F.col("token_budget_exhausted"))
    return df.select(
        F.col("query_id").cast("long").alias("seq"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.lit(tool).cast("string").alias("tool"),
        "query",
        *own,
        F.lit(float(duration_ms)).alias("duration_ms"),
        F.struct(*asked, intent.alias("search_intent"), mentions_tests("query").alias("query_mentions_tests")).alias("filters"),
        F.struct(*budget).alias("budget"),
        listed.alias("results"),
    )


def format_results(results: DataFrame) -> DataFrame:
    """(query_id, text): all results of a query as one text, the first on top."""
    head = F.concat(F.lit("## Result "), F.col("rank").cast("string"), F.format_string(" (relevance: %.2f)\n\n", F.col("score").cast("double")), format_result(), F.lit("\n"))
    parts = results.select("query_id", F.struct("rank", head.alias("t")).alias("s")).groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return parts.select("query_id", F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("text"))


def resolve_intent_name(intent: str | None) -> str:
    name = (intent or "").strip().lower()
    name = INTENT_ALIASES.get(name, name)
    return name if name in INTENTS else DEFAULT_INTENT


class Service:
    """The tools of the search service over a store."""

    def __init__(self, store: Store, embedder: Embedder | None = None, reranker: Reranker = lexical_reranker, settings: Settings = Settings()):
        self.store, self.embedder, self.reranker, self.settings = store, embedder or HashEmbedder(), reranker, settings

    def _queries(self, texts: list[str]) -> DataFrame:
        rows = [(n, t, [float(x) for x in self.embedder.embed_query(t)]) for n, t in enumerate(texts)]
        return self.store.spark.createDataFrame(rows, "query_id int, query string, query_vector array<double>")

    def search_codebase(self, query: str | list[str], tool: str = "search_codebase", **options) -> DataFrame:
        """Results of one or many queries.  With a search log configured they are computed at once, and a row is appended for each query."""
        at = self.store.current()
        project = options.get("project")
        chunks = self.store.read("chunks", at, None if project is None else [project]).drop("project_id")  # of one project, its files alone
        files, queries = self.store.read("files", at), self._queries([query] if isinstance(query, str) else query)
        if not self.settings.search_log_path:
            return search(chunks, files, queries, reranker=self.reranker, settings=self.settings, **options)
        start = time.monotonic()
        steps = steps_of(chunks, files, queries, reranker=self.reranker, settings=self.settings, **options).persist()  # retrieval_k rows a query
        found = assembled(steps, chunks, files, settings=self.settings, **options)
        results = self.store.spark.createDataFrame(found.collect(), found.schema)
        took = (time.monotonic() - start) * 1000
        try:
            append_log(log_rows(queries, results, took, self.settings, counters(queries, steps, self.settings), tool, **options), self.settings.search_log_path)
        except Exception as e:  # a log that can't be written fails no search
            warnings.warn(f"search log: {e}", stacklevel=2)
        steps.unpersist()
        return results

    def search_by_file(self, filepath: str, query: str, **options) -> DataFrame:
        return self.search_codebase(query, "search_by_file", filepath=filepath, **options)

    def list_projects(self) -> DataFrame:
        at = self.store.current()
        return stats.list_projects(self.store.read("files", at), self.store.read("chunks", at)).orderBy(F.desc("last_indexed"), "project_id")

    def list_books(self) -> DataFrame:
        at = self.store.current()
        return stats.list_books(self.store.read("books", at), self.store.read("passages", at)).orderBy(F.desc("indexed_at"), "book_id")

    def search_literature(self, query: str, top_k: int = 8, book_id: str | None = None, category: str | None = None) -> DataFrame:
        """Similarity for 25, then the reranker alone: no thresholds, no de-duplication, no budget.  At most 8 rows; 0 means 8."""
        at = self.store.current()
        found = search_book_chunks(self.store.read("passages", at), self.store.read("books", at), self.embedder.embed_query(query), 25, book_id, category)
        scored = self.reranker(found.withColumn("query", F.lit(query)))
        return scored.orderBy(F.desc("score"), F.desc("similarity"), "passage_id").limit(min(top_k or 8, 8)).select("title", "author", "chapter_title", "section", F.col("chunk_text").alias("content"), F.col("score").alias("relevance"))
