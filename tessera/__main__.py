"""Command line: python -m tessera --store DIR VERB ...

Every verb works on the snapshot store DIR.  Watching runs until it is interrupted; on a cluster
the stream is managed by spark.streams.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.embedding import HashEmbedder
from tessera.operators import analytics, stats
from tessera.plans import benchmark, index, search
from tessera.session import local_session, ship
from tessera.sources import logs
from tessera.sources.snapshots import Store
from tessera.streaming.watch import watch, watch_each


def roots(store: Store) -> dict[str, str]:
    return {r["project_id"]: r["project_root"] for r in store.read("files").groupBy("project_id").agg(F.min("project_root").alias("project_root")).collect()}


def show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--store", default=os.environ.get("TESSERA_STORE", "tessera-store"))
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, *arguments: tuple[str, dict]) -> None:
        sub = verbs.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)

    path, project, force = ("path", {}), ("project", {}), ("--force", {"action": "store_true"})
    verb("list")
    verb("stats", ("--project", {}))
    verb("index", path, ("--id", {}), force)
    verb("sync", project, force)
    verb("sync-all", force)
    verb("check", project)
    verb("delete", project)
    verb("prune")
    verb("vacuum", ("--keep", {"type": int, "default": 10}))
    verb("reset")
    verb("watch", ("projects", {"nargs": "*"}), ("--checkpoint", {"required": True}), ("--every", {"default": "30 seconds"}), ("--registry", {}), ("--stagger", {"type": float}))
    verb("benchmark", ("questions", {}), ("--project", {}), ("--save", {}), ("--compare", {}))
    verb("index-books", path, ("--category", {"default": "software"}), force)
    verb("books")
    verb("search", ("query", {}), ("--project", {}), ("--file", {}), ("--file-type", {}), ("--directory", {}), ("--max-tokens", {"type": int}), ("--include-tests", {"action": "store_true"}))
    verb("literature", ("query", {}), ("--book", {}), ("--category", {}), ("--top", {"type": int, "default": 8}))
    verb("analyze", path, ("--since", {}), ("--last", {"type": int}))
    a = parser.parse_args(argv)
    spark = local_session()
    ship(spark)
    store = Store(spark, a.store)
    service = search.Service(store, HashEmbedder(), settings=Settings.from_env())
    at = store.current()
    files, chunks = store.read("files", at), store.read("chunks", at)
    if a.verb == "list":
        show(service.list_projects())
    elif a.verb == "stats":
        show(stats.project_stats(files, chunks, a.project) if a.project else stats.index_stats(files, chunks))
        quality = stats.quality_stats(chunks, files, a.project)
        show(quality)
        show(stats.quality_ratios(quality))
    elif a.verb == "index":
        root = os.path.abspath(a.path)
        print(json.dumps(index.index_project(store, root, a.id or os.path.basename(root), a.force)))
    elif a.verb == "sync":
        print(json.dumps(index.index_project(store, roots(store)[a.project], a.project, a.force)))
    elif a.verb == "sync-all":
        print(json.dumps(index.sync_all(store, roots(store), force=a.force)))
    elif a.verb == "check":
        show(index.check_status(store, roots(store)[a.project], a.project).groupBy("state").count())
    elif a.verb == "delete":
        print(json.dumps(index.delete_project(store, a.project)))
    elif a.verb == "prune":
        index.prune(store)
    elif a.verb == "vacuum":
        print(json.dumps({"deleted": store.vacuum(a.keep)}))
    elif a.verb == "reset":
        store.reset()
    elif a.verb == "watch":
        known = roots(store)
        chosen = {p: known[p] for p in a.projects or known}
        if a.stagger is not None:
            watch_each(store, chosen, a.checkpoint, a.every, a.stagger)
            spark.streams.awaitAnyTermination()
        else:
            watch(store, None if a.registry else chosen, a.checkpoint, a.every, registry=a.registry).awaitTermination()
    elif a.verb == "benchmark":
        print(json.dumps(benchmark.report(benchmark.run(service, a.questions, a.project), a.save, a.compare)))
    elif a.verb == "index-books":
        print(json.dumps(index.index_books(store, a.path, a.category, a.force)))
    elif a.verb == "books":
        show(service.list_books())
    elif a.verb == "search":
        given = {"project": a.project, "filepath": a.file, "file_type": a.file_type, "directory": a.directory, "max_tokens": a.max_tokens}
        found = service.search_codebase(a.query, include_tests=a.include_tests, **{k: v for k, v in given.items() if v is not None})
        text = search.format_results(found).first()
        print(text["text"] if text else "No relevant code found.")
    elif a.verb == "literature":
        show(service.search_literature(a.query, a.top, a.book, a.category))
    elif a.verb == "analyze":
        log = logs.read_log(spark, a.path, a.since, a.last)
        show(analytics.control_counters(log, ("per_file_budget_skipped", "per_file_file_replaced", "per_file_symbol_capped")))
        for report in (analytics.outcomes, analytics.relevance, analytics.efficiency, analytics.latency, analytics.intents):
            show(report(log))


if __name__ == "__main__":
    main()
