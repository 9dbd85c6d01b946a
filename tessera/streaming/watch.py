"""Watching trees as a stream: a Python data source that polls, and a sink that indexes each batch.

The offset is the time of the last poll and the files then known.  A poll gives the files with
an mtime since then (less a second), and those that have gone.  The built-in file source
gives neither changes to a known file nor deletions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.index import index_files, index_project
from tessera.sources.files import LISTING, collect_files
from tessera.sources.snapshots import Store

CHANGES = f"project_id string, root string, change string, {LISTING}"


class TreeReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.fixed = json.loads(options.get("projects", "{}"))
        self.registry = options.get("registry")

    def roots(self) -> dict[str, str]:
        """Project id to root.  A registry file is read at every poll, so projects may come and go."""
        if self.registry:
            return json.loads(Path(self.registry).read_text("utf-8"))
        return self.fixed

    def initialOffset(self) -> dict:
        return {"last_poll": 0.0, "known": {}}

    def _poll(self, start: dict) -> tuple[list[tuple], dict]:
        began, rows, known = time.time(), [], {}
        for project, root in sorted(self.roots().items()):
            listed = collect_files(root)
            known[project] = sorted(p for p, *_ in listed)
            before = set(start["known"].get(project, []))
            for path, size, mtime, language in listed:
                if mtime >= start["last_poll"] - 1 or path not in before:
                    rows.append((project, root, "changed", path, size, mtime, language))
            rows += [(project, root, "deleted", p, None, None, None) for p in sorted(before - set(known[project]))]
        return rows, {"last_poll": began, "known": known}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._poll(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that is run again: what is on disk now; indexing it is idempotent."""
        return iter(self._poll(start)[0])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_tree"

    def schema(self) -> str:
        return CHANGES

    def simpleStreamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def changes(spark: SparkSession, projects: dict[str, str] | None = None, registry: str | None = None) -> DataFrame:
    """The stream of changes of one or many projects."""
    spark.dataSource.register(TreeSource)
    reader = spark.readStream.format("tessera_tree")
    return (reader.option("registry", registry) if registry else reader.option("projects", json.dumps(projects or {}))).load()


def apply_changes(store: Store, **options):
    """A foreachBatch function that commits one snapshot for each project with changes."""

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for row in batch.select("project_id", "root").distinct().orderBy("project_id").collect():  # a few projects
            mine = batch.where(F.col("project_id") == row["project_id"])
            listing = mine.where("change = 'changed'").select("filepath", "size", "mtime", "language")
            gone = mine.where("change = 'deleted'").select("filepath")
            index_files(store, listing, row["root"], row["project_id"], gone, **options)
        batch.unpersist()

    return apply


PREFIX = "tessera_watch"


def watch(store: Store, projects: dict[str, str] | None, checkpoint: str, every: str = "30 seconds", once: bool = False, initial_sync: bool = True, registry: str | None = None, name: str = PREFIX, **options) -> StreamingQuery:
    """Keep projects in step with their trees.

    projects maps ids to roots; a registry file of the same form is read at every poll instead,
    so projects may come and go while the stream runs.
    """
    if initial_sync:
        for project, root in sorted((projects or (json.loads(Path(registry).read_text("utf-8")) if registry else {})).items()):
            index_project(store, root, project, **options)
    writer = changes(store.spark, projects, registry).writeStream.foreachBatch(apply_changes(store, **options)).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def watch_each(store: Store, projects: dict[str, str], checkpoints: str, every: str = "30 seconds", stagger: float = 2.0, **options) -> dict[str, StreamingQuery]:
    """A stream of its own for each project, begun `stagger` seconds apart so that their polls don't fall together."""
    out = {}
    for n, (project, root) in enumerate(sorted(projects.items())):
        if n:
            time.sleep(stagger)
        out[project] = watch(store, {project: root}, f"{checkpoints}/{quote(project, safe='')}", every, name=f"{PREFIX}:{project}", **options)
    return out


def watchers(spark: SparkSession) -> list[dict]:
    """The session's watching streams: name, id, and whether it is active, with the last batch."""
    return [{"name": q.name, "id": str(q.id), "active": q.isActive, "batch": (q.lastProgress or {}).get("batchId")} for q in spark.streams.active if q.name and q.name.startswith(PREFIX)]


def stop(spark: SparkSession, name: str | None = None) -> list[str]:
    """Stop one watching stream, or all of them; the names of those stopped.  A checkpoint lets each go on later."""
    stopped = []
    for q in spark.streams.active:
        if q.name and q.name.startswith(PREFIX) and name in (None, q.name, q.name.removeprefix(f"{PREFIX}:")):
            q.stop()
            stopped.append(q.name)
    return stopped
