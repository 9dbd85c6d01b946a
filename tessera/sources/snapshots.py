"""Tables as immutable snapshots, on any file system that Hadoop reaches.

A commit writes the parts of tables that changed under data/<id>/ and then puts the manifest of
the next version in place by a rename that fails if there is one already.  So readers see all
tables of a commit or none, and of two writers that began from the same version the second
gets a Conflict and begins anew: no update is lost, and no lock outlives its writer.  Nothing
that a reader may hold is overwritten; `vacuum` deletes what no recent version names.

Tables in PARTED have a part for each project.  A part that a commit doesn't touch stays the same files.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "filepath string, file_hash string, language string, last_indexed timestamp, loc long, project_root string, project_id string"
CHUNKS = (
    "chunk_id long, filepath string, chunk_text string, embedding array<float>, start_line int, end_line int, chunk_type string, symbol_name string, "
    "context_metadata struct<filepath:string,imports:array<string>,parent_class:string,signature:string>, token_count long, project_id string"
)
BOOKS = "book_id string, title string, author string, filepath string, category string, chapter_count long, indexed_at timestamp"
PASSAGES = "passage_id long, book_id string, chapter_title string, section string, chunk_text string, embedding array<float>, chunk_index int, token_count long"
SCHEMAS = {"files": FILES, "chunks": CHUNKS, "books": BOOKS, "passages": PASSAGES}
#: By which column a table is parted.
PARTED = {"files": "project_id", "chunks": "project_id"}
MANIFEST = re.compile(r"v(\d{12})\.json")


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


@dataclass(frozen=True)
class Snapshot:
    """Of each table the folder of each part; a table that isn't parted has one, named by the empty string."""

    version: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)


class Store:
    """A folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        for folder in ("manifests", "data"):
            self._fs.mkdirs(self._path(folder))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _listed(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(m[1]) for m in map(MANIFEST.fullmatch, self._listed("manifests")) if m]

    def at(self, version: int) -> Snapshot:
        stream = self._fs.open(self._path(f"manifests/v{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(version, json.loads(text))

    def current(self) -> Snapshot:
        found = self.versions()
        return self.at(found[-1]) if found else Snapshot()

    def read(self, name: str, at: Snapshot | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """A table of the current snapshot, or of one that the caller has pinned; all of it, or some parts' files alone."""
        held = (at or self.current()).tables.get(name, {})
        paths = [held[p] for p in (held if parts is None else sorted(set(parts))) if p in held]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _written(self, name: str, df: DataFrame, folder: str) -> dict[str, str]:
        """The folders of what was written.  Files hold all columns; the folder's name only tells the parts apart."""
        df = df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns)
        if name not in PARTED:
            df.write.parquet(f"{self.root}/{folder}/{name}")
            return {"": f"{self.root}/{folder}/{name}"}
        # rows of a part lie together, so that a commit leaves few files; a large part is split at run time
        df.withColumn("part", F.col(PARTED[name])).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{folder}/{name}")
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(n[5:]): f"{self.root}/{folder}/{name}/{n}" for n in self._listed(f"{folder}/{name}") if n.startswith("part=")}

    def commit(self, base: Snapshot, parts: Iterable[str] | None = None, **tables: DataFrame) -> Snapshot:
        """Replace tables, or the given parts of parted ones, in a version after `base`.

        Raises Conflict if there is such a version already; what was written is then deleted.
        """
        folder = f"data/{uuid.uuid4().hex}"
        chosen = None if parts is None else set(parts)
        after = {name: dict(held) for name, held in base.tables.items()}
        for name, df in tables.items():
            whole = chosen is None or name not in PARTED
            stay = {} if whole else {p: path for p, path in after.get(name, {}).items() if p not in chosen}
            fresh = self._written(name, df if whole else df.where(F.col(PARTED[name]).isin(*chosen)), folder)
            after[name] = stay | fresh
        try:
            self._publish(base.version + 1, json.dumps(after))
        except Conflict:
            self._fs.delete(self._path(folder), True)
            raise
        return Snapshot(base.version + 1, after)

    def _publish(self, version: int, text: str) -> None:
        fresh = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        qualified = lambda path: path.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory())
        try:
            context.rename(qualified(fresh), qualified(self._path(f"manifests/v{version:012d}.json")), rename)
        except Py4JJavaError as e:
            self._fs.delete(fresh, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} is there already") from None
            raise

    def update(self, change: Callable[[Snapshot], object], attempts: int = 5) -> object:
        """change(snapshot), which reads that snapshot and commits on it, again from a newer one after each Conflict."""
        for n in range(attempts):
            try:
                return change(self.current())
            except Conflict:
                if n == attempts - 1:
                    raise
        raise AssertionError("unreachable")

    def reset(self) -> None:
        """Empty files and chunks; books stay."""
        self.update(lambda at: self.commit(at, **{n: self.spark.createDataFrame([], SCHEMAS[n]) for n in ("files", "chunks")}))

    def vacuum(self, keep: int = 10) -> int:
        """Delete all but the last `keep` versions, and the data that only those name; how many folders went.

        A writer that began before may lose what it has written so far, and readers of older
        versions their files: keep more versions than commits happen during the longest of them.
        """
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep]
        named = {path for v in kept for held in self.at(v).tables.values() for path in held.values()}
        old = {path for v in gone for held in self.at(v).tables.values() for path in held.values()} - named
        for v in gone:
            self._fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        for path in old:
            self._fs.delete(self._hadoop.Path(path), True)
        return len(old)
