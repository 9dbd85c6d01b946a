"""Indexing: one job over the changed files of a project, committed as one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.columns import chapter_title, embedding_text
from tessera.functions.embedding import Embedder, HashEmbedder, embed
from tessera.operators import merge
from tessera.operators.books import book_id, chunk_chapters
from tessera.operators.chunking import chunk_files
from tessera.operators.stats import delete_counts
from tessera.sources.epub import read_epubs
from tessera.sources.files import files_table, list_files, read_files
from tessera.sources.snapshots import CHUNKS, Snapshot, Store


def check_status(store: Store, root: str, project_id: str, settings: Settings = Settings()) -> DataFrame:
    """(filepath, state) without writing: new, modified, deleted, unchanged, skipped_ineligible."""
    disk = read_files(list_files(store.spark, root), settings.max_file_size_kb)
    index = merge_index(store, project_id)
    diff = merge.sync_diff(disk.select("filepath", "file_hash"), index)
    new = disk.join(diff.where("state = 'new'"), "filepath", "left_semi")
    useful = chunk_files(new.where("error IS NULL"), settings).where(F.trim("chunk_text") != "").select("filepath").distinct().withColumn("useful", F.lit(True))
    state = F.when((F.col("state") == "new") & F.col("useful").isNull(), "skipped_ineligible").otherwise(F.col("state"))
    return diff.join(useful, "filepath", "left").select("filepath", state.alias("state"))


def merge_index(store: Store, project_id: str, at: Snapshot | None = None) -> DataFrame:
    return store.read("files", at, [project_id]).where(F.col("project_id") == project_id).select("filepath", "file_hash")


def index_files(store: Store, listing: DataFrame, root: str, project_id: str, gone: DataFrame | None = None, force: bool = False, embedder: Embedder | None = None, settings: Settings = Settings()) -> dict[str, int]:
    """Index what is listed, remove what is gone, commit once; counts by outcome.

    A file that is too large or can't be read keeps its chunks and counts as skipped.  One with
    the hash that is known, in any project, is unchanged.  A changed one that yields no
    chunks is removed.  Only the parts of projects that own one of the files are written; if
    another writer commits meanwhile, the merge is done again on what it left.
    """
    embedder = embedder or HashEmbedder()
    read = read_files(listing, settings.max_file_size_kb).persist()
    held = [read]

    def change(at: Snapshot) -> dict[str, int]:
        files = store.read("files", at)
        known = files.select("filepath", F.col("file_hash").alias("known_hash"))
        changed = read.where("error IS NULL").join(known, "filepath", "left")
        if not force:
            changed = changed.where("known_hash IS NULL OR known_hash <> file_hash")
        changed = changed.drop("known_hash").persist()
        made = chunk_files(changed, settings).where(F.length(F.regexp_replace("chunk_text", r"(?U)\s+", "")) > 0)
        made = made.join(changed.select("filepath", "language"), "filepath")
        made = embed(made.withColumn("__text", embedding_text("language")), embedder, "__text").drop("__text", "language")
        made = made.withColumn("chunk_id", F.xxhash64("filepath", "start_line", "end_line", "chunk_type", "chunk_text")).withColumn("project_id", F.lit(project_id))
        made = made.select(*store.spark.createDataFrame([], CHUNKS).columns).persist()
        held.extend((changed, made))
        with_chunks = made.select("filepath").distinct()
        empty = changed.select("filepath").join(with_chunks, "filepath", "left_anti")
        removed = empty if gone is None else empty.union(gone.select("filepath"))
        counts = {
            "indexed": with_chunks.count(),
            "removed": 0 if gone is None else gone.count(),
            "no_chunks": empty.count(),
            "unchanged": read.where("error IS NULL").count() - changed.count(),
            "skipped": read.where("error = 'file_too_large'").count(),
            "errors": read.where("error IS NOT NULL AND error <> 'file_too_large'").count(),
            "chunks": made.count(),
        }
        # A file that another project owns keeps its owner, and its chunks go to that owner's part.
        owner = files.select("filepath", F.col("project_id").alias("__owner"))
        touched = changed.select("filepath").union(removed).join(owner, "filepath", "left").select(F.coalesce("__owner", F.lit(project_id)).alias("p")).distinct()
        parts = sorted(r["p"] for r in touched.collect())  # a few projects
        if not parts:
            return counts
        incoming = files_table(changed.join(with_chunks, "filepath", "left_semi"), project_id, root)
        placed = made.join(owner, "filepath", "left").withColumn("project_id", F.coalesce("__owner", "project_id")).drop("__owner")
        files, chunks = merge.delete_files(store.read("files", at, parts), store.read("chunks", at, parts), removed)
        store.commit(at, parts, files=merge.upsert_files(files, incoming), chunks=merge.replace_chunks(chunks, placed, with_chunks))
        return counts

    try:
        return store.update(change)
    finally:
        for df in held:
            df.unpersist()


def index_project(store: Store, root: str, project_id: str, force: bool = False, embedder: Embedder | None = None, settings: Settings = Settings()) -> dict[str, int]:
    """Bring a project's index in line with its tree."""
    listing = list_files(store.spark, root)
    gone = merge_index(store, project_id).join(listing.select("filepath"), "filepath", "left_anti").select("filepath")
    return index_files(store, listing, root, project_id, gone, force, embedder, settings)


def sync_all(store: Store, roots: dict[str, str], **options) -> dict[str, int]:
    """Every project (id: root); the counts are added up."""
    total: dict[str, int] = {}
    for project, root in sorted(roots.items()):
        for k, v in index_project(store, root, project, **options).items():
            total[k] = total.get(k, 0) + v
    return total


def delete_project(store: Store, project_id: str) -> dict[str, int]:
    def change(at: Snapshot) -> dict[str, int]:
        files, chunks = store.read("files", at, [project_id]), store.read("chunks", at, [project_id])
        counts = delete_counts(files, chunks, project_id).first().asDict()
        files, chunks = merge.delete_project(files, chunks, project_id)
        store.commit(at, [project_id], files=files, chunks=chunks)
        return counts

    return store.update(change)


def prune(store: Store) -> None:
    """Drop the chunks of files that aren't indexed."""
    store.update(lambda at: store.commit(at, chunks=merge.prune_orphans(store.read("chunks", at), store.read("files", at))))


def index_books(store: Store, folder: str, category: str = "software", force: bool = False, embedder: Embedder | None = None) -> dict[str, int]:
    """Books of a folder; one whose id is known is skipped unless forced."""
    embedder = embedder or HashEmbedder()
    read = read_epubs(store.spark, folder).persist()
    held = [read]

    def change(at: Snapshot) -> dict[str, int]:
        books, passages = store.read("books", at), store.read("passages", at)
        chapters = read.where("error IS NULL").withColumn("book_id", book_id("title"))
        if not force:
            chapters = chapters.join(books.select("book_id"), "book_id", "left_anti")
        chapters = chapters.withColumn("chapter_title", chapter_title("chapter_order", F.col("item_title"), F.col("h1"), F.col("h2"), F.col("h3")))
        made = embed(chunk_chapters(chapters), embedder, "chunk_text").withColumn("passage_id", F.xxhash64("book_id", "chunk_index", "chunk_text")).persist()
        held.append(made)
        incoming = chapters.groupBy("book_id").agg(
            F.min("title").alias("title"), F.min("author").alias("author"), F.min("path").alias("filepath"), F.lit(category).alias("category"), F.count("*").alias("chapter_count"), F.current_timestamp().alias("indexed_at")
        )
        ids = incoming.select("book_id")
        counts = {"books": ids.count(), "passages": made.count(), "errors": read.where("error IS NOT NULL").count()}
        if counts["books"]:
            store.commit(
                at,
                books=books.join(ids, "book_id", "left_anti").unionByName(incoming),
                passages=passages.join(ids, "book_id", "left_anti").unionByName(made.select(*passages.columns)),
            )
        return counts

    try:
        return store.update(change)
    finally:
        for df in held:
            df.unpersist()
