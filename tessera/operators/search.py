"""Vector search: exact cosine top-k, for one query or for a table of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import cosine
from tessera.operators.filters import filter_chunks, with_files


def vector_top_k(df: DataFrame, query: list[float], k: int = 50, id_col: str = "chunk_id", vector_col: str = "embedding", min_similarity: float | None = None) -> DataFrame:
    """The k most similar rows, then those of at least min_similarity.  Ties go to the lower id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = df.where(F.col(vector_col).isNotNull()).withColumn("similarity", cosine(vector_col, q)).orderBy(F.desc("similarity"), id_col).limit(k)
    return top if min_similarity is None else top.where(F.col("similarity") >= min_similarity)


#: Queries that one pass over the vectors takes along.
BROADCAST_QUERIES = 20_000
#: Similarities that a task works on at a time.
CELLS = 1 << 20
#: What a matrix product may differ by from the sum of products; candidates are kept with it, and then summed.
SLACK = 1e-9


def is_small(queries: DataFrame) -> bool:
    """Whether it has been counted to be small enough for a broadcast."""
    return queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES


def similarities(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, pair by pair, in double precision; 0 where one has no length.

    Equal rows give equal results, wherever they stand.
    """
    norm = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1))
    return np.where(norm > 0, (x * q).sum(1) / np.where(norm > 0, norm, 1), 0.0)


def best_of_block(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of the k most similar rows of each query, and of what ties with the last."""
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
    near = unit(q) @ unit(x).T
    if near.shape[1] > k:
        i, j = np.nonzero(near >= np.partition(near, -k, axis=1)[:, -k][:, None] - SLACK)
    else:
        i, j = np.nonzero(np.ones(near.shape, bool))
    s = similarities(x[j], q[i])
    order = np.lexsort((ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], s[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _near(df: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, id, similarity): each task's best of its rows for each query."""
    rows = queries.select("query_id", F.col("query_vector").cast("array<double>")).where("query_vector IS NOT NULL").collect()  # counted, or a part of bounded size
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for n in {len(r[1]) for r in rows}:
        some = [r for r in rows if len(r[1]) == n]
        by_size[n] = ([r[0] for r in some], np.array([r[1] for r in some], np.float64).reshape(len(some), n))
    given = df.sparkSession.sparkContext.broadcast(by_size)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = {f.name: f.dataType.simpleString() for f in queries.schema}
    out = f"query_id {names['query_id']}, `{id_col}` {kinds[id_col]}, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by length: queries, ids, vectors and similarities of the best so far
        for batch in batches:
            sizes = pc.list_value_length(batch.column(vector_col)).to_numpy(zero_copy_only=False)
            for n, (names, q) in given.value.items():
                part = batch.filter(pa.array(sizes == n))
                step = max(1, CELLS // max(1, len(q)))
                for s in range(0, part.num_rows, step):
                    piece = part.slice(s, step)
                    ids = piece.column(id_col).to_numpy(zero_copy_only=False)
                    i, j, sim = best_of_block(ids, _matrix(piece.column(vector_col)), q, k)
                    held.setdefault(n, []).append((i, ids[j], sim))
                    if len(held[n]) > 32:
                        held[n] = [_best(held[n], k)]
        for n, parts in held.items():
            i, ids, sim = _best(parts, k)
            names = given.value[n][0]
            yield pa.record_batch([pa.array([names[m] for m in i.tolist()], schema.field(0).type), pa.array(ids, schema.field(1).type), pa.array(sim)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.sparkSession.createDataFrame([], out).schema)
    whole = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda v: v.isNull() | F.isnan(v))
    return df.where(whole).select(id_col, vector_col).mapInArrow(run, out)


def _best(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, ids, sim = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -sim, i))
    i, ids, sim = i[order], ids[order], sim[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], ids[keep], sim[keep]


def vector_top_k_batch(df: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """df's rows with (query_id, similarity, rank) for each row of queries (query_id, query_vector); ids are unique.

    Rows without an id or a vector, or with a null or NaN in it, are no candidates.

    One pass over ids and vectors scores blocks of rows against all queries as a matrix product; a
    task hands on its k best for each query.  The other columns are fetched for the winners
    alone.  More than BROADCAST_QUERIES queries go in parts, a pass each.
    """
    n = queries.count()
    parts = -(-n // BROADCAST_QUERIES)
    if parts <= 1:
        near = _near(df, queries, k, id_col, vector_col)
    else:
        part = F.pmod(F.xxhash64("query_id"), F.lit(2 * parts))  # half full on average, so none is much too large
        near = reduce(DataFrame.unionByName, [_near(df, queries.where(part == p), k, id_col, vector_col) for p in range(2 * parts)])
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    top = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    extra = [c for c in queries.columns if c not in ("query_id", "query_vector")]
    if extra:
        top = top.join(queries.select("query_id", *extra), "query_id")
    found = df.join(F.broadcast(top) if n * k <= BROADCAST_QUERIES * 50 else top, id_col)
    return found.select(*df.columns, "query_id", *extra, "similarity", "rank")


def search_chunks(chunks: DataFrame, files: DataFrame, query: list[float], k: int = 20, **filters) -> DataFrame:
    """Filtered chunk search: filters, join with files, similarity, top-k."""
    joined = with_files(chunks, files)
    return vector_top_k(filter_chunks(joined, **filters), query, k)


def search_book_chunks(passages: DataFrame, books: DataFrame, query: list[float], k: int = 5, book_id: str | None = None, category: str | None = None) -> DataFrame:
    if book_id is not None:
        books, passages = books.where(F.col("book_id") == book_id), passages.where(F.col("book_id") == book_id)
    if category is not None:
        books = books.where(F.col("category") == category)
    keep = [c for c in books.columns if c == "book_id" or c not in passages.columns]
    return vector_top_k(passages.join(books.select(*keep), "book_id"), query, k, id_col="passage_id")


def lsh_top_k(df: DataFrame, query: list[float], k: int = 50, id_col: str = "chunk_id", vector_col: str = "embedding", bucket_length: float = 0.5, tables: int = 8) -> DataFrame:
    """Approximate alternative on unit vectors: random-projection buckets, then exact cosine on what they give."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    data = df.where(F.col(vector_col).isNotNull()).withColumn("__v", array_to_vector(vector_col))
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=bucket_length, numHashTables=tables, seed=1).fit(data)
    near = model.approxNearestNeighbors(data, Vectors.dense(query), k)
    return vector_top_k(near.select(*df.columns), query, k, id_col, vector_col)
