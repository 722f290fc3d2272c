"""Embeddings and exact vector retrieval for a table of queries."""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import map_arrow, written
from ..functions import text as T
from .access import in_department, visible
from .lexical import DIGITS, INDEX_LENGTH, INDEX_TOKENS, token_lists, with_index_tokens

#: Queries of a block, and rows of a tile, about: what a task multiplies at a time.
BLOCK, TILE = 1024, 1024
#: Rows to which cells are fitted, about, and most cells.
SAMPLE, MOST_CELLS = 4000, 256
OVERFETCH = 4
#: Rounding of sums and distances is less.
SLACK = 1e-6


def hash_dimension(model: str) -> int:
    """Of hash://N; 384 if that is no number or another model's name."""
    try:
        return max(1, int(model.split("hash://", 1)[1]))
    except (IndexError, ValueError):
        return 384


def bucket(term: Column, dimension: int) -> Column:
    """First eight bytes of the term's md5, little end first, modulo the dimension."""
    digest = F.md5(term.cast("binary"))
    total = F.lit(0).cast("long")
    for i in range(8):
        total = total + F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("long") * F.lit(pow(256, i, dimension))
    return F.pmod(total, F.lit(dimension)).cast("int")


def _buckets(terms: pa.Array, dimension: int) -> np.ndarray:
    """bucket() of each term. A batch's rare terms are hardly those of the next, so none are remembered."""
    digests = b"".join([hashlib.md5(t).digest() for t in terms.cast(pa.binary()).to_pylist()])
    return (np.frombuffer(digests, "<u8")[::2] % np.uint64(dimension)).astype(np.int64)


def hash_vectors(token_lists: pa.ListArray | list[list[str]], dimension: int) -> np.ndarray:
    """Counts by bucket, each row of length 1; rows without tokens are 0. Each different token is hashed once."""
    lists = token_lists if isinstance(token_lists, pa.ListArray) else pa.array(token_lists, pa.list_(pa.string()))
    n = len(lists)
    coded = lists.flatten().dictionary_encode()
    buckets = _buckets(coded.dictionary, dimension)
    row = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy())
    out = np.bincount(row * dimension + buckets[coded.indices.to_numpy()], minlength=n * dimension).reshape(n, dimension).astype(float)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class Embedding:
    """A backend by model name. hash://N is built in; another needs its package on the executors, and falls back to
    hash vectors where it can't be loaded or DISABLE_EXTERNAL_MODELS is 1."""

    model: str = "hash://384"

    def encoder(self) -> tuple[int, Callable[[pa.Array, pa.ListArray], np.ndarray]]:
        dimension = hash_dimension(self.model)
        if not self.model.startswith("hash://") and os.environ.get("DISABLE_EXTERNAL_MODELS") != "1":
            try:
                from sentence_transformers import SentenceTransformer

                loaded = SentenceTransformer(self.model)
                return loaded.get_sentence_embedding_dimension(), lambda texts, _: np.asarray(loaded.encode(texts.to_pylist(), normalize_embeddings=True), float)
            except Exception:  # noqa: BLE001  any failure of an optional model means the built-in one
                pass
        return dimension, lambda _, tokens: hash_vectors(tokens, dimension)

    def encode(self, rows: DataFrame, key: str, text: Column, *keep: str, tokens: Column | None = None, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, more: str = "") -> DataFrame:
        """key, the columns in ``keep`` (text) and vector (array of double) of every row; tokens: of the text, joined by spaces, if known.
        then: what the same tasks make of such rows, with the columns ``more`` in place of vector."""
        backend = self

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, encode = backend.encoder()
            for batch in batches:
                vectors = encode(batch.column(len(kept)), token_lists(batch.column(len(kept) + 1)))
                flat = pa.array(vectors.reshape(-1))
                ends = pa.array(np.arange(0, flat.__len__() + 1, vectors.shape[1] or 1, dtype=np.int32)) if len(vectors) else pa.array([0], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.ListArray.from_arrays(ends, flat)], [*kept, "vector"])

        kept = (key, *keep)
        text = F.lit(None).cast("string") if tokens is not None and self.model.startswith("hash://") else text
        tokens = F.array_join(T.index_tokens(text), " ") if tokens is None else tokens
        run = work if then is None else lambda batches: then(work(batches))
        return map_arrow(rows.select(*kept, text.alias("__text"), tokens.alias("__tokens")), run, ", ".join(f"{c} string" for c in kept) + (more or ", vector array<double>"))


@dataclass(frozen=True)
class Cells:
    """Vectors by cell, in tiles: cell, tile, rows (array of structs: key, what was kept, vector as the bytes of its doubles).

    centres: a row for each cell; radii: the farthest row's distance to it; sizes: rows; by cell's number.
    """

    tiles: DataFrame
    key: str
    keep: tuple[str, ...]
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """A few rounds of k-means from rows that are far from each other."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < cells and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centres = sample[chosen]
    for _ in range(4):
        of = _squares(sample, centres).argmin(axis=1)
        centres = np.array([sample[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squares of all distances."""
    return np.maximum((rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1), 0)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)


#: What place() makes of vector, beside key and what is kept.
PLACE = ", vector binary, cell int, far double"


def _packed(matrix: np.ndarray) -> pa.Array:
    """Each row's doubles as one binary value: read, shuffled and handed to Python as a whole."""
    ends = np.arange(len(matrix) + 1, dtype=np.int64) * (8 * matrix.shape[1])
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix, "<f8"))]).cast(pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    """The matrix of _packed()."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].tobytes(), "<f8").reshape(len(column), -1)


def in_cells(vectors: DataFrame, key: str = "chunk_id", *keep: str) -> Cells:
    """The cells of rows that have key, ``keep`` (columns of strings) and vector."""
    columns = [F.col(c).cast("string").alias(c) for c in (key, *keep)]
    return _dealt(
        vectors,
        lambda rows: rows.select("vector"),
        lambda rows, place: map_arrow(rows.select(*columns, "vector"), place, ", ".join(f"{c} string" for c in (key, *keep)) + PLACE),
        key,
        *keep,
    )


def _dealt(rows: DataFrame, vectors: Callable[[DataFrame], DataFrame], placed: Callable, key: str, *keep: str) -> Cells:
    """Deals all rows to the cells of their nearest centres; the centres are fitted to a sample, by a hash of the key, of
    about SAMPLE rows. Vectors are shuffled once, here, and a cell of many rows has many tiles.

    vectors: gives the vectors of some of ``rows``; placed: what the function that it gets makes of all of their keys, what is kept and vectors.
    """
    n = rows.count()
    part = F.pmod(F.xxhash64(F.lit("cells"), F.col(key)), F.lit(1 << 30)) < F.lit(min(1 << 30, (1 << 30) * SAMPLE // max(1, n)))
    sample = [r["vector"] for r in vectors(rows.where(part)).limit(2 * SAMPLE).collect()] or [r["vector"] for r in vectors(rows.limit(1)).collect()]
    centres = _centres(np.array(sample, float), min(MOST_CELLS, max(1, math.isqrt(n) // 4))) if sample else np.zeros((1, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(1 + len(keep)), batch.num_rows)
                squares = _squares(vectors, centres)
                of = squares.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(keep)], _packed(vectors), pa.array(of.astype(np.int32)), pa.array(np.sqrt(squares[np.arange(len(of)), of]))], [key, *keep, "vector", "cell", "far"])

    placed = written(placed(rows, place), "placed")
    found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}  # a row for each cell
    sizes = np.array([found[c]["n"] if c in found else 0 for c in range(len(centres))])
    radii = np.array([found[c]["radius"] if c in found else 0.0 for c in range(len(centres))])
    tiles = F.element_at(F.array(*[F.lit(max(1, -(-int(x) // TILE))) for x in sizes]), F.col("cell") + 1)
    dealt = placed.withColumn("tile", F.pmod(F.xxhash64(key), tiles).cast("int")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "tile")
    packed = dealt.groupBy("cell", "tile").agg(F.collect_list(F.struct(key, *keep, "vector")).alias("rows"))
    return Cells(written(packed, "cells"), key, keep, centres, radii, sizes)


@dataclass(frozen=True)
class DenseIndex:
    """vectors: chunk_id, vector, department, access_level. model: what made them, checked at search. cells: of the vectors,
    if they are made yet."""

    vectors: DataFrame
    model: str
    cells: Cells | None = None

    def placed(self) -> Cells:
        return self.cells or in_cells(self.vectors, "chunk_id", "department", "access_level")


def encoded(chunks: DataFrame, model: str = "hash://384", then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, more: str = "") -> DataFrame:
    """chunk_id, department, access_level and vector of every chunk, or what ``then`` makes of that (encode())."""
    text = T.index_text(F.col("title"), F.col("section_path"), F.col("text"))
    tokens = F.col(INDEX_TOKENS) if INDEX_LENGTH in chunks.columns else F.array_join(INDEX_TOKENS, " ") if INDEX_TOKENS in chunks.columns else None
    return Embedding(model).encode(chunks, "chunk_id", text, "department", "access_level", tokens=tokens, then=then, more=more)


def tokenised(chunks: DataFrame, model: str) -> DataFrame:
    """What encoded() reads of chunks, and their tokens."""
    kept = ("chunk_id", "department", "access_level", *(() if model.startswith("hash://") else ("title", "section_path", "text")))
    return with_index_tokens(chunks).select(*kept, INDEX_TOKENS, INDEX_LENGTH)


def build_index(chunks: DataFrame, model: str = "hash://384") -> DenseIndex:
    """Vectors are made by the tasks that deal them to cells, and are written once; only the sample's are made before.

    ``chunks`` that bring their tokens (with_index_tokens()) are taken for a table; others are written first.
    """
    if INDEX_TOKENS not in chunks.columns:
        chunks = written(tokenised(chunks, model), "tokens")
    cells = _dealt(chunks, lambda rows: encoded(rows, model).select("vector"), lambda rows, place: encoded(rows, model, place, PLACE), "chunk_id", "department", "access_level")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _unpacked(batch.column(3))
                ends = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))], ["chunk_id", "department", "access_level", "vector"])

    return DenseIndex(map_arrow(cells.tiles.select(F.inline("rows")), arrays, "chunk_id string, department string, access_level string, vector array<double>"), model, cells)


def _visits(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """query_id, cell, vector: for each query (query_id, vector, bound) the cells that can hold a row of ``bound`` or more; where that
    is null, the likeliest ones that hold ``k`` rows together.

    A row's product with the query is at most the centre's, and the query's length times the row's distance to it.
    """
    centres, radii, sizes = cells.centres, cells.radii, cells.sizes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not sizes.any():
                continue
            q = _matrix(batch.column(1), batch.num_rows)
            bound = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            reach = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radii + SLACK
            order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros_like(reach, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            i, cell = np.nonzero(np.where(np.isnan(bound)[:, None], first, reach >= bound[:, None]) & (sizes > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(cell.astype(np.int32)), batch.column(1).take(pa.array(i))], ["query_id", "cell", "vector"])

    return map_arrow(queries.select("query_id", "vector", "bound"), work, "query_id string, cell int, vector array<double>")


def _products(cells: Cells, visits: DataFrame, n_queries: int, k: int) -> DataFrame:
    """query_id, key, what was kept, score: of the rows in the visited cells at least the ``k`` best of each query.

    Queries are joined to tiles by cell, in blocks; the planner broadcasts them if they are small, and else shuffles both.
    """
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries // BLOCK)))).alias("block")
    asked = written(visits.groupBy("cell", block).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked")).drop("block"), "visits")
    names = (cells.key, *cells.keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, float] = {}  # of each query what the k-th best score reaches at least
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = batch.column(0)[i].values, batch.column(1)[i].values
                ids = held.field(0).to_pylist()
                q, v = _matrix(held.field(1), len(ids)), _unpacked(rows.field(len(names)))
                found = np.round(q @ v.T, DIGITS)
                enough = np.array([least.get(x, -np.inf) for x in ids])
                if len(rows) >= k:
                    enough = np.maximum(enough, np.partition(found, len(rows) - k, axis=1)[:, len(rows) - k])
                    least.update(zip(ids, enough.tolist()))
                a, b = np.nonzero(found >= enough[:, None])
                at = pa.array(b)
                yield pa.RecordBatch.from_arrays([held.field(0).take(pa.array(a)), *[rows.field(j).take(at) for j in range(len(names))], pa.array(found[a, b])], ["query_id", *names, "score"])

    joined = cells.tiles.join(asked, "cell").select("rows", "asked")
    return map_arrow(joined, work, "query_id string, " + ", ".join(f"{c} string" for c in names) + ", score double")


def nearest(vectors: DataFrame | Cells, query_vectors: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """query_id, key, what was kept, score, rank: the ``k`` rows of greatest inner product for each query, ties by key.

    ``vectors`` that aren't in cells yet (key, vector) are put there first.
    First each query visits the cells of its likeliest rows; its k-th score there bounds what others must reach, and all cells that
    can reach it are visited. So no row is missed, and cells that are too far aren't read for the query.
    """
    cells = vectors if isinstance(vectors, Cells) else in_cells(vectors, key)
    asked = written(query_vectors.select(F.col("query_id").cast("string").alias("query_id"), "vector"), "asked")
    n = asked.count()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), cells.key)

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = best(_products(cells, _visits(cells, asked.withColumn("bound", F.lit(None).cast("double")), k), n, k))
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
    visits = _visits(cells, asked.join(bounds, "query_id"), k)
    return best(_products(cells, visits, n, k))


def search(index: DenseIndex, queries: DataFrame, k: int, model: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the 4k nearest chunks, then those the caller may see, then ``k``.

    The cut comes before the filters, so there may be fewer than ``k``; scores may be 0. Queries with a column ``candidates`` have
    that as their own k, of ``k`` at the most.
    """
    if model is not None and model != index.model:
        raise ValueError(f"the index was made by {index.model}, not {model}")
    own = F.col("candidates") if "candidates" in queries.columns else F.lit(k)
    asked = Embedding(index.model).encode(queries, "query_id", F.col("query"))
    found = nearest(index.placed(), asked, OVERFETCH * k).withColumnRenamed("rank", "place")
    found = found.join(queries.select("query_id", F.col("department").alias("want"), F.col("access_level").alias("level"), own.alias("own")), "query_id").where(F.col("place") <= OVERFETCH * F.col("own"))
    seen = found.where(in_department(F.col("want"), F.col("department")) & visible(F.col("level"), F.col("access_level"))).select("query_id", "chunk_id", "score", "own")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("own")).drop("own")
