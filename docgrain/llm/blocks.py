"""Texts as numbers: blocks of documents, each with a dictionary of its own.

A block is some megabytes of text of one task. Its words become numbers of the block's dictionary, so what is joined
with counts or numbers of the whole corpus are the blocks' distinct words, not their occurrences, and no dictionary of the corpus
is ever held by a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, column_bytes, map_arrow, mixed, rounds, written

#: Bytes of text of a block, and of a row of its numbers. A longer text makes a row, or a block, of its own.
BLOCK_BYTES = 24_000_000
ROW_BYTES = 1_000_000

#: Written for the end of a text where ends count as words; no word has a space.
END = " "

SCHEMA = "block long, id int, grp string, word string, n long, learned long, ids binary, docs array<long>, flags array<boolean>, sizes array<int>"
_ARROW = pa.schema(
    [("block", pa.int64()), ("id", pa.int32()), ("grp", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("learned", pa.int64()), ("ids", pa.binary()), ("docs", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))]
)


def packed(ids: np.ndarray) -> bytes:
    """int32 numbers as four planes of bytes, of which the upper ones compress to next to nothing."""
    return np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _table(breaks: bytes) -> np.ndarray:
    """What each byte is read as: A-Z lower-cased, ``breaks`` as line feeds."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[list(breaks)] = 10
    return out


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings that ``data`` holds between start and end."""
    sizes = end - start
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.string())


class _Block:
    """Rows of one block: every distinct (group, word) with its number and counts, and the texts as numbers."""

    def __init__(self, number: int, breaks: bool, ends: bool):
        self.number, self.breaks, self.ends = number, breaks, ends
        self.bytes = 0
        self.keys, self.words, self.groups, self.rows = [], [], [], []

    def add(self, data: np.ndarray, offsets: np.ndarray, docs: pa.Array, flags: np.ndarray, groups: pa.Array, group_hash: np.ndarray) -> None:
        """data: bytes as _table() reads them."""
        w = Words(data, offsets)
        counts = np.diff(w.of_text)
        text = np.repeat(np.arange(len(counts)), counts)
        keys = mixed(w.hash ^ group_hash[text])
        found, first, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        learned = np.bincount(inverse, weights=flags[text], minlength=len(found)).astype(np.int64)
        self.keys.append((found, n, learned))
        self.words.append(_spans(w.data, w.start[first], w.end[first]))
        self.groups.append(groups.take(pa.array(text[first])))
        marks = None
        if self.breaks:
            piece = np.cumsum((w.data >= 10) & (w.data <= 13))[w.start]
            marks = np.ones(len(text), bool)
            marks[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        self.rows.append((inverse.astype(np.int32), counts, marks, docs, flags))
        self.bytes += len(data)

    def batches(self) -> Iterator[pa.RecordBatch]:
        all_keys = np.concatenate([k for k, _, _ in self.keys])
        found, first, inverse = np.unique(all_keys, return_index=True, return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([k[i] for k in self.keys]), minlength=len(found)).astype(np.int64) for i in (1, 2)]
        at = pa.array(first)
        yield self._batch(len(found), id=pa.array(np.arange(len(found), dtype=np.int32)), grp=pa.chunked_array(self.groups, pa.string()).combine_chunks().take(at), word=pa.chunked_array(self.words, pa.string()).combine_chunks().take(at), n=pa.array(sums[0]), learned=pa.array(sums[1]))
        if self.ends:
            flags = np.concatenate([r[4] for r in self.rows])
            yield self._batch(1, id=pa.array([len(found)], pa.int32()), word=pa.array([END]), n=pa.array([len(flags)]), learned=pa.array([int(flags.sum())]))
        start = 0
        for number, ((ids, counts, marks, docs, flags), (keys, _, _)) in enumerate(zip(self.rows, self.keys, strict=True)):
            ids = inverse[start : start + len(keys)][ids].astype(np.int32)
            start += len(keys)
            if self.breaks:
                ids = np.insert(ids, np.flatnonzero(marks), np.int32(-1))
            if self.ends:
                ids, counts = np.insert(ids, np.cumsum(counts), np.int32(len(found))), counts + 1
            yield self._batch(1, id=pa.array([number], pa.int32()), ids=pa.array([packed(ids)], pa.binary()), docs=pa.array([docs.to_pylist()], pa.list_(pa.int64())), flags=pa.array([flags.tolist()]), sizes=pa.array([counts.tolist()], pa.list_(pa.int32())))

    def _batch(self, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["block"] = pa.array(np.full(rows, self.number))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _ARROW], schema=_ARROW)


def blocks(docs: DataFrame, text: Column, doc_id: Column | None = None, group: Column | None = None, learned: Column | None = None, breaks: bytes = b"", ends: bool = False) -> DataFrame:
    """The written blocks of ``docs``: rows with a word are a block's dictionary, rows with ids its texts, numbered by id.

    Words are runs of anything but white space (``[\\x20\\x09-\\x0D]``) and ``breaks``, A-Z lower-cased. With ``breaks``,
    -1 stands before each piece, and pieces end at line feeds and their like or at one of ``breaks``. With ``ends``, every text ends with
    a number that stands for END. ``n`` counts a word's occurrences, ``learned`` those in rows where ``learned`` holds. Words are told apart
    by 64-bit hashes within a block: of its 10**5 distinct words two meet with a chance of 3e-10.
    """
    asked, with_breaks = _table(breaks), bool(breaks)
    none = F.lit(None)
    columns = [F.coalesce(text, F.lit("")).alias("text"), (none if doc_id is None else doc_id).cast("long").alias("doc"), (F.lit("") if group is None else group).cast("string").alias("grp"), (F.lit(False) if learned is None else learned).alias("learned")]
    rows = docs.select(*columns).withColumn("h", F.xxhash64("grp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number, with_breaks, ends)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            data = asked[data]
            flags = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            hashes = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j in rounds(np.diff(offsets), ROW_BYTES):
                block.add(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], batch.column(1).slice(i, j - i), flags[i:j], batch.column(2).slice(i, j - i), hashes[i:j])
                if block.bytes >= BLOCK_BYTES:
                    yield from block.batches()
                    number += 1
                    block = _Block(number, with_breaks, ends)
        if block.rows:
            yield from block.batches()

    return written(map_arrow(rows, run, SCHEMA), "blocks")
