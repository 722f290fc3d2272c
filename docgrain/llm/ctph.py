"""Context-triggered piecewise hashing: fingerprints that stay alike when texts are edited.

A rolling hash over seven bytes ends a chunk where it is -1 modulo the block size; each chunk gives one character. The
block size, 3 * 2 ** k, is the largest that gives ``LEAST`` ends, so it follows the text's length and its ends are a
subset of the next smaller one's. A fingerprint is ``size:chunks at size:chunks at twice the size``; runs of a
character count three. Two are compared at a block size that both have, by edit distance with insertions and deletions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, column_bytes, map_arrow, mixed, rounds, written

ROLL = 7
LEAST = 32
#: Characters that two chunk strings must have in common in a row to be alike at all.
RUN = 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTES = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Of each text in a run of texts, given by bytes and offsets."""
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    values = _BYTES[data]
    rolled = values.copy()
    factor = 1
    since = np.arange(len(data)) - offsets[:-1][text_of]
    for back in range(1, ROLL):
        factor = factor * 0x9E3779B1 & 0xFFFFFFFF
        term = values[:-back] * np.uint32(factor)
        rolled[back:] += np.where(since[back:] >= back, term, np.uint32(0))
    rolled += np.uint32(1)
    ends = np.flatnonzero(rolled % np.uint32(3) == 0)
    bits = rolled[ends]
    low = bits & (~bits + np.uint32(1))
    level = np.where(low, np.log2(np.maximum(low, 1)).astype(np.int64), 31)
    counts = np.zeros((n, 33), np.int64)
    np.add.at(counts, (text_of[ends], level), 1)
    at_least = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    size = np.maximum((at_least >= LEAST).sum(axis=1) - 1, 0)
    Words._grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(Words._values[data] * Words._powers[: len(data)], out=sums[1:])
    first, second = (_chunks(ends[level >= size[text_of[ends]] + k], text_of, offsets, sums) for k in (0, 1))
    return [f"{3 << k}:{a}:{b}" for k, a, b in zip(size.tolist(), first, second)]


def _chunks(ends: np.ndarray, text_of: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> list[str]:
    """The chunk strings of texts whose chunks end at ``ends``; what follows a text's last end is a chunk too."""
    stops = np.union1d(ends + 1, offsets[1:][np.diff(offsets) > 0])
    starts = np.append(0, stops)[:-1]
    codes = ALPHABET[(mixed((sums[stops] - sums[starts]) * Words._inverses[starts] + (stops - starts).astype(np.uint64)) >> np.uint64(58)).astype(np.int64)]
    text = text_of[starts] if len(starts) else starts
    if len(codes) > 3:
        again = np.zeros(len(codes), bool)
        again[3:] = (codes[3:] == codes[2:-1]) & (codes[3:] == codes[1:-2]) & (codes[3:] == codes[:-3]) & (text[3:] == text[:-3])
        codes, text = codes[~again], text[~again]
    whole = codes.tobytes().decode()
    at = np.searchsorted(text, np.arange(len(offsets))).tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one integer of len(a) bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    run = min(RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """From 0 to 1: one less the edit distance's share of both lengths, at the best block size that both have."""
    if x == y:
        return 1.0
    (i, a, b), (j, c, d) = x.split(":"), y.split(":")
    i, j = int(i), int(j)
    if i == j:
        return max(_alike(a, c), _alike(b, d))
    return _alike(b, c) if 2 * i == j else _alike(a, d) if i == 2 * j else 0.0


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (long) and fingerprint of every row of ``docs`` (doc_id, text), without a shuffle.

    Null texts are empty; empty texts have "3::". Repeated rows and null ids stay; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            out: list[str] = []
            for a, b in rounds(np.diff(offsets)):
                out += fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.as_py() or "") for x in batch.column(1)], pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _of(texts: list[str]) -> list[str]:
    raw = [t.encode() for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    out: list[str] = []
    for a, b in rounds(np.diff(offsets)):
        out += fingerprints(np.frombuffer(b"".join(raw[a:b]), np.uint8), offsets[a : b + 1] - offsets[a])
    return out


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in RESULT.split(", ")]


def _rows(ids: list, texts: list[str], following: list[str], prints: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    changed_prints = _of(changed)
    columns = (ids, map(len, texts), (hashlib.sha256(t.encode()).hexdigest() for t in changed), prints, changed_prints, map(likeness, prints, changed_prints), map(likeness, prints, next_prints))
    return [pa.array(list(x), k) for x, k in zip(columns, _KINDS)]


def against_next(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) held against its own edited text and against the next document.

    Order is by descending doc_id, nulls last, equal ids by text; after the last row comes the first. Null texts are
    empty; a row that is alone is its own next; other columns are not read; an empty table gives an empty one.

    Texts are shuffled once, by ranges of doc_id, and streamed in order, so that a row meets the next one in its task.
    A task's last row meets the first of the next task's range in a second, small step, which takes two texts a task.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [*_NAMES, "part", "end", "text"]

        def end(kind: str, doc_id: int | None, text: str, known: str) -> pa.RecordBatch:
            nothing = [pa.array([x], k) for x, k in zip((doc_id, None, None, known, None, None, None), _KINDS)]
            return pa.RecordBatch.from_arrays([*nothing, pa.array([part], pa.int32()), pa.array([kind]), pa.array([text])], names)

        held: tuple | None = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            if not ids:
                continue
            prints = _of(texts)
            if held is None:
                yield end("first", ids[0], texts[0], prints[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            held = ids[-1], texts[-1], prints[-1]
            if len(ids) > 1:
                done = _rows(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                blank = [pa.array([part] * (len(ids) - 1), pa.int32()), pa.nulls(len(ids) - 1, pa.string()), pa.nulls(len(ids) - 1, pa.string())]
                yield pa.RecordBatch.from_arrays([*done, *blank], names)
        if held is not None:
            yield end("last", *held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_rows(*(batch.column(i).to_pylist() for i in (0, 1, 3, 2, 4))), _NAMES)

    by = F.col("doc_id").desc_nulls_last()
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(by).sortWithinPartitions(by, F.col("text").asc_nulls_first())
    rows = written(map_arrow(ranged, stream, f"{RESULT}, part int, end string, text string"), "ctph")
    firsts = rows.where("end = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # one narrow row a task
    parts = rows.where("end = 'first'").select("part")
    order = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    lasts = rows.where("end = 'last'").select("doc_id", "text", "fingerprint", "part").join(after, "part").join(firsts, "next_part")
    return rows.where("end IS NULL").select(*_NAMES).unionByName(map_arrow(lasts.select("doc_id", "text", "fingerprint", "next_text", "next_print"), meet, RESULT))
