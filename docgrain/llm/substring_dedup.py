"""Removal of repeated passages: every window of ``width`` words but its first occurrence.

Tasks hash every window (Rabin-Karp over word hashes), keep each hash's first place among a pack of their own texts and
mark the others at once. What is left is packed by hash bucket, so that a window costs about ten shuffled bytes, and a
bucket's task finds each hash's first place among all texts. Marks go back packed by document group, where texts meet
them; overlapping windows merge into maximal intervals, which are cut out.

Buckets and groups are as many as the input asks for: ``bucket_bytes`` and ``group_bytes`` of text each. Where buckets
are more than ``fan``, packs go to coarse buckets first, dealt by salt so that a task gets as much as one pack holds; it
keeps each hash's first place, marks the others and packs anew by bucket. So rows stay packed, a task's memory does not
grow with the input, and a passage that every document has meets in one task once for each pack, or with coarse
buckets once for each ``fan`` packs, not once for each document.

Windows are told apart by 64 bits and by their bucket, which an independent hash gives: among n different windows in b
buckets about n * n / b / 2 ** 65 pairs are mistaken as equal, 0.6 at the 1.6 * 10 ** 13 windows of 100 TB.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Words, column_bytes, map_arrow, mixed, on_cogroup, on_group, rounds, ship, unused, whole_row, window_hashes

WIDTH = 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Rows with null doc_id get numbers from here on, which are below any real id's, by a hash of their text.
NO_ID = -(2**63)
#: 2 ** RUN consecutive ids go to one group.
RUN = 4
#: Partitions of a shuffle at the most; each may hold several buckets or groups, taken one by one.
PARTITIONS = 50_000


@dataclass(frozen=True)
class Packs:
    """Sizes, in bytes of text. fan: coarse buckets at the most."""

    pack_bytes: int = 8 << 20
    bucket_bytes: int = 8 << 20
    group_bytes: int = 16 << 20
    fan: int = 2048


def _number(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2**61)))


def _group(number: Column, n_groups: int) -> Column:
    return F.pmod(F.crc32(F.shiftright(number, RUN).cast("string").cast("binary")), F.lit(n_groups))


def _groups(docs: np.ndarray, n_groups: int) -> np.ndarray:
    """What _group() gives."""
    runs, of = np.unique(docs >> RUN, return_inverse=True)
    return np.array([zlib.crc32(str(x).encode()) % n_groups for x in runs.tolist()], np.int64)[of]


#: Makes a second hash of each word.
SECOND = np.uint64(0x9FB21C651E98DF25)


def _packed(values: np.ndarray) -> bytes:
    """Differences of a mostly ascending integer array, compressed."""
    return zstandard.compress(np.diff(values.astype(np.int64), prepend=0).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))


def _later(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one first occurrence of each key, and of all occurrences that start after the first of their key.

    ordered: docs and places ascend.
    """
    order = np.argsort(keys, kind="stable")
    same = np.empty(len(order), bool)
    same[:1], same[1:] = False, keys[order[1:]] == keys[order[:-1]]
    if not ordered:
        some = same.copy()
        some[:-1] |= same[1:]
        at = np.flatnonzero(some)
        part = order[at]
        order[at] = part[np.lexsort((places[part], docs[part], keys[part]))]
    first = order[np.flatnonzero(~same)]
    of = first[np.cumsum(~same) - 1]
    late = same & ((docs[order] != docs[of]) | (places[order] != places[of]))
    return first, order[late]


def _blobs(group: np.ndarray, keys: np.ndarray | None, docs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Rows (group, keys, docs, places) for each group; docs and places ascend within each."""
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        part = order[a:b]
        yield int(group[part[0]]), b"" if keys is None else keys[part].tobytes(), _packed(docs[part]), _packed(places[part])


ROWS = "bucket long, salt long, keys binary, more binary, docs binary, places binary, marked boolean"
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ROWS.split(", ")])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _marks(docs: np.ndarray, places: np.ndarray, n_groups: int) -> list[tuple]:
    """Rows of marks, which bear their group's number as a negative bucket; docs and places ascend."""
    return [(-1 - dst, 0, b"", b"", d, p, True) for dst, _, d, p in _blobs(_groups(docs, n_groups), None, docs, places)] if len(docs) else []


def repeated_windows(docs: DataFrame, width: int, size: int, packs: Packs) -> DataFrame:
    """Rows (dst, docs, places) with the packed documents and starts of windows that also start earlier.

    docs: number and text; size: bytes of all texts.
    """
    n_buckets, n_groups = 1 + size // packs.bucket_bytes, 1 + size // packs.group_bytes
    coarse = packs.fan if n_buckets > packs.fan else 0
    salts = 1 + size // packs.pack_bytes // packs.fan
    round_bytes = min(packs.pack_bytes, 500_000)

    def packed(keys: np.ndarray, more: np.ndarray, docs: np.ndarray, places: np.ndarray, salt: int) -> list[tuple]:
        """Rows of a pack's first places, by bucket or coarse bucket."""
        buckets = (more % np.uint64(n_buckets)).astype(np.int64)
        if not coarse:
            return [(b, 0, k, b"", d, p, False) for b, k, d, p in _blobs(buckets, keys, docs, places)]
        both = np.stack([keys, more], axis=1)
        return [(b, salt, np.ascontiguousarray(x[:, 0]).tobytes(), np.ascontiguousarray(x[:, 1]).tobytes(), d, p, False) for b, k, d, p in _blobs(buckets % coarse, both, docs, places) for x in [np.frombuffer(k, np.uint64).reshape(-1, 2)]]

    def settled(parts: list[tuple[np.ndarray, ...]], salt: int) -> list[tuple]:
        """Rows of one pack: its first places, and marks of the others."""
        keys, more, docs, places = (np.concatenate(x) for x in zip(*parts))
        if np.any(np.diff(docs) < 0):
            order = np.lexsort((places, docs))
            keys, more, docs, places = keys[order], more[order], docs[order], places[order]
        # rows of one document can leave places that don't ascend
        ordered = not np.any((np.diff(docs) == 0) & (np.diff(places) <= 0))
        first, late = _later(keys, docs, places, ordered)
        first.sort()
        late.sort()
        return packed(keys[first], more[first], docs[first], places[first], salt) + _marks(docs[late], places[late], n_groups)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_packs, held, parts = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            data, offsets = column_bytes(batch.column(1))
            for a, b in rounds(np.diff(offsets), round_bytes):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                (keys, more), row, places = window_hashes([words.hash, mixed(words.hash ^ SECOND)], words.of_text, width)
                parts.append((keys, more, numbers[a:b][row], places))
                held += offsets[b] - offsets[a]
                if held >= packs.pack_bytes:
                    yield from _table(settled(parts, zlib.crc32(f"{part}:{n_packs}".encode()) % salts)).to_batches()
                    n_packs, held, parts = n_packs + 1, 0, []
        if parts:
            yield from _table(settled(parts, zlib.crc32(f"{part}:{n_packs}".encode()) % salts)).to_batches()

    def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
        keys, more = (np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table[c]]) for c in ("keys", "more"))
        docs, places = (np.concatenate([_unpacked(x.as_py()) for x in table[c]]) for c in ("docs", "places"))
        return keys, more, docs, places

    def regroup(table: pa.Table) -> pa.Table:
        """A coarse bucket's part, packed by bucket."""
        if table["marked"][0].as_py():
            return table
        keys, more, docs, places = unpacked(table)
        first, late = _later(keys, docs, places, False)
        first, late = (x[np.lexsort((places[x], docs[x]))] for x in (first, late))
        buckets = (more[first] % np.uint64(n_buckets)).astype(np.int64)
        rows = [(b, 0, k, b"", d, p, False) for b, k, d, p in _blobs(buckets, keys[first], docs[first], places[first])]
        return _table(rows + _marks(docs[late], places[late], n_groups))

    def meet(table: pa.Table) -> pa.Table:
        if table["marked"][0].as_py():
            return pa.table({"dst": pa.array([-1 - b for b in table["bucket"].to_pylist()], pa.int64()), "docs": table["docs"], "places": table["places"]})
        keys, _, docs, places = unpacked(table)
        _, late = _later(keys, docs, places, False)
        late = late[np.lexsort((places[late], docs[late]))]
        rows = _marks(docs[late], places[late], n_groups)
        return pa.table({"dst": pa.array([-1 - r[0] for r in rows], pa.int64()), "docs": pa.array([r[4] for r in rows], pa.binary()), "places": pa.array([r[5] for r in rows], pa.binary())})

    # marks made at once go by the same shuffles; a negative bucket tells their way
    rows = map_arrow(docs, first_round, ROWS)
    parts = min(n_buckets, PARTITIONS)
    if coarse:
        rows = rows.repartition(parts, "bucket", "salt").groupBy("bucket", "salt").applyInArrow(on_group(regroup), ROWS)
    return rows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(on_group(meet), "dst long, docs binary, places binary")


def kept(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words of a text are outside the windows at ``starts``, of which those count that fit in it."""
    starts = starts[starts + width <= n_words]
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:-1]) == 0


def cut_out(raw: bytes, keep: np.ndarray) -> bytes:
    """A text without the intervals of words that aren't kept; a line break, or else a space, closes a gap."""
    spans = [m.span() for m in _WORD.finditer(raw)]
    edges = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0, append=0))
    out, last = [], None
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if last is not None:
            out.append(b"\n" if b"\n" in raw[last : spans[a][0]] else b" ")
        last = spans[b - 1][1]
        out.append(raw[spans[a][0] : last])
    return b"".join(out)


def remove_repeats(docs: DataFrame, width: int = WIDTH, digest: bool = False, packs: Packs = Packs()) -> DataFrame:
    """``docs`` without the words of windows of ``width`` words that also start earlier, by doc_id and then by place.

    The columns are those of ``docs``, ``text`` being what is left of it (as it was if nothing goes), and last
    ``repeats``, a struct of n_words and n_removed; if ``docs`` has that name, underscores are added to it. With
    ``digest``: doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) alone.

    Null texts have no words and stay null. Rows of one doc_id are one document: equal windows at one place of it are the
    same occurrence, and a window that goes at a place goes in all its rows that reach so far. Rows with null doc_id come
    before all others, in the order of a hash of their texts; equal ones are one document. Texts shorter than
    ``width`` words lose nothing. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_groups = 1 + size // packs.group_bytes
    number = _number(docs["doc_id"], docs["text"])
    marks = repeated_windows(docs.select(number.alias("number"), docs["text"].alias("text")), width, size, packs)
    row = (F.struct(docs["doc_id"]) if digest else whole_row(docs, ("text",))).alias("rest")
    texts = docs.select(_group(number, n_groups).cast("long").alias("dst"), number.alias("number"), docs["text"].alias("text"), row)
    shape = StructType([texts.schema["rest"], StructField("kept_sha256" if digest else "text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            of = np.concatenate([_unpacked(x.as_py()) for x in right["docs"]])
            starts = np.concatenate([_unpacked(x.as_py()) for x in right["places"]])
            order = np.argsort(of, kind="stable")
            of, starts = of[order], starts[order]
        else:
            of = starts = np.zeros(0, np.int64)
        ids = left["number"].to_numpy()
        out, n_words, n_removed = [], [], []
        for text, a, b in zip(left["text"], np.searchsorted(of, ids, "left"), np.searchsorted(of, ids, "right")):
            raw = text.as_buffer()
            raw = None if raw is None else raw.to_pybytes()
            words = (raw or b"").split()
            keep = kept(len(words), starts[a:b], width) if a < b else None
            gone = 0 if keep is None else len(words) - int(keep.sum())
            if digest:
                left_over = words if keep is None else [words[i] for i in np.flatnonzero(keep).tolist()]
                out.append(hashlib.sha256(b" ".join(left_over)).hexdigest())
            else:
                out.append(raw if keep is None else cut_out(raw, keep))
            n_words.append(len(words))
            n_removed.append(gone)
        return pa.table({"rest": left["rest"], "kept_sha256" if digest else "text": pa.array(out, pa.string() if digest else pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    parts = min(n_groups, PARTITIONS)
    done = texts.repartition(parts, "dst").groupBy("dst").cogroup(marks.repartition(parts, "dst").groupBy("dst")).applyInArrow(on_cogroup(cut), shape)
    if digest:
        return done.select("rest.doc_id", "n_words", "n_removed", "kept_sha256")
    return done.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns], F.struct("n_words", "n_removed").alias(unused(docs, "repeats")))
