"""What the operators of this subpackage share: words and their hashes, and what cluster.py has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import map_arrow, new_dir, on_batches, on_cogroup, on_group, ship, written

__all__ = ["ROUND_BYTES", "SPACE", "Words", "column_bytes", "map_arrow", "mixed", "new_dir", "on_batches", "on_cogroup", "on_group", "quoted", "rounds", "ship", "unused", "whole_row", "windows", "written"]

#: Fixed pattern: white space is these six characters, a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text that one round of array work takes; a longer text makes a round of its own.
ROUND_BYTES = 2_000_000


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with as many underscores as make it none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """A struct of all columns, or of those that aren't in ``but``, whatever their names hold."""
    return F.struct(*[df[quoted(c)] for c in df.columns if c not in but])


def rounds(sizes: np.ndarray, most: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows whose sizes sum to ``most`` at the most, or single larger rows."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    large = column.cast(pa.large_string())
    _, ends, data = large.buffers()
    offsets = np.frombuffer(ends, np.int64)[large.offset : large.offset + len(large) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of texts and a 64-bit hash of each, by array operations over their bytes."""

    _values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _base = np.uint64(0xD6E8FEB86659FD93)
    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        """data, offsets: as of column_bytes(). lower: A-Z count as a-z."""
        data = np.append(data, np.uint8(32))
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        black = ~((data == 32) | ((data >= 9) & (data <= 13)))
        before = np.empty_like(black)
        before[0], before[1:] = False, black[:-1]
        breaks = np.zeros(len(data) + 1, bool)
        breaks[offsets] = True
        first = black & (~before | breaks[:-1])
        after = np.empty_like(black)
        after[-1], after[:-1] = True, ~black[1:] | breaks[1:-1]
        last = black & after
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: Number of the first word of each text, and of all words.
        self.of_text = np.searchsorted(self.start, offsets)
        self.data = data
        self.hash = self._hashes()

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            inverse = np.uint64(pow(int(cls._base), -1, 1 << 64))
            for name, factor in (("_powers", cls._base), ("_inverses", inverse)):
                out = np.full(n, factor, np.uint64)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))

    def _hashes(self) -> np.ndarray:
        """Each word's polynomial over its bytes modulo 2**64, from differences of one prefix sum."""
        n = len(self.data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._values[self.data] * self._powers[:n], out=sums[1:])
        whole = (sums[self.end] - sums[self.start]) * self._inverses[self.start]
        return mixed(whole + (self.end - self.start).astype(np.uint64))


def windows(hashes: np.ndarray, of_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every ``width`` consecutive words of one text; the text and the first word of each."""
    (keys,), text, place = window_hashes([hashes], of_text, width)
    return keys, text, place


def window_hashes(word_hashes: list[np.ndarray], of_text: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The same by several hashes of each word."""
    hashes = word_hashes[0]
    n = len(hashes)
    counts = np.diff(of_text)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - of_text[:-1][text]
    whole = place + width <= counts[text]
    Words._grow(n + 1)
    at = np.flatnonzero(whole)
    inverses = Words._inverses[at]
    out = []
    for hashes in word_hashes:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * Words._powers[:n], out=sums[1:])
        out.append(mixed((sums[at + width] - sums[at]) * inverses))
    return out, text[at], place[at]
