"""Phrase collocation mining: frequent word sequences that hang together, by group.

Texts are cut into pieces and words. Words that occur often enough are numbered (a dictionary encoding); pieces are broken at
all others, as no frequent phrase holds one. Runs of 2 or more numbers are packed into binary keys of fixed width (four bytes
a word, zeros behind), which each block sorts (as single numbers, of its own words) and counts by run length. The counts are dealt by key range, packed by block and range, and each
range is sorted by radix and counted by run length once more. Ranges are as many as the words ask for and begin where the words' own counts
let expect equal loads. All later steps are joins on such keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks, unpacked
from .common import on_batches, ship, written


@dataclass(frozen=True)
class Mining:
    #: Fixed: characters that end a piece, beside line feeds and their like.
    breaks: bytes = b".,;:!?"
    most_words: int = 3
    #: A candidate occurs so often at least.
    least: int = 10
    #: One whose words lie inside a longer candidate with this percentage of its occurrences goes.
    covered_percent: int = 50
    scale: int = 1_000_000
    top: int = 2000


MINING = Mining()

#: Bytes of a word's number.
WIDTH = 4
#: Keys of a range, about, and that a task sorts at a time.
RANGE_KEYS = 1_000_000


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of 16-bit numbers: least significant digit first, each digit by numpy's radix sort of uint16."""
    order = np.arange(len(keys))
    for digit in range(keys.shape[1] - 1, -1, -1):
        column = keys[:, digit][order].astype(np.uint16)
        if len(column) and (column != column[0]).any():
            order = order[np.argsort(column, kind="stable")]
    return order


def counted_runs(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a matrix of uint32 in order, big-endian, and how often each is there, or the sum of its ``n``."""
    keys = np.ascontiguousarray(keys, ">u4")
    order = radix_order(keys.view(">u2").reshape(len(keys), 2 * keys.shape[1]))
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    if n is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def phrase_keys(numbers: np.ndarray, most: int) -> np.ndarray:
    """Keys of all runs of 2 to ``most`` numbers over 0, as rows of uint32 with zeros behind."""
    out, known = [], numbers > 0
    whole = known
    for size in range(2, most + 1):
        whole = whole[:-1] & known[size - 1 :]
        at = np.flatnonzero(whole)
        rows = np.zeros((len(at), most), np.uint32)
        for i in range(size):
            rows[:, i] = numbers[at + i]
        out.append(rows)
    return np.concatenate(out)


def phrase_codes(numbers: np.ndarray, most: int) -> np.ndarray:
    """The rows of phrase_keys() as one uint64 each, in their order; numbers are below code_limit()."""
    bits = 64 // most
    out, known = [], numbers > 0
    whole = known
    for size in range(2, most + 1):
        whole = whole[:-1] & known[size - 1 :]
        at = np.flatnonzero(whole)
        codes = np.zeros(len(at), np.uint64)
        for i in range(size):
            codes |= numbers[at + i].astype(np.uint64) << np.uint64(bits * (most - 1 - i))
        out.append(codes)
    return np.concatenate(out)


def code_limit(most: int) -> int:
    return 1 << 64 // most


def counted_codes(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What counted_runs() gives for the codes' rows, as uint32; ``codes`` is sorted in place."""
    bits = 64 // most
    codes.sort()
    first = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    at = np.flatnonzero(first)
    n = np.diff(at, append=len(codes)).astype("<u4")
    codes = codes[at]
    keys = np.empty((len(codes), most), np.uint32)
    for i in range(most):
        keys[:, i] = (codes >> np.uint64(bits * (most - 1 - i))) & np.uint64((1 << bits) - 1)
    return keys, n


def _binary(keys: np.ndarray) -> pa.Array:
    width = keys.shape[1] * keys.dtype.itemsize
    ends = np.arange(len(keys) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def _key(*parts: Column, mining: Mining, words: Column | int) -> Column:
    """A key of ``words`` words from its parts, filled with zeros."""
    zeros = F.lit(bytes(WIDTH * mining.most_words))
    return F.substring(F.concat(*parts, zeros), 1, WIDTH * mining.most_words)


def dictionary(found: DataFrame, mining: Mining = MINING) -> DataFrame:
    """grp, word, f, id (from 1), start and key of every word that occurs ``least`` times in its group; start: occurrences of
    the words of smaller ids.

    Numbers are dense and given without one task: a row's place in its part, after the rows of the parts before.
    """
    words = found.where("word IS NOT NULL").groupBy("grp", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= mining.least)
    words = written(words.withColumn("place", F.monotonically_increasing_id()), "words")
    words = words.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    words = words.withColumn("start", F.sum("f").over(Window.partitionBy("part").orderBy("place")) - F.col("f"))
    parts = words.groupBy("part").agg(F.count("*").alias("rows"), F.sum("f").alias("occurrences"))  # a row for each part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum("occurrences").over(earlier), F.lit(0)).alias("begun"))
    number = F.col("before") + F.col("place") + 1
    number = F.when(number < 1 << 8 * WIDTH, number).otherwise(F.raise_error(F.lit("more words than a key's width can number")).cast("long"))
    words = words.join(parts, F.col("part") == F.col("of")).select("grp", "word", "f", number.alias("id"), (F.col("begun") + F.col("start")).alias("start"))
    as_bytes = F.unhex(F.lpad(F.hex("id"), 2 * WIDTH, "0"))
    return written(words.withColumn("key", _key(as_bytes, mining=mining, words=1)), "dictionary")


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, which compress well for sorted ones."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, kind: str, columns: int) -> np.ndarray:
    width = np.dtype(kind).itemsize * columns
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1, columns)


def block_phrases(found: DataFrame, words: DataFrame, mining: Mining = MINING) -> DataFrame:
    """range, keys and n of every block: its phrases of each key range, sorted and packed, and their counts, for about
    RANGE_KEYS of its phrases at a time.

    A phrase's range is where it would stand among all occurrences if words followed each other by chance: the occurrences
    before its first word's, and of that word's own the share before its second word. Keys of one range follow each other, and
    equal keys of all blocks are in one. A task holds the packed texts and frequent words of one block and RANGE_KEYS phrases, and
    hands those over before it goes on.
    """
    most = mining.most_words
    ship(found.sparkSession)
    total = words.agg(F.sum("f")).first()[0] or 1
    ranges = -(-(most - 1) * total // RANGE_KEYS)
    numbers = found.where("word IS NOT NULL").join(words.select("grp", "word", F.col("id").alias("number"), (F.col("start") / total).alias("start"), (F.col("f") / total).alias("share")), ["grp", "word"]).select("block", "id", "number", "start", "share")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's rows come in any order; its texts stay packed
        known, texts = [], []
        for batch in batches:
            texts += [x.as_buffer() for x in batch.column("ids").drop_null()]
            known.append(batch.filter(batch.column("number").is_valid()).select(["id", "number", "start", "share"]))
        known = pa.Table.from_batches(known).combine_chunks()
        ids = known.column("id").to_numpy()
        number = known.column("number").to_numpy()
        order = np.argsort(number)
        # a word's place among the block's, from 1, keeps the order of the numbers and fits into less
        place = np.zeros(int(ids.max()) + 2 if len(ids) else 1, np.uint32)
        place[ids[order]] = np.arange(1, len(order) + 1)
        number, start, share = (np.append(0, x[order]) for x in (number, known.column("start").to_numpy(), known.column("share").to_numpy()))
        del batch, known, ids, order
        coded = len(number) <= code_limit(most)
        keys, held = [], 0
        while texts:
            local = unpacked(texts.pop())
            keys.append((phrase_codes if coded else phrase_keys)(place[np.where(local < len(place) - 1, local, -1)], most))
            held += len(keys[-1])
            if held >= RANGE_KEYS or not texts:
                whole, held = [np.concatenate(keys)], 0
                keys.clear()
                yield from packs(*(counted_codes(whole.pop(), most) if coded else counted_runs(whole.pop())), number, start, share)

    def packs(places: np.ndarray, n: np.ndarray, number: np.ndarray, start: np.ndarray, share: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = np.empty(len(places), np.int64)
        for a in range(0, len(places), 100_000):
            first, second = (places[a : a + 100_000, i].astype(np.int64) for i in (0, 1))
            of[a : a + 100_000] = (start[first] + share[first] * start[second]) * ranges
        np.minimum(of, ranges - 1, out=of)
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(begins[1:], len(of))[: len(begins)]
        key = lambda a, b: _planes(number[places[a:b].astype(np.int64)].astype("<u4"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(of[begins]), pa.array([key(a, b) for a, b in zip(begins, ends, strict=True)], pa.binary()), pa.array([_planes(n[a:b].astype("<u4")) for a, b in zip(begins, ends, strict=True)], pa.binary())],
            ["range", "keys", "n"],
        )

    # one kind of rows, so that what a block gives can leave it part by part
    rows = numbers.unionByName(found.where("ids IS NOT NULL").select("block", "ids"), allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(on_batches(count), "range long, keys binary, n binary")


def run_lengths(rows: DataFrame, mining: Mining = MINING) -> DataFrame:
    """key and f (the sum of n) of keys with ``least`` or more: each range sorted by radix and summed run by run.

    A task holds the different keys of one range, and RANGE_KEYS more at the most.
    """
    most, least = mining.most_words, mining.least

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, done = [], [], 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                keys.append(_unplanes(r["keys"], "<u4", most))
                counts.append(_unplanes(r["n"], "<u4", 1).ravel().astype(np.int64))
                held += len(keys[-1])
                if held > done + RANGE_KEYS:
                    one, n = counted_runs(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held, done = [np.asarray(one, "<u4")], [n], len(one), len(one)
        found, n = counted_runs(np.concatenate(keys), np.concatenate(counts))
        often = np.flatnonzero(n >= least)
        for a in range(0, len(often), 100_000):
            yield pa.RecordBatch.from_arrays([_binary(found[often[a : a + 100_000]]), pa.array(n[often[a : a + 100_000]])], ["key", "f"])

    return rows.groupBy("range").applyInArrow(on_batches(add), "key binary, f long")


def _size(key: Column, mining: Mining) -> Column:
    """Number of words of a key."""
    words = [F.when(F.substring(key, WIDTH * i + 1, WIDTH) != F.lit(bytes(WIDTH)), 1).otherwise(0) for i in range(mining.most_words)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total


def _part(key: Column, start: Column, size: Column, mining: Mining) -> Column:
    """The key of ``size`` words of ``key`` from word ``start`` (from 0) on."""
    return _key(key.substr(start * WIDTH + 1, size * WIDTH), mining=mining, words=size)


def scored(phrases: DataFrame, words: DataFrame, mining: Mining = MINING) -> DataFrame:
    """key, size, a, grp, l, r, score of every phrase: of its cuts the one of the lowest score, ties to the earliest.

    Scores are whole-number decimals: 1,000,000 a a has up to 38 digits for a below 3e15.
    """
    often = phrases.select("key", "f", F.lit(None).cast("string").alias("grp")).unionByName(words.select("key", "f", "grp"))
    sized = phrases.select("key", F.col("f").alias("a"), _size(F.col("key"), mining).alias("size"))
    cuts = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", _part(F.col("key"), F.lit(0), F.col("k"), mining).alias("left"), _part(F.col("key"), F.col("k"), F.col("size") - F.col("k"), mining).alias("right"))
    of = lambda side, n: often.select(F.col("key").alias(side), F.col("f").alias(n), *([F.col("grp")] if side == "left" else []))
    cuts = cuts.join(of("left", "l"), "left").join(of("right", "r"), "right")
    score = F.expr(f"(CAST({mining.scale} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")
    best = cuts.groupBy("key", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.max("grp").alias("grp"))
    return best.select("key", "size", "a", "grp", "cut.l", "cut.r", "cut.score")


def uncovered(found: DataFrame, mining: Mining = MINING) -> DataFrame:
    """Rows of scored() whose words don't lie inside a longer candidate that has enough of their occurrences."""
    longer = found.where("size > 2").select("key", "a", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part"))
    inside = longer.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("part"))).alias("start"))
    inside = inside.groupBy(_part(F.col("key"), F.col("start"), F.col("part"), mining).alias("key")).agg(F.max("a").alias("longer"))
    joined = found.join(inside, "key", "left")
    return joined.where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(mining.covered_percent) * F.col("a"))).drop("longer")


def mine(docs: DataFrame, mining: Mining = MINING) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases, from all of ``docs`` (text, lang).

    A null language is ``und``. Null and empty texts have no words; copies and repeated rows count each time; ids are not
    read, nor are other columns. A text is worked on whole, in rows of bounded size, or one of its own if it is longer. Phrases of equal score and
    occurrences are ordered by their bytes. A language without candidates has no row, and an empty table gives an empty one.
    """
    found = blocks(docs, F.col("text"), group=F.coalesce(F.col("lang"), F.lit("und")), breaks=mining.breaks)
    words = dictionary(found, mining)
    phrases = written(run_lengths(block_phrases(found, words, mining), mining), "phrases")
    best = uncovered(written(scored(phrases, words, mining), "scored"), mining)
    ahead = F.rank().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a")))
    best = best.withColumn("ahead", ahead).where(F.col("ahead") <= mining.top)  # and all that tie with the last
    named = best.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: _part(F.col("key"), i, F.lit(1), mining))).alias("at", "one"))
    named = named.join(words.select(F.col("key").alias("one"), "word"), "one")
    named = named.groupBy("grp", "key", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    named = named.withColumn("rank", rank).where(F.col("rank") <= mining.top)
    totals = found.where("word IS NOT NULL").groupBy("grp").agg(F.sum("n").alias("n"))
    return named.join(totals, "grp").select(F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
