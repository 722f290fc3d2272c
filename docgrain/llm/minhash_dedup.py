"""Near duplicates by MinHash with tensored banding; candidates are confirmed on whole shingle sets.

Two small collections of sub-keys are computed, each sub-key from a few minhashes, and a table key is formed from
every pair of one sub-key of either collection. ``side`` sub-keys a collection give ``side ** 2`` tables for
``2 * side * rows`` minhashes; separate bands of the same width would need ``side ** 2 * 2 * rows``. With the defaults
(12 a side, 3 rows) a pair of similarity 0.8 shares a table with probability 0.9996, one of 0.9 with 1 - 5e-7.

Documents with equal sets form a class first, so copies cost nothing further. Sub-keys that one class alone has can't
be part of a shared table key and go before the pairs are formed. In each table bucket the smallest class
is the hub, all others are compared with it, and links make components. What remains are pairs of one bucket in
different components: each is compared once, in tiles whose sets have bounded bytes, and only until its
components are linked. So no link between members of a bucket is lost, pairs are never rows of a table, and large
groups of near copies, which their hub links, cost no more than a row for each member and table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, column_bytes, map_arrow, mixed, on_batches, on_cogroup, on_group, quoted, rounds, ship, windows, written


@dataclass(frozen=True)
class Near:
    """width: words of a shingle. percent: least similarity. side, rows: see above. bucket_rows: members of a
    bucket that one task pairs. lot, lot_bytes: documents, and bytes of their sets, of half a tile. broadcast_rows: ids
    that may be broadcast. block_bytes: of sets that one task compares at a time."""

    width: int = 2
    percent: int = 80
    side: int = 12
    rows: int = 3
    seed: int = 1
    bucket_rows: int = 4096
    lot: int = 128
    lot_bytes: int = 2 << 20
    broadcast_rows: int = 500_000
    block_bytes: int = 8 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text, end to end, and where each text's begin.

    A text of fewer than ``width`` words, but some, has one shingle: all its words.
    """
    words = Words(data, offsets, lower=True)
    hashes, row, _ = windows(words.hash, words.of_text, width)
    counts = np.diff(words.of_text)
    few = np.flatnonzero((counts > 0) & (counts < width))
    whole = [mixed(np.array([sum(int(h) * (2 * k + 3) ** 9 for k, h in enumerate(words.hash[words.of_text[i] : words.of_text[i + 1]])) + int(counts[i]) & (2**64 - 1)], np.uint64))[0] for i in few]
    hashes, row = np.append(hashes, np.array(whole, np.uint64)), np.append(row, few)
    order = np.argsort(hashes)
    n = len(offsets) - 1
    order = order[np.argsort(row[order].astype(np.int16 if n < 2**15 else np.int64), kind="stable")]
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(n + 1))


def sub_keys(hashes: np.ndarray, starts: np.ndarray, near: Near) -> np.ndarray:
    """Both collections' sub-keys of each non-empty set: an array of sets by 2 * side."""
    chance = np.random.default_rng(near.seed)
    n = 2 * near.side * near.rows
    factors = chance.integers(0, 2**64, n, np.uint64, False) | np.uint64(1)
    salts = chance.integers(0, 2**64, n, np.uint64, False)
    out = np.empty((len(starts), 2 * near.side), np.uint64)
    for k in range(2 * near.side):
        key = np.full(len(starts), k + 1, np.uint64)
        for j in range(k * near.rows, (k + 1) * near.rows):
            values = (hashes ^ salts[j]) * factors[j]
            key = mixed(key ^ np.minimum.reduceat(values, starts)) + key
        out[:, k] = key
    return out


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and the sub-keys, for every row of ``docs``; written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in rounds(np.diff(offsets)):
                hashes, starts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], near.width)
                sizes = np.diff(starts)
                some = np.flatnonzero(sizes)
                digest = np.zeros((2, b - a), np.uint64)
                keys = np.zeros((b - a, 2 * near.side), np.uint64)
                if len(some):
                    at = starts[:-1][some]
                    digest[0, some] = np.add.reduceat(mixed(hashes), at)
                    digest[1, some] = np.add.reduceat(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    keys[some] = sub_keys(hashes, at, near)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)), near.side).cast(pa.list_(pa.int64())) for x in (keys[:, : near.side], keys[:, near.side :])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sizes, pa.int64()), *[pa.array(d.view(np.int64)) for d in digest], *lists], ["doc_id", "n_shingles", "s1", "s2", "a", "b"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(map_arrow(ids, work, "doc_id long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>"), "signatures")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node that u reaches, for every u that isn't that itself.

    Large-star and small-star steps in turn until nothing changes; a step's result is a written table. So are each
    node's least neighbours: a join with a table can be split where a hub's edges meet.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    return e


def _chosen(docs: DataFrame, ids: DataFrame, n: int, near: Near, how: str) -> DataFrame:
    """Semi or anti join by doc_id; ids are broadcast if they are few, else both sides are shuffled."""
    return docs.join(F.broadcast(ids) if n <= near.broadcast_rows else ids, "doc_id", how)


def sets_of(docs: DataFrame, ids: DataFrame, near: Near) -> DataFrame:
    """doc_id and hashes, the sorted set, of the documents whose ids a written table lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in rounds(np.diff(offsets)):
                hashes, starts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], near.width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([hashes[x:y].tobytes() for x, y in zip(starts, starts[1:])], pa.binary())], ["doc_id", "hashes"])

    wanted = _chosen(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, ids.count(), near, "left_semi")
    return map_arrow(wanted, work, "doc_id long, hashes binary")


def confirmed(docs: DataFrame, pairs: DataFrame, near: Near) -> DataFrame:
    """Those of ``pairs`` (u, v, n: the larger set's size) whose documents' sets are as similar as asked; written.

    Each pair goes to a block; blocks hold about ``block_bytes`` of sets, and a hub of many pairs goes to several.
    """
    pairs = written(pairs, "pairs")
    total = pairs.agg(F.count("*").alias("n"), F.sum("n").alias("size")).first()
    if not total["n"]:
        return pairs.select("u", "v")
    found = sets_of(docs, written(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids"), near)
    n_blocks = 1 + int(8 * total["size"] // near.block_bytes)
    share = max(1, total["n"] // n_blocks)
    degrees = pairs.groupBy("u").agg(F.count("*").alias("degree"))
    part = F.pmod(F.xxhash64("v"), F.ceil(F.col("degree") / share))
    placed = written(pairs.join(degrees, "u").select("u", "v", F.pmod(F.xxhash64("u", part), F.lit(n_blocks)).alias("block")), "blocks")
    needed = placed.select(F.col("block").alias("at"), F.explode(F.array("u", "v")).alias("doc_id")).distinct()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[int, list[np.ndarray]] = {}
        for doc_id, raw in zip(right["doc_id"].to_pylist(), right["hashes"]):
            by.setdefault(doc_id, []).append(np.frombuffer(raw.as_buffer(), np.uint64))
        keep = [any(similar(x, y, near.percent) for x in by.get(u, ()) for y in by.get(v, ())) for u, v in zip(left["u"].to_pylist(), left["v"].to_pylist())]
        return left.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    links = placed.groupBy("block").cogroup(needed.join(found, "doc_id").groupBy("at")).applyInArrow(on_cogroup(compare), "u long, v long")
    return written(links, "links")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, neither empty, have at least that similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    shared = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _keys(a: Column | str = "a", b: Column | str = "b") -> Column:
    """Table keys of every pair of sub-keys."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.xxhash64(x, y))))


def bucket_keys(classes: DataFrame, near: Near) -> DataFrame:
    """(rep, key): the table keys of every class, without those that a sub-key of this class alone rules out."""
    subs = classes.select("rep", "s1", "s2", F.posexplode(F.concat("a", "b")).alias("at", "sub"))
    often = written(subs.groupBy("sub").agg(F.count("*").alias("n")).where("n > 1").select("sub"), "subs")
    of_class = subs.join(often, "sub").groupBy("rep", "s1", "s2").agg(F.collect_list(F.struct("at", "sub")).alias("subs"))

    def side(first: bool) -> Column:
        return F.transform(F.filter("subs", lambda x: (x["at"] < near.side) if first else (x["at"] >= near.side)), lambda x: x["sub"])

    return of_class.select("rep", side(True).alias("a"), side(False).alias("b")).select("rep", F.explode(_keys()).alias("key"))


def packed_pairs(pairs: np.ndarray) -> bytes:
    """Four rows (id, component, id, component), compressed."""
    return zstandard.compress(np.ascontiguousarray(pairs).tobytes(), 1)


def unpacked_pairs(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.int64).reshape(4, -1)


def across(docs: DataFrame, rows: DataFrame, of: DataFrame, classes: DataFrame, near: Near) -> DataFrame | None:
    """Links between members of one bucket, hubs left out, that are in different components so far.

    rows: (key, rep) of buckets. of: components() so far. A pair belongs to the first table that it shares, which its
    sub-keys tell, and is compared once. Pairs go packed to tiles, a tile being two lots of documents that have to do with
    the same component, about ``near.lot`` of them or ``near.lot_bytes`` of sets; sets go to each of the tiles that need
    them. Buckets of more than ``near.bucket_rows`` members are taken in blocks, of which a task holds the members and the
    pairs of a few at a time.
    """
    placed = rows.join(of.select(F.col("u").alias("rep"), "v"), "rep", "left").select("key", "rep", F.coalesce("v", "rep").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least <> most")
    mixed_rows = written(placed.join(several.select("key", "least", "n"), "key"), "mixed")
    if mixed_rows.isEmpty():
        return None
    sizes = classes.groupBy("rep").agg(F.max("n_shingles").alias("size"))
    anchors = mixed_rows.groupBy("rep").agg(F.min("least").alias("anchor")).join(sizes, "rep")
    lots = anchors.groupBy("anchor").agg(F.greatest(F.ceil(F.count("*") / near.lot), F.ceil(8 * F.sum("size") / near.lot_bytes)).alias("lots"))
    lot = F.pmod(F.xxhash64("rep"), F.col("lots"))
    known = written(anchors.join(lots, "anchor").select("rep", F.xxhash64("anchor", lot).alias("lot")), "lots")
    # a rep's row of classes() that is in the bucket: where the key is among its table keys
    full = mixed_rows.join(known, "rep").join(classes.select("rep", "n_shingles", "a", "b"), "rep").withColumn("table", F.array_position(_keys(), F.col("key")) - 1).where("table >= 0")
    blocks = F.ceil(F.col("n") / near.bucket_rows).cast("long")
    own = F.pmod(F.xxhash64("rep", F.lit(1)), blocks)
    full = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    full = full.select("key", "table", "rep", "component", "n_shingles", "lot", "a", "b", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        low, high, at = table["low"][0].as_py(), table["high"][0].as_py(), table["table"][0].as_py()
        own = table["own"].to_numpy()
        rep, component, size, lot = (table[c].to_numpy() for c in ("rep", "component", "n_shingles", "lot"))
        i, j = divmod(at, near.side)
        earlier = [np.stack(table[c].to_numpy())[:, :k] for c, k in (("a", i), ("b", j))]
        del table
        xs, ys = (x[np.lexsort((rep[x], lot[x]))] for x in (np.flatnonzero(own == low), np.flatnonzero(own == high)))
        for start in range(0, len(xs), 256):
            x = xs[start : start + 256]
            take = component[x][:, None] != component[ys][None, :]
            take &= 100 * np.minimum(size[x][:, None], size[ys][None, :]) >= near.percent * np.maximum(size[x][:, None], size[ys][None, :])
            if low == high:
                take &= rep[x][:, None] < rep[ys][None, :]
            for keys in earlier:
                for k in range(keys.shape[1]):
                    take &= keys[x, k][:, None] != keys[ys, k][None, :]
            p, q = np.nonzero(take)
            p, q = x[p], ys[q]
            swap = lot[p] > lot[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            order = np.lexsort((lot[q], lot[p]))
            p, q = p[order], q[order]
            new = np.ones(len(p), bool)
            new[1:] = (np.diff(lot[p]) != 0) | (np.diff(lot[q]) != 0)
            edge = np.flatnonzero(new)
            rows = [(int(lot[p[s]]), int(lot[q[s]]), packed_pairs(np.stack([rep[p[s:e]], component[p[s:e]], rep[q[s:e]], component[q[s:e]]]))) for s, e in zip(edge, np.append(edge[1:], len(p)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["x", "y", "pairs"])

    def join(table: pa.Table) -> pa.Table:
        pairs = np.concatenate([unpacked_pairs(raw.as_py()) for raw in table["pairs"]], axis=1)
        ids = np.unique(pairs[[0, 2]])
        return pa.table({"x": table["x"][:1], "y": table["y"][:1], "pairs": pa.array([packed_pairs(pairs)], pa.binary()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[int, list[np.ndarray]] = {}
        for doc_id, raw in zip(right["doc_id"].to_pylist(), right["hashes"]):
            by.setdefault(doc_id, []).append(np.frombuffer(raw.as_buffer(), np.uint64))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            top = c
            while top in parent:
                top = parent[top]
            while c in parent:
                parent[c], c = top, parent[c]
            return top

        links = []
        for raw in left["pairs"]:
            for u, cu, v, cv in zip(*unpacked_pairs(raw.as_py()).tolist()):
                cu, cv = root(cu), root(cv)
                if cu != cv and any(similar(x, y, near.percent) for x in by.get(u, ()) for y in by.get(v, ())):
                    parent[max(cu, cv)] = min(cu, cv)
                    links.append((u, v))
        return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    packed = full.groupBy("key", "low", "high").applyInArrow(on_batches(pack), "x long, y long, pairs binary")
    tiles = written(packed.groupBy("x", "y").applyInArrow(on_group(join), "x long, y long, pairs binary, ids array<long>"), "tiles")
    needed = tiles.select(F.col("x").alias("p"), F.col("y").alias("q"), F.explode("ids").alias("doc_id"))
    ids = written(needed.select("doc_id").distinct(), "ids")
    sent = needed.join(sets_of(docs, ids, near), "doc_id")
    return written(tiles.select("x", "y", "pairs").groupBy("x", "y").cogroup(sent.groupBy("p", "q")).applyInArrow(on_cogroup(compare), "u long, v long"), "links")


def linked(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text); see the module.

    component_id is the smallest doc_id that links reach. Null, empty and wordless texts have no shingles and are
    their own component, as are rows with null doc_id (component_id null, kept). Rows of one doc_id are one document
    of several texts. Other columns are not read; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = signatures(docs, near)
    grouped = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = written(grouped, "classes")
    sizes = classes.groupBy("rep").agg(F.max("n_shingles").alias("n"), F.min("n_shingles").alias("m"))
    # a document with several texts links its own classes by sharing their rep
    buckets = written(bucket_keys(classes, near), "keys")
    hubs = written(buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).where("members > 1"), "hubs")
    bucket_rows = written(buckets.join(hubs, "key").select("key", "hub", "rep", "members").where("rep <> hub"), "buckets")

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity, with the larger size."""
        u, v = (sizes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}")) for x in "uv")
        fits = (100 * F.least("n_u", "n_v") >= near.percent * F.greatest("m_u", "m_v")) & (F.col("u") != F.col("v"))
        return pairs.distinct().join(u, "u").join(v, "v").where(fits).select("u", "v", F.greatest("n_u", "n_v").alias("n"))

    compared = written(bucket_rows.select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct(), "compared")
    links = confirmed(docs, sized(compared), near)
    of = components(links)
    found = across(docs, bucket_rows.where("members > 2").select("key", "rep"), of, classes, near)
    if found is not None:
        of = components(links.unionByName(found))
    roots = of.select(F.col("u").alias("rep"), F.col("v").alias("root"))
    of_class = classes.select("s1", "s2", "n_shingles", "rep").join(roots, "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    out = rows.select("doc_id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2", "n_shingles"], "left")
    root = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """``docs``, with all columns, whatever their names, without the near duplicates of a document with a smaller doc_id.

    Texts without words (null, empty, blank) have no duplicates; rows of one doc_id are one document of several texts and
    stay or go together, as they are; rows with null doc_id stay. An empty table gives an empty one. Ids to drop are
    broadcast if they are few, else texts are shuffled by doc_id once.
    """
    gone = written(linked(docs, near).where("NOT kept").select(F.col("doc_id")).distinct(), "gone")
    return _chosen(docs, gone, gone.count(), near, "left_anti").select(*[quoted(c) for c in docs.columns])
