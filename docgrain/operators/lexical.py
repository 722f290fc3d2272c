"""Lexical index and BM25 retrieval for a table of queries.

queries: query_id, query, top_k, department, access_level. Results: query_id, chunk_id, score, rank.

The index is dealt by chunk: shards of about a thousand chunks, and of each term in each shard one block of postings with what
its greatest score can be. A search adds up whole scores within shards and keeps the best of each, so what is shuffled are blocks and
shards x queries x k rows, not a row for each query and chunk; a shard is counted, and scored for a block of queries, as arrays. Shards that can't reach the k-th score that a query's rare terms
alone give are left out; the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import on_cogroup, on_group, ship, written
from ..functions import text as T
from .access import in_department, visible

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Digits that scores keep, so that ties don't depend on the order of a sum.
DIGITS = 9
#: A chunk's tokens, joined by spaces (which no token has) or as an array, and their number.
INDEX_TOKENS, INDEX_LENGTH = "index_tokens", "index_length"
#: What shards hold of a chunk, and blocks of a chunk that has the term.
MEMBER, HIT = ("chunk_id", "dl", "department", "access_level"), ("no", "tf", "dl")
#: Chunks of a shard, about: chunks are dealt by a hash of their ids.
SHARD_CHUNKS = 1024
#: Queries that are scored together in a shard, about.
QUERY_BLOCK = 512
#: Up to so many different terms of the queries are looked up in the Parquet files' statistics; more are joined alone.
MOST_LOOKED_UP = 400
#: A term is rare if it is in one chunk in so many at the most.
RARE = 100
#: Sums in another order differ by less.
SLACK = 1e-6
#: What a shard's best occurrence of a common term has at least, as a guess; and by how much a bound may pass its guess.
COMMON_TF, MARGIN = 2.0, 2.0


@dataclass(frozen=True)
class LexicalIndex:
    """blocks: term, shard, n, most_tf, least_dl, hits (HIT of each chunk, four bytes a number), by term within each file. shards: shard and
    members (chunk_id, dl, department, access_level), whose place is a chunk's no; a null is no longer there. terms: term, df. The numbers are of all chunks."""

    blocks: DataFrame
    shards: DataFrame
    terms: DataFrame
    n_chunks: int
    mean_length: float
    mean_idf: float


def with_index_tokens(chunks: DataFrame) -> DataFrame:
    """``chunks`` with INDEX_TOKENS, as one string, and INDEX_LENGTH.

    As strings tokens are written, shuffled and handed to Python one value a chunk.
    """
    if INDEX_TOKENS not in chunks.columns:
        found = T.index_tokens(T.index_text(F.col("title"), F.col("section_path"), F.col("text")))
        both = T.let(found, lambda t: F.struct(F.array_join(t, " ").alias("joined"), F.size(t).alias("n")))
        chunks = chunks.withColumn("__tokens", both)
        return chunks.withColumns({INDEX_TOKENS: F.col("__tokens.joined"), INDEX_LENGTH: F.col("__tokens.n")}).drop("__tokens")
    if INDEX_LENGTH not in chunks.columns:
        chunks = chunks.withColumns({INDEX_LENGTH: F.size(INDEX_TOKENS), INDEX_TOKENS: F.array_join(INDEX_TOKENS, " ")})
    return chunks


def token_lists(joined: pa.Array | pa.ChunkedArray) -> pa.ListArray:
    """The tokens of strings that have them joined; empty strings have none."""
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    return pc.split_pattern(pc.if_else(pc.equal(joined, ""), pa.scalar(None, joined.type), joined), " ")


def raw_idf(n: int, df: Column) -> Column:
    return F.ln(F.lit(float(n)) - df + 0.5) - F.ln(df + 0.5)


def by_shard(rows: DataFrame) -> DataFrame:
    """``rows`` with a shard's together, in as many tasks as the session's shuffles have."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")


def _blocks(rows: pa.Table) -> pa.Table:
    """The blocks of a shard's chunks, numbered in the order of members."""
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in MEMBER], null_placement="at_start").to_numpy()
    no_of = np.empty(len(order), np.int64)
    no_of[order] = np.arange(len(order))
    lists, dl = token_lists(rows.column("tokens")), rows.column("dl").to_numpy()[order]
    coded = lists.flatten().dictionary_encode()
    no = np.repeat(no_of, lists.value_lengths().fill_null(0).to_numpy())
    keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(order) + no, return_counts=True)
    if not len(keys):
        return pa.table({"shard": pa.array([], pa.int32()), "term": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "occurrences": pa.array([], pa.int64()), "most_tf": pa.array([], pa.int32()), "least_dl": pa.array([], pa.int32()), "hits": pa.array([], pa.binary())})
    term, no = keys // len(order), keys % len(order)
    begins = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    hits = np.ascontiguousarray(np.stack([no, tf, dl[no]], axis=1), "<i4")
    return pa.table({
        "shard": pa.array(np.full(len(begins) - 1, rows.column("shard")[0].as_py(), np.int32)),
        "term": coded.dictionary.take(pa.array(term[begins[:-1]])),
        "n": pa.array(np.diff(begins)),
        "occurrences": pa.array(np.add.reduceat(tf, begins[:-1])),
        "most_tf": pa.array(np.maximum.reduceat(tf, begins[:-1]).astype(np.int32)),
        "least_dl": pa.array(np.minimum.reduceat(dl[no], begins[:-1]).astype(np.int32)),
        "hits": pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((begins * hits.itemsize * len(HIT)).astype(np.int32)), pa.py_buffer(hits)]),
    })


def build_index(chunks: DataFrame) -> LexicalIndex:
    """Chunks and their tokens are shuffled once, by shard; terms are counted and blocks made within it.

    ``chunks`` may bring their tokens as a column INDEX_TOKENS, and their number as INDEX_LENGTH if those are joined. Rows of one
    chunk_id are chunks each.
    """
    made = INDEX_TOKENS in chunks.columns
    chunks = with_index_tokens(chunks).select("chunk_id", "department", "access_level", F.col(INDEX_TOKENS).alias("tokens"), F.col(INDEX_LENGTH).alias("dl"))
    if not made:  # a table, as it is read again
        chunks = written(chunks, "tokens")
    n, blocks, shards = parts(chunks)
    terms = written(blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("occurrences").alias("occurrences")), "terms")
    return with_numbers(blocks, shards, terms.drop("occurrences"), n, terms.agg(F.sum("occurrences")).first()[0] or 0)


def parts(chunks: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written) -> tuple[int, DataFrame, DataFrame]:
    """The number of ``chunks``, and their blocks and shards as ``keep`` writes them; ``chunks`` is a table with chunk_id, department,
    access_level, tokens (joined) and dl."""
    n = chunks.count()
    n_shards = max(1, math.ceil(n / SHARD_CHUNKS))
    rows = by_shard(chunks.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(n_shards)).cast("int")))
    ship(rows.sparkSession)
    kinds = "shard int, term string, n long, occurrences long, most_tf int, least_dl int, hits binary"
    blocks = rows.groupBy("shard").applyInArrow(on_group(_blocks), kinds)
    blocks = keep(blocks.sortWithinPartitions("term", "shard"), "blocks")
    return n, blocks, keep(rows.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(*MEMBER))).alias("members")), "shards")


def with_numbers(blocks: DataFrame, shards: DataFrame, terms: DataFrame, n: int, tokens: int) -> LexicalIndex:
    """An index of ``n`` chunks and so many tokens."""
    mean_idf = terms.agg(F.avg(raw_idf(n, F.col("df")))).first()[0] or 0.0
    return LexicalIndex(blocks, shards, terms, n, tokens / max(1, n), mean_idf)


def fallback_idf(index: LexicalIndex) -> DataFrame:
    """term, df, idf = ln((N + 1) / (df + 1)) + 1, N one at least."""
    n = float(max(1, index.n_chunks))
    return index.terms.select("term", "df", (F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def okapi_idf(index: LexicalIndex) -> DataFrame:
    """term, df, idf = ln(N - df + .5) - ln(df + .5); negative ones are EPSILON times the mean over terms."""
    raw = raw_idf(index.n_chunks, F.col("df"))
    return index.terms.select("term", "df", F.when(raw < 0, F.lit(EPSILON * index.mean_idf)).otherwise(raw).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, department, access_level, term and how often the query has it."""
    rows = queries.select("query_id", F.col("department").alias("want_department"), F.col("access_level").alias("level"), F.explode(T.index_tokens(F.col("query"))).alias("term"))
    return rows.groupBy("query_id", "want_department", "level", "term").agg(F.count("*").alias("times"))


def _part(mean_length, tf, dl, scorer: str):
    """What an occurrence count (a column or an array of doubles) adds to a score, but for the term's weight: grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean_length)) if scorer == "okapi" else tf


def _best(index: LexicalIndex, blocks: DataFrame, wanted: DataFrame, k: int, scorer: str, open_shards: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score: of each shard the ``k`` best chunks of each query that its caller may see and that score.

    Blocks of wanted terms meet, by shard and block of queries, the places that each kind of caller may see.
    """
    ship(wanted.sparkSession)
    mean_length, limited = index.mean_length, open_shards is not None
    parts = max(1, math.ceil(wanted.select("query_id").distinct().count() / QUERY_BLOCK))
    of = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("of")
    caller = F.to_json(F.struct("want_department", "level")).alias("caller")
    wanted = wanted.select("*", of, caller)
    asked = wanted.groupBy("term", "of").agg(F.collect_list(F.struct("query_id", "caller", "weight")).alias("asked"))
    found = blocks.select("shard", "term", "hits").join(asked, "term")
    callers = wanted.select("of", "caller", "want_department", "level").distinct()
    may = F.transform("members", lambda m: F.coalesce(m.isNotNull() & in_department(F.col("want_department"), m["department"]) & visible(F.col("level"), m["access_level"]), F.lit(False)))
    seen = index.shards.crossJoin(callers).select("shard", "of", "caller", may.alias("seen"), F.lit(None).cast("string").alias("query_id"))
    if open_shards is not None:
        opened = open_shards.select("shard", of, "query_id")
        some = opened.select("shard", "of").distinct()
        found, seen = (x.join(some, ["shard", "of"], "left_semi") for x in (found, seen))
        none = F.lit(None)
        seen = seen.unionByName(opened.select("shard", "of", none.cast("string").alias("caller"), none.cast("array<boolean>").alias("seen"), "query_id"))

    def score(terms: pa.Table, places: pa.Table) -> pa.Table:
        out = {"shard": [], "query_id": [], "no": [], "score": []}
        if terms.num_rows and places.num_rows:
            allowed = {c: np.array(s, bool) for c, s in zip(places.column("caller").to_pylist(), places.column("seen").to_pylist()) if c is not None}
            opened = {q for q in places.column("query_id").to_pylist() if q is not None}
            hits, lists = terms.column("hits").combine_chunks().cast(pa.large_binary()), terms.column("asked").combine_chunks()
            _, ends, data = hits.buffers()
            ends = np.frombuffer(ends, np.int64)[hits.offset : hits.offset + len(hits) + 1]
            no, tf, dl = np.frombuffer(data, "<i4")[ends[0] // 4 : ends[-1] // 4].reshape(-1, len(HIT)).T
            h, a = (ends - ends[0]) // (4 * len(HIT)), lists.offsets.to_numpy()
            part = _part(mean_length, tf.astype(float), dl, scorer)
            held = lists.values
            coded, weight = held.field("query_id").dictionary_encode(), held.field("weight").to_numpy(zero_copy_only=False)
            query = coded.indices.to_numpy()
            scores = np.zeros((len(coded.dictionary), max(map(len, allowed.values()))))
            # in the terms' order, so that equal chunks get equal sums
            for t in pc.sort_indices(terms.column("term")).to_numpy():
                i, j = slice(a[t], a[t + 1]), slice(h[t], h[t + 1])
                scores[query[i, None], no[None, j]] += np.outer(weight[i], part[j])
            scores = np.round(scores, DIGITS)
            shard, names, of_query = terms.column("shard")[0].as_py(), coded.dictionary.to_pylist(), dict(zip(query.tolist(), held.field("caller").to_pylist()))
            for q, name in enumerate(names):
                if limited and name not in opened:
                    continue
                mine = scores[q]
                at = np.flatnonzero((mine > 0) & allowed[of_query[q]])
                if len(at) > k:
                    at = at[mine[at] >= np.partition(mine[at], len(at) - k)[len(at) - k]]
                at = at[np.argsort(-mine[at], kind="stable")][:k]  # a shard's places are in the order of chunk_id
                if len(at):
                    for c, x in zip(out, (shard, name, at.tolist(), mine[at].tolist())):
                        out[c].append(x)
        kinds = {"shard": pa.int32(), "query_id": pa.string(), "no": pa.list_(pa.int32()), "score": pa.list_(pa.float64())}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    seen = seen.select(F.col("shard").alias("in_shard"), F.col("of").alias("in_of"), "caller", "seen", "query_id")  # the sides have names of their own
    best = found.groupBy("shard", "of").cogroup(seen.groupBy("in_shard", "in_of")).applyInArrow(on_cogroup(score), "shard int, query_id string, no array<int>, score array<double>")
    named = F.transform(F.arrays_zip("no", "score"), lambda x: F.struct(F.get(F.col("members"), x["no"])["chunk_id"].alias("chunk_id"), x["score"].alias("score")))
    return best.join(index.shards, "shard").select("query_id", F.inline(named))


def prunable(index: LexicalIndex, wanted: DataFrame, k: int, scorer: str = "okapi") -> DataFrame:
    """query_id of the queries whose rare terms may give a bound that some shards' common terms alone don't reach.

    A guess from the terms' numbers, which decides what is worth a bound and not what is found. The bound is taken for what one
    occurrence of the rare term adds that, from the heaviest on, completes ``k`` chunks, MARGIN times; without so many there is none.
    """
    rare = F.col("df") * RARE <= index.n_chunks
    part = lambda tf: float(_part(index.mean_length, tf, index.mean_length, scorer))
    heavier = Window.partitionBy("query_id").orderBy(F.desc("rare"), F.desc("weight"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = wanted.withColumn("rare", rare).withColumn("chunks", F.sum("df").over(heavier))
    guess = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("rare") & (F.col("chunks") >= k), F.col("weight"))).alias("bound"),
        F.coalesce(F.sum(F.when(~F.col("rare"), F.col("weight"))), F.lit(0.0)).alias("common"),
    )
    return guess.where(F.col("bound") * (MARGIN * part(1.0)) > F.col("common") * part(COMMON_TF)).select("query_id")


def candidates(index: LexicalIndex, queries: DataFrame, k: int, scorer: str = "okapi") -> DataFrame:
    """query_id, chunk_id, score: positive scores of chunks that callers may see, the ``k`` best of each query among them.

    First the rare terms are scored; the k-th score that they give is a bound. Then, of all terms, the shards are opened whose blocks
    together can reach it. Where weights may be below 0 (of terms in most chunks of a tiny collection) there is no bound, and for
    queries that aren't prunable() none is sought: all shards are opened.
    """
    idf = okapi_idf(index) if scorer == "okapi" else fallback_idf(index)
    weight = (F.col("times") * F.col("idf")).alias("weight")
    # a table, so that a common term's blocks can be split where the planner doesn't broadcast the queries' terms
    wanted = written(query_terms(queries).join(idf, "term").select("query_id", "want_department", "level", "term", "df", weight), "terms")
    looked_up = [r["term"] for r in wanted.select("term").distinct().limit(MOST_LOOKED_UP + 1).collect()]
    if not looked_up:
        return wanted.select("query_id", F.lit("").alias("chunk_id"), "weight").toDF("query_id", "chunk_id", "score").limit(0)
    # equalities reach the files' statistics, so pages without the terms aren't read
    blocks = index.blocks if len(looked_up) > MOST_LOOKED_UP else index.blocks.where(reduce(lambda a, b: a | b, [F.col("term") == t for t in looked_up]))
    of = wanted.drop("df")
    if index.mean_idf < 0:
        return _best(index, blocks, of, k, scorer)
    bounded = written(prunable(index, wanted, k, scorer), "prunable")
    if not bounded.limit(1).count():
        return _best(index, blocks, of, k, scorer)
    tried = of.join(bounded, "query_id", "left_semi")
    rare = wanted.where(F.col("df") * RARE <= index.n_chunks).join(bounded, "query_id", "left_semi")
    partial = _best(index, blocks, rare.drop("df"), k, scorer)
    bounds = ranked(partial, k, "chunk_id").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") >= k).drop("n")
    reach = F.sum(F.col("weight") * _part(F.lit(index.mean_length), F.col("most_tf").cast("double"), F.col("least_dl"), scorer)).alias("reach")
    reached = blocks.select("term", "shard", "most_tf", "least_dl").join(tried, "term").groupBy("query_id", "shard").agg(reach)
    reached = reached.join(bounds, "query_id", "left").where(F.col("bound").isNull() | (F.col("reach") >= F.col("bound") - SLACK))
    whole = of.select("query_id").distinct().join(bounded, "query_id", "left_anti").crossJoin(index.shards.select("shard"))
    return _best(index, blocks, of, k, scorer, written(reached.select("query_id", "shard").unionByName(whole), "reached"))


def ranked(scored: DataFrame, k: Column | int, *tie: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *tie)
    limit = F.lit(k) if isinstance(k, int) else k
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def search(index: LexicalIndex, queries: DataFrame, k: int, scorer: str = "okapi") -> DataFrame:
    """The ``k`` best chunks of each query, positive scores alone, ties by chunk_id."""
    return ranked(candidates(index, queries, k, scorer), k, "chunk_id")
