"""Fusion of two rankings, boosts and thresholds.

Hits are rows of query_id, chunk_id, rank and scores; a rank that is asked for is total, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K = 60
TINY = 1e-8


def minmax(scored: DataFrame, score: str = "score", by: str = "query_id") -> DataFrame:
    """``scored`` with ``norm``: 0 to 1 within the query, 1 for all if they don't differ."""
    group = Window.partitionBy(by)
    low, high = F.min(score).over(group), F.max(score).over(group)
    return scored.withColumn("low", low).withColumn("high", high).withColumn("norm", F.when(F.col("high") - F.col("low") < TINY, 1.0).otherwise((F.col(score) - F.col("low")) / (F.col("high") - F.col("low")))).drop("low", "high")


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank, ranks from 1."""
    return F.lit(1.0) / (F.lit(k) + rank)


def query_weights(query: Column, lexical: float = 0.62, dense: float = 0.38) -> Column:
    """Struct of lexical and dense weights: digits or capitals favour words, ten words and more favour meaning."""

    def of(tokens: Column) -> Column:
        code = F.exists(tokens, lambda t: F.regexp_like(t, F.lit(r"\p{Nd}")) | ((F.length(t) >= 2) & (t == F.upper(t)) & (t != F.lower(t))))
        long = F.size(tokens) >= 10
        lex = F.greatest(F.lit(0.1), F.lit(lexical) + F.when(code, 0.15).otherwise(0.0) - F.when(long, 0.10).otherwise(0.0))
        den = F.greatest(F.lit(0.1), F.lit(dense) - F.when(code, 0.15).otherwise(0.0) + F.when(long, 0.10).otherwise(0.0))
        return F.struct((lex / (lex + den)).alias("lexical"), (den / (lex + den)).alias("dense"))

    return T.let(T.words_of(query), of)


def fuse(lexical: DataFrame, dense: DataFrame, weights: DataFrame, k: int, method: str = "weighted") -> DataFrame:
    """query_id, chunk_id, bm25_score, dense_score, fused, rank from two rankings and weights (query_id, lexical, dense).

    A hit that one ranking lacks has 0 there. method: "rrf", or anything else for weighted min-max scores.
    """

    def side(hits: DataFrame, name: str) -> DataFrame:
        part = rrf(F.col("rank")) if method == "rrf" else F.col("norm")
        return minmax(hits).select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"), part.alias(f"{name}_part"))

    both = side(lexical, "bm25").join(side(dense, "dense"), ["query_id", "chunk_id"], "full").join(weights, "query_id")
    zero = F.lit(0.0)
    fused = F.round(F.col("lexical") * F.coalesce("bm25_part", zero) + F.col("dense") * F.coalesce("dense_part", zero), 9)
    order = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last())
    out = both.withColumn("fused", fused).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    source = F.when(F.col("bm25_rank").isNotNull() & F.col("dense_rank").isNotNull(), "hybrid").when(F.col("bm25_rank").isNotNull(), "bm25").otherwise("dense")
    return out.select("query_id", "chunk_id", F.coalesce("bm25_score", zero).alias("bm25_score"), F.coalesce("dense_score", zero).alias("dense_score"), "fused", "rank", source.alias("found_by"))


def reranked(hits: DataFrame, score: str) -> DataFrame:
    """Ranks anew by a score, equal scores as before."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "rank")
    return hits.withColumn("new_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("new_rank", "rank")


def recency_boost(hits: DataFrame, weight: float = 0.08) -> DataFrame:
    """``hits`` (with updated_at and score) with newer chunks raised by up to ``weight``, by their place in the span."""
    if weight <= 0:
        return hits
    group = Window.partitionBy("query_id")
    day = F.datediff(T.parse_date(F.col("updated_at")), F.lit("1970-01-01").cast("date"))
    dated = hits.withColumn("day", day).withColumn("first", F.min("day").over(group)).withColumn("span", F.max("day").over(group) - F.col("first"))
    raised = F.when(F.col("span") > 0, F.round(F.col("score") + F.lit(weight) * (F.col("day") - F.col("first")) / F.col("span"), 9)).otherwise(F.col("score"))
    return reranked(dated.withColumn("score", raised).drop("day", "first", "span"), "score")


def metadata_boost_value(weight: float = 0.22) -> Column:
    """Of columns q (the query's tokens), targets, title_tokens, section_tokens and meta_tokens."""
    q, meta = F.col("q"), F.col("meta_tokens")
    titles = F.transform(F.col("targets.doc_titles"), T.token_set)
    sections = F.transform(F.col("targets.sections"), T.token_set)

    def of(doc: Column) -> Column:
        total = F.lit(weight) * F.size(F.array_intersect(q, meta)) / F.greatest(F.lit(1), F.size(q))
        total = total + F.lit(weight * 0.9) * doc + F.lit(weight * 1.1) * T.best_phrase_score(sections, F.col("section_tokens"))
        total = total + F.least(F.lit(0.24), F.lit(0.08) * F.size(F.array_intersect(q, F.col("section_tokens"))))
        return total - F.when((F.size(titles) > 0) & (doc < 0.2), F.lit(weight * 0.15)).otherwise(0.0)

    value = T.let(T.best_phrase_score(titles, F.col("title_tokens")), of)
    return F.when((F.size(q) == 0) | (F.size(meta) == 0), 0.0).otherwise(value)


def metadata_boost(hits: DataFrame, weight: float = 0.22) -> DataFrame:
    """``hits`` raised by what title and section share with the query and its quoted targets."""
    if weight <= 0:
        return hits
    return reranked(hits.withColumn("score", F.round(F.col("score") + metadata_boost_value(weight), 9)), "score")


def threshold_filter(hits: DataFrame, k: Column | int, min_score: float, min_relative: float, min_overlap: float) -> DataFrame:
    """The first ``k`` hits whose score, score against the query's best, and token overlap are high enough."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    overlap = F.greatest(T.overlap_score(F.col("q"), F.col("text_tokens")), T.overlap_score(F.col("q"), F.col("meta_tokens")))
    overlap = F.when((F.size("q") == 0), 0.0).otherwise(overlap)
    rated = hits.withColumn("top", top).withColumn("relative", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)).withColumn("overlap", overlap)
    passed = rated.where((F.col("score") >= min_score) & (F.col("relative") >= min_relative) & (F.col("overlap") >= min_overlap)).drop("top")
    order = Window.partitionBy("query_id").orderBy("rank")
    limit = F.lit(k) if isinstance(k, int) else k
    return passed.withColumn("new_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("new_rank", "rank").where(F.col("rank") <= limit)
