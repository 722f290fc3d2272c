"""Hybrid retrieval and answering for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..config import Settings
from ..functions import text as T
from ..operators import answering, dense, fusion, generation, lexical


@dataclass(frozen=True)
class Corpus:
    """chunks and both indexes."""

    chunks: DataFrame
    lexical: lexical.LexicalIndex
    dense: dense.DenseIndex


def with_tokens(chunks: DataFrame) -> DataFrame:
    """``chunks``, or hits joined with theirs, with the token sets that every overlap score needs, computed once."""
    meta = F.concat_ws(" ", "title", "section_path")
    return chunks.select("*", T.token_set(F.col("text")).alias("text_tokens"), T.token_set(F.col("title")).alias("title_tokens"), T.token_set(F.col("section_path")).alias("section_tokens"), T.token_set(meta).alias("meta_tokens"))


def build_corpus(chunks: DataFrame, settings: Settings = Settings()) -> Corpus:
    """Chunks are written with their index tokens, which both indexes read."""
    found = written(lexical.with_index_tokens(chunks), "chunks")
    return Corpus(found.drop(lexical.INDEX_TOKENS, lexical.INDEX_LENGTH), lexical.build_index(found), dense.build_index(found, settings.embedding_model))


def normalized_queries(queries: DataFrame) -> DataFrame:
    """query_id, query, top_k, department, access_level; absent columns get 5, null and "public"."""

    def column(name: str, default: Column) -> Column:
        return F.col(name) if name in queries.columns else default

    return queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        "query",
        column("top_k", F.lit(5)).cast("int").alias("top_k"),
        column("department", F.lit(None)).cast("string").alias("department"),
        column("access_level", F.lit("public")).cast("string").alias("access_level"),
    )


def candidate_size(settings: Settings, top_k: int) -> int:
    return max(settings.candidate_size, top_k * 3, 10)


@dataclass(frozen=True)
class Retrieved:
    hits: DataFrame
    lexical: DataFrame
    dense: DataFrame
    weights: DataFrame


def boosted(corpus: Corpus, queries: DataFrame, settings: Settings, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hits after fusion and both boosts, and what they came from. Only the hits' texts are tokenised.

    queries: with ``candidates``, how many each has of either list and of the fused one, ``n`` at the most.
    """
    sizes = queries.select("query_id", "candidates")

    def own(ranked: DataFrame) -> DataFrame:
        return ranked.join(sizes, "query_id").where(F.col("rank") <= F.col("candidates")).drop("candidates")

    lex = written(own(lexical.search(corpus.lexical, queries, n)), "bm25")
    den = written(dense.search(corpus.dense, queries, n, settings.embedding_model), "dense")
    weight = fusion.query_weights(F.col("query"), settings.lexical_weight, settings.dense_weight)
    weights = queries.select("query_id", weight.alias("w")).select("query_id", "w.lexical", "w.dense")
    fused = own(fusion.fuse(lex, den, weights, n, settings.fusion_method))
    asked = queries.select("query_id", "query", "top_k", T.token_set(F.col("query")).alias("q"), T.query_targets(F.col("query")).alias("targets"))
    full = with_tokens(fused.join(corpus.chunks, "chunk_id")).join(asked, "query_id").withColumn("score", F.col("fused"))
    dated = fusion.recency_boost(full, settings.recency_weight)
    return written(fusion.metadata_boost(dated, settings.metadata_weight), "boosted"), lex, den, weights


def retrieve(corpus: Corpus, queries: DataFrame, settings: Settings = Settings()) -> Retrieved:
    """Hits of every query: fused, boosted by date and metadata, filtered and cut to the query's top_k.

    Queries of different top_k have candidates of their own number in one retrieval. The two retrievers' lists and the boosted candidates are a few rows a query and are written tables.
    """
    queries = normalized_queries(queries)
    most = queries.agg(F.max("top_k")).first()[0] or 1
    if queries.where("top_k < 1 OR top_k > 50 OR query IS NULL OR query = ''").limit(1).count():
        raise ValueError("queries must not be empty and top_k must be from 1 to 50")
    size = F.greatest(F.lit(settings.candidate_size), F.col("top_k") * 3, F.lit(10)).alias("candidates")
    ranked, lex, den, weights = boosted(corpus, queries.select("*", size), settings, candidate_size(settings, most))
    hits = fusion.threshold_filter(ranked, F.col("top_k"), settings.min_score, settings.min_relative_score, settings.min_overlap)
    return Retrieved(written(hits, "hits"), lex, den, weights)


def search(corpus: Corpus, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, doc_id, title, section_path, chunk_id, score, retrieval_source, snippet."""
    hits = retrieve(corpus, queries, settings).hits
    return hits.select("query_id", "rank", "doc_id", "title", "section_path", "chunk_id", "score", F.lit("hybrid").alias("retrieval_source"), T.search_snippet(F.col("text")).alias("snippet"))


def _listed(queries: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """query_id and the first top_k of a retriever's list, as structs of chunk_id and score."""
    cut = hits.join(queries.select("query_id", "top_k"), "query_id").where("rank <= top_k")
    pairs = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score")))
    return cut.groupBy("query_id").agg(F.transform(pairs, lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"))).alias(name))


def search_debug(corpus: Corpus, queries: DataFrame, settings: Settings = Settings(), found: Retrieved | None = None) -> DataFrame:
    """One row a query: both retrievers' first top_k hits, weights, candidate size and thresholds."""
    queries = normalized_queries(queries)
    found = found or retrieve(corpus, queries, settings)
    out = queries.select("query_id", "top_k").join(found.weights, "query_id").join(_listed(queries, found.lexical, "bm25"), "query_id", "left").join(_listed(queries, found.dense, "vector"), "query_id", "left")
    size = F.greatest(F.lit(settings.candidate_size), F.col("top_k") * 3, F.lit(10))
    return out.select("query_id", "bm25", F.col("vector").alias("dense"), F.col("lexical").alias("lexical_weight"), F.col("dense").alias("dense_weight"), size.alias("candidate_size"), F.lit(settings.min_score).alias("min_score"), F.lit(settings.min_relative_score).alias("min_relative_score"), F.lit(settings.min_overlap).alias("min_overlap"))


#: Settings that ask_debug() shows beside those of search_debug().
ASK_THRESHOLDS = ("min_citation_relevance", "min_top_relevance", "min_yesno_relevance", "min_open_coverage")


def judged(corpus: Corpus, queries: DataFrame, settings: Settings = Settings(), found: Retrieved | None = None) -> DataFrame:
    """One row a query with citations, features and gates; found: what retrieve() gave for these queries, if it ran."""
    queries, settings = normalized_queries(queries), generation.effective(settings)
    found = found or retrieve(corpus, queries, settings)
    rows = generation.drafted(answering.gathered(queries, found.hits), settings)
    return answering.gated(answering.features(answering.select_citations(rows, settings), settings), settings)


def ask(corpus: Corpus, queries: DataFrame, settings: Settings = Settings(), found: Retrieved | None = None) -> DataFrame:
    return answering.answers(judged(corpus, queries, settings, found), generation.effective(settings))


def ask_debug(corpus: Corpus, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """ask() with ``retrieval``, a struct of search_debug(), and ``thresholds`` of the gates; one retrieval for both."""
    found = retrieve(corpus, queries, settings)
    shown = search_debug(corpus, queries, settings, found)
    thresholds = F.struct(*[F.lit(getattr(settings, name)).alias(name) for name in ASK_THRESHOLDS], F.lit(answering.MIN_DOC_COVERAGE).alias("min_doc_coverage"))
    shown = shown.select("query_id", F.struct(*[c for c in shown.columns if c != "query_id"]).alias("retrieval"))
    return ask(corpus, queries, settings, found).join(shown, "query_id").withColumn("thresholds", thresholds)
