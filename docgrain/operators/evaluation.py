"""Retrieval and answer metrics over tables of items and results.

items: id, question, gold (array), reference_answer, difficulty, query_type, domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import fusion
from ..plans import retrieval

FAILURES = ("retrieval_miss_positive", "false_refusal_positive", "missing_citations_positive", "citation_mismatch_positive", "answered_negative_query", "citations_on_negative_query")


def with_defaults(items: DataFrame) -> DataFrame:
    """Absent gold is empty, difficulty easy, query_type positive if there is gold."""
    gold = F.coalesce(F.col("gold"), F.array().cast("array<string>"))
    out = items.withColumn("gold", gold).withColumn("difficulty", F.coalesce("difficulty", F.lit("easy")))
    return out.withColumn("query_type", F.coalesce("query_type", F.when(F.size("gold") > 0, "positive").otherwise("negative")))


def recall_at_k(retrieved: Column, gold: Column, k: int) -> Column:
    """1 if any gold id is among the first k, else 0."""
    return F.when((F.size(gold) > 0) & F.arrays_overlap(F.slice(retrieved, 1, k), gold), 1.0).otherwise(0.0)


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    """1 / place of the first gold id in the whole list, 0 if there is none."""
    first = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def as_queries(items: DataFrame, k: int) -> DataFrame:
    return items.select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.lit(k).alias("top_k"), F.lit(None).cast("string").alias("department"), F.lit("restricted").alias("access_level"))


def ranked_ids(found: retrieval.Retrieved, k: int, mode: str, settings: Settings = Settings()) -> DataFrame:
    """query_id, chunk_id, rank by "bm25", "dense", "hybrid" (the whole service) or, else, plain fusion.

    found: retrieve() of as_queries(), whose lists are longer than k and have no filters, so shorter ones are their heads.
    """
    if mode == "hybrid":
        return found.hits.select("query_id", "chunk_id", "rank")
    n = k if mode in ("bm25", "dense") else max(10, k)
    lex, den = (hits.where(F.col("rank") <= n) for hits in (found.lexical, found.dense))
    if mode in ("bm25", "dense"):
        return (lex if mode == "bm25" else den).select("query_id", "chunk_id", "rank")
    weights = found.weights.select("query_id", F.lit(settings.lexical_weight).alias("lexical"), F.lit(settings.dense_weight).alias("dense"))
    return fusion.fuse(lex, den, weights, k, settings.fusion_method).select("query_id", "chunk_id", "rank")


def listed(ranked: DataFrame) -> DataFrame:
    """query_id and its chunk ids in order."""
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))


def retrieval_rows(items: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """id, recall, mrr of every item that has gold."""
    found = items.where(F.size("gold") > 0).join(listed(ranked).withColumnRenamed("query_id", "id"), "id", "left")
    ids = F.coalesce("retrieved", F.array().cast("array<string>"))
    return found.select("id", "question", ids.alias("retrieved"), "gold", recall_at_k(ids, F.col("gold"), k).alias("recall"), reciprocal_rank(ids, F.col("gold")).alias("mrr"))


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """One row of means; 0 without rows. evidence_hit_rate is the recall."""
    mean = {c: F.coalesce(F.avg(c), F.lit(0.0)) for c in ("recall", "mrr")}
    return rows.agg(F.count("*").alias("n"), mean["recall"].alias("recall_at_k"), mean["mrr"].alias("mrr"), mean["recall"].alias("evidence_hit_rate"))


def run_retrieval_eval(corpus: retrieval.Corpus, items: DataFrame, k: int, modes: tuple[str, ...] = ("bm25", "dense", "hybrid"), settings: Settings = Settings(), found: retrieval.Retrieved | None = None) -> DataFrame:
    """A row of retrieval_summary() for each mode, all from one retrieval: ``found``, if it ran already."""
    found = found or retrieval.retrieve(corpus, as_queries(items, k), settings)
    out = None
    for mode in modes:
        one = retrieval_summary(retrieval_rows(items, ranked_ids(found, k, mode, settings), k)).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def answer_rows(items: DataFrame, answers: DataFrame) -> DataFrame:
    """id, status and whether refusal was expected and given."""
    joined = items.join(answers.select(F.col("query_id").alias("id"), "answer", "status", "confidence", "citations"), "id")
    expected = (F.size("gold") == 0) | (F.col("query_type") == "negative")
    return joined.withColumn("expected_not_found", expected).withColumn("predicted_not_found", F.col("status") == "NOT_FOUND").withColumn("citation_count", F.size("citations"))


def answer_summary(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of refusals."""
    expected, predicted = F.col("expected_not_found"), F.col("predicted_not_found")
    counts = rows.agg(F.count_if(expected & predicted).alias("tp"), F.count_if(~expected & predicted).alias("fp"), F.count_if(expected & ~predicted).alias("fn"))
    p, r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall")).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")))


def failures(items: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each failure of each item: id, failure, query_type, difficulty, and what was retrieved and cited."""
    found = items.join(listed(hits).withColumnRenamed("query_id", "id"), "id", "left").join(answers.select(F.col("query_id").alias("id"), "status", "confidence", F.transform("citations", lambda c: c["chunk_id"]).alias("cited")), "id")
    none = F.array().cast("array<string>")
    found = found.withColumn("retrieved", F.coalesce("retrieved", none)).withColumn("cited", F.coalesce("cited", none))
    positive, refused, bare = F.size("gold") > 0, F.col("status") == "NOT_FOUND", F.size("cited") == 0
    rules = (
        positive & ~F.arrays_overlap("retrieved", "gold"),
        positive & refused,
        positive & ~refused & bare,
        positive & ~refused & ~bare & ~F.arrays_overlap("cited", "gold"),
        ~positive & ~refused,
        ~positive & ~bare,
    )
    kinds = F.filter(F.array(*[F.when(rule, name) for name, rule in zip(FAILURES, rules)]), lambda x: x.isNotNull())
    return found.select("*", F.explode(kinds).alias("failure"))


def failure_counts(failed: DataFrame) -> DataFrame:
    """Counts by failure, by query_type and by difficulty in one pass: kind, name, n."""
    sets = failed.select("failure", "query_type", "difficulty").groupingSets([["failure"], ["query_type"], ["difficulty"]], "failure", "query_type", "difficulty")
    counted = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "failure").when(F.col("g") == 5, "query_type").otherwise("difficulty")
    return counted.select(kind.alias("kind"), F.coalesce("failure", "query_type", "difficulty").alias("name"), "n")


def failure_samples(failed: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` failures of each kind, by id."""
    order = Window.partitionBy("failure").orderBy("id")
    return failed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def failure_rates(items: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: items, positives, negatives, retrieval recall, false-refusal and negative-hallucination rates."""
    ids = listed(hits).withColumnRenamed("query_id", "id")
    joined = items.join(ids, "id", "left").join(answers.select(F.col("query_id").alias("id"), "status"), "id")
    positive, refused = F.size("gold") > 0, F.col("status") == "NOT_FOUND"
    hit = F.coalesce(F.arrays_overlap("retrieved", "gold"), F.lit(False))
    counts = joined.agg(F.count("*").alias("total_items"), F.count_if(positive).alias("positive_items"), F.count_if(~positive).alias("negative_items"), F.count_if(positive & hit).alias("a"), F.count_if(positive & refused).alias("b"), F.count_if(~positive & ~refused).alias("c"))
    one = F.lit(1)
    return counts.select("total_items", "positive_items", "negative_items", (F.col("a") / F.greatest(one, "positive_items")).alias("retrieval_recall_at_k"), (F.col("b") / F.greatest(one, "positive_items")).alias("false_refusal_rate"), (F.col("c") / F.greatest(one, "negative_items")).alias("negative_hallucination_rate"))
