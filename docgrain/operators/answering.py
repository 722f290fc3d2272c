"""Citations, refusal gates and answers, from one row a query with its hits in an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import fixed
from ..functions import text as T

#: What a hit of the array has.
HIT_FIELDS = ("rank", "score", "doc_id", "chunk_id", "title", "section_path", "text")


def gathered(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every query (query_id, query, top_k) with ``hits``, its hits in rank order; queries without hits stay."""
    arrays = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*HIT_FIELDS))).alias("hits"))
    empty = F.array().cast("array<struct<rank:int,score:double,doc_id:string,chunk_id:string,title:string,section_path:string,text:string>>")
    joined = queries.select("query_id", F.col("query").alias("question"), "top_k").join(arrays, "query_id", "left")
    return joined.withColumn("hits", F.coalesce("hits", empty))


def relevance(h: Column, q: Column, titles: Column, sections: Column, preferred: Column, settings: Settings) -> Column:
    """Struct of a hit's relevance as a citation; relevance 0 and less, and null, mean none."""
    overlap = _overlap(q, T.token_set(h["text"]))

    def of(m: Column) -> Column:
        out = 0.55 * h["score"] + 0.45 * m["o"] + 0.65 * m["d"] + 0.75 * m["s"]
        out = out + F.when(F.array_contains(preferred, h["chunk_id"]), 0.05).otherwise(0.0)
        out = out - F.when((F.size(titles) > 0) & (m["d"] < 0.25), 0.20).otherwise(0.0)
        out = out - F.when((F.size(sections) > 0) & (m["s"] < 0.20), 0.10).otherwise(0.0)
        weak = (h["score"] < settings.min_score) | ((m["o"] < settings.min_citation_relevance) & (F.greatest(m["d"], m["s"]) < 0.35))
        return F.when(~weak, out)

    parts = F.struct(overlap.alias("o"), T.best_phrase_score(titles, T.token_set(h["title"])).alias("d"), T.best_phrase_score(sections, T.token_set(h["section_path"])).alias("s"))
    return T.let(parts, of)


def _overlap(q: Column, c: Column) -> Column:
    return F.when((F.size(q) == 0) | (F.size(c) == 0), 0.0).otherwise(T.overlap_score(q, c))


def select_citations(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` of gathered() and drafted() with ``q``, ``targets``, ``n_candidates``, ``selected`` (hits in order) and ``coverage``.

    Coverage is of candidates before equal texts are dropped.
    """
    rows = rows.withColumn("q", T.token_set(F.col("question"))).withColumn("targets", T.query_targets(F.col("question")))
    titles = F.transform(F.col("targets.doc_titles"), T.token_set)
    sections = F.transform(F.col("targets.sections"), T.token_set)
    rows = rows.withColumn("titles", titles).withColumn("sections", sections)
    rated = F.transform("hits", lambda h: F.struct(F.round(-relevance(h, F.col("q"), F.col("titles"), F.col("sections"), F.col("preferred"), settings), 9).alias("minus"), h["rank"].alias("rank"), T.signature(h["text"]).alias("sig"), h.alias("hit")))
    rows = rows.withColumn("candidates", F.array_sort(F.filter(rated, lambda x: x["minus"] < 0)))
    kind = rows.schema["candidates"].dataType.simpleString()
    first = F.aggregate("candidates", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: y["sig"] == x["sig"]), acc).otherwise(F.array_append(acc, x)))
    rows = rows.withColumn("selected", F.transform(F.slice(first, 1, settings.max_citations), lambda x: x["hit"])).withColumn("n_candidates", F.size("candidates"))
    coverage = F.when(F.col("n_candidates") == 0, 0.0).otherwise(F.size("selected") / F.greatest(F.lit(1), F.least(F.lit(settings.max_citations), F.col("n_candidates"))))
    return rows.withColumn("coverage", coverage).drop("titles", "sections", "candidates")


def confidence(top: Column, coverage: Column, n_hits: Column) -> Column:
    return F.when(n_hits == 0, "Low").when((top >= 0.75) & (coverage >= 1.0), "High").when((top >= 0.35) & (coverage >= 0.5), "Medium").otherwise("Low")


def features(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds what the gates look at. An absent first hit counts 0."""
    q, hits = F.col("q"), F.col("hits")
    some = F.size(hits) > 0
    near = F.slice(hits, 1, max(5, settings.max_citations))

    def spelled(h: Column) -> Column:
        return F.concat_ws(" ", h["title"], h["section_path"], h["text"])

    rows = rows.withColumn("top", F.get(hits, 0)).withColumn("n_hits", F.size(hits))
    of_top = [T.token_set(F.col("top.title")), T.token_set(F.col("top.section_path")), T.token_set(F.concat_ws(" ", "top.title", "top.section_path"))]
    rows = rows.withColumn("top_text", F.when(some, _overlap(q, T.token_set(F.col("top.text")))).otherwise(0.0))
    rows = rows.withColumn("top_meta", F.when(some, F.greatest(*[_overlap(q, t) for t in of_top])).otherwise(0.0))
    rows = rows.withColumn("top_relevance", F.greatest("top_text", "top_meta")).withColumn("top_score", F.coalesce("top.score", F.lit(0.0)))
    same = F.filter(near, lambda h: h["doc_id"] == F.col("top.doc_id"))
    rows = rows.withColumn("same_doc", F.transform(same, spelled)).withColumn("support", F.size("same_doc"))
    second = F.coalesce(F.get(hits, 1)["score"], F.lit(0.0))
    rows = rows.withColumn("second_ratio", F.when((F.size(hits) >= 2) & (F.col("top_score") > 0), second / F.col("top_score")).otherwise(0.0))
    evidence = F.transform(F.when(F.size("selected") > 0, F.col("selected")).otherwise(F.slice(hits, 1, settings.max_citations)), spelled)
    rows = rows.withColumn("evidence", evidence)
    rows = rows.withColumn("open_coverage", T.token_coverage(F.col("question"), F.col("evidence"), 5))
    rows = rows.withColumn("doc_coverage", T.token_coverage(F.col("question"), F.col("same_doc"), 4))
    return rows.withColumn("reference", F.size("targets.quoted_phrases") > 0).withColumn("yes_no", T.is_yes_no(F.col("question")))


def gates(settings: Settings = Settings()) -> dict[str, Column]:
    """Reasons to refuse, by name, over the columns of features(); any of them refuses."""
    c = F.col
    open_query = ~c("reference")
    draft = F.trim(F.upper(c("draft")))
    return {
        "n1_no_hits": c("n_hits") == 0,
        "n2_low_score": c("top_score") < settings.min_score,
        "n3_low_coverage": c("coverage") < settings.min_citation_coverage,
        "n4_low_relevance": c("top_relevance") < settings.min_top_relevance,
        "n5_draft": draft == fixed.NOT_FOUND,
        "n6_yes_no": c("yes_no") & (c("top_relevance") < settings.min_yesno_relevance),
        "n7_yes_no_open": c("yes_no") & open_query & (c("top_text") < 0.75),
        "n8_open_relevance": open_query & (c("top_relevance") < max(settings.min_top_relevance, 0.18)),
        "n9_open_support": open_query & (c("top_text") <= 0.5) & (c("top_meta") < 0.5) & (c("support") < 2) & (c("second_ratio") < 0.95),
        "n10_numbers": ~T.numbers_supported(c("question"), c("evidence")),
        "n11_acronyms": ~T.acronyms_supported(c("question"), c("evidence")),
        "n12_open_coverage": open_query & (c("open_coverage") < settings.min_open_coverage),
        "n13_doc_coverage": open_query & (c("support") >= 2) & (c("doc_coverage") < MIN_DOC_COVERAGE),
        "n14_no_citation": F.lit(settings.llm_backend == "heuristic") & (F.size(c("selected")) == 0),
    }


#: Least coverage of an open question by the first hit's document.
MIN_DOC_COVERAGE = 0.5
DEBUG = ("top_score", "coverage", "top_relevance", "top_text", "top_meta", "support", "second_ratio", "open_coverage", "doc_coverage")


def gated(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """features() with a boolean column for each gate and ``refused``."""
    found = gates(settings)
    rows = rows.select("*", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in found.items()])
    refused = F.lit(False)
    for name in found:
        refused = refused | F.col(name)
    return rows.withColumn("refused", refused)


def answers(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a query: answer, citations, confidence, status, clarifying_question and a struct ``debug``."""
    cited = F.transform("selected", lambda h: F.struct(h["title"].alias("title"), h["section_path"].alias("section_path"), h["chunk_id"].alias("chunk_id")))
    bullets = F.array_join(F.transform("selected", lambda h: T.snippet(h["text"])), "\n")
    text = bullets if settings.llm_backend == "heuristic" else F.col("draft")
    no = F.col("refused")
    return rows.select(
        "query_id",
        "question",
        F.when(no, fixed.REFUSAL).otherwise(text).alias("answer"),
        F.when(no, F.slice(cited, 1, 0)).otherwise(cited).alias("citations"),
        F.when(no, "Low").otherwise(confidence(F.col("top_score"), F.col("coverage"), F.col("n_hits"))).alias("confidence"),
        F.when(no, "NOT_FOUND").otherwise("ANSWERED").alias("status"),
        F.when(no, T.clarifying_question(F.col("question"))).alias("clarifying_question"),
        F.struct(*DEBUG).alias("debug"),
    )
