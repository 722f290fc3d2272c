"""The engine: ingest files, build indexes, search and ask for tables of queries, evaluate."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from . import config
from .cluster import written
from .operators import evaluation
from .plans import retrieval
from .sources import files, indexes


class Engine:
    def __init__(self, spark: SparkSession, settings: config.Settings = config.Settings()):
        self.spark, self.settings = spark, config.validate(settings)
        self.corpus: retrieval.Corpus | None = None

    def health(self) -> dict[str, object]:
        return {"status": "ok", "version": self.settings.version, "indices_loaded": self.corpus is not None, "llm_loaded": self.settings.llm_backend == "heuristic"}

    def ingest(self) -> DataFrame:
        """Chunks of the raw folder, written to the chunk path and read back."""
        files.write_jsonl(files.ingest(self.spark, self.settings), self.settings.chunk_output_path)
        return files.read_chunks(self.spark, self.settings.chunk_output_path)

    def build(self, chunks: DataFrame | None = None, save: bool = False) -> "Engine":
        """Indexes ``chunks``, or those of the chunk path; with ``save`` also writes both indexes."""
        chunks = files.read_chunks(self.spark, self.settings.chunk_output_path) if chunks is None else chunks
        self.corpus = retrieval.build_corpus(chunks, self.settings)
        if save:
            indexes.save_lexical(self.corpus.lexical, self.settings.bm25_index_path)
            indexes.save_dense(self.corpus.dense, self.settings.dense_index_dir)
        return self

    def load(self) -> "Engine":
        chunks = files.read_chunks(self.spark, self.settings.chunk_output_path)
        self.corpus = retrieval.Corpus(chunks, indexes.load_lexical(self.spark, self.settings.bm25_index_path), indexes.load_dense(self.spark, self.settings.dense_index_dir))
        return self

    def _built(self) -> retrieval.Corpus:
        if self.corpus is None:
            raise ValueError("build() or load() indexes first")
        return self.corpus

    def queries(self, *texts: str, top_k: int = 5, department: str | None = None, access_level: str | None = "public") -> DataFrame:
        """A query table of texts, numbered from 0."""
        rows = [(str(i), t, top_k, department, access_level) for i, t in enumerate(texts)]
        return self.spark.createDataFrame(rows, "query_id string, query string, top_k int, department string, access_level string")

    def search(self, queries: DataFrame) -> DataFrame:
        return retrieval.search(self._built(), queries, self.settings)

    def search_debug(self, queries: DataFrame) -> DataFrame:
        return retrieval.search_debug(self._built(), queries, self.settings)

    def ask(self, queries: DataFrame) -> DataFrame:
        return retrieval.ask(self._built(), queries, self.settings)

    def evaluate(self, items: DataFrame, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
        """Retrieval means by mode, and refusal precision, recall and F1."""
        corpus = self._built()
        queries = evaluation.as_queries(items, top_k)
        found = retrieval.retrieve(corpus, queries, self.settings)
        answered = retrieval.ask(corpus, queries, self.settings, found)
        return evaluation.run_retrieval_eval(corpus, items, top_k, settings=self.settings, found=found), evaluation.answer_summary(evaluation.answer_rows(items, answered))

    def ask_debug(self, queries: DataFrame) -> DataFrame:
        """ask() with both retrievers' lists, weights and thresholds."""
        return retrieval.ask_debug(self._built(), queries, self.settings)

    def report(self, items: DataFrame, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
        """failure_rates() and failures() of the whole service."""
        corpus, queries = self._built(), evaluation.as_queries(items, top_k)
        found = retrieval.retrieve(corpus, queries, self.settings)
        answered = retrieval.ask(corpus, queries, self.settings, found)
        return evaluation.failure_rates(items, found.hits, answered), evaluation.failures(items, found.hits, answered)

    def full_report(self, items: DataFrame, top_k: int = 5, sample_limit: int = 5) -> dict:
        """The report as a dictionary: rates, counts by kind, and the first ``sample_limit`` failures of each kind.

        All that is collected is one row, the counts and so many samples.
        """
        rates, failed = self.report(items, top_k)
        failed = written(failed, "failures")
        counts = evaluation.failure_counts(failed).collect()
        samples: dict[str, list[dict]] = {}
        for r in evaluation.failure_samples(failed, sample_limit).orderBy("failure", "place").collect():
            samples.setdefault(r["failure"], []).append({"id": r["id"], "question": r["question"], "gold_chunk_ids": r["gold"], "retrieved_ids": r["retrieved"], "answer_status": r["status"], "confidence": r["confidence"], "citation_ids": r["cited"], "query_type": r["query_type"], "difficulty": r["difficulty"], "domain": r["domain"] or "General"})
        by = {kind: {r["name"]: r["n"] for r in counts if r["kind"] == kind} for kind in ("failure", "query_type", "difficulty")}
        summary = rates.first().asDict()
        return {"summary": {"top_k": top_k, **summary}, "failure_counts": by["failure"], "failures_by_query_type": by["query_type"], "failures_by_difficulty": by["difficulty"], "failure_samples": samples}


@lru_cache(maxsize=1)
def service(path: str | None = None) -> Engine:
    """The process's engine, with loaded indexes, by the settings file of ``path`` or of APP_CONFIG_PATH."""
    settings = config.load_settings(path or os.environ.get("APP_CONFIG_PATH", "config/default.yaml"))
    config.ensure_directories(settings)
    return Engine(SparkSession.builder.getOrCreate(), settings).load()
