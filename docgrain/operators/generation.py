"""Drafts of answers: by the built-in heuristic, or by a local text-generation model where its package is installed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import map_arrow
from ..config import Settings
from ..functions import fixed
from ..functions import text as T


def draft_answer(hits: Column) -> Column:
    """What the heuristic says of the first three hits."""
    return F.when(F.size(hits) == 0, fixed.NOT_FOUND).otherwise(F.array_join(F.transform(F.slice(hits, 1, 3), lambda h: T.draft_bullet(h["text"])), "\n"))


def first_ids(hits: Column) -> Column:
    return F.transform(F.slice(hits, 1, 3), lambda h: h["chunk_id"])


def read_output(output: str) -> tuple[str, list[str]] | None:
    """Answer and cited chunk ids of a model's output, whose last line is a JSON object; None if it isn't."""
    try:
        payload = json.loads(output.split("\n")[-1].strip())
        cited = payload.get("citations", [])
        ids = [str(c["chunk_id"]) for c in cited if isinstance(c, dict) and c.get("chunk_id")] if isinstance(cited, list) else []
        return str(payload.get("answer", fixed.NOT_FOUND)), ids
    except (ValueError, AttributeError):
        return None


def local_model(settings: Settings) -> Callable[[str], str]:
    """Greedy generation by the model that the settings name."""
    from transformers import pipeline

    pipe = pipeline("text-generation", model=settings.llm_model)
    return lambda prompt: pipe(prompt, max_new_tokens=settings.max_new_tokens, do_sample=False)[0]["generated_text"]


@lru_cache(maxsize=8)
def _loads(settings: Settings, load: Callable[[Settings], Callable[[str], str]]) -> bool:
    try:
        load(settings)
    except Exception:  # noqa: BLE001  any failure of an optional model means the heuristic
        return False
    return True


def effective(settings: Settings, load: Callable[[Settings], Callable[[str], str]] = local_model) -> Settings:
    """``settings`` with the heuristic backend if the chosen one can't be loaded: its package or its model is missing or
    broken. The driver tries once for each settings."""
    if settings.llm_backend == "transformers" and not _loads(settings, load):
        return replace(settings, llm_backend="heuristic")
    return settings


def drafted(rows: DataFrame, settings: Settings, load: Callable[[Settings], Callable[[str], str]] = local_model) -> DataFrame:
    """``rows`` (query_id, question, hits) with ``draft`` and ``preferred``, the ids that the draft cites.

    An output that can't be read means the heuristic's draft. A model runs once a query, on the executors.
    """
    rows = rows.withColumn("draft", draft_answer(F.col("hits"))).withColumn("preferred", first_ids(F.col("hits")))
    if settings.llm_backend != "transformers":
        return rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = load(settings)
        for batch in batches:
            found = [read_output(generate(p)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.list_(pa.string()))], ["query_id", "said", "cited"])

    prompts = rows.select("query_id", T.build_prompt(F.col("question"), F.col("hits")).alias("prompt"))
    said = map_arrow(prompts, work, "query_id string, said string, cited array<string>")
    joined = rows.join(said, "query_id", "left")
    return joined.withColumn("draft", F.coalesce("said", "draft")).withColumn("preferred", F.coalesce("cited", "preferred")).drop("said", "cited")
