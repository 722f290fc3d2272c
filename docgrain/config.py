"""Settings of the engine: a frozen dataclass, read from YAML, captured in plans as literals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Shipped values. ``guardrail_min_score`` and ``default_top_k`` are read and kept, and nothing uses them."""

    version: str = "0.1.0"
    raw_data_dir: str = "data/raw"
    chunk_output_path: str = "data/processed/chunks.jsonl"
    bm25_index_path: str = "data/indices/bm25"
    dense_index_dir: str = "data/indices/dense"
    eval_dataset_path: str = "data/eval/qa_eval.jsonl"
    chunk_size: int = 350
    overlap: int = 80
    default_top_k: int = 5
    fusion_method: str = "weighted"
    lexical_weight: float = 0.62
    dense_weight: float = 0.38
    min_score: float = 0.18
    min_relative_score: float = 0.35
    min_overlap: float = 0.05
    candidate_size: int = 24
    recency_weight: float = 0.08
    metadata_weight: float = 0.22
    embedding_model: str = "hash://384"
    llm_backend: str = "heuristic"
    llm_model: str = ""
    max_new_tokens: int = 256
    guardrail_min_score: float = 0.18
    min_citation_coverage: float = 0.34
    min_citation_relevance: float = 0.08
    min_top_relevance: float = 0.08
    min_yesno_relevance: float = 0.60
    min_open_coverage: float = 0.34
    max_citations: int = 3
    #: False keeps every update date at 1970-01-01, as a pattern that never matches does.
    parse_filename_dates: bool = True


#: Where a setting stands in the file; REQUIRED where it must be, else the value that its absence means.
REQUIRED = object()
PLACES: dict[str, tuple[str, Any]] = {
    "version": ("app.version", "0.1.0"),
    "raw_data_dir": ("paths.raw_data_dir", REQUIRED),
    "chunk_output_path": ("paths.chunk_output_path", REQUIRED),
    "bm25_index_path": ("paths.bm25_index_path", REQUIRED),
    "dense_index_dir": ("paths.dense_index_dir", REQUIRED),
    "eval_dataset_path": ("paths.eval_dataset_path", REQUIRED),
    "chunk_size": ("chunking.chunk_size_tokens", 350),
    "overlap": ("chunking.overlap_tokens", 80),
    "default_top_k": ("retrieval.default_top_k", 5),
    "fusion_method": ("retrieval.fusion_method", "weighted"),
    "lexical_weight": ("retrieval.lexical_weight", 0.62),
    "dense_weight": ("retrieval.dense_weight", 0.38),
    "min_score": ("retrieval.min_score_threshold", 0.18),
    "min_relative_score": ("retrieval.min_relative_score", 0.45),
    "min_overlap": ("retrieval.min_query_token_overlap", 0.05),
    "candidate_size": ("retrieval.candidate_size", 20),
    "recency_weight": ("retrieval.recency_weight", 0.08),
    "metadata_weight": ("retrieval.metadata_boost_weight", 0.18),
    "embedding_model": ("models.embedding_model_name", "hash://384"),
    "llm_backend": ("models.llm_backend", "heuristic"),
    "llm_model": ("models.llm_model_name", ""),
    "max_new_tokens": ("models.max_new_tokens", 256),
    "guardrail_min_score": ("guardrails.min_score_threshold", 0.18),
    "min_citation_coverage": ("guardrails.min_citation_coverage", 0.34),
    "min_citation_relevance": ("guardrails.min_citation_relevance", 0.08),
    "min_top_relevance": ("guardrails.min_top_relevance", 0.08),
    "min_yesno_relevance": ("guardrails.min_yesno_relevance", 0.60),
    "min_open_coverage": ("guardrails.min_open_query_token_coverage", 0.34),
    "max_citations": ("guardrails.max_citations", 3),
}


def lookup(config: Mapping[str, Any], dotted: str, default: Any = REQUIRED) -> Any:
    """The value at a dotted path; ValueError if it isn't there and has no default."""
    node: Any = config
    for part in dotted.split("."):
        if not isinstance(node, Mapping) or part not in node:
            if default is REQUIRED:
                raise ValueError(f"missing setting: {dotted}")
            return default
        node = node[part]
    return node


def load_settings(path: str | os.PathLike[str]) -> Settings:
    import yaml

    config = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    kinds = {f.name: f.type for f in fields(Settings)}
    cast = {"str": str, "int": int, "float": float}
    return Settings(**{name: cast[kinds[name]](lookup(config, dotted, default)) for name, (dotted, default) in PLACES.items()})


def ensure_directories(settings: Settings) -> list[str]:
    """Makes the folders that local paths need; stores that aren't local make theirs on writing."""
    made = [settings.raw_data_dir, str(Path(settings.chunk_output_path).parent), settings.bm25_index_path, settings.dense_index_dir, str(Path(settings.eval_dataset_path).parent)]
    for folder in made:
        if "://" not in folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
    return made


def validate(settings: Settings) -> Settings:
    """ValueError for settings that no plan can run with."""
    if settings.chunk_size <= 0:
        raise ValueError("chunk_size must be > 0")
    if not 0 <= settings.overlap < settings.chunk_size:
        raise ValueError("overlap must be smaller than chunk_size")
    if settings.candidate_size < 1 or settings.max_citations < 1:
        raise ValueError("candidate_size and max_citations must be positive")
    return settings
