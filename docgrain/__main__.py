"""Command lines: python -m docgrain ingest | eval | split | report."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession

from . import config
from .engine import Engine
from .sources import files


def arguments(line: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="docgrain")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("ingest", "chunk the raw files and build both indexes"), ("eval", "retrieval and answer metrics"), ("report", "failures of the whole service")):
        one = commands.add_parser(name, help=what)
        one.add_argument("--config", default=os.environ.get("APP_CONFIG_PATH", "config/default.yaml"))
        if name != "ingest":
            one.add_argument("--dataset", default=None, help="JSON lines of items; the settings' own if not given")
            one.add_argument("--top_k", type=int, default=5)
        if name == "report":
            one.add_argument("--sample_limit", type=int, default=5)
            one.add_argument("--output_json", default="artifacts/holdout_error_report.json")
            one.add_argument("--output_md", default="artifacts/holdout_error_report.md")
    split = commands.add_parser("split", help="train and holdout items")
    split.add_argument("--input", default="data/eval/qa_eval.jsonl")
    split.add_argument("--train-output", default="data/eval/qa_eval_train.jsonl")
    split.add_argument("--holdout-output", default="data/eval/qa_eval_holdout.jsonl")
    split.add_argument("--holdout-ratio", type=float, default=0.2)
    split.add_argument("--seed", type=int, default=42)
    found = parser.parse_args(line)
    if found.command == "split" and not 0 < found.holdout_ratio < 1:
        parser.error("--holdout-ratio must be between 0 and 1")
    return found


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def run(spark: SparkSession, asked: argparse.Namespace) -> dict:
    """What the command prints, as a dictionary."""
    if asked.command == "split":
        counts = files.split_items(spark, asked.input, asked.train_output, asked.holdout_output, asked.holdout_ratio, asked.seed).collect()
        return {name: {f"{r['query_type']}/{r['difficulty']}": r["n"] for r in sorted(counts) if r["split"] == name} for name in ("train", "holdout")}
    settings = config.load_settings(asked.config)
    config.ensure_directories(settings)
    engine = Engine(spark, settings)
    if asked.command == "ingest":
        chunks = engine.ingest()
        engine.build(chunks, save=True)
        return {"chunks": chunks.count(), "chunk_file": settings.chunk_output_path, "bm25_index": settings.bm25_index_path, "dense_index_dir": settings.dense_index_dir}
    engine.load()
    items = files.read_items(spark, asked.dataset or settings.eval_dataset_path)
    if asked.command == "eval":
        found, answered = engine.evaluate(items, asked.top_k)
        return {"retrieval": {r["mode"]: r.asDict() for r in found.collect()}, "answer": _row(answered)}
    report = engine.full_report(items, asked.top_k, asked.sample_limit)
    files.write_report(spark, report, asked.output_json, asked.output_md)
    return report["summary"]


def main(line: list[str] | None = None) -> None:
    asked = arguments(line)
    spark = SparkSession.builder.appName(f"docgrain {asked.command}").getOrCreate()
    print(json.dumps(run(spark, asked), ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
