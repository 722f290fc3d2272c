import json

import pytest

from docgrain import __main__ as commands
from docgrain.sources import files

REPORT = {
    "summary": {k: 0.5 if k.endswith(("rate", "_k")) else 2 for k in files.SUMMARY_NAMES},
    "failure_counts": {"b": 1, "a": 2},
    "failures_by_query_type": {"unknown": 3},
    "failures_by_difficulty": {},
    "failure_samples": {},
}


def test_write_report(spark, tmp_path):
    files.write_report(spark, REPORT, f"{tmp_path}/r.json", f"{tmp_path}/r.md")
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == REPORT
    shown = (tmp_path / "r.md").read_text(encoding="utf-8")
    assert shown.index("- a: 2") < shown.index("- b: 1") and "0.5000" in shown and shown.endswith("- No failures found.\n")


def test_split_items(spark, tmp_path):
    rows = [{"id": str(i), "question": f"q{i}", "query_type": "fact", "extra": i} for i in range(20)]
    (tmp_path / "items.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    counts = files.split_items(spark, f"{tmp_path}/items.jsonl", f"{tmp_path}/train", f"{tmp_path}/holdout", 0.25)
    assert {r["split"]: r["n"] for r in counts.collect()} == {"train": 15, "holdout": 5}
    parts = [spark.read.json(f"{tmp_path}/{x}") for x in ("train", "holdout")]
    assert sorted(r["extra"] for p in parts for r in p.collect()) == list(range(20))
    with pytest.raises(ValueError):
        files.split_items(spark, f"{tmp_path}/items.jsonl", f"{tmp_path}/a", f"{tmp_path}/b", 1.0)


def test_arguments():
    asked = commands.arguments(["report", "--config", "c.yaml", "--sample_limit", "3"])
    assert (asked.command, asked.config, asked.top_k, asked.sample_limit) == ("report", "c.yaml", 5, 3)
    with pytest.raises(SystemExit):
        commands.arguments(["split", "--holdout-ratio", "1"])
