"""Documents from files, and tables of chunks and items as JSON lines."""

from __future__ import annotations

import io
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import map_arrow, written
from ..config import Settings
from ..functions import fixed
from ..functions import text as T
from ..operators.chunking import CHUNK_COLUMNS, build_chunks

CHUNK_SCHEMA = ", ".join(f"{c} string" for c in CHUNK_COLUMNS)
ITEM_SCHEMA = "id string, question string, gold_chunk_ids array<string>, reference_answer string, difficulty string, query_type string, domain string"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, suffix, content of every file below ``folder`` that can be read, whatever the case of its suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*fixed.TEXT_SUFFIXES, *fixed.BINARY_SUFFIXES))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def title_of(name: Column) -> Column:
    found = F.trim(F.replace(stem(name), F.lit("_"), F.lit(" ")))
    return F.when(found != "", found).otherwise(name)


def text_of(suffix: str, content: bytes) -> str:
    """UTF-8 text without invalid bytes, or the text of a PDF or Word file if its package is installed."""
    if suffix in fixed.TEXT_SUFFIXES:
        return content.decode("utf-8", errors="ignore")
    if suffix == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError as missing:
            raise RuntimeError("pypdf is required to parse PDF files") from missing
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    if suffix == "docx":
        try:
            import docx2txt
        except ImportError as missing:
            raise RuntimeError("docx2txt is required to parse DOCX files") from missing
        return docx2txt.process(io.BytesIO(content)) or ""
    raise ValueError(f"Unsupported document type: .{suffix}")


def parse(files: DataFrame) -> DataFrame:
    """name and text, in normal form C, of scanned files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unicodedata.normalize("NFC", text_of(s.as_py(), c.as_py() or b"")) for s, c in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["name", "text"])

    return map_arrow(files.select(file_name(F.col("path")).alias("name"), "suffix", "content"), work, "name string, text string")


def compose(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and text in normal form C. Only rows with a character outside the safe ranges go through Python."""
    need = F.regexp_like(F.col(text), F.lit(T.MAY_NEED_NFC))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if t is None else unicodedata.normalize("NFC", t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], [key, "text"])

    rows = texts.select(F.col(key).cast("string").alias(key), F.col(text).alias("text"))
    plain = rows.where(~F.coalesce(need, F.lit(False)))
    return plain.unionByName(map_arrow(rows.where(need), work, f"{key} string, text string"))


def documents(parsed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, title, text, department, updated_at, access_level, all from the file's name and normalized text.

    Files without text are left out.
    """
    name = F.col("name")
    rows = parsed.select(stem(name).alias("doc_id"), title_of(name).alias("title"), T.normalize_text(F.col("text")).alias("text"), T.infer_department(stem(name)).alias("department"), T.infer_updated_at(stem(name), settings.parse_filename_dates).alias("updated_at"), T.infer_access_level(stem(name)).alias("access_level"))
    return rows.where("text <> ''")


def ingest(spark: SparkSession, settings: Settings = Settings()) -> DataFrame:
    """Chunks of all files below the raw folder."""
    return build_chunks(documents(parse(scan(spark, settings.raw_data_dir)), settings), settings.chunk_size, settings.overlap)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, non-ASCII characters as they are; overwrites."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file or folder; blank lines are skipped, others that don't parse raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CHUNK_SCHEMA)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items with defaults for what is absent."""
    from ..operators.evaluation import with_defaults

    return with_defaults(read_jsonl(spark, path, ITEM_SCHEMA).withColumnRenamed("gold_chunk_ids", "gold"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one UTF-8 file, in whatever store Spark reaches ``path``; overwrites."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


#: Names that the Markdown report gives to parts of a report.
SUMMARY_NAMES = {"total_items": "Total items", "positive_items": "Positive items", "negative_items": "Negative items", "retrieval_recall_at_k": "Retrieval Recall@k", "false_refusal_rate": "False refusal rate (positive queries)", "negative_hallucination_rate": "Hallucination rate on negative queries"}
COUNT_NAMES = {"failure_counts": "Failure Counts", "failures_by_query_type": "Failures By Query Type", "failures_by_difficulty": "Failures By Difficulty"}


def markdown_report(report: dict) -> str:
    """Sections of a report as Markdown: rates with four decimals, names sorted."""
    summary = [f"- {shown}: {report['summary'][k]:.4f}" if isinstance(report["summary"][k], float) else f"- {shown}: {report['summary'][k]}" for k, shown in SUMMARY_NAMES.items()]
    out = ["# Holdout Error Analysis Report", "", "## Summary", *summary, ""]
    for key, shown in COUNT_NAMES.items():
        out += [f"## {shown}", *(f"- {k}: {n}" for k, n in sorted(report[key].items())), ""]
    out.append("## Sample Failures")
    for kind, rows in sorted(report["failure_samples"].items()):
        out.append(f"### {kind}")
        for r in rows:
            out.append(f"- `{r['id']}` | {r['query_type']} | {r['difficulty']} | {r['domain']}")
            out += [f"  - {shown}: {value}" for shown, value in (("Question", r["question"]), ("Gold", r["gold_chunk_ids"]), ("Retrieved", r["retrieved_ids"]), ("Status", f"{r['answer_status']} | Confidence: {r['confidence']}"), ("Citations", r["citation_ids"]))]
        out.append("")
    if not report["failure_samples"]:
        out.append("- No failures found.")
    return "\n".join(out).strip() + "\n"


def write_report(spark: SparkSession, report: dict, json_path: str, markdown_path: str) -> None:
    """A report as JSON and as Markdown."""
    write_text(spark, json_path, json.dumps(report, ensure_ascii=False, indent=2) + "\n")
    write_text(spark, markdown_path, markdown_report(report))


def split_items(spark: SparkSession, source: str, train: str, holdout: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Splits a file of items by datasets.stratified_split() into two folders of JSON lines, with all their fields;
    returns counts by split, query_type and difficulty. ValueError if there are no items or the ratio isn't in (0, 1)."""
    from ..operators.datasets import stratified_split

    rows = spark.read.option("mode", "FAILFAST").json(source)
    if rows.isEmpty():
        raise ValueError(f"no items in {source}")
    for name in ("query_type", "difficulty"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit("unknown"))
    parted = written(stratified_split(rows, ratio, seed), "split")
    for path, held in ((train, False), (holdout, True)):
        write_jsonl(parted.where(F.col("holdout") == held).drop("holdout"), path)
    return parted.groupBy(F.when(F.col("holdout"), "holdout").otherwise("train").alias("split"), "query_type", "difficulty").agg(F.count("*").alias("n"))
