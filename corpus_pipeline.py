"""From documents to token ids: quality rules, near-duplicate removal, repeated-passage removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of ``documents``, whatever else they hold, clashing names included. What a stage does with nulls, empty and
very long texts, ties, repeated rows and empty tables is its operator's and is said in its docstring; an empty table
gives an empty one throughout. A stage deletes those of its own intermediate tables that its result doesn't read, and no others;
run() deletes what a stage has left once the next one's rows are written. ``docgrain.cluster.clean`` deletes the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.cluster import clean, tracked
from docgrain.llm import minhash_dedup, mixing, quality_rules, sentencepiece_bpe, substring_dedup
from docgrain.llm.common import quoted, written

#: Near duplicates share 0.8 or more of their shingles of five words.
NEAR = minhash_dedup.Near(width=5, percent=80)
#: Smaller packs than the operator's own: workers of the stage before still hold memory when this one begins.
PACKS = substring_dedup.Packs(pack_bytes=4 << 20)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    """``stage``, without the tables that it made and its result doesn't read."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with tracked() as folders:
            out = stage(spark, docs, sf_dir)
        clean(spark, folders, but=out)
        return out

    return run_stage


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their hosts' verdicts keep.

    Null and empty texts go, as all of under ten words; repeated rows stay or go together; a null source is a host.
    """
    return quality_rules.keep_good(docs)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Rows of one doc_id are one document and stay or go together; rows with null doc_id and texts without words stay.
    """
    return minhash_dedup.keep_one(docs, NEAR)


@_tidy
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words and more that start earlier elsewhere; n_chars is of what is left.

    Other texts, null and empty ones included, stay as they are. A document that loses all its words goes. Ties are
    broken by doc_id and place; rows of one doc_id are one document.
    """
    cut = substring_dedup.remove_repeats(docs, packs=PACKS)
    gone, words = (F.col(quoted(cut.columns[-1])).getField(x) for x in ("n_removed", "n_words"))
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")
    return cut.where((gone == 0) | (gone < words)).select(*[n_chars if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


@_tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them; rows of one doc_id in one leaf together, null levels as "".
    """
    return mixing.mixed_documents(docs)


@_tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and lossless of every document of the mix; its copies, which the mix writes one after the
    other, have own draws. Nothing is shuffled.

    Null and empty texts have no ids; null doc_ids count as one number in the draws.
    """
    return sentencepiece_bpe.encode(docs, adjacent=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("encode", encode)]

#: SQL has no byte-pair merges; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        with tracked() as folders:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = written(docs, name)
                clean(spark, left, but=docs)
                clean(spark, folders, but=docs)
        left = folders
    return docs
