"""Indexes as Parquet tables with a small JSON-lines table of their numbers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.dense import DenseIndex
from ..operators.lexical import LexicalIndex


def save_lexical(index: LexicalIndex, path: str) -> None:
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    index.shards.write.mode("overwrite").parquet(f"{path}/shards")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    one = index.terms.sparkSession.range(1).select(F.lit(index.n_chunks).cast("long").alias("n_chunks"), F.lit(index.mean_length).cast("double").alias("mean_length"), F.lit(index.mean_idf).cast("double").alias("mean_idf"))
    one.write.mode("overwrite").parquet(f"{path}/numbers")


def load_lexical(spark: SparkSession, path: str) -> LexicalIndex:
    n = spark.read.parquet(f"{path}/numbers").first()
    return LexicalIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/terms"), n["n_chunks"], n["mean_length"], n["mean_idf"])


def save_dense(index: DenseIndex, path: str) -> None:
    index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    index.vectors.sparkSession.range(1).select(F.lit(index.model).alias("model")).write.mode("overwrite").parquet(f"{path}/model")


def load_dense(spark: SparkSession, path: str) -> DenseIndex:
    return DenseIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/model").first()["model"])
