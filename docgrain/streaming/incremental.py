"""Incremental ingest: new files become chunks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.chunking import build_chunks
from ..sources import files
from ..sources.segments import SegmentedIndex


def _new_chunks(spark: SparkSession, settings: Settings, handle: Callable[[DataFrame, int], object], checkpoint: str, once: bool) -> StreamingQuery:
    """Calls ``handle`` with the chunks of each batch of files that are new below the raw folder, and the batch's number."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(settings.raw_data_dir)

    def cut(batch: DataFrame, number: int) -> None:
        found = batch.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "content")
        readable = found.where(F.col("suffix").isin(*files.fixed.TEXT_SUFFIXES, *files.fixed.BINARY_SUFFIXES))
        handle(build_chunks(files.documents(files.parse(readable), settings), settings.chunk_size, settings.overlap), number)

    writer = source.writeStream.foreachBatch(cut).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch(spark: SparkSession, settings: Settings, chunk_table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the chunks of files that are new below the raw folder to a Parquet table, each batch in a partition of
    its own that a repeated batch overwrites, so a batch that runs again adds nothing twice."""
    return _new_chunks(spark, settings, lambda chunks, number: chunks.write.mode("overwrite").parquet(f"{chunk_table}/batch={number}"), checkpoint, once)


def watch_index(spark: SparkSession, settings: Settings, index_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds the chunks of new files to a segmented index, a segment for each batch; a file of a doc_id that is already there
    replaces it. A batch that runs again is known by its number, so it is committed once."""
    index = SegmentedIndex(spark, index_path, settings)
    return _new_chunks(spark, settings, lambda chunks, number: index.add(chunks, batch=f"stream-{number}"), checkpoint, once)
