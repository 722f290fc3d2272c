"""An index that grows: a log of immutable segments under a committed snapshot.

A batch of chunks becomes a segment of its own: blocks of postings, shards, vectors, and changes of the counts. Documents
that it replaces or deletes are marked dead in the segments that have them, and their counts are taken off, so statistics are sums over
the live segments and a batch costs what it brings and replaces. Tokens are on disk only while a batch is added. A snapshot is a small JSON file that lists segments; it
appears by one rename, so readers see a batch whole or not at all, and of two writers of one number the second fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import clean, put, release, tracked, written
from ..config import Settings
from ..operators import dense, lexical
from ..operators.chunking import CHUNK_COLUMNS
from ..plans.retrieval import Corpus

#: A segment's shards are numbered from its own number times this on.
SHARDS = 1 << 20
#: How segments' files are compressed: what Spark takes otherwise makes blocks half as large again.
CODEC = "zstd"


@dataclass(frozen=True)
class Snapshot:
    """number: of the commit. segments: their names, oldest first; a segment's place in the log never changes before compact()."""

    number: int
    segments: tuple[str, ...]
    #: Names of batches that are in it.
    batches: tuple[str, ...]


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def _fs(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def snapshot(self) -> Snapshot:
        """The last commit; number 0 and nothing in it before the first."""
        folder, fs = self._fs(f"{self.path}/snapshots")
        numbers = [int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")] if fs.exists(folder) else []
        if not numbers:
            return Snapshot(0, (), ())
        held = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/snapshots/{max(numbers)}.json").collect()))
        return Snapshot(max(numbers), tuple(held["segments"]), tuple(held["batches"]))

    def _commit(self, after: Snapshot, segments: tuple[str, ...], batches: tuple[str, ...]) -> Snapshot:
        made, fs = self._fs(f"{self.path}/snapshots/.{uuid.uuid4().hex}")
        final, _ = self._fs(f"{self.path}/snapshots/{after.number + 1}.json")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps({"segments": segments, "batches": batches}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(made, final):
            fs.delete(made, False)
            raise RuntimeError(f"snapshot {after.number + 1} was committed by another writer")
        return Snapshot(after.number + 1, segments, batches)

    def _read(self, snapshot: Snapshot, name: str, segments: tuple[str, ...] | None = None) -> DataFrame:
        """A table of all, or of some, segments of a snapshot."""
        segments = snapshot.segments if segments is None else segments
        return self.spark.read.parquet(*[f"{self.path}/segments/{s}/{name}" for s in segments])

    def _live(self, snapshot: Snapshot) -> DataFrame:
        """Chunks, with segment, that no later segment marks dead."""
        dead, rows = self._read(snapshot, "dead"), self._read(snapshot, "chunks").select(*CHUNK_COLUMNS, "segment")
        return rows if dead.isEmpty() else rows.join(dead.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_anti")

    def add(self, chunks: DataFrame, batch: str | None = None, deleted: DataFrame | None = None) -> Snapshot:
        """Commits ``chunks`` (CHUNK_COLUMNS) as a segment, in place of all chunks that their documents, and those whose doc_id
        is in ``deleted``, had before. A ``batch`` that is already committed is not added again."""
        before = self.snapshot()
        if batch is not None and batch in before.batches:
            return before
        number, name = before.number + 1, f"{before.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        with tracked() as folders:
            try:
                self._write(f"{self.path}/segments/{name}", number, before, chunks, deleted)
            finally:
                clean(self.spark, folders)
                release(self.spark)
        return self._commit(before, (*before.segments, name), (*before.batches, *([batch] if batch is not None else [])))

    def _write(self, into: str, number: int, before: Snapshot, chunks: DataFrame, deleted: DataFrame | None) -> None:
        """The tables of a segment."""
        segment = F.lit(number).alias("segment")

        def keep(df: DataFrame, table: str) -> DataFrame:
            return put(df.drop("occurrences").withColumns({"shard": F.col("shard") + number * SHARDS, "segment": segment}), f"{into}/{table}", CODEC)

        found = put(chunks.select(*CHUNK_COLUMNS, segment), f"{into}/chunks", CODEC)
        release(self.spark)  # what chunks come from is needed no more
        tokens = written(dense.tokenised(found, self.settings.embedding_model), "tokens", CODEC)
        _, blocks, _ = lexical.parts(tokens.select("chunk_id", "department", "access_level", F.col(lexical.INDEX_TOKENS).alias("tokens"), F.col(lexical.INDEX_LENGTH).alias("dl")), keep)
        release(self.spark)
        put(dense.encoded(tokens, self.settings.embedding_model).withColumn("segment", segment), f"{into}/vectors", CODEC)
        gone = found.select("doc_id").distinct()
        if deleted is not None:
            gone = gone.unionByName(deleted.select(F.col("doc_id").cast("string").alias("doc_id"))).distinct()
        live = self._live(before) if before.segments else found.limit(0)
        replaced = lexical.with_index_tokens(live.join(gone, "doc_id", "left_semi"))
        replaced = written(replaced.select("segment", "doc_id", "chunk_id", lexical.INDEX_TOKENS, lexical.INDEX_LENGTH), "replaced", CODEC)
        put(replaced.select("segment", "doc_id", "chunk_id").distinct(), f"{into}/dead", CODEC)
        # changes of the counts: what the batch brings, less what it replaces
        less = replaced.select(F.explode(F.array_remove(F.array_distinct(F.split(lexical.INDEX_TOKENS, " ")), "")).alias("term"), F.lit(-1).cast("long").alias("df"))
        put(blocks.select("term", F.col("n").alias("df")).unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), f"{into}/terms", CODEC)
        signed = tokens.select(F.lit(1).alias("sign"), lexical.INDEX_LENGTH).unionByName(replaced.select(F.lit(-1).alias("sign"), lexical.INDEX_LENGTH))
        put(signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col(lexical.INDEX_LENGTH)), F.lit(0)).alias("tokens")), f"{into}/numbers", CODEC)

    def delete(self, doc_ids: DataFrame) -> Snapshot:
        """Commits a segment without chunks that marks the documents of ``doc_ids`` (doc_id) dead."""
        kinds = ", ".join(f"{c} string" for c in CHUNK_COLUMNS)
        return self.add(self.spark.createDataFrame([], kinds), deleted=doc_ids)

    def corpus(self, snapshot: Snapshot | None = None) -> Corpus:
        """What retrieval reads, of the live chunks of a snapshot (the last one): the same as of one build of them."""
        at = snapshot or self.snapshot()
        if not at.segments:
            raise ValueError("no snapshot is committed")
        dead = self._read(at, "dead").select("segment", "chunk_id")
        numbers = self._read(at, "numbers").agg(F.sum("n"), F.sum("tokens")).first()
        terms = self._read(at, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        # a dead chunk keeps its place among its shard's members and is nobody
        of_shard = self._read(at, "shards").select("shard", "segment", F.posexplode("members").alias("no", "m")).select("shard", "segment", "no", "m.chunk_id")
        killed = of_shard.join(dead, ["segment", "chunk_id"], "left_semi").groupBy("shard").agg(F.collect_set("no").alias("dead"))
        killed = killed.withColumnRenamed("shard", "of")
        shards = self._read(at, "shards").join(killed, F.col("shard") == F.col("of"), "left")
        members = F.when(F.col("dead").isNull(), F.col("members")).otherwise(F.transform("members", lambda m, i: F.when(~F.array_contains("dead", i), m)))
        shards = shards.select("shard", members.alias("members"))
        index = lexical.with_numbers(self._read(at, "blocks").drop("segment", "occurrences"), shards, terms, numbers[0] or 0, numbers[1] or 0)
        vectors = self._read(at, "vectors").join(dead, ["segment", "chunk_id"], "left_anti").drop("segment")
        return Corpus(self._live(at).select(*CHUNK_COLUMNS), index, dense.DenseIndex(vectors, self.settings.embedding_model))

    def compact(self) -> Snapshot:
        """Commits one segment of all live chunks in place of all others, whose files stay until vacuum()."""
        before = self.snapshot()
        if not before.segments:
            return before
        live = self._live(before).select(*CHUNK_COLUMNS)
        alone = SegmentedIndex(self.spark, f"{self.path}/segments/.{uuid.uuid4().hex}", self.settings)
        name = alone.add(live).segments[0]
        made, fs = self._fs(f"{alone.path}/segments/{name}")
        fs.rename(made, self._fs(f"{self.path}/segments/{name}")[0])
        fs.delete(self._fs(alone.path)[0], True)
        return self._commit(before, (name,), before.batches)

    def vacuum(self) -> int:
        """Deletes segments that the last snapshot doesn't list, and with them what still reads older ones."""
        kept, (folder, fs) = set(self.snapshot().segments), self._fs(f"{self.path}/segments")
        gone = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName() not in kept]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
