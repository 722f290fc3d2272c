import os
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docgrain.cluster import made, tracked
from docgrain.config import Settings
from docgrain.operators import dense, lexical
from docgrain.plans import catalog, retrieval
from docgrain.sources.segments import SegmentedIndex
from docgrain.streaming import incremental

from .helpers import write_files

KINDS = "doc_id string, chunk_id string, text string, title string, section_path string, department string, updated_at string, access_level string"


def chunk(doc, no, text, access="public"):
    return (doc, f"{doc}-{no}-{zlib.crc32(text.encode())}", text, f"title {doc}", "s", "HR", "2020-01-01", access)


def frame(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def found(corpus, queries):
    lex = {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in lexical.search(corpus.lexical, queries, 5).collect()}
    return lex, {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in dense.search(corpus.dense, queries, 5).collect()}


def test_batches_equal_one_build(spark, tmp_path):
    """Replaced, deleted, returned and unchanged documents: after each commit the same as one build of what is live."""
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    queries = retrieval.normalized_queries(spark.createDataFrame([("a", "alpha beta"), ("b", "gamma words"), ("c", "title d3")], "query_id string, query string"))
    first = [chunk("d1", 0, "alpha beta"), chunk("d1", 1, "beta gamma"), chunk("d2", 0, "alpha words words"), chunk("d3", 0, "delta", "restricted"), chunk("d6", 0, "epsilon zeta")]
    second = [chunk("d1", 0, "gamma gamma"), chunk("d4", 0, "alpha words"), chunk("d3", 0, "delta", "restricted")]
    third = [chunk("d5", 0, "eta theta alpha"), chunk("d2", 0, "alpha words words")]
    live = {}
    for rows, gone in ((first, []), (second, ["d2", "none"]), (third, []), ([], ["d4"])):
        for doc in {r[0] for r in rows} | set(gone):
            live.pop(doc, None)
        for r in rows:
            live.setdefault(r[0], []).append(r)
        index.add(frame(spark, rows), deleted=spark.createDataFrame([(x,) for x in gone], "doc_id string"))
        whole = retrieval.build_corpus(frame(spark, [r for rows in live.values() for r in rows]))
        corpus = index.corpus()
        assert found(corpus, queries) == found(whole, queries)
        assert sorted(r.chunk_id for r in corpus.chunks.collect()) == sorted(r[1] for rows in live.values() for r in rows)
        assert {(r.term, r.df) for r in corpus.lexical.terms.collect()} == {(r.term, r.df) for r in whole.lexical.terms.collect()}
    old = index.snapshot()
    at_old = found(index.corpus(old), queries)
    new = index.compact()
    assert len(new.segments) == 1 and len(old.segments) == 4 and new.number == 5
    assert found(index.corpus(), queries) == at_old == found(index.corpus(old), queries), "older snapshots can still be read"
    index.add(frame(spark, [chunk("d9", 0, "alpha iota")]))
    live["d9"] = [chunk("d9", 0, "alpha iota")]
    assert found(index.corpus(), queries) == found(retrieval.build_corpus(frame(spark, [r for rows in live.values() for r in rows])), queries)
    assert index.vacuum() == 4 and found(index.corpus(), queries)[0]


def test_commits(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        index.corpus()
    one = index.add(frame(spark, [chunk("d1", 0, "alpha")]), batch="b1")
    assert index.add(frame(spark, [chunk("d1", 0, "other")]), batch="b1") == one, "a batch is added once"
    with pytest.raises(RuntimeError):
        index._commit(type(one)(0, (), ()), ("x",), ())
    assert index.snapshot() == one
    index.delete(spark.createDataFrame([("d1",)], "doc_id string"))
    assert index.corpus().chunks.count() == 0 and index.corpus().lexical.n_chunks == 0


def test_stream_of_files(spark, tmp_path):
    """Files become segments as they come; a batch that runs again, from a lost checkpoint, is not added again."""
    raw, where = tmp_path / "raw", str(tmp_path / "index")
    raw.mkdir()
    write_files(str(raw))
    settings = Settings(raw_data_dir=str(raw))
    incremental.watch_index(spark, settings, where, str(tmp_path / "c1")).awaitTermination()
    index = SegmentedIndex(spark, where)
    before = index.snapshot()
    n = index.corpus().chunks.count()
    assert len(before.segments) == 1 and n > 5
    incremental.watch_index(spark, settings, where, str(tmp_path / "c2")).awaitTermination()
    assert index.snapshot() == before
    (raw / "new_policy_public.md").write_text("# New\n## Part\nMột quy định mới hoàn toàn.\n")
    incremental.watch_index(spark, settings, where, str(tmp_path / "c1")).awaitTermination()
    assert len(index.snapshot().segments) == 2 and index.corpus().chunks.where(F.col("doc_id") == "new_policy_public").count() == 1
    assert index.corpus().chunks.count() == n + 1


def test_a_segment_makes_no_cells(spark, tmp_path):
    """Cells are made of the live vectors at search; a commit writes vectors alone."""
    index = SegmentedIndex(spark, str(tmp_path / "alone"))
    with tracked() as folders:
        index.add(frame(spark, [chunk("d1", 0, "alpha beta")]))
    assert not [f for f in folders if "-cells-" in f or "-placed-" in f]


def test_a_segment_leaves_no_tokens(spark, tmp_path):
    """What a commit makes on its way is deleted; of the text a segment has the chunks and the blocks alone, compressed."""
    index = SegmentedIndex(spark, str(tmp_path / "lean"))
    before = made(spark)
    index.add(frame(spark, [chunk("d1", 0, "alpha beta"), chunk("d2", 0, "gamma")]))
    index.add(frame(spark, [chunk("d1", 0, "delta")]))
    assert made(spark) == before
    for name in index.snapshot().segments:
        tables = {x.name: pq.ParquetFile(next(x.glob("*.parquet"))) for x in (tmp_path / "lean" / "segments" / name).iterdir()}
        assert not {"index_tokens", "occurrences"} & {c for t in tables.values() for c in t.schema_arrow.names}
        assert {t.metadata.row_group(i).column(0).compression for t in tables.values() for i in range(t.metadata.num_row_groups)} == {"ZSTD"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_query_keeps_live_segments_alone(spark):
    """Compacted segments go, and documents are read where they are needed, not written again."""
    with tracked() as folders:
        index = catalog.segmented_index(spark, "/root/testdata/sf0.001")
    assert not [f for f in folders if "-documents-" in f]
    assert {x.name for x in Path(index.path.removeprefix("file://"), "segments").iterdir()} == set(index.snapshot().segments)
