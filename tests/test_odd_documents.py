"""Queries over chunks against their SQL, on documents that markdown can't carry or that have no words."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

from .test_catalog import rows

NAMES = (
    "chunk_round_trip chunk_statistics chunk_windows citation_signatures dataset_summary eval_dataset_easy eval_dataset_gen item_round_trip "
    "parse_dates sentence_snippets stratified_split section_blocks multi_hop_pairs"
).split()
LONG = " ".join(f"w{i}" for i in range(700))
DOCUMENTS = [
    (1, "Some words. And more.\n  of  two lines", "en", "src1"),
    (2, "", "en", "src1"),
    (3, " \n\t \r\n", "de", "src1"),
    (4, None, "fr", "src2"),
    (5, "# not a heading\nbelow\n ## nor this one", "en", "src2"),
    (6, "a\x00b c", "de", "src2"),
    (7, "\x00", "es", "src1"),
    (8, f"{LONG} \x00 {LONG}\n#tag {LONG}", "en", "src3"),
    (9, "no language", None, "src1"),
    (10, "no source", "en", None),
    (11, "names that a heading would change", "", "## src\n4"),
    (12, LONG, "fr", "src2"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("odd")
    doc_id, text, lang, source = zip(*DOCUMENTS)
    pq.write_table(pa.table({"doc_id": pa.array(doc_id, pa.int64()), "text": pa.array(text, pa.string()), "lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string())}), made / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": ["of two", "w1 w2 w3"]}), made / "benchmark.parquet")
    return str(made)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, folder, name):
    with duckdb.connect() as con:
        for table in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        want = con.execute(entry.oracle_sql()[name])
        columns, found = [c[0] for c in want.description], want.fetchall()
    got = entry.queries()[name](spark, folder)
    assert rows(got.columns, got.collect()) == rows(columns, found)
