"""Every registered query against its SQL, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from docgrain.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shown(x):
    if x is None or x != x:
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


def once(build):
    made = {}

    def get(spark, sf):
        if sf not in made:
            made[sf] = build(spark, sf)
        return made[sf]

    return get


@pytest.fixture(scope="module", autouse=True)
def built_once():
    """What several queries build is built once here."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("corpus", "_evaluated", "_full", "_judged"):
            patch.setattr(catalog, name, once(getattr(catalog, name)))
        yield


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, tables, name):
    got = entry.queries()[name](spark, SF)
    want = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_a_package_of_the_other_queries():
    """What the optional subpackage lacks doesn't take the rest with it."""
    code = "import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') for k in e.queries()))"
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    n, n_sql, left = map(int, ran.stdout.split())
    assert n == len(catalog.queries()) and 0 < n_sql <= n and left == 0
    assert ran.stderr.count("can't be imported") == 1


def test_items_look_into_the_chunks_they_are_given(spark, monkeypatch):
    """Documents are cut once a query; gold are chunks that hold a text within words, of one and two words too."""
    table = lambda _, sf, name: spark.createDataFrame([(1, "one two  three"), (2, "wo"), (3, "no such words here"), (4, "a b")], "item_id int, text string")
    monkeypatch.setattr(catalog, "table", table)
    monkeypatch.setattr(catalog, "chunks", None)
    cut = spark.createDataFrame([("c1", "one two three"), ("c2", "none two threefold two"), ("c3", "one two"), ("c4", "pa bare")], "chunk_id string, text string")
    got = {r.id: r.gold for r in catalog.items(spark, "", cut).collect()}
    assert got == {"b1": ["c1", "c2"], "b2": ["c1", "c2", "c3"], "b3": [], "b4": ["c4"]}
