import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrain.cluster import written
from docgrain.config import Settings
from docgrain.operators import dense, fusion, lexical
from docgrain.plans import retrieval

CHUNKS = [("d1", "d1-0", "alpha beta beta gamma", "one", "s", "HR", "2020-01-01", "public"), ("d1", "d1-1", "alpha delta", "one", "s", "HR", "2025-01-01", "restricted"), ("d2", "d2-0", "epsilon zeta", "two", "s", "Engineering", "2022-01-01", "internal"), ("d3", "d3-0", "eta theta iota", "three", "s", "General", "bad", "public")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "doc_id string, chunk_id string, text string, title string, section_path string, department string, updated_at string, access_level string")


def asked(spark, *rows):
    return spark.createDataFrame([(f"q{i}", *r) for i, r in enumerate(rows)], "query_id string, query string, top_k int, department string, access_level string")


def okapi(query):
    docs = {c[1]: f"{c[3]} {c[4]} {c[2]}".split() for c in CHUNKS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in {t for d in docs.values() for t in d}}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if v < 0 else v for t, v in raw.items()}
    return {i: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query.split()) for i, d in docs.items()}


def test_bm25(spark, chunks):
    index = lexical.build_index(chunks)
    got = lexical.search(index, asked(spark, ("beta beta alpha zeta", 5, None, "restricted"), ("nothing", 5, None, None)), 10).collect()
    want = okapi("beta beta alpha zeta")
    assert {r.chunk_id: pytest.approx(want[r.chunk_id]) for r in got} == {r.chunk_id: r.score for r in got}
    assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank)] == sorted((i for i in want if want[i] > 0), key=lambda i: (-want[i], i))
    plain = {r.term: r.idf for r in lexical.fallback_idf(index).collect()}
    assert plain["alpha"] == pytest.approx(math.log(5 / 3) + 1)


def test_access_and_department(spark, chunks):
    index = lexical.build_index(chunks)
    rows = [("beta delta", 5, None, level) for level in ("public", "restricted", None, "", "internal")] + [("beta epsilon", 5, "Engineering", None)]
    got = {}
    for r in lexical.search(index, asked(spark, *rows), 10).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    both = {"d1-0", "d1-1"}
    assert [got[f"q{i}"] for i in range(6)] == [{"d1-0"}, both, both, both, {"d1-0"}, {"d2-0"}]


def test_one_chunk_gives_no_lexical_hit(spark, chunks):
    one = chunks.where("chunk_id = 'd3-0'")
    assert lexical.search(lexical.build_index(one), asked(spark, ("eta", 5, None, None)), 5).count() == 0
    assert dense.search(dense.build_index(one), asked(spark, ("eta", 5, None, None)), 5).count() == 1


def test_hash_vectors(spark):
    terms = ["alpha", "nhánh", "x", "日本", "é"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string")
    for dim in (384, 128, 97):
        got = {r.t: r.b for r in rows.select("t", dense.bucket(F.col("t"), dim).alias("b")).collect()}
        assert got == {t: int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little") % dim for t in terms}
    v = dense.hash_vectors([["a", "a", "b"], []], 16)
    assert (v[0] ** 2).sum() == pytest.approx(1) and not v[1].any()
    assert dense.hash_dimension("hash://12") == 12 and dense.hash_dimension("hash://x") == 384 and dense.hash_dimension("other") == 384


def test_dense_cuts_before_it_filters(spark, chunks):
    index = dense.build_index(chunks, "hash://64")
    got = dense.search(index, asked(spark, ("alpha delta", 1, None, "public")), 1).collect()
    assert [r.chunk_id for r in got] == ["d1-0"]
    zero = dense.search(index, asked(spark, ("qqqq", 5, None, None)), 3).collect()
    assert [r.chunk_id for r in sorted(zero, key=lambda r: r.rank)] == ["d1-0", "d1-1", "d2-0"] and {r.score for r in zero} == {0.0}
    with pytest.raises(ValueError):
        dense.search(index, asked(spark, ("a", 1, None, None)), 1, "hash://128")


def test_nearest_takes_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i:02d}", [float(i % 7), 1.0]) for i in range(60)], "key string, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", [1.0, float(-i)]) for i in range(5)], "query_id string, vector array<double>")
    whole = sorted(map(tuple, dense.nearest(rows, queries, 4, "key").collect()))
    monkeypatch.setattr(dense, "BLOCK", 2)
    assert sorted(map(tuple, dense.nearest(rows.repartition(5), queries, 4, "key").collect())) == whole and len(whole) == 20
    assert dense.nearest(rows, queries.limit(0), 4, "key").count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def test_weighted_fusion(spark):
    lex, den = hits(spark, [("q", "a", 10.0, 1), ("q", "b", 8.0, 2)]), hits(spark, [("q", "b", 0.9, 1), ("q", "c", 0.8, 2)])
    weights = spark.createDataFrame([("q", 0.5, 0.5)], "query_id string, lexical double, dense double")
    got = {r.chunk_id: (r.fused, r.rank, r.found_by) for r in fusion.fuse(lex, den, weights, 5).collect()}
    assert got == {"a": (0.5, 1, "bm25"), "b": (0.5, 2, "hybrid"), "c": (0.0, 3, "dense")}
    rrf = {r.chunk_id: r.fused for r in fusion.fuse(lex, den, weights, 5, "rrf").collect()}
    assert rrf["b"] == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-9) and rrf["a"] == pytest.approx(0.5 / 61, abs=1e-9)


def test_minmax_of_equal_scores(spark):
    assert {r.norm for r in fusion.minmax(hits(spark, [("q", "a", 2.0, 1), ("q", "b", 2.0, 2)])).collect()} == {1.0}


def test_query_weights(spark):
    rows = spark.createDataFrame([(t,) for t in ("plain words", "has 2024", "has SLA", "a b c d e f g h i j", "A one")], "q string")
    got = [tuple(round(x, 4) for x in r.w) for r in rows.select(fusion.query_weights(F.col("q")).alias("w")).collect()]
    assert got == [(0.62, 0.38), (0.77, 0.23), (0.77, 0.23), (0.52, 0.48), (0.62, 0.38)]


def test_recency(spark):
    rows = spark.createDataFrame([("q", "a", 0.7, 1, "2020-01-01"), ("q", "b", 0.7, 2, "2025-01-01"), ("p", "a", 0.5, 1, "x"), ("p", "b", 0.4, 2, "y")], "query_id string, chunk_id string, score double, rank int, updated_at string")
    got = {(r.query_id, r.chunk_id): (r.score, r.rank) for r in fusion.recency_boost(rows, 0.2).collect()}
    assert got == {("q", "b"): (0.9, 1), ("q", "a"): (0.7, 2), ("p", "a"): (0.5, 1), ("p", "b"): (0.4, 2)}


def test_retrieve(spark, chunks):
    corpus = retrieval.build_corpus(chunks, Settings())
    queries = asked(spark, ("alpha beta gamma", 1, None, "public"), ("alpha delta", 2, None, "restricted"), ("zzzz", 5, None, None))
    found = retrieval.search(corpus, queries)
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in found.collect())
    assert got[0] == ("q0", 1, "d1-0") and ("q1", 1, "d1-1") in got and not any(q == "q2" for q, *_ in got)
    for bad in (("x", 0, None, None), ("x", 51, None, None), ("", 5, None, None)):
        with pytest.raises(ValueError):
            retrieval.retrieve(corpus, asked(spark, bad))


def many_chunks(spark, n):
    chance = random.Random(8)
    rows = []
    for i in range(n):
        words = ["common", *chance.choices([f"w{x}" for x in range(40)], k=chance.randrange(3, 30)), *(["seldom"] * (i % 29 == 0)), *(["common"] * chance.randrange(4))]
        rows.append((f"d{i}", f"d{i}-0", " ".join(words), "t", "s", ("HR", "General")[i % 2], "2020-01-01", ("public", "restricted")[i % 5 == 0]))
    return rows, spark.createDataFrame(rows, "doc_id string, chunk_id string, text string, title string, section_path string, department string, updated_at string, access_level string")


def plain_okapi(rows, query, k, department, level):
    docs = {r[1]: f"{r[3]} {r[4]} {r[2]}".split() for r in rows}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if v < 0 else v for t, v in raw.items()}
    found = []
    for r in rows:
        if (department is None or r[5] == department) and (level in (None, "restricted") or r[7] != "restricted"):
            d = docs[r[1]]
            score = round(sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query.split()), 9)
            if score > 0:
                found.append((-score, r[1]))
    return [(c, pytest.approx(-s)) for s, c in sorted(found)[:k]]


def test_bounded_search_is_exact(spark, monkeypatch):
    """Many shards, a term in every chunk, rare terms, filters: the same as scoring all chunks; and some shards stay shut."""
    monkeypatch.setattr(lexical, "SHARD_CHUNKS", 8)
    monkeypatch.setattr(lexical, "RARE", 20)
    rows, chunks = many_chunks(spark, 300)
    index = lexical.build_index(chunks)
    assert index.shards.count() > 20
    texts = [("common seldom", None, "restricted"), ("seldom seldom w3", "HR", None), ("common", None, "public"), ("common w1 w2 absent", "General", "public"), ("absent", None, None)]
    queries = asked(spark, *[(t, 5, d, a) for t, d, a in texts])
    opened = []
    best = lexical._best

    def watched(*args):
        opened.append(args[-1].count() if len(args) > 5 else None)
        return best(*args)

    monkeypatch.setattr(lexical, "_best", watched)
    got = {}
    for r in sorted(lexical.search(index, queries, 6).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for i, (t, d, a) in enumerate(texts):
        assert got.get(f"q{i}", []) == plain_okapi(rows, t, 6, d, a), t
    assert opened[0] is None and opened[1] < 4 * index.shards.count(), "not all shards of all queries with hits"
    monkeypatch.setattr(lexical, "MOST_LOOKED_UP", 1)
    again = lexical.search(index, queries, 6).collect()
    assert sorted((r.query_id, r.chunk_id) for r in again) == sorted((q, c) for q, x in got.items() for c, _ in x)


def test_rows_of_one_chunk_id(spark):
    one = [("d", "d-0", "alpha beta", "t", "s", "HR", "2020-01-01", "public")]
    rows = one * 2 + [("e", f"e-{i}", f"gamma x{i}", "t", "s", "HR", "2020-01-01", "public") for i in range(5)]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id string, chunk_id string, text string, title string, section_path string, department string, updated_at string, access_level string"))
    assert [r.chunk_id for r in lexical.search(index, asked(spark, ("alpha", 5, None, None)), 5).collect()] == ["d-0", "d-0"]


def test_cells_miss_nothing(spark, monkeypatch):
    """Clustered, copied and zero vectors in many cells and tiles: the same as all products, and far cells aren't visited."""
    monkeypatch.setattr(dense, "TILE", 16)
    monkeypatch.setattr(dense, "BLOCK", 3)
    chance = np.random.default_rng(2)
    middles = chance.standard_normal((12, 6)) * 4
    rows = [middles[i % 12] + chance.standard_normal(6) * 0.2 for i in range(900)] + [np.zeros(6)] * 5 + [middles[0]] * 300
    names = [f"k{i:05d}" for i in range(len(rows))]
    vectors = spark.createDataFrame([(n, "x" if i % 2 else None, v.tolist()) for i, (n, v) in enumerate(zip(names, rows))], "key string, tag string, vector array<double>")
    asked_rows = [middles[3] + 0.1, middles[0], np.zeros(6), -middles[5], *chance.standard_normal((6, 6))]
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked_rows)], "query_id string, vector array<double>")
    cells = dense.in_cells(vectors, "key", "tag")
    assert cells.sizes.sum() == len(rows) and len(cells.sizes) > 5
    got = {}
    for r in sorted(dense.nearest(cells, queries, 7).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.key, r.score, r.tag))
    for i, q in enumerate(asked_rows):
        products = np.round(np.array(rows) @ q, 9)
        best = sorted(range(len(rows)), key=lambda j: (-products[j], names[j]))[:7]
        assert [(k, t) for k, _, t in got[f"q{i}"]] == [(names[j], "x" if j % 2 else None) for j in best], i
        assert [s for _, s, _ in got[f"q{i}"]] == pytest.approx([products[j] for j in best], abs=1e-8)
    bounded = queries.where("query_id = 'q0'").withColumn("bound", F.lit(float(got["q0"][-1][1])))
    assert dense._visits(cells, bounded, 7).count() < len(cells.sizes) / 2
    assert dense.nearest(dense.in_cells(vectors.limit(0), "key"), queries, 7).count() == 0


def test_queries_of_different_top_k(spark, chunks):
    """One retrieval gives each query what it gets alone."""
    corpus = retrieval.build_corpus(chunks)
    rows = [("alpha beta one", 1, None, "restricted"), ("alpha beta one", 3, None, "public"), ("epsilon delta two", 20, None, None)]
    together = retrieval.retrieve(corpus, asked(spark, *rows), Settings(candidate_size=1))
    def shown(frame):
        return {tuple(r[c] for c in ("query_id", "chunk_id", "score", "rank")) for r in frame.collect()}

    parts = [retrieval.retrieve(corpus, asked(spark, *rows).where(F.col("query_id") == f"q{i}"), Settings(candidate_size=1)) for i in range(3)]
    for name in ("hits", "lexical", "dense"):
        assert shown(getattr(together, name)) == set().union(*(shown(getattr(p, name)) for p in parts)), name


def test_blocks_hold_hits_as_bytes(spark):
    """A block's hits are one binary value: place, occurrences and length of each chunk that has the term."""
    rows = [("a", None, "public", ["x", "y", "x"]), ("b", None, "public", ["x"]), ("c", None, "public", None)]
    chunks = spark.createDataFrame(rows, f"chunk_id string, department string, access_level string, {lexical.INDEX_TOKENS} array<string>")
    found = {r.term: np.frombuffer(r.hits, "<i4").reshape(-1, len(lexical.HIT)).tolist() for r in lexical.build_index(chunks).blocks.collect()}
    assert found == {"x": [[0, 2, 3], [1, 1, 1]], "y": [[0, 1, 3]]}


def test_tokens_are_one_string_a_chunk(spark, chunks):
    """Joined or as arrays, brought or made: the same index; chunks without tokens have none."""
    blank = chunks.unionByName(chunks.limit(1).withColumns({"chunk_id": F.lit("blank"), **{c: F.lit("?") for c in ("title", "section_path", "text")}}))
    joined = lexical.with_index_tokens(blank)
    rows = {r.chunk_id: r for r in joined.collect()}
    assert rows["blank"][lexical.INDEX_TOKENS] == "" and rows["blank"][lexical.INDEX_LENGTH] == 0
    assert all(r[lexical.INDEX_LENGTH] == len(r[lexical.INDEX_TOKENS].split()) for r in rows.values()) and sum(r[lexical.INDEX_LENGTH] for r in rows.values())
    arrays = joined.drop(lexical.INDEX_LENGTH).withColumn(lexical.INDEX_TOKENS, F.filter(F.split(lexical.INDEX_TOKENS, " "), lambda x: x != ""))
    found = []
    for one in (blank, joined, arrays):
        index, vectors = lexical.build_index(one), dense.build_index(one, "hash://16").vectors
        found.append((index.mean_length, sorted(map(str, index.blocks.collect())), sorted(map(str, index.shards.collect())), sorted(map(str, vectors.collect()))))
    assert found[0] == found[1] == found[2] and len(found[0][3]) == len(rows)


def test_vectors_are_made_and_placed_by_the_same_tasks(spark, chunks, monkeypatch):
    """No table of vectors is written before that of their cells, where they are bytes."""
    made = []
    monkeypatch.setattr(dense, "written", lambda df, name: made.append(name) or written(df, name))
    index = dense.build_index(lexical.with_index_tokens(chunks), "hash://16")
    assert made == ["placed", "cells"] and dict(index.cells.tiles.select(F.inline("rows")).dtypes)["vector"] == "binary"
    want = {r.chunk_id: r.vector for r in dense.encoded(chunks, "hash://16").collect()}
    assert {r.chunk_id: r.vector for r in index.vectors.collect()} == want and want


def test_bounds_are_sought_where_they_can_help(spark, monkeypatch):
    """Not for queries whose common terms outweigh what their rare ones can bound, or whose rare terms are in too few chunks."""
    rows = [("q0", "a", 5, 9.0), ("q0", "b", 500, 1.0), ("q1", "a", 2, 9.0), ("q1", "b", 500, 1.0), ("q2", "a", 5, 5.0), ("q2", "b", 500, 6.0), ("q2", "c", 400, 6.0), ("q3", "b", 500, 1.0), ("q4", "a", 3, 9.0), ("q4", "d", 3, 4.0), ("q4", "b", 500, 2.0)]
    wanted = spark.createDataFrame(rows, "query_id string, term string, df long, weight double")
    index = lexical.LexicalIndex(None, None, None, 1000, 10.0, 1.0)
    assert {r.query_id for r in lexical.prunable(index, wanted, 5).collect()} == {"q0", "q4"}
    monkeypatch.setattr(lexical, "SHARD_CHUNKS", 8)
    calls, best = [], lexical._best
    monkeypatch.setattr(lexical, "_best", lambda *args: calls.append(len(args)) or best(*args))
    rows, chunks = many_chunks(spark, 100)
    got = lexical.search(lexical.build_index(chunks), asked(spark, ("common", 5, None, "public")), 6)
    assert [(r.chunk_id, r.score) for r in sorted(got.collect(), key=lambda r: r["rank"])] == plain_okapi(rows, "common", 6, None, "public")
    assert calls == [5]


def test_buckets_are_taken_for_all_terms_of_a_batch():
    terms = ["a", "quy", "định", "_9", "x" * 500]
    for n in (1, 7, 384):
        plain = [int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little") % n for t in terms]
        assert dense._buckets(pa.array(terms), n).tolist() == plain
    assert dense._buckets(pa.array([], pa.string()), 384).tolist() == []
