import pytest
from pyspark.sql import functions as F

from docgrain import config
from docgrain.engine import Engine
from docgrain.operators import answering, datasets, evaluation, generation
from docgrain.sources import files
from docgrain.streaming import incremental

from .helpers import write_files


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    write_files(root / "raw")
    settings = config.Settings(raw_data_dir=str(root / "raw"), chunk_output_path=f"{root}/chunks", bm25_index_path=f"{root}/bm25", dense_index_dir=f"{root}/dense")
    made = Engine(spark, settings)
    made.ingest()
    return made.build(save=True)


def ask(engine, *texts, **more):
    return {r.question: r for r in engine.ask(engine.queries(*texts, **more)).collect()}


def test_ingest(engine):
    rows = files.read_chunks(engine.spark, engine.settings.chunk_output_path).collect()
    by = {r.doc_id: r for r in rows}
    assert set(by) == {"hr_leave_policy_internal", "engineering_onboarding_public", "operations_it_helpdesk_sla_public_2024-09-25", "security_access_restricted", "legal_document_retention_internal_2024-10-28", "broken_public"}
    assert len(rows) == 10 and by["broken_public"].text == "<p>café bar</p>" and by["broken_public"].section_path == "General"
    sla = by["operations_it_helpdesk_sla_public_2024-09-25"]
    assert (sla.title, sla.updated_at, sla.access_level, sla.department) == ("operations it helpdesk sla public 2024-09-25", "2024-09-25", "public", "General")


def test_scenarios(engine):
    named = "Theo tài liệu 'engineering onboarding public', mục 'Code Review' quy định gì?"
    multi = "Hãy tổng hợp yêu cầu chính ở mục 'Thời hạn lưu trữ hồ sơ' và 'Lưu trữ và truy xuất' trong tài liệu 'legal document retention internal 2024-10-28'."
    secret = "Thông tin đăng nhập nhạy cảm cần xoay vòng bao lâu?"
    got = ask(engine, named, multi, secret, "Chính sách?", "Công ty có chính sách nuôi thú cưng tại văn phòng không?", access_level="restricted")
    assert got[named].status == "ANSWERED" and got[named].citations[0].chunk_id.startswith("engineering_onboarding_public-1-") and got[named].confidence in ("High", "Medium")
    assert {c.chunk_id.rsplit("-", 1)[0] for c in got[multi].citations} >= {f"legal_document_retention_internal_2024-10-28-{i}" for i in (0, 1)}
    assert got[secret].status == "ANSWERED" and "90" in got[secret].answer
    refused = got["Chính sách?"]
    assert (refused.status, refused.confidence, refused.citations) == ("NOT_FOUND", "Low", []) and "Cau hoi goc" in refused.clarifying_question
    assert got["Công ty có chính sách nuôi thú cưng tại văn phòng không?"].status == "NOT_FOUND"
    assert ask(engine, secret, access_level="public")[secret].status == "NOT_FOUND"
    assert ask(engine, named)[named] == ask(engine, named)[named]


def test_search(engine):
    assert engine.search(engine.queries("zzzzzzzzzzzz", access_level="internal")).count() == 0
    many = engine.search(engine.queries("Theo tài liệu 'engineering onboarding public', mục 'Code Review' quy định gì?", top_k=50, access_level="restricted")).collect()
    assert any(r.chunk_id.startswith("engineering_onboarding_public-1-") for r in many)
    with pytest.raises(ValueError):
        engine.search(engine.queries("test", top_k=0))


def test_saved_indexes(engine):
    again = Engine(engine.spark, engine.settings)
    assert again.health()["indices_loaded"] is False
    with pytest.raises(ValueError):
        again.search(again.queries("x"))
    queries = engine.queries("xoay vòng 90 ngày", "SLA hỗ trợ IT", access_level="restricted")
    assert sorted(map(tuple, again.load().search(queries).collect())) == sorted(map(tuple, engine.search(queries).collect()))
    debug = {r.query_id: r for r in engine.search_debug(queries).collect()}
    assert debug["1"].candidate_size == 24 and len(debug["1"].dense) == 5 and debug["1"].bm25[0].score > 0


def rows_of(spark, question, hits):
    schema = "query_id string, rank int, score double, doc_id string, chunk_id string, title string, section_path string, text string"
    table = spark.createDataFrame([("q", i + 1, *h) for i, h in enumerate(hits)], schema)
    queries = spark.createDataFrame([("q", question, 5)], "query_id string, query string, top_k int")
    return answering.gated(answering.features(answering.select_citations(generation.drafted(answering.gathered(queries, table), config.Settings()))))


GATES = {
    "n1_no_hits": ("anything here", []),
    "n2_low_score": ("alpha beta", [(0.1, "d", "c", "t", "s", "alpha beta gamma")]),
    "n4_low_relevance": ("omega psi", [(0.9, "d", "c", "t", "s", "alpha beta gamma")]),
    "n6_yes_no": ("Có alpha beta gamma delta epsilon zeta không", [(0.9, "d", "c", "t", "s", "alpha x1 x2 x3 x4")]),
    "n7_yes_no_open": ("Có alpha beta gamma không", [(0.9, "d", "c", "t", "s", "alpha beta x1 x2 x3 x4")]),
    "n8_open_relevance": ("alpha b1 c1 d1 e1 f1 g1 h1", [(0.9, "d", "c", "t", "s", "alpha y1 y2 y3 y4 y5 y6 y7")]),
    "n9_open_support": ("alpha b1 c1 d1", [(0.9, "d", "c", "t", "s", "alpha y1 y2 y3 y4")]),
    "n10_numbers": ("alpha beta 2020", [(0.9, "d", "c", "t", "s", "alpha beta 2021")]),
    "n11_acronyms": ("alpha beta ESOP", [(0.9, "d", "c", "t", "s", "alpha beta said")]),
    "n12_open_coverage": ("alpha kappa1 kappa2 kappa3", [(0.9, "d", "c", "t", "s", "alpha x1")]),
    "n13_doc_coverage": ("alpha kappa1 kappa2 kappa3", [(0.9, "d", "c", "t", "s", "alpha x1"), (0.8, "d", "c2", "t", "s", "alpha x2")]),
    "n14_no_citation": ("omega psi", [(0.9, "d", "c", "t", "s", "alpha beta gamma")]),
}


@pytest.mark.parametrize("gate", GATES)
def test_gates(spark, gate):
    row = rows_of(spark, *GATES[gate]).first()
    assert row[gate] and row["refused"]


def test_no_gate(spark):
    row = rows_of(spark, "alpha beta gamma", [(0.9, "d", "c", "t", "s", "Alpha beta gamma delta."), (0.8, "e", "c2", "t", "s", "alpha  BETA gamma delta."), (0.7, "e", "c3", "t", "s", "Alpha beta only.")]).first()
    assert not row["refused"] and [h.chunk_id for h in row["selected"]] == ["c", "c3"]
    assert row["n_candidates"] == 3 and row["coverage"] == pytest.approx(2 / 3)


def test_citations_prefer_targets(spark):
    hits = [(0.9, "d", "wrong", "other doc", "General", "code review of alpha"), (0.6, "e", "right", "engineering onboarding public", "Eng > Code Review", "hai người duyệt")]
    row = rows_of(spark, "Theo tài liệu 'engineering onboarding public', mục 'Code Review' gì?", hits).first()
    assert row["selected"][0].chunk_id == "right"


def test_generation(spark):
    hits = [(0.9, "d", "c1", "t", "s", "Alpha beta gamma."), (0.8, "e", "c2", "t", "s", "Delta.")]
    table = spark.createDataFrame([("q", i + 1, *h) for i, h in enumerate(hits)], "query_id string, rank int, score double, doc_id string, chunk_id string, title string, section_path string, text string")
    rows = answering.gathered(spark.createDataFrame([("q", "alpha", 5)], "query_id string, query string, top_k int"), table)
    model = config.Settings(llm_backend="transformers")
    assert generation.effective(model).llm_backend == "heuristic"
    said = generation.drafted(rows, model, lambda _: lambda prompt: 'x\n{"answer": "yes", "citations": [{"chunk_id": "c2"}, 3]}').first()
    assert (said.draft, said.preferred) == ("yes", ["c2"])
    unread = generation.drafted(rows, model, lambda _: lambda prompt: "no json").first()
    assert (unread.draft, unread.preferred) == ("- Alpha beta gamma\n- Delta", ["c1", "c2"])
    assert generation.read_output("[1]") is None and generation.read_output("{}") == ("NOT_FOUND", [])


def test_evaluation(engine, spark):
    chunks = files.read_chunks(spark, engine.settings.chunk_output_path)
    negatives = spark.createDataFrame([("Công ty có chính sách nuôi thú cưng tại văn phòng không?",), ("Quy định sử dụng drone là gì?",)], "question string")
    items = datasets.generate(chunks, negatives, hard=4, multi=3, target=10 + 4 + 3 + 2)
    ids = [r.id for r in items.orderBy("id").collect()]
    assert ids[0] == "q001" and ids[-1] == "q019"
    with pytest.raises(ValueError):
        datasets.generate(chunks, negatives, target=1)
    assert datasets.generate(chunks, hard=0, multi=0).count() == 10 + 30
    found, answered = engine.evaluate(items)
    by = {r["mode"]: r for r in found.collect()}
    assert by["bm25"].recall_at_k == 1.0 and by["hybrid"].recall_at_k > 0.9 and by["bm25"].n == 17
    row = answered.first()
    assert row.recall == 1.0 and row.precision > 0.6
    rates, failed = engine.report(items)
    assert rates.first().negative_hallucination_rate == 0
    assert {r.kind for r in evaluation.failure_counts(failed).collect()} <= {"failure", "query_type", "difficulty"}
    split = datasets.stratified_split(items, 0.2).groupBy("query_type", "difficulty").agg(F.count_if("holdout").alias("h"), F.count("*").alias("n")).collect()
    assert all(r.h == max(1, min(r.n - 1, round(r.n * 0.2))) for r in split)
    with pytest.raises(ValueError):
        datasets.stratified_split(items, 1.0)


def test_metrics(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["c"]), (["a"], []), ([], ["x"]), (["x", "y"], ["y", "x"])], "ids array<string>, gold array<string>")
    got = rows.select(evaluation.recall_at_k(F.col("ids"), F.col("gold"), 2).alias("r"), evaluation.reciprocal_rank(F.col("ids"), F.col("gold")).alias("m")).collect()
    assert [(r.r, r.m) for r in got] == [(0.0, pytest.approx(1 / 3)), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    paths = "paths: {raw_data_dir: a, chunk_output_path: b/c, bm25_index_path: d, dense_index_dir: e, eval_dataset_path: f/g}"
    path.write_text(paths + "\nretrieval: {candidate_size: 7}\n")
    s = config.load_settings(path)
    assert (s.candidate_size, s.min_relative_score, s.metadata_weight, s.chunk_size) == (7, 0.45, 0.18, 350)
    path.write_text("app: {version: x}")
    with pytest.raises(ValueError):
        config.load_settings(path)
    with pytest.raises(ValueError):
        config.validate(config.Settings(overlap=350))


def test_compose_and_unknown_types(spark):
    rows = spark.createDataFrame([("1", "é"), ("2", "é"), ("3", None)], "k string, text string")
    assert {r.k: r.text for r in files.compose(rows, "k").collect()} == {"1": "é", "2": "é", "3": None}
    with pytest.raises(ValueError):
        files.text_of("xyz", b"")
    for suffix in ("pdf", "docx"):
        with pytest.raises(Exception):
            files.text_of(suffix, b"")


def test_incremental(spark, tmp_path):
    raw, table = tmp_path / "raw", f"{tmp_path}/chunks"
    raw.mkdir()
    settings = config.Settings(raw_data_dir=str(raw))
    for name in ("a_public.md", "b_internal.md"):
        (raw / name).write_text(f"# {name}\nsome text")
        incremental.watch(spark, settings, table, f"{tmp_path}/check").awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(table).collect()} == {"a_public", "b_internal"}
