import corpus_pipeline
import numpy as np

from docgrain.cluster import made, written
from docgrain.llm import mixing, sentencepiece_bpe

from .helpers import edited, frame, prose
from .test_minhash_dedup import brute as near
from .test_mixing import brute as mixed
from .test_quality_rules import WORD, counts
from .test_substring_dedup import brute as cut


def corpus():
    rows = []
    for i in range(40):
        text = prose(60 + i, i)
        rows.append((3 * i, text, ("en", "de")[i % 2], f"src{i % 5}"))
        if i % 4 == 0:
            rows.append((3 * i + 1, edited(text, 0.01, i), "en", "src1"))
        if i % 5 == 0:
            rows.append((3 * i + 2, f"{prose(20, 500 + i)} {prose(60, 999)} {prose(20, 600 + i)}", "fr", "src2"))
    return [*rows, (900, "short", "en", "src1"), (901, None, "en", "src1"), (902, "a b c d e f " * 30, "en", "src2")]


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [r for r in rows if (c := counts(r[1]))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    component = {i: c for i, (_, c) in near([r[:2] for r in left], 5).items()}
    left = [r for r in left if component[r[0]] == r[0]]
    texts = cut([r[:2] for r in left])
    left = [(i, t, la, s) for (i, _, la, s), (_, n, gone, t) in zip(left, texts) if gone < n or not gone]
    copies = {int(i): c for i, *_, c in mixed(left, mixing.MIX)[0]}
    want = sorted(i for i, *_ in left for _ in range(copies[i]))
    assert sorted(r.doc_id for r in got) == want and 0 < len(want) < len(rows)
    assert all(r.lossless for r in got)
    vocabulary = sentencepiece_bpe.Vocabulary()
    text = {i: t for i, t, *_ in left}
    for r in got:
        data, _ = sentencepiece_bpe.decode_run(vocabulary, np.array(r.ids), np.array([0, len(r.ids)]))
        assert WORD.findall(data.tobytes().decode()) == WORD.findall(text[r.doc_id])


def test_stages_return_documents(spark, tmp_path):
    docs = frame(spark, corpus(), clashing=True)
    columns = docs.columns
    assert {"repeats", "tick`ed", "domain"} <= set(columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == docs.count()
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_stages_leave_what_others_read(spark, tmp_path):
    """Each deletes but its own tables that its result doesn't read: interleaved runs don't touch each other's."""
    mine = written(spark.range(3), "mine")
    one, two = frame(spark, corpus()), frame(spark, [(i, prose(50, 900 + i), "en", "src1") for i in range(30)])
    first, second = [], []
    for name, stage in corpus_pipeline.STAGES:
        before = set(made(spark))
        one, two = stage(spark, one, str(tmp_path)), stage(spark, two, str(tmp_path))
        assert len([x for x in made(spark) if x not in before]) <= 6, name
        first.append(one)
        second.append(two)
    sizes = [x.count() for x in first]
    assert sizes == [x.count() for x in first] and 0 < sizes[-1] <= sizes[0] and all(x.count() > 0 for x in second)
    assert mine.count() == 3, "other tables stay"


def test_two_runs(spark, tmp_path):
    """A run deletes its own tables alone, and the rows of both are there afterwards."""
    folders = [str(tmp_path / x) for x in "ab"]
    for i, folder in enumerate(folders):
        frame(spark, corpus()[i:]).write.parquet(f"{folder}/documents.parquet")
    before = set(made(spark))
    runs = [corpus_pipeline.run(spark, folder) for folder in folders]
    assert all(r.count() > 0 for r in runs)
    assert len([x for x in made(spark) if x not in before]) <= 2, "the last written table of each"


def test_copies_of_the_mix_are_encoded_apart(spark, tmp_path):
    docs = frame(spark, [(1, prose(300, 1), "en", "src1")] * 2 + [(2, prose(300, 1), "en", "src1")])
    got = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2] and len({tuple(r.ids) for r in got}) == 3 and all(r.lossless for r in got)
