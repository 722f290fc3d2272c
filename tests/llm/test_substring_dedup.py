import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from docgrain.llm import substring_dedup as S

from .helpers import ODD, frame, prose

LOW = -(10**19)


def brute(rows, width=20):
    """(doc_id, words, removed, kept text) of each row."""
    texts = [(LOW if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            first[key] = min(first.get(key, (i, s)), (i, s))
    late = {(n, s) for n, words in texts for s in range(len(words) - width + 1) if first[tuple(words[s : s + width])] < (n, s)}
    out = []
    for (i, _), (n, words) in zip(rows, texts):
        gone = {s + j for s in range(len(words) - width + 1) if (n, s) in late for j in range(width)}
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def passages():
    shared = prose(60, 77)
    rows = [(i, f"{prose(30, i)} {shared} {prose(25, 50 + i)}") for i in (5, 3, 9)]
    rows += [(20, prose(25, 6) + " " + prose(25, 6)), (21, "z " * 50), (22, prose(19, 8)), (23, prose(19, 8)), (24, shared), (25, f"{shared}\n\n{shared[:80]}")]
    return rows


def check(spark, rows, **more):
    got = S.remove_repeats(frame(spark, rows, clashing=True), digest=True, **more).collect()
    want = sorted((str(i), n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(rows))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_matches_brute_force(spark):
    check(spark, passages())
    for sizes in (S.Packs(pack_bytes=400, bucket_bytes=50, group_bytes=300), S.Packs(pack_bytes=300, bucket_bytes=60, group_bytes=100, fan=3), S.Packs(1, 1000, 1, 1)):
        check(spark, passages(), packs=sizes)


def test_groups_are_alike_on_both_sides(spark):
    ids = [0, 15, 16, -1, -16, -17, 2**40 + 3, 2**62 + 17, S.NO_ID + 5, -(2**62) - 15]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(S._group(F.col("i"), 97)).collect()]
    assert got == S._groups(np.array(ids), 97).tolist()
    strided = S._groups(np.arange(0, 64 * 10_000, 64), 64)
    assert np.bincount(strided, minlength=64).min() > 100, "ids in even steps fill all groups"


def test_null_ids_are_dealt_out(spark):
    rows = [(None, prose(30, i)) for i in range(60)]
    numbers = {r[0] for r in frame(spark, rows).select(S._number(F.col("doc_id"), F.col("text"))).collect()}
    assert len(numbers) == 60 and all(S.NO_ID <= n < -(2**61) for n in numbers)
    shared = prose(25, 999)
    got = S.remove_repeats(frame(spark, [*[(None, f"{shared} x{i}") for i in range(5)], (1, shared)]), digest=True).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 25), ("None", 0), *[("None", 25)] * 4]


def test_odd_rows(spark):
    check(spark, ODD)
    long = prose(25, 4)
    check(spark, [(5, long), (5, long), (None, long), (2, long)])
    check(spark, [(5, prose(30, 1)), (5, prose(25, 2)), (5, prose(90, 3) + " " + long), (5, "short"), (7, prose(90, 3)), (3, long)])
    assert S.remove_repeats(frame(spark, []), digest=True).count() == 0


def test_texts(spark):
    docs = frame(spark, [*passages(), (30, None)], clashing=True)
    out = S.remove_repeats(docs)
    assert out.columns == [*docs.columns, "repeats_"]
    assert S.remove_repeats(docs.drop("repeats")).columns == [*docs.drop("repeats").columns, "repeats"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.pop(30) is None
    was = dict(passages())
    for i, _, gone, text in brute(passages()):
        assert re.findall(r"[^\x20\x09-\x0D]+", got[i]) == text.split(" ") * bool(text)
        assert gone or got[i] == was[i], "untouched texts stay as they are"


def test_cut_out():
    keep = np.array([True, False, True, True, False, False, True, False])
    assert S.cut_out(b" a  b\tc\n\nd e\nf g h ", keep) == b"a c\n\nd\ng"
    assert S.cut_out(b"a b", np.array([False, False])) == b""
