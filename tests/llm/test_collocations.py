import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from docgrain.llm import blocks, collocations, common
from docgrain.llm.collocations import Mining

from .helpers import frame, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, mining):
    """(lang, rank, phrase, a, l, r, n, score) of each phrase, from Python's whole numbers."""
    out = []
    for lang in {x[2] or "und" if x[2] is None else x[2] for x in rows}:
        f, n = Counter(), 0
        for _, text, of, *_ in rows:
            if ("und" if of is None else of) != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for size in range(1, mining.most_words + 1):
                    f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= mining.least}
        best = []
        for w, a in found.items():
            if any(100 * b >= mining.covered_percent * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in found.items() if len(v) > len(w)):
                continue
            score, k = min((mining.scale * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            best.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[: mining.top], 1)]
    return sorted(out)


def got(found):
    return sorted(tuple(x) for x in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


ODD = [(1, None, "en"), (2, "", None), (3, " \t\n", "xx"), (4, ".,;:!?", "en"), (5, "a b c a b c. A B c,a b\tc" * 3, None), (5, "a b c a b c. A B c,a b\tc" * 3, None), (None, "ü é x ü é x ü é x\x0bü é", ""), (6, "日本 語 日本 語 日本 語", "")]


def test_matches_counting_in_python(spark):
    rows = ODD + [(10 + i, prose(300, i, 12).replace("w3 ", "w3. "), ("en", "de", None)[i % 3]) for i in range(12)] + [(90, prose(40_000, 5, 60), "long")]
    for mining in (Mining(), Mining(least=2, top=7), Mining(least=3, most_words=4, covered_percent=30, top=50)):
        docs = frame(spark, [(i, t, lang, "s") for i, t, lang in rows], clashing=True).repartition(3)
        want = plain(rows, mining)
        assert got(collocations.mine(docs, mining)) == want and want


def test_nothing_to_find(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(1, None), (2, ""), (3, "each word but once")])).count() == 0


def test_blocks_are_cut_anywhere(spark, monkeypatch):
    """Counts don't depend on where blocks and rows end."""
    rows = [(i, prose(200, i, 9), "en") for i in range(30)]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(blocks, "ROW_BYTES", 400)
    monkeypatch.setattr(collocations, "RANGE_KEYS", 500)
    mining = Mining(least=4)
    docs = frame(spark, [(i, t, lang, "s") for i, t, lang in rows])
    assert got(collocations.mine(docs, mining)) == plain(rows, mining)


def test_scores_beyond_64_bits(spark):
    """1,000,000 a a and l r pass 64 bits, and the quotient is still exact."""
    key = lambda *ids: b"".join(i.to_bytes(4) for i in (*ids, *[0] * (3 - len(ids))))
    a, left, right = 3_000_000_000, 7_000_000_001, 4_000_000_007
    phrases = spark.createDataFrame([(key(1, 2), a)], "key binary, f long")
    words = spark.createDataFrame([("en", "x", left, 1, key(1)), ("en", "y", right, 2, key(2))], "grp string, word string, f long, id long, key binary")
    r = collocations.scored(phrases, words).first()
    assert (r.score, r.l, r.r, r.grp) == (10**6 * a * a // (left * right), left, right, "en")


def test_radix_runs():
    chance = random.Random(1)
    rows = [tuple(chance.choice((0, 1, 255, 256, 65_535, 65_536, 2**32 - 1)) for _ in range(3)) for _ in range(4000)]
    keys, n = collocations.counted_runs(np.array(rows, np.uint32))
    want = sorted(Counter(rows).items())
    assert [tuple(k) for k in keys.tolist()] == [k for k, _ in want] and n.tolist() == [v for _, v in want]
    assert keys.dtype == ">u4"
    again, sums = collocations.counted_runs(np.concatenate([keys, keys]), np.concatenate([n, 2 * n]))
    assert (again == keys).all() and (sums == 3 * n).all()
    keys, n = collocations.counted_runs(np.zeros((0, 3), np.uint32))
    assert len(keys) == len(n) == 0


def test_numbers_of_blocks_keep_their_bytes():
    ids = np.array([-1, 0, 1, 255, 256, 2**31 - 1], np.int32)
    assert (blocks.unpacked(blocks.packed(ids)) == ids).all()


def test_a_block_leaves_its_task_in_parts(spark, monkeypatch):
    """What a block's phrases are packed into is handed over before the next texts are read, not at the block's end."""
    taken = []
    monkeypatch.setattr(collocations, "on_batches", lambda f: taken.append(f) or common.on_batches(f))
    monkeypatch.setattr(collocations, "RANGE_KEYS", 50)
    found = spark.createDataFrame([(0, 0, "en", "x", 400, None), (0, 1, "en", "y", 400, None), *[(0, i, None, None, None, blocks.packed(np.array([-1, *[0, 1] * 20], np.int32))) for i in range(20)]], "block long, id int, grp string, word string, n long, ids binary")
    words = spark.createDataFrame([("en", "x", 400, 1, 0), ("en", "y", 400, 2, 400)], "grp string, word string, f long, id long, start long")
    rows = collocations.block_phrases(found, words)
    want = {b"\0\0\0\1\0\0\0\2\0\0\0\0": 400, b"\0\0\0\2\0\0\0\1\0\0\0\0": 380, b"\0\0\0\1\0\0\0\2\0\0\0\1": 380, b"\0\0\0\2\0\0\0\1\0\0\0\2": 380}
    assert {bytes(r.key): r.f for r in collocations.run_lengths(rows).collect()} == want
    texts = [blocks.packed(np.array([-1, *[0, 1] * 20], np.int32))] * 20
    none = pa.nulls(20, pa.int64())
    words = pa.RecordBatch.from_pydict({"block": [0, 0], "id": pa.array([0, 1], pa.int32()), "number": pa.array([1, 2]), "start": [0.0, 0.5], "share": [0.5, 0.5], "ids": pa.nulls(2, pa.binary())})
    rest = pa.RecordBatch.from_pydict({"block": none, "id": none.cast(pa.int32()), "number": none, "start": none.cast(pa.float64()), "share": none.cast(pa.float64()), "ids": pa.array(texts, pa.binary())})
    for order in ([words, rest], [rest, words]):
        parts = list(taken[0](iter(order)))
        assert len(parts) == 20 and sum(np.sum(collocations._unplanes(n, "<u4", 1)) for part in parts for n in part.column("n").to_pylist()) == 20 * (39 + 38)


def test_phrases_as_one_number_each():
    """A block's phrases as 64-bit numbers are counted as their keys are, in less memory."""
    chance = random.Random(2)
    for most in (2, 3, 4):
        top = collocations.code_limit(most) - 1
        numbers = np.array([chance.choice((0, 1, 2, 255, 256, min(top, 2**32 - 1))) for _ in range(3000)], np.uint32)
        keys, n = collocations.counted_runs(collocations.phrase_keys(numbers, most))
        got, times = collocations.counted_codes(collocations.phrase_codes(numbers, most), most)
        assert (got == keys).all() and (times == n).all()
    numbers = np.array([chance.randrange(1, 3000) for _ in range(200_000)], np.uint32)
    most = {}
    for name, count in (("keys", lambda: collocations.counted_runs(collocations.phrase_keys(numbers, 3))), ("codes", lambda: collocations.counted_codes(collocations.phrase_codes(numbers, 3), 3))):
        tracemalloc.start()
        count()
        most[name] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert most["codes"] < 50 * 400_000 < most["keys"], most


def test_blocks_of_too_many_words_for_such_numbers(spark, monkeypatch):
    rows = [(i, prose(200, i, 9), "en") for i in range(30)]
    monkeypatch.setattr(collocations, "code_limit", lambda most: 4)
    mining = Mining(least=4)
    docs = frame(spark, [(i, t, lang, "s") for i, t, lang in rows])
    assert got(collocations.mine(docs, mining)) == plain(rows, mining)
