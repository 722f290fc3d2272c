import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrain.llm import gru_lm, queries
from docgrain.llm.gru_lm import Gru, Layout, Net

from .helpers import ODD, TINY, frame, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = Net(most_words=30, least_count=1, classes=5, width=6, lanes=3, window=4, score_window=7, least_tokens=2000)


def held_rows():
    return F.expr("crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 7 = 2")


def words(text):
    return [*WORD.findall((text or "").translate(LOWER)), " "]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 6)))
    return sorted(out, key=str)


def got(found):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str)


def test_counts_match_python(spark):
    rows = [*ODD, *[(100 + i, prose(60, i, 50)) for i in range(40)], (99, "Same WORDS twice. Same words twice.")]
    found = gru_lm.score(frame(spark, rows, clashing=True).repartition(3), held_rows(), net=SMALL).collect()
    assert got(found) == plain(rows)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found)
    twins = [r.score for r in found if r.doc_id == 5]
    assert len(twins) == 2 and twins[0] == pytest.approx(twins[1])


def test_nothing_to_learn_from(spark):
    assert gru_lm.score(frame(spark, []), held_rows(), net=SMALL).count() == 0
    rows = gru_lm.score(frame(spark, [(1, "a b"), (2, None)]), F.lit(True), net=SMALL).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def net(seed=0, n=12):
    chance = np.random.default_rng(seed)
    layout = Layout(sorted(chance.integers(1, 90, n).tolist(), reverse=True), 25, SMALL)
    weights = gru_lm.new_weights(layout, SMALL)
    return {k: v + chance.standard_normal(v.shape).astype(np.float32) * 0.3 for k, v in weights.items()}, layout


def by_hand(w, layout, tokens):
    """Log probability of one document, token by token, from the equations; and of all words at the last step."""
    h, total, n = np.zeros(SMALL.width), 0.0, SMALL.width
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for x in tokens:
        classes = soft(w["classes"].astype(float) @ h + w["class_bias"])
        chances = np.concatenate([classes[c] * soft(w["words"][a:b].astype(float) @ h + w["word_bias"][a:b]) for c, (a, b) in enumerate(zip(layout.start[:-1], layout.start[1:], strict=True))])
        total += math.log(chances[x])
        g, a = w["embed"][x] @ w["into"] + w["bias"], h @ w["again"]
        update, reset = (1 / (1 + np.exp(-(g[i : i + n] + a[i : i + n]))) for i in (0, n))
        h = (1 - update) * np.tanh(g[2 * n :] + reset * a[2 * n :]) + update * h
    return total, chances


def test_likelihood_is_that_of_whole_documents():
    """State is carried over windows and begins anew with each document, whatever lane it is in."""
    w, layout = net()
    chance = np.random.default_rng(5)
    sizes = np.array([1, 40, 3, 17, 9, 1, 25])
    tokens = chance.integers(0, layout.size, sizes.sum())
    found = gru_lm.log_likelihoods(w, layout, tokens, sizes, SMALL)
    ends = np.cumsum(sizes)
    for got_, b, n in zip(found, ends, sizes, strict=True):
        total, chances = by_hand(w, layout, tokens[b - n : b])
        assert got_ == pytest.approx(total, rel=1e-4)
        assert chances.sum() == pytest.approx(1)


def test_gradients():
    """Backpropagation agrees with differences of the loss, within one window."""
    w, layout = net(3)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    chance = np.random.default_rng(7)
    ids = chance.integers(0, layout.size, (5, 3))
    begins = chance.random((5, 3)) < 0.3
    state = chance.standard_normal((3, SMALL.width)) * 0.1

    def loss():
        before, _, _ = Gru(w, layout).read(ids, begins, state, keep=True)
        return -Gru(w, layout).outputs(before.reshape(-1, SMALL.width).astype(np.float64), ids.ravel())[0].sum()

    gru = Gru(w, layout)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    before, _, kept = gru.read(ids, begins, state, keep=True)
    _, back = gru.outputs(before.reshape(-1, SMALL.width), ids.ravel(), grads)
    gru.backward(ids, begins, before, kept, back.reshape(before.shape), grads)
    for k, v in w.items():
        for at in chance.integers(0, v.size, 6):
            kept_value, step = v.flat[at], 1e-3
            v.flat[at] = kept_value + step
            up = loss()
            v.flat[at] = kept_value - step
            down = loss()
            v.flat[at] = kept_value
            assert grads[k].flat[at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-3), k


def test_learns_what_counts_cannot(spark):
    """Texts of two kinds and of fixed order: held-out ones get likelier than by counts."""
    cycles = [[f"{k}{i}" for i in range(8)] for k in "ab"]
    rows = [(i, " ".join((cycles[i % 2] * 12)[i % 5 : i % 5 + 60])) for i in range(150)]
    found = [r for r in gru_lm.score(frame(spark, rows), held_rows(), net=Net(most_words=30, classes=5, width=12, lanes=16, window=12, least_tokens=60_000)).collect() if r.held_out]
    assert len(found) > 10
    assert sum(r.score for r in found) > 0.6 * sum(r.base_score for r in found)


def test_tables(spark):
    found = queries.op12_lm_scoring(spark, TINY).collect()
    docs = table(TINY, "documents")
    assert got(found) == plain(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)))
    apart = [r for r in found if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_learns_from_every_row(spark):
    """A word that a single row has changes its vector, whichever row that is."""
    n, net_ = 60, Net(most_words=60, least_count=1, classes=5, width=6, lanes=3, window=4, least_tokens=10)
    layout = Layout([2] * n, 1, net_)
    before = gru_lm.new_weights(layout, net_)
    rows = spark.createDataFrame([(0, i, bytearray(np.array([i, i], "<u2").tobytes()), [2], [True]) for i in range(n)], "block long, row int, tokens binary, sizes array<int>, flags array<boolean>")
    model = gru_lm.Model(gru_lm.new_weights(layout, net_), layout, 2 * n, n, 0, 0)
    gru_lm.trained(rows, model, net_)
    assert (np.abs(model.weights["embed"] - before["embed"])[:n].max(axis=1) > 1e-6).all()


def test_features_come_first_inside():
    """Gates are read and kept with lanes side by side, so no array operation runs over a few features at a time."""
    w, layout = net(4)
    ids = np.random.default_rng(2).integers(0, layout.size, (5, 3))
    before, state, kept = Gru(w, layout).read(ids, np.zeros(ids.shape, bool), np.zeros((3, SMALL.width), np.float32), keep=True)
    assert before.shape == (5, 3, SMALL.width) and state.shape == (3, SMALL.width)
    assert [x.shape for x in kept] == [(SMALL.width, 5, 3)] * 5 and all(x.flags.c_contiguous and x.dtype == np.float32 for x in kept)
    assert (kept[0].transpose(1, 2, 0) == before).all()


def test_classes_are_scored_in_one_array(monkeypatch):
    """A window's exponentials are taken at once, however many classes its words are in; so are those of a step's gates."""
    w, layout = net(4)
    ids = np.arange(layout.size)
    states = np.random.default_rng(3).standard_normal((len(ids), SMALL.width)).astype(np.float32)
    exp, calls = np.exp, []
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    Gru(w, layout).outputs(states, ids, {k: np.zeros_like(v) for k, v in w.items()})
    assert layout.classes > 3 and len(calls) == 1
    Gru(w, layout).read(ids[:, None], np.zeros((len(ids), 1), bool), np.zeros((1, SMALL.width), np.float32))
    assert len(calls) == 1 + len(ids)
