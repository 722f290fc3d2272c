import random
import re
import zlib
from itertools import product

import numpy as np

from docgrain.llm import crf_quality as Q

from .helpers import ODD, frame, prose


def test_marginals_match_enumeration():
    chance = np.random.default_rng(3)
    steps = chance.normal(size=(2, 2))
    sizes = [1, 4, 2, 6]
    starts = np.append(0, np.cumsum(sizes))
    scores = chance.normal(size=starts[-1]) * 2
    got, pairs = Q.marginals(scores, steps, starts)
    want, want_pairs = [], np.zeros((2, 2))
    for a, b in zip(starts, starts[1:]):
        weights = {y: np.exp(sum(scores[a + i] * v for i, v in enumerate(y)) + sum(steps[u, v] for u, v in zip(y, y[1:]))) for y in product((0, 1), repeat=b - a)}
        total = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[i]) / total for i in range(b - a)]
        for y, w in weights.items():
            for u, v in zip(y, y[1:]):
                want_pairs[u, v] += w / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_features_are_of_each_text_alone():
    texts = ["Good line here.\nAnother one, fine.", "", "AAA AAA!!\n\n  \nx#% y", "é Ü 12", "same same same"]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    together, weight, starts = Q.line_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert np.diff(starts).tolist() == [2, 1, 2, 1, 1]
    for i, r in enumerate(raw):
        alone, w, _ = Q.line_features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(alone, together[starts[i] : starts[i + 1]]) and np.allclose(w, weight[starts[i] : starts[i + 1]])
    named = dict(zip(Q.FEATURES, together[2 + 1]))
    assert named["shouts"] == 1 and named["capitals"] == 1 and named["doubled_words"] == 0
    assert np.isclose(dict(zip(Q.FEATURES, together[-1]))["doubled_words"], 2 / 3)


def labelled(n):
    chance = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        lines = [prose(chance.randrange(5, 20), 100 * i + k).capitalize() + "." for k in range(chance.randrange(1, 6))]
        good = int(chance.random() < 0.7)
        if not good:
            kind = i % 3
            lines = [" ".join(w + "###" for w in x.split()) if kind == 0 else x.upper().replace(" ", "!! ") if kind == 1 else " ".join(["word"] * 30) for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, good, 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled(500)
    docs, table = frame(spark, rows, clashing=True), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.score(docs, Q.train(docs, table)).collect()}
    held = [(got[i], good) for i, good, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert np.mean([r.predicted == good for r, good in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_teach_nothing(spark):
    rows, labels = labelled(60)
    docs = frame(spark, rows)
    kind = "doc_id long, quality int, toxic int"
    swapped = [(i, 1 - q, t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    one, two = (Q.train(docs, spark.createDataFrame(x, kind)) for x in (labels, swapped))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.steps, two.steps)


def test_odd_rows(spark):
    docs = frame(spark, ODD, clashing=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.score(docs, Q.train(docs, none)).collect()
    assert len(got) == len(ODD) and all(abs(r.score - 0.5) < 1e-9 and r.predicted == 1 for r in got)
    model = Q.train(docs, spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in Q.score(docs, model).collect())
    assert Q.score(frame(spark, []), model).count() == 0


def plain_features(text):
    """A text's line features by plain string work, line by line."""
    def words_of(line):
        return re.findall(r"[^\x20\x09-\x0D]+", line)

    lines = [x for x in text.split("\n") if words_of(x)]
    low = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(x)] for x in lines]
    every = [w for line in low for w in line]
    triples, seen, out, at = set(), [False] * len(every), [], 0
    for i in range(len(every) - 2):
        seen[i] = tuple(every[i : i + 3]) in triples
        triples.add(tuple(every[i : i + 3]))
    for line, words in zip(lines, low):
        body = line.strip("\x20\t\n\x0b\x0c\r")
        n, size = len(words), len(body.encode())
        upper = sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in body)
        letters = max(1, sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in body))
        doubled = sum(i > 0 and every[i] == every[i - 1] for i in range(at, at + n))
        stops = sum(w in Q.STOP_WORDS for w in words)
        out.append([np.log1p(n), sum(c in "#*$%&|<>{}[]=_~^\\@" for c in body) / n, upper / letters, sum("0" <= c <= "9" for c in body) / size, body.count("!") / n, size / n, len(set(words)) / n, doubled / n, stops / n, sum(seen[at : at + n]) / n, float(body[-1] in ".!?\"')"), float(len(lines) == 1)])
        at += n
    return out


def test_features_match_plain_string_work():
    texts = ["The end of it. Is it?\nUND das ist Über 12 # {x}\n\n \t\nfoo!! FOO foo foo", "one line, \"quoted\"", "a b c a b c\na b c", "ÉÀÞ ß ñ\n\x0b x \x0c y\r\nz", prose(200, 1).replace("w1", "W1\n").replace("w2", "the")]
    for text in texts:
        raw = text.encode()
        got, _, _ = Q.line_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        want = np.array(plain_features(text))
        assert got.shape == want.shape
        for i, name in enumerate(Q.FEATURES):
            assert np.allclose(got[:, i], want[:, i]), (name, text[:30])
