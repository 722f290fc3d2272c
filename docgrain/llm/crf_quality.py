"""Document quality from a linear-chain conditional random field over lines.

Every line that holds a word is good or bad. A line's features and those of the lines beside it score its label, a
2 x 2 matrix scores neighbouring labels, and the forward-backward recursions give each line's chance of being good.
A document's score is the mean of its lines' chances, weighted by their bytes.

Labels are of documents; in training all lines of a document have its label. The model is fitted on the driver to at
most ``Crf.train_rows`` labelled documents, of which only line features leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, column_bytes, map_arrow, rounds, windows
from .html_extract import STOP_WORDS

FEATURES = ("words", "symbols", "capitals", "digits", "shouts", "word_bytes", "fresh_words", "doubled_words", "stop_words", "seen_before", "ends_sentence", "single")


@dataclass(frozen=True)
class Crf:
    """train_rows: labelled documents used at the most, those whose hashed ids come first. folds: documents whose
    crc32 is 0 modulo it are held out."""

    train_rows: int = 4000
    folds: int = 5
    steps: int = 150
    rate: float = 0.1
    ridge: float = 1e-3
    threshold: float = 0.3


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_SYMBOL, _DIGIT, _SHOUT = _table(b"#*$%&|<>{}[]=_~^\\@"), _table(b"0123456789"), _table(b"!")
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]))
_STOP = None


def _stop_hashes() -> np.ndarray:
    global _STOP
    if _STOP is None:
        raw = " ".join(sorted(STOP_WORDS)).encode()
        _STOP = np.sort(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash)
    return _STOP


def _first(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its value."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that holds a word, its bytes, and where each text's lines begin.

    A text without words has one line whose features are 0 and whose weight is 1.
    """
    n = len(offsets) - 1
    words = Words(data, offsets)
    lower = Words(data, offsets, lower=True).hash
    text = np.repeat(np.arange(n), np.diff(words.of_text))
    breaks = np.cumsum(words.data == 10)
    line_of = breaks[words.start] if len(words.start) else np.zeros(0, np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    n_words = np.diff(np.append(at, len(text))).astype(np.float64)
    begin, end = words.start[at], words.end[np.append(at[1:], len(text)) - 1] if len(at) else at

    def per_line(table: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(table[words.data]))
        return (sums[end] - sums[begin]).astype(np.float64)

    def mean(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line, flags, len(at)) / n_words if len(at) else np.zeros(0)

    wide = words.data.astype(np.int32)
    accented = np.append(0, np.cumsum((wide[1:] >= 0x80) & (wide[1:] <= 0x9E) & (wide[:-1] == 0xC3)))
    accented = np.append(accented, accented[-1])
    letters = np.maximum(per_line(_LETTER), 1)
    doubled = np.zeros(len(text), bool)
    doubled[1:] = (lower[1:] == lower[:-1]) & (text[1:] == text[:-1])
    fresh = _first(lower ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    triples, of, place = windows(lower, words.of_text, 3)
    seen = np.zeros(len(text), bool)
    if len(triples):
        again = ~_first(triples ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        seen[(words.of_text[:-1][of] + place)[again]] = True
    stops = _stop_hashes()
    stop = stops[np.minimum(np.searchsorted(stops, lower), len(stops) - 1)] == lower
    last = words.data[end - 1] if len(at) else np.zeros(0, np.uint8)
    lines_of = np.searchsorted(text[at], np.arange(n + 1)) if len(at) else np.zeros(n + 1, np.int64)
    own = np.diff(lines_of)
    out = np.stack(
        [
            np.log1p(n_words),
            per_line(_SYMBOL) / n_words,
            (per_line(_UPPER) + (accented[end] - accented[begin])) / letters,
            per_line(_DIGIT) / np.maximum(end - begin, 1),
            per_line(_SHOUT) / n_words,
            (end - begin) / n_words,
            mean(fresh),
            mean(doubled),
            mean(stop),
            mean(seen),
            np.isin(last, np.frombuffer(b".!?\"')", np.uint8)).astype(np.float64),
            np.repeat((own == 1).astype(np.float64), own),
        ],
        axis=1,
    ) if len(at) else np.zeros((0, len(FEATURES)))
    weight = (end - begin).astype(np.float64)
    if np.any(own == 0):
        bare = np.flatnonzero(own == 0)
        out = np.insert(out, lines_of[:-1][bare], 0, axis=0)
        weight = np.insert(weight, lines_of[:-1][bare], 1)
        lines_of = np.append(0, np.cumsum(np.maximum(own, 1)))
    return out, weight, lines_of


def _beside(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features, a constant, and those of the lines before and after it in its text (0 at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    return np.concatenate([x, np.ones((len(x), 1)), before, after], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Scores of (label of a line, label of the next).
    steps: np.ndarray

    def inputs(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _beside(np.clip((features - self.mean) / self.scale, -8, 8), starts)


def marginals(scores: np.ndarray, steps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's chance of being good, and the expected counts of label pairs in each text, by forward-backward.

    scores: of the label good, that of bad being 0. All texts advance together, a line a step.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[:-1][order], sizes[order]
    most = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, most + 1), "right")
    both = np.stack([np.zeros(len(scores)), scores], axis=1)
    ahead, behind = np.zeros_like(both), np.zeros_like(both)
    for t in range(most):
        i = first[: active[t]] + t
        if t:
            into = ahead[i - 1][:, :, None] + steps
            ahead[i] = np.logaddexp(into[:, 0], into[:, 1]) + both[i]
        else:
            ahead[i] = both[i]
    for t in range(most - 2, -1, -1):
        i = first[: active[t + 1]] + t
        out = steps + (behind[i + 1] + both[i + 1])[:, None, :]
        behind[i] = np.logaddexp(out[:, :, 0], out[:, :, 1])
    total = np.logaddexp(*(ahead[starts[1:] - 1]).T) if len(sizes) else np.zeros(0)
    joint = ahead + behind
    good = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))
    inner = np.ones(len(scores), bool)
    inner[starts[1:] - 1] = False
    i = np.flatnonzero(inner)
    text = np.repeat(np.arange(len(sizes)), sizes)[i]
    pairs = np.exp(ahead[i][:, :, None] + steps + (both[i + 1] + behind[i + 1])[:, None, :] - total[text][:, None, None])
    return good, pairs.sum(axis=0)


def fit(features: np.ndarray, starts: np.ndarray, labels: np.ndarray, crf: Crf = Crf()) -> Model:
    """Weights by gradient ascent (Adam) on the mean log-likelihood of the lines' labels, with a ridge penalty."""
    width = 3 * len(FEATURES) + 1
    model = Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(width), np.zeros((2, 2)))
    if not len(labels):
        return model
    model.mean, model.scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-3)
    x = model.inputs(features, starts)
    sizes = np.diff(starts)
    of_line = np.repeat(labels, sizes).astype(np.float64)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (sizes[labels == label] - 1).sum()
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, crf.steps + 1):
        good, pairs = marginals(x @ theta[:width], theta[width:].reshape(2, 2), starts)
        slope = np.concatenate([x.T @ (of_line - good), (seen - pairs).reshape(-1)]) / len(x) - crf.ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + crf.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.steps = theta[:width], theta[width:].reshape(2, 2)
    return model


def document_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    features, weight, starts = line_features(data, offsets)
    good, _ = marginals(model.inputs(features, starts) @ model.weights, model.steps, starts)
    return np.clip(np.add.reduceat(good * weight, starts[:-1]) / np.add.reduceat(weight, starts[:-1]), 0, 1)


def fold(doc_id: Column, crf: Crf = Crf()) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % crf.folds


def train(docs: DataFrame, labels: DataFrame, crf: Crf = Crf()) -> Model:
    """A model of ``labels`` (doc_id, quality), learned from documents that aren't held out.

    Null ids and labels are left out; of several labels of a document the least counts. Without labels all scores
    are 0.5.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id"), crf) != 0)
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(crf.train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in rounds(np.diff(offsets)):
                x, _, starts = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = [x[i:j].astype(np.float32).tobytes() for i, j in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(raw, pa.binary())], ["doc_id", "quality", "lines"])

    found = sorted((r["doc_id"], r["quality"], bytes(r["lines"])) for r in map_arrow(rows, work, "doc_id long, quality int, lines binary").collect())
    lines = [np.frombuffer(r[2], np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in found]
    starts = np.append(0, np.cumsum([len(x) for x in lines], dtype=np.int64))
    features = np.concatenate(lines) if lines else np.zeros((0, len(FEATURES)))
    return fit(features, starts, np.array([r[1] for r in found], np.int64), crf)


def score(docs: DataFrame, model: Model, crf: Crf = Crf()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text), from the text alone.

    A null text is empty; a text without words is scored as one line of no features. Repeated rows and null ids stay;
    other columns are not read; an empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in rounds(np.diff(offsets)):
                scores = document_scores(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(scores)], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), crf) == 0).alias("held_out"), "score", (F.col("score") >= crf.threshold).cast("int").alias("predicted"))
