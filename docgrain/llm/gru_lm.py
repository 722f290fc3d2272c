"""Language-model scoring: a gated recurrent network over words, beside plain counts.

Counts of all training tokens are joined back to each block's distinct words. The most frequent words are the network's
own; each other word is ``rare`` to it and then drawn by its count among the rare, so any text has a probability. The output is
factored: a softmax over classes of words, and one over the words of the class. Training is truncated backpropagation through
time in numpy: tasks go through all rows of training documents, which a hash deals to rounds, and after each round their weights are averaged. A document is
read whole and in order; its state is carried from window to window.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import END, blocks, unpacked
from .common import map_arrow, on_batches, on_cogroup, quoted, ship, written


@dataclass(frozen=True)
class Net:
    #: Words of the network's own at the most: all that occur as often as some bound; what ties with it goes along or not.
    most_words: int = 2048
    #: and this at least; seldomer words are likelier drawn by count alone.
    least_count: int = 10
    classes: int = 40
    width: int = 16
    #: Documents side by side at the most, and tokens of each between two updates. Scoring has larger windows, which change nothing but speed.
    lanes: int = 256
    window: int = 24
    score_window: int = 64
    #: A task deals so many tokens to lanes at a time, or one longer row of texts.
    batch_tokens: int = 1_500_000
    rate: float = 0.1
    #: Largest norm of an update's gradient.
    clip: float = 5.0
    #: Training goes through all rows of texts, in rounds that each end by averaging.
    rounds: int = 4
    #: So many tokens at least are gone through: small collections are repeated.
    least_tokens: int = 500_000
    seed: int = 17


NET = Net()

#: Logits end here; their exponentials then sum within float32.
MOST = np.float32(60)

#: Floats of a row in which tasks hand over weights.
SLICE = 1 << 16


class Layout:
    """Words of the network by number, most frequent first, in classes of about equal sums of root frequencies.

    The last number is ``rare`` and has the last class to itself.
    """

    def __init__(self, counts: list[int], rare: int, net: Net = NET):
        """counts: of the words, descending; rare: occurrences of all others."""
        self.size = len(counts) + 1
        roots = np.sqrt(np.array(counts, np.float64))
        share = np.cumsum(roots) / roots.sum() if counts else roots
        of = np.minimum((share * net.classes).astype(int), net.classes - 1) if counts else np.zeros(0, int)
        _, of = np.unique(of, return_inverse=True)
        self.of_word = np.append(of, of.max() + 1 if counts else 0).astype(np.int64)
        self.start = np.searchsorted(self.of_word, np.arange(self.of_word[-1] + 2))
        self.counts = np.append(np.array(counts, np.float64), float(rare)) + 1.0

    @property
    def classes(self) -> int:
        return len(self.start) - 1


def new_weights(layout: Layout, net: Net = NET) -> dict[str, np.ndarray]:
    """Small random weights; biases are the logarithms of the counts, so that an untrained network is a unigram model."""
    chance = np.random.default_rng(net.seed)
    h, (v, c) = net.width, (layout.size, layout.classes)
    of_class = np.add.reduceat(layout.counts, layout.start[:-1])
    draw = lambda *shape: (chance.standard_normal(shape) * 0.5 / math.sqrt(h)).astype(np.float32)
    return {
        "embed": draw(v, h),
        "into": draw(h, 3 * h),
        "again": draw(h, 3 * h),
        "bias": np.zeros(3 * h, np.float32),
        "classes": draw(c, h) * np.float32(0.1),
        "class_bias": np.log(of_class / of_class.sum()).astype(np.float32),
        "words": draw(v, h) * np.float32(0.1),
        "word_bias": np.log(layout.counts / of_class[layout.of_word]).astype(np.float32),
    }


class Lanes:
    """Documents dealt to lanes of about equal length; a lane reads its documents one after the other."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, lanes: int):
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        # not so many that most lanes end long before the one with the longest document
        n = min(lanes, len(sizes), max(8, 2 * int(sizes.sum()) // max(1, int(sizes.max(initial=1)))))
        heap = [(0, i) for i in range(max(1, n))]
        held: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-sizes, kind="stable").tolist():
            load, lane = heapq.heappop(heap)
            held[lane].append(d)
            heapq.heappush(heap, (load + int(sizes[d]), lane))
        loads = np.array([int(sizes[x].sum()) if x else 0 for x in held])
        order = np.argsort(-loads, kind="stable")
        self.loads = loads[order]
        docs = np.array([d for lane in order for d in held[lane]], np.int64)
        #: Place in ``tokens`` of each token of the lanes, lane after lane; the document of each.
        sizes = sizes[docs]
        self.doc = np.repeat(docs, sizes)
        ends = np.cumsum(sizes)
        self.tokens = tokens[np.arange(len(self.doc)) + np.repeat(begins[docs] - (ends - sizes), sizes)]
        self.begins = np.zeros(len(self.doc), bool)
        self.begins[(ends - sizes)[sizes > 0]] = True
        self.first = np.cumsum(self.loads) - self.loads

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (steps x lanes that are not at their end) and whether there is a token at each."""
        for s in range(0, int(self.loads[0]) if len(self.loads) else 0, steps):
            n = int(np.searchsorted(-self.loads, -s))
            step = s + np.arange(min(steps, int(self.loads[0]) - s))[:, None]
            there = step < self.loads[:n]
            yield np.where(there, self.first[:n] + step, 0), there


class Gru:
    """Arrays of steps and lanes have their features first inside, so that all that is done number by number runs over contiguous ones."""

    def __init__(self, weights: dict[str, np.ndarray], layout: Layout):
        self.w, self.layout = weights, layout
        self.h = weights["again"].shape[0]
        self.heads = None

    def _inputs(self, ids: np.ndarray) -> np.ndarray:
        """What each word adds to the gates, with the sign turned for the two that are sigmoids: those are 1 / (1 + exp(-x))."""
        sign = np.repeat(np.array([-1, 1], self.w["into"].dtype), [2 * self.h, self.h])
        out = (self.w["into"] * sign).T @ self.w["embed"][ids.ravel()].T
        out += (self.w["bias"] * sign)[:, None]
        return out.reshape(3 * self.h, *ids.shape)

    def _heads(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Output weights with their biases behind them, and whether a logit may be beyond MOST: states are within 1."""
        w = self.w
        found = [np.concatenate([w[k], w[f"{one}_bias"][:, None]], axis=1) for k, one in (("classes", "class"), ("words", "word"))]
        return *found, any(len(x) and np.abs(x).sum(axis=1).max() >= MOST for x in found)

    def read(self, ids: np.ndarray, begins: np.ndarray, state: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
        """ids, begins: steps x lanes. The states before each token, the last state, and what backward() needs."""
        w, h = self.w, self.h
        steps, lanes = ids.shape
        # inside a step all is contiguous; what is added to the gates becomes the gates and the new state
        made = np.ascontiguousarray(self._inputs(ids).transpose(1, 0, 2))
        weights = np.ascontiguousarray(w["again"].T)
        np.negative(weights[: 2 * h], out=weights[: 2 * h])
        states = np.empty((steps + 1, h, lanes), state.dtype)
        states[0] = state.T
        again = np.empty((steps if keep else 1, 3 * h, lanes), state.dtype)
        some = begins.any(axis=1)
        for t in range(steps):
            state, then, mine = states[t], states[t + 1], again[t if keep else 0]
            if some[t]:
                np.copyto(state, 0, where=begins[t])
            np.matmul(weights, state, out=mine)
            gates, new = made[t, : 2 * h], made[t, 2 * h :]
            gates += mine[: 2 * h]
            np.minimum(gates, MOST, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[h:], mine[2 * h :], out=then)
            new += then
            np.tanh(new, out=new)
            np.subtract(state, new, out=then)
            then *= gates[:h]
            then += new
        kept = ()
        if keep:
            before, gated, last = (np.ascontiguousarray(x.transpose(1, 0, 2)) for x in (states[:-1], made, again[:, 2 * h :]))
            kept = (before, gated[:h], gated[h : 2 * h], gated[2 * h :], last)
        return np.ascontiguousarray(states[:-1].transpose(0, 2, 1)), np.ascontiguousarray(states[-1].T), kept

    def outputs(self, states: np.ndarray, ids: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each token after its state; with grads, adds the loss's gradients and returns that of the states."""
        layout, h, n = self.layout, self.h, len(ids)
        heads = self._heads() if grads is not None or self.heads is None else self.heads
        if grads is None:
            self.heads = heads
        classes, words, large = heads
        order = np.argsort(layout.of_word[ids].astype(np.uint16), kind="stable")  # by radix
        ids = ids[order]
        of = layout.of_word[ids]
        held = np.empty((n, h + 1), states.dtype)
        held[:, :h] = states[order]
        held[:, h] = 1
        # the classes' logits, and those of each class's words for its tokens, of one token a column, one after the other in one array
        cuts = np.searchsorted(of, np.arange(layout.classes + 1))
        many, held_by = np.diff(layout.start), np.diff(cuts)
        sizes = np.where(many > 1, many * held_by, 0)  # one word alone is certain
        ends = np.cumsum(sizes) + layout.classes * n
        logits = np.empty(ends[-1], states.dtype)
        outer = logits[: layout.classes * n].reshape(layout.classes, n)
        np.matmul(classes, held.T, out=outer)
        parts = []
        for c in np.flatnonzero(sizes).tolist():
            at, tokens = slice(layout.start[c], layout.start[c + 1]), slice(cuts[c], cuts[c + 1])
            parts.append((at, tokens, logits[ends[c] - sizes[c] : ends[c]].reshape(many[c], held_by[c])))
            np.matmul(words[at], held[tokens].T, out=parts[-1][2])
        if large:
            np.minimum(logits, MOST, out=logits)
        row = np.arange(n)
        inner = np.flatnonzero((many > 1)[of])
        places = of * n + row, (ends[of] - sizes[of] + (ids - layout.start[of]) * held_by[of] + row - cuts[of])[inner]
        found = logits[places[0]].astype(np.float64)
        found[inner] += logits[places[1]]
        np.exp(logits, out=logits)
        total, totals = outer.sum(axis=0), np.ones(n, states.dtype)
        for _, tokens, part in parts:
            np.add.reduce(part, axis=0, out=totals[tokens])
        found -= np.log(total)
        found -= np.log(totals)
        place = np.empty(n, np.int64)
        place[order] = row
        if grads is None:
            return found[place], None
        # gradients of the logits but for a factor of each token, which its state and what goes back to it get
        logits[places[0]] -= total
        logits[places[1]] -= totals[inner]
        factor, factors = (1 / total)[:, None], (1 / totals)[:, None]
        of_classes, of_words = outer @ (held * factor), np.zeros_like(words)
        back, more, held = outer.T @ classes[:, :h], np.zeros((n, h), states.dtype), held * factors
        for at, tokens, part in parts:
            np.matmul(part, held[tokens], out=of_words[at])
            np.matmul(part.T, words[at, :h], out=more[tokens])
        back *= factor
        more *= factors
        back += more
        for k, one, x in (("classes", "class", of_classes), ("words", "word", of_words)):
            grads[k] += x[:, :h]
            grads[f"{one}_bias"] += x[:, h]
        return found[place], back[place]

    def backward(self, ids: np.ndarray, begins: np.ndarray, before: np.ndarray, kept: tuple, back: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """back: gradient of each state before a token. Adds the gradients of what made them, within the window."""
        w, h = self.w, self.h
        steps, lanes = ids.shape
        before, update, reset, new, again = kept
        back = np.ascontiguousarray(back.transpose(2, 0, 1))
        of_new = (1 - update) * (1 - new * new)
        of_update = (before - new) * update * (1 - update)
        of_reset = again * reset * (1 - reset)
        # of the new state by way of the state before, of the update, of the reset, and of the new state by way of the inputs
        made = np.empty((4 * h, steps, lanes), before.dtype)
        weights = np.concatenate([w["again"][:, 2 * h :], w["again"][:, : 2 * h]], axis=1)
        later = np.zeros((h, lanes), before.dtype)
        some = begins.any(axis=1)
        for t in range(steps - 1, -1, -1):
            slope = later * of_new[:, t]
            np.multiply(slope, reset[:, t], out=made[:h, t])
            np.multiply(later, of_update[:, t], out=made[h : 2 * h, t])
            np.multiply(slope, of_reset[:, t], out=made[2 * h : 3 * h, t])
            made[3 * h :, t] = slope
            later *= update[:, t]
            later += weights @ made[: 3 * h, t]
            later += back[:, t]
            if some[t]:
                later = np.where(begins[t], before.dtype.type(0), later)
        made = made.reshape(4 * h, -1)
        gates, flat_ids = made[h:], ids.ravel()
        of_again = before.reshape(h, -1) @ made[: 3 * h].T
        grads["again"][:, 2 * h :] += of_again[:, :h]
        grads["again"][:, : 2 * h] += of_again[:, h:]
        grads["bias"] += gates.sum(axis=1)
        grads["into"] += w["embed"][flat_ids].T @ gates.T
        of_words = gates.T @ w["into"].T
        order = np.argsort(flat_ids.astype(np.uint16), kind="stable")  # by radix
        sorted_ids = flat_ids[order]
        at = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
        grads["embed"][sorted_ids[at]] += np.add.reduceat(of_words[order], at, axis=0)


def views(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays that flat() put one after the other, as parts of ``values``."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def learn(weights: dict[str, np.ndarray], speeds: dict[str, np.ndarray], layout: Layout, tokens: np.ndarray, sizes: np.ndarray, net: Net = NET) -> None:
    """One pass over documents, changing weights and speeds (sums of squared gradients) in place."""
    lanes = Lanes(tokens, sizes, net.lanes)
    all_weights, all_speeds = flat(weights), flat(speeds)
    all_grads, step = np.zeros_like(all_weights), np.empty_like(all_weights)
    gru, grads = Gru(views(all_weights, weights), layout), views(all_grads, weights)
    state = np.zeros((len(lanes.loads), net.width), np.float32)
    for places, there in lanes.windows(net.window):
        ids = lanes.tokens[places]
        begins = lanes.begins[places] & there
        before, last, kept = gru.read(ids, begins, state[: ids.shape[1]], keep=True)
        state = last
        all_grads[:] = 0
        back = np.zeros_like(before)
        _, back[there] = gru.outputs(before[there], ids[there], grads)
        gru.backward(ids, begins, before, kept, back, grads)
        n = int(there.sum())
        norm = math.sqrt(float(np.vdot(all_grads, all_grads))) / n
        all_grads *= np.float32(min(1.0, net.clip / max(norm, 1e-9)) / n * net.lanes)
        np.multiply(all_grads, all_grads, out=step)
        all_speeds += step
        np.sqrt(all_speeds, out=step)
        step += np.float32(1e-6)
        np.divide(all_grads, step, out=step)
        step *= np.float32(net.rate)
        all_weights -= step
    for arrays, values in ((weights, all_weights), (speeds, all_speeds)):
        for k, x in views(values, weights).items():
            arrays[k][...] = x


def log_likelihoods(weights: dict[str, np.ndarray], layout: Layout, tokens: np.ndarray, sizes: np.ndarray, net: Net = NET) -> np.ndarray:
    """Natural log probability of each document's tokens, rare ones as ``rare``."""
    gru, lanes = Gru(weights, layout), Lanes(tokens, sizes, net.lanes)
    state = np.zeros((len(lanes.loads), net.width), np.float32)
    out = np.zeros(len(sizes))
    for places, there in lanes.windows(net.score_window):
        ids = lanes.tokens[places]
        before, state, _ = gru.read(ids, lanes.begins[places] & there, state[: ids.shape[1]])
        found, _ = gru.outputs(before[there], ids[there])
        out += np.bincount(lanes.doc[places[there]], weights=np.minimum(found, 0.0), minlength=len(out))
    return out


def flat(arrays: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([arrays[k].ravel() for k in sorted(arrays)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = values[at : at + n].astype(np.float32).reshape(like[k].shape)
        at += n
    return out


@dataclass
class Model:
    """The network and what it knows of counts."""

    weights: dict[str, np.ndarray]
    layout: Layout
    train_tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int


def _bound(counts: DataFrame, most: int) -> int:
    """The least count of the network's own words: the smallest of a scale of bounds that at most ``most`` words reach.

    The scale has sixteen steps an octave, so what comes to the driver is some hundred rows for any corpus.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    held = {r["step"]: (r["rows"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()}
    total, bound = 0, 1 << 62
    for s in sorted(held, reverse=True):
        total += held[s][0]
        if total > most:
            break
        bound = held[s][1]
    return bound


def encoded(found: DataFrame, counts: DataFrame, own: DataFrame, model: Model) -> DataFrame:
    """Rows of texts as the network's numbers, with n_tokens, known, base and rare (log10 sums) of each document.

    counts: word, n; own: word, number.
    """
    session = found.sparkSession
    ship(session)
    joined = counts.join(F.broadcast(own), "word", "left")  # at most most_words rows
    known = found.where("word IS NOT NULL").join(joined, "word").select("block", "id", joined["n"], "number")
    rare, total = model.layout.size - 1, math.log10(model.train_tokens + model.distinct + 1)
    rare_total = math.log10(model.rare_tokens + model.rare_distinct + 1)

    def number(texts: pa.Table, words: pa.Table) -> pa.Table:
        texts = texts.sort_by("row")
        rows = [(unpacked(x.as_py())) for x in texts.column("ids")]
        top = max((int(r.max()) for r in rows if len(r)), default=-1) + 1
        n, to = np.zeros(top, np.int64), np.full(top, rare, np.uint16)
        ids = words.column("id").to_numpy()
        n[ids] = words.column("n").to_numpy()
        numbers = words.column("number").fill_null(rare).to_numpy()
        to[ids] = numbers.astype(np.uint16)
        logs = np.log10(n + 1.0)
        out = {k: [] for k in ("tokens", "known", "base", "rare")}
        for row, sizes in zip(rows, texts.column("sizes").to_pylist(), strict=True):
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
            mine = to[row]
            out["tokens"].append(mine.astype("<u2").tobytes())
            out["known"].append(np.add.reduceat((n[row] > 0).astype(np.int64), starts).tolist())
            out["base"].append((np.add.reduceat(logs[row], starts) - np.array(sizes) * total).tolist())
            out["rare"].append(np.add.reduceat(np.where(mine == rare, logs[row] - rare_total, 0.0), starts).tolist())
        return pa.table({"block": texts.column("of"), "row": texts.column("row"), "docs": texts.column("docs"), "flags": texts.column("flags"), "sizes": texts.column("sizes"), "tokens": pa.array(out["tokens"], pa.binary()), "known": pa.array(out["known"], pa.list_(pa.int64())), "base": pa.array(out["base"], pa.list_(pa.float64())), "rare": pa.array(out["rare"], pa.list_(pa.float64()))})

    texts = found.where("ids IS NOT NULL").select(F.col("block").alias("of"), F.col("id").alias("row"), "ids", "docs", "flags", "sizes")
    schema = "block long, row int, docs array<long>, flags array<boolean>, sizes array<int>, tokens binary, known array<long>, base array<double>, rare array<double>"
    return written(texts.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(on_cogroup(number), schema), "encoded")


def _gathered(batches: Iterator[pa.RecordBatch], net: Net, learnable: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[dict]]]:
    """Tokens and sizes of runs of rows; of their learnable documents alone if asked."""
    tokens, sizes, rows, n = [], [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            ids, of = np.frombuffer(row.pop("tokens"), "<u2").astype(np.int64), np.array(row["sizes"], np.int64)
            if learnable:
                flags = np.array(row["flags"], bool)
                ids, of = ids[np.repeat(flags, of)], of[flags]
            tokens.append(ids)
            sizes.append(of)
            rows.append(row)
            n += len(ids)
            if n >= net.batch_tokens:
                yield np.concatenate(tokens), np.concatenate(sizes), rows
                tokens, sizes, rows, n = [], [], [], 0
    if n:
        yield np.concatenate(tokens), np.concatenate(sizes), rows


def trained(rows: DataFrame, model: Model, net: Net = NET) -> None:
    """Trains the model's weights on learnable documents of encoded().

    A round takes the rows of texts whose hash falls to it, and the rounds together take each row once. Each task starts from the weights of the round before and goes through its
    rows; what it hands over is of the size of the weights, and is averaged, by tokens, slice by slice. Only the averages reach the driver.
    """
    layout = model.layout
    weights = model.weights
    speeds = {k: np.full_like(v, 0.1) for k, v in weights.items()}
    if not model.train_tokens:
        return
    repeats = math.ceil(net.least_tokens / model.train_tokens)
    rows = rows.select("tokens", "sizes", "flags", F.pmod(F.xxhash64("block", "row"), F.lit(net.rounds)).alias("round"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number, n = None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                values = np.frombuffer(r["values"], "<f4").astype(np.float64) * r["n"]
                total, number, n = values if total is None else total + values, r["slice"], n + r["n"]
        yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "n": pa.array([n], pa.int64()), "values": pa.array([(total / n).astype("<f8").tobytes()], pa.binary())})

    for number in range(net.rounds):
        begin = flat(weights), flat(speeds)

        def run(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            mine, pace, seen = unflat(begin[0], weights), unflat(begin[1], weights), 0
            for tokens, sizes, _ in _gathered(batches, net, learnable=True):
                for _ in range(repeats):
                    learn(mine, pace, layout, tokens, sizes, net)
                seen += len(tokens)
            if seen:
                values = np.concatenate([flat(mine), flat(pace)]).astype("<f4")
                for k, at in enumerate(range(0, len(values), SLICE)):
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "n": pa.array([seen], pa.int64()), "values": pa.array([values[at : at + SLICE].tobytes()], pa.binary())})

        found = map_arrow(rows.where(F.col("round") == number), run, "slice int, n long, values binary")
        slices = {r["slice"]: np.frombuffer(r["values"], "<f8") for r in found.groupBy("slice").applyInArrow(on_batches(add), "slice int, n long, values binary").collect()}
        if slices:
            values = np.concatenate([slices[k] for k in sorted(slices)])
            half = len(values) // 2
            weights, speeds = unflat(values[:half], weights), unflat(values[half:], weights)
    model.weights = weights


def score(docs: DataFrame, held_out: Column, text: str = "text", net: Net = NET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Rows where ``held_out`` is true are scored and not learned from. A null or empty text is its end alone. Copies and repeated
    rows count each time; a null doc_id stays null. Other columns are not read. Without rows to learn from all counts are 0: every token has
    probability 1 by the counts (1 / (0 + 0 + 1)) and by the network, which knows but ``rare``. A text is read whole, however long;
    one longer than a block's bytes is a row of its own and held as such. An empty table gives an empty one.
    """
    out_of = F.coalesce(held_out, F.lit(False))
    found = blocks(docs, F.col(quoted(text)), doc_id=F.col("doc_id"), learned=~out_of, ends=True)
    counts = written(found.where("learned > 0").groupBy("word").agg(F.sum("learned").alias("n")), "counts")
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    bound = max(_bound(counts, net.most_words), net.least_count)
    own = sorted(((r["n"], r["word"]) for r in counts.where(F.col("n") >= bound).collect()), key=lambda x: (-x[0], x[1]))
    train_tokens, distinct = sums[0] or 0, sums[1]
    rare_tokens = train_tokens - sum(n for n, _ in own)
    layout = Layout([n for n, _ in own], rare_tokens, net)
    model = Model(new_weights(layout, net), layout, train_tokens, distinct, rare_tokens, distinct - len(own))
    numbers = docs.sparkSession.createDataFrame([(w, i) for i, (_, w) in enumerate(own)], "word string, number int")
    rows = encoded(found, counts, numbers, model)
    trained(rows, model, net)
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, sizes, held in _gathered(batches, net):
            joined = {k: [x for row in held for x in row[k]] for k in ("docs", "flags", "known", "base", "rare")}
            values = log_likelihoods(weights, layout, tokens, sizes, net) / math.log(10) + np.array(joined["rare"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(joined["docs"], pa.int64()), pa.array([not f for f in joined["flags"]]), pa.array(sizes), pa.array(joined["known"], pa.int64()), pa.array(np.full(len(sizes), train_tokens)), pa.array(joined["base"], pa.float64()), pa.array(values)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return map_arrow(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
