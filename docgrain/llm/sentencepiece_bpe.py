"""SentencePiece BPE encoding with seeded merge-dropout, and decoding, without loss.

A text, a word mark before it and its spaces turned to word marks, is merged pair by pair, best piece first and
leftmost first. Each merge whose turn comes is put to a keyed hash of the seed, doc_id, the copy of the row, the unit's
place in the text and the number of the draw; if the hash falls below ``dropout`` the merge is skipped for good. The
hash alone decides, so a task that runs again gives the same pieces, and dropout 0 gives the model's own segmentation.

Merges never cross the border before a word mark that follows another character, nor a character that no longer piece
holds. Texts are therefore cut into units there. Every occurrence of a unit has draws of its own; those whose draws are
equal as far as merging can use them are merged once for a run of texts, all units of the run together, one merge of
each at a time, by array operations; units of over LONG symbols have an agenda (a heap) of their own.

Characters without a piece, and the word mark itself where a text holds it, become byte pieces, so decoding gives
every text back byte for byte.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, map_arrow, mixed, rounds, ship

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG = 200
#: Draws that a pattern holds; occurrences that may need more are merged alone.
DRAWS = 62
NONE = np.int64(2**62)
#: Bits of a candidate: its rank, its place in the unit, its piece.
RANK_AT, PLACE_AT = 26, 17
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 11

    @property
    def below(self) -> np.uint64:
        return np.uint64(min(int(self.rate * 2**64), 2**64 - 1))


class Vocabulary:
    """A BPE model's pieces as tables; small, and bounded by the model."""

    def __init__(self, model_file: str = MODEL_FILE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int32)
        normal = {}
        spelled = [b""] * n
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                spelled[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal[piece] = i
                spelled[i] = piece.replace(MARK, " ").encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        # Characters of pieces that aren't pieces themselves get numbers behind the vocabulary.
        symbols = dict(normal)
        for char in sorted({c for p in normal for c in p} - set(normal)):
            symbols[char] = n + len(symbols) - len(normal)
        self.n_pieces, self.n_symbols = n, n + len(symbols) - len(normal)
        self.of_char = np.full(0x110000, -1, np.int32)
        for char, i in symbols.items():
            if len(char) == 1 and char != MARK:
                self.of_char[ord(char)] = i
        if " " in normal:
            raise ValueError("the model has a piece of a plain space")
        self.of_char[0x20] = symbols[MARK]
        scores = {i: model.get_score(i) for i in normal.values()}
        rank: dict[int, int] = {}
        level, last = -1, None  # equal scores are equal ranks
        for i in sorted(scores, key=lambda i: (-scores[i], i)):
            if scores[i] != last:
                level, last = level + 1, scores[i]
            rank[i] = level
        pairs = {}
        joined = set()
        for piece, i in normal.items():
            if len(piece) > 1:
                joined.update(piece)
                for k in range(1, len(piece)):
                    a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                    if a is not None and b is not None:
                        pairs[a * self.n_symbols + b] = i
        self.cuts_at_marks = not any(MARK in p.lstrip(MARK) for p in normal)
        self.n_pairs = len(pairs)
        self._fill(pairs, rank)
        #: By symbol: whether it takes part in no merge.
        self.loner = np.ones(self.n_symbols + 1, bool)
        for char in joined:
            if char in symbols:
                self.loner[symbols[char]] = False
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_ends = np.append(0, np.cumsum([len(s) for s in spelled]))

    def _fill(self, pairs: dict[int, int], rank: dict[int, int]) -> None:
        """A hash table of pairs: keys, and of each what it merges to as rank << RANK_AT | piece."""
        bits = max(10, len(pairs).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        for key, piece in pairs.items():
            slot = (key * int(_M1) & (2**64 - 1)) >> (64 - bits)
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot], self.values[slot] = key, rank[piece] << RANK_AT | piece

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of symbols what it merges to, as rank << RANK_AT | piece; NONE if they make no piece."""
        keys = left.astype(np.int64) * self.n_symbols + right
        slot = ((keys.view(np.uint64) * _M1) >> self.shift).astype(np.int64)
        found = self.slots[slot]
        out = self.values[slot]
        wrong = np.flatnonzero(found != keys)
        out[wrong] = NONE
        wrong = wrong[found[wrong] >= 0]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % len(self.slots)
            found = self.slots[slot[wrong]]
            hit = found == keys[wrong]
            out[wrong[hit]] = self.values[slot[wrong[hit]]]
            wrong = wrong[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = NONE
        return out


def _skipped(keys: np.ndarray, draw: np.ndarray | np.uint64, below: np.uint64) -> np.ndarray:
    """Which merges the keyed hash skips; draws are numbered from 0 in each unit."""
    with np.errstate(over="ignore"):
        return mixed(keys + draw * _M1) < below


def _draws(key: int, dropout: Dropout) -> Iterator[bool]:
    """One unit's draws in turn."""
    keyed, at = np.array([key & (2**64 - 1)], np.uint64), 0
    while True:
        yield from _skipped(keyed, np.arange(at, at + LONG, dtype=np.uint64), dropout.below).tolist()
        at += LONG


def patterns(keys: np.ndarray, sizes: np.ndarray, dropout: Dropout) -> np.ndarray:
    """Of each unit the draws that its merging can come to, as bits; equal units with equal patterns have equal pieces.

    A unit of n symbols merges n - 1 times at the most, and has n - 1 candidates and two more for each merge, so its
    draws end with the (n - 1)th that passes or when candidates must have run out. Beyond DRAWS the key is the pattern.
    """
    out = np.zeros(len(keys), np.uint64)
    if dropout.rate <= 0:
        return out
    which = np.flatnonzero(sizes > 1)
    key, merges = keys[which], sizes[which] - 1
    left = merges.copy()
    for draw in range(DRAWS):
        if not len(which):
            return out
        skip = _skipped(key, np.uint64(draw), dropout.below)
        out[which[skip]] |= np.uint64(1 << draw)
        merges -= ~skip
        left += np.where(skip, -1, 1)
        more = (merges > 0) & (left > 0)
        which, key, merges, left = which[more], key[more], merges[more], left[more]
    out[which] = key | np.uint64(1 << 63)
    return out


def merge_unit(vocabulary: Vocabulary, symbols: list[int], key: int, dropout: Dropout) -> list[tuple[int, int]]:
    """One unit by an agenda: pieces as (symbol, start)."""
    n = len(symbols)
    symbol, end, before, after = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int, int]] = []
    alive = [True] * n
    draws = _draws(key, dropout)

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if not lefts:
            return
        j = np.array([after[x] for x in lefts])
        ends = np.array([end[x] for x in j.tolist()])
        found = vocabulary.merges(np.array([symbol[x] for x in lefts]), np.array([symbol[x] for x in j.tolist()]))
        for k in np.flatnonzero(found != NONE).tolist():
            heapq.heappush(agenda, (int(found[k]) >> RANK_AT, lefts[k], int(j[k]), int(ends[k]), int(found[k]) & (1 << PLACE_AT) - 1))

    offer(list(range(n - 1)))
    while agenda:
        _, i, j, stop, piece = heapq.heappop(agenda)
        if not alive[i] or not alive[j] or end[i] != j or end[j] != stop:
            continue
        if dropout.rate > 0 and next(draws):
            continue
        symbol[i], end[i], after[i], alive[j] = piece, stop, after[j], False
        if after[j] < n:
            before[after[j]] = i
        offer([before[i], i])
    return [(symbol[i], i) for i in range(n) if alive[i]]


def merge_units(vocabulary: Vocabulary, symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, dropout: Dropout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of many units: symbols, their places among the symbols given, and the first piece of each unit.

    Every step takes the best candidate of each unit that has one, so steps number the draws of all units.
    """
    sizes = np.diff(starts)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(symbols)) - starts[:-1][unit]
    final_symbol = symbols.astype(np.int64).copy()
    kept = np.ones(len(symbols), bool)
    for u in np.flatnonzero(sizes > LONG).tolist():
        a, b = starts[u], starts[u + 1]
        kept[a:b] = False
        for symbol, at in merge_unit(vocabulary, symbols[a:b].tolist(), int(keys[u]), dropout):
            final_symbol[a + at], kept[a + at] = symbol, True
    # of units in work: number, symbols left and where they begin; of their symbols: piece, place, and the candidate
    # that each makes with the next one
    unit_of = np.flatnonzero((sizes > 1) & (sizes <= LONG))
    counts = sizes[unit_of]
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LONG), sizes))
    sym = final_symbol[at]

    def offered(i: np.ndarray) -> np.ndarray:
        """Candidates of symbols i with the next ones."""
        out = vocabulary.merges(sym[i], sym[i + 1])
        some = np.flatnonzero(out != NONE)
        out[some] |= place[at[i[some]]] << PLACE_AT
        return out

    best = np.full(len(at), NONE)
    if len(at):
        first = np.append(0, np.cumsum(counts))[:-1]
        inner = np.ones(len(at), bool)
        inner[first + counts - 1] = False
        i = np.flatnonzero(inner)
        best[i] = offered(i)
    step = 0
    while len(at):
        first = np.append(0, np.cumsum(counts))[:-1]
        least = np.minimum.reduceat(best, first)
        busy = least != NONE
        stay = np.repeat(busy, counts)
        if not busy.all():
            final_symbol[at[~stay]] = sym[~stay]
            if not busy.any():
                break
        i = np.flatnonzero((best == np.repeat(least, counts)) & stay)  # one in each busy unit: places differ
        unit_of, counts = unit_of[busy], counts[busy]
        merged = np.ones(len(i), bool)
        if dropout.rate > 0:
            merged = ~_skipped(keys[unit_of], np.uint64(step), dropout.below)
            best[i[~merged]] = NONE
            i = i[merged]
        step += 1
        sym[i] = best[i] & (1 << PLACE_AT) - 1
        kept[at[i + 1]] = False
        stay[i + 1] = False
        i = np.cumsum(stay)[i] - 1
        counts -= merged
        sym, at, best = sym[stay], at[stay], best[stay]
        first = np.append(0, np.cumsum(counts))
        first, last = first[:-1][merged], first[1:][merged] - 1
        best[i] = NONE
        for j in (i[i < last], i[i > first] - 1):
            best[j] = offered(j)
    where = np.flatnonzero(kept)
    return final_symbol[where], where, np.searchsorted(where, starts)


def encode_run(vocabulary: Vocabulary, texts: list[str], salts: np.ndarray, dropout: Dropout) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a run of texts, end to end, and where each text's begin. salts: a key of each text."""
    marked = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_at = np.append(0, np.cumsum([len(t) for t in marked]))
    symbols = vocabulary.of_char[codes]
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    new = np.zeros(len(codes), bool)
    new[text_at[:-1][np.diff(text_at) > 0]] = True
    if vocabulary.cuts_at_marks:
        mark = codes == 0x20
        new[1:] |= mark[1:] & ~mark[:-1]
    loner = vocabulary.loner[symbols]
    new |= loner
    new[1:] |= loner[:-1]
    begin = np.flatnonzero(new)
    starts = np.append(begin, len(codes))
    sizes = np.diff(starts)
    # two hashes of each unit's characters, by prefix sums
    n = len(codes)
    powers = np.full(n + 1, _M1 | np.uint64(1), np.uint64)
    powers[0] = 1
    inverses = np.full(n + 1, np.uint64(pow(int(_M1 | np.uint64(1)), -1, 1 << 64)), np.uint64)
    inverses[0] = 1
    powers, inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
    hashes = []
    for salt in (np.uint64(1), np.uint64(2)):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) * _M2 + salt) * powers[:n], out=sums[1:])
        hashes.append(mixed((sums[starts[1:]] - sums[begin]) * inverses[begin] + sizes.astype(np.uint64)))
    text_of = np.searchsorted(text_at, begin, "right") - 1
    seed = np.uint64(dropout.seed & (2**64 - 1))
    draws = mixed(salts[text_of] + mixed((begin - text_at[text_of]).astype(np.uint64) + seed))
    pattern = patterns(draws, sizes, dropout)
    keys = mixed(hashes[0] ^ mixed(pattern * _M3 + seed))
    _, pick, inverse = np.unique(keys, return_index=True, return_inverse=True)
    if np.any((hashes[1][pick][inverse] != hashes[1]) | (pattern[pick][inverse] != pattern)):
        both = np.stack([keys, hashes[1], pattern], axis=1)
        _, pick, inverse = np.unique(both, axis=0, return_index=True, return_inverse=True)
    own_sizes = sizes[pick]
    own_starts = np.append(0, np.cumsum(own_sizes))
    chars = np.repeat(begin[pick] - own_starts[:-1], own_sizes) + np.arange(own_starts[-1])
    pieces, where, firsts = merge_units(vocabulary, symbols[chars], own_starts, draws[pick], dropout)
    # symbols without a piece become bytes
    odd = (pieces < 0) | (pieces >= vocabulary.n_pieces)
    if odd.any():
        widths = np.ones(len(pieces), np.int64)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[chars[where[odd]]].tolist()]
        widths[odd] = [len(s) for s in spelled]
        ends = np.append(0, np.cumsum(widths))
        out = np.repeat(pieces, widths)
        out[np.repeat(odd, widths)] = vocabulary.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        pieces, firsts = out, ends[firsts]
    lengths = np.diff(firsts)[inverse]
    out_at = np.append(0, np.cumsum(lengths))
    ids = pieces[np.repeat(firsts[:-1][inverse] - out_at[:-1], lengths) + np.arange(out_at[-1])].astype(np.int32)
    return ids, out_at[np.searchsorted(begin, text_at)]


def decode_run(vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a run of id lists, end to end, and where each text begins; the first word mark is taken off."""
    lengths = np.diff(vocabulary.byte_ends)[ids]
    ends = np.append(0, np.cumsum(lengths))
    data = vocabulary.bytes[np.repeat(vocabulary.byte_ends[:-1][ids] - ends[:-1], lengths) + np.arange(ends[-1])]
    text_at = ends[at]
    full = np.flatnonzero(np.diff(text_at) > 0)
    head = text_at[full]
    head = head[data[head] == 32]
    keep = np.ones(len(data), bool)
    keep[head] = False
    return data[keep], text_at - np.searchsorted(head, text_at)


def encode(docs: DataFrame, model_file: str = MODEL_FILE, dropout: Dropout = Dropout(), ids: bool = True, copy: str | None = None, adjacent: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and lossless of every row of ``docs`` (doc_id, text), over whole texts.

    lossless: decoding the ids gave the text back. Null and empty texts have no ids. ``copy`` names a column of whole
    numbers that tells copies of a document apart, which then have draws of their own; without it equal rows get equal
    ids. ``adjacent``: rows of one doc_id and text that follow each other, as the mix writes them, are copies and are numbered from 0;
    if they come in two tasks the second adds its own number, so that no two have the same draws. Null doc_ids and copies count as 0. Other columns are not read; an empty table gives an empty one. The model is read on the driver
    and sent to the executors once, as a broadcast as small as the vocabulary.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(Vocabulary(model_file))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        last, run, first = None, 0, True
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            numbers = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if copy is not None:
                numbers = numbers + batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * _M2
            if adjacent and len(numbers):
                copies = np.zeros(len(numbers), np.uint64)
                for i, (n, text) in enumerate(zip(numbers.tolist(), batch.column(1))):
                    if last is not None and last[0] == n and last[1] == text:
                        run += 1
                    else:
                        first, run = last is None, 0
                        last = n, text
                    copies[i] = run + (TaskContext.get().partitionId() << 32 if first else 0)
                numbers = numbers + copies * _M2
            for a, b in rounds(np.diff(offsets)):
                raw = data[offsets[a] : offsets[b]]
                whole = raw.tobytes()
                inner = (offsets[a : b + 1] - offsets[a]).tolist()
                texts = [whole[x:y].decode() for x, y in zip(inner, inner[1:])]
                found, at = encode_run(vocabulary, texts, mixed(numbers[a:b]), dropout)
                back, back_at = decode_run(vocabulary, found, at)
                same = np.array_equal(back, raw) and np.array_equal(back_at, np.array(inner))
                same = [True] * (b - a) if same else [back[x:y].tobytes() == whole[p:q] for x, y, p, q in zip(back_at, back_at[1:], inner, inner[1:])]
                out = [batch.column(0)[a:b], pa.array(np.diff(at), pa.int64()), pa.array(same, pa.bool_())]
                if ids:
                    out.insert(2, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found)))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", *["ids"] * ids, "lossless"])

    read = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    if copy is not None:
        read.append(F.col(f"`{copy}`").cast("long").alias("copy"))
    return map_arrow(docs.select(*read), work, f"doc_id long, n_tokens long, {'ids array<int>, ' if ids else ''}lossless boolean")


def decode(encoded: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids give an empty text."""
    spark = encoded.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(Vocabulary(model_file))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            at = np.append(0, np.cumsum([len(x) for x in lists], dtype=np.int64))
            data, text_at = decode_run(sent.value, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode() for a, b in zip(text_at.tolist(), text_at[1:].tolist())], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), work, "doc_id long, text string")
