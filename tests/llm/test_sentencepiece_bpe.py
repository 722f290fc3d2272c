from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.llm import sentencepiece_bpe as B

from .helpers import ODD, frame, prose


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary()


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=B.MODEL_FILE)


TEXTS = ["", " ", "  two  spaces ", "Hello world, this is a test.", "\n\nline\n", "日本語 😀 ñ", "x" * 700, "aaaa" * 100, "tab\tand nbsp", "<s> </s>", "ab " * 400]


def run(vocabulary, texts, dropout, salts=None):
    ids, at = B.encode_run(vocabulary, texts, np.arange(len(texts), dtype=np.uint64) if salts is None else salts, dropout)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_no_dropout_is_the_model(vocabulary, model):
    assert run(vocabulary, TEXTS, B.Dropout(rate=0)) == [model.encode(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=40), max_size=4), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_lossless(vocabulary, texts, rate):
    texts = [*texts, "a▁b ▁", "\x00"]
    ids, at = B.encode_run(vocabulary, texts, np.zeros(len(texts), np.uint64), B.Dropout(rate=rate))
    data, ends = B.decode_run(vocabulary, ids, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == texts


def test_arrays_equal_the_agenda(vocabulary):
    for rate in (0.0, 0.2, 0.7):
        dropout = B.Dropout(rate=rate)
        for k, word in enumerate(" unbelievable internationalization aaaaaaaa xkcdqq Straße".split() * 6):
            symbols = vocabulary.of_char[np.frombuffer((" " + word).encode("utf-32-le"), np.uint32)]
            key = B.mixed(np.array([k], np.uint64))
            pieces, where, _ = B.merge_units(vocabulary, symbols, np.array([0, len(symbols)]), key, dropout)
            assert list(zip(pieces.tolist(), where.tolist())) == B.merge_unit(vocabulary, symbols.tolist(), int(key[0]), dropout)


def test_dropout_varies_by_key_alone(vocabulary):
    texts = [prose(300, 1)] * 2
    one = run(vocabulary, texts, B.Dropout(rate=0.3))
    assert one == run(vocabulary, texts, B.Dropout(rate=0.3)) and one[0] != one[1]
    assert run(vocabulary, texts[:1], B.Dropout(rate=0.3)) == one[:1], "the same in any run of texts"
    assert run(vocabulary, texts, B.Dropout(rate=0.3, seed=12)) != one
    assert run(vocabulary, texts, B.Dropout(rate=0)) != one
    assert len(run(vocabulary, texts, B.Dropout(rate=1))[0]) == len(texts[0]) + 1, "no merge at all"


def drawn(model, text, rate, rng):
    """Pieces of a text by brute force: the best merge not skipped yet is drawn for, again and again."""
    pieces, skipped = [text[i : i + 1].replace(" ", B.MARK) for i in range(len(text))], set()
    while True:
        ends = np.cumsum([0, *map(len, pieces)]).tolist()
        found = [(-model.get_score(i), k) for k in range(len(pieces) - 1) if not model.is_unknown(i := model.piece_to_id(pieces[k] + pieces[k + 1])) and tuple(ends[k : k + 3]) not in skipped]
        if not found:
            return tuple(model.piece_to_id(p) for p in pieces)
        k = min(found)[1]
        if rng.random() < rate:
            skipped.add(tuple(ends[k : k + 3]))
        else:
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]


def test_every_occurrence_has_draws_of_its_own(vocabulary, model):
    for word in (" people", " unbelievable"):
        n, rng = 4000, np.random.default_rng(1)
        ids, _ = B.encode_run(vocabulary, [word[1:] + word * (n - 1)], np.zeros(1, np.uint64), B.Dropout())
        ends = np.cumsum(np.diff(vocabulary.byte_ends)[ids])
        got = Counter(tuple(x.tolist()) for x in np.split(ids, np.searchsorted(ends, np.arange(1, n) * len(word)) + 1))
        want = Counter(drawn(model, word, 0.1, rng) for _ in range(n))
        assert got.total() == n and len(got) > 4
        assert all(abs(got[x] - want[x]) < 0.03 * n for x in got | want)


def test_shared_merges_equal_lone_ones(vocabulary, monkeypatch):
    texts = [prose(300, 1), *TEXTS]
    for rate in (0.1, 0.5, 1.0):
        shared = run(vocabulary, texts, B.Dropout(rate=rate))
        with monkeypatch.context() as m:
            m.setattr(B, "DRAWS", 0)
            assert run(vocabulary, texts, B.Dropout(rate=rate)) == shared


def test_copies_have_draws_of_their_own(spark):
    text = prose(300, 1)
    table = spark.createDataFrame([(1, text, 1), (1, text, 2), (1, text, 2), (1, text, None)], "doc_id long, text string, `a.b` int")
    got = [tuple(r.ids) for r in B.encode(table, copy="a.b").collect()]
    assert len(set(got)) == 3 and len({tuple(r.ids) for r in B.encode(table).collect()}) == 1


def test_rows(spark):
    got = B.encode(frame(spark, ODD, clashing=True)).collect()
    assert len(got) == len(ODD) and all(r.lossless for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[1] == 0 and all(len(r.ids) == r.n_tokens for r in got)
    texts = {(r.doc_id, r.text) for r in B.decode(B.encode(frame(spark, ODD))).collect()}
    assert texts == {(i, t or "") for i, t in ODD}
    assert B.encode(frame(spark, [])).count() == 0


def finished(x):
    """The 64-bit finaliser, by Python's integers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def one_by_one(model, text, salt, rate, seed):
    """A text's ids: each unit by its own agenda, each draw by a keyed hash of its own."""
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    joined = {c for p in pieces if len(p) > 1 for c in p}
    # a mark in the text itself is no word mark
    marked = [B.MARK, *(B.MARK if c == " " else "\x00" if c == B.MARK else c for c in text)] if text else []
    starts = [i for i, c in enumerate(marked) if not i or c == B.MARK != marked[i - 1] or c not in joined or marked[i - 1] not in joined]
    out = []
    for a, b in zip(starts, [*starts[1:], len(marked)]):
        key = finished((salt + finished((a + seed) % 2**64)) % 2**64)
        parts, skipped, draw = [(marked[i], i) for i in range(a, b)], set(), 0
        while True:
            found = []
            for (x, i), (y, j) in zip(parts, parts[1:]):
                if x + y in pieces and (i, j, j + len(y)) not in skipped:
                    found.append((-model.get_score(pieces[x + y]), i, j, y))
            if not found:
                break
            _, i, j, y = min(found)
            skip = rate > 0 and finished((key + draw * 0x9E3779B97F4A7C15) % 2**64) < int(rate * 2**64)
            draw += 1
            if skip:
                skipped.add((i, j, j + len(y)))
            else:
                parts = [(x + y, k) if k == i else (x, k) for x, k in parts if k != j]
        for x, i in parts:
            raw = text[i - 1].encode() if marked[i] == "\x00" else x.encode()
            out += [pieces[x]] if x in pieces else [model.piece_to_id(f"<0x{byte:02X}>") for byte in raw]
    return out


def test_draws_match_one_by_one(vocabulary, model):
    texts = [*TEXTS[:-1], prose(60, 3), "unbelievable internationalization of comfortable people " * 8, "Straße▁mit ▁ ñandú 日本", "aaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbbbbbb"]
    texts = [t for t in texts if len(t) < 500]
    salts = B.mixed(np.arange(len(texts), dtype=np.uint64) + np.uint64(77))
    for rate in (0.1, 0.5):
        got = run(vocabulary, texts, B.Dropout(rate=rate, seed=5), salts)
        for text, salt, ids in zip(texts, salts.tolist(), got):
            assert ids == one_by_one(model, text, salt, rate, 5), (rate, text[:40])


def test_common_words_vary_as_an_independent_sampler_says(vocabulary, model):
    """Over 600 documents a common word has within a tenth of the segmentations that independent draws give."""
    n, rng = 600, np.random.default_rng(4)
    for word in ("unbelievable", "comfortable", "international"):
        salts = B.mixed(np.arange(n, dtype=np.uint64))
        got = len({tuple(x) for x in run(vocabulary, [word] * n, B.Dropout(), salts)})
        want = np.mean([len({drawn(model, " " + word, 0.1, rng) for _ in range(n)}) for _ in range(12)])
        assert abs(got - want) <= max(0.1 * want, 4), (word, got, want)
