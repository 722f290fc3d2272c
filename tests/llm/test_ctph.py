import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.llm import ctph

from .helpers import ODD, edited, frame, prose


def one(text):
    raw = text.encode()
    return ctph.fingerprints(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def slow(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_common_subsequence(a, b):
    assert ctph.common_subsequence(a, b) == slow(a, b)


def test_a_text_has_its_fingerprint_in_any_run():
    texts = ["", "a", prose(50, 1), "x" * 3000, prose(4000, 2), "é😀" * 200, ""]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    assert ctph.fingerprints(np.frombuffer(b"".join(raw), np.uint8), offsets) == [one(t) for t in texts]
    assert one("") == "3::"


def test_likeness():
    for n in (30, 200, 3000):
        text = prose(n, n)
        assert ctph.likeness(one(text), one(text)) == 1
        assert ctph.likeness(one(text), one(edited(text, 0.01, 3))) > 0.4
        assert ctph.likeness(one(text), one(prose(n, n + 1))) < 0.3


def test_against_next_matches_brute_force(spark):
    rows = [*ODD, *[(100 + i, prose(20 + 7 * i, i)) for i in range(40)]]
    got = ctph.against_next(frame(spark, rows, clashing=True)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (i, t), (_, f) in zip(order, order[1:] + order[:1]):
        t, f = t or "", f or ""
        e = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), one(t), one(e), ctph.likeness(one(t), one(e)), ctph.likeness(one(t), one(f))))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_small_tables(spark):
    assert ctph.against_next(frame(spark, [])).count() == 0
    alone = ctph.against_next(frame(spark, [(1, "abcdef")])).collect()[0]
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert {(r.doc_id, r.fingerprint) for r in ctph.fingerprint(frame(spark, [(1, None), (2, "abc")])).collect()} == {(1, "3::"), (2, one("abc"))}


def finished(x):
    """The 64-bit finaliser, by Python's integers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def byte_by_byte(raw):
    """A fingerprint by the definition: roll over seven bytes, cut, hash each chunk, one step a byte."""
    roll_of = [finished((b + 1) * 0x632BE59BD9B4E019 % 2**64) >> 32 for b in range(256)]
    code_of = [finished((b + 1) * 0x9E3779B97F4A7C15 % 2**64) for b in range(256)]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    last, rolls = [], []
    for b in raw:
        last = [b, *last][:7]
        rolls.append(sum(roll_of[x] * 0x9E3779B1**k for k, x in enumerate(last)) % 2**32)

    def ends(k):
        return [i for i, r in enumerate(rolls) if (r + 1) % 2**32 % (3 << k) == 0]

    def chunks(k):
        out, start = "", 0
        for stop in [*(i + 1 for i in ends(k)), len(raw)]:
            if stop > start:
                sum_ = sum(code_of[b] * pow(0xD6E8FEB86659FD93, i, 2**64) for i, b in enumerate(raw[start:stop]))
                char = alphabet[finished((sum_ + stop - start) % 2**64) >> 58]
                out += "" if out.endswith(char * 3) else char
                start = stop
        return out

    k = 0
    while len(ends(k + 1)) >= 32:
        k += 1
    return f"{3 << k}:{chunks(k)}:{chunks(k + 1)}"


def test_fingerprints_match_byte_by_byte():
    texts = ["", "a", "abcdefg", prose(50, 1), prose(900, 2), "x" * 300, "ab" * 400, "é😀" * 90, "\x00\n\t " * 50, edited(prose(300, 3), 0.05, 4)]
    for text in texts:
        assert one(text) == byte_by_byte(text.encode()), text[:40]
