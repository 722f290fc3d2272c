import re
from itertools import combinations

import pytest

from docgrain.llm import minhash_dedup as M

from .helpers import ODD, edited, frame, prose


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width=2):
    """By doc_id: set size and component, comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(sets.items(), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus():
    rows, n = [], 0
    for base in range(12):
        text = prose(60 + 10 * base, base)
        rows.append((n, text))
        n += 1
        for k in range(14):
            rows.append((n, edited(text, 0.01 * k, 100 * base + k)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate(["A b C", "a B c", "one", "one", "", "x y", "X Y"])]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_all_pairs(spark, width):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.linked(frame(spark, rows), M.Near(width=width)).collect()}
    assert got == brute(rows, width)


def test_large_groups_in_small_tiles(spark):
    """A chain and a crowd of near copies, in blocks and tiles of a few rows."""
    base = prose(80, 5)
    rows = [(i, edited(base, 0.06 + 0.002 * (i % 40), i)) for i in range(150)]
    text, chain = base.split(), []
    for i in range(40):
        text = text[2:] + [f"c{i}a", f"c{i}b"]
        chain.append((1000 + i, " ".join(text)))
    near = M.Near(bucket_rows=16, lot=8, block_bytes=4000, broadcast_rows=3)
    got = {r.doc_id: r.component_id for r in M.linked(frame(spark, rows + chain), near).collect()}
    assert got == {i: c for i, (_, c) in brute(rows + chain).items()}


def test_odd_rows(spark):
    got = M.linked(frame(spark, ODD, clashing=True)).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == r.doc_id and r.kept
    assert {r.doc_id: r.n_shingles for r in got}[1] == 0
    assert M.linked(frame(spark, [])).count() == 0


def test_keep_one(spark):
    docs = frame(spark, [(9, "a b c d"), (4, "A b c D"), (7, "z y x w"), (8, "")], clashing=True)
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 7, 8]
