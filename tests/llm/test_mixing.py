import hashlib
from collections import defaultdict

import pytest

from docgrain.llm import mixing as X

from .helpers import ODD, frame, prose
from .test_quality_rules import WORD


def dealt(children, budget):
    """children: [(name, capacity, weight)]; what each gets, in whole numbers."""
    order = sorted(children, key=lambda c: (c[1] / c[2] if c[2] else float("inf"), c[0]))
    out, left, weight, open_ = {}, budget, sum(c[2] for c in order), []
    for name, capacity, w in order:
        if not open_ and capacity * weight <= left * w:
            out[name] = capacity
            left, weight = left - capacity, weight - w
        else:
            open_.append((name, w))
    total = sum(w for _, w in open_)
    return out | {name: left * w // total if total else 0 for name, w in open_}


def brute(rows, mix):
    """Copies by doc_id and leaf, from rows (doc_id, text, lang, source)."""
    def domain(s):
        return "web" if s[-1:] in tuple("0123") else "books" if s[-1:] in tuple("456") else "reference"

    leaf_of = [(domain(s or ""), la or "", s or "") for _, _, la, s in rows]
    tokens = [len(WORD.findall(t or "")) for _, t, _, _ in rows]
    have = defaultdict(int)
    for leaf, n in zip(leaf_of, tokens):
        have[leaf] += n

    def weight(level, name):
        return mix.weights.get(level, {}).get(name, 1)

    cap = {leaf: n * mix.max_epochs if all(weight(x, y) for x, y in zip(mix.levels, leaf)) else 0 for leaf, n in have.items()}
    budgets = {(): min(sum(have.values()) * mix.percent // 100, sum(cap.values()))}
    for depth, level in enumerate(mix.levels):
        for parent in {leaf[:depth] for leaf in cap}:
            names = sorted({leaf[depth] for leaf in cap if leaf[:depth] == parent})
            children = [(n, sum(c for leaf, c in cap.items() if leaf[: depth + 1] == (*parent, n)), weight(level, n)) for n in names]
            budgets |= {(*parent, n): b for n, b in dealt(children, budgets[parent]).items()}
    out = []
    for leaf, total in have.items():
        epochs, rest = divmod(budgets[leaf], total) if total else (0, -1)
        by_key = defaultdict(list)
        for i, (r, own, n) in enumerate(zip(rows, leaf_of, tokens)):
            if own == leaf:
                by_key[hashlib.md5(f"{mix.seed}:{epochs + 1}:{'' if r[0] is None else r[0]}".encode()).hexdigest()].append((i, n))
        run = 0
        for key in sorted(by_key):
            run += sum(n for _, n in by_key[key])
            out += [(str(rows[i][0]), *leaf, n, epochs + (run <= rest)) for i, n in by_key[key]]
    return sorted(out), budgets


def corpus():
    rows = [(i, prose(5 + i % 37, i), ("en", "de", "fr", "es")[i % 7 % 4], f"src{i % 3 and i % 9}") for i in range(400)]
    return [*rows, *[(i, t, None, None) for i, t in ODD if i != 7], (7, "z", "de", ""), (900, "only " * 4, "it", "src5")]


@pytest.mark.parametrize("mix", [X.MIX, X.Mix(percent=150, max_epochs=3), X.Mix(percent=30, weights={"lang": {"en": 0}, "source": {"src0": 5}}, range_digits=1, steps=1), X.Mix(percent=60, steps=0), X.Mix(percent=1000, max_epochs=2)])
def test_copies_match_brute_force(spark, mix):
    rows = corpus()
    got = X.mixture(frame(spark, rows, clashing=True), mix).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute(rows, mix)[0]


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "a " * 10, "en", "s0"), (2, "a " * 1000, "en", "s1"), (3, "a " * 1000, "de", "s2"), (4, "a " * 1000, "de", "s4")]
    leaves = X.budgets(X.leveled(frame(spark, rows), X.Mix()).groupBy("domain", "lang", "source").sum("tokens").withColumnRenamed("sum(tokens)", "tokens"), X.Mix(percent=50, max_epochs=1))
    got = {r.source: r.budget for r in leaves.collect()}
    assert got == {"s0": 10, "s1": 366, "s2": 376, "s4": 752}
    assert sum(got.values()) <= 1505


def test_a_column_of_domains_counts_where_it_is_named(spark):
    docs = frame(spark, [(i, "a b c", "en", f"src{i % 8}") for i in range(80)], clashing=True)
    assert {r.domain for r in X.mixture(docs).collect()} == {"web", "books", "reference"}
    assert {r.domain for r in X.mixture(docs, X.Mix(columns={"domain": "domain"})).collect()} == {"x"}


def test_capacities_are_ordered_in_whole_numbers(spark):
    """Ratios that doubles can't tell apart."""
    big = 3 * 10**16 + 1
    leaves = spark.createDataFrame([("web", "en", "s0", big), ("web", "en", "s1", big - 1), ("web", "en", "s2", 10**17)], "domain string, lang string, source string, tokens long")
    mix = X.Mix(percent=60, max_epochs=1, weights={"source": {"s0": 3, "s1": 3, "s2": 1}})
    got = {r.source: r.budget for r in X.budgets(leaves, mix).collect()}
    total = (2 * big - 1 + 10**17) * 60 // 100
    assert got == dealt([("s0", big, 3), ("s1", big - 1, 3), ("s2", 10**17, 1)], total)


def test_documents(spark):
    rows = corpus()
    docs = frame(spark, rows, clashing=True)
    mix = X.Mix(percent=150, max_epochs=3)
    out = X.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    copies = {(i, *leaf): c for i, *leaf, _, c in brute(rows, mix)[0]}
    assert out.count() == sum(c for *_, c in brute(rows, mix)[0]) and max(copies.values()) > 1
    assert X.mixture(frame(spark, [])).count() == 0 and X.mixed_documents(frame(spark, [])).count() == 0
