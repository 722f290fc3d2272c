import random
import re
from collections import Counter

from docgrain.llm import quality_rules

from .helpers import ODD, LARGER, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rows = [*ODD, (10, "a b c d e f a b c d e g"), (11, "x\nx\n\nx y\nx"), (12, "a b c d e " * 40), (13, "## a $ b | <c>"), (14, "q " * 6)]
    got = quality_rules.quality_rules(frame(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *counts(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_hosts(spark):
    good = [(i, prose(40, i), "en", "good") for i in range(30)]
    bad = [(100 + i, "too short" if i % 10 else prose(40, 100 + i), "en", "bad") for i in range(40)]
    marked = [(200 + i, " ".join(w + "###" for w in prose(40, i).split()) if i % 4 == 0 else prose(40, 300 + i), "en", "marked") for i in range(20)]
    none = [(300, prose(40, 999), "en", None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, good + bad + marked + none)).collect()}
    assert all(got[i].kept for i in range(30)) and got[300].kept
    assert not any(got[100 + i].kept for i in range(40)), "a host that mostly fails loses all"
    assert all(got[200 + i].kept == bool(i % 4) for i in range(20)), "symbols are held against a host that has them"


def test_equal_documents_of_different_hosts(spark):
    """A lone failure is pardoned on a host that seldom fails and held against its twin on a host that often does."""
    marked = " ".join(w + "###" for w in prose(40, 5).split())
    rows = [(i, prose(40, i), "en", "clean") for i in range(400)] + [(500 + i, marked if i % 3 else prose(40, i), "en", "dirty") for i in range(60)]
    rows += [(1000, marked, "en", "clean"), (1001, marked, "en", "dirty")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    twins = got[1000], got[1001]
    assert twins[0].symbols_failed and twins[1].symbols_failed and [r.kept for r in twins] == [True, False]
    assert twins[0][1:7] == twins[1][1:7]
    kept = {r.doc_id for r in quality_rules.keep_good(frame(spark, rows)).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_hosts_that_differ_by_chance_alone(spark):
    """Equal hosts get one rate and equal verdicts, whatever each of them happened to fail."""
    chance = random.Random(4)
    rows = [(f"h{i % 50}", chance.random() < 0.1, chance.random() < 0.15, chance.random() < 0.2) for i in range(3000)]
    found = quality_rules.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean, symbols_failed boolean, lines_failed boolean")).collect()
    assert len(found) == 50
    assert len({(r.host_rejected, r.enforce_symbols, r.enforce_lines) for r in found}) == 1
    assert not found[0].host_rejected and found[0].enforce_symbols and found[0].enforce_lines


def test_hosts_that_truly_differ(spark):
    rates = {"clean": 0.01, "usual": 0.2, "marked": 0.6}
    chance = random.Random(5)
    rows = [(h, chance.random() < rate, chance.random() < rate, False) for h, rate in rates.items() for _ in range(2000)]
    rows += [("few", False, False, False)] * 2
    found = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean, symbols_failed boolean, lines_failed boolean")).collect()}
    assert [found[h].host_rejected for h in ("clean", "usual", "marked", "few")] == [False, False, True, False]
    assert [found[h].enforce_symbols for h in ("clean", "usual", "marked", "few")] == [False, False, True, True] or found["usual"].enforce_symbols
    assert not found["clean"].enforce_symbols and found["few"].enforce_symbols, "two documents say too little of a host"


def test_hosts_of_the_tables_are_alike(spark):
    """Their failures differ as by chance, so all soft failures count alike."""
    got = quality_rules.quality_rules(spark.read.parquet(f"{LARGER}/documents.parquet"))
    soft = {r.kept: r["count"] for r in got.where("NOT base_failed AND (symbols_failed OR lines_failed)").groupBy("kept").count().collect()}
    assert soft.get(False, 0) > 100 and soft.get(True, 0) < 0.1 * soft[False]
    assert got.where("host_rejected").count() == 0


def test_keep_good_and_empty(spark):
    docs = frame(spark, [(1, prose(40, 1)), (2, "short"), (3, prose(40, 2)), (3, prose(40, 2))], clashing=True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3]
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0
    assert quality_rules.keep_good(frame(spark, [])).count() == 0
