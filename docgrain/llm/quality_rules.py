"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets counts and rule failures. Failures are summed by host (the ``source`` column), each host's rate
is shrunk by a beta prior fitted to all hosts by moments, and the host's verdicts are joined back to its documents: a
host that mostly fails loses all its documents; the soft rules (symbols, repeated lines) are held against documents of
all hosts but those whose rate is almost surely below the prior's mean, where a lone failure is pardoned. "Almost surely" is by the
posterior beta, through its mean and deviation. Where hosts differ no more than chance would have them, none has a verdict of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, whole_row, written


@dataclass(frozen=True)
class Rules:
    """Limits; percentages are of words, or of lines that hold a word."""

    least_words: int = 10
    window: int = 5
    repeat_percent: int = 20
    symbol_percent: int = 30
    line_percent: int = 30
    #: A host whose rate of base failures is surely this high loses all its documents.
    reject_rate: float = 0.5
    #: A rate is surely above or below another if the posterior's mean is by so many of its deviations (95 %).
    sure: float = 1.645
    #: Bounds of the prior's weight in documents.
    least_weight: float = 1.0
    most_weight: float = 1000.0


RULES = Rules()


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column, width: int) -> Column:
    """Number of words in windows of ``width`` that occur more than once; windows are told apart by 64-bit hashes."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)

        return _let(_let(pairs, places), total)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[words[i + k] for k in range(width)]))
    some = _let(hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) >= width, some).otherwise(F.lit(0))


def measures(text: Column, rules: Rules = RULES) -> Column:
    """A struct of the counts of one text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = _let(
        F.array_remove(F.split(text, SPACE), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w, rules.window).cast("long").alias("n_repeat_words")),
    )
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))


def measured(docs: DataFrame, *keep: str, rules: Rules = RULES) -> DataFrame:
    """Counts and failures of every row of ``docs``, beside the columns named in ``keep`` (as they are)."""
    df = docs.select(*[F.col(c) for c in keep], measures(F.col("text"), rules).alias("__m"))
    df = df.select(*keep, "__m.w.n_words", "__m.w.word_chars", "__m.n_symbols", "__m.l.n_dup_lines", "__m.w.n_repeat_words", "__m.l.n_lines")
    n = F.col("n_words")
    return df.select(
        "*",
        ((n < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * n)).alias("base_failed"),
        (100 * F.col("n_symbols") > rules.symbol_percent * n).alias("symbols_failed"),
        (100 * F.col("n_dup_lines") > rules.line_percent * F.col("n_lines")).alias("lines_failed"),
    )


FAILURES = ("base_failed", "symbols_failed", "lines_failed")


def host_verdicts(rows: DataFrame, host: str = "source", rules: Rules = RULES) -> DataFrame:
    """One row per host: shrunk rates and verdicts, from rows of ``measured()``; a null host is a host.

    The sums are aggregated before the shuffle, so a hot host costs one row per task. The prior is one row.
    """
    hosts = written(rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.sum(F.col(f).cast("long")).alias(f) for f in FAILURES]), "hosts")
    moments = hosts.agg(F.avg(1 / F.col("n")).alias("one"), *[x for f in FAILURES for x in (F.avg(F.col(f) / F.col("n")).alias(f"mean_{f}"), F.var_pop(F.col(f) / F.col("n")).alias(f"var_{f}"))]).first()
    out, surely = hosts, {}
    for f in FAILURES:
        mean, var = moments[f"mean_{f}"] or 0.0, moments[f"var_{f}"] or 0.0
        var -= mean * (1 - mean) * (moments["one"] or 0.0)  # what sampling alone makes
        if var <= 0:  # hosts are alike: all get the common rate
            out, surely[f] = out.withColumn(f"rate_{f}", F.lit(mean)), None
            continue
        weight = min(max(mean * (1 - mean) / var - 1, rules.least_weight), rules.most_weight)
        rate = (F.col(f) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        margin = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(weight + 1))) * rules.sure
        out, surely[f] = out.withColumn(f"rate_{f}", rate), (rate - margin, rate + margin, mean)
    base, symbols, lines = (surely[f] for f in FAILURES)
    return out.select(
        "host",
        "n",
        *[f"rate_{f}" for f in FAILURES],
        (F.lit(False) if base is None else base[0] >= rules.reject_rate).alias("host_rejected"),
        (F.lit(True) if symbols is None else symbols[1] >= symbols[2]).alias("enforce_symbols"),
        (F.lit(True) if lines is None else lines[1] >= lines[2]).alias("enforce_lines"),
    )


def _judged(rows: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """``rows`` with their hosts' verdicts. The planner broadcasts the written verdicts if they are small; else it
    shuffles both sides and splits a hot host's rows."""
    of_host = verdicts.select(F.col("host").alias("__of"), "host_rejected", "enforce_symbols", "enforce_lines")
    joined = rows.join(of_host, F.col(host).eqNullSafe(F.col("__of")), "left").drop("__of")
    bad = F.col("base_failed") | F.col("host_rejected") | (F.col("symbols_failed") & F.col("enforce_symbols")) | (F.col("lines_failed") & F.col("enforce_lines"))
    return joined.withColumn("kept", ~bad)


def quality_rules(docs: DataFrame, host: str = "source", rules: Rules = RULES) -> DataFrame:
    """Counts, failures and verdict of every row of ``docs`` (doc_id, text, host); one row out for each row in.

    Null or empty text: all counts 0, so base_failed. A null host is a host of its own; null doc_ids and repeated
    rows are kept as they are, and very long texts are measured whole. Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    rows = written(measured(docs, "doc_id", host, rules=rules), "rules")
    out = _judged(rows, written(host_verdicts(rows, host, rules), "verdicts"), host)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "symbols_failed", "lines_failed", "host_rejected")


def keep_good(docs: DataFrame, host: str = "source", rules: Rules = RULES) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns, whatever their names.

    Null and empty texts fail and go, as do all texts under the least words; repeated rows stay or go together; null
    hosts are a host; very long texts are measured whole; an empty table gives an empty one. Texts are measured twice, for the
    hosts' sums and for the rows that stay, so that no copy of them is written; and none is shuffled while the verdicts are few.
    """
    sums = measured(docs.select(docs[host].alias("__host"), docs["text"].alias("text")), "__host", rules=rules)
    verdicts = written(host_verdicts(sums, "__host", rules), "verdicts")
    rows = measured(docs.select(whole_row(docs).alias("__row"), docs[host].alias("__host"), docs["text"].alias("text")), "__row", "__host", rules=rules)
    return _judged(rows.where(~F.col("base_failed")), verdicts, "__host").where("kept").select("__row.*")
