"""Mixing sources to target weights, in DataFrame functions only.

Leaves are the paths of a tree of levels (domain, language, source). A node's budget is dealt to its children by their
weights; a child that can't take its share (its tokens times ``max_epochs``) takes what it can and its siblings share
the rest by their weights. A node's own capacity is its children's sum, so a shortage reaches an ancestor's other
children only if the siblings can't make it up. Each leaf's budget is some whole epochs and a prefix of one more, in an
order by hash that the seed, the epoch and doc_id give.

The plan has one row a leaf and is all that the documents are joined with: copies = epochs, and one more up to the
leaf's last key. Finding that key takes sums by leaf and key range, then by narrower ranges of the one range where the
budget ends, and single keys only in the last, so that no task orders a leaf. All arithmetic is in whole numbers; shares
are rounded down.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import lcm
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, quoted, whole_row, written


@dataclass(frozen=True)
class Mix:
    """percent: the budget, of all tokens. weights: by level, then by node name; whole numbers, 1 if not named.
    columns: the column of the documents that a level is read from, that of its own name if not named; the level domain is
    derived from source unless it is named here. range_digits: hexadecimal digits of a key by which each step narrows its
    range, in ``steps`` steps."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    percent: int = 80
    max_epochs: int = 2
    seed: int = 7
    columns: Mapping[str, str] = field(default_factory=dict)
    range_digits: int = 2
    steps: int = 3


def domain(source: Column) -> Column:
    """Domain of a source: by the last digit of its name."""
    last = F.substring(F.coalesce(source, F.lit("")), -1, 1)
    return F.when(last.isin("0", "1", "2", "3"), "web").when(last.isin("4", "5", "6"), "books").otherwise("reference")


#: The mix that the queries use, over domain(), lang and source.
MIX = Mix(weights={"domain": {"web": 3, "books": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 3}})


def n_tokens(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1)
    for name, weight in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("decimal(38,0)")


def _key(mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (the levels and ``tokens``) with ``budget``; see the module."""
    whole = "decimal(38,0)"
    df = leaves
    able = F.lit(True)
    for level in mix.levels:
        able = able & (_weight(level, mix) > 0)
    df = df.withColumn("capacity", F.when(able, F.col("tokens") * mix.max_epochs).otherwise(F.lit(0)).cast(whole))
    total = df.agg(F.sum(F.col("tokens").cast(whole)).alias("tokens"), F.sum("capacity").alias("most")).first()
    root = min(int(total["tokens"] or 0) * mix.percent // 100, int(total["most"] or 0))
    df = df.withColumn("budget", F.lit(root).cast(whole))
    for depth, level in enumerate(mix.levels):
        parent, node = list(mix.levels[:depth]), list(mix.levels[: depth + 1])
        nodes = df.groupBy(*node).agg(F.sum("capacity").cast(whole).alias("c"), F.first("budget").alias("b")).withColumn("w", F.nullif(_weight(level, mix), F.lit(0)))
        group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        # capacity by weight, in whole numbers
        common = lcm(*(int(w) for w in mix.weights.get(level, {}).values() if w > 0))
        order = group.orderBy(F.expr(f"c * ({common} div w)").asc_nulls_last(), level)
        nodes = nodes.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(whole))
        nodes = nodes.withColumn("behind", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(whole))
        nodes = nodes.withColumn("full", F.col("c").cast(whole) * F.col("behind") <= (F.col("b") - F.col("before")) * F.col("w"))
        nodes = nodes.withColumn("rest", (F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(group), F.lit(0))).cast(whole))
        nodes = nodes.withColumn("shared", F.sum(F.when(~F.col("full"), F.col("w"))).over(group).cast(whole))
        share = F.floor(F.expr("cast(rest * w as decimal(38,0)) div cast(shared as decimal(38,0))")).cast(whole)
        dealt = nodes.select(*node, F.when(F.col("full"), F.col("c")).when(F.col("shared") > 0, share).otherwise(F.lit(0)).cast(whole).alias("budget"))
        df = df.drop("budget").join(dealt, node)
    return df.select(*mix.levels, F.col("tokens").cast("long").alias("tokens"), F.col("budget").cast("long").alias("budget"))


def _levels(docs: DataFrame, mix: Mix) -> list[Column]:
    """The levels of each document; null is the node ""."""
    out = []
    for level in mix.levels:
        if level == "domain" and level not in mix.columns:
            found = domain(docs[quoted(mix.columns.get("source", "source"))])
        else:
            found = docs[quoted(mix.columns.get(level, level))]
        out.append(F.coalesce(found.cast("string"), F.lit("")).alias(level))
    return out


def leveled(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, the levels (null is the node "") and tokens of every row of ``docs``."""
    return docs.select(docs["doc_id"], *_levels(docs, mix), n_tokens(docs["text"]).alias("tokens"))


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row a leaf, written: the levels, tokens, budget, epochs and ``upto``, the last key of the epoch after."""
    levels = list(mix.levels)
    leaves = written(rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "leaves")
    some = F.col("tokens") > 0
    dealt = budgets(leaves, mix).withColumn("epochs", F.when(some, F.expr("budget div nullif(tokens, 0)")).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.when(some, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(-1)).cast("long"))
    dealt = written(dealt, "budgets")
    # of each leaf the range where the budget ends, and the tokens before it
    last = dealt.where("rest >= 0").select(*levels, "epochs", "rest", F.lit("").alias("range"), F.lit(0).cast("long").alias("before"))

    def inside() -> DataFrame:
        """Documents in the range of their leaf."""
        keyed = rows.join(last, levels).withColumn("key", _key(mix))
        return keyed.where(F.startswith("key", "range"))

    for step in range(mix.steps):
        narrow = F.substring("key", 1, mix.range_digits * (step + 1))
        sums = inside().groupBy(*levels, "epochs", "rest", "before", narrow.alias("range")).agg(F.sum("tokens").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        ends = sums.withColumn("upto", upto).where("upto > rest").groupBy(*levels).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"), "epochs", "rest")).alias("x"))
        last = written(ends.select(*levels, "x.epochs", "x.rest", "x.range", "x.before"), "ranges")
    keys = inside().withColumn("sum", F.col("before") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("key")))
    keys = keys.where("sum <= rest").groupBy(*levels).agg(F.max("key").alias("key"))
    ends = last.join(keys, levels, "left").select(*levels, F.coalesce("key", "range").alias("upto"))
    out = dealt.join(ends, levels, "left").select(*levels, "tokens", "budget", "epochs", F.coalesce("upto", F.lit("")).alias("upto"))
    return written(out, "plan")


def copies(rows: DataFrame, planned: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` of leveled() with how often the mix takes each."""
    joined = rows.join(planned.select(*mix.levels, "epochs", "upto"), list(mix.levels), "left")
    return joined.withColumn("copies", F.col("epochs") + (_key(mix) <= F.col("upto")).cast("long")).drop("epochs", "upto")


def mixture(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies (0 and up) of every row of ``docs``.

    Null levels are the node "", a null text has no tokens, a null doc_id counts as an empty text in keys. Rows of one
    doc_id in one leaf are taken together or not at all. A leaf without tokens is not taken. Other columns are not
    read; an empty table gives an empty one.
    """
    rows = written(leveled(docs, mix), "tokens")
    return copies(rows, plan(rows, mix), mix).select("doc_id", *mix.levels, F.col("tokens").alias("n_tokens"), "copies")


def mixed_documents(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """``docs``, with their columns, whatever their names, each row as often as the mix takes it.

    Null levels are the node "", null and empty texts have no tokens and are taken as their leaf's keys fall, rows of one
    doc_id in one leaf (repeated rows, null doc_ids) together or not at all. An empty table gives an empty one. Texts are
    scanned twice and not shuffled while the plan is small.
    """
    planned = plan(written(leveled(docs, mix), "tokens"), mix)
    keyed = docs.select(whole_row(docs).alias("__row"), docs["doc_id"], *_levels(docs, mix))
    taken = copies(keyed, planned, mix).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
