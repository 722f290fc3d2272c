"""Quarantine and cascading release: replays the delivery of conversations' turns in JVM expressions.

The turns of a conversation arrive at a fixed pace and each may wait for one of the few turns before it. Faulty turns are
tried again with growing pauses until they deliver or are dead; what waits for a dead or blocked turn is blocked. The
sorted turns are collected as structs and a higher-order ``aggregate`` folds them into an array of outcomes, in which
each finds its parent's by index; the array is exploded, and deliveries are ranked and summed by windows.

However long a conversation is, no task needs all of it. It is cut where no later turn can have an earlier one as its
parent, so folds are short; and turns are numbered, and deliveries ranked, within ranges of (conversation, order)
that Spark deals by sampled bounds: the ranges' counts and sums, one row for each range and conversation, say where each begins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Policy:
    """Seconds, and moduli of the hashes that decide."""

    #: Seconds between the arrivals of a conversation's turns.
    pace: int = 7
    #: The parent is this many turns earlier, less one, at the most.
    reach: int = 5
    #: Of ``fault_of`` hash values so many make a turn faulty; it is repaired within as many seconds.
    faulty: int = 50
    fault_of: int = 101
    #: One attempt in so many of a faulty turn fails though it is repaired.
    fails_of: int = 3
    #: Pause after the first failed attempt; each later one is twice as long.
    pause: int = 10
    attempts: int = 6


POLICY = Policy()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def drawn(conv_id: Column, turn: Column, policy: Policy = POLICY) -> list[Column]:
    """back, faulty, wait and bad of a turn: distance of the parent, whether faulty, seconds to its repair, and a bit for
    each attempt that fails by itself."""

    def h(k: int) -> Column:
        return F.crc32(F.concat(F.lit(f"{k}:"), F.coalesce(conv_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(""))).cast("binary"))

    bad = [F.when(h(a + 2) % policy.fails_of == 0, 1 << (a - 1)).otherwise(0) for a in range(1, policy.attempts + 1)]
    total = bad[0]
    for x in bad[1:]:
        total = total + x
    return [
        (h(0) % policy.reach).cast("int").alias("back"),
        (h(1) % policy.fault_of < policy.faulty).alias("faulty"),
        (h(2) % policy.fault_of).cast("int").alias("wait"),
        total.cast("int").alias("bad"),
    ]


def _earlier(parts: DataFrame) -> Window:
    """Over a conversation's earlier ranges. A conversation has as many rows here as ranges that hold a part of it."""
    return Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _join_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with what ``parts`` says of their range and conversation; conversations without an id are one."""
    of = parts.select(F.col("part").alias("__part"), F.col("conv_id").alias("__conv"), *[c for c in parts.columns if c not in ("part", "conv_id")])
    return rows.join(of, (F.col("part") == F.col("__part")) & F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__part", "__conv", "part")


def segments(turns: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """conv_id, turn, sum (crc32 of the text), back, faulty, wait, bad, p (place from 0) and segment of every turn.

    No turn of a segment has its parent in another one: one begins at each turn from which on, for as far as parents
    reach, none lies before it. At the end of a range the turns that follow aren't seen, so none begins there, which only
    makes the segment before it longer.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = turns.select(F.col("conv_id"), F.col("turn"), crc.alias("sum"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "sum", "row"]
    rows = rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    rows = rows.select("*", *drawn(F.col("conv_id"), F.col("turn"), policy))
    here = Window.partitionBy("part", "conv_id").orderBy(*order)
    clean = F.col("back") == 0
    for ahead in range(1, policy.reach - 1):
        clean = clean & F.coalesce(F.lead("back", ahead).over(here) <= ahead, F.lit(False))
    rows = rows.withColumn("k", F.row_number().over(here)).withColumn("clean", clean)
    rows = rows.withColumn("begins", F.max(F.when(F.col("clean"), F.col("k"))).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    rows = written(rows.drop("row", "clean"), "turns")
    parts = rows.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.max("begins").alias("last"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(_earlier(parts)), F.lit(0)))
    parts = parts.withColumn("open", F.coalesce(F.max(F.col("before") + F.col("last")).over(_earlier(parts)), F.lit(1)))
    joined = _join_parts(rows, parts.select("part", "conv_id", "before", "open"))
    p = (F.col("before") + F.col("k") - 1).alias("p")
    return joined.select("conv_id", "turn", "sum", "back", "faulty", "wait", "bad", p, F.coalesce(F.col("before") + F.col("begins"), F.col("open")).alias("segment"))


def _outcome(policy: Policy) -> Callable[[Column, Column], Column]:
    """The step of the fold: the outcomes so far and a turn, to the outcomes with that turn's.

    An outcome has attempts, first_at, last_at and ok (delivered).
    """
    none = F.lit(None).cast("long")
    tries = range(1, policy.attempts + 1)
    after = F.array(*[F.lit(policy.pause * ((1 << (a - 1)) - 1)).cast("long") for a in tries])

    def struct(attempts: Column, first: Column, last: Column, ok: Column) -> Column:
        return F.struct(attempts.cast("int").alias("attempts"), first.alias("first_at"), last.alias("last_at"), ok.alias("ok"))

    def step(so_far: Column, x: Column) -> Column:
        arrival = x["p"] * policy.pace

        def of(parent: Column) -> Column:
            def tried(first: Column) -> Column:
                passes = [F.when(~x["faulty"] | ((first + after[a - 1] >= arrival + x["wait"]) & (x["bad"].bitwiseAND(1 << (a - 1)) == 0)), a) for a in tries]
                return _let(F.coalesce(*passes), lambda a: struct(F.coalesce(a, F.lit(policy.attempts)), first, first + F.element_at(after, F.coalesce(a, F.lit(policy.attempts))), a.isNotNull()))

            # a turn without a parent finds a null here
            return F.when(parent.isNotNull() & ~parent["ok"], struct(F.lit(0), none, none, F.lit(False))).otherwise(_let(F.greatest(arrival, parent["last_at"]), tried))

        return F.concat(so_far, F.array(_let(F.get(so_far, F.size(so_far) - x["back"]), of)))

    return step


def outcomes(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """conv_id, turn, p, sum, attempts, first_at, last_at and ok of every row of segments()."""
    turn = F.struct("p", "turn", "sum", "back", "faulty", "wait", "bad")
    grouped = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    none = F.array().cast("array<struct<attempts:int,first_at:bigint,last_at:bigint,ok:boolean>>")
    folded = grouped.select("conv_id", "turns", F.aggregate("turns", none, _outcome(policy)).alias("found"))
    both = F.transform("turns", lambda x, i: F.struct(x["turn"].alias("turn"), x["p"].alias("p"), x["sum"].alias("sum"), F.get(F.col("found"), i).alias("o")))
    return folded.select("conv_id", F.inline(both)).select("conv_id", "turn", "p", "sum", "o.attempts", "o.first_at", "o.last_at", "o.ok")


def releases(found: DataFrame) -> DataFrame:
    """Rows of outcomes() with release_no (by last_at, turn and place, delivered turns of a conversation alone) and state.

    state is a decimal, as it grows with the square of a conversation's turns.
    """
    when = F.when(F.col("ok"), F.col("last_at"))
    order = ["at", "turn", "p"]
    rows = found.withColumn("at", when).repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    here = Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("ok").cast("long")
    rows = rows.withColumn("k", F.sum(ok).over(here))
    rows = rows.withColumn("sums", F.sum(ok * F.col("sum")).over(here)).withColumn("ranked", F.sum((ok * F.col("k") * F.col("sum")).cast("decimal(38,0)")).over(here))
    rows = written(rows, "releases")
    wide = "decimal(38,0)"
    parts = rows.groupBy("part", "conv_id").agg(F.max("k").alias("n"), F.max("sums").alias("sums_all"), F.max("ranked").alias("ranked_all"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(_earlier(parts)), F.lit(0)))
    whole = (F.col("before").cast("decimal(18,0)") * F.col("sums_all").cast("decimal(19,0)") + F.col("ranked_all")).cast(wide)
    parts = parts.withColumn("state_before", F.coalesce(F.sum(whole).over(_earlier(parts)), F.lit(0)).cast(wide))
    joined = _join_parts(rows, parts.select("part", "conv_id", "before", "state_before"))
    state = F.col("state_before") + F.col("before").cast("decimal(18,0)") * F.col("sums").cast("decimal(19,0)") + F.col("ranked")
    return joined.select(
        *[c for c in found.columns],
        F.when(F.col("ok"), F.col("before") + F.col("k")).alias("release_no"),
        F.when(F.col("ok"), state.cast(wide)).alias("state"),
    )


def replay(turns: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no, state and p of every row of ``turns`` (conv_id, turn, text).

    A null text counts as empty, and so does a null conv_id or turn in the hashes; rows without a conv_id are one
    conversation, and a null turn comes first. Rows of one conversation and turn are turns of their own, ordered by crc32 of
    their texts (those that agree in it too differ in nothing that is returned but ``p``). A text is read for its crc32 alone, so very long ones
    cost a scan. Other columns are not read, and an empty table gives an empty table.
    """
    found = releases(outcomes(segments(turns, policy), policy))
    status = F.when(F.col("ok"), "delivered").when(F.col("attempts") > 0, "dead").otherwise("blocked")
    return found.select("conv_id", "turn", status.alias("status"), "attempts", "first_at", "last_at", "release_no", "state", "p")
