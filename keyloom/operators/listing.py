"""What keys there were at many moments of a log, by one pass over the stretches in which each entry lived.

A listing finds the entries whose life holds its place in the log. Patterns meet keys by an equality
join on the pattern's fixed prefix, never pair by pair; only lives that hold some listing get there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.exprs import glob_match, live
from keyloom.operators.fold import SLICE_OPS, count_before
from keyloom.operators.slices import cut_points, slice_at
from keyloom.runtime import durable, small_side


def took_effect() -> Column:
    """Whether an operation of ``replies`` changed its key: W and D always, U where the key existed."""
    return F.col("kind").isin("W", "D") | ((F.col("kind") == "U") & F.col("existed"))


def lives(told: DataFrame) -> DataFrame:
    """key, value, exp, epoch, start, stop for each write of ``replies``: it is seen by operations of its epoch between start and stop (null: to the end)."""
    ops = told.filter(took_effect()).select("key", "epoch", "seq", "pos", "kind", "value", "exp")
    n = ops.count()
    cuts = cut_points(ops, ["seq"], n // SLICE_OPS + 1, n)
    sliced = ops.withColumn("s", slice_at(["seq"], cuts))
    inside = F.lead("seq").over(W.partitionBy("key", "epoch", "s").orderBy("seq", "pos"))
    ended = sliced.withColumn("stop", inside)
    if cuts:
        first = sliced.groupBy("key", "epoch", "s").agg(F.min("seq").alias("f"))
        later = first.select("key", "epoch", "s", F.lead("f").over(W.partitionBy("key", "epoch").orderBy("s")).alias("l"))
        ended = ended.join(later, ["key", "epoch", "s"]).withColumn("stop", F.coalesce("stop", "l"))
    return ended.filter("kind <> 'D'").select("key", "value", "exp", "epoch", F.col("seq").alias("start"), "stop")


def holding(found: DataFrame, moments: DataFrame) -> DataFrame:
    """The lives that hold at least one of the ``moments`` (seq), with lo and hi: they hold numbers lo to hi - 1 of them."""
    marks = moments.select(F.col("seq").alias("m"))
    n = marks.count()
    low = count_before(found, marks, "lo", "start")
    both = count_before(low, marks, "hi", "stop").withColumn("hi", F.when(F.col("stop").isNull(), F.lit(n)).otherwise(F.col("hi")))
    return both.filter("lo < hi")


def prefix_of(pattern: Column) -> Column:
    """What a glob's matches begin with."""
    return F.substring_index(pattern, "*", 1)


def match_globs(keys: DataFrame, patterns: DataFrame, also: Column | None = None) -> DataFrame:
    """The rows of ``keys`` (key and others) joined with those of ``patterns`` (glob and others) that match; ``also`` is a further condition.

    An empty or null glob matches nothing. The other columns of the two must differ.
    """
    wanted = patterns.filter(F.length("glob") > 0).withColumn("__p", prefix_of(F.col("glob")))
    lengths = sorted(r[0] for r in wanted.select(F.length("__p")).distinct().collect())
    if not lengths:
        return keys.join(wanted.drop("__p"), F.lit(False))
    # a key is tried with its heads of those lengths that prefixes have
    heads = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("key")), lambda n: F.substring("key", F.lit(1), n))
    tried = keys.withColumn("__p", F.explode(heads))
    met = tried.join(small_side(wanted), "__p").filter(glob_match("key", F.col("glob")))
    return (met if also is None else met.filter(also)).drop("__p")


def listed(found: DataFrame, lists: DataFrame, flushes: DataFrame) -> DataFrame:
    """(seq, key) for each listing (seq, ts, glob) and key that it finds, from ``lives``; ``flushes`` (m) part the epochs.

    Each key meets each glob once, and then the listings with it in the stretch from the key's first to its last life of
    an epoch; which of its lives a listing sees is the last one that began before, not a search of all.
    """
    at = count_before(lists.select(F.col("seq").alias("at"), "ts", "glob"), flushes, "epoch", "at")
    kept = durable(holding(found, lists).select("key", "epoch", "start", "stop", "exp"))
    keys = kept.groupBy("key", "epoch").agg(F.min("start").alias("first"), F.max(F.struct(F.col("stop").isNull().alias("open"), "stop")).alias("end"))
    globs = lists.select("glob").distinct()
    pairs = match_globs(keys.select("key").distinct(), globs).join(keys, "key")
    inside = (F.col("first") < F.col("at")) & (F.col("end.open") | (F.col("at") < F.col("end.stop")))
    asked = pairs.join(at, ["glob", "epoch"]).filter(inside).select("key", "epoch", "at", "ts")
    null = lambda t: F.lit(None).cast(t)
    life = kept.select("key", "epoch", F.col("start").alias("at"), null("bigint").alias("ts"), F.struct("start", "stop", "exp").alias("life"))
    both = durable(life.union(asked.withColumn("life", null(dict(life.dtypes)["life"]))))
    seen = last_of(both, ["key", "epoch"], "at", "life").filter("ts is not null")
    return seen.filter((F.col("life.stop").isNull() | (F.col("at") < F.col("life.stop"))) & live("life.exp", F.col("ts"))).select(F.col("at").alias("seq"), "key")


def last_of(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with null ``name`` filled by its last value before; among rows of one order, values are behind. Hot groups are cut into slices."""
    n = rows.count()
    sliced = rows.withColumn("__s", slice_at([order], cut_points(rows, [order], n // SLICE_OPS + 1, n)))
    w = W.partitionBy(*by, "__s").orderBy(order, F.col(name).isNotNull())
    inside = sliced.withColumn("__i", F.last(name, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = sliced.groupBy(*by, "__s").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias("__e"))
    before = ends.select(*by, "__s", F.last("__e", ignorenulls=True).over(W.partitionBy(*by).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)).alias("__c"))
    return inside.join(before, [*by, "__s"]).withColumn(name, F.coalesce("__i", "__c")).drop("__s", "__i", "__c")
