"""From an ordered operation log to the current state, and to each operation's reply.

A log is a DataFrame with seq (unique order), ts (never falling with seq), op, key, value, expireAt,
items and keys. An expired entry does not exist for any operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.exprs import live, value_type
from keyloom.operators.changes import replay
from keyloom.operators.slices import cut_points, search, slice_at
from keyloom.runtime import small_side

#: A log is cut into slices of about this many operations; a key's run in a slice is no longer, so hot keys spread over tasks.
SLICE_OPS = 500_000
#: Truncations of a stretch of the log that knows how many came before it.
FLUSHES = 1024
STATE = "key string, value string, value_type string, expire_at bigint, created_at bigint"


def explode_ops(log: DataFrame) -> DataFrame:
    """One row for each key that an operation touches: seq, pos, ts, kind (W, D, U; R for reads), key, value, exp.

    FLUSH touches no key and gives no row; null keys are left out. MSET and MUPD keep repeated keys, in order.
    """
    pairs = F.when(F.col("op").isin("SET"), F.array(F.struct(F.col("key"), F.col("value")))).when(F.col("op").isin("MSET", "MUPD"), F.col("items"))
    gone = F.when(F.col("op").isin("DEL", "GET", "EXISTS", "TYPE"), F.array("key")).when(F.col("op").isin("MDEL", "MGET"), F.col("keys"))
    both = F.coalesce(pairs, F.transform(gone, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value"))))
    kind = F.when(F.col("op").isin("SET", "MSET"), "W").when(F.col("op").isin("DEL", "MDEL"), "D").when(F.col("op") == "MUPD", "U").when(F.col("op").isin("GET", "EXISTS", "TYPE", "MGET"), "R")
    rows = log.filter(kind.isNotNull()).select("seq", "ts", "op", kind.alias("kind"), F.coalesce("expireAt", F.lit(0)).alias("exp"), F.posexplode(both).alias("pos", "kv"))
    return rows.select("seq", "pos", "ts", "op", "kind", "kv.key", "kv.value", "exp").filter("key is not null")


def bounds(log: DataFrame):
    """n, low and high seq, and seq of the last FLUSH of a log."""
    return log.agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.max(F.when(F.col("op") == "FLUSH", F.col("seq"))).alias("flush")).first()


def slice_of(log: DataFrame, b, slices: int | None) -> Column:
    """The slice of a row by its seq; the slices of ``log``, of bounds ``b``, hold about as many operations each."""
    return slice_at(["seq"], cut_points(log, ["seq"], slices or b.n // SLICE_OPS + 1, b.n))


def fold(log: DataFrame, now: int, slices: int | None = None) -> DataFrame:
    """The state at ``now``, which is not before any ts: key, value, value_type, expire_at, created_at.

    An empty log gives no rows; extra columns of the log are not read. The type is inferred from the value.
    """
    b = bounds(log)
    later = log if b.flush is None else log.filter(F.col("seq") > b.flush)
    ops = explode_ops(later).filter("kind <> 'R'")
    sliced = ops.withColumn("slice", slice_of(later, b, slices)).withColumn("at", F.col("ts"))
    part = replay(sliced, ["key", "slice"], ["seq", "pos"], ["value", "ts"])
    ends = replay(part, ["key"], ["slice"], ["value", "ts"]).filter("kind = 'W'")
    return ends.filter(live("exp", now)).select("key", "value", value_type("value").alias("value_type"), F.col("exp").alias("expire_at"), F.col("ts").alias("created_at"))


def count_before(rows: DataFrame, marks: DataFrame, name: str, at: str = "seq") -> DataFrame:
    """``rows`` with ``name``, the number of ``marks`` (a column m, no nulls) below the row's ``at``.

    The marks are kept in stretches that know the number of marks before them; a row finds its stretch,
    and its place there, by binary search.
    """
    n = marks.count()
    if not n:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    cuts = cut_points(marks, ["m"], n // FLUSHES + 1, n)
    held = marks.groupBy(slice_at(["m"], cuts).alias("__s")).agg(F.sort_array(F.collect_list("m")).alias("__m"))
    every = rows.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__s")).join(held, "__s", "left")
    every = every.withColumn("__m", F.coalesce("__m", F.array().cast(dict(held.dtypes)["__m"]))).withColumn("__n", F.size("__m"))
    # a row for each stretch, SLICES at most
    before = F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = small_side(every.withColumn("__b", before))
    most = known.agg(F.max("__n")).first()[0]
    found = rows.withColumn("__s", slice_at([at], cuts)).join(known, "__s")
    inside = search(F.col("__m"), F.col("__n"), F.col(at), most, lambda a, b: a < b)
    return found.withColumn(name, F.col("__b") + inside).drop("__s", "__m", "__n", "__b")


def with_epoch(rows: DataFrame, log: DataFrame, b) -> DataFrame:
    """``rows`` with epoch, the number of FLUSHes of ``log`` (of bounds ``b``) before their seq."""
    if b.flush is None:
        return rows.withColumn("epoch", F.lit(0).cast("bigint"))
    return count_before(rows, log.filter("op = 'FLUSH'").select(F.col("seq").alias("m")), "epoch")


def _running(ops: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``ops`` with prev (kind, exp, value): the last operation of the group that took effect before the row.

    kind R (a read) takes no effect; what a group opens with is known to it, so an update at its start finds nothing.
    """
    w = W.partitionBy(*by).orderBy(*order)
    seg = ops.withColumn("seg", F.sum(F.when(F.col("kind").isin("W", "D"), 1).otherwise(0)).over(w))
    mark = F.when(F.col("kind") == "D", F.lit(1)).when(F.col("kind") != "R", F.coalesce("exp", F.lit(0)))
    in_seg = W.partitionBy(*by, "seg").orderBy(*order)
    left = F.last(mark, ignorenulls=True).over(in_seg.rowsBetween(W.unboundedPreceding, -1))
    ok = F.when(F.col("kind") == "U", (left <= 0) | (F.col("at") < left))
    chained = seg.withColumn("ok", ok).withColumn("ok", F.min("ok").over(in_seg))
    took = F.col("kind").isin("W", "D") | ((F.col("kind") == "U") & (F.col("seg") > 0) & F.coalesce("ok", F.lit(False)))
    prev = F.last(F.when(took, F.struct("kind", "exp", "value")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return chained.withColumn("prev", prev).drop("seg", "ok")


def replies(log: DataFrame, slices: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """What each touched key looked like before its operation: seq, pos, ts, op, kind, key, value, exp, existed, old_value, epoch.

    ``existed``: the key was there; ``old_value``: its value then, null if it was not. For DEL, MDEL and
    MUPD ``existed`` is also whether the operation took effect; for reads it is the answer; ``epoch`` counts the FLUSHes before. Slices of a
    key are given the state that the slices before them leave, so a hot key is spread over tasks. With
    ``only`` (key), no other keys are looked at.
    """
    b = bounds(log)
    slices = slices or b.n // SLICE_OPS + 1
    every = explode_ops(log)
    asked = every if only is None else every.join(small_side(only.select("key").distinct()), "key", "left_semi")
    ops = with_epoch(asked, log, b).withColumn("slice", slice_of(log, b, slices)).withColumn("at", F.col("ts"))
    by, order = ["key", "epoch", "slice"], [F.col("seq").asc_nulls_first(), F.col("pos")]
    if slices > 1:
        part = replay(ops.filter("kind <> 'R'"), by, ["seq", "pos"], ["value"])
        touched = ops.select(*by).distinct().join(part, by, "left").withColumn("kind", F.coalesce("kind", F.lit("R")))
        start = _running(touched, ["key", "epoch"], [F.col("slice")]).filter("prev is not null")
        null = lambda t: F.lit(None).cast(t)
        head = start.select(null("bigint").alias("seq"), F.lit(-1).alias("pos"), null("bigint").alias("ts"), null("string").alias("op"), F.when(F.col("prev.kind") == "D", "D").otherwise("W").alias("kind"), "key", F.col("prev.value").alias("value"), F.col("prev.exp").alias("exp"), "epoch", "slice", null("bigint").alias("at"))
        ops = ops.select(*head.columns).union(head)
    seen = _running(ops, by, order).filter("pos >= 0")
    existed = F.coalesce((F.col("prev.kind") != "D") & ((F.coalesce("prev.exp", F.lit(0)) <= 0) | (F.col("ts") < F.col("prev.exp"))), F.lit(False))
    return seen.withColumn("existed", existed).select("seq", "pos", "ts", "op", "kind", "key", "value", "exp", "existed", F.when(F.col("existed"), F.col("prev.value")).alias("old_value"), "epoch")


def op_counts(log: DataFrame) -> DataFrame:
    """seq, op, n for DEL, MDEL and MUPD: keys removed, or pairs applied; 0 where a list is null or empty."""
    n = replies(log).filter(F.col("kind").isin("D", "U")).groupBy("seq").agg(F.sum(F.col("existed").cast("bigint")).alias("n"))
    ops = log.filter(F.col("op").isin("DEL", "MDEL", "MUPD")).select("seq", "op")
    return ops.join(n, "seq", "left").select("seq", "op", F.coalesce("n", F.lit(0)).alias("n"))
