"""Applying a change feed: inserts, updates and deletes, repeated and out of order.

Per-key ordered replay. Copies of one change (same scope and sequence number) become one change at
its earliest time, so an already applied sequence is skipped; fields that one copy lost come from
the earliest copy that has them (partial columns). Every change is then taken apart into key
operations, which are partitioned by (scope, key, time slice), sorted by (time, sequence) and run
through a small state machine:

* W (write) sets the entry, D (delete) removes it;
* U (update) replaces the entry only if it exists at the update's own time.

The run of a slice is itself one operation (its last W or D with the updates after it, or, without
any, a conditional U), so slices are composed by the same machine. Slices split a hot key over
tasks; windows stream and spill, so no group has to fit into memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.operators.slices import cut_points, slice_at
from keyloom.runtime import small_side

#: There is a time slice for this many rows of the feed, so that a hot key spreads over as many tasks.
SLICE_ROWS = 1_000_000
_KINDS = {"SET": "W", "MSET": "W", "DEL": "D", "MDEL": "D", "MUPD": "U"}


def merged_changes(feed: DataFrame, scope: str = "nodeId") -> DataFrame:
    """One row for each (scope, seq): lowest ts, and op, touched keys and expireAt; each field is from the earliest copy that has it."""
    rows = feed.filter(F.col(scope).isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull()).select(
        F.col(scope).alias("scope"), "seq", "ts", "line_id", "op", "key", F.col("items.key").alias("items"), "keys", F.col("expireAt").alias("exp")
    )
    # partitioned first, so that the aggregation sorts once and needs no second exchange
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_id"))).alias(c)
    whole = rows.repartition("scope", "seq").groupBy("scope", "seq").agg(F.min("ts").alias("ts"), *[first(c) for c in ("op", "key", "items", "keys", "exp")])
    touched = F.when(F.col("op").isin("SET", "DEL"), F.array("key")).when(F.col("op").isin("MSET", "MUPD"), F.col("items")).when(F.col("op") == "MDEL", F.col("keys"))
    return whole.select("scope", "seq", "ts", "op", F.array_distinct(F.filter(touched, lambda k: k.isNotNull())).alias("touched"), "exp")


def scopes(feed: DataFrame, scope: str = "nodeId") -> DataFrame:
    """For each scope: the highest time of any of its rows, their number, and (ts, seq) of its last FLUSH, merged like any change."""
    rows = feed.filter(F.col(scope).isNotNull() & F.col("ts").isNotNull()).select(F.col(scope).alias("scope"), "ts", "seq", "op", "line_id")
    span = rows.groupBy("scope").agg(F.max("ts").alias("now"), F.count("*").alias("rows"))
    # copies without an op may be the earliest ones of a FLUSH
    marked = small_side(rows.filter((F.col("op") == "FLUSH") & F.col("seq").isNotNull()).select("scope", "seq").distinct())
    copies = rows.join(marked, ["scope", "seq"], "left_semi").groupBy("scope", "seq").agg(F.min("ts").alias("ts"), F.min_by("op", F.when(F.col("op").isNotNull(), F.col("line_id"))).alias("op"))
    flush = copies.filter("op = 'FLUSH'").groupBy("scope").agg(F.max(F.struct("ts", "seq")).alias("flush"))
    return span.join(flush, "scope", "left")


def replay(ops: DataFrame, by: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """One operation for each group, equal to running the group's operations in order.

    ``ops``: by, order, kind (W, D, U), at (the time at which an update asks for the entry), exp, and the
    columns to ``carry`` from the last operation that took effect. Result: by, kind, at, exp, carry.
    """
    w = W.partitionBy(*by).orderBy(*order)
    seg = ops.withColumn("seg", F.sum(F.when(F.col("kind") == "U", 0).otherwise(1)).over(w))
    # a deleted entry is one that expired at the start of time; a group that opens with an update trusts it
    left = F.lag(F.when(F.col("kind") == "D", F.lit(1)).otherwise(F.coalesce("exp", F.lit(0)))).over(W.partitionBy(*by, "seg").orderBy(*order))
    ok = (F.col("kind") != "U") | left.isNull() | (left <= 0) | (F.col("at") < left)
    alive = seg.withColumn("ok", ok).withColumn("ok", F.min("ok").over(W.partitionBy(*by, "seg").orderBy(*order))).filter("ok")
    last = F.max_by(F.struct("seg", "kind", "exp", *carry, *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]), F.struct(*order))
    out = alive.groupBy(*by).agg(last.alias("x"), F.min(F.when(F.col("seg") == 0, F.struct(*order, "at"))).alias("head"))
    kind = F.when(F.col("x.seg") == 0, F.lit("U")).when(F.col("x.kind") == "D", F.lit("D")).otherwise(F.lit("W"))
    return out.select(*by, kind.alias("kind"), F.col("head.at").alias("at"), "x.exp", *[f"x.{c}" for c in carry])


def current_entries(feed: DataFrame, scope: str = "nodeId", slices: int | None = None) -> DataFrame:
    """The entries (scope, key, seq, expireAt) that exist in each scope at the scope's highest ``ts``.

    ``feed``: line_id, seq, ts, op, key, items, keys, expireAt and the scope column; others are not read.
    Rows without scope, seq or ts are no changes, though a row with a ts counts for the highest one.
    Ops other than SET, DEL, MSET, MDEL, MUPD, FLUSH in exactly this spelling, null keys and null or
    empty lists do nothing. An empty feed gives no rows. Two changes of a scope at one ts go by seq;
    a key repeated inside one change is touched once. FLUSH empties the scope, so only changes after
    the last one matter.
    """
    spans = small_side(scopes(feed, scope))
    n = spans.agg(F.sum("rows")).first()[0] or 0
    slices = slices or n // SLICE_ROWS + 1
    changes = merged_changes(feed, scope).filter(F.col("op").isin(*_KINDS)).join(spans, "scope")
    later = changes.filter(F.col("flush").isNull() | (F.struct("ts", "seq") > F.col("flush")))
    # equal numbers of rows, whatever times a burst or a wrong clock gives them
    cuts = cut_points(feed, ["ts", "seq"], slices, n)
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("op")]
    ops = later.select(
        "scope",
        F.explode("touched").alias("key"),
        slice_at(["ts", "seq"], cuts).alias("slice"),
        "ts",
        "seq",
        kind.alias("kind"),
        F.col("ts").alias("at"),
        "exp",
    )
    by_slice = replay(ops, ["scope", "key", "slice"], ["ts", "seq"], ["seq"])
    ends = replay(by_slice, ["scope", "key"], ["slice"], ["seq"]).filter("kind = 'W'")
    live = ends.join(spans.select("scope", "now"), "scope").filter("exp is null or exp <= 0 or now < exp")
    return live.select(F.col("scope").alias(scope), "key", "seq", F.col("exp").alias("expireAt"))
