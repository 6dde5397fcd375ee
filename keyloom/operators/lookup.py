"""Reads of a state: point and multi-point lookups, key patterns, ranges, and the joins behind writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import glob_match, value_type
from keyloom.runtime import small_side


def get(state: DataFrame, key: str) -> DataFrame:
    """value of one key; no row if it does not exist. The filter reaches the scan of a stored state."""
    return state.filter(F.col("key") == key).select("value")


def mget(state: DataFrame, probes: DataFrame, missing: str = "(nil)") -> DataFrame:
    """pos, key, value for each probe (pos, key), repeated ones too; ``missing`` where the key does not exist."""
    return small_side(probes.select("pos", "key")).join(state.select("key", "value"), "key", "left").select("pos", "key", F.coalesce("value", F.lit(missing)).alias("value"))


def exists(state: DataFrame, probes: DataFrame) -> DataFrame:
    """The probes (key) that exist, once each."""
    return probes.select("key").distinct().join(state.select("key"), "key", "left_semi")


def type_of(state: DataFrame, probes: DataFrame) -> DataFrame:
    """key, type for each distinct probe; none where the key does not exist."""
    return probes.select("key").distinct().join(state.select("key", "value"), "key", "left").select("key", F.coalesce(value_type("value"), F.lit("none")).alias("type"))


def keys(state: DataFrame, pattern: str | None = "*") -> DataFrame:
    """The keys that match a glob; null and empty patterns match all."""
    return state.filter(glob_match("key", pattern or "*")).select("key")


def size(state: DataFrame) -> DataFrame:
    """n, the number of entries."""
    return state.agg(F.count("*").alias("n"))


def key_range(state: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Entries with start <= key < end in the order of UTF-8 bytes; an open end is None."""
    low = state if start is None else state.filter(F.col("key") >= start)
    return low if end is None else low.filter(F.col("key") < end)


def without(state: DataFrame, gone: DataFrame) -> DataFrame:
    """The state after deleting the keys of ``gone``."""
    return state.join(gone.select("key"), "key", "left_anti")


def update_existing(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """The state after setting (pos, key, value) for keys that exist; the last pair of a key wins and its expiry is dropped."""
    last = pairs.groupBy("key").agg(F.max_by("value", "pos").alias("new"), F.lit(True).alias("hit"))
    return state.join(last, "key", "left").select("key", F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value"), F.when(F.col("hit"), F.lit(0)).otherwise(F.col("expire_at")).alias("expire_at"))


def rename(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, value, expire_at after renaming (old, new) at once: a moved entry loses its expiry and replaces what has the new name.

    Names that do not exist move nothing; old = new deletes the key; of several moves to one name the largest old name wins.
    """
    moved = pairs.join(state.select(F.col("key").alias("old"), "value"), "old")
    landed = moved.filter("old <> new").groupBy("new").agg(F.max_by("value", "old").alias("value")).select(F.col("new").alias("key"), "value", F.lit(0).cast("bigint").alias("expire_at"))
    gone = moved.select(F.col("old").alias("key")).union(landed.select("key"))
    return without(state.select("key", "value", "expire_at"), gone).union(landed)


def newest(runs: list[DataFrame]) -> DataFrame:
    """One state from several sources, newest first: the newest source that knows a key wins, a tombstone (op DEL) hides it.

    Each: key, op, value, expire_at.
    """
    ranked = None
    for i, r in enumerate(runs):
        one = r.select("key", "op", "value", "expire_at", F.lit(-i).alias("priority"))
        ranked = one if ranked is None else ranked.unionByName(one)
    x = F.max_by(F.struct("op", "value", "expire_at"), "priority").alias("x")
    return ranked.groupBy("key").agg(x).filter("x.op <> 'DEL'").select("key", "x.value", "x.expire_at")
