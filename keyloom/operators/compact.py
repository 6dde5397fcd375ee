"""Log compaction and sorted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.changes import replay
from keyloom.operators.fold import bounds, explode_ops, fold, slice_of
from keyloom.operators.lookup import newest

#: Runs that make a merge due, and most runs of one merge.
MERGE_AT, MERGE_MOST = 4, 8
_LOG = ["seq", "ts", "op", "key", "value", "valueType", "expireAt", "items", "keys"]


def _log_rows(rows: DataFrame) -> DataFrame:
    """seq, ts, op, key, value, exp as log rows; an update keeps its condition as an MUPD of one pair."""
    pair = F.when(F.col("op") == "MUPD", F.array(F.struct("key", "value")))
    one = F.col("op") != "MUPD"
    return rows.select("seq", "ts", "op", F.when(one, F.col("key")).alias("key"), F.when(one, F.col("value")).alias("value"), F.when(F.col("op") == "SET", "STRING").alias("valueType"), F.when(F.col("op") != "DEL", F.col("exp")).alias("expireAt"), pair.alias("items"), F.lit(None).cast("array<string>").alias("keys"))


def snapshot(log: DataFrame, now: int) -> DataFrame:
    """The whole log up to ``now`` as one SET for each entry; expiries are kept.

    fold(snapshot(prefix) + suffix) = fold(prefix + suffix), if no ts of the suffix is before ``now``.
    """
    high = log.agg(F.max("seq")).first()[0] or 0
    state = fold(log, now)
    return _log_rows(state.select(F.lit(high).alias("seq"), F.col("created_at").alias("ts"), F.lit("SET").alias("op"), "key", "value", F.col("expire_at").alias("exp")))


def segment(log: DataFrame) -> DataFrame:
    """One operation for each key behind the last FLUSH of a stretch of the log: key, kind (W, D, U), at, exp, value, ts, seq."""
    b = bounds(log)
    rest = log if b.flush is None else log.filter(F.col("seq") > b.flush)
    ops = explode_ops(rest).filter("kind <> 'R'").withColumn("slice", slice_of(rest, b, None)).withColumn("at", F.col("ts")).withColumn("last", F.col("seq"))
    part = replay(ops, ["key", "slice"], ["seq", "pos"], ["value", "ts", "last"])
    return replay(part, ["key"], ["slice"], ["value", "ts", "last"]).withColumnRenamed("last", "seq")


def as_log(ops: DataFrame) -> DataFrame:
    """Operations of ``segment`` as log rows; a conditional update is made at the moment at which it asks for its entry."""
    op = F.when(F.col("kind") == "W", "SET").when(F.col("kind") == "D", "DEL").otherwise("MUPD")
    return _log_rows(ops.select("seq", F.when(F.col("kind") == "U", F.col("at")).otherwise(F.col("ts")).alias("ts"), op.alias("op"), "key", "value", "exp"))


def compact_segment(log: DataFrame) -> DataFrame:
    """A stretch of the log with at most one operation for each key, and its last FLUSH.

    Deletions and conditional updates stay, as they act on what came before the stretch:
    fold(a + compact_segment(b) + c) = fold(a + b + c), but for created_at of updated entries.
    """
    last = bounds(log).flush
    kept = as_log(segment(log))
    return kept if last is None else kept.unionByName(log.filter(F.col("seq") == last).select(*_LOG))


def write_run(rows: DataFrame, path: str, files: int | None = None, compression: str = "snappy") -> None:
    """Write rows with a key as a run sorted by key, with min/max statistics and a Bloom filter on the key for point reads."""
    placed = rows.repartitionByRange(files, "key") if files else rows.repartitionByRange("key")
    writer = placed.sortWithinPartitions("key").write.mode("overwrite").option("compression", compression)
    writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", "0.01").parquet(path)


def due(runs: list) -> list:
    """The oldest runs to merge now; none while fewer than ``MERGE_AT`` wait. ``runs``: oldest first."""
    return runs[:MERGE_MOST] if len(runs) >= MERGE_AT else []


def merge_runs(runs: list[DataFrame], final: bool = True) -> DataFrame:
    """One run of several, oldest first; tombstones are dropped only where nothing older is left (``final``)."""
    if final:
        return newest(runs[::-1]).select("key", F.lit("SET").alias("op"), "value", "expire_at")
    ranked = None
    for i, r in enumerate(runs):
        one = r.select("key", "op", "value", "expire_at", F.lit(i).alias("i"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("key").agg(F.max_by(F.struct("op", "value", "expire_at"), "i").alias("x")).select("key", "x.*")
