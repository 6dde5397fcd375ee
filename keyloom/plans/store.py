"""A store: an op-log directory with the commands, reads and maintenance on it."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import collections as C
from keyloom.operators import lookup
from keyloom.operators.compact import snapshot, write_run
from keyloom.plans.session import execute
from keyloom.operators.fold import STATE
from keyloom.runtime import durable
from keyloom.sources import runs
from keyloom.sources.oplog import FIELDS, FILE, LAST, append_log, file_numbers, read_log


class Store:
    """Key-value data kept as a log of operations below ``path``.

    Every method takes the moment ``now`` in epoch milliseconds (the clock's if not given), on which
    expiries depend. Writes of one call become one stretch of the log.
    """

    def __init__(self, spark: SparkSession, path: str, leader: str | None = None) -> None:
        """``leader``: on a read-only follower, the name of the node that takes writes."""
        self.spark, self.path, self.leader = spark, path, leader

    def log(self) -> DataFrame:
        """All operations in order."""
        if not file_numbers(self.spark, self.path):
            return self.spark.createDataFrame([], f"seq bigint, {FIELDS}")
        return read_log(self.spark, self.path)

    def execute(self, lines: Sequence[str] | DataFrame, now: int | None = None) -> DataFrame:
        """seq, session, reply for command lines, or for a script DataFrame (session, seq, ts, line); writes are appended."""
        now = int(time.time() * 1000) if now is None else now
        numbers = file_numbers(self.spark, self.path)
        base = runs.as_base(self.spark, self.path) if numbers else None
        # behind every place of the files that are there; the writes make new files
        high = (max([n for n in numbers if n < LAST], default=-1) + 1) * FILE if LAST not in numbers else (LAST + 1) * FILE
        if isinstance(lines, DataFrame):
            script = lines.withColumn("seq", F.col("seq") + high + 1)
        else:
            script = self.spark.createDataFrame([("", high + 1 + i, now, x) for i, x in enumerate(lines)], "session string, seq bigint, ts bigint, line string")
        replies, writes = execute(script, self.leader, base)
        replies, writes = durable(replies), durable(writes)
        if not writes.isEmpty():
            append_log(writes.withColumn("valueType", F.lit("STRING")), self.path)
        return replies.withColumn("seq", F.col("seq") - high - 1)

    def state(self, now: int | None = None) -> DataFrame:
        """The current entries."""
        if not file_numbers(self.spark, self.path):
            return self.spark.createDataFrame([], STATE)
        return runs.state(self.spark, self.path, int(time.time() * 1000) if now is None else now)

    def get(self, key: str, now: int | None = None) -> str | None:
        """One key's value, None if it does not exist."""
        if not file_numbers(self.spark, self.path):
            return None
        row = runs.state(self.spark, self.path, int(time.time() * 1000) if now is None else now, key).first()
        return row and row.value

    def mget(self, probes: DataFrame, now: int | None = None) -> DataFrame:
        """A value for each probe (pos, key)."""
        return lookup.mget(self.state(now), probes)

    def exists(self, probes: DataFrame, now: int | None = None) -> DataFrame:
        """The probes that exist."""
        return lookup.exists(self.state(now), probes)

    def type_of(self, probes: DataFrame, now: int | None = None) -> DataFrame:
        """The probes' types."""
        return lookup.type_of(self.state(now), probes)

    def keys(self, pattern: str | None = None, now: int | None = None) -> DataFrame:
        """Keys that match a glob."""
        return lookup.keys(self.state(now), pattern)

    def collections(self, now: int | None = None) -> DataFrame:
        """Names of collections."""
        return C.names(self.state(now))

    def compact(self, to: str, now: int | None = None) -> None:
        """Write the log as one SET for each entry to the new directory ``to``, which is a store of the same state."""
        append_log(snapshot(self.log(), int(time.time() * 1000) if now is None else now), to, gzip=True)

    def maintain(self, now: int | None = None, least: int = runs.FLUSH_BYTES) -> None:
        """Make a sorted run of the log behind the runs, once that has ``least`` bytes, and merge the runs that are due."""
        runs.maintain(self.spark, self.path, int(time.time() * 1000) if now is None else now, least)

    def checkpoint(self, to: str, now: int | None = None) -> None:
        """Write the state as a run sorted by key, for point reads by other engines."""
        write_run(self.state(now), to)
