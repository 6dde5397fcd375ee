"""Sorted runs of a log: one operation for each key of a stretch of log files, sorted by key.

A run is a Parquet folder ``_runs/run-FIRST-LAST`` beside the log, named by the numbers of the log files
that it covers; a name that ends in -f tells that a FLUSH in it hides all older runs. Its rows are what
``replay`` makes of the stretch: key, kind (W, D, U), at, exp, value, ts, seq. So a state is the replay of
all runs and of the log files behind them, and a point read asks each run for one key, by statistics
and Bloom filter.

A run counts once it is complete; one whose files a larger run covers is a leftover of a merge and is
passed over. Nothing else needs to be recovered after a failure.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.exprs import live, value_type
from keyloom.operators.changes import replay
from keyloom.operators.compact import as_log, due, segment, write_run
from keyloom.operators.fold import bounds
from keyloom.sources.oplog import LAST, file_numbers, log_files, read_log

#: Bytes of log behind the runs from which on they are made a run.
FLUSH_BYTES = 16 << 20
_CARRY = ["value", "ts", "seq"]
COLUMNS = ["key", "kind", "at", "exp", *_CARRY]


class Run(NamedTuple):
    """The log files from first to last; flush: nothing older counts."""

    first: int
    last: int
    flush: bool

    @property
    def name(self) -> str:
        return f"run-{self.first:07d}-{self.last:07d}" + ("-f" if self.flush else "")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _complete(spark: SparkSession, path: str) -> list[Run]:
    fs, root = _fs(spark, f"{path}/_runs")
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    found = [(n, m) for n in names if (m := re.fullmatch(r"run-(\d+)-(\d+)(-f)?", n))]
    return [Run(int(m[1]), int(m[2]), bool(m[3])) for n, m in found if fs.exists(_fs(spark, f"{path}/_runs/{n}/_SUCCESS")[1])]


def live_runs(spark: SparkSession, path: str) -> list[Run]:
    """The runs that make up the state, oldest first."""
    every = _complete(spark, path)
    whole = sorted(r for r in every if not any(o != r and o.first <= r.first and r.last <= o.last and (o.last - o.first, o.flush) > (r.last - r.first, r.flush) for o in every))
    start = max((i for i, r in enumerate(whole) if r.flush), default=0)
    return whole[start:]


def read_run(spark: SparkSession, path: str, run: Run) -> DataFrame:
    """One run."""
    return spark.read.parquet(f"{path}/_runs/{run.name}").select(*COLUMNS)


def tail(spark: SparkSession, path: str) -> DataFrame:
    """The log behind the runs."""
    runs = live_runs(spark, path)
    return read_log(spark, path, behind=runs[-1].last if runs else -1)


def parts(spark: SparkSession, path: str, key: str | None = None) -> list[DataFrame]:
    """What is to be replayed for a state, or for one key: runs, oldest first, and the log behind them.

    The filter on a key reaches each run's scan; only the log behind the runs is read in full.
    """
    runs, log = live_runs(spark, path), tail(spark, path)
    flushed = bounds(log).flush is not None
    own = segment(log)
    every = [*([] if flushed else [read_run(spark, path, r) for r in runs]), own.select(*COLUMNS)]
    return every if key is None else [p.filter(F.col("key") == key) for p in every]


def merged(every: list[DataFrame]) -> DataFrame:
    """One operation for each key, of several parts."""
    whole = every[0]
    for p in every[1:]:
        whole = whole.unionByName(p)
    at = whole.select("key", "kind", "at", "exp", "value", "ts", F.col("seq").alias("o"), "seq")
    return replay(at, ["key"], ["o"], _CARRY)


def state(spark: SparkSession, path: str, now: int, key: str | None = None) -> DataFrame:
    """The state at ``now`` of runs and log, or one key's entry: key, value, value_type, expire_at, created_at."""
    ends = merged(parts(spark, path, key)).filter(F.col("kind") == "W").filter(live("exp", now))
    return ends.select("key", "value", value_type("value").alias("value_type"), F.coalesce("exp", F.lit(0)).alias("expire_at"), F.col("ts").alias("created_at"))


def as_base(spark: SparkSession, path: str) -> DataFrame:
    """Runs and log as one op log, a row for each key of a run."""
    runs, log = live_runs(spark, path), tail(spark, path)
    whole = log
    for r in runs:
        whole = whole.unionByName(as_log(read_run(spark, path, r)))
    return whole


def flush_tail(spark: SparkSession, path: str, compression: str = "snappy") -> Run | None:
    """Make the log behind the runs a run of its own; None if there is none. The active file is left alone."""
    runs = live_runs(spark, path)
    done = runs[-1].last if runs else -1
    new = [n for n in file_numbers(spark, path) if done < n < LAST]
    if not new:
        return None
    log = read_log(spark, path, behind=done).filter(F.col("seq") < F.lit(LAST << 42))
    run = Run(done + 1, max(new), bounds(log).flush is not None)
    write_run(segment(log).select(*COLUMNS), f"{path}/_runs/{run.name}", compression=compression)
    return run


def merge_due(spark: SparkSession, path: str, now: int, compression: str = "snappy") -> Run | None:
    """Merge the oldest runs if enough wait; None if not.

    They are the oldest part of the state, so deletions, updates of nothing and what has expired by ``now`` go.
    """
    some = due(live_runs(spark, path))
    if not some:
        return None
    run = Run(some[0].first, some[-1].last, True)
    ends = merged([read_run(spark, path, r) for r in some]).filter(F.col("kind") == "W").filter(live("exp", now))
    write_run(ends.select(*COLUMNS), f"{path}/_runs/{run.name}", compression=compression)
    forget_old(spark, path)
    return run


def forget_old(spark: SparkSession, path: str) -> None:
    """Delete runs that no longer count."""
    kept = set(live_runs(spark, path))
    for r in _complete(spark, path):
        if r not in kept:
            fs, p = _fs(spark, f"{path}/_runs/{r.name}")
            fs.delete(p, True)


def maintain(spark: SparkSession, path: str, now: int, least: int = FLUSH_BYTES, compression: str = "snappy") -> None:
    """One round of maintenance: a run of the log behind the runs, once that has ``least`` bytes, then all merges that are due."""
    runs = live_runs(spark, path)
    done = runs[-1].last if runs else -1
    waiting = sum(size for (_, size), n in zip(log_files(spark, path), file_numbers(spark, path)) if done < n < LAST)
    if waiting >= least:
        flush_tail(spark, path, compression)
    while merge_due(spark, path, now, compression):
        pass
