"""Session helpers shared by all operators: tables, durable cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that may be broadcast, in rows and in bytes of its columns' text.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the cluster's shared folder from ``spark.checkpoint.dir``; only a local master gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"keyloom-checkpoints-{os.getpid()}")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which outlives any executor."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Write ``df`` once, measure it, and hint a broadcast only within both bounds.

    Beyond them the plain DataFrame comes back, so that the join is a shuffled one which
    adaptive execution may split at hot keys.
    """
    kept = durable(df)
    n, b = kept.select(F.count("*"), F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns]))))).first()
    return F.broadcast(kept) if n <= rows and (b or 0) <= size else kept


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as the session has cores; more are left as they are.

    For work of many CPU seconds a row on tables of few file splits; large tables are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
