"""A follower: the state kept up to date from a stream of log files, by Structured Streaming.

Each micro-batch writes what it does to each key, a delta of one operation for each key; after ``MERGE``
batches the deltas since the last base are merged into a new base. So a batch costs what it holds, and the
state is rewritten once in a while. A batch that is run again after a failure writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.functions.exprs import live, value_type
from keyloom.operators.compact import segment
from keyloom.operators.fold import bounds
from keyloom.sources.oplog import FIELDS
from keyloom.sources.runs import COLUMNS, merged

LOG = f"seq bigint, {FIELDS}"
#: Deltas that are merged into a base.
MERGE = 16


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, state_dir: str) -> list[str]:
    """Complete folders: batch=N or batch=N-f (behind a FLUSH) for deltas, base=N for the state behind batch N."""
    fs, root = _fs(spark, state_dir)
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return [n for n in names if fs.exists(_fs(spark, f"{state_dir}/{n}/_SUCCESS")[1])]


def _number(name: str) -> int:
    return int(name.split("=")[1].removesuffix("-f"))


def _parts(spark: SparkSession, state_dir: str, batch: int) -> list[str]:
    """The folders that make up the state behind a batch, oldest first; an error if one is lost."""
    names = _names(spark, state_dir)
    deltas = {_number(n): n for n in names if n.startswith("batch=") and _number(n) <= batch}
    start = max([_number(n) for n in names if n.startswith("base=") and _number(n) <= batch], default=-1)
    flush = max([k for k, n in deltas.items() if n.endswith("-f")], default=-1)
    first = max(start + 1, flush)
    lost = [k for k in range(first, batch + 1) if k not in deltas]
    if lost:
        raise FileNotFoundError(f"{state_dir} lacks the batches {lost}; the state cannot be told without them")
    return [*([f"base={start}"] if start >= 0 and flush <= start else []), *[deltas[k] for k in range(first, batch + 1)]]


def _state(spark: SparkSession, state_dir: str, batch: int) -> DataFrame:
    every = [spark.read.parquet(f"{state_dir}/{n}").select(*COLUMNS) for n in _parts(spark, state_dir, batch)]
    return merged(every).filter("kind = 'W'").select(*COLUMNS)


def follow(spark: SparkSession, log_dir: str, state_dir: str, checkpoint_dir: str, once: bool = False, files: int = 64) -> StreamingQuery:
    """Apply the JSON log files that arrive in ``log_dir`` (with seq rising over batches) to the state below ``state_dir``.

    A file's lines that do not parse are skipped. ``once`` ends the query when all present files are
    applied. A batch takes ``files`` files at most. A batch fails if one before it is lost.
    """
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).json(log_dir)

    def apply(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        new = batch.filter(F.col("op").isNotNull() & F.col("ts").isNotNull())
        if number:
            _parts(own, state_dir, number - 1)
        name = f"batch={number}" + ("-f" if bounds(new).flush is not None else "")
        segment(new).select(*COLUMNS).write.mode("overwrite").parquet(f"{state_dir}/{name}")
        if number % MERGE == MERGE - 1:
            _state(own, state_dir, number).write.mode("overwrite").parquet(f"{state_dir}/base={number}")
            # the base before is kept for readers of the last batches
            for n in _names(own, state_dir):
                if _number(n) < number - MERGE or (n.startswith("batch=") and _number(n) <= number - MERGE):
                    fs, p = _fs(own, f"{state_dir}/{n}")
                    fs.delete(p, True)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_batch(spark: SparkSession, state_dir: str) -> int:
    """The number of the last batch that is complete; -1 if there is none."""
    return max([_number(n) for n in _names(spark, state_dir) if n.startswith("batch=")], default=-1)


def current(spark: SparkSession, state_dir: str, batch: int, now: int) -> DataFrame:
    """The follower's state after a batch, at ``now``: key, value, value_type, expire_at, created_at."""
    ends = _state(spark, state_dir, batch).filter(live("exp", now))
    return ends.select("key", "value", value_type("value").alias("value_type"), F.coalesce("exp", F.lit(0)).alias("expire_at"), F.col("ts").alias("created_at"))
