"""Operation logs: their schema, reading and writing JSON-lines files, cluster configuration files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.runtime import small_side

#: A log line as it is written; seq is ours, the rest are the names in the files.
FIELDS = "op string, key string, value string, valueType string, expireAt bigint, ts bigint, items array<struct<key string, value string>>, keys array<string>"
OPS = ["SET", "DEL", "MSET", "MDEL", "MUPD", "FLUSH"]
#: Characters after which a log file is full.
ROTATE = 64 << 20
#: Places that seq leaves to each file, and the number of the active file, behind all rotated ones.
FILE, LAST = 1 << 42, 1 << 20
NODE = "nodeId string, clusterPort int, peers array<struct<nodeId string, host string, port int, clusterPort int>>"


def decode(line: Column) -> Column:
    """A line's operation; null for blank, cut or foreign lines and for unknown ops."""
    op = F.from_json(line, FIELDS, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(line).isNotNull() & op.op.isin(*OPS), op)


def file_rank(path: Column) -> Column:
    """Order of log files: rotated ones by number (whatever their width and suffix), the active one last."""
    name = F.element_at(F.split(path, "/"), -1)
    number = F.regexp_extract(name, r"(\d+)", 1).try_cast("decimal(38,0)")
    return F.struct(name.startswith("active.").alias("active"), number.alias("number"), name.alias("name"))


def read_log(spark: SparkSession, path: str, behind: int = -1) -> DataFrame:
    """All operations of a log directory with seq, their place in the log: file order, then line order.

    Plain and compressed files are read; lines that do not decode are skipped. seq is packed from the
    file's place and the byte order of lines; it rises through the log but has gaps. With ``behind``,
    only rotated files of a higher number and the active one are read, and may be none.
    """
    text = spark.read.schema("value string").option("pathGlobFilter", "*.jsonl*").text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    # a line's place in its file: splits of one file come in the order of their offsets
    lines = text.select(name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), decode(F.col("value")).alias("o"))
    if behind >= 0:
        lines = lines.filter(file_number(F.col("file")) > behind)
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    place = lambda f: (f * F.lit(FILE) + F.col("block") + within).alias("seq")
    numbers = [_number(f.rsplit("/", 1)[-1]) for f in text.inputFiles()]
    if None not in numbers and len(set(numbers)) == len(numbers):
        return lines.filter("o is not null").select(place(file_number(F.col("file"))), "o.*")
    # names without numbers of their own: a row for each file
    files = lines.select("file").distinct().select("file", F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(file_rank(F.col("file")))).alias("f"))
    return lines.filter("o is not null").join(small_side(files), "file").select(place(F.col("f")), "o.*")


def _number(name: str) -> int | None:
    """The number of a rotated file, LAST for an active one, None for other names."""
    m = re.match(r"rotated-(\d{1,6})\.jsonl", name)
    return int(m.group(1)) if m else LAST if name.startswith("active.jsonl") else None


def file_number(name: Column) -> Column:
    """The same of a column."""
    return F.when(name.startswith("active.jsonl"), F.lit(LAST)).otherwise(F.regexp_extract(name, r"^rotated-(\d{1,6})\.jsonl", 1).try_cast("bigint"))


def lines_of(ops: DataFrame) -> DataFrame:
    """The log lines of operations, each with its op's own fields only, in ``value``."""
    o = F.struct(*[F.col(c) for c in ("op", "key", "value", "valueType", "expireAt", "ts", "items", "keys")])
    by_op = {"SET": ["op", "key", "value", "valueType", "expireAt", "ts"], "DEL": ["op", "key", "ts"], "MSET": ["op", "items", "expireAt", "ts"], "MUPD": ["op", "items", "expireAt", "ts"], "MDEL": ["op", "keys", "ts"], "FLUSH": ["op", "ts"]}
    text = F.lit(None).cast("string")
    for op, fields in by_op.items():
        text = F.when(F.col("op") == op, F.to_json(F.struct(*[o.getField(f).alias(f) for f in fields]), {"ignoreNullFields": "false"})).otherwise(text)
    return ops.select(text.alias("value")).filter("value is not null")


def log_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files of a log directory; none if it does not exist."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = fs.listStatus(root) if fs.exists(root) else []
    return [(f.getPath().getName(), f.getLen()) for f in listed if f.isFile() and ".jsonl" in f.getPath().getName()]


def file_numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of ``log_files``; a file without one counts as active."""
    return [LAST if (n := _number(f)) is None else n for f, _ in log_files(spark, path)]


def append_log(ops: DataFrame, path: str, gzip: bool = False, rotate: int = ROTATE) -> int:
    """Append operations to a log directory as rotated-N.jsonl files that follow each other in seq order; the next free N.

    A new file begins after about ``rotate`` characters. The log is range-partitioned by seq, so that each
    file is a stretch of it, small enough to be one task's work even if compressed; numbers go on behind
    the files that are there.
    """
    spark = ops.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    first = max([n + 1 for f, _ in log_files(spark, path) if (n := _number(f)) is not None and n < LAST], default=0)
    size = lines_of(ops).agg(F.sum(F.length("value") + 1)).first()[0]
    if not size:
        return first
    fresh = f"{path}/_new-{uuid.uuid4().hex}"
    placed = ops.repartitionByRange(-(-size // rotate), "seq").sortWithinPartitions("seq")
    lines_of(placed).write.option("compression", "gzip" if gzip else "none").text(fresh)
    parts = sorted(f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(fresh)) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(parts):
        to = f"{path}/rotated-{first + i:03d}.jsonl" + (".gz" if gzip else "")
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{fresh}/{name}"), jvm.org.apache.hadoop.fs.Path(to))
    fs.delete(jvm.org.apache.hadoop.fs.Path(fresh), True)
    return first + len(parts)


def read_cluster(spark: SparkSession, path: str) -> DataFrame:
    """Cluster configuration: one row for each JSON file."""
    return spark.read.schema(NODE).option("multiLine", True).json(path)


def cluster_links(nodes: DataFrame) -> DataFrame:
    """nodeId, peer, host, port, clusterPort: a row for each peer of each node; a missing port counts as 0 and an empty list gives none."""
    peer = nodes.select("nodeId", F.explode("peers").alias("p"))
    return peer.select("nodeId", F.col("p.nodeId").alias("peer"), "p.host", F.coalesce("p.port", F.lit(0)).alias("port"), F.coalesce("p.clusterPort", F.lit(0)).alias("clusterPort"))
