"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Every input partition is sorted in place by key and order, and its rows are numbered; every
   ``chunk_rows`` numbers make a piece, so a key's rows are cut into pieces of no more than that.
2. Each (key, partition, piece) is reduced to a state and its number of rows by partial aggregation on
   the map side. Rows do not cross the network, only states do.
3. A prefix sum of the numbers over a key's pieces, in the order of partitions, gives the exact rank
   at which each piece begins among the key's rows; rank // chunk_rows is its chunk.
4. The pieces of a chunk, and then the ordered chunks of a key, are merged.

What one task gets of a key is its pieces, about one for each ``chunk_rows`` rows and input partition.
``rank_in_key`` numbers the rows themselves; both of its passes have to see the same rows in the same
partitions, so it keeps a durable copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.runtime import durable, small_side

#: Rows of a chunk: a hundredth of the table, within these bounds.
CHUNK_LEAST, CHUNK_ROWS = 1_000, 100_000
_PID, _IDX, _PIECE, _CHUNK, _RANK = "__pid", "__idx", "__piece", "__chunk", "__rank"
_LOCAL = (1 << 33) - 1


def _offsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(partition, key) -> start of the key's run in its sorted partition, rows of the key in earlier partitions.

    ``counts``: rows of each (partition, key).
    """
    placed = counts.select(
        _PID,
        *keys,
        F.coalesce(F.sum("__n").over(W.partitionBy(_PID).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
        "__n",
    )
    by_key = W.partitionBy(*keys)
    return (
        placed.withColumn("__offset", F.coalesce(F.sum("__n").over(by_key.orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(_PID, *keys, "__start", "__offset")
    )


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df``, a durable copy, with the exact 0-based rank of each row among its key's rows."""
    with_pid = df.withColumn(_PID, F.spark_partition_id())
    counts = durable(with_pid.groupBy(_PID, *keys).agg(F.count("*").alias("__n")))
    offsets = small_side(_offsets(counts, keys))
    runs = with_pid.sortWithinPartitions(*keys, *order).withColumn(_IDX, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)))
    ranked = runs.join(offsets, [_PID, *keys]).withColumn(_RANK, F.col("__offset") + F.col(_IDX) - F.col("__start"))
    return ranked.drop(_PID, _IDX, "__start", "__offset")


def chunk_states(
    df: DataFrame,
    keys: Sequence[str],
    groups: Sequence[str],
    states: dict[str, tuple[str, str]],
    order: str,
    chunk_rows: int | None = None,
) -> DataFrame:
    """One row for each (keys, groups) with the named states, whatever share of the rows one key holds.

    ``states`` maps a result name to (kind, column); kinds: min, max, sum, count, and first, last
    (the column's value at the lowest or highest ``order``). Null keys form a group of their own;
    an empty table gives no rows; ties in ``order`` are broken by the smaller (first) or larger
    (last) value, so repeated rows change nothing but count and sum. Other columns of the table
    are not read and may have any name. The result does not depend on ``chunk_rows``.
    """
    if chunk_rows is not None and chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    if unknown := {k for k, _ in states.values()} - {"min", "max", "sum", "count", "first", "last"}:
        raise ValueError(f"unknown state kinds: {sorted(unknown)}")
    if chunk_rows is None:
        chunk_rows = min(CHUNK_ROWS, max(CHUNK_LEAST, df.count() // 100))
    ks, gs = [f"__k{i}" for i in range(len(keys))], [f"__g{i}" for i in range(len(groups))]
    named = [*zip(keys, ks), *zip(groups, gs), (order, "__o"), *[(c, f"__v{i}") for i, (_, c) in enumerate(states.values())]]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in named], F.spark_partition_id().alias(_PID))
    numbered = rows.sortWithinPartitions(*ks, "__o").withColumn(_IDX, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)))
    cut = numbered.withColumn(_PIECE, F.floor(F.col(_IDX) / chunk_rows))

    def part(i: int, kind: str) -> Column:
        v, o = F.col(f"__v{i}"), F.col("__o")
        return {"min": F.min(v), "max": F.max(v), "sum": F.sum(v), "count": F.count(v), "first": F.min(F.struct(o, v)), "last": F.max(F.struct(o, v))}[kind].alias(f"__s{i}")

    def merge(i: int, kind: str) -> Column:
        s = F.col(f"__s{i}")
        return {"min": F.min(s), "max": F.max(s), "sum": F.sum(s), "count": F.sum(s), "first": F.min(s), "last": F.max(s)}[kind].alias(f"__s{i}")

    kinds = [k for k, _ in states.values()]
    pieces = cut.groupBy(*ks, _PID, _PIECE, *gs).agg(F.count("*").alias("__n"), *[part(i, k) for i, k in enumerate(kinds)])
    before = W.partitionBy(*ks).orderBy(_PID, _PIECE, *gs).rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.withColumn(_CHUNK, F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / chunk_rows))
    chunks = placed.groupBy(*ks, _CHUNK, *gs).agg(*[merge(i, k) for i, k in enumerate(kinds)])
    merged = chunks.groupBy(*ks, *gs).agg(*[merge(i, k) for i, k in enumerate(kinds)])
    value = lambda i, k: F.col(f"__s{i}").getField(f"__v{i}") if k in ("first", "last") else F.col(f"__s{i}")
    return merged.select(
        *[F.col(k).alias(c) for c, k in zip(keys, ks)],
        *[F.col(g).alias(c) for c, g in zip(groups, gs)],
        *[value(i, k).alias(name) for i, (name, (k, _)) in enumerate(states.items())],
    )


def rank_in_key(df: DataFrame, key: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank``, the exact 0-based place of each row among the rows of its (non-null) ``key``.

    The rows are range-partitioned by key and order, which splits a hot key, and numbered by offsets;
    no task ever holds a whole key. Rows without a key are left out.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.filter(F.col(key).isNotNull()).repartitionByRange(n, key, *order).sortWithinPartitions(key, *order))
    return _numbered(placed, [key], [F.col(o) for o in order]).withColumnRenamed(_RANK, "rank")
