"""Most frequent items of a column with far more distinct values than memory can hold.

Pass 1 makes a space-saving summary of ``capacity`` counters for each input partition and merges
the summaries in a tree. A counter never undercounts, and overcounts by at most its ``error``;
what has no counter occurs at most ``floor`` times. Pass 2 counts exactly the candidates whose upper
bound reaches the threshold, of which there are at most ``capacity``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.runtime import durable

#: Summaries merged by one task of the tree.
FAN_IN = 16
_SUMMARY = "part long, item string, n long, error long, floor long, total long"


def merge_counters(frames: list[pd.DataFrame], floors: list[int], capacity: int) -> tuple[pd.DataFrame, int]:
    """One summary (item, n, error) of several, and its floor.

    An item that a summary lacks may have occurred there up to that summary's floor, so the floor is
    added to both its count and its error.
    """
    whole = sum(floors)
    parts = [f.assign(n=f["n"] - low, error=f["error"] - low) for f, low in zip(frames, floors)]
    got = pd.concat(parts).groupby("item", sort=False, as_index=False)[["n", "error"]].sum()
    got["n"] += whole
    got["error"] += whole
    if len(got) <= capacity:
        return got, whole
    got = got.sort_values(["n", "item"], ascending=[False, True], kind="stable")
    return got.iloc[:capacity], max(whole, int(got["n"].iloc[capacity]))


def _summarise(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    kept, floor, total, part = pd.DataFrame({"item": pd.Series(dtype=object), "n": pd.Series(dtype="int64"), "error": pd.Series(dtype="int64")}), 0, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(1)[0].as_py()
        counts = pc.value_counts(b.column(0).drop_null())
        new = pd.DataFrame({"item": counts.field("values").to_pandas(), "n": counts.field("counts").to_numpy(zero_copy_only=False).astype("int64")})
        new["error"] = 0
        total += int(new["n"].sum())
        kept, floor = merge_counters([kept, new], [floor, 0], capacity)
    yield _batch(kept, part, floor, total)


def _batch(kept: pd.DataFrame, part: int, floor: int, total: int) -> pa.RecordBatch:
    # the first row has no item and carries the summary's floor and total
    n = len(kept) + 1
    pad = lambda x: np.concatenate([[0], x.to_numpy(dtype="int64")])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, part)), pa.array([None, *kept["item"]], pa.string()), pa.array(pad(kept["n"])), pa.array(pad(kept["error"])), pa.array([floor] + [0] * (n - 1), pa.int64()), pa.array([total] + [0] * (n - 1), pa.int64())],
        names=["part", "item", "n", "error", "floor", "total"],
    )


def _merge_group(df: pd.DataFrame, capacity: int) -> pd.DataFrame:
    heads = df[df["item"].isna()]
    rows = df[df["item"].notna()]
    # the items of summary s without a counter there are bounded by its floor; counts of others add up
    low = heads.groupby("src")["floor"].sum()
    by_src = dict(iter(rows.groupby("src")))
    none = rows.iloc[:0]
    kept, floor = merge_counters([by_src.get(s, none)[["item", "n", "error"]] for s in low.index], [int(x) for x in low], capacity)
    out = _batch(kept, int(df["part"].iloc[0]), floor, int(heads["total"].sum())).to_pandas()
    return out[["part", "item", "n", "error", "floor", "total"]]


def summary(df: DataFrame, column: str, capacity: int) -> DataFrame:
    """The merged space-saving summary of a string column: item, n (upper bound), error (n - error is a lower bound), floor, total.

    Nulls are not counted. The row without item carries floor and total.
    """
    items = df.select(F.col(f"`{column}`").cast("string").alias("item"), F.spark_partition_id().cast("long").alias("part"))
    level = items.mapInArrow(lambda b: _summarise(b, capacity), _SUMMARY)
    parts = max(1, df.rdd.getNumPartitions())
    for _ in range(max(1, math.ceil(math.log(parts, FAN_IN)))):
        grouped = level.withColumnRenamed("part", "src").withColumn("part", F.floor(F.col("src") / FAN_IN))
        level = grouped.groupBy("part").applyInPandas(lambda d: _merge_group(d, capacity), _SUMMARY)
    return level.select("item", "n", "error", "floor", "total")


def frequent(df: DataFrame, column: str, share: float, capacity: int | None = None) -> DataFrame:
    """item, n (exact), upper, error of every value on at least ``share`` of the rows with a non-null value.

    ``capacity`` counters (10 / share unless given) must be at least 1 / share, so that none is missed.
    An empty table or a column of nulls gives no rows; empty strings are values; ties are all kept.
    """
    capacity = capacity or math.ceil(10 / share)
    if not 0 < share <= 1 or capacity < 1 / share:
        raise ValueError("share must be in (0, 1] and capacity at least 1 / share")
    spark = df.sparkSession
    kept = durable(summary(df, column, capacity))
    total = kept.agg(F.sum("total")).first()[0] or 0
    exact_share = Fraction(share).limit_denominator(10**6)
    least = -(-total * exact_share.numerator // exact_share.denominator)
    # the summary has ``capacity`` counters at most, so what is collected is bounded
    bounds = kept.filter(F.col("item").isNotNull() & (F.col("n") >= max(least, 1)))
    found = [r[0] for r in bounds.select("item").collect()]
    if not found:
        return spark.createDataFrame([], "item string, n long, upper long, error long")
    value = F.col(f"`{column}`").cast("string")
    exact = df.filter(value.isin(found)).groupBy(value.alias("item")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return exact.join(bounds.select("item", F.col("n").alias("upper"), "error"), "item").select("item", "n", "upper", "error")
