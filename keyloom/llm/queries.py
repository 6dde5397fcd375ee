"""Queries of the training-data operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.distinct import cells, distinct_by_day_and_ops
from keyloom.llm.heavy import frequent
from keyloom.llm.leaks import find_leaks
from keyloom.llm.packing import fill_containers
from keyloom.llm.sentences import sentences
from keyloom.runtime import table

FREQUENT_SHARE = 1 / 200


def _keys_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "active").select("key", "op", F.floor(F.col("ts") / 86_400_000).alias("day"))


def p2_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated distinct keys by day, by op, by both, and by combination of ops with and without the day, with the error bound."""
    return distinct_by_day_and_ops(_keys_by_day(spark, sf_dir), "key", "day", "op")


def p2_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable partial results: the words of the bitmaps of each day and op."""
    return cells(_keys_by_day(spark, sf_dir), "key", "day", "op")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on at least 1/200 of the rows that have a key."""
    return p3_frequent_keys(spark, sf_dir).select("key")


def p3_frequent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent keys with exact counts, and the upper bound and error of the summary that found them."""
    found = frequent(table(spark, sf_dir, "active").select("key"), "key", FREQUENT_SHARE)
    return found.select(F.col("item").alias("key"), "n", "upper", "error")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's containers of 4,096 tokens."""
    return fill_containers(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items of which they hold a passage."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every sentence of every document."""
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p2_distinct_keys": p2_distinct_keys, "p2_sketches": p2_sketches, "p3_found": p3_found, "p3_frequent_keys": p3_frequent_keys, "p6_containers": p6_containers, "p7_found": p7_found, "p8_found": p8_found}
SQL = {
    "p2_sketches": """
        WITH h AS (SELECT CAST(floor(ts / 86400000.0) AS BIGINT) AS day, coalesce(op, '(null)') AS op, CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) AS h FROM active WHERE key IS NOT NULL),
        p AS (SELECT day, op, h & 4095 AS slot, h >> 12 AS g FROM h)
        SELECT day, op, least(bit_count((g & -g) - 1), 43)::INT AS level, (slot // 32)::INT AS word, bit_or(1::BIGINT << (slot % 32)) AS bit FROM p GROUP BY ALL""",
    "p3_found": """
        SELECT key FROM (SELECT key, count(*) AS n FROM active WHERE key IS NOT NULL GROUP BY key)
        WHERE n * 200 >= (SELECT count(key) FROM active)""",
}
