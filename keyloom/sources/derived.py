"""Key-value inputs derived from the driver tables, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.runtime import table

_NO_ITEMS = "array<struct<key:string,value:string>>"
#: Which events are a FLUSH: every 4,000th, so that replies cross many, or one early one, so that at every size the state comes from most of the log.
MANY, EARLY = "event_id % 4000 = 3999", "event_id = 99"


def _events(spark: SparkSession, sf_dir: str, flush: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), ms.alias("ts"), F.when(F.expr(flush), "flush").otherwise(F.col("event_type")).alias("kind"), "user_id", "value", "props")


def event_log(spark: SparkSession, sf_dir: str, view: str = "MUPD", flush: str = MANY) -> DataFrame:
    """An op log from events: signup, purchase (with a time to live) and click set, view updates (or is read, with ``view`` GET), error deletes."""
    e = _events(spark, sf_dir, flush)
    key, tag = F.concat(F.lit("user:"), "user_id"), F.col("seq").cast("string")
    op = F.when(F.col("kind").isin("signup", "purchase", "click"), "SET").when(F.col("kind") == "view", view).when(F.col("kind") == "error", "DEL").when(F.col("kind") == "flush", "FLUSH")
    value = F.when(F.col("kind") == "signup", F.col("props")).when(F.col("kind") == "purchase", F.concat(F.lit("p"), tag)).when(F.col("kind") == "click", F.concat(F.lit('["c'), tag, F.lit('"]')))
    updated = F.when((F.col("kind") == "view") & F.lit(view == "MUPD"), F.array(F.struct(key.alias("key"), F.concat(F.lit("v"), tag).alias("value"))))
    exp = F.when(F.col("kind") == "purchase", F.col("ts") + F.floor("value").cast("bigint") * 1_000_000).otherwise(F.lit(0))
    return e.select("seq", "ts", op.alias("op"), F.when(op.isin("SET", "DEL", "GET"), key).alias("key"), value.alias("value"), exp.cast("bigint").alias("expireAt"), updated.cast(_NO_ITEMS).alias("items"), F.lit(None).cast("array<string>").alias("keys"))


def bulk_log(spark: SparkSession, sf_dir: str, flush: str = MANY) -> DataFrame:
    """An op log of bulk operations from events: signup and click MSET two neighbouring keys, purchase sets, view MUPDs two pairs, error MDELs with a repeated key."""
    e = _events(spark, sf_dir, flush)
    one, two, tag = F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("user:"), F.col("user_id") + 1), F.col("seq").cast("string")
    op = F.when(F.col("kind").isin("signup", "click"), "MSET").when(F.col("kind") == "purchase", "SET").when(F.col("kind") == "view", "MUPD").when(F.col("kind") == "error", "MDEL").when(F.col("kind") == "flush", "FLUSH")
    pair = lambda k, p: F.struct(k.alias("key"), F.concat(F.lit(p), tag).alias("value"))
    items = F.when(op.isin("MSET", "MUPD"), F.array(pair(one, "a"), pair(two, "b"), pair(one, "c")))
    exp = F.when(op == "SET", F.col("ts") + F.floor("value").cast("bigint") * 1_000_000).otherwise(F.lit(0))
    return e.select("seq", "ts", op.alias("op"), F.when(op == "SET", one).alias("key"), F.when(op == "SET", F.concat(F.lit("p"), tag)).alias("value"), exp.cast("bigint").alias("expireAt"), items.cast(_NO_ITEMS).alias("items"), F.when(op == "MDEL", F.array(one, two, one)).alias("keys"))


def end_of(log: DataFrame) -> int:
    """A moment behind the log."""
    return (log.agg(F.max("ts")).first()[0] or 0) + 1


def customer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state from customers: key segment:custkey, value the name, no expiry."""
    return table(spark, sf_dir, "customer").select(F.concat_ws(":", "c_mktsegment", "c_custkey").alias("key"), F.col("c_name").alias("value"), F.lit(0).cast("bigint").alias("expire_at"))


def user_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe (pos, key) for each customer number."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("user:"), "c_custkey").alias("key"))
