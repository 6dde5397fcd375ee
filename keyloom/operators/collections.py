"""Collections: namespaces made by the key prefix before the first colon, and by declaration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import META_KEY, collection_of, glob_match


def declared(state: DataFrame) -> DataFrame:
    """name of each declared collection, kept as a JSON list under the meta key."""
    meta = state.filter(F.col("key") == META_KEY)
    return meta.select(F.explode(F.from_json("value", "array<string>")).alias("name")).filter("name is not null").distinct()


def names(state: DataFrame) -> DataFrame:
    """All collections, declared or seen as a prefix of a key, in order of name."""
    seen = state.select(collection_of("key").alias("name")).filter("name is not null")
    return declared(state).union(seen).distinct().orderBy("name")


def counts(state: DataFrame) -> DataFrame:
    """name, n for the collections that have keys."""
    return state.groupBy(collection_of("key").alias("name")).agg(F.count("*").alias("n")).filter("name is not null")


def create_errors(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, error for each wanted name; null where it can be created."""
    taken = names(state).select("name", F.lit(True).alias("taken"))
    bad = F.when(F.col("name").contains(":"), "collection name cannot contain ':'")
    full = F.when((F.col("name") == "") | F.col("taken"), F.concat(F.lit("collection already exists: "), "name"))
    return wanted.select("name").distinct().join(taken, "name", "left").select("name", F.coalesce(bad, full).alias("error"))


def create(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """The meta row (key, value) after declaring the wanted names that can be created."""
    ok = create_errors(state, wanted).filter("error is null").select("name")
    every = declared(state).union(ok).distinct()
    return every.agg(F.array_sort(F.collect_list("name")).alias("l")).select(F.lit(META_KEY).alias("key"), F.to_json("l").alias("value"))


def drop(state: DataFrame, name: str) -> DataFrame:
    """The state's keys after dropping a collection; the name is a glob, so * drops every prefixed key. The meta row stays."""
    return state.filter(~glob_match("key", f"{name}:*"))


def dropped(state: DataFrame, name: str) -> DataFrame:
    """n, the number of keys that dropping a collection deletes."""
    return state.filter(glob_match("key", f"{name}:*")).agg(F.count("*").alias("n"))
