import os
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from keyloom.llm import queries
from keyloom.llm.distinct import distinct_by_day_and_ops, estimate, merge, sketch


@pytest.mark.parametrize("n", [0, 1, 50, 5_000, 300_000])
def test_error_is_within_the_bound(spark, n):
    df = spark.range(n).select(F.concat(F.lit("key-"), "id").alias("v"), F.lit("g").alias("g"))
    got = estimate(sketch(df, "v", ["g"]), ["g"]).collect()
    assert len(got) == (1 if n else 0)
    for r in got:
        assert abs(r.n - n) <= r.bound * n and r.bound < (0.08 if n > 50 else 2)


def test_repeats_nulls_and_merging(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), None if rnd.random() < 0.1 else f"k{rnd.randint(0, 900)}") for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, v string")
    parts = sketch(df, "v", ["g"])
    whole = estimate(merge(parts.select(F.lit("all").alias("g"), "level", "word", "bit"), ["g"]), ["g"]).first()
    assert estimate(sketch(df.withColumn("g", F.lit("all")), "v", ["g"]), ["g"]).first() == whole
    exact = len({v for _, v in rows if v})
    assert abs(whole.n - exact) <= whole.bound * exact
    by = {r.g: r for r in estimate(parts, ["g"]).collect()}
    for g in "ab":
        n = len({v for h, v in rows if h == g and v})
        assert abs(by[g].n - n) <= by[g].bound * n


def exact_counts(rows):
    """Every count of (day, op, key) rows, by brute force."""
    held = defaultdict(set)
    for d, o, k in rows:
        if k is not None:
            held[d, o or "(null)"].add(k)
    ops, days = sorted({o for _, o in held}), {d for d, _ in held}
    sets = ["+".join(c) for n in range(2, len(ops) + 1) for c in combinations(ops, n)]
    take = lambda f: len(set().union(*[v for g, v in held.items() if f(*g)], set()))
    out = {("day", d, None): take(lambda x, _, d=d: x == d) for d in days} | {("op", None, o): take(lambda _, x, o=o: x == o) for o in ops}
    out |= {("day_op", d, o): len(v) for (d, o), v in held.items()}
    out |= {("ops", None, s): take(lambda _, x, s=s: x in s.split("+")) for s in sets}
    return out | {("day_ops", d, s): take(lambda y, x, s=s, d=d: y == d and x in s.split("+")) for s in sets for d in days}


def test_every_day_op_and_combination_is_within_its_bound(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 2) if rnd.random() < 0.95 else None, rnd.choice(["SET", "DEL", "set", "x", None]), f"k{rnd.randint(0, 400)}" if rnd.random() < 0.9 else None) for _ in range(5000)]
    df = spark.createDataFrame([*rows, (1, "FLUSH", None)], "day long, op string, key string")
    got = {(r.scope, r.day, r.ops): r for r in distinct_by_day_and_ops(df, "key", "day", "op").collect()}
    want = {k: n for k, n in exact_counts(rows).items() if n}
    assert set(got) == set(want)
    for k, n in want.items():
        assert abs(got[k].n - n) <= got[k].bound * n, k


def test_empty_input_and_clashing_columns(spark):
    df = spark.createDataFrame([], "day long, op string, key string, level int, bit long")
    assert distinct_by_day_and_ops(df, "key", "day", "op").collect() == []
    one = spark.createDataFrame([(1, "a", "k", 9, 9)], df.schema)
    assert sorted((r.scope, r.n) for r in distinct_by_day_and_ops(one, "key", "day", "op").collect()) == [("day", 1), ("day_op", 1), ("op", 1)]


def test_combinations_of_more_ops_than_can_be_listed(spark):
    df = spark.createDataFrame([(1, f"op{i}", "k") for i in range(63)], "day long, op string, key string")
    with pytest.raises(ValueError):
        distinct_by_day_and_ops(df, "key", "day", "op")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_the_query_against_exact_counts_of_whole_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/active.parquet").selectExpr("floor(ts / 86400000)", "op", "key").collect()]
    want = exact_counts(rows)
    got = {(r.scope, r.day, r.ops): r for r in queries.p2_distinct_keys(spark, d).collect()}
    assert set(got) == {k for k, n in want.items() if n}
    assert all(abs(got[k].n - n) <= got[k].bound * n for k, n in want.items() if n)
