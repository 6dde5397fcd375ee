import random
from collections import defaultdict

import pytest

from keyloom.operators.chunks import chunk_states, rank_in_key


def brute(rows):
    out = defaultdict(list)
    for k, g, o, v in rows:
        out[k, g].append((o, v))
    return sorted(((k, g, min(o for o, _ in x), max(o for o, _ in x), len(x), min(x)[1], max(x)[1]) for (k, g), x in out.items()), key=str)


def found(df, chunk):
    states = {"lo": ("min", "o"), "hi": ("max", "o"), "n": ("count", "o"), "a": ("first", "v"), "z": ("last", "v")}
    return sorted((tuple(r) for r in chunk_states(df, ["k"], ["g"], states, "o", chunk).collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 7, 50, 100_000])
def test_equal_to_brute_force_with_a_hot_key(spark, tmp_path, chunk):
    rnd = random.Random(chunk)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b ", "B", "", None, "é"]), rnd.randint(0, 2), i, rnd.choice("xyz")) for i in range(600)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "k string, g int, o long, v string").repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert found(df, chunk) == brute(rows)


def test_empty_ties_and_clashing_columns(spark):
    schema = "k string, g int, o long, v string, __pid string, __chunk int, rank int"
    assert found(spark.createDataFrame([], schema), 5) == []
    rows = [("k", 1, 5, "b", "x", 1, 1), ("k", 1, 5, "a", "x", 1, 1), ("k", 1, 5, "b", "x", 1, 1)]
    assert found(spark.createDataFrame(rows, schema), 2) == [("k", 1, 5, 5, 3, "a", "b")]


def test_no_row_is_shuffled_and_no_side_is_broadcast(spark, tmp_path):
    spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k", "1 as g", "id as o", "'v' as v").write.parquet(str(tmp_path / "t"))
    df = chunk_states(spark.read.parquet(str(tmp_path / "t")), ["k"], ["g"], {"n": ("count", "o")}, "o", 100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert "partial_count" in below and "Join" not in plan and plan.count("Exchange") == 2
    assert {r.k: r.n for r in df.collect()}["hot"] == 1667


def test_null_and_float_keys(spark):
    rows = [(None, 1), (float("nan"), 2), (0.5, 3), (None, 4), (float("nan"), 5)]
    got = chunk_states(spark.createDataFrame(rows, "k double, o long"), ["k"], [], {"a": ("min", "o"), "n": ("count", "o")}, "o", 1).collect()
    assert sorted((str(r.k), r.a, r.n) for r in got) == [("0.5", 3, 1), ("None", 1, 2), ("nan", 2, 2)]


def test_bad_arguments(spark):
    df = spark.createDataFrame([], "k string, g int, o long, v string")
    with pytest.raises(ValueError):
        chunk_states(df, ["k"], ["g"], {"x": ("min", "o")}, "o", 0)
    with pytest.raises(ValueError):
        chunk_states(df, ["k"], ["g"], {"x": ("median", "o")}, "o")


def test_rank_in_key(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), i) for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1)], "k string, o int")
    want = {(k, o): sum(1 for k2, o2 in rows if k2 == k and o2 < o) for k, o in rows}
    assert {(r.k, r.o): r.rank for r in rank_in_key(df, "k", ["o"], 6).collect()} == want
