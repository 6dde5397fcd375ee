import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from keyloom.operators import fold as fold_module
from keyloom.operators.fold import count_before, fold, replies
from keyloom.operators.slices import cut_points, slice_at
from tests.logs import LOG, random_log, sequential


def sizes(df, order, slices):
    cuts = cut_points(df, order, slices)
    return cuts, sorted(r["count"] for r in df.groupBy(slice_at(order, cuts).alias("s")).count().collect())


def test_a_burst_and_a_far_off_moment_leave_slices_even(spark):
    rows = [(5, i) for i in range(3000)] + [(10**13, 3001)] + [(i, 4000 + i) for i in range(1000)]
    df = spark.createDataFrame(rows, "ts long, seq long")
    cuts, n = sizes(df, ["ts", "seq"], 50)
    assert 45 <= len(cuts) <= 49 and len(n) == len(cuts) + 1 and n[-1] < 4 * 4001 / 50
    assert sizes(df, ["seq"], 1) == ([], [4001])
    assert cut_points(df.filter("ts < 0"), ["seq"], 9) == []
    assert cut_points(spark.createDataFrame([(None, 1), (7, 1)], "ts long, seq long"), ["ts"], 3) == [(7,)]


def test_slices_follow_the_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    cuts = cut_points(df, ["a", "b"], 13)
    got = df.withColumn("s", slice_at(["a", "b"], cuts)).collect()
    assert all(r.s == bisect_right(cuts, (r.a, r.b)) for r in got)


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_count_before(spark, monkeypatch, most):
    monkeypatch.setattr(fold_module, "FLUSHES", most)
    rnd = random.Random(most)
    marks = sorted(rnd.sample(range(300), 40))
    df = spark.range(300).select(F.col("id").alias("seq"))
    got = count_before(df, spark.createDataFrame([(m,) for m in marks], "m long"), "n").collect()
    assert all(r.n == bisect_left(marks, r.seq) for r in got)
    assert {r.n for r in count_before(df, spark.createDataFrame([], "m long"), "n").collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_many_truncations_over_many_stretches(spark, monkeypatch, seed):
    monkeypatch.setattr(fold_module, "FLUSHES", 4)
    log = random_log(seed, n=200, flush=0.3)
    log = [(r[0] * 10**9 if r[0] < 150 else 10**15 + r[0], *r[1:]) for r in log]
    df = spark.createDataFrame(log, LOG)
    state, told = sequential(log, log[-1][1])
    assert {r.key: (r.value, r.expire_at, r.created_at) for r in fold(df, log[-1][1], slices=9).collect()} == state
    assert {(r.seq, r.pos): (r.existed, r.old_value) for r in replies(df, slices=9).collect()} == told
