import random
import re
import time

from keyloom.operators.listing import listed
from pyspark.sql import functions as F

LIFE = "key string, value string, exp bigint, epoch bigint, start bigint, stop bigint"


def test_listings_equal_a_search_of_all_lives(spark, monkeypatch):
    monkeypatch.setattr("keyloom.operators.listing.SLICE_OPS", 60)
    rng = random.Random(3)
    places = rng.sample(range(2000), 900)
    flushes, times, writes = sorted(places[:3]), sorted(places[3:300]), sorted(places[300:])
    epoch = lambda at: sum(f < at for f in flushes)
    lives, last = [], {}
    for s in writes:
        k = (rng.choice(["a", "ab", "a:b", "b", "b:a"]), epoch(s))
        if k in last and last[k][5] is None:
            last[k][5] = s
        if rng.random() < 0.7:
            last[k] = [k[0], "v", rng.choice([0, 0, s + rng.randrange(1, 90)]), k[1], s, None]
            lives.append(last[k])
    asked = [(at, at, rng.choice(["*", "a*", "ab", "*a", "b", "nope", "a:*"])) for at in times]
    fits = lambda key, glob: re.fullmatch(glob.replace("*", ".*"), key)
    want = sorted((at, x[0]) for at, _, g in asked for x in lives if fits(x[0], g) and x[3] == epoch(at) and x[4] < at and (x[5] is None or at < x[5]) and (x[2] <= 0 or at < x[2]))
    got = listed(spark.createDataFrame(lives, LIFE), spark.createDataFrame(asked, "seq bigint, ts bigint, glob string"), spark.createDataFrame([(f,) for f in flushes], "m bigint"))
    assert sorted(map(tuple, got.collect())) == want and want


def test_many_lives_and_listings_of_one_key(spark):
    n = 40_000
    found = spark.range(n).select(F.lit("k").alias("key"), F.lit("v").alias("value"), F.lit(0).cast("bigint").alias("exp"), F.lit(0).cast("bigint").alias("epoch"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 2).alias("stop"))
    lists = spark.range(n).select((F.col("id") * 4 + F.when(F.col("id") % 2 == 0, 1).otherwise(3)).alias("seq"), F.lit(0).cast("bigint").alias("ts"), F.lit("k").alias("glob"))
    began = time.monotonic()
    got = listed(found, lists, spark.createDataFrame([], "m bigint"))
    assert got.agg(F.count("*"), F.sum(F.col("seq") % 8)).first() == (n // 2, n // 2)
    # not each listing with each life, which are 1.6 billion pairs
    assert time.monotonic() - began < 60
