import pytest
from pyspark.sql import functions as F

from keyloom.operators import lookup
from keyloom.operators.compact import compact_segment, due, merge_runs, snapshot, write_run
from keyloom.operators.fold import explode_ops, fold, op_counts, replies
from tests.logs import LOG, random_log, sequential


@pytest.mark.parametrize("seed", range(8))
def test_fold_and_replies_equal_sequential_model(spark, seed):
    log = random_log(seed, n=150)
    df = spark.createDataFrame(log, LOG)
    now = log[-1][1] + seed
    state, told = sequential(log, now)
    got = {r.key: (r.value, r.expire_at, r.created_at) for r in fold(df, now, slices=7).collect()}
    assert got == state
    seen = {(r.seq, r.pos): (r.existed, r.old_value) for r in replies(df, slices=5).collect()}
    assert seen == told
    counts = {r.seq: r.n for r in op_counts(df).collect()}
    want = {s: sum(told.get((s, p), (False,))[0] for p in range(4)) for s, _, op, *_ in log if op in ("DEL", "MDEL", "MUPD")}
    assert counts == want


def test_empty_log(spark):
    df = spark.createDataFrame([], LOG)
    assert fold(df, 0).collect() == [] and replies(df).collect() == [] and op_counts(df).collect() == []


def test_hot_key_is_sliced_and_null_keys_are_left_out(spark):
    log = [(i, i, "SET" if i % 3 else "MUPD", "k" if i % 3 else None, str(i), 0, None if i % 3 else [("k", str(i)), (None, "x")], None) for i in range(1, 400)]
    df = spark.createDataFrame(log, LOG)
    assert [(r.key, r.value) for r in fold(df, 1000).collect()] == [("k", "399")]
    assert explode_ops(df).filter("key is null").count() == 0


# the reference's store scenarios: expired entries are absent for every command
def scenario(spark, ops, now):
    rows = [(i, ts, *rest) for i, (ts, *rest) in enumerate(ops)]
    df = spark.createDataFrame(rows, LOG)
    return {r.key: r.value for r in fold(df, now).collect()}, {(r.seq, r.pos): r.existed for r in replies(df).collect()}


def s(ts, k, v, e=0):
    return (ts, "SET", k, v, e, None, None)


def test_store_scenarios(spark):
    d = lambda ts, k: (ts, "DEL", k, None, None, None, None)
    assert scenario(spark, [s(0, "k", "v")], 1)[0] == {"k": "v"}
    state, told = scenario(spark, [s(0, "k", "v"), d(1, "k"), d(2, "k")], 3)
    assert state == {} and told[1, 0] and not told[2, 0]
    assert scenario(spark, [s(0, "k", "v", 1000)], 1100)[0] == {}
    assert scenario(spark, [s(0, "k", "v", 1000)], 1000)[0] == {}  # gone at the moment itself
    assert scenario(spark, [s(0, "k", "v", 1000), s(500, "k", "v2")], 2000)[0] == {"k": "v2"}
    # a deletion stays deleted, and an expired write hides the older value
    assert scenario(spark, [s(0, "k", "old"), s(1, "k", "new", 5)], 10)[0] == {}
    # an update of an expired key does nothing
    assert scenario(spark, [s(0, "k", "v", 5), (6, "MUPD", None, None, 0, [("k", "w")], None)], 7)[0] == {}


@pytest.mark.parametrize("seed", range(5))
def test_compaction_preserves_the_fold(spark, seed):
    log = random_log(seed + 50, n=120, reads=False)
    cut, now = 70, log[-1][1]
    a, b = [r for r in log if r[0] < cut], [r for r in log if r[0] >= cut]
    want = {k: v[:2] for k, v in sequential(log, now)[0].items()}
    A, B = spark.createDataFrame(a, LOG), spark.createDataFrame(b, LOG)
    cols = LOG.replace("array<struct<key string, value string>>", "x").split(", ")
    names = [c.split()[0] for c in cols]
    snap = snapshot(A, a[-1][1]).select(*names).union(B.select(*names))
    assert {r.key: (r.value, r.expire_at) for r in fold(snap, now).collect()} == want
    mixed = A.select(*names).union(compact_segment(B.withColumn("valueType", F.lit(None).cast("string"))).select(*names))
    assert {r.key: (r.value, r.expire_at) for r in fold(mixed, now).collect()} == want


def test_runs(spark, tmp_path):
    schema = "key string, op string, value string, expire_at bigint"
    old = spark.createDataFrame([("a", "SET", "1", 0), ("b", "SET", "1", 0), ("c", "SET", "1", 0)], schema)
    new = spark.createDataFrame([("b", "DEL", None, None), ("a", "SET", "2", 0)], schema)
    assert sorted((r.key, r.value) for r in merge_runs([old, new]).collect()) == [("a", "2"), ("c", "1")]
    assert ("b", "DEL") in [(r.key, r.op) for r in merge_runs([old, new], final=False).collect()]
    assert sorted((r.key, r.value) for r in lookup.newest([new, old]).collect()) == [("a", "2"), ("c", "1")]
    write_run(old, str(tmp_path / "run"))
    back = spark.read.parquet(str(tmp_path / "run"))
    assert [r.value for r in lookup.get(back, "b").collect()] == ["1"]
    assert "EqualTo(key,b)" in back.filter("key = 'b'")._jdf.queryExecution().toString()
    assert due([1, 2, 3]) == [] and due(list(range(10))) == list(range(8))


def test_lookups(spark):
    state = spark.createDataFrame([("a", "1", 5), ("b", "(nil)", 0), ("user:1", "[x]", 0)], "key string, value string, expire_at bigint")
    probes = spark.createDataFrame([(0, "a"), (1, "zz"), (2, "a"), (3, "b")], "pos int, key string")
    assert [r.value for r in lookup.mget(state, probes).orderBy("pos").collect()] == ["1", "(nil)", "1", "(nil)"]
    assert sorted(r.key for r in lookup.exists(state, probes).collect()) == ["a", "b"]
    assert dict(map(tuple, lookup.type_of(state, probes).collect())) == {"a": "string", "zz": "none", "b": "set"}
    assert lookup.keys(state, None).count() == lookup.keys(state, "").count() == 3
    assert lookup.size(state).first().n == 3
    assert [r.key for r in lookup.key_range(state, "b", None).orderBy("key").collect()] == ["b", "user:1"]
    pairs = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "zz", "n")], "pos int, key string, value string")
    assert sorted(map(tuple, lookup.update_existing(state, pairs).collect())) == [("a", "y", 0), ("b", "(nil)", 0), ("user:1", "[x]", 0)]
    moves = spark.createDataFrame([("a", "b"), ("zz", "q"), ("user:1", "user:1")], "old string, new string")
    assert sorted(map(tuple, lookup.rename(state, moves).collect())) == [("b", "1", 0)]
