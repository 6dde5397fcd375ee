import os

import pytest

from keyloom.operators.fold import fold
from keyloom.plans.store import Store
from keyloom.sources import runs
from keyloom.sources.oplog import append_log, read_log
from pyspark.sql import functions as F
from tests.logs import LOG, random_log, sequential


def entries(df):
    return {r.key: (r.value, r.expire_at, r.created_at) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_runs_and_log_tail_equal_the_fold(spark, tmp_path, seed):
    path, log = str(tmp_path), random_log(seed, n=210, reads=False, flush=0.01)
    df, now = spark.createDataFrame(log, LOG).withColumn("valueType", F.lit("STRING")), log[-1][1]
    for i in range(7):
        append_log(df.filter(f"seq >= {30 * i} and seq < {30 * (i + 1)}"), path)
        if i < 6:
            assert runs.flush_tail(spark, path).last == i
        if i == 4:
            assert runs.merge_due(spark, path, log[30 * i][1]) is not None or len(runs.live_runs(spark, path)) < 4
    want = sequential(log, now)[0]
    assert entries(runs.state(spark, path, now)) == want == entries(fold(read_log(spark, path), now))
    for k in "abcdz":
        assert [r.value for r in runs.state(spark, path, now, k).collect()] == ([want[k][0]] if k in want else [])


def test_leftovers_and_incomplete_runs_are_passed_over(spark, tmp_path):
    path = str(tmp_path)
    for i in range(5):
        append_log(spark.createDataFrame([(0, i, "SET", f"k{i}", str(i), 0, None, None), (1, i, "SET", "same", str(i), 0, None, None)], LOG).withColumn("valueType", F.lit("STRING")), path)
        runs.flush_tail(spark, path)
    os.makedirs(tmp_path / "_runs" / "run-0000000-0000004-f")  # a merge that did not end
    assert [r.name for r in runs.live_runs(spark, path)] == [f"run-{i:07d}-{i:07d}" for i in range(5)]
    keep = tmp_path / "kept"
    os.rename(tmp_path / "_runs" / "run-0000000-0000000", keep)
    os.rename(keep, tmp_path / "_runs" / "run-0000000-0000000")
    runs.maintain(spark, path, 10)
    assert [r.name for r in runs.live_runs(spark, path)] == ["run-0000000-0000004-f"] and len(os.listdir(tmp_path / "_runs")) == 1
    assert entries(runs.state(spark, path, 10)) == {**{f"k{i}": (str(i), 0, i) for i in range(5)}, "same": ("4", 0, 4)}
    plan = runs.read_run(spark, path, runs.live_runs(spark, path)[0]).filter("key = 'k1'")._jdf.queryExecution().toString()
    assert "EqualTo(key,k1)" in plan
    # pruned for a state, too
    assert "EqualTo(key,k1)" in runs.state(spark, path, 10, "k1")._jdf.queryExecution().toString()


def test_a_store_over_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    run = lambda lines, now: [r.reply for r in s.execute(lines, now).orderBy("seq").collect()]
    for i in range(4):
        run([f"SET k{i} v{i}", "SET n 1", f"SET t{i} x 1"], 1000 + i)
        s.maintain(1000 + i, least=0)
    assert len(runs.live_runs(spark, str(tmp_path))) == 1
    assert run(["GET k2", "DEL k0", "MUPD k1 w zz q", "KEYS k*", "GET n"], 5000) == ['"v2"', "(integer) 1", "(integer) 1", '"k1"\n"k2"\n"k3"\n*END', '"1"']
    assert (s.get("k1", 5000), s.get("k0", 5000), s.get("t0", 5000)) == ("w", None, None)
    assert sorted(r.key for r in s.state(5000).collect()) == ["k1", "k2", "k3", "n"]
    assert run(["FLUSH", "SET a 1"], 6000) == ["OK", "OK"] and [r.key for r in s.state(6000).collect()] == ["a"]
    s.maintain(6000, least=0)
    assert [r.flush for r in runs.live_runs(spark, str(tmp_path))] == [True] and s.get("a", 6000) == "1"
