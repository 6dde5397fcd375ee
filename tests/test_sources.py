import gzip
import json
import os
import shutil

import pytest

from pyspark.sql import functions as F

from keyloom.operators.fold import bounds, fold, slice_of
from keyloom.sources.oplog import append_log, cluster_links, decode, lines_of, read_cluster, read_log
from keyloom.streaming import replica
from keyloom.streaming.replica import current, follow, last_batch
from tests.logs import LOG, random_log, sequential


def state(df, now):
    return {r.key: r.value for r in fold(df, now).collect()}


def test_replay_of_rotated_and_active_files(spark, tmp_path):
    def put(name, lines, opener=open):
        with opener(tmp_path / name, "wt") as f:
            f.write("\n".join(lines) + "\n")

    j = lambda **x: json.dumps(x)
    put("rotated-999.jsonl", [j(op="SET", key="k1", value="1", expireAt=0, ts=1), "", "{cut", "null", j(op="NOPE", ts=1)])
    put("rotated-1000.jsonl.gz", [j(op="SET", key="k2", value="2", expireAt=0, ts=2)], gzip.open)
    put("active.jsonl", [j(op="DEL", key="k1", ts=3), j(op="SET", key="k2", value="new", expireAt=0, ts=4), j(op="SET", key="old", value="x", expireAt=5, ts=4)])
    log = read_log(spark, str(tmp_path))
    assert [r.op for r in log.orderBy("seq").collect()] == ["SET", "SET", "DEL", "SET", "SET"]
    assert state(log, 10) == {"k2": "new"}


def test_flush_between_files(spark, tmp_path):
    (tmp_path / "rotated-001.jsonl").write_text('{"op":"SET","key":"k1","value":"1","expireAt":0,"ts":1}\n')
    (tmp_path / "active.jsonl").write_text('{"op":"FLUSH","ts":2}\n{"op":"SET","key":"k3","value":"3","expireAt":0,"ts":2}\n')
    assert state(read_log(spark, str(tmp_path)), 10) == {"k3": "3"}


def test_append_and_read_back(spark, tmp_path):
    log = random_log(5, n=200, reads=False)
    df = spark.createDataFrame(log, LOG).withColumn("valueType", F.lit("STRING"))
    assert append_log(df.filter("seq < 0"), str(tmp_path)) == 0
    first = append_log(df.filter("seq < 120"), str(tmp_path), gzip=True, rotate=3000)
    size = lines_of(df.filter("seq < 120")).agg(F.sum(F.length("value") + 1)).first()[0]
    assert first == -(-size // 3000) > 1  # files by size
    assert append_log(df.filter("seq >= 120"), str(tmp_path)) == first + 1
    back = read_log(spark, str(tmp_path))
    assert [r.ts for r in back.orderBy("seq").collect()] == [r[1] for r in log]
    now = log[-1][1]
    assert state(back, now) == {k: v[0] for k, v in sequential(log, now)[0].items()}
    assert read_log(spark, str(tmp_path), behind=first - 1).count() == 80 and read_log(spark, str(tmp_path), behind=first).count() == 0


def test_slices_of_a_log_read_back_are_even(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id as seq", "id as ts", "'SET' as op", "'k' as key", "'v' as value", "'STRING' as valueType", "0L as expireAt", "cast(null as array<struct<key:string,value:string>>) as items", "cast(null as array<string>) as keys")
    append_log(df, str(tmp_path), rotate=400_000)
    back = read_log(spark, str(tmp_path))
    n = [r.n for r in back.groupBy(slice_of(back, bounds(back), 100).alias("s")).agg(F.count("*").alias("n")).collect()]
    assert len(n) == 100 and max(n) < 3 * 200


def test_files_without_numbers_go_by_name(spark, tmp_path):
    for name, ts in (("b-2.jsonl", 2), ("b-10.jsonl", 3), ("a.jsonl", 1), ("active.jsonl", 4)):
        (tmp_path / name).write_text(f'{{"op":"DEL","key":"k","ts":{ts}}}\n')
    assert [r.ts for r in read_log(spark, str(tmp_path)).orderBy("seq").collect()] == [1, 2, 3, 4]


def test_lines_have_their_own_fields(spark):
    df = spark.createDataFrame([(0, 1, "SET", "a", "1", 0, None, None), (1, 2, "FLUSH", None, None, None, None, None), (2, 3, "MDEL", None, None, None, None, ["x"])], LOG).withColumn("valueType", F.lit("STRING"))
    got = [json.loads(r.value) for r in lines_of(df).collect()]
    assert got == [{"op": "SET", "key": "a", "value": "1", "valueType": "STRING", "expireAt": 0, "ts": 1}, {"op": "FLUSH", "ts": 2}, {"op": "MDEL", "keys": ["x"], "ts": 3}]


def test_decode_skips_what_is_no_operation(spark):
    lines = [None, "", "  ", "{", "[]", "null", "7", '{"op":"PING"}', '{"op":"DEL","key":"a","ts":1}', '{"op":"SET","key":"a"']
    got = [r.o for r in spark.createDataFrame([(x,) for x in lines], "l string").select(decode(F.col("l")).alias("o")).collect()]
    assert [g is not None for g in got] == [False] * 8 + [True, False]


def test_cluster_configuration(spark, tmp_path):
    (tmp_path / "n1.json").write_text(json.dumps({"nodeId": "n1", "clusterPort": 7001, "peers": [{"nodeId": "n2", "host": "h", "port": None, "clusterPort": 7002}]}, indent=1))
    (tmp_path / "n2.json").write_text(json.dumps({"nodeId": "n2", "clusterPort": 7002, "peers": []}))
    assert [tuple(r) for r in cluster_links(read_cluster(spark, str(tmp_path))).collect()] == [("n1", "n2", "h", 0, 7002)]


@pytest.mark.parametrize("seed", [9, 10])
def test_follower_equals_fold(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(replica, "MERGE", 3)
    log = random_log(seed, n=240, reads=False)
    names = [c.split()[0] for c in LOG.replace("array<struct<key string, value string>>", "x").split(", ")]
    (tmp_path / "log").mkdir()
    for i in range(8):
        part = [dict(zip(names, r)) for r in log[i * 30 : (i + 1) * 30]]
        (tmp_path / "log" / f"{i}.json").write_text("\n".join(json.dumps(r | {"items": [{"key": k, "value": v} for k, v in r["items"]] if r["items"] is not None else None}) for r in part) + "\n")
        os.utime(tmp_path / "log" / f"{i}.json", (1000 + i, 1000 + i))
    state = str(tmp_path / "state")
    follow(spark, str(tmp_path / "log"), state, str(tmp_path / "cp"), once=True, files=1).awaitTermination()
    now = log[-1][1]
    assert last_batch(spark, state) == 7 and sorted(n for n in os.listdir(state) if n.startswith("base")) == ["base=2", "base=5"]
    got = {r.key: (r.value, r.expire_at, r.created_at) for r in current(spark, state, 7, now).collect()}
    assert got == sequential(log, now)[0]
    # a lost batch is an error, not an empty state
    shutil.rmtree(next(tmp_path.glob("state/batch=7*")))
    with pytest.raises(FileNotFoundError):
        current(spark, state, 7, now)
