import json

from keyloom.plans.store import Store
from keyloom.streaming.commands import serve
from keyloom.streaming.keyed import answers
from tests.logs import LOG, random_log, sequential


def test_keyed_answers_equal_the_sequential_model(spark, tmp_path):
    log = random_log(11, n=150, flush=0)
    names = [c.split()[0] for c in LOG.replace("array<struct<key string, value string>>", "x").split(", ")]

    def put(i, rows):
        lines = [json.dumps(dict(zip(names, r)) | {"items": [{"key": k, "value": v} for k, v in r[6]] if r[6] is not None else None}) for r in rows]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines) + "\n")

    (tmp_path / "in").mkdir()
    for i in range(2):
        put(i, log[i * 75 : (i + 1) * 75])
        stream = spark.readStream.schema(LOG).json(str(tmp_path / "in"))
        answers(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").json(str(tmp_path / f"out{n}"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for n in range(2):
        for r in spark.read.schema("key string, seq long, op string, existed boolean, old_value string").json(str(tmp_path / f"out{n}")).collect():
            got.setdefault((r.seq, r.key), []).append((r.existed, r.old_value))
    want = {}
    told = sequential(log, log[-1][1])[1]
    for seq, _, op, key, _, _, items, keys in log:
        touched = [key] if op in ("SET", "DEL", "GET") else [k for k, _ in items] if items is not None else keys or []
        for pos, k in enumerate(touched):
            want.setdefault((seq, k), []).append(told[seq, pos])
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_command_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "session string, seq bigint, ts bigint, line string"
    store = Store(spark, str(tmp_path / "store"))
    for i, lines in enumerate([["SET a 1", "GET a"], ["DEL a", "GET a"]]):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"session": "s", "seq": j, "ts": 10 * i + j, "line": x}) + "\n" for j, x in enumerate(lines)))
        serve(spark.readStream.schema(schema).json(str(tmp_path / "in")), store, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = [[r.reply for r in spark.read.json(str(tmp_path / f"out/batch={i}")).orderBy("seq").collect()] for i in range(2)]
    assert got == [["OK", '"1"'], ["(integer) 1", "(nil)"]]
