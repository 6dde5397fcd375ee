import json

from pyspark.sql import functions as F

from keyloom.plans.rest import key_listings, pattern_of, respond
from keyloom.plans.store import Store


def test_store_keeps_what_scripts_write(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"))
    run = lambda lines, now: [r.reply for r in s.execute(lines, now).orderBy("seq").collect()]
    assert run(["SET a 1", "SET t x 10", "MSET web:1 p web:2 q"], 1000) == ["OK"] * 3
    assert run(["GET a", "DEL a", "GET a", "COLLECTION DROP web", "GET t"], 2000) == ['"1"', "(integer) 1", "(nil)", "(integer) 2", '"x"']
    assert run(["KEYS", "COLLECTION LIST"], 3000) == ['"__collections__"\n"t"\n*END', "*END"]
    assert s.get("t", 3000) == "x" and s.get("t", 11_000) is None and s.get("a", 3000) is None
    s.compact(str(tmp_path / "small"), 3000)
    assert sorted(map(tuple, Store(spark, str(tmp_path / "small")).state(4000).select("key", "value", "expire_at").collect())) == [("__collections__", "[]", 0), ("t", "x", 11_000)]
    assert [r.reply for r in Store(spark, str(tmp_path / "log"), leader="n1").execute(["SET a 2"], 4000).collect()] == ["(error) ERR not the leader, current leader is n1"]
    assert s.keys("t*", 3000).count() == 1


def test_empty_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "none"))
    assert s.state(0).count() == 0 and s.get("a", 0) is None and s.execute([], 0).count() == 0


def test_requests(spark):
    j = json.dumps
    reqs = [
        ("GET", "/api/ping", None, None, 200, {"pong": True}),
        ("POST", "/api/keys/a", None, j({"value": 'x"y'}), 200, {"ok": True}),
        ("GET", "/api/keys/a", None, None, 200, {"key": "a", "value": 'x"y', "exists": True}),
        ("POST", "/api/keys/t", None, j({"value": "v", "ttl": 1}), 200, {"ok": True}),
        ("PUT", "/api/keys/t", None, j({"value": "w", "ttl": 5}), 200, {"updated": 1}),
        ("PUT", "/api/keys/zz", None, j({"value": "w"}), 200, {"updated": 0}),
        ("POST", "/api/keys/batch", None, j({"ops": [{"op": "set", "key": "b", "value": "1"}, {"op": "DEL", "key": "a"}, {"op": "DEL", "key": "q"}, {"op": "INCR", "key": "b"}]}), 200, {"count": 2}),
        ("GET", "/api/keys", "pattern=%2A", None, 200, {"keys": ["b", "t"]}),
        ("DELETE", "/api/keys/b", None, None, 200, {"deleted": True}),
        ("DELETE", "/api/keys/b", None, None, 200, {"deleted": False}),
        ("GET", "/api/keys/b", None, None, 200, {"key": "b", "exists": False}),
        ("POST", "/api/keys/b", None, "{}", 400, {"error": "missing value"}),
        ("POST", "/api/keys/b", None, "{", 500, {"error": "body is not JSON"}),
        ("PATCH", "/api/keys/b", None, None, 405, {"error": "method not allowed"}),
        ("GET", "/api/keys/", None, None, 400, {"error": "missing key"}),
        ("GET", "/nope", None, None, 404, {"error": "not found"}),
        ("OPTIONS", "/api/keys", None, None, 200, {}),
        ("DELETE", "/api/keys", None, None, 200, {"ok": True}),
        ("GET", "/api/keys", None, None, 200, {"keys": []}),
        ("POST", "/api/keys/batch", None, "{}", 200, {"count": 0}),
    ]
    df = spark.createDataFrame([(i, i, *r[:4]) for i, r in enumerate(reqs)], "seq bigint, ts bigint, method string, path string, query string, body string")
    got = {r.seq: (r.status, json.loads(r.body)) for r in respond(df).collect()}
    assert got == {i: (r[4], r[5]) for i, r in enumerate(reqs)}


def test_patterns_of_queries(spark):
    want = {"x=1&pattern=a%3A*": "a:*", None: "*", "pattern": "*", "pattern=": "", "pattern=a+b&pattern=c": "a b", "pattern=%zz": "%zz", "patterns=x": "*"}
    df = spark.createDataFrame([(q,) for q in want], "q string")
    assert {r.q: r.p for r in df.select("q", pattern_of(F.col("q")).alias("p")).collect()} == want


def test_many_listings_and_a_large_batch(spark):
    body = json.dumps({"ops": [{"op": "SET", "key": f"k{i % 50}", "value": str(i)} for i in range(3000)]})
    reqs = [("POST", "/api/keys/batch", None, body)] + [("GET", "/api/keys", f"pattern=k{i % 50}", None) for i in range(130)] + [("DELETE", "/api/keys/k7", None, None), ("GET", "/api/keys", "pattern=k7", None)]
    df = spark.createDataFrame([(2**50 + i, i, *r) for i, r in enumerate(reqs)], "seq bigint, ts bigint, method string, path string, query string, body string")
    got = {r.seq - 2**50: json.loads(r.body) for r in respond(df).collect()}
    assert got[0] == {"count": 3000} and got[132] == {"keys": []}
    assert all(got[1 + i] == {"keys": [f"k{i % 50}"]} for i in range(130))
    assert key_listings(df).count() == 130
