import pytest

from keyloom.operators import collections as C
from keyloom.plans.queries import read_only_follower
from keyloom.plans.session import batch_count, last_before, run_script
from pyspark.sql import functions as F


def replies(spark, lines, read_only=None, sessions=None):
    rows = [((sessions or ["s"] * len(lines))[i], i, 1000 + i, line) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "session string, seq bigint, ts bigint, line string")
    return [r.reply for r in run_script(df, read_only).orderBy("seq").collect()]


def test_smoke_script(spark):
    lines = ["PING", "SET name zhangsan", "GET name", "EXISTS name", "EXISTS noexist", "SET user:001 alice", "KEYS user:*", "MSET k1 v1 k2 v2", "MUPD k1 new1 k3 new3", "GET k1", "DEL k1", "GET k1", "FLUSH", "KEYS"]
    want = ['"PONG"', "OK", '"zhangsan"', "(integer) 1", "(integer) 0", "OK", '"user:001"\n*END', "OK", "(integer) 1", '"new1"', "(integer) 1", "(nil)", "OK", "*END"]
    assert replies(spark, lines) == want


def test_errors(spark):
    lines = ["SET a", "GET", "GET a b", "MSET a", "MUPD a 1 b", "SET a 1 x", "SET a 1 -5", "NOPE", "RENAME a b", "", 'SET "a', "CLUSTER", "COLLECTION", "COLLECTION WHAT", "COLLECTION CREATE a:b", "MGET", "TYPE", "MDEL"]
    got = replies(spark, lines)
    assert all(r.startswith("(error) ERR ") for r in got), got
    assert got[0] == "(error) ERR wrong number of arguments for 'SET'" and got[5] == got[6] == "(error) ERR value is not an integer or out of range"
    assert got[7] == "(error) ERR unknown command 'NOPE'" and got[9] == "(error) ERR empty line" and got[10] == "(error) ERR unterminated quoted string"
    texts = ["cluster mode not enabled", "wrong number of arguments for 'COLLECTION' — usage: COLLECTION LIST|CREATE|DROP ...", "unknown COLLECTION sub-command: WHAT — valid: LIST, CREATE, DROP", "collection name cannot contain ':'"]
    assert got[11:15] == [f"(error) ERR {t}" for t in texts]
    assert got[8] == "(error) ERR unknown command 'RENAME'"
    assert [got[i] for i in (1, 2, 3, 4, 15, 16, 17)] == [f"(error) ERR wrong number of arguments for '{v}'" for v in ("GET", "GET", "MSET", "MUPD", "MGET", "TYPE", "MDEL")]


def test_values_types_and_ttl(spark):
    lines = ['SET l "[1,2]"', "TYPE l", "TYPE none", "SET t v 0", "MGET l none t l", "SET x 1 1", "SET q \"a\\\"b\"", "GET q", "MSET d 1 d 2", "GET d", "MDEL d d zz"]
    assert replies(spark, lines) == ["OK", '"list"', '"none"', "OK", '"[1,2]"\n"(nil)"\n"v"\n"[1,2]"\n*END', "OK", "OK", '"a\\"b"', "OK", '"2"', "(integer) 1"]


def test_use_quit_and_sessions(spark):
    lines = ["USE web", "SET a 1", "USE *", "KEYS *", "GET web:a", "USE web", "GET web:a", "KEYS", "QUIT", "GET a", "GET web:a"]
    sessions = ["x"] * 10 + ["y"]
    got = replies(spark, lines, sessions=sessions)
    assert got == ['"OK (using web)"', "OK", '"OK (default)"', '"web:a"\n*END', '"1"', '"OK (using web)"', '"1"', '"web:a"\n*END', "OK", '"1"']


def test_collections_in_a_script(spark):
    lines = ["COLLECTION CREATE shop", "COLLECTION CREATE shop", "SET web:1 a", "SET web:2 b", "COLLECTION LIST", "COLLECTION CREATE web", "COLLECTION DROP web", "KEYS web:*", "COLLECTION DROP shop", "COLLECTION LIST", "GET __collections__"]
    got = replies(spark, lines)
    assert got == ["OK", "(error) ERR collection already exists: shop", "OK", "OK", '"shop"\n"web"\n*END', "(error) ERR collection already exists: web", "(integer) 2", "*END", "(integer) 0", "*END", '"[]"']


def test_read_only_follower(spark):
    assert replies(spark, ["SET a 1", "GET a"], read_only="n2") == ["(error) ERR not the leader, current leader is n2", "(nil)"]


def test_more_than_a_hundred_listings(spark):
    lines, want = [], []
    for i in range(60):
        lines += [f"SET k{i % 9}:{i} {i}", f"KEYS k{i % 9}:*", "KEYS *9"]
        keys = [f"k{j % 9}:{j}" for j in range(i + 1)]
        want += ["OK", sorted(k for k in keys if k.startswith(f"k{i % 9}:")), sorted(k for k in keys if k.endswith("9"))]
    got = replies(spark, lines)
    assert got == [w if isinstance(w, str) else "\n".join([*(f'"{k}"' for k in w), "*END"]) for w in want]


def test_listings_see_deletions_expiries_and_truncations(spark):
    lines = ["SET a 1", "SET t x 1", "MSET b 1 b 2", "KEYS", "DEL a", "KEYS", "FLUSH", "KEYS", "MUPD a 5", "SET a 2", "KEYS a", "KEYS a*b*"]
    assert replies(spark, lines)[3::2] == ['"a"\n"b"\n"t"\n*END', '"b"\n"t"\n*END', "*END", "OK", "*END"]
    rows = [("s", i, ts, x) for i, (ts, x) in enumerate([(0, "SET t v 5"), (4999, "KEYS"), (5000, "KEYS"), (5001, "COLLECTION LIST")])]
    df = spark.createDataFrame(rows, "session string, seq bigint, ts bigint, line string")
    assert [r.reply for r in run_script(df).orderBy("seq").collect()] == ["OK", '"t"\n*END', "*END", "*END"]


def test_collections_over_flushes_and_raw_writes_of_the_meta_key(spark):
    lines = [
        ("COLLECTION CREATE a", "OK"), ("COLLECTION CREATE b", "OK"), ("GET __collections__", '"[\\"a\\",\\"b\\"]"'), ("KEYS", '"__collections__"\n*END'),
        ("COLLECTION DROP a", "(integer) 0"), ("COLLECTION LIST", '"b"\n*END'), ("COLLECTION CREATE a", "OK"), ("FLUSH", "OK"), ("COLLECTION LIST", "*END"), ("COLLECTION CREATE b", "OK"),
        ('SET __collections__ "[\\"x\\",\\"y\\"]"', "OK"), ("COLLECTION LIST", '"x"\n"y"\n*END'), ("COLLECTION CREATE x", "(error) ERR collection already exists: x"), ("COLLECTION DROP x", "(integer) 0"),
        ("GET __collections__", '"[\\"y\\"]"'), ("SET k:1 v", "OK"), ("COLLECTION CREATE k", "(error) ERR collection already exists: k"), ("DEL k:1", "(integer) 1"), ("COLLECTION CREATE k", "OK"),
        ("DEL __collections__", "(integer) 1"), ("COLLECTION LIST", "*END"), ("COLLECTION CREATE x:y", "(error) ERR collection name cannot contain ':'"), ("EXISTS __collections__", "(integer) 0"),
        ("SET k:2 v", "OK"), ("COLLECTION DROP k", "(integer) 1"), ("SET k:2 w", "OK"), ("COLLECTION LIST", '"k"\n*END'), ("COLLECTION DROP *", "(integer) 1"), ("COLLECTION LIST", "*END"),
    ]
    assert replies(spark, [x for x, _ in lines]) == [y for _, y in lines]


def test_last_before_is_carried_over_slices(spark, monkeypatch):
    monkeypatch.setattr("keyloom.plans.session.SLICE_LINES", 7)
    df = spark.createDataFrame([("k", i, "v" + str(i) if i in (3, 170) else None) for i in range(300)], "k string, i bigint, v string")
    got = {r.i: r.x for r in last_before(df, "k", "i", F.col("v"), "x").collect()}
    assert got[3] is None and got[4] == got[170] == "v3" and got[171] == got[299] == "v170"


def test_a_sliced_script_of_one_session_named_by_a_literal(spark, monkeypatch):
    monkeypatch.setattr("keyloom.plans.session.SLICE_LINES", 400)
    got = read_only_follower(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.reply == ("(nil)" if r.seq % 2 else "(error) ERR not the leader, current leader is n1") for r in got)


def test_collections_of_a_state(spark):
    state = spark.createDataFrame([("__collections__", '["b","a"]'), ("web:1", "x"), (":x", "y"), ("plain", "z"), ("web:2\n", "n")], "key string, value string")
    assert [r.name for r in C.names(state).collect()] == ["a", "b", "web"]
    wanted = spark.createDataFrame([("web",), ("a",), ("new",), ("x:y",), ("",)], "name string")
    errors = dict(map(tuple, C.create_errors(state, wanted).collect()))
    assert errors["new"] is None and "colon" not in str(errors["x:y"]) and all(errors[n] for n in ("web", "a", "x:y", ""))
    assert C.create(state, wanted).first() == ("__collections__", '["a","b","new"]')
    assert C.dropped(state, "web").first().n == 1 and C.dropped(state, "*").first().n == 2  # the star is a glob, and stays within a line
    assert C.drop(state, "web").count() == 4


def test_batch_count(spark):
    ops = spark.createDataFrame([(0, 0, "SET", "a", "1"), (1, 1, "DEL", "a", None), (2, 2, "DEL", "a", None), (3, 3, "INCR", "a", None), (4, 4, "SET", "b", "")], "seq bigint, ts bigint, op string, key string, value string")
    assert batch_count(ops).first().n == 3
