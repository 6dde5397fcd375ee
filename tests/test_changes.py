import random
from collections import defaultdict

import pytest

from keyloom.operators.changes import current_entries

FEED = "line_id long, nodeId string, seq long, op string, key string, expireAt long, ts long, items array<struct<key string, value string>>, keys array<string>"


def brute(rows):
    changes, now = {}, {}
    for line, node, seq, op, key, exp, ts, items, keys in sorted(rows, key=lambda r: r[0] if r[0] is not None else -1):
        if node is None or ts is None:
            continue
        now[node] = max(now.get(node, ts), ts)
        if seq is None:
            continue
        c = changes.setdefault((node, seq), {"ts": ts, "op": None, "t": None, "e": None})
        touched = [key] if op in ("SET", "DEL") else [k for k, _ in items] if op in ("MSET", "MUPD") and items is not None else keys if op == "MDEL" else None
        c["ts"] = min(c["ts"], ts)
        c["op"] = c["op"] if c["op"] is not None else op
        c["t"] = c["t"] if c["t"] is not None else touched
        c["e"] = c["e"] if c["e"] is not None else exp
    state = defaultdict(dict)
    there = lambda s, k, t: k in s and (not s[k][1] or s[k][1] <= 0 or t < s[k][1])
    for (node, seq), c in sorted(changes.items(), key=lambda x: (x[1]["ts"], x[0][1])):
        s = state[node]
        if c["op"] == "FLUSH":
            s.clear()
        for k in dict.fromkeys(c["t"] or []):
            if k is None:
                continue
            if c["op"] in ("SET", "MSET") or (c["op"] == "MUPD" and there(s, k, c["ts"])):
                s[k] = (seq, c["e"])
            elif c["op"] in ("DEL", "MDEL"):
                s.pop(k, None)
    return sorted((n, k, v[0]) for n, s in state.items() for k, v in s.items() if there(s, k, now[n]))


def feed(seed, n):
    rnd, rows = random.Random(seed), []
    for seq in range(n):
        node, ts = rnd.choice(["n1", "n1", "n2"]), rnd.randint(0, n // 2)
        op = rnd.choice(["SET"] * 6 + ["DEL", "DEL", "MSET", "MUPD", "MUPD", "MDEL", "FLUSH" if rnd.random() < 0.2 else "SET", "set", None])
        key = rnd.choice(["a", "A", "b ", None, "c"]) if op in ("SET", "DEL", "set") else None
        items = [(rnd.choice(["a", "A", None]), "v") for _ in range(rnd.randint(0, 3))] if op in ("MSET", "MUPD") and rnd.random() < 0.9 else None
        keys = [rnd.choice(["a", "c", None]) for _ in range(2)] if op == "MDEL" else None
        exp = rnd.choice([0, None, ts + rnd.randint(-3, 20)])
        for copy in range(rnd.choice([1, 1, 1, 2, 3])):
            rows.append([None, node, seq, op, key, None if copy and rnd.random() < 0.5 else exp, ts + copy * rnd.randint(0, 9), items, keys])
    rnd.shuffle(rows)
    # the first copy to arrive has the fields of the change
    return [tuple([i, *r[1:]]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", range(6))
def test_equal_to_sequential_replay(spark, seed):
    rows = feed(seed, 250)
    got = current_entries(spark.createDataFrame(rows, FEED), slices=5 + seed)
    assert sorted((r.nodeId, r.key, r.seq) for r in got.collect()) == brute(rows)


def test_hot_key_and_many_slices(spark):
    rows = [(i, "n", i, "SET" if i % 5 == 0 else "MUPD", "k" if i % 5 == 0 else None, 0, i, None if i % 5 == 0 else [("k", "v")], None) for i in range(500)]
    assert [(r.key, r.seq) for r in current_entries(spark.createDataFrame(rows, FEED), slices=200).collect()] == [("k", 499)]


def test_updates_only_and_expiry_chain(spark):
    up = lambda i, ts, e: (i, "n", i, "MUPD", None, e, ts, [("k", "v")], None)
    assert current_entries(spark.createDataFrame([up(1, 1, 0), up(2, 2, 0)], FEED)).collect() == []
    rows = [(0, "n", 0, "SET", "k", 10, 0, None, None), up(1, 5, 20), up(2, 15, 30), up(3, 31, 0), (9, "n", 9, "PING", None, None, 40, None, None)]
    assert current_entries(spark.createDataFrame(rows, FEED), slices=7).collect() == []
    assert [r.seq for r in current_entries(spark.createDataFrame([*rows[:3], up(3, 29, 0)], FEED), slices=7).collect()] == [3]


def test_nulls_empty_and_clashing_columns(spark):
    extra = FEED + ", scope string, kind int, slice int, now long, exp string, flush int"
    assert current_entries(spark.createDataFrame([], extra)).collect() == []
    rows = [(1, None, 1, "SET", "a", 0, 1, None, None), (2, "n", None, "SET", "b", 0, 1, None, None), (3, "n", 3, "SET", "c", 0, None, None, None), (4, "n", 4, "SET", "d", 0, 1, None, None)]
    assert [r.key for r in current_entries(spark.createDataFrame([(*r, "s", 1, 2, 3, "e", 4) for r in rows], extra)).collect()] == ["d"]


def test_each_field_from_the_first_copy_that_has_it(spark):
    rows = [
        # the first copy lacks the key
        (1, "n", 1, "SET", None, None, 1, None, None), (2, "n", 1, "SET", "a", 0, 1, None, None),
        # the first copy lacks the op
        (3, "n", 2, None, "b", 0, 2, None, None), (4, "n", 2, "SET", None, None, 2, None, None),
        (5, "n", 3, "MSET", None, 0, 3, None, None), (6, "n", 3, None, None, None, 3, [("c", "v"), ("d", "v")], None),
        # of two keys the first one counts
        (7, "n", 4, "SET", "e", 0, 4, None, None), (8, "n", 4, "SET", "f", 0, 4, None, None),
        (9, "n", 5, "MDEL", None, None, 5, None, None), (10, "n", 5, None, None, None, 5, None, ["c"]),
        # a FLUSH whose earliest copy has no op: what was set at 3 is behind it
        (11, "m", 1, "SET", "a", 0, 1, None, None), (12, "m", 2, None, None, None, 2, None, None), (13, "m", 2, "FLUSH", None, None, 4, None, None), (18, "m", 6, "SET", "g", 0, 3, None, None),
        (14, "m", 3, "DEL", None, None, 4, None, None), (15, "m", 3, None, "b", None, 3, None, None), (16, "m", 4, "SET", "b", 0, 2, None, None), (17, "m", 5, "SET", "c", 0, 5, None, None),
    ]
    got = current_entries(spark.createDataFrame(rows, FEED), slices=3).collect()
    assert sorted((r.nodeId, r.key, r.seq) for r in got) == [("m", "c", 5), ("m", "g", 6), ("n", "a", 1), ("n", "b", 2), ("n", "d", 3), ("n", "e", 4)]
