import json
import random
from collections import Counter

import pytest

from keyloom.operators.drift import STEADY, VALUE_TYPES, ingest, schema_changes

LINES, FILES = "file_id long, line_no int, line string", "file_id long, nodeId string, file_name string"


def layouts(rnd):
    vt = rnd.choice([None, ("valueType",), ("vtype",), ("meta", "valueType"), ("VALUE_TYPE",)])
    ex = rnd.choice([None, ("expireAt",), ("deadline",), ("meta", "inner", "exp"), ("exp",)])
    return vt, rnd.choice(["string", "number", "array"]), ex, rnd.choice(["string", "number"])


def line(rnd, op, lay, ts):
    o = {"op": op, "ts": ts, "crc": rnd.randint(0, 10**9), "type": "kv", "createdAt": ts - rnd.randint(0, 3), "n": rnd.randint(0, 3), "flag": True}
    if op in ("SET", "DEL"):
        o |= {"key": "k", "value": '{"expireAt": "5", "valueType": "MAP"}'}
    if op == "MSET":
        o["items"] = [{"key": "k", "value": "v"}]
    vt, vtype, ex, etype = lay

    def put(path, v):
        at = o
        for p in path[:-1]:
            at = at.setdefault(p, {})
        at[path[-1]] = v

    k = rnd.randint(0, 3)
    if vt and op == "SET":
        put(vt, None if rnd.random() < 0.1 else {"string": VALUE_TYPES[k], "number": k, "array": [VALUE_TYPES[k]]}[vtype])
    if ex and op in ("SET", "MSET"):
        e = rnd.choice([0, ts + rnd.randint(1, 99)])
        put(ex, None if rnd.random() < 0.1 else str(e) if etype == "string" else e)
    return json.dumps(o)


def corpus(seed, nodes=6, files=6):
    rnd, lines, names, truth = random.Random(seed), [], [], set()
    fid = 0
    for n in range(nodes):
        before = None
        for i in range(files):
            fid += 1
            names.append((fid, f"n{n}", "active.jsonl" if i == files - 1 else f"rotated-{997 + i:03d}.jsonl"))
            if rnd.random() < 0.15:  # no readable SET line
                lines += [(fid, 1, "{cut"), (fid, 2, None), (fid, 3, json.dumps({"op": "DEL", "ts": 1, "key": "a"}))]
                continue
            lay = layouts(rnd)
            body = [line(rnd, rnd.choice(["SET", "SET", "SET", "DEL", "MSET"]), lay, 1000 + j) for j in range(40)] + ["", "#", "null", '{"op":"SE']
            other = layouts(rnd)
            body += [line(rnd, "SET", other, 2000) for _ in range(2)]
            rnd.shuffle(body)
            lines += [(fid, j, x) for j, x in enumerate(body)]
            if before:
                for f, a, b, ta, tb in (("valueType", before[0], lay[0], before[1], lay[1]), ("expireAt", before[2], lay[2], before[3], lay[3])):
                    if a is None or b is None:
                        truth |= {(fid, f, "added")} if b else {(fid, f, "removed")} if a else set()
                    else:
                        truth |= ({(fid, f, "renamed")} if a != b else set()) | ({(fid, f, "retyped")} if ta != tb else set())
            before = lay
    return lines, names, truth


def test_changes_are_found(spark):
    lines, names, truth = corpus(4)
    got = schema_changes(spark.createDataFrame(lines, LINES), spark.createDataFrame(names, FILES))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == truth and len(rows) == len(set(rows))


def rebuilt(r):
    """The object of a readable line, from the columns of its row; steady fields that are null are left out."""
    o = {}
    for part in (r["replayed"], r["rescued"]):
        for path, v in json.loads(part or "{}").items():
            names = [n.replace("~1", "/").replace("~0", "~") for n in path.split("/")]
            at = o
            for n in names[:-1]:
                at = at.setdefault(n, {})
            at[names[-1]] = v
    for c in STEADY:
        if c not in o and r[c] is not None:
            o[c] = [i.asDict() for i in r[c]] if c == "items" else r[c]
    return o


def without_null_steady(o):
    return {k: v for k, v in o.items() if v is not None or k not in STEADY}


def test_every_line_can_be_rebuilt(spark):
    lines, _, _ = corpus(7)
    odd = [
        {"op": "MSET", "ts": "17", "items": [{"key": "a", "value": "b", "more": 1}, {"key": "c"}], "keys": None},
        {"op": "MDEL", "ts": "soon", "keys": ["a", 5], "value": {"x": [1, {"y": 2}]}, "key": 9},
        {"op": "SET", "ts": 5, "a/b": {"c~d": {"e": {"f": {"g": {"h": {"i": 1.5}}}}}}, "empty": {}, "none": None, "list": [{"z": {}}]},
        {"op": 3, "ts": 1.25, "items": "text", "keys": {"k": 1}},
    ]
    lines = [*lines, *[(1000 + i, 1, json.dumps(o)) for i, o in enumerate(odd)], (None, 1, '{"op":"SET","valueType":"LIST"}'), (2000, 1, '{"a":1,"a":2}')]
    got = [r.asDict() for r in ingest(spark.createDataFrame(lines, LINES)).collect()]
    assert len(got) == len(lines)
    by = {(r["file_id"], r["line_no"]): r for r in got}
    for f, n, x in lines:
        r = by[f, n]
        try:
            o = json.loads(x, object_pairs_hook=lambda kv: dict(kv) if len(dict(kv)) == len(kv) else None)
        except (TypeError, ValueError):
            o = None
        assert r["readable"] == isinstance(o, dict)
        if r["readable"]:
            assert rebuilt(r) == without_null_steady(o)
        else:
            assert r["rescued"] is None if x is None else json.loads(r["rescued"]) == {"_line": x}
            assert all(r[c] is None for c in (*STEADY, "value_type", "expire_at", "replayed"))
    assert by[1000, 1]["ts"] == 17 and json.loads(by[1000, 1]["rescued"])["ts"] == "17"
    assert by[1001, 1]["ts"] is None and json.loads(by[1001, 1]["rescued"])["ts"] == "soon"


def test_ingest_types_what_it_replays(spark):
    lines, _, _ = corpus(7)
    got = [r.asDict() for r in ingest(spark.createDataFrame(lines, LINES)).collect() if r.readable]
    for r in got:
        assert r["value_type"] in (None, *VALUE_TYPES)
        if r["op"] == "DEL":
            assert r["value_type"] is None and r["expire_at"] is None
    by = Counter(r["value_type"] for r in got if r["op"] == "SET")
    assert all(by[v] for v in VALUE_TYPES)


def nested(path, v):
    for p in reversed(path):
        v = {p: v}
    return v


def changes_of(spark, files):
    """Changes between files of one node, each a list of objects."""
    lines = [(f, i, json.dumps(o)) for f, body in enumerate(files) for i, o in enumerate(body)]
    names = [(f, "n", f"rotated-{f:03d}.jsonl") for f in range(len(files))]
    return sorted(map(tuple, schema_changes(spark.createDataFrame(lines, LINES), spark.createDataFrame(names, FILES)).collect()))


@pytest.mark.parametrize("deep", [4, 5, 6, 20, 40])
def test_fields_in_many_objects_are_found(spark, deep):
    path = [f"o{i}" for i in range(deep)]
    body = lambda p: [{"op": "SET", "ts": i, "key": "k"} | nested(p, VALUE_TYPES[i % 4]) for i in range(6)]
    assert changes_of(spark, [body(["valueType"]), body([*path, "valueType"])]) == [(1, "valueType", "renamed")]


def test_one_name_may_stand_for_either_field(spark):
    sets = lambda v: [{"op": "SET", "ts": 100 + i, "key": "k", "meta": v(i)} for i in range(6)]
    named, expiry = sets(lambda i: VALUE_TYPES[i % 4]), sets(lambda i: 5000 + i if i else 0)
    want = [(1, "expireAt", "added"), (1, "valueType", "removed")]
    assert changes_of(spark, [named, expiry]) == want
    assert changes_of(spark, [named, expiry, expiry, expiry, expiry]) == want
    numbered = sets(lambda i: i % 4)
    assert changes_of(spark, [numbered, expiry]) == want


def test_empty_and_odd_inputs(spark):
    empty = schema_changes(spark.createDataFrame([], LINES + ", path string"), spark.createDataFrame([], FILES + ", rank int"))
    assert empty.collect() == [] and ingest(spark.createDataFrame([], LINES)).collect() == []
    lines = [(1, 1, '{"op":"SET","ts":1,"expireAt":0,"expireAt":5}'), (None, 1, '{"op":"SET","ts":1}'), (9, 1, "[" * 5000), (9, 2, '{"op":"SET","a":{}}')]
    got = schema_changes(spark.createDataFrame(lines, LINES), spark.createDataFrame([(1, "n", "active.jsonl"), (9, None, None)], FILES))
    assert got.collect() == []
    assert ingest(spark.createDataFrame(lines, LINES)).count() == 4


def test_iso_and_digit_expiries(spark):
    body = lambda v: json.dumps({"op": "SET", "ts": 1_672_531_200_000, "until": v, "key": "k", "value": "v"})
    lines = [(1, i, body(v)) for i, v in enumerate(["2023-01-05T00:00:00.500Z", "1672900000000", 1672900000000, 0, "0", None])]
    got = {r.line_no: r.expire_at for r in ingest(spark.createDataFrame(lines, LINES)).collect()}
    assert got == {0: 1672876800500, 1: 1672900000000, 2: 1672900000000, 3: 0, 4: 0, 5: 0}
