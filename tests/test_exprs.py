import random
import re

import pytest
from pyspark.sql import functions as F

from keyloom.functions import exprs, protocol


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


GLOBS = [
    ("foo", "foo", True), ("user:*", "user:001", True), ("u*r:001", "user:001", True), ("user:00*", "user:001", True),
    ("foo", "bar", False), ("", "foo", False), ("a.b", "a.b", True), ("a.b", "axb", False), ("a?b", "acb", False), ("a?b", "a?b", True),
    ("*", "a\nb", False), ("*", "", True), ("*b", "ab\n", False), ("[x]*", "[x]1", True), ("a\\*", "a\\z", True), ("é*", "éa", True),
]


@pytest.mark.parametrize("glob,key,want", GLOBS)
def test_glob_literal_and_column_agree(spark, glob, key, want):
    df = spark.createDataFrame([(key, glob)], "k string, g string")
    assert df.select(exprs.glob_match("k", glob).alias("a"), exprs.glob_match("k", F.col("g")).alias("b")).first() == (want, want)


def test_glob_random(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("ab.*[:\n-_\\", k=rnd.randint(0, 5))), "".join(rnd.choices("ab.*[:\n-_\\", k=rnd.randint(0, 6)))) for _ in range(1500)]
    want = [bool(g) and re.fullmatch(".*".join(map(re.escape, g.split("*"))), k) is not None for g, k in pairs]
    got = spark.createDataFrame([(i, g, k) for i, (g, k) in enumerate(pairs)], "i int, g string, k string").orderBy("i").select(exprs.glob_match("k", F.col("g")).alias("m")).collect()
    assert [r.m for r in got] == want


def test_glob_null_key_and_prefix_pushdown(spark, tmp_path):
    assert spark.createDataFrame([(None,)], "k string").select(exprs.glob_match("k", "*").alias("m")).first().m is False
    spark.createDataFrame([("user:1",)], "key string").write.parquet(str(tmp_path / "s"))
    plan = spark.read.parquet(str(tmp_path / "s")).filter(exprs.glob_match("key", "user:*"))._jdf.queryExecution().toString()
    assert "StringStartsWith(key,user:)" in plan


TYPES = [("abc", "string"), (" [1] ", "list"), ('{"a":"b"}', "map"), ('("a")', "set"), ("(a]", "string"), ("", "string"), ("\t(x)\n", "set"), (None, None)]


@pytest.mark.parametrize("value,want", TYPES)
def test_value_type(spark, value, want):
    assert one(spark, value, exprs.value_type("v")) == want


@pytest.mark.parametrize("value,want", [("true", "bool"), ("1e5", "number"), (" 7 ", "number"), ("NaN", "number"), ("x", "string"), ("[1]", "list"), (None, None)])
def test_type_label(spark, value, want):
    assert one(spark, value, exprs.type_label("v")) == want


def test_container_values(spark):
    assert one(spark, '["a","b"]', exprs.list_value("v")) == ["a", "b"]
    assert one(spark, '("a","b","a")', exprs.set_value("v")) == ["a", "b"]
    assert one(spark, '{"a":"b"}', exprs.map_value("v")) == {"a": "b"}
    assert one(spark, "[1,", exprs.list_value("v")) is None and one(spark, "x", exprs.map_value("v")) is None


@pytest.mark.parametrize(
    "raw,kind,want",
    [("a, b", "list", '["a","b"]'), ("a,,", "list", '["a"]'), (",", "list", "[]"), ("[x", "list", "[x"), ("a,b", "set", '("a","b")'), ("k: v:w,l", "map", '{"k":"v:w","l":""}'), (" 5 ", "number", "5"), (" s ", "string", " s "), ("", "list", ""), (None, "list", None)],
)
def test_wrap_value(spark, raw, kind, want):
    assert one(spark, raw, exprs.wrap_value("v", F.lit(kind))) == want


def test_expiry(spark):
    df = spark.createDataFrame([(1000, 60), (1000, 0), (1000, -1), (1000, 2**62)], "ts bigint, ttl bigint")
    assert [r.e for r in df.select(exprs.expire_at("ts", "ttl").alias("e")).collect()] == [61000, 0, 0, None]
    live = spark.createDataFrame([(0,), (None,), (-1,), (10,), (11,)], "e bigint").select(exprs.live("e", 10).alias("l")).collect()
    assert [r.l for r in live] == [True, True, True, False, True]


@pytest.mark.parametrize("key,want", [("a:b", "a"), ("a:b:c", "a"), (":b", None), ("ab", None), ("a:", "a"), (None, None)])
def test_collection_of(spark, key, want):
    assert one(spark, key, exprs.collection_of("v")) == want


LINES = [
    ("SET foo bar", "SET", ["foo", "bar"], None), ('SET name "张 三"', "SET", ["name", "张 三"], None), ("SET foo bar 60", "SET", ["foo", "bar", "60"], None),
    ("FLUSH", "FLUSH", [], None), ("set foo bar", "SET", ["foo", "bar"], None), ("", None, None, "empty line"), (None, None, None, "empty line"), (" \t ", None, None, "empty line"),
    ('SET k ""', "SET", ["k", ""], None), ('"a"b', "A", ["b"], None), ('SET k "a\\"b"', "SET", ["k", 'a"b'], None), ('SET k "a\\nb"', "SET", ["k", "anb"], None),
    ('SET k a"b', "SET", ["k", 'a"b'], None), ('SET k "open', None, None, "unterminated quoted string"), ("GET a\tb", "GET", ["a\tb"], None), ('SET k "a\nb"', "SET", ["k", "a\nb"], None),
]


@pytest.mark.parametrize("line,verb,args,error", LINES)
def test_parse(spark, line, verb, args, error):
    got = one(spark, line, protocol.parse(F.col("v")))
    assert (got.verb, got.args, got.error) == (verb, args, error)


def test_parse_very_long_line(spark):
    got = one(spark, 'SET k "' + "x\\\\" * 200_000 + '"', protocol.parse(F.col("v")))
    assert got.error is None and len(got.args[1]) == 400_000


WIRES = [
    ("OK", None, None, None, "OK"), ("NIL", None, None, None, "(nil)"), ("INTEGER", 3, None, None, "(integer) 3"), ("VALUE", None, "foo", None, '"foo"'), ("VALUE", None, 'a"b', None, '"a\\"b"'),
    ("VALUE", None, "a\nb", None, "(error) ERR value contains newline"), ("ERROR", None, "boom", None, "(error) ERR boom"), ("MULTI", None, None, ["user:001", "user:002"], '"user:001"\n"user:002"\n*END'), ("MULTI", None, None, [], "*END"),
]


@pytest.mark.parametrize("kind,n,s,lines,want", WIRES)
def test_to_wire(spark, kind, n, s, lines, want):
    df = spark.createDataFrame([(kind, n, s, lines)], "k string, n int, s string, l array<string>")
    assert df.select(protocol.to_wire(F.col("k"), F.col("n"), F.col("s"), F.col("l")).alias("w")).first().w == want


def test_quote_unquote_round_trip(spark):
    values = ["", "a", 'q"', "b\\", '\\"', "张 三", "\t"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.x for r in df.select(protocol.unquote(protocol.quote(F.col("v"))).alias("x")).collect()] == values
