"""HTTP-style requests as a DataFrame: method, path, query and body to status and JSON.

The store's routes over an op log; sockets and headers are not part of it. All key listings of a set of
requests are answered together, from the stretches of the log in which each entry lived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import expire_at
from keyloom.operators.fold import replies
from keyloom.operators.listing import listed, lives
from keyloom.runtime import durable

#: Operations of a request have seq * STEP + their place as their seq in the log, a decimal; no array has more places.
STEP = 1 << 31
_BODY = "value string, ttl bigint, ops array<struct<op:string,key:string,value:string>>"
_PAIRS, _NAMES = "array<struct<key:string,value:string>>", "array<string>"


def _json(text: Column) -> Column:
    """A string as JSON with only backslashes, quotes and line feeds escaped."""
    escaped = F.regexp_replace(F.regexp_replace(text, r'([\\"])', r"\\$1"), "\n", r"\\n")
    return F.concat(F.lit('"'), F.coalesce(escaped, F.lit("")), F.lit('"'))


def routed(requests: DataFrame) -> DataFrame:
    """Requests (seq, ts, method, path, query, body) with route, key and parsed body b."""
    m, p = F.col("method"), F.col("path")
    key = F.when(p.startswith("/api/keys/"), F.substring(p, F.lit(len("/api/keys/") + 1), F.length(p)))
    good = F.try_parse_json("body").isNotNull()
    route = (
        F.when(m == "OPTIONS", "options")
        .when(p == "/api/ping", "ping")
        .when((p == "/api/keys") & (m == "GET"), "list")
        .when((p == "/api/keys") & (m == "DELETE"), "flush")
        .when((p == "/api/keys/batch") & (m == "POST"), F.when(good, "batch").otherwise("bad json"))
        .when(key.isNull(), "not found")
        .when(key == "", "no key")
        .when(m.isin("GET", "DELETE"), F.lower(m))
        .when(m.isin("POST", "PUT"), F.when(~good, "bad json").when(F.col("b.value").isNull(), "no value").otherwise(F.lower(m)))
        .otherwise("not allowed")
    )
    return requests.withColumn("b", F.from_json("body", _BODY)).withColumn("key", key).withColumn("route", route)


def log_of(reqs: DataFrame) -> DataFrame:
    """The op log of routed requests."""
    null = lambda t: F.lit(None).cast(t)
    route, ttl = F.col("route"), F.coalesce("b.ttl", F.lit(0))
    one = F.array(F.struct(F.when(route == "post", "SET").when(route == "get", "GET").when(route == "delete", "DEL").when(route == "put", "MUPD").when(route == "flush", "FLUSH").alias("op"), F.col("key"), F.col("b.value").alias("value")))
    many = F.transform(F.filter("b.ops", lambda o: F.upper(o.op).isin("SET", "DEL") & o.key.isNotNull()), lambda o: F.struct(F.upper(o.op).alias("op"), o.key.alias("key"), o.value.alias("value")))
    rows = reqs.filter(route.isin("post", "get", "delete", "put", "flush", "batch")).withColumn("exp", F.when(route.isin("post", "put"), F.coalesce(expire_at("ts", ttl), F.lit(0))).otherwise(F.lit(0)))
    each = rows.select("seq", "ts", "exp", F.posexplode(F.when(route == "batch", many).otherwise(one)).alias("pos", "o"))
    update = F.col("o.op") == "MUPD"
    return each.select(
        (_place(F.col("seq")) + F.col("pos")).cast("decimal(38,0)").alias("seq"),
        F.col("ts").cast("bigint").alias("ts"),
        F.col("o.op").alias("op"),
        F.when(~update, F.col("o.key")).alias("key"),
        F.when(~update, F.col("o.value")).alias("value"),
        F.col("exp").alias("expireAt"),
        F.when(update, F.array(F.struct(F.col("o.key").alias("key"), F.col("o.value").alias("value")))).otherwise(null(_PAIRS)).alias("items"),
        null(_NAMES).alias("keys"),
    )


def _place(seq: Column) -> Column:
    """Where a request's operations begin in the log."""
    return (seq.cast("decimal(28,0)") * F.lit(STEP).cast("decimal(10,0)")).cast("decimal(38,0)")


def key_listings(requests: DataFrame) -> DataFrame:
    """seq, key for each key listing and the keys that it finds, a row each, for answers too large for one body."""
    reqs = durable(routed(requests))
    log = log_of(reqs)
    return _found(reqs, log, durable(replies(log)))


def _found(reqs: DataFrame, log: DataFrame, r: DataFrame) -> DataFrame:
    lists = reqs.filter("route = 'list'").select(F.col("seq").cast("bigint").alias("req"), _place(F.col("seq")).alias("seq"), F.col("ts").cast("bigint").alias("ts"), pattern_of(F.col("query")).alias("glob"))
    flushes = log.filter("op = 'FLUSH'").select(F.col("seq").alias("m"))
    return listed(lives(r), lists.drop("req"), flushes).select(F.expr(f"seq div {STEP}").alias("seq"), "key")


def respond(requests: DataFrame) -> DataFrame:
    """seq, status, body for every request; ts must not fall with seq, which is unique.

    A batch counts each SET and each DEL that removed something; its other ops, and those without a
    key, do nothing. A body that is no JSON is a server error; an empty table gives no rows.
    """
    reqs = durable(routed(requests))
    log = log_of(reqs)
    r = durable(replies(log))
    done = r.groupBy(F.expr(f"seq div {STEP}").alias("req")).agg(F.sum(((F.col("op") == "SET") | F.col("existed")).cast("int")).alias("n"), F.max("old_value").alias("old"), F.max("existed").alias("existed"))
    listed_ = requests.sparkSession.createDataFrame([], "lseq bigint, keys array<string>")
    if not reqs.filter("route = 'list'").isEmpty():
        listed_ = _found(reqs, log, r).groupBy(F.col("seq").alias("lseq")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    route, key = F.col("route"), F.col("key")
    status = F.when(route.isin("no key", "no value"), 400).when(route == "not found", 404).when(route == "not allowed", 405).when(route == "bad json", 500).otherwise(200)
    named = F.concat(F.lit('{"key":'), _json(key))
    body = (
        F.when(route == "options", "{}")
        .when(route == "ping", '{"pong":true}')
        .when(route == "list", F.to_json(F.struct(F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))))
        .when(route.isin("flush", "post"), '{"ok":true}')
        .when(route == "batch", F.concat(F.lit('{"count":'), F.coalesce("n", F.lit(0)).cast("string"), F.lit("}")))
        .when((route == "get") & F.col("existed"), F.concat(named, F.lit(',"value":'), _json(F.col("old")), F.lit(',"exists":true}')))
        .when(route == "get", F.concat(named, F.lit(',"exists":false}')))
        .when(route == "put", F.concat(F.lit('{"updated":'), F.coalesce("n", F.lit(0)).cast("string"), F.lit("}")))
        .when(route == "delete", F.concat(F.lit('{"deleted":'), F.coalesce("existed", F.lit(False)).cast("string"), F.lit("}")))
        .when(route == "not found", '{"error":"not found"}')
        .when(route == "no key", '{"error":"missing key"}')
        .when(route == "no value", '{"error":"missing value"}')
        .when(route == "not allowed", '{"error":"method not allowed"}')
        .otherwise('{"error":"body is not JSON"}')
    )
    return reqs.join(done, reqs.seq == done.req, "left").join(listed_, reqs.seq == listed_.lseq, "left").select("seq", status.alias("status"), body.alias("body"))


def pattern_of(query: Column) -> Column:
    """The key pattern of a query string; * where it has none."""
    first = F.regexp_extract(query, r"(?:^|&)pattern(=[^&]*)?(?=&|$)", 1)
    text = F.substring(first, F.lit(2), F.length(first))
    return F.when(F.length(first) > 0, F.coalesce(F.try_url_decode(text), text)).otherwise("*")
