"""Queries of the key-value operators over the driver tables, each with its SQL."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import exprs, protocol
from keyloom.operators import collections as C
from keyloom.operators import lookup
from keyloom.operators.compact import compact_segment, merge_runs, snapshot
from keyloom.operators.fold import bounds, explode_ops, fold, op_counts, replies
from keyloom.operators.listing import match_globs
from keyloom.plans.rest import respond
from keyloom.plans.session import batch_count, run_script
from keyloom.runtime import durable, table, use_checkpoint_dir
from keyloom.sources import runs
from keyloom.sources.derived import EARLY, MANY, bulk_log, customer_state, end_of, event_log, user_probes
from keyloom.sources.oplog import append_log, cluster_links, decode, read_log
from keyloom.streaming.keyed import answers
from keyloom.streaming.replica import current, follow, last_batch

#: Files in which the log arrives at the follower, each a batch of its own.
STREAM_FILES = 4
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, long: bool = False):
    """Register a query under its function's name, and if ``long`` as NAME_long over the log with one early FLUSH."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        if long:
            QUERIES[f"{f.__name__}_long"] = partial(f, flush=EARLY)
            SQL[f"{f.__name__}_long"] = sql.replace(MANY, EARLY)
        return f

    return put


def _state(spark: SparkSession, sf_dir: str, flush: str) -> DataFrame:
    log = event_log(spark, sf_dir, flush=flush)
    return fold(log, end_of(log))


def _shared(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``_shared``, once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ---- SQL of the derived logs and of the fold ---------------------------------------------------------

_EVENTS = """ev AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, CASE WHEN event_id % 4000 = 3999 THEN 'flush' ELSE event_type END AS kind, user_id, value, props FROM events)"""
_OPS = f"""{_EVENTS}, o AS (
    SELECT seq, ts, 0 AS pos, CASE kind WHEN 'view' THEN 'MUPD' WHEN 'error' THEN 'DEL' WHEN 'flush' THEN 'FLUSH' ELSE 'SET' END AS op,
        CASE kind WHEN 'view' THEN 'U' WHEN 'error' THEN 'D' ELSE 'W' END AS kind, 'user:' || user_id AS key,
        CASE kind WHEN 'signup' THEN props WHEN 'purchase' THEN 'p' || seq WHEN 'click' THEN '["c' || seq || '"]' WHEN 'view' THEN 'v' || seq END AS value,
        CASE kind WHEN 'purchase' THEN ts + CAST(floor(value) AS BIGINT) * 1000000 ELSE 0 END AS e FROM ev)"""
_BULK = f"""{_EVENTS}, p AS (
    SELECT seq, ts, CASE kind WHEN 'view' THEN 'MUPD' WHEN 'error' THEN 'MDEL' WHEN 'purchase' THEN 'SET' WHEN 'flush' THEN 'FLUSH' ELSE 'MSET' END AS op,
        'user:' || user_id AS one, 'user:' || (user_id + 1) AS two, CASE kind WHEN 'purchase' THEN ts + CAST(floor(value) AS BIGINT) * 1000000 ELSE 0 END AS e FROM ev),
    o AS (
    SELECT seq, ts, pos, op, CASE op WHEN 'MUPD' THEN 'U' WHEN 'MDEL' THEN 'D' ELSE 'W' END AS kind, CASE pos WHEN 1 THEN two ELSE one END AS key,
        CASE op WHEN 'SET' THEN 'p' WHEN 'MDEL' THEN NULL ELSE ['a', 'b', 'c'][pos + 1] END || seq AS value, e
    FROM p, (SELECT unnest([0, 1, 2]) AS pos) WHERE pos = 0 OR op NOT IN ('SET', 'FLUSH'))"""
_CHAIN = """s AS (SELECT *, sum(CASE kind WHEN 'W' THEN 1 WHEN 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY key, epoch ORDER BY seq, pos) AS seg FROM a),
    l AS (SELECT *, CASE WHEN seg = 0 THEN NULL ELSE last_value(CASE kind WHEN 'D' THEN 1 WHEN 'R' THEN NULL ELSE e END IGNORE NULLS) OVER (PARTITION BY key, epoch, seg ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS p FROM s),
    g AS (SELECT *, bool_and(CASE WHEN kind = 'U' THEN coalesce(p <= 0 OR ts < p, FALSE) END) OVER (PARTITION BY key, epoch, seg ORDER BY seq, pos) AS ok FROM l),
    k AS (SELECT *, kind IN ('W', 'D') OR (kind = 'U' AND coalesce(ok, FALSE)) AS took FROM g)"""
_ALL = f"a AS (SELECT o.*, coalesce(f.n, 0) AS epoch FROM (SELECT * FROM o WHERE op <> 'FLUSH') o ASOF LEFT JOIN (SELECT seq AS fs, row_number() OVER (ORDER BY seq) AS n FROM o WHERE op = 'FLUSH') f ON o.seq > f.fs), {_CHAIN}"
_STATE = f"""{_ALL}, st AS (
    SELECT key, value, e AS expire_at, ts AS created_at FROM (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, pos DESC) AS r FROM k WHERE took AND epoch = (SELECT count(*) FROM o WHERE op = 'FLUSH'))
    WHERE r = 1 AND kind <> 'D' AND (e <= 0 OR (SELECT max(ts) + 1 FROM o) < e))"""
_SEEN = f"""{_ALL}, v AS (
    SELECT *, last_value(CASE WHEN took THEN {{'kind': kind, 'e': e, 'value': value}} END IGNORE NULLS) OVER (PARTITION BY key, epoch ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM k),
    w AS (SELECT *, q IS NOT NULL AND q.kind <> 'D' AND (q.e <= 0 OR ts < q.e) AS existed FROM v)"""
_TRIM = "regexp_replace({0}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def _type_sql(v: str) -> str:
    t = _TRIM.format(v)
    return f"CASE WHEN {t} LIKE '(%)' THEN 'set' WHEN {t} LIKE '[%]' THEN 'list' WHEN {t} LIKE '{{%}}' THEN 'map' WHEN {v} IS NOT NULL THEN 'string' END"


_QUOTE = """CASE WHEN {0} IS NULL OR regexp_matches({0}, '[\\n\\r]') THEN '(error) ERR value contains newline' ELSE '"' || regexp_replace({0}, '(["\\\\])', '\\\\\\1', 'g') || '"' END"""


# ---- fold and replies --------------------------------------------------------------------------------


@query(f"WITH {_OPS}, {_STATE} SELECT key, value, {_type_sql('value')} AS value_type, expire_at, created_at FROM st", long=True)
def fold_state(spark, sf_dir, flush=MANY):
    """The whole log folded to the current state."""
    return _state(spark, sf_dir, flush)


@query(f"WITH {_BULK}, {_STATE} SELECT key, value, expire_at FROM st", long=True)
def fold_bulk(spark, sf_dir, flush=MANY):
    """A log of bulk operations folded; of repeated keys in one operation the last pair wins."""
    log = bulk_log(spark, sf_dir, flush)
    return fold(log, end_of(log)).select("key", "value", "expire_at")


@query(f"WITH {_OPS} SELECT key, max(seq) > (SELECT max(seq) FROM o WHERE op = 'FLUSH') AS later FROM o WHERE op <> 'FLUSH' GROUP BY key", long=True)
def fold_flush(spark, sf_dir, flush=MANY):
    """All keys ever touched, and whether an operation behind the last FLUSH touches them."""
    log = event_log(spark, sf_dir, flush=flush)
    ops = explode_ops(log).groupBy("key").agg(F.max("seq").alias("last"))
    return ops.select("key", (F.col("last") > F.lit(bounds(log).flush)).alias("later"))


@query(f"WITH {_OPS} SELECT seq, key, (e <= 0 OR (SELECT max(ts) + 1 FROM o) < e) AS live FROM o WHERE op = 'SET'")
def ttl_live(spark, sf_dir):
    """Whether what each SET wrote would still live behind the log."""
    log = event_log(spark, sf_dir)
    return log.filter("op = 'SET'").select("seq", "key", exprs.live("expireAt", end_of(log)).alias("live"))


@query(f"WITH {_OPS} SELECT seq, CASE WHEN ttl > 0 THEN ts + ttl * 1000 ELSE 0 END AS expire_at FROM (SELECT seq, ts, CAST(floor(value) AS BIGINT) - 20 AS ttl FROM ev)")
def ttl_expire_at(spark, sf_dir):
    """Expiry moments of times to live in seconds; none of those up to zero."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), exprs.expire_at(ms, F.floor("value").cast("bigint") - 20).alias("expire_at"))


@query(f"WITH {_OPS} SELECT key, arg_max(value, seq) AS value, arg_max(e, seq) AS expire_at FROM o WHERE op = 'SET' GROUP BY key")
def set_overwrite(spark, sf_dir):
    """Value and expiry of each key's last SET."""
    last = F.max_by(F.struct("value", "expireAt"), "seq").alias("x")
    return event_log(spark, sf_dir).filter("op = 'SET'").groupBy("key").agg(last).select("key", "x.value", F.col("x.expireAt").alias("expire_at"))


@query(f"WITH {_OPS}, {_SEEN} SELECT seq, key, CAST(existed AS INT) AS removed FROM w WHERE op = 'DEL'")
def del_result(spark, sf_dir):
    """What each DEL replies."""
    return replies(event_log(spark, sf_dir)).filter("op = 'DEL'").select("seq", "key", F.col("existed").cast("int").alias("removed"))


@query(f"WITH {_OPS}, {_SEEN} SELECT seq, key, took AS applied FROM w WHERE op = 'MUPD'")
def mupd_applied(spark, sf_dir):
    """Whether each update found its key."""
    return replies(event_log(spark, sf_dir)).filter("op = 'MUPD'").select("seq", "key", F.col("existed").alias("applied"))


@query(f"WITH {_BULK}, {_SEEN} SELECT seq, op, CAST(sum(CAST(existed AS INT)) AS BIGINT) AS n FROM w WHERE op IN ('MDEL', 'MUPD') GROUP BY 1, 2")
def bulk_counts(spark, sf_dir):
    """What each MDEL and MUPD replies."""
    return op_counts(bulk_log(spark, sf_dir))


@query(f"WITH {_OPS.replace(chr(39) + 'MUPD' + chr(39), chr(39) + 'GET' + chr(39)).replace(chr(39) + 'U' + chr(39), chr(39) + 'R' + chr(39))}, {_SEEN} SELECT seq, key, CASE WHEN existed THEN q.value END AS value FROM w WHERE op = 'GET'")
def asof_get(spark, sf_dir):
    """The value that each read sees between the writes of the log."""
    return replies(event_log(spark, sf_dir, "GET")).filter("op = 'GET'").select("seq", "key", F.col("old_value").alias("value"))


@query("SELECT line_id, k AS key, v AS value FROM (SELECT line_id, i.key AS k, i.value AS v, row_number() OVER (PARTITION BY line_id, i.key ORDER BY pos DESC) AS r FROM (SELECT line_id, unnest(items) AS i, generate_subscripts(items, 1) AS pos FROM active WHERE op = 'MSET')) WHERE r = 1 AND k IS NOT NULL")
def mset_dupes(spark, sf_dir):
    """What each MSET of the logs writes: of a repeated key the last pair."""
    log = table(spark, sf_dir, "active").filter("op = 'MSET'").select(F.col("line_id").alias("seq"), "ts", "op", "key", "value", "expireAt", "items", "keys")
    return explode_ops(log).groupBy("seq", "key").agg(F.max_by("value", "pos").alias("value")).select(F.col("seq").alias("line_id"), "key", "value")


# ---- lookups ------------------------------------------------------------------------------------------


@query(f"WITH {_OPS}, {_STATE} SELECT value FROM st WHERE key = 'user:7'")
def get_point(spark, sf_dir, flush=MANY, key="user:7"):
    """One key's value."""
    return lookup.get(_state(spark, sf_dir, flush), key)


# user:7 ends deleted in the long log at sf0.1; user:1 lives at every size
QUERIES["get_point_long"] = partial(get_point, flush=EARLY, key="user:1")
SQL["get_point_long"] = SQL["get_point"].replace(MANY, EARLY).replace("'user:7'", "'user:1'")


@query(f"WITH {_OPS}, {_STATE} SELECT c_custkey AS pos, 'user:' || c_custkey AS key, coalesce(value, '(nil)') AS value FROM customer LEFT JOIN st ON st.key = 'user:' || c_custkey", long=True)
def mget(spark, sf_dir, flush=MANY):
    """A value, or (nil), for every probe."""
    return lookup.mget(_state(spark, sf_dir, flush), user_probes(spark, sf_dir))


@query(f"WITH {_OPS}, {_STATE} SELECT key FROM st WHERE key IN (SELECT 'user:' || c_custkey FROM customer)", long=True)
def exists(spark, sf_dir, flush=MANY):
    """The probes that exist."""
    return lookup.exists(_state(spark, sf_dir, flush), user_probes(spark, sf_dir))


@query(f"WITH {_OPS}, {_STATE} SELECT 'user:' || c_custkey AS key, coalesce({_type_sql('value')}, 'none') AS type FROM customer LEFT JOIN st ON st.key = 'user:' || c_custkey", long=True)
def type_of(spark, sf_dir, flush=MANY):
    """The type of every probe's value, or none."""
    return lookup.type_of(_state(spark, sf_dir, flush), user_probes(spark, sf_dir))


@query("SELECT c_mktsegment || ':' || c_custkey AS key FROM customer WHERE starts_with(c_mktsegment || ':' || c_custkey, 'BUILDING:1')")
def keys_prefix(spark, sf_dir):
    """Keys below a prefix."""
    return lookup.keys(customer_state(spark, sf_dir), "BUILDING:1*")


@query("SELECT c_mktsegment || ':' || c_custkey AS key FROM customer WHERE regexp_full_match(c_mktsegment || ':' || c_custkey, 'A.*:.*5')")
def keys_middle(spark, sf_dir):
    """Keys by a glob with two stars."""
    return lookup.keys(customer_state(spark, sf_dir), "A*:*5")


@query("SELECT line_id, key FROM active WHERE key IS NOT NULL AND regexp_full_match(key, 'feed:.*/.*')")
def keys_literal(spark, sf_dir):
    """Keys by a glob with characters that mean something to regular expressions."""
    return table(spark, sf_dir, "active").filter(exprs.glob_match("key", "feed:*/*")).select("line_id", "key")


@query("SELECT r_name AS region, c_mktsegment || ':' || c_custkey AS key FROM customer, region WHERE regexp_full_match(c_mktsegment || ':' || c_custkey, substr(r_name, 1, 1) || '.*:.*' || r_regionkey)")
def keys_pattern_column(spark, sf_dir):
    """Keys by globs that are data: joined on what a pattern begins with."""
    patterns = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.concat(F.substring("r_name", 1, 1), F.lit("*:*"), "r_regionkey").alias("glob"))
    return match_globs(customer_state(spark, sf_dir).select("key"), patterns).select("region", "key")


@query(f"WITH {_OPS}, {_STATE} SELECT key, value FROM st WHERE key >= 'user:2' AND key < 'user:5'", long=True)
def range_scan(spark, sf_dir, flush=MANY):
    """Entries in a range of keys."""
    return lookup.key_range(_state(spark, sf_dir, flush), "user:2", "user:5").select("key", "value")


@query(f"WITH {_OPS}, {_STATE} SELECT count(*) AS n FROM st", long=True)
def size(spark, sf_dir, flush=MANY):
    """Number of entries."""
    return lookup.size(_state(spark, sf_dir, flush))


@query(f"WITH {_OPS}, {_STATE} SELECT st.key, CASE WHEN c_custkey IS NULL THEN value ELSE c_name END AS value, CASE WHEN c_custkey IS NULL THEN expire_at ELSE 0 END AS expire_at FROM st LEFT JOIN customer ON st.key = 'user:' || c_custkey", long=True)
def update_existing(spark, sf_dir, flush=MANY):
    """The state after updating the customers' keys that exist."""
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("user:"), "c_custkey").alias("key"), F.col("c_name").alias("value"))
    return lookup.update_existing(_state(spark, sf_dir, flush), pairs)


@query(f"WITH {_OPS}, {_STATE} SELECT key, value FROM st WHERE key NOT IN (SELECT 'user:' || s_suppkey FROM supplier)", long=True)
def delete_keys(spark, sf_dir, flush=MANY):
    """The state after deleting the suppliers' numbers."""
    gone = table(spark, sf_dir, "supplier").select(F.concat(F.lit("user:"), "s_suppkey").alias("key"))
    return lookup.without(_state(spark, sf_dir, flush), gone).select("key", "value")


@query(f"WITH {_OPS}, {_STATE} SELECT coalesce('moved:' || s_suppkey, key) AS key, value, CASE WHEN s_suppkey IS NULL THEN expire_at ELSE 0 END AS expire_at FROM st LEFT JOIN supplier ON key = 'user:' || s_suppkey", long=True)
def rename(spark, sf_dir, flush=MANY):
    """The state after renaming the suppliers' numbers."""
    pairs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("user:"), "s_suppkey").alias("old"), F.concat(F.lit("moved:"), "s_suppkey").alias("new"))
    return lookup.rename(_state(spark, sf_dir, flush), pairs)


# ---- collections --------------------------------------------------------------------------------------


def _declared_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").agg(F.to_json(F.array_sort(F.collect_list("r_name"))).alias("value"))
    return customer_state(spark, sf_dir).union(names.select(F.lit(exprs.META_KEY), "value", F.lit(0).cast("bigint")))


@query("SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT r_name FROM region")
def collection_list(spark, sf_dir):
    """Declared collections and those seen in keys."""
    return C.names(_declared_state(spark, sf_dir))


@query("SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1")
def collection_counts(spark, sf_dir):
    """Keys in each collection."""
    return C.counts(_declared_state(spark, sf_dir))


@query("SELECT DISTINCT name, CASE WHEN name IN (SELECT r_name FROM region) OR name IN (SELECT c_mktsegment FROM customer) THEN 'collection already exists: ' || name END AS error FROM (SELECT n_name AS name FROM nation UNION SELECT c_mktsegment FROM customer UNION SELECT r_name FROM region)")
def collection_create_check(spark, sf_dir):
    """Why a collection cannot be created."""
    t = lambda n: table(spark, sf_dir, n)
    wanted = t("nation").select(F.col("n_name").alias("name")).union(t("customer").select("c_mktsegment")).union(t("region").select("r_name"))
    return C.create_errors(_declared_state(spark, sf_dir), wanted)


@query("""SELECT '__collections__' AS key, '["' || string_agg(name, '","' ORDER BY name) || '"]' AS value FROM (SELECT r_name AS name FROM region UNION SELECT n_name FROM nation)""")
def collection_create(spark, sf_dir):
    """The meta row after declaring every nation."""
    return C.create(_declared_state(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query("SELECT c_mktsegment || ':' || c_custkey AS key FROM customer WHERE c_mktsegment <> 'BUILDING'")
def collection_drop(spark, sf_dir):
    """Keys left after dropping a collection."""
    return C.drop(customer_state(spark, sf_dir), "BUILDING").select("key")


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN ['web:user:' || user_id, props] WHEN 'click' THEN ['web:a' || user_id, 'x', 'web:b', 'y'] WHEN 'view' THEN ['web:k' || user_id, 'web:l'] WHEN 'error' THEN ['web:*'] ELSE ['p'] END AS args FROM events""")
def use_prefix(spark, sf_dir):
    """Arguments with a session's collection before their keys."""
    u, t = F.col("user_id").cast("string"), F.col("event_type")
    verb = F.when(t == "signup", "SET").when(t == "click", "MSET").when(t == "view", "MGET").when(t == "error", "KEYS").otherwise("PING")
    args = F.when(t == "signup", F.array(F.concat(F.lit("web:user:"), u), "props")).when(t == "click", F.array(F.concat(F.lit("a"), u), F.lit("x"), F.lit("b"), F.lit("y"))).when(t == "view", F.array(F.concat(F.lit("k"), u), F.lit("web:l"))).when(t == "error", F.array().cast("array<string>")).otherwise(F.array(F.lit("p")))
    return table(spark, sf_dir, "events").select("event_id", exprs.apply_prefix(verb, args, F.lit("web")).alias("args"))


# ---- protocol and values ----------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.regexp_replace("props", r'(["\\])', r"\\$1"), F.lit('"'))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("  set user:"), "user_id", F.lit("  "), quoted, F.lit(" 60 ")).alias("line"))


@query("SELECT event_id, ['set', 'user:' || user_id, props, '60'] AS tokens FROM events")
def tokenize(spark, sf_dir):
    """Tokens of command lines with quoted values."""
    return _lines(spark, sf_dir).select("event_id", protocol.tokens(F.col("line")).alias("tokens"))


@query("SELECT event_id, 'SET' AS verb, ['user:' || user_id, props, '60'] AS args FROM events")
def parse_lines(spark, sf_dir):
    """Verb and arguments of command lines."""
    return _lines(spark, sf_dir).select("event_id", protocol.parse(F.col("line")).alias("p")).select("event_id", "p.verb", "p.args")


@query(f"SELECT line_id, {_QUOTE.format('value')} AS wire FROM active")
def quote_wire(spark, sf_dir):
    """Values as they are sent."""
    return table(spark, sf_dir, "active").select("line_id", protocol.quote(F.col("value")).alias("wire"))


@query(f"SELECT doc_id, {_QUOTE.format('text')} AS wire FROM documents")
def quote_documents(spark, sf_dir):
    """Whole documents as values to be sent; line ends cannot be."""
    return table(spark, sf_dir, "documents").select("doc_id", protocol.quote(F.col("text")).alias("wire"))


@query(f"SELECT line_id, CASE WHEN ty <> 'string' THEN ty WHEN {_TRIM.format('value')} IN ('true', 'false') THEN 'bool' WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'number' ELSE ty END AS label FROM (SELECT line_id, value, {_type_sql('value')} AS ty FROM active)")
def type_label(spark, sf_dir):
    """Values by what they look like, numbers and booleans included."""
    return table(spark, sf_dir, "active").select("line_id", exprs.type_label("value").alias("label"))


@query("""SELECT c_custkey, '["' || c_name || '","' || c_mktsegment || '"]' AS l, '("' || c_name || '","' || c_mktsegment || '")' AS s, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS m FROM customer""")
def wrap_value(spark, sf_dir):
    """Comma-separated inputs as lists, sets and maps."""
    flat = F.concat_ws(" , ", "c_name", "c_mktsegment")
    pairs = F.concat(F.lit("name: "), F.col("c_name"), F.lit(", segment :"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", exprs.wrap_value(flat, F.lit("list")).alias("l"), exprs.wrap_value(flat, F.lit("set")).alias("s"), exprs.wrap_value(pairs, F.lit("map")).alias("m"))


@query("""SELECT line_id, unnest(from_json(value, '["VARCHAR"]')) AS item FROM active WHERE value LIKE '[%]' AND json_valid(value)""")
def list_items(spark, sf_dir):
    """The strings of all list values."""
    return table(spark, sf_dir, "active").select("line_id", F.explode(exprs.list_value("value")).alias("item"))


@query("""SELECT line_id, unnest(json_keys(value)) AS k FROM active WHERE value LIKE '{%}' AND json_valid(value)""")
def map_keys(spark, sf_dir):
    """The keys of all map values."""
    return table(spark, sf_dir, "active").select("line_id", F.explode(F.map_keys(exprs.map_value("value"))).alias("k"))


# ---- logs, runs, scripts, streams ----------------------------------------------------------------------


@query("""SELECT file_id, line_no, line ->> 'op' AS op, line ->> 'key' AS key, CAST(line ->> 'ts' AS BIGINT) AS ts FROM (SELECT * FROM log_lines WHERE json_valid(line)) WHERE line ->> 'op' IN ('SET', 'DEL', 'MSET', 'MDEL', 'MUPD', 'FLUSH')""")
def decode_lines(spark, sf_dir):
    """Operations of raw log lines; what does not decode is skipped."""
    lines = table(spark, sf_dir, "log_lines").select("file_id", "line_no", decode(F.col("line")).alias("o")).filter("o is not null")
    return lines.select("file_id", "line_no", "o.op", "o.key", "o.ts")


@query(f"WITH {_OPS}, {_STATE} SELECT key, value, expire_at FROM st", long=True)
def replay_log(spark, sf_dir, flush=MANY):
    """The log written to rotated files, read back in order and folded."""
    path = _shared(spark, "log")
    log = event_log(spark, sf_dir, flush=flush)
    append_log(log.withColumn("valueType", F.lit(None).cast("string")), path, gzip=True)
    back = read_log(spark, path)
    state = durable(fold(back, end_of(log)).select("key", "value", "expire_at"))
    _forget(spark, path)
    return state


@query(f"WITH {_OPS}, {_STATE} SELECT key, value, expire_at AS \"expireAt\", created_at AS ts FROM st", long=True)
def compact_log(spark, sf_dir, flush=MANY):
    """The log compacted to one SET for each entry."""
    log = event_log(spark, sf_dir, flush=flush)
    return snapshot(log, end_of(log)).select("key", "value", "expireAt", "ts")


@query(f"WITH {_OPS} SELECT key, x.value AS value, x.e AS expire_at FROM (SELECT key, arg_max({{'op': op, 'value': value, 'e': e}}, seq) AS x FROM o WHERE op IN ('SET', 'DEL') GROUP BY key) WHERE x.op = 'SET'")
def merge_sorted_runs(spark, sf_dir):
    """Four runs, each with the last write or deletion of its keys, merged; the newest run wins."""
    ops = event_log(spark, sf_dir).filter("op in ('SET', 'DEL')").select("seq", "op", "key", "value", F.col("expireAt").alias("expire_at"))
    high = (ops.agg(F.max("seq")).first()[0] or 0) + 1
    runs = []
    for i in range(4):
        part = ops.filter((F.col("seq") >= high * i // 4) & (F.col("seq") < high * (i + 1) // 4))
        runs.append(part.groupBy("key").agg(F.max_by(F.struct("op", "value", "expire_at"), "seq").alias("x")).select("key", "x.*"))
    return merge_runs(runs).select("key", "value", "expire_at")


@query(f"WITH {_OPS}, {_SEEN} SELECT CAST(sum(CASE WHEN op = 'SET' THEN 1 WHEN q IS NOT NULL AND q.kind <> 'D' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM w".replace("FROM ev)", "FROM ev WHERE kind NOT IN ('view', 'flush'))").replace("ts + CAST(floor(value) AS BIGINT) * 1000000", "0"))
def rest_batch(spark, sf_dir):
    """The count of a batch of SETs (without expiry) and DELs."""
    return batch_count(event_log(spark, sf_dir).filter("op in ('SET', 'DEL')"))


@query(f"""WITH {_OPS.replace(chr(39) + 'MUPD' + chr(39), chr(39) + 'GET' + chr(39)).replace(chr(39) + 'U' + chr(39), chr(39) + 'R' + chr(39)).replace("ts + CAST(floor(value) AS BIGINT) * 1000000", "CASE WHEN value >= 1 THEN ts + CAST(floor(value) AS BIGINT) * 1000 ELSE 0 END")}, {_SEEN},
    r AS (SELECT seq, CASE op WHEN 'SET' THEN 'OK' WHEN 'DEL' THEN '(integer) ' || CAST(existed AS INT) ELSE CASE WHEN existed THEN {_QUOTE.format('q.value')} ELSE '(nil)' END END AS reply FROM w)
    SELECT seq, reply FROM r UNION ALL SELECT seq, 'OK' FROM o WHERE op = 'FLUSH'""")
def session_script(spark, sf_dir):
    """Replies to a script of command lines, one line for each event."""
    log = event_log(spark, sf_dir, "GET")
    value = F.concat(F.lit('"'), F.regexp_replace("value", r'(["\\])', r"\\$1"), F.lit('"'))
    ttl = F.when(F.col("expireAt") > 0, F.concat(F.lit(" "), ((F.col("expireAt") - F.col("ts")) / 1_000_000).cast("bigint").cast("string"))).otherwise("")
    line = F.when(F.col("op") == "SET", F.concat(F.lit("set "), "key", F.lit(" "), value, ttl)).when(F.col("op") == "FLUSH", "FLUSH").otherwise(F.concat_ws(" ", "op", "key"))
    script = log.select(F.lit("s").alias("session"), "seq", "ts", line.alias("line"))
    return run_script(script).select("seq", "reply")


@query(f"WITH {_OPS}, {_STATE} SELECT key, value, expire_at FROM st", long=True)
def stream_replica(spark, sf_dir, flush=MANY):
    """A follower's state after the log has arrived as a stream of files."""
    path = _shared(spark, "stream")
    log = event_log(spark, sf_dir, flush=flush)
    b = bounds(log)
    low, step = b.low or 0, ((b.high or 0) - (b.low or 0)) // STREAM_FILES + 1
    for i in range(STREAM_FILES):
        # one file after the other, so that batches come in the order of seq
        part = log.filter((F.col("seq") >= low + i * step) & (F.col("seq") < low + (i + 1) * step))
        part.withColumn("valueType", F.lit(None).cast("string")).coalesce(1).write.mode("append").json(f"{path}/log")
        follow(spark, f"{path}/log", f"{path}/state", f"{path}/checkpoint", once=True, files=1).awaitTermination()
    state = durable(current(spark, f"{path}/state", last_batch(spark, f"{path}/state"), end_of(log)).select("key", "value", "expire_at"))
    _forget(spark, path)
    return state


@query("SELECT nodeId, p.nodeId AS peer, p.host AS host, coalesce(p.port, 0) AS port, coalesce(p.clusterPort, 0) AS \"clusterPort\" FROM (SELECT nodeId, unnest(peers) AS p FROM nodes)")
def cluster_peers(spark, sf_dir):
    """A row for each peer of each node."""
    return cluster_links(table(spark, sf_dir, "nodes"))


# ---- runs over written files --------------------------------------------------------------------------


def _run_store(spark: SparkSession, sf_dir: str, flush: str) -> tuple[str, int]:
    """A log of four files and a tail, with a sorted run for each of the four, and a moment behind it."""
    path = _shared(spark, "runs")
    log = event_log(spark, sf_dir, flush=flush).withColumn("valueType", F.lit(None).cast("string"))
    b = bounds(log)
    low, step = b.low or 0, ((b.high or 0) - (b.low or 0)) // 5 + 1
    for i in range(5):
        append_log(log.filter((F.col("seq") >= low + i * step) & (F.col("seq") < low + (i + 1) * step)), path)
        if i < 4:
            runs.flush_tail(spark, path)
    return path, end_of(log)


def _entries(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    found = durable(df.select("key", "value", "expire_at", "created_at"))
    _forget(spark, path)
    return found


@query(f"WITH {_OPS}, {_STATE} SELECT key, value, expire_at, created_at FROM st", long=True)
def run_scan(spark, sf_dir, flush=MANY):
    """The state off sorted runs and the log behind them."""
    path, now = _run_store(spark, sf_dir, flush)
    return _entries(runs.state(spark, path, now), spark, path)


@query(f"WITH {_OPS}, {_STATE} SELECT key, value, expire_at, created_at FROM st", long=True)
def run_merge(spark, sf_dir, flush=MANY):
    """The same after the runs were merged into one."""
    path, now = _run_store(spark, sf_dir, flush)
    runs.maintain(spark, path, 0)
    return _entries(runs.state(spark, path, now), spark, path)


@query(f"WITH {_OPS}, {_STATE} SELECT key, value, expire_at, created_at FROM st WHERE key = 'user:1'", long=True)
def run_point_get(spark, sf_dir, flush=MANY):
    """One key's entry, asked of each run."""
    path, now = _run_store(spark, sf_dir, flush)
    return _entries(runs.state(spark, path, now, "user:1"), spark, path)


@query(f"WITH {_OPS}, {_STATE} SELECT key, value, expire_at FROM st", long=True)
def compacted_segments(spark, sf_dir, flush=MANY):
    """The state of a log of which each of two stretches was compacted by itself."""
    log = event_log(spark, sf_dir, flush=flush).withColumn("valueType", F.lit(None).cast("string"))
    b = bounds(log)
    cut = ((b.low or 0) + (b.high or 0)) // 2
    parts = compact_segment(log.filter(F.col("seq") <= cut)).unionByName(compact_segment(log.filter(F.col("seq") > cut)))
    return fold(parts, end_of(log)).select("key", "value", "expire_at")


# ---- requests, sessions, keyed streams -----------------------------------------------------------------

_JSON = """'"' || replace(regexp_replace({0}, '(["\\\\])', '\\\\\\1', 'g'), chr(10), '\\n') || '"'"""
#: One request for each event: every 97th ones ask for something else, the others set, update, read, delete and flush.
_REQUESTS = """r AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, event_id % 97 AS odd, 'user:' || user_id AS key, props, value AS v,
        CASE WHEN event_id % 4000 = 3999 THEN 'FLUSH' WHEN event_id % 97 BETWEEN 5 AND 12 THEN 'ODD' WHEN event_type IN ('signup', 'click') THEN 'SET' WHEN event_type = 'purchase' THEN 'MUPD' WHEN event_type = 'view' THEN 'GET' ELSE 'DEL' END AS op FROM events),
    o AS (SELECT seq, ts, 0 AS pos, op, CASE op WHEN 'SET' THEN 'W' WHEN 'MUPD' THEN 'U' WHEN 'GET' THEN 'R' ELSE 'D' END AS kind, key, CASE op WHEN 'SET' THEN props WHEN 'MUPD' THEN 'p' || seq END AS value,
        CASE WHEN op IN ('SET', 'MUPD') AND floor(v) > 40 THEN ts + CAST(floor(v) AS BIGINT) * 1000000 ELSE 0 END AS e FROM r WHERE op <> 'ODD')"""


@query(f"""WITH {_REQUESTS}, {_SEEN},
    li AS (SELECT seq, ts, (SELECT count(*) FROM o x WHERE x.op = 'FLUSH' AND x.seq < r.seq) AS epoch FROM r WHERE op = 'ODD' AND odd = 12),
    mk AS (SELECT li.seq, li.ts, k.key, arg_max({{'kind': k.kind, 'e': k.e}}, k.seq) AS x FROM li JOIN k ON k.epoch = li.epoch AND k.seq < li.seq AND k.took AND k.key LIKE 'user:1%' GROUP BY ALL),
    ll AS (SELECT li.seq, list_sort(list(mk.key) FILTER (x.kind <> 'D' AND (x.e <= 0 OR mk.ts < x.e))) AS keys FROM li LEFT JOIN mk USING (seq) GROUP BY li.seq)
    SELECT r.seq, CASE WHEN r.op <> 'ODD' OR odd IN (5, 6, 12) THEN 200 WHEN odd = 7 THEN 404 WHEN odd = 8 THEN 405 WHEN odd = 9 THEN 500 ELSE 400 END AS status,
        CASE WHEN r.op = 'ODD' THEN CASE odd WHEN 5 THEN '{{"pong":true}}' WHEN 6 THEN '{{}}' WHEN 7 THEN '{{"error":"not found"}}' WHEN 8 THEN '{{"error":"method not allowed"}}' WHEN 9 THEN '{{"error":"body is not JSON"}}' WHEN 10 THEN '{{"error":"missing value"}}' WHEN 11 THEN '{{"error":"missing key"}}'
                ELSE '{{"keys":[' || coalesce('"' || array_to_string(ll.keys, '","') || '"', '') || ']}}' END
             WHEN r.op IN ('FLUSH', 'SET') THEN '{{"ok":true}}' WHEN r.op = 'MUPD' THEN '{{"updated":' || CAST(w.existed AS INT) || '}}' WHEN r.op = 'DEL' THEN '{{"deleted":' || CAST(w.existed AS VARCHAR) || '}}'
             WHEN w.existed THEN '{{"key":"' || r.key || '","value":' || {_JSON.format("w.q.value")} || ',"exists":true}}' ELSE '{{"key":"' || r.key || '","exists":false}}' END AS body
    FROM r LEFT JOIN w ON w.seq = r.seq LEFT JOIN ll ON ll.seq = r.seq""")
def rest_requests(spark, sf_dir):
    """Status and body of a request for each event, over all routes but the batch."""
    e = table(spark, sf_dir, "events")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    odd, t = F.when((F.col("event_id") % 4000 != 3999) & (F.col("event_id") % 97).between(5, 12), F.col("event_id") % 97), F.col("event_type")
    flush = F.col("event_id") % 4000 == 3999
    own = F.concat(F.lit("/api/keys/user:"), "user_id")
    kind = F.when(flush, "flush").when(t.isin("signup", "click"), "set").when(t == "purchase", "update").when(t == "view", "get").otherwise("delete")
    ttl = F.when(F.floor("value") > 40, F.floor("value").cast("bigint") * 1000)
    value = F.when(kind == "set", F.col("props")).when(kind == "update", F.concat(F.lit("p"), "event_id"))
    methods = {5: "GET", 6: "OPTIONS", 7: "GET", 8: "PATCH", 9: "POST", 10: "POST", 11: "GET", 12: "GET"}
    paths = {5: "/api/ping", 6: "/api/keys", 7: "/nope", 8: "/api/keys/x", 9: "/api/keys/x", 10: "/api/keys/x", 11: "/api/keys/", 12: "/api/keys"}
    by = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[odd]
    method = F.coalesce(by(methods), F.when(flush, "DELETE").when(kind == "set", "POST").when(kind == "update", "PUT").when(kind == "get", "GET").otherwise("DELETE"))
    path = F.coalesce(by(paths), F.when(flush, "/api/keys").otherwise(own))
    body = F.when(odd == 9, "{").when(odd == 10, "{}").when(odd.isNull() & value.isNotNull(), F.to_json(F.struct(value.alias("value"), ttl.alias("ttl"))))
    return respond(e.select(F.col("event_id").alias("seq"), ms.alias("ts"), method.alias("method"), path.alias("path"), F.when(odd == 12, "pattern=user%3A1*").alias("query"), body.alias("body")))


@query(r"""WITH e AS (SELECT event_id AS seq, user_id % 3 AS session, event_id % 12 AS n, 'k' || (user_id % 20) AS k FROM events),
    q AS (SELECT session, min(seq) AS quit FROM e WHERE session = 2 AND n = 6 AND seq > (SELECT max(seq) / 2 FROM e) GROUP BY 1),
    a AS (SELECT e.* FROM e LEFT JOIN q USING (session) WHERE quit IS NULL OR seq <= quit),
    u AS (SELECT *, last_value(CASE WHEN n = 5 THEN CASE seq % 3 WHEN 0 THEN '*' WHEN 1 THEN 'a' ELSE 'b' END END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM a),
    p AS (SELECT *, CASE WHEN c IS NULL OR c = '*' THEN k ELSE c || ':' || k END AS key FROM u),
    s AS (SELECT p.*, w.value FROM p ASOF LEFT JOIN (SELECT key, seq, 'v' || seq AS value FROM p WHERE n = 8) w ON p.key = w.key AND p.seq > w.seq)
    SELECT session::VARCHAR AS session, seq, CASE n WHEN 0 THEN '"PONG"' WHEN 1 THEN coalesce('"' || value || '"', '"(nil)"') || chr(10) || coalesce('"' || value || '"', '"(nil)"') || chr(10) || '*END'
        WHEN 2 THEN '(error) ERR unknown command ''NOPE' || chr(39) WHEN 3 THEN '(error) ERR wrong number of arguments for ''SET' || chr(39) WHEN 4 THEN '(error) ERR unterminated quoted string'
        WHEN 5 THEN CASE seq % 3 WHEN 0 THEN '"OK (default)"' WHEN 1 THEN '"OK (using a)"' ELSE '"OK (using b)"' END
        WHEN 6 THEN CASE WHEN seq = (SELECT quit FROM q WHERE q.session = s.session) THEN 'OK' ELSE '(error) ERR empty line' END
        WHEN 7 THEN '(error) ERR unknown COLLECTION sub-command: WHAT — valid: LIST, CREATE, DROP' WHEN 8 THEN 'OK' WHEN 9 THEN CASE WHEN value IS NULL THEN '"none"' ELSE '"string"' END
        WHEN 10 THEN '(integer) ' || CASE WHEN value IS NULL THEN 0 ELSE 1 END ELSE CASE WHEN value IS NULL THEN '*END' ELSE '"' || key || '"' || chr(10) || '*END' END END AS reply FROM s""")
def session_verbs(spark, sf_dir):
    """Replies of three sessions to PING, MGET, USE, QUIT, TYPE, EXISTS, KEYS, SET and erroneous lines, one for each event."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 3).cast("string").alias("session"), (F.col("event_id") % 12).alias("n"), F.concat(F.lit("k"), F.col("user_id") % 20).alias("k"))
    half = (e.agg(F.max("seq")).first()[0] or 0) / 2
    quit_ = e.filter((F.col("session") == "2") & (F.col("n") == 6) & (F.col("seq") > half)).agg(F.min("seq")).first()[0]
    coll = F.when(F.col("seq") % 3 == 0, "*").when(F.col("seq") % 3 == 1, "a").otherwise("b")
    verbs = {0: "PING", 1: F.concat_ws(" ", F.lit("MGET"), "k", "k"), 2: "nope x", 3: "SET a", 4: 'SET "open', 5: F.concat(F.lit("USE "), coll), 7: "COLLECTION WHAT", 8: F.concat(F.lit("SET "), "k", F.lit(" v"), "seq"), 9: F.concat(F.lit("TYPE "), "k"), 10: F.concat(F.lit("EXISTS "), "k"), 11: F.concat(F.lit("KEYS "), "k")}
    line = F.when(F.col("seq") == F.lit(quit_), "QUIT").when(F.col("n") == 6, "  ")
    for n, text in verbs.items():
        line = line.when(F.col("n") == n, text if not isinstance(text, str) else F.lit(text))
    return run_script(e.select("session", "seq", F.col("seq").alias("ts"), line.alias("line")))


@query("SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN '(error) ERR not the leader, current leader is n1' ELSE '(nil)' END AS reply FROM events")
def read_only_follower(spark, sf_dir):
    """A follower's replies to writes and reads."""
    line = F.concat(F.when(F.col("event_id") % 2 == 0, "DEL k").otherwise("GET k"), "user_id")
    script = table(spark, sf_dir, "events").select(F.lit("s").alias("session"), F.col("event_id").alias("seq"), F.lit(0).alias("ts"), line.alias("line"))
    return run_script(script, read_only="n1").select("seq", "reply")


@query(f"WITH {_OPS.replace('WHEN event_id % 4000 = 3999 THEN ' + chr(39) + 'flush' + chr(39), 'WHEN FALSE THEN NULL')}, {_SEEN} SELECT seq, key, op, existed, CASE WHEN existed THEN q.value END AS old_value FROM w")
def keyed_stream(spark, sf_dir):
    """The same replies from a stream with an entry of state for each key, without FLUSH."""
    path = _shared(spark, "keyed")
    event_log(spark, sf_dir, flush="false").repartitionByRange(STREAM_FILES, "seq").write.json(f"{path}/log")
    stream = spark.readStream.schema("seq bigint, ts bigint, op string, key string, value string, expireAt bigint, items array<struct<key:string,value:string>>, keys array<string>").json(f"{path}/log")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    answers(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = durable(spark.read.parquet(f"{path}/out").select("seq", "key", "op", "existed", "old_value"))
    _forget(spark, path)
    return found


@query("""SELECT line_id, unnest(list_distinct(from_json('[' || substr(value, 2, length(value) - 2) || ']', '["VARCHAR"]'))) AS item FROM active WHERE value LIKE '(%)' AND json_valid('[' || substr(value, 2, length(value) - 2) || ']')""")
def set_items(spark, sf_dir):
    """The distinct strings of all set values."""
    return table(spark, sf_dir, "active").select("line_id", F.explode(exprs.set_value("value")).alias("item"))
