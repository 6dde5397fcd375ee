"""Command scripts: a DataFrame of command lines to a DataFrame of replies.

All key commands of a script are one op log, answered at once by ``replies``. Commands that look at the
whole key space (KEYS, COLLECTION) are answered together, from the stretches of the log in which each entry
and each declared collection lived; what they change becomes operations of that log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.exprs import META_KEY, apply_prefix, collection_of, expire_at, live, value_type
from keyloom.functions.protocol import parse, to_wire
from keyloom.operators.fold import count_before, explode_ops, replies
from keyloom.operators.listing import holding, listed, lives, match_globs, took_effect
from keyloom.operators.slices import cut_points, slice_at
from keyloom.runtime import durable

#: A script is cut into slices of about this many lines, so that a long session is spread over tasks.
SLICE_LINES = 500_000
KEY_VERBS = ["SET", "GET", "DEL", "EXISTS", "TYPE", "MSET", "MGET", "MDEL", "MUPD", "FLUSH"]
WRITES = ["SET", "DEL", "MSET", "MDEL", "MUPD", "FLUSH", "RENAME"]
VERBS = [*KEY_VERBS, "KEYS", "COLLECTION", "PING", "QUIT", "USE", "CLUSTER"]
_NOT_INT = "value is not an integer or out of range"


def last_before(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``df`` with the last non-null value of its key on earlier rows; hot keys are cut into slices."""
    n = df.count()
    cuts = cut_points(df, [order], n // SLICE_LINES + 1, n)
    sliced = df.withColumn("__v", value).withColumn("__s", slice_at([order], cuts))
    inside = F.last("__v", ignorenulls=True).over(W.partitionBy(key, "__s").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    if not cuts:
        return sliced.withColumn(name, inside).drop("__v", "__s")
    ends = sliced.groupBy(key, "__s").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__e"))
    carried = ends.select(key, "__s", F.last("__e", ignorenulls=True).over(W.partitionBy(key).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)).alias("__c"))
    return sliced.withColumn("__i", inside).join(carried, [key, "__s"]).withColumn(name, F.coalesce("__i", "__c")).drop("__v", "__s", "__i", "__c")


def requests(script: DataFrame) -> DataFrame:
    """session, seq, ts, verb, args, error of a script's lines (session, seq, ts, line), with each session's collection applied.

    Lines behind a session's QUIT are gone.
    """
    # parsed once; what follows reads the result several times
    p = durable(script.select("session", "seq", "ts", parse(F.col("line")).alias("p"))).select("session", "seq", "ts", "p.*")
    quits = p.filter("verb = 'QUIT'").groupBy("session").agg(F.min("seq").alias("quit"))
    open_ = p.join(quits, "session", "left").filter("quit is null or seq <= quit").drop("quit")
    name = F.coalesce(F.get("args", F.lit(0)), F.lit(""))
    used = last_before(open_, "session", "seq", F.when(F.col("verb") == "USE", F.when(name == "*", "").otherwise(name)), "coll")
    coll = F.when(F.col("coll") != "", F.col("coll"))
    return used.select("session", "seq", "ts", "verb", apply_prefix(F.col("verb"), F.col("args"), coll).alias("args"), "error")


def checked(reqs: DataFrame, read_only: str | None = None) -> DataFrame:
    """``reqs`` with the error that a request's verb and arguments alone tell.

    ``read_only``: the leader's name on a follower, which then takes no writes.
    """
    v, n = F.col("verb"), F.size("args")
    ttl = F.get("args", F.lit(2))
    wrong = F.concat(F.lit("wrong number of arguments for '"), v, F.lit("'"))
    one = v.isin("GET", "DEL", "EXISTS", "TYPE") & (n != 1)
    some = v.isin("MGET", "MDEL") & (n < 1)
    pairs = v.isin("MSET", "MUPD") & ((n < 2) | (n % 2 != 0))
    number = F.when(ttl.rlike(r"^[+-]?\d+$"), ttl.try_cast("bigint"))
    late = (v == "SET") & (n >= 3) & (number.isNull() | (number < 0))
    sub = F.upper(F.get("args", F.lit(0)))
    coll = v == "COLLECTION"
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~v.isin(*VERBS), F.concat(F.lit("unknown command '"), v, F.lit("'")))
        .when(v.isin(*WRITES) & F.lit(read_only is not None), F.lit(f"not the leader, current leader is {read_only}"))
        .when(one | some | pairs | ((v == "SET") & (n < 2)), wrong)
        .when(late, _NOT_INT)
        .when(v == "CLUSTER", "cluster mode not enabled")
        .when(coll & (n < 1), "wrong number of arguments for 'COLLECTION' — usage: COLLECTION LIST|CREATE|DROP ...")
        .when(coll & (sub == "CREATE") & (n < 2), "usage: COLLECTION CREATE <name>")
        .when(coll & (sub == "DROP") & (n < 2), "usage: COLLECTION DROP <name>")
        .when(coll & ~sub.isin("LIST", "CREATE", "DROP"), F.concat(F.lit("unknown COLLECTION sub-command: "), sub, F.lit(" — valid: LIST, CREATE, DROP")))
    )
    return reqs.withColumn("error", error)


def log_of(reqs: DataFrame) -> DataFrame:
    """The key commands of good requests as an op log, reads included."""
    a = F.col("args")
    at = lambda i: F.get(a, F.lit(i))
    pairs = F.transform(F.filter(a, lambda _, i: i % 2 == 0), lambda k, i: F.struct(k.alias("key"), F.get(a, 2 * i + 1).alias("value")))
    v = F.col("verb")
    return reqs.filter(F.col("error").isNull() & v.isin(*KEY_VERBS)).select(
        F.col("seq").cast("bigint").alias("seq"),
        F.col("ts").cast("bigint").alias("ts"),
        v.alias("op"),
        F.when(v.isin("SET", "GET", "DEL", "EXISTS", "TYPE"), at(0)).alias("key"),
        F.when(v == "SET", at(1)).alias("value"),
        F.when(v == "SET", F.coalesce(expire_at(F.col("ts"), F.coalesce(at(2).try_cast("bigint"), F.lit(0))), F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("expireAt"),
        F.when(v.isin("MSET", "MUPD"), pairs).alias("items"),
        F.when(v.isin("MGET", "MDEL"), a).alias("keys"),
    )


def _key_replies(log: DataFrame, r: DataFrame) -> DataFrame:
    """seq, kind, n, s, lines for the key commands of a log, from its ``replies``."""
    by = r.groupBy("seq").agg(F.sum(F.col("existed").cast("int")).alias("n"), F.array_sort(F.collect_list(F.struct("pos", F.col("old_value").alias("v")))).alias("x"))
    v, first = F.col("op"), F.get("x", F.lit(0)).v
    kind = F.when(v.isin("SET", "MSET", "FLUSH"), "OK").when(v.isin("DEL", "EXISTS", "MDEL", "MUPD"), "INTEGER").when(v == "GET", F.when(first.isNull(), "NIL").otherwise("VALUE")).when(v == "TYPE", "VALUE").when(v == "MGET", "MULTI")
    s = F.when(v == "GET", first).when(v == "TYPE", F.coalesce(value_type(first), F.lit("none")))
    return log.select("seq", "op").join(by, "seq", "left").select("seq", kind.alias("kind"), F.coalesce("n", F.lit(0)).cast("int").alias("n"), s.alias("s"), F.when(v == "MGET", F.transform("x", lambda e: F.coalesce(e.v, F.lit("(nil)")))).alias("lines"))


def _as_ops(rows: DataFrame, op: str) -> DataFrame:
    """seq, ts, key, value as SET or DEL operations of a log."""
    null = lambda t: F.lit(None).cast(t)
    return rows.select("seq", "ts", F.lit(op).alias("op"), "key", "value", F.lit(0).cast("bigint").alias("expireAt"), null("array<struct<key:string,value:string>>").alias("items"), null("array<string>").alias("keys"))


def _declared(told: DataFrame, marks: DataFrame, creates: DataFrame, drops: DataFrame) -> DataFrame:
    """name, era, start, stop, exp: the stretches in which collections were declared.

    An era begins with each of the ``marks``, the FLUSHes and the key commands that changed the meta key. In it a
    name is declared by its last CREATE, or by the list that began the era, until its DROP.
    """
    own = told.filter((F.col("key") == META_KEY) & took_effect()).groupBy("seq").agg(F.max_by(F.struct("kind", "value", "exp"), "pos").alias("x"))
    listed_ = own.filter("x.kind <> 'D'").select("seq", "x.exp", F.explode(F.array_distinct(F.from_json("x.value", "array<string>"))).alias("name")).filter("name is not null")
    raw = count_before(listed_, marks, "era").select("name", (F.col("era") + 1).alias("era"), "seq", "exp", F.lit(True).alias("there"))
    event = lambda df, there: count_before(df.select("seq", "name"), marks, "era").select("name", "era", "seq", F.lit(0).cast("bigint").alias("exp"), F.lit(there).alias("there"))
    every = raw.union(event(creates, True)).union(event(drops, False))
    return every.withColumn("stop", F.lead("seq").over(W.partitionBy("name", "era").orderBy("seq"))).filter("there").select("name", "era", F.col("seq").alias("start"), "stop", "exp")


def _scans(reqs: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For a script with KEYS or COLLECTION commands: the replies to its key operations, those to the scans
    (seq, kind, n, s, lines), and what the scans change as operations.

    The meta key is written without expiry. A MUPD of it counts if a key command wrote it before.
    """
    sub = F.when(F.col("verb") == "KEYS", "KEYS").otherwise(F.upper(F.get("args", F.lit(0))))
    name = F.get("args", F.when(F.col("verb") == "KEYS", 0).otherwise(1))
    scans = durable(reqs.filter(F.col("error").isNull() & F.col("verb").isin("KEYS", "COLLECTION")).select(F.col("seq").cast("bigint").alias("seq"), F.col("ts").cast("bigint").alias("ts"), sub.alias("sub"), name.alias("name")))
    of = lambda what: scans.filter(F.col("sub") == what)
    creates, drops, lists = of("CREATE"), of("DROP"), of("LIST")
    flushes = log.filter("op = 'FLUSH'").select(F.col("seq").alias("m"))
    # a DROP deletes the keys that any write before or after it touches; of those only what exists then is lost
    touched = explode_ops(log).filter("kind in ('W', 'U')").select("key").distinct()
    globs = drops.select("seq", "ts", F.concat("name", F.lit(":*")).alias("glob"))
    dels = durable(_as_ops(match_globs(touched, globs).select("seq", "ts", "key", F.lit(None).cast("string").alias("value")), "DEL"))
    told = durable(replies(log.union(dels)))
    held = lives(told)
    # a command sees what was there before it, what it ends itself included
    inside = (F.col("start") < F.col("at")) & (F.col("stop").isNull() | (F.col("at") <= F.col("stop"))) & live("exp", F.col("ts"))
    moment = lambda df, marks, epoch: count_before(df.withColumnRenamed("seq", "at"), marks, epoch, "at")
    # names that keys have: at each CREATE whether it is one, at each LIST all
    named = held.withColumn("name", collection_of("key")).filter("name is not null").drop("key", "value")
    at = moment(creates, flushes, "epoch")
    blocked = durable(at.join(named, (at.name == named.name) & (at.epoch == named.epoch) & (named.start < at["at"]) & (named.stop.isNull() | (at["at"] <= named.stop)) & live(named.exp, at.ts), "left_semi").select(F.col("at").alias("seq")))
    marks = durable(flushes.union(told.filter((F.col("key") == META_KEY) & took_effect()).select("seq")).distinct())
    free = creates.filter(~F.col("name").contains(":") & (F.col("name") != "")).join(blocked, "seq", "left_anti")
    spans = durable(_declared(told, marks, free, drops))
    known = moment(creates, marks, "in_era").join(spans.withColumnRenamed("name", "span"), (F.col("span") == F.col("name")) & (F.col("in_era") == F.col("era")) & inside, "left_semi").select(F.col("at").alias("seq"))
    taken = durable(known.union(blocked).distinct())
    bad = F.when(F.col("name").contains(":"), "collection name cannot contain ':'").when((F.col("name") == "") | F.col("taken"), F.concat(F.lit("collection already exists: "), "name"))
    created = durable(creates.join(taken.withColumn("taken", F.lit(True)), "seq", "left").withColumn("bad", bad))
    # the meta key behind each change of it
    changes = moment(created.filter("bad is null").select("seq", "ts").union(drops.select("seq", "ts")), marks, "in_era")
    after = (F.col("in_era") == F.col("era")) & (F.col("start") <= F.col("at")) & (F.col("stop").isNull() | (F.col("at") < F.col("stop"))) & live("exp", F.col("ts"))
    names = changes.join(spans, after, "left").groupBy("at", "ts").agg(F.array_sort(F.collect_set("name")).alias("l"))
    metas = durable(_as_ops(names.select(F.col("at").alias("seq"), "ts", F.lit(META_KEY).alias("key"), F.to_json("l").alias("value")), "SET"))
    on_meta = (F.col("op") == "FLUSH") | (F.col("key") == META_KEY) | F.coalesce(F.exists("items", lambda i: i.key == META_KEY), F.lit(False)) | F.coalesce(F.array_contains("keys", META_KEY), F.lit(False))
    r = durable(told.filter(F.col("key") != META_KEY).unionByName(replies(log.filter(on_meta).union(metas)).filter(F.col("key") == META_KEY)))
    # what the listings find
    keys = listed(lives(r), of("KEYS").select("seq", "ts", F.when(F.length("name") > 0, F.col("name")).otherwise("*").alias("glob")), flushes).select("seq", F.col("key").alias("line"))
    order = lists.select(F.col("seq").alias("m"))
    numbered = count_before(lists, order, "number")
    seen = holding(named, lists).withColumn("number", F.explode(F.expr("sequence(lo, hi - 1)"))).join(numbered.select("number", F.col("seq").alias("at"), "ts"), "number")
    by_key = count_before(seen, flushes, "in_epoch", "at").filter((F.col("in_epoch") == F.col("epoch")) & inside).select(F.col("at").alias("seq"), F.col("name").alias("line")).distinct()
    by_name = moment(lists.drop("name"), marks, "in_era").join(spans, (F.col("in_era") == F.col("era")) & inside).select(F.col("at").alias("seq"), F.col("name").alias("line"))
    lines = keys.union(by_key.union(by_name).distinct()).groupBy("seq").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    gone = r.join(drops.select("seq"), "seq", "left_semi").filter((F.col("key") != META_KEY) & (F.col("kind") == "D") & F.col("existed"))
    n = gone.groupBy("seq").agg(F.count("*").cast("int").alias("n"))
    kind = F.when(F.col("sub").isin("KEYS", "LIST"), "MULTI").when(F.col("sub") == "DROP", "INTEGER").when(F.col("bad").isNull(), "OK").otherwise("ERROR")
    every = scans.join(lines, "seq", "left").join(n, "seq", "left").join(created.select("seq", "bad"), "seq", "left")
    empty = F.when(kind == "MULTI", F.coalesce("lines", F.array().cast("array<string>")))
    answers = every.select("seq", kind.alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.col("bad").alias("s"), empty.alias("lines"))
    lost = dels.join(gone.select("seq", "key"), ["seq", "key"], "left_semi").select(*metas.columns)
    return r, answers, lost.union(metas)


def run_script(script: DataFrame, read_only: str | None = None, base: DataFrame | None = None) -> DataFrame:
    """session, seq, reply (wire text) for every line of a script: session, seq (unique order), ts, line.

    ts must not fall with seq. Null and blank lines get an error reply; an empty script gives no rows.
    ``base`` is the op log of what was there before, with lower seqs and no later ts.
    """
    return execute(script, read_only, base)[0]


def execute(script: DataFrame, read_only: str | None = None, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The replies of ``run_script``, and the script's writes as an op log."""
    reqs = durable(checked(requests(script), read_only))
    own_log = log_of(reqs)
    log = own_log if base is None else base.select(*own_log.columns).union(own_log)
    changed = own_log.filter(F.col("op").isin(*WRITES))
    if reqs.filter(F.col("error").isNull() & F.col("verb").isin("KEYS", "COLLECTION")).isEmpty():
        touched = None if base is None else explode_ops(own_log).select("key")
        answered = _key_replies(own_log, _own(replies(log, only=touched), base, own_log))
    else:
        r, scanned, changes = _scans(reqs, log)
        answered = _key_replies(own_log, _own(r, base, own_log)).union(scanned)
        changed = changed.union(changes)
    v = F.col("verb")
    name = F.coalesce(F.get("args", F.lit(0)), F.lit(""))
    use = F.when(name.isin("", "*"), '"OK (default)"').otherwise(F.concat(F.lit('"OK (using '), name, F.lit(')"')))
    wire = F.when(F.col("error").isNotNull(), F.concat(F.lit("(error) ERR "), "error")).when(v == "PING", '"PONG"').when(v == "QUIT", "OK").when(v == "USE", use).otherwise(to_wire(F.col("kind"), F.col("n"), F.col("s"), F.col("lines")))
    return reqs.join(answered, "seq", "left").select("session", "seq", wire.alias("reply")), changed


def _own(r: DataFrame, base: DataFrame | None, own_log: DataFrame) -> DataFrame:
    """The replies to a script's own operations."""
    return r if base is None else r.join(own_log.select("seq"), "seq", "left_semi")


def batch_count(ops: DataFrame) -> DataFrame:
    """n for a batch of (seq, ts, op, key, value): every SET counts, a DEL if it removed something, other ops not at all."""
    log = ops.filter(F.col("op").isin("SET", "DEL")).select("seq", "ts", "op", "key", "value", F.lit(0).cast("bigint").alias("expireAt"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("items"), F.lit(None).cast("array<string>").alias("keys"))
    hit = replies(log).select(((F.col("op") == "SET") | F.col("existed")).cast("bigint").alias("hit"))
    return hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("n"))
