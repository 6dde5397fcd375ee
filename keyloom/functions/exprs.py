"""Column expressions of the key-value model. All are built-in functions; none needs a Python worker."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

META_KEY = "__collections__"
#: Verbs by which of their arguments are keys, for collection prefixes.
ONE_KEY = ["GET", "DEL", "EXISTS", "TYPE", "RENAME", "SET"]
PAIRED_KEYS = ["MSET", "MUPD"]
ALL_KEYS = ["MDEL", "MGET"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(value: Column | str) -> Column:
    """Without leading and trailing characters up to U+0020 (more than blanks)."""
    return F.regexp_replace(_col(value), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _wrapped(value: Column, left: str, right: str) -> Column:
    return value.startswith(left) & value.endswith(right) & (F.length(value) > 1)


def value_type(value: Column | str) -> Column:
    """set, list, map or string by the first and last character; null for a null value."""
    t = trimmed(value)
    return F.when(_wrapped(t, "(", ")"), "set").when(_wrapped(t, "[", "]"), "list").when(_wrapped(t, "{", "}"), "map").when(t.isNotNull(), "string")


def type_label(value: Column | str) -> Column:
    """value_type, with bool and number told apart from other strings."""
    v, kind = _col(value), value_type(value)
    number = v.try_cast("double").isNotNull()
    return F.when(kind != "string", kind).when(trimmed(v).isin("true", "false"), "bool").when(number, "number").otherwise(kind)


def list_value(value: Column | str) -> Column:
    """The strings of a list value; null for other values and for bad JSON."""
    return F.when(value_type(value) == "list", F.from_json(trimmed(value), "array<string>"))


def map_value(value: Column | str) -> Column:
    """The entries of a map value; null for other values and for bad JSON."""
    return F.when(value_type(value) == "map", F.from_json(trimmed(value), "map<string,string>"))


def set_value(value: Column | str) -> Column:
    """The distinct strings of a set value, in order of first occurrence; null for others and for bad JSON."""
    t = trimmed(value)
    body = F.concat(F.lit("["), F.substring(t, F.lit(2), F.length(t) - 2), F.lit("]"))
    return F.when(value_type(value) == "set", F.array_distinct(F.from_json(body, "array<string>")))


def wrap_value(raw: Column | str, kind: Column | str) -> Column:
    """A comma-separated input as the text of a list, set or map value; text that is wrapped already stays."""
    r, k = _col(raw), _col(kind)
    # trailing empty parts do not count
    body = F.regexp_replace(r, ",+$", "")
    parts = F.when(body == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, ","), trimmed))
    quoted = F.array_join(F.transform(parts, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    pair = lambda x: F.split(x, ":", 2)
    entry = lambda x: F.concat(F.lit('"'), trimmed(F.get(pair(x), 0)), F.lit('":"'), F.coalesce(trimmed(F.get(pair(x), F.lit(1))), F.lit("")), F.lit('"'))
    entries = F.array_join(F.transform(parts, entry), ",")
    around = lambda left, inner, right: F.when(r.startswith(left), r).otherwise(F.concat(F.lit(left), inner, F.lit(right)))
    return (
        F.when(r == "", r)
        .when(k.isin("number", "bool"), trimmed(r))
        .when(k == "list", around("[", quoted, "]"))
        .when(k == "set", around("(", quoted, ")"))
        .when(k == "map", around("{", entries, "}"))
        .otherwise(r)
    )


def live(expire_at: Column | str, now: Column | int) -> Column:
    """Whether an entry exists at ``now``: it does not from its expiry on; 0 or null never comes."""
    e = F.coalesce(_col(expire_at), F.lit(0))
    return (e <= 0) | ((F.lit(now) if isinstance(now, int) else now) < e)


def expire_at(ts: Column | str, ttl: Column | str) -> Column:
    """The expiry in epoch milliseconds of a time to live in seconds; 0 for none, null where it overflows."""
    t = _col(ttl)
    return F.when(t > 0, F.try_add(_col(ts), F.try_multiply(t, F.lit(1000).cast("bigint")))).otherwise(F.lit(0).cast("bigint"))


def collection_of(key: Column | str) -> Column:
    """What stands before the first colon, if anything does; else null."""
    k = _col(key)
    return F.when(F.instr(k, ":") > 1, F.substring_index(k, ":", 1))


def glob_regex(pattern: Column) -> Column:
    """The anchored regular expression of a glob in which only * is special and stays within a line."""
    escaped = F.regexp_replace(pattern, r"([^\p{L}\p{Nd}_:*-])", r"\\$1")
    return F.concat(F.lit(r"\A"), F.regexp_replace(escaped, r"\*", ".*"), F.lit(r"\z"))


def glob_match(key: Column | str, pattern: Column | str) -> Column:
    """Whether a key matches a glob. A string is a literal pattern, whose fixed prefix reaches the scan as a range."""
    k = _col(key)
    if not isinstance(pattern, str):
        return F.coalesce((pattern != "") & F.regexp(k, glob_regex(pattern)), F.lit(False))
    if pattern == "":
        return F.lit(False)
    if "*" not in pattern:
        return k.isNotNull() & (k == pattern)
    prefix = pattern.split("*", 1)[0]
    rx = r"\A" + ".*".join(re.sub(r"([^\w:-])", r"\\\1", x) for x in pattern.split("*")) + r"\z"
    whole = F.regexp(k, F.lit(rx))
    # false rather than null for a null key, in a form that can be pushed down
    return k.isNotNull() & (k.startswith(prefix) & whole if prefix else whole)


def apply_prefix(verb: Column, args: Column, collection: Column) -> Column:
    """Arguments with the session's collection before each key that lacks it; KEYS without a pattern lists the collection."""
    head = F.concat(collection, F.lit(":"))
    put = lambda a: F.when(a.startswith(head), a).otherwise(F.concat(head, a))
    first = F.transform(args, lambda a, i: F.when(i == 0, put(a)).otherwise(a))
    even = F.transform(args, lambda a, i: F.when(i % 2 == 0, put(a)).otherwise(a))
    keys = F.when(F.size(args) == 0, F.array(F.concat(head, F.lit("*")))).otherwise(first)
    done = F.when(verb.isin(*ONE_KEY), first).when(verb.isin(*PAIRED_KEYS), even).when(verb.isin(*ALL_KEYS), F.transform(args, put)).when(verb == "KEYS", keys).otherwise(args)
    return F.when(collection.isNull(), args).otherwise(done)
