"""One table from JSON files whose fields are renamed, moved, retyped, added or removed over time.

Rescue-column ingestion. The target schema is enforced on each line; whatever is unknown to it or
does not cast is kept, as JSON, in a rescue column. Every leaf of that JSON is evidence about its
path in its file: where the values fit the domain of a target field, the path is approved for that
field in that file, and the rescued values of approved paths are replayed into the typed columns.
What a file has, and thus every change between a file and the one before it, is read off the
replayed values of the ingested table.

A line is parsed once, into an array of its leaves that later steps filter in place; only counts by
file and path, and the approved paths of files, are shuffled. All of it runs on built-in functions;
JSON is read as VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.chunks import rank_in_key
from keyloom.runtime import durable, small_side

#: The names of the value types, in the order of their numbers.
VALUE_TYPES = ["STRING", "LIST", "MAP", "SET"]
#: Fields of the target schema that never drift, with their types; they are no candidates for others.
STEADY = {"op": "string", "key": "string", "value": "string", "ts": "bigint", "items": "array<struct<key:string,value:string>>", "keys": "array<string>"}
#: Objects in objects that one pass opens; deeper ones take more passes.
LEVELS = 16
#: Share of a path's non-null values that must fit a field's domain.
FIT = 0.9
_MAP = "map<string,variant>"


def _once(value: Column, name: str) -> Column:
    """``value`` behind a generator, so that filters on it are not computed by evaluating it once more."""
    return F.explode(F.array(value)).alias(name)


def depth(lines: DataFrame) -> int:
    """The largest number of objects in objects of any line, never too small."""
    bare = F.regexp_replace("line", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a: Column, c: Column) -> Column:
        d = a.d + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(d.alias("d"), F.greatest(a.m, d).alias("m"))

    some = lines.filter(F.col("line").rlike(r":\s*\{"))
    return some.agg(F.max(F.aggregate(braces, zero, step, lambda a: a.m))).first()[0] or 1


def _opened(leaves: Column) -> Column:
    """Leaves with each object that is not empty replaced by its fields."""

    def fields(x: Column) -> Column:
        inner = F.transform(F.array(F.try_variant_get(x.leaf, "$", _MAP)), lambda m: F.when(F.size(m) > 0, _named(m, F.concat(x.path, F.lit("/")))))
        return F.coalesce(F.get(inner, F.lit(0)), F.array(x))

    return F.flatten(F.transform(leaves, fields))


def _named(fields: Column, before: Column) -> Column:
    """A map's entries as (path, leaf); a path joins names by /, with / and ~ in them as ~1 and ~0."""
    name = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.transform(F.map_entries(fields), lambda e: F.struct(F.concat(before, name(e.key)).alias("path"), e.value.alias("leaf")))


def json_lines(lines: DataFrame) -> DataFrame:
    """Each line once parsed: file_id, line_no, readable, raw (an unreadable line), the steady fields, lost and leaves.

    ``lost``: path and json of the steady fields that their columns do not tell in full. ``leaves``: path,
    type (string, number, array, null, other), json, vt and ex (the value type and the expiry that the
    leaf may tell) of everything else. No VARIANT is left, so that a copy of it is cheap.
    """
    parsed = lines.select("file_id", "line_no", "line", _once(F.try_variant_get(F.try_parse_json("line"), "$", _MAP), "fields"))
    rest = _named(F.map_filter("fields", lambda k, _: ~k.isin(*STEADY)), F.lit(""))
    at = parsed.withColumn("leaves", rest)
    levels = depth(lines) - 1
    for i in range(levels):
        at = at.withColumn("leaves", F.when(F.col("line").rlike(r":\s*\{"), _opened(F.col("leaves"))).otherwise(F.col("leaves")))
        if i % LEVELS == LEVELS - 1:
            at = durable(at)
    # stage by stage, as a lambda's expressions are evaluated anew wherever they stand
    kinds = F.transform("leaves", lambda x: F.struct(x.path.alias("path"), x.leaf.alias("leaf"), F.schema_of_variant(x.leaf).alias("kind")))
    typed = F.transform(kinds, lambda x: F.struct(x.path.alias("path"), x.leaf.alias("leaf"), _type(x.kind).alias("type")))
    told = F.transform(typed, lambda x: F.struct(x.path.alias("path"), x.leaf.alias("leaf"), x.type.alias("type"), _word(x).alias("text"), _number(x).alias("number")))
    known = F.transform(told, lambda x: F.struct(x.path.alias("path"), x.type.alias("type"), F.to_json(x.leaf).alias("json"), as_value_type(x).alias("vt"), as_expiry(x).alias("ex")))
    steady = {c: F.try_variant_get(F.col("fields")[c], "$", t) for c, t in STEADY.items()}
    kind = {c: F.schema_of_variant(F.col("fields")[c]) for c in STEADY}
    raw = {c: F.to_json(F.col("fields")[c]) for c in STEADY}

    def full(c: str) -> Column:
        if t := {"string": "STRING", "bigint": "BIGINT"}.get(STEADY[c]):
            return kind[c] == t
        return F.coalesce(F.concat(F.lit("["), raw[c], F.lit("]")) == F.to_json(F.to_variant_object(F.array(steady[c]))), F.lit(False))

    lost = [F.when((kind[c] != "VOID") & ~full(c), F.struct(F.lit(c).alias("path"), raw[c].alias("json"))) for c in STEADY]
    readable = F.col("fields").isNotNull()
    return at.select(
        "file_id", "line_no", readable.alias("readable"), F.when(~readable, F.col("line")).alias("raw"), *[v.alias(c) for c, v in steady.items()],
        F.filter(F.array(*lost), lambda x: x.isNotNull()).alias("lost"), known.alias("leaves"),
    )


def _type(kind: Column) -> Column:
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(kind == "STRING", "string").when(kind.isNull() | (kind == "VOID"), "null").when(kind.startswith("ARRAY"), "array").when(number, "number").otherwise("other")


def _word(x: Column) -> Column:
    """The text of a string, or of the only element of an array."""
    only = F.try_variant_get(x.leaf, "$", "array<string>")
    return F.when(x.type == "string", F.try_variant_get(x.leaf, "$", "string")).when(x.type == "array", F.when(F.size(only) == 1, F.get(only, F.lit(0))))


def _number(x: Column) -> Column:
    return F.when(x.type == "number", F.try_variant_get(x.leaf, "$", "bigint"))


def as_value_type(x: Column) -> Column:
    """The value type that a leaf (type, text, number) tells, by name, by number or as the only element of an array; else null."""
    named = F.array_position(F.array(*[F.lit(v) for v in VALUE_TYPES]), F.upper(x.text))
    at = F.when(x.type == "number", F.when(x.number.between(0, len(VALUE_TYPES) - 1), x.number + 1)).otherwise(named)
    return F.when(at > 0, F.element_at(F.array(*[F.lit(v) for v in VALUE_TYPES]), at.cast("int")))


def as_expiry(x: Column) -> Column:
    """The moment in epoch milliseconds that a leaf (type, text, number) tells, as a number, in digits or as ISO date and time; 0 is never; else null."""
    digits, iso = x.text.rlike(r"^\d{1,18}$"), x.text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d")
    said = F.when(digits, x.text.try_cast("bigint")).when(iso, F.unix_millis(F.try_to_timestamp(x.text)))
    return F.when(x.type == "number", x.number).when(x.type == "string", said)


def approved_paths(parsed: DataFrame) -> DataFrame:
    """file_id, path -> field (valueType or expireAt), from the evidence of the file and of all files.

    Both fields describe a write: a path that also occurs on removals is neither, nor is one whose
    values fit neither domain. valueType: the values name or number a value type. expireAt: they are 0
    or moments after the line's own ``ts``. The file's own values decide which; where they fit both
    (zeros) or neither (nulls, a few odd lines) the path's values in all files do, and at last its
    place: only an expiry occurs on bulk writes.
    """
    shown = parsed.select("file_id", "op", "ts", F.explode("leaves").alias("x")).select("file_id", "op", "ts", "x.path", "x.type", "x.vt", "x.ex")
    n = lambda c, name: F.count(F.when(c, True)).alias(name)
    some, vt = F.col("type") != "null", F.col("vt").isNotNull()
    ex = F.coalesce((F.col("ex") == 0) | (F.col("ex") > F.col("ts")), F.lit(False))
    counts = [n(some, "some"), n(some & vt, "vt"), n(some & ex, "ex"), n(some & (vt | ex), "either"), n(F.col("op").isin("DEL", "MDEL", "FLUSH"), "off"), n(F.col("op").isin("MSET", "MUPD"), "bulk"), F.count("*").alias("rows")]
    by_file = durable(shown.groupBy("file_id", "path").agg(*counts))
    names = ["some", "vt", "ex", "either", "off", "bulk", "rows"]
    whole = by_file.groupBy("path").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    likely = whole.filter((F.col("all_some") > 0) & (F.col("all_off") <= (1 - FIT) * F.col("all_rows")) & (F.col("all_either") >= FIT * F.col("all_some")))
    fits = lambda c, of: (F.col(c) >= FIT * F.col(of)) & (F.col(of) > 0)
    all_ex, all_vt = fits("all_ex", "all_some"), fits("all_vt", "all_some")
    everywhere = F.when(all_ex & (~all_vt | (F.col("all_bulk") > 0)), "expireAt").when(all_vt, "valueType")
    here_ex, here_vt = fits("ex", "some"), fits("vt", "some")
    placed = F.when(here_ex & here_vt, F.when(F.col("bulk") > 0, "expireAt").otherwise("valueType"))
    field = F.when(here_ex & ~here_vt, "expireAt").when(here_vt & ~here_ex, "valueType").otherwise(F.coalesce(everywhere, placed))
    return by_file.join(small_side(likely), "path").select("file_id", "path", field.alias("field")).filter("field is not null")


def ingested(lines: DataFrame) -> DataFrame:
    """The table of ``ingest`` before its JSON is written: the steady fields, value_type, expire_at, ``told`` and ``left``.

    ``told``: field, path, type and json of each leaf on an approved path; ``left``: path and json of what is rescued.
    """
    parsed = durable(json_lines(lines))
    # the approved paths of one file: those of two fields and their variants in odd lines
    paths = approved_paths(parsed).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "field"))).alias("fields_of"))
    rows = parsed.join(small_side(paths), "file_id", "left")
    known = F.transform("leaves", lambda x: F.struct(F.try_element_at("fields_of", x.path).alias("field"), x.path.alias("path"), x.type.alias("type"), x.json.alias("json"), x.vt.alias("vt"), x.ex.alias("ex")))
    rows = rows.withColumn("x", known)
    is_ = lambda field: lambda x: x.field == field
    value_type = F.array_max(F.transform(F.filter("x", is_("valueType")), lambda x: x.vt))
    expire_at = F.array_max(F.transform(F.filter("x", is_("expireAt")), lambda x: F.when(x.type == "null", F.lit(0).cast("bigint")).otherwise(x.ex)))
    odd = lambda x: x.field.isNull() | ((x.type != "null") & F.when(x.field == "valueType", x.vt.isNull()).otherwise(x.ex.isNull()))
    kept = F.transform(F.filter("x", odd), lambda x: F.struct(x.path.alias("path"), x.json.alias("json")))
    told = F.filter("x", lambda x: x.field.isNotNull())
    return rows.select("file_id", "line_no", "readable", "raw", *STEADY, value_type.alias("value_type"), expire_at.alias("expire_at"), told.alias("told"), F.array_sort(F.concat(kept, "lost")).alias("left"))


def _object(pairs: Column) -> Column:
    """(path, json) pairs as the text of a JSON object; null for none."""
    name = lambda p: F.regexp_extract(F.to_json(F.create_map(p, F.lit(0))), r"(?s)\A\{(.*)0\}\z", 1)
    text = F.array_join(F.transform(pairs, lambda x: F.concat(name(x.path), x.json)), ",")
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), text, F.lit("}")))


def ingest(lines: DataFrame) -> DataFrame:
    """All lines in one form: file_id, line_no, readable, op, key, value, ts, items, keys, value_type, expire_at, replayed, rescued.

    ``rescued`` holds, as a JSON object by path, the fields that neither the target schema nor an
    approved path explains, and those whose value is not told in full by its column: a value that does
    not cast, digits in place of a number, an item with further fields. ``replayed`` holds, in the same
    form, the values as they were from which value_type and expire_at come. Both are null where there is
    nothing. So the columns of a readable line give its object back, but for steady fields that are
    null in it. A null, blank, cut or foreign line, or one whose object names a field twice, is not
    readable: its fields are null, and rescued is {"_line": the line}, null for a null line. value_type is
    null on lines that tell none, expire_at null where none is told and 0 for never. Lines without
    file_id have no approved paths. Empty tables give no rows.
    """
    t = ingested(lines)
    rescued = F.when(F.col("readable"), _object(F.col("left"))).when(F.col("raw").isNotNull(), F.to_json(F.create_map(F.lit("_line"), F.col("raw"))))
    replayed = _object(F.array_sort(F.transform("told", lambda x: F.struct(x.path.alias("path"), x.json.alias("json")))))
    return t.select("file_id", "line_no", "readable", *STEADY, "value_type", "expire_at", replayed.alias("replayed"), rescued.alias("rescued"))


def file_fields(table: DataFrame) -> DataFrame:
    """What each file with readable SET lines has, off the ingested table: file_id, field, path and type; null where most of those lines show none."""
    sets = table.filter("op = 'SET'")
    lines = sets.groupBy("file_id").agg(F.count("*").alias("lines"))
    by_type = sets.select("file_id", F.explode("told").alias("x")).groupBy("file_id", "x.field", "x.path", "x.type").agg(F.count("*").alias("n"))
    typed = F.max(F.when(F.col("type") != "null", F.struct("n", "type"))).getField("type")
    by_path = by_type.groupBy("file_id", "field", "path").agg(F.sum("n").alias("n"), typed.alias("type"))
    top = by_path.groupBy("file_id", "field").agg(F.sum("n").alias("with"), F.max(F.struct("n", "path", "type")).alias("x"))
    both = lines.select("file_id", "lines", F.explode(F.array(F.lit("valueType"), F.lit("expireAt"))).alias("field"))
    has = F.col("x.n") >= F.col("lines") - F.col("with")
    return both.join(top, ["file_id", "field"], "left").select("file_id", "field", F.when(has, F.col("x.path")).alias("path"), F.when(has, F.col("x.type")).alias("type"))


def file_order() -> Column:
    """Place of a file among its node's files: rotated ones by number, then by name, the active one last."""
    active = F.col("file_name").startswith("active.")
    number = F.regexp_extract("file_name", r"(\d+)", 1).try_cast("decimal(38,0)")
    return F.struct(F.coalesce(active, F.lit(False)).alias("a"), number.alias("n"), F.coalesce("file_name", F.lit("")).alias("f"), F.col("file_id").alias("i"))


def schema_changes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Every change of valueType and expireAt from file to file of a node: file_id, field, change.

    ``lines``: file_id, line_no, line; ``files``: file_id, nodeId, file_name; other columns are not
    read. Null, blank, cut or foreign lines are unreadable; a file without readable SET lines is
    passed over; files without a node, and lines of unknown files, are left out; a field seen only
    as null keeps its name but has no type, so it is never retyped. Empty tables give no rows.
    """
    has = file_fields(ingested(lines))
    wide = has.groupBy("file_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("path", "type"))).alias(f) for f in ("valueType", "expireAt")])
    placed = wide.join(files.select("file_id", "nodeId", file_order().alias("o")), "file_id")
    ranked = durable(rank_in_key(placed, "nodeId", ["o"]).select("nodeId", "rank", "file_id", "valueType", "expireAt"))
    before = ranked.select("nodeId", (F.col("rank") + 1).alias("rank"), F.col("valueType").alias("valueType0"), F.col("expireAt").alias("expireAt0"))
    pairs = ranked.join(before, ["nodeId", "rank"])

    def changes(field: str) -> Column:
        new, old = F.col(field), F.col(f"{field}0")
        is_, was = new.path.isNotNull(), old.path.isNotNull()
        kinds = {"added": is_ & ~was, "removed": was & ~is_, "renamed": new.path != old.path, "retyped": is_ & was & (new.type != old.type)}
        return F.array(*[F.when(c, F.struct(F.lit(field).alias("field"), F.lit(k).alias("change"))) for k, c in kinds.items()])

    both = F.concat(changes("valueType"), changes("expireAt"))
    return pairs.select("file_id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("file_id", "x.field", "x.change")
