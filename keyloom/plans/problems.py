"""Queries of the general data problems over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.changes import current_entries
from keyloom.operators.chunks import chunk_states, rank_in_key
from keyloom.operators.drift import ingest, schema_changes
from keyloom.runtime import table

DAY_MS = 86_400_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last line_id of each key and UTC day; rows without key or ts belong to none."""
    rows = table(spark, sf_dir, "active").filter("key is not null and ts is not null").select("key", F.floor(F.col("ts") / DAY_MS).alias("utc_day"), "line_id")
    return chunk_states(rows, ["key"], ["utc_day"], {"first_line": ("min", "line_id"), "last_line": ("max", "line_id")}, "line_id")


def p1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's rows numbered in order of line_id and cut into chunks of 1,000: their rows, first and last line_id."""
    rows = table(spark, sf_dir, "active").filter("key is not null").select("key", "line_id")
    ranked = rank_in_key(rows, "key", ["line_id"]).withColumn("chunk", F.floor(F.col("rank") / 1000))
    return ranked.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each node at its highest ts, with the seq of the change that last wrote them."""
    return current_entries(table(spark, sf_dir, "active")).select("nodeId", "key", "seq")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of valueType and expireAt from file to file of each node."""
    return schema_changes(table(spark, sf_dir, "log_lines"), table(spark, sf_dir, "log_files"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All log lines in one form, with what is left over in ``rescued``; items and keys as JSON."""
    t = ingest(table(spark, sf_dir, "log_lines"))
    return t.withColumn("items", F.to_json("items", {"ignoreNullFields": "false"})).withColumn("keys", F.to_json("keys"))


#: What the values of each path in log_lines tell, and the paths that stand for a field in each file.
_PATHS = r"""
        j AS (SELECT file_id, line_no, CAST(line AS JSON) AS j FROM log_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
        t AS (SELECT file_id, line_no, j ->> 'op' AS op, TRY_CAST(j ->> 'ts' AS BIGINT) AS ts, u.fullkey AS path, u.type AS jt, u.value AS v
              FROM j, json_tree(j.j) AS u WHERE (u.type <> 'OBJECT' OR u.value = '{}') AND u.fullkey <> '$' AND NOT contains(u.fullkey, '[') AND split_part(u.fullkey, '.', 2) NOT IN ('op', 'key', 'value', 'ts', 'items', 'keys')),
        s AS (SELECT *, CASE WHEN jt = 'VARCHAR' THEN 'string' WHEN jt = 'ARRAY' THEN 'array' WHEN jt IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN jt = 'NULL' THEN 'null' ELSE 'other' END AS type, v ->> '$' AS txt FROM t),
        e AS (SELECT *, CASE type WHEN 'string' THEN list_filter(['STRING', 'LIST', 'MAP', 'SET'], lambda n: n = upper(txt))[1] WHEN 'array' THEN CASE WHEN json_array_length(v) = 1 THEN list_filter(['STRING', 'LIST', 'MAP', 'SET'], lambda n: n = upper(v ->> '$[0]'))[1] END
                       WHEN 'number' THEN CASE WHEN txt IN ('0', '1', '2', '3') THEN ['STRING', 'LIST', 'MAP', 'SET'][txt::INT + 1] END END AS vt,
                  CASE WHEN type = 'number' OR (type = 'string' AND regexp_full_match(txt, '\d{1,18}')) THEN TRY_CAST(txt AS BIGINT) WHEN type = 'string' AND regexp_matches(txt, '^\d{4}-\d\d-\d\d[T ]') THEN epoch_ms(TRY_CAST(txt AS TIMESTAMPTZ)) END AS x FROM s),
        f AS (SELECT file_id, path, count(*) FILTER (type <> 'null') AS filled, count(*) FILTER (type <> 'null' AND vt IS NOT NULL) AS nvt, count(*) FILTER (type <> 'null' AND (x = 0 OR x > ts)) AS nex,
                     count(*) FILTER (type <> 'null' AND (vt IS NOT NULL OR x = 0 OR x > ts)) AS nany, count(*) FILTER (op IN ('MSET', 'MUPD')) AS bulk, count(*) FILTER (op IN ('DEL', 'MDEL', 'FLUSH')) AS gone, count(*) AS n FROM e GROUP BY ALL),
        w AS (SELECT path, CASE WHEN sum(nex) >= 0.9 * sum(filled) AND (sum(nvt) < 0.9 * sum(filled) OR sum(bulk) > 0) THEN 'expireAt' WHEN sum(nvt) >= 0.9 * sum(filled) THEN 'valueType' END AS common
              FROM f GROUP BY path HAVING sum(filled) > 0 AND sum(gone) <= 0.1 * sum(n) AND sum(nany) >= 0.9 * sum(filled)),
        p AS (SELECT * FROM (SELECT file_id, path, CASE WHEN filled > 0 AND nex >= 0.9 * filled AND nvt < 0.9 * filled THEN 'expireAt' WHEN filled > 0 AND nvt >= 0.9 * filled AND nex < 0.9 * filled THEN 'valueType'
                     WHEN common IS NOT NULL THEN common WHEN filled > 0 AND nex >= 0.9 * filled THEN CASE WHEN bulk > 0 THEN 'expireAt' ELSE 'valueType' END END AS field FROM f JOIN w USING (path)) WHERE field IS NOT NULL),"""
QUERIES = {"p1_found": p1_found, "p1_chunks": p1_chunks, "p4_found": p4_found, "p5_found": p5_found, "p5_table": p5_table}
SQL = {
    "p1_found": """
        SELECT key, CAST(floor(ts / 86400000.0) AS BIGINT) AS utc_day, min(line_id) AS first_line, max(line_id) AS last_line
        FROM active WHERE key IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2""",
    "p1_chunks": """
        SELECT key, r // 1000 AS chunk, count(*) AS n, min(line_id) AS first_line, max(line_id) AS last_line
        FROM (SELECT key, line_id, row_number() OVER (PARTITION BY key ORDER BY line_id) - 1 AS r FROM active WHERE key IS NOT NULL) GROUP BY 1, 2""",
    "p4_found": """
        WITH c AS (
            SELECT nodeId, seq, min(ts) AS ts, arg_min(op, line_id) AS op, arg_min(expireAt, line_id) FILTER (expireAt IS NOT NULL) AS e,
                   arg_min(key, line_id) AS k, arg_min(items, line_id) AS items, arg_min(keys, line_id) AS ks
            FROM active GROUP BY nodeId, seq),
        n AS (SELECT nodeId, max(ts) AS now FROM active GROUP BY nodeId),
        f AS (SELECT nodeId, max((ts, seq)) AS fl FROM (SELECT nodeId, seq, ts FROM c WHERE op = 'FLUSH') GROUP BY nodeId),
        o AS (
            SELECT nodeId, k AS key, ts, seq, CASE op WHEN 'SET' THEN 'W' ELSE 'D' END AS kind, e FROM c WHERE op IN ('SET', 'DEL') AND k IS NOT NULL
            UNION ALL SELECT DISTINCT nodeId, i.key, ts, seq, CASE op WHEN 'MSET' THEN 'W' ELSE 'U' END, e FROM (SELECT *, unnest(items) AS i FROM c WHERE op IN ('MSET', 'MUPD')) WHERE i.key IS NOT NULL
            UNION ALL SELECT DISTINCT nodeId, i, ts, seq, 'D', e FROM (SELECT *, unnest(ks) AS i FROM c WHERE op = 'MDEL') WHERE i IS NOT NULL),
        a AS (SELECT o.* FROM o LEFT JOIN f USING (nodeId) WHERE fl IS NULL OR (o.ts, o.seq) > fl),
        s AS (SELECT *, sum(CASE kind WHEN 'U' THEN 0 ELSE 1 END) OVER (PARTITION BY nodeId, key ORDER BY ts, seq) AS seg FROM a),
        l AS (SELECT *, lag(CASE kind WHEN 'D' THEN 1 ELSE coalesce(e, 0) END) OVER (PARTITION BY nodeId, key, seg ORDER BY ts, seq) AS p FROM s WHERE seg > 0),
        g AS (SELECT *, bool_and(kind <> 'U' OR p <= 0 OR ts < p) OVER (PARTITION BY nodeId, key, seg ORDER BY ts, seq) AS ok FROM l),
        z AS (SELECT *, row_number() OVER (PARTITION BY nodeId, key ORDER BY ts DESC, seq DESC) AS r FROM g WHERE ok)
        SELECT nodeId, key, seq FROM z JOIN n USING (nodeId) WHERE r = 1 AND kind <> 'D' AND (e IS NULL OR e <= 0 OR now < e)""",
    "p5_table": """
        WITH""" + _PATHS + r"""
        q AS (SELECT file_id, line_no, replace(substr(path, 3), '.', '/') AS path, CAST(v AS VARCHAR) AS json, field, vt, x, type, CASE field WHEN 'valueType' THEN vt IS NOT NULL OR type = 'null' WHEN 'expireAt' THEN x IS NOT NULL OR type = 'null' ELSE FALSE END AS fits FROM e LEFT JOIN p USING (file_id, path)),
        z AS (SELECT file_id, line_no, j ->> 'op' AS op, j ->> 'key' AS key, j ->> 'value' AS value, TRY_CAST(j ->> 'ts' AS BIGINT) AS ts, from_json(j -> 'items', '[{"key":"VARCHAR","value":"VARCHAR"}]') AS items, from_json(j -> 'keys', '["VARCHAR"]') AS keys, j FROM j),
        k AS (SELECT file_id, line_no, unnest([{'path': 'op', 'json': j -> 'op', 'ok': to_json(op)}, {'path': 'key', 'json': j -> 'key', 'ok': to_json(key)}, {'path': 'value', 'json': j -> 'value', 'ok': to_json(value)},
                     {'path': 'ts', 'json': j -> 'ts', 'ok': to_json(ts)}, {'path': 'items', 'json': j -> 'items', 'ok': to_json(items)}, {'path': 'keys', 'json': j -> 'keys', 'ok': to_json(keys)}]) AS u FROM z),
        r AS (SELECT file_id, line_no, path, json FROM q WHERE NOT fits UNION ALL SELECT file_id, line_no, u.path, CAST(u.json AS VARCHAR) FROM k WHERE u.json IS NOT NULL AND json_type(u.json) <> 'NULL' AND CAST(u.json AS VARCHAR) <> CAST(u.ok AS VARCHAR)),
        ra AS (SELECT file_id, line_no, '{' || string_agg(CAST(to_json(path) AS VARCHAR) || ':' || json, ',' ORDER BY path) || '}' AS rescued FROM r GROUP BY ALL),
        qa AS (SELECT file_id, line_no, '{' || string_agg(CAST(to_json(path) AS VARCHAR) || ':' || json, ',' ORDER BY path) FILTER (field IS NOT NULL) || '}' AS replayed, max(vt) FILTER (field = 'valueType') AS value_type, max(CASE type WHEN 'null' THEN 0 ELSE x END) FILTER (field = 'expireAt') AS expire_at FROM q GROUP BY ALL)
        SELECT i.file_id, i.line_no, z.j IS NOT NULL AS readable, op, key, value, ts, to_json(items)::VARCHAR AS items, to_json(keys)::VARCHAR AS keys, value_type, expire_at, replayed,
               CASE WHEN z.j IS NOT NULL THEN rescued WHEN line IS NOT NULL THEN json_object('_line', line)::VARCHAR END AS rescued
        FROM log_lines i LEFT JOIN z USING (file_id, line_no) LEFT JOIN qa USING (file_id, line_no) LEFT JOIN ra USING (file_id, line_no)""",
    "p5_found": """
        WITH""" + _PATHS + r"""
        l AS (SELECT file_id, count(*) AS lines FROM j WHERE j ->> 'op' = 'SET' GROUP BY 1),
        c AS (SELECT file_id, field, path, type, count(*) AS n FROM e JOIN p USING (file_id, path) WHERE op = 'SET' GROUP BY ALL),
        d AS (SELECT file_id, field, path, sum(n) AS n, max((n, type)) FILTER (type <> 'null') AS mt FROM c GROUP BY ALL),
        g AS (SELECT file_id, field, sum(n) AS shown, max((n, path, mt[2])) AS x FROM d GROUP BY ALL),
        h AS (SELECT l.file_id, f.field, CASE WHEN x[1] >= lines - shown THEN x[2] END AS path, CASE WHEN x[1] >= lines - shown THEN x[3] END AS type
              FROM l CROSS JOIN (SELECT unnest(['valueType', 'expireAt']) AS field) f LEFT JOIN g ON g.file_id = l.file_id AND g.field = f.field),
        o AS (SELECT h.*, lag(path) OVER w AS path0, lag(type) OVER w AS type0, row_number() OVER w AS r FROM h JOIN log_files USING (file_id) WHERE nodeId IS NOT NULL
              WINDOW w AS (PARTITION BY nodeId, field ORDER BY starts_with(file_name, 'active.'), TRY_CAST(regexp_extract(file_name, '\d+') AS BIGINT), file_name, file_id))
        SELECT file_id, field, change FROM (
            SELECT file_id, field, unnest([CASE WHEN path IS NOT NULL AND path0 IS NULL THEN 'added' END, CASE WHEN path IS NULL AND path0 IS NOT NULL THEN 'removed' END, CASE WHEN path <> path0 THEN 'renamed' END,
                CASE WHEN path IS NOT NULL AND path0 IS NOT NULL AND type <> type0 THEN 'retyped' END]) AS change FROM o WHERE r > 1) WHERE change IS NOT NULL""",
}
