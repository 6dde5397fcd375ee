"""State queries over a log that lies mostly behind its last FLUSH, at a size where the log of many FLUSHes leaves nothing."""

import os

import pytest

import __spark_entry__ as entry
from keyloom.plans import queries as key_value

DATA = "/root/testdata/sf0.1"
STATE = ["fold_state", "fold_bulk", "get_point", "mget", "exists", "type_of", "range_scan", "size", "update_existing", "delete_keys", "rename", "replay_log", "compact_log", "stream_replica"]
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", STATE)
def test_state_is_there_and_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[f"{name}_long"](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    cur = con.execute(entry.oracle_sql()[f"{name}_long"])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols and sorted(map(repr, got)) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    some = {"mget": lambda r: "(nil)" not in r, "type_of": lambda r: "none" not in r, "size": lambda r: r[0] > 0}.get(name, lambda r: True)
    assert any(map(some, got))


def test_the_follower_runs_batch_by_batch(spark, monkeypatch):
    read = []
    current = key_value.current
    monkeypatch.setattr(key_value, "current", lambda s, path, batch, now: read.append((batch, sorted(n.removesuffix("-f") for n in os.listdir(path.removeprefix("file:")) if n.startswith("batch=")))) or current(s, path, batch, now))
    assert entry.queries()["stream_replica_long"](spark, DATA).count() > 0
    assert read == [(3, ["batch=0", "batch=1", "batch=2", "batch=3"])]
