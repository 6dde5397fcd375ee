"""Per-key state in a stream: entries with their expiry in a keyed state store.

Each operation of the stream is answered as it arrives. Sequences that were applied already are
skipped, so a feed may be sent again. Truncation concerns all keys and is not part of it; see replica.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyloom.operators.fold import explode_ops

OUT = "key string, seq long, op string, existed boolean, old_value string"
_ENTRY = "live boolean, value string, exp long, seq long, pos int"


class _Entries(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", _ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live, value, exp, seq, pos = self.entry.get() if self.entry.exists() else (False, None, 0, -1, -1)
        ops = pd.concat(list(rows)).sort_values(["seq", "pos"])  # one key of one micro-batch
        out = []
        for o in ops.itertuples(index=False):
            if (o.seq, o.pos) <= (seq, pos):
                continue
            existed = bool(live and (exp <= 0 or o.ts < exp))
            out.append((key[0], o.seq, o.op, existed, value if existed else None))
            if o.kind == "W" or (o.kind == "U" and existed):
                live, value, exp = True, o.value, int(o.exp)
            elif o.kind == "D" or (o.kind == "U" and not existed):
                live, value, exp = False, None, 0
            if o.kind != "R":
                seq, pos = int(o.seq), int(o.pos)
        self.entry.update((live, value, exp, seq, pos))
        yield pd.DataFrame(out, columns=["key", "seq", "op", "existed", "old_value"])

    def close(self) -> None:
        pass


def answers(log: DataFrame) -> DataFrame:
    """A reply (key, seq, op, existed, old_value) for each key operation of a streaming op log.

    Within a key the log's seq rises over micro-batches. The session needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), which this sets.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return explode_ops(log).groupBy("key").transformWithStateInPandas(statefulProcessor=_Entries(), outputStructType=OUT, outputMode="update", timeMode="none")
