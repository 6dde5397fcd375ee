"""Command lines that arrive as a stream, answered by a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyloom.plans.store import Store


def serve(lines: DataFrame, store: Store, reply_dir: str, checkpoint_dir: str, once: bool = False) -> StreamingQuery:
    """Answer a stream of (session, seq, ts, line), any source's, batch by batch; replies go to batch=N below ``reply_dir``.

    seq rises within a batch. A batch whose replies are complete is not run again after a failure.
    """

    def answer(batch: DataFrame, number: int) -> None:
        spark, to = batch.sparkSession, f"{reply_dir}/batch={number}"
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{to}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return
        store.execute(batch.select("session", "seq", "ts", "line")).write.mode("overwrite").json(to)

    writer = lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer).start()
