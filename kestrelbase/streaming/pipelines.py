"""Structured Streaming counterparts: rollups, sessions, fixed-window deduplication, topic routing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrelbase.operators import dedup, timeseries
from kestrelbase.operators.queue import Broker
from kestrelbase.sources.shared import shared_dir


def read_table(spark: SparkSession, sf_dir: str, table: str, ts: str = "ts") -> DataFrame:
    """A Parquet table as a stream; its time without zone becomes a timestamp, as watermarks need one."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    reader = spark.readStream.schema(schema)
    stream = reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if single else reader.parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def rollup(stream: DataFrame, value: str, seconds: int, ts: str = "ts", late: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """start, end, (by), count, total of every origin-aligned window; state goes as the watermark passes."""
    keys = [F.col(b) for b in by or []]
    grouped = stream.withWatermark(ts, late).groupBy(timeseries.bucket(F.col(ts), seconds).alias("w"), *keys).agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    return grouped.select("w.start", "w.end", *(by or []), "count", "total")


def sessions(stream: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """key, start, end, count of runs of events less than ``gap`` apart."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select(key, "w.start", "w.end", "count")


def fixed_window_dedup(stream: DataFrame, keys: list[str], seconds: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Rows that ``dedup.fixed_window`` accepts, a micro-batch at a time.

    State is one long a key.  A row that comes a micro-batch later than a younger one is judged against
    what was accepted before it came, so only streams in order of time give the batch answer.
    """
    width = int(seconds * 1_000_000)
    schema = stream.schema

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values([ts, tie], kind="stable")
        times = rows[ts].astype("datetime64[us]").astype("int64").to_numpy()
        fresh = np.flatnonzero(times >= last + width) if last is not None else np.arange(len(times))
        if len(fresh):
            at, last = dedup.accepted(times[fresh], width, last)
            state.update((int(last),))
            yield rows.iloc[fresh[at]]

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, T.StructType([T.StructField("last", T.LongType())]), "append", GroupStateTimeout.NoTimeout)


def queue_operations(log: DataFrame) -> DataFrame:
    """queue, seq, op, applied, id of a stream of queue operations (queue, seq, at seconds, op, id, args JSON).

    A queue's open messages, leases and deduplication window are its state; a lease's end is noticed with
    the queue's next operation.  Operations are applied in order of seq within a micro-batch.
    """
    names = ["queue", "seq", "op", "applied", "id"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        broker = Broker.load(state.get[0]) if state.exists else Broker()
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            done, which = broker.apply(r.at, r.op, r.id, json.loads(r.args) if r.args else {})
            out.append((key[0], r.seq, r.op, done, which))
        state.update((broker.dump(),))
        yield pd.DataFrame(out, columns=names)

    schema = "queue string, seq long, op string, applied boolean, id string"
    return log.groupBy("queue").applyInPandasWithState(run, schema, "broker string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has now and give the result as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/kestrelbase-stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:

        def put(df: DataFrame, batch: int) -> None:
            # a complete result replaces the one before it
            df.write.mode("overwrite").parquet(f"{base}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def metrics(query: Any) -> dict[str, float]:
    """What a running stream last reported."""
    p = query.lastProgress
    return {} if p is None else {"input_rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond", 0.0), "batch": p["batchId"]}
