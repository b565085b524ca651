"""Registered streaming queries: the events table replayed as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import HISTORY
from ..plans.core import _HIST, ORACLES, E, evts, query, steady
from ..storage import shared_dir
from . import online, windows


def replay(s: SparkSession, d: str, parts: int = 3) -> DataFrame:
    """The events as a stream of ``parts`` files in time order, one a batch."""
    folder = f"{shared_dir(s)}/tollgate-stream-{uuid.uuid4().hex}"
    e = evts(s, d)
    top = e.agg(F.max("txn_id")).first()[0] + 1
    for k in range(parts):
        e.where((F.col("txn_id") >= k * top // parts) & (F.col("txn_id") < (k + 1) * top // parts)).coalesce(1).write.mode("append").parquet(folder)
    return s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(s: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream to its end into the shared folder and read what it wrote."""
    base = f"{shared_dir(s)}/tollgate-out-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{base}/rows")


@query()
def stream_online_history(s, d):
    """Online history of the stream; equal to features_history, features_counterparty and features_graph together."""
    return steady(run(s, online.online_history(replay(s, d))).select("txn_id", "side", *HISTORY))


ORACLES["stream_online_history"] = E + _HIST + f" SELECT txn_id, side, {', '.join(HISTORY)} FROM h"


@query(E + " SELECT date_trunc('day', event_time)::TIMESTAMP AS start, count(*) AS transactions, CAST(sum(is_laundering) AS BIGINT) AS laundering FROM t WHERE event_time < (SELECT date_trunc('day', max(event_time) - INTERVAL 1 HOUR) FROM t) GROUP BY 1")
def stream_daily_volume(s, d):
    """Daily volume of all days that the watermark has closed."""
    return run(s, windows.volume(replay(s, d)))

