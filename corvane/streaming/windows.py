"""Structured Streaming: windowed totals with a watermark, and stateful start and end pairing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIR = "user_id long, started timestamp, ended timestamp, n_starts long"


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='corvane-stream-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event files as a stream; a file is read once. A single file is watched through its folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    if spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith(f"/{name}"):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def hourly(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Totals by hour and type; rows later than ``delay`` are dropped."""
    w = F.window("ts", "1 hour")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).alias("total"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives until its input is read, as a table in the shared folder; the last batch counts in complete mode.

    A batch has a folder of its own by its number, so one that is run again writes over its first run."""
    spark, to = stream.sparkSession, _folder(stream.sparkSession)
    seen: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{to}/rows/{'last' if mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(path)
        seen.append(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*dict.fromkeys(seen)) if seen else spark.createDataFrame([], stream.schema)


def run_hours(spark: SparkSession, path: str) -> DataFrame:
    rows = drained(hourly(event_stream(spark, path)), "complete")
    return rows.select(F.col("window.start").alias("hour"), "event_type", "n_events", "total")


#: An item that no end has come for within this time of the events is given up.
OPEN_FOR_MS = 30 * 24 * 3600 * 1000


def pair_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The open item of a user: (first start, number of starts). An end closes it; the rows of a batch go in time order."""
    if state.hasTimedOut:
        state.remove()
        return
    started, n = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    for ts, kind in zip(rows["ts"], rows["event_type"]):
        if kind == "view":
            started, n = (ts.value // 1000 if started is None else started), n + 1
        elif kind == "purchase" and started is not None:
            out.append((key[0], pd.Timestamp(started, unit="us"), ts, n))
            started, n = None, 0
    if started is None and state.exists:
        state.remove()
    elif started is not None:
        state.update((started, n))
        state.setTimeoutTimestamp(max(started // 1000 + OPEN_FOR_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["user_id", "started", "ended", "n_starts"]).astype({"user_id": "int64", "n_starts": "int64", "started": "datetime64[ns]", "ended": "datetime64[ns]"})


def pairs(stream: DataFrame) -> DataFrame:
    """Pairs as they close. Within a batch the order is by time; a batch must not be more than an hour older than the one before."""
    rows = stream.where(F.col("event_type").isin("view", "purchase")).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", "1 hour")
    return rows.groupBy("user_id").applyInPandasWithState(pair_group, PAIR, "started long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_pairs(spark: SparkSession, path: str) -> DataFrame:
    return drained(pairs(event_stream(spark, path)), "append")
