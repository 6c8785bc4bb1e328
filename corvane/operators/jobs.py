"""Jobs of steps that resume, reads that are tried again, pushes that happen once, tables that appear whole, pauses between calls.

State lives in the folder that driver and executors share, written by Spark, so a job that was lost goes on from another machine.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stopped(RuntimeError):
    """The budget is spent; the steps that are done stay done."""


class Job:
    """``step(key, function)`` runs each key once, over all runs of the job until ``finish``. Values are JSON."""

    def __init__(self, spark: SparkSession, folder: str, name: str, budget: float = float("inf"), clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.clock = spark, f"{folder.rstrip('/')}/{name}", clock
        self.end = clock() + budget
        self.done = {r["key"]: json.loads(r["value"]) for r in self._rows().collect()}  # a row a step
        self.ran = self.skipped = 0

    def _rows(self) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema("key string, value string").json(self.path) if there else self.spark.createDataFrame([], "key string, value string")

    def step(self, key: str, function: Callable[[], Any], cost: float = 0.0) -> Any:
        if key in self.done:
            self.skipped += 1
            return self.done[key]
        if self.clock() + cost >= self.end:
            raise Stopped(f"{len(self.done)} steps are done")
        value = function()
        # a file a step: a write that is lost leaves no part of it
        self.spark.range(1).select(F.lit(key).alias("key"), F.lit(json.dumps(value)).alias("value")).coalesce(1).write.mode("append").json(self.path)
        self.done[key] = value
        self.ran += 1
        return value

    def finish(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def retried(function: Callable[[], Any], attempts: int = 3, delay: float = 2.0, on: tuple = (Exception,), left: Callable[[], float] | None = None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The function's value; after an error of ``on`` it is tried again, each wait twice the last, while ``left`` seconds allow it."""
    if attempts < 1:
        raise ValueError("attempts")
    for n in range(attempts):
        try:
            return function()
        except on:
            wait = delay * 2**n
            if n + 1 == attempts or (left is not None and left() <= wait):
                raise
            sleep(wait)
    raise AssertionError("not reached")


def published(rows: DataFrame, path: str) -> None:
    """A table that appears whole: written beside its place, then moved there, and what was there is gone only after that."""
    spark = rows.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(path_of(path)) and fs.rename(path_of(path), path_of(old))
    if not fs.rename(path_of(fresh), path_of(path)):
        if had:
            fs.rename(path_of(old), path_of(path))
        raise OSError("the table could not be moved to its place")
    if had:
        fs.delete(path_of(old), True)


def push_candidates(events: DataFrame, pushed: DataFrame, now: str, late_minutes: int = 15) -> DataFrame:
    """id, kind, reason of what must be told: work that ended badly, and work past its estimate. pushed: id, reason, of what was told;
    each is told once. events: id, kind, ev, t (timestamp), eta (timestamp), outcome."""
    last = events.groupBy("id", "kind").agg(F.max_by(F.struct("ev", "t", "eta", "outcome"), "t").alias("e")).select("id", "kind", "e.*")
    over = (F.col("ev") == "start") & (F.col("eta") < F.lit(now).cast("timestamp") - F.expr(f"interval {late_minutes} minutes"))
    bad = (F.col("ev") == "end") & F.col("outcome").isin("red", "needs-you")
    reason = F.when(bad, F.col("outcome")).when(over, "late")
    return last.select("id", "kind", reason.alias("reason")).where("reason is not null").join(pushed, ["id", "reason"], "left_anti")


def turns(calls: DataFrame, interval_seconds: float) -> DataFrame:
    """host, id, asked, starts: when each call to a host may start, at least ``interval_seconds`` after the one before.

    A call starts at the later of its own time and the slot behind all calls before it: the running maximum of (time - n x interval)
    plus n x interval. calls: host, id, asked (timestamp)."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("host").orderBy("asked", "id")
    gap = int(interval_seconds * 1_000_000)
    n = (F.row_number().over(order) - 1).cast("long")
    rows = calls.withColumn("_n", n).withColumn("_base", F.unix_micros("asked") - F.col("_n") * gap)
    starts = F.max("_base").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * gap
    return rows.select("host", "id", "asked", F.timestamp_micros(starts).alias("starts"))
