"""Intervals: islands, gaps, clipping, start and end pairing, month spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching half-open intervals merged, with the number of merged rows."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.where(F.col(start) < F.col(end)).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_rows")).drop("_island")


def gaps(merged: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The spaces between the islands of each key."""
    order = Window.partitionBy(*keys).orderBy(start)
    return merged.withColumn("gap_start", F.lag(end).over(order)).where(F.col("gap_start").isNotNull()).select(*keys, "gap_start", F.col(start).alias("gap_end"))


def clipped(rows: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Rows cut to the window, with the share of each row inside it; rows outside are dropped."""
    a, z = F.greatest(F.col(start), low), F.least(F.col(end), high)
    whole = F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))
    share = (F.unix_micros(z) - F.unix_micros(a)) / whole
    return rows.where((F.col(start) < F.col(end)) & (F.col(start) < high) & (F.col(end) > low)).withColumns({"clip_start": a, "clip_end": z, "share": share})


def paired(events: DataFrame, keys: list[str], at: str, row_id: str, is_start: Column, is_end: Column) -> DataFrame:
    """Start and end rows matched: an end closes the open item of its key; a start while one is open updates it (the first
    start stands); an end without an open item is dropped. An item without an end is open (null end)."""
    order = Window.partitionBy(*keys).orderBy(at, row_id)
    kept = events.where(is_start | is_end).withColumn("_end", is_end.cast("int"))
    closed = F.coalesce(F.sum("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = kept.withColumn("_item", closed)
    items = grouped.groupBy(*keys, "_item").agg(F.min(F.when(F.col("_end") == 0, F.col(at))).alias("started"), F.max(F.when(F.col("_end") == 1, F.col(at))).alias("ended"), F.sum(1 - F.col("_end")).alias("n_starts"))
    return items.where("started is not null").drop("_item")


def month_spine(low: Column, high: Column) -> Column:
    """The first days of all months from ``low`` to ``high``."""
    return F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr("interval 1 month"))
