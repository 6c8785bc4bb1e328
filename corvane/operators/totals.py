"""Sums with units and unknowns, and several groupings in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def known_sum(value: Column) -> Column:
    """Null when any value is null, unlike ``sum``."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def grouping_totals(rows: DataFrame, sets: list[list[str]], totals: dict[str, Column]) -> DataFrame:
    """All groupings in one scan and one shuffle; ``grouping`` names the columns of a row's grouping."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(*[v.alias(k) for k, v in totals.items()], *[F.grouping(c).alias(f"_g_{c}") for c in every])
    name = F.concat_ws("+", *[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in every])
    return out.select(F.when(name == "", "all").otherwise(name).alias("grouping"), *every, *totals)


def set_digest(value: Column) -> Column:
    """An order-free digest of a set's values: sums of 60-bit parts of their MD5, combined before the shuffle."""
    part = lambda at: F.conv(F.substring(F.md5(value.cast("string")), at, 15), 16, 10).cast("decimal(20,0)")
    return F.concat_ws("-", F.sum(part(1)).cast("decimal(38,0)").cast("string"), F.sum(part(16)).cast("decimal(38,0)").cast("string"))


def numbered(rows: DataFrame, order: list[Column], part: Column, name: str) -> DataFrame:
    """A gapless number from 1 over all rows in ``order``. ``part`` must not fall along the order; it cuts the rows into ranges that are
    ordered by themselves, and the ranges' counts (a row a range) give the offsets."""
    rows = rows.withColumn("_part", part)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_nth", nth).join(offsets, "_part").withColumn(name, F.col("_nth") + F.col("_ahead")).drop("_part", "_nth", "_ahead")


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float], part: Column) -> DataFrame:
    """group and a column for each share: the value at rank ceil(share x n) of the group.

    ``part`` must not fall with the value; it cuts a group into ranges. Their counts (a row a group and range) tell in which range a
    rank lies, and only the rows of those ranges are ordered, each range by itself, so a group with most of the rows is no one task."""
    rows = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"), part.alias("_p"))
    counts = rows.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_g").orderBy("_p")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_g")))
    asked = counts.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.ceil(F.lit(x) * F.col("_all")).alias("rank")) for k, x in shares.items()])))
    asked = asked.where((F.col("_s.rank") > F.col("_before")) & (F.col("_s.rank") <= F.col("_before") + F.col("_n"))).select("_g", "_p", "_s.name", (F.col("_s.rank") - F.col("_before")).alias("_at"))
    ranked = rows.join(asked.select("_g", "_p").distinct(), ["_g", "_p"], "left_semi").withColumn("_at", F.row_number().over(Window.partitionBy("_g", "_p").orderBy("_v")))
    hit = ranked.join(asked, ["_g", "_p", "_at"])
    return hit.groupBy(F.col("_g").alias(group)).agg(*[F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in shares])
