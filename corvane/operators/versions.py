"""Differences of two versions, three-way merges, latest and as-of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed, same) and the names of the fields that differ; nulls are values of their own."""
    a = old.select(F.col(key), F.lit(True).alias("_old"), *[F.col(f).alias(f"old_{f}") for f in fields])
    b = new.select(F.col(key), F.lit(True).alias("_new"), *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = a.join(b, key, "full")
    differ = [F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]
    names = F.concat_ws(",", *differ)
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(names != "", "changed").otherwise("same")
    return joined.select(key, change.alias("change"), F.when(change == "changed", names).otherwise("").alias("fields"), *[F.col(f"{s}_{f}") for f in fields for s in ("old", "new")])


def merge_three(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """key, value and outcome of a keyed three-way merge: the side that changed wins, equal changes agree, else conflict.
    A row is deleted when one side deleted it and the other left it as it was."""
    parts = [(base, "b"), (ours, "o"), (theirs, "t")]
    sides = [d.select(F.col(key), F.col(value).alias(f"_{n}"), F.lit(True).alias(f"_has_{n}")) for d, n in parts]
    j = reduce(lambda x, y: x.join(y, key, "full"), sides)
    side = lambda n: F.struct(F.coalesce(F.col(f"_has_{n}"), F.lit(False)).alias("h"), F.col(f"_{n}").alias("v"))
    b, o, t = side("b"), side("o"), side("t")
    same = lambda x, y: x.eqNullSafe(y)
    take = F.when(same(o, t), o).when(same(b, t), o).when(same(b, o), t)
    outcome = F.when(same(o, t) & same(b, o), "unchanged").when(same(o, t), "both").when(same(b, t), "ours").when(same(b, o), "theirs").otherwise("conflict")
    return j.select(key, take.alias("_take"), outcome.alias("outcome")).where(F.col("_take").isNull() | F.col("_take.h")).select(key, F.col("_take.v").alias("merged"), "outcome")


def latest(rows: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The values of the last row of each key by ``order``; a maximum of structs, so it is combined before the shuffle."""
    best = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *values)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def as_of(rows: DataFrame, keys: list[str], at: str, moment: Column, values: list[str]) -> DataFrame:
    return latest(rows.where(F.col(at) <= moment), keys, [F.col(at)], [at, *values])


def ranked(rows: DataFrame, group: list[str], order: list[Column], eligible: Column) -> DataFrame:
    """A row number in each group for eligible rows, null for others."""
    n = F.row_number().over(Window.partitionBy(*group, eligible).orderBy(*order))
    return rows.withColumn("rank", F.when(eligible, n))
