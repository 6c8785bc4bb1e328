"""Lookups with a verdict, nearest fits and band joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check_rows(sheet: DataFrame, records: DataFrame, keys: list[str], claimed: str, actual: str, tolerance: Column | None = None) -> DataFrame:
    """``sheet`` with the number of records of its keys, their price if there is one alone, and a verdict.

    none: missing, several: ambiguous, no price on either side: unknown, else ok or mismatch. Records are counted before the
    join, so a key with very many records meets the sheet as one row.
    """
    found = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), F.min(actual).alias("found_price"))
    joined = sheet.join(found, keys, "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    gap = F.abs(F.col(claimed) - F.col("found_price"))
    verdict = (
        F.when(F.col("n_records") == 0, "missing")
        .when(F.col("n_records") > 1, "ambiguous")
        .when(F.col(claimed).isNull() | F.col("found_price").isNull(), "unknown")
        .when(gap <= (tolerance if tolerance is not None else F.lit(0)), "ok")
        .otherwise("mismatch")
    )
    return joined.withColumn("verdict", verdict).withColumn("found_price", F.when(F.col("n_records") == 1, F.col("found_price")))


def verdict_counts(checked: DataFrame, verdicts: list[str]) -> DataFrame:
    """Rows per verdict; every verdict is there, also with no rows."""
    every = reduce(DataFrame.unionAll, [checked.sparkSession.range(1).select(F.lit(v).alias("verdict")) for v in verdicts])
    counted = checked.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_rows"))
    return every.join(counted, "verdict", "left").select("verdict", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def nearest_fit(requests: DataFrame, request_id: str, need: tuple[str, str], offers: DataFrame, offer_id: str, have: tuple[str, str], steps: int) -> DataFrame:
    """For each request the offer with both sizes at least as large, the smallest by (first, second, id); null if none fits.

    The first size has few values: they are counted, and more than ``steps`` are an error, since each request is given to each of those
    at or above its need. It meets the offers of that size on an as-of order of the second size, so no pair of rows that doesn't fit
    is made.
    """
    sizes = offers.select(F.col(have[0]).alias("_size")).distinct()
    if len(sizes.limit(steps + 1).collect()) > steps:
        raise ValueError(f"the first size has more than {steps} values")
    wanted = requests.select(F.col(request_id), F.col(need[0]).alias("_a"), F.col(need[1]).alias("_b"))
    asked = wanted.join(F.broadcast(sizes), F.col("_size") >= F.col("_a"))
    kinds = offers.groupBy(F.col(have[0]).alias("_size"), F.col(have[1]).alias("_b")).agg(F.min(offer_id).alias("_offer"))
    both = asked.select("_size", "_b", F.col(request_id).alias("_request"), F.lit(None).cast(offers.schema[offer_id].dataType).alias("_offer"), F.lit(None).cast(offers.schema[have[1]].dataType).alias("_have"), F.lit(1).alias("_kind"))
    both = both.unionByName(kinds.select("_size", "_b", F.lit(None).cast(requests.schema[request_id].dataType).alias("_request"), "_offer", F.col("_b").alias("_have"), F.lit(0).alias("_kind")))
    # ascending by size two, offers before requests from behind: the next offer at or above a request
    order = Window.partitionBy("_size").orderBy(F.desc("_b"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    fit = both.withColumn("_fit", F.last(F.when(F.col("_kind") == 0, F.struct("_have", "_offer")), ignorenulls=True).over(order)).where("_kind = 1 and _fit is not null")
    best = fit.groupBy(F.col("_request").alias(request_id)).agg(F.min(F.struct(F.col("_size"), F.col("_fit._have").alias("_have"), F.col("_fit._offer").alias("_offer"))).alias("_best"))
    return requests.join(best, request_id, "left").select(*requests.columns, F.col("_best._size").alias("fit_size"), F.col("_best._have").alias("fit_second"), F.col("_best._offer").alias("fit_id"))


def band_pairs(rows: DataFrame, row_id: str, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Pairs (left_id < right_id by time, then id) of rows with equal keys at most ``seconds`` apart, found in bins of that width
    and the next bin, so only rows that are near in time meet."""
    t = F.unix_micros(F.col(at))
    width = seconds * 1_000_000
    one = rows.select(F.col(row_id).alias("left_id"), *keys, t.alias("left_t"), F.floor(t / width).alias("_bin"))
    two = rows.select(F.col(row_id).alias("right_id"), *keys, t.alias("right_t"), F.explode(F.array(F.floor(t / width), F.floor(t / width) - 1)).alias("_bin"))
    near = (F.col("right_t") - F.col("left_t") <= width) & ((F.col("left_t") < F.col("right_t")) | ((F.col("left_t") == F.col("right_t")) & (F.col("left_id") < F.col("right_id"))))
    return one.join(two, [*keys, "_bin"]).where(near).select(*keys, "left_id", "right_id", ((F.col("right_t") - F.col("left_t")) / 1_000_000).alias("seconds"))
