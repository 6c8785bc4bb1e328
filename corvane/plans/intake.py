"""Intake of a folder: extract every part, normalise, learn names over all files, redact, and report what a check still finds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import logs, normalise, patterns
from corvane.operators import redact
from corvane.sources import readers


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """part_id and normalised text of every part that could be read; secret lines are gone before names are looked for."""
    parts = readers.extracted(readers.files(spark, folder)).where("state = 'ok' and text <> ''")

    def clean(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else logs.without_secret_lines(normalise.normalise(t).text) for t in text.to_pylist()], pa.string())

    return parts.select(F.concat("path", "part").alias("part_id"), "kind", F.arrow_udf(clean, "string")("text").alias("text"))


def run(spark: SparkSession, folder: str) -> DataFrame:
    """part_id, redacted, hits by class, and the classes that the structured patterns still find (none, if all went well)."""
    parts = read_parts(spark, folder)
    out = redact.redacted(parts.select("part_id", "text"), "part_id", redact.learn(parts))
    left = F.array_distinct(F.transform(patterns.spans(F.col("redacted")), lambda s: s["cls"]))
    return out.select("part_id", "redacted", "hits", left.alias("left"))


def incomplete(spark: SparkSession, folder: str) -> DataFrame:
    """Files of which some part could not be read in full."""
    parts = readers.extracted(readers.files(spark, folder))
    return parts.groupBy("path").agg(F.bool_or(F.col("state") != "ok").alias("incomplete"), F.count(F.lit(1)).alias("n_parts"))
