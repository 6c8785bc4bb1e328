"""Queries of tests over answers, stated numbers, mentioned services, turns, due work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import checks as K
from corvane.functions import text as X
from corvane.operators import jobs
from corvane.plans.registry import query, table


@query("SELECT c_custkey, c_custkey % 3 <> 2 AS stated, length('#' || ltrim(CAST(CAST(round(abs(c_acctbal) * 100, 0) AS BIGINT) AS VARCHAR), '0')) AS key_length FROM customer WHERE abs(c_acctbal) >= 100 AND CAST(round(abs(c_acctbal) * 100, 0) AS BIGINT) % 10 <> 0")
def stated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sentence states an amount: written in full, rounded to the unit, or wrong; and the amount's key."""
    c = table(spark, sf_dir, "customer").withColumn("a", F.abs("c_acctbal").cast("decimal(12,2)")).where((F.col("a") >= 100) & (F.floor(F.col("a") * 100) % 10 != 0))
    k = F.col("c_custkey") % 3
    shown = F.when(k == 0, F.translate(F.format_number("a", 2), ",.", ".,")).when(k == 1, F.round("a", 0).cast("decimal(12,0)").cast("string")).otherwise((F.col("a") + 777).cast("string"))
    key = F.arrow_udf(_keys, "string")(F.format_number("a", 2))
    return c.select("c_custkey", K.states(F.col("c_acctbal").cast("decimal(12,2)"), F.concat(F.lit("It comes to "), shown, F.lit(" in all."))).alias("stated"), F.length(key).cast("long").alias("key_length"))


def _keys(text):
    import pyarrow as pa

    return pa.array([K.number_key(t, 1) for t in text.to_pylist()], pa.string())


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'refuted' ELSE 'undecided' END AS verdict FROM supplier")
def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two calls against the tests of a check."""
    k = F.col("s_suppkey") % 5
    state = F.when(k == 0, "ON").when(k == 1, "OFF").otherwise("ODD")
    data = F.to_json(F.struct(F.array(F.struct(F.col("s_name").alias("name"), state.alias("state"))).alias("items")))
    answers = F.concat(F.lit('[{"status": '), F.when(k == 3, "500").otherwise("200"), F.lit(', "data": '), data, F.lit('}, {"status": 200, "data": ["'), F.when(k == 4, "x").otherwise("alive"), F.lit('"]}]'))
    path = F.concat(F.lit("call 1: items[name="), F.col("s_name"), F.lit("].state is "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.read_verdict(F.concat(path, F.lit("ON")), F.concat(path, F.lit("OFF")), F.lit("call 2: 0 has alive"), answers).alias("verdict"))


@query(
    """WITH c AS (SELECT event_type AS host, event_id AS id, ts AS asked, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events WHERE user_id % 4 = 0)
       SELECT host, id, make_timestamp(max(epoch_us(asked) - n * 900000000) OVER (PARTITION BY host ORDER BY asked, id ROWS UNBOUNDED PRECEDING) + n * 900000000) AS starts FROM c"""
)
def call_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each call to a host may start, a quarter of an hour after the one before at the least."""
    e = table(spark, sf_dir, "events").where("user_id % 4 = 0").select(F.col("event_type").alias("host"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("asked"))
    return jobs.turns(e, 900).select("host", "id", F.col("starts").cast("timestamp_ntz").alias("starts"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Old Store' WHEN 1 THEN 'Gone Net' END AS name FROM part WHERE p_partkey % 4 < 2""")
def service_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that are not offered and that a text names, by name or short form."""
    services = spark.createDataFrame([("Old Store", ["Old Store", "OST"], False), ("Gone Net", ["Gone Net", "GNX"], False), ("Live", ["Live", "Wires"], True), ("Wire", ["Wire"], False)], "name string, forms array<string>, offered boolean")
    k = F.col("p_partkey") % 4
    text = F.concat("p_name", F.when(k == 0, " on the old-store").when(k == 1, " by GNX").when(k == 2, " over wires, gnx").otherwise(" in the old days"), F.lit("."))
    return K.mentioned(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", services, X.name_key)


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'needs-you' END ELSE CASE WHEN o_orderkey % 5 < 2 THEN 'late' END END AS reason FROM orders
       WHERE CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 < 2 ELSE o_orderkey % 5 < 2 END AND o_orderkey % 7 <> 0"""
)
def due_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be told once: work that ended badly, and work past its estimate."""
    o = table(spark, sf_dir, "orders")
    k, at = F.col("o_orderkey"), lambda text: F.lit(text).cast("timestamp")
    start = o.select(k.alias("id"), F.lit("order").alias("kind"), F.lit("start").alias("ev"), at("2026-01-01 08:00:00").alias("t"), F.when(k % 5 < 2, at("2026-01-01 09:00:00")).otherwise(at("2026-01-01 09:55:00")).alias("eta"), F.lit(None).cast("string").alias("outcome"))
    outcome = F.when(k % 3 == 0, "red").when(k % 3 == 1, "needs-you").otherwise("ok")
    end = o.where("o_orderstatus = 'F'").select(k.alias("id"), F.lit("order").alias("kind"), F.lit("end").alias("ev"), at("2026-01-01 08:30:00").alias("t"), F.lit(None).cast("timestamp").alias("eta"), outcome.alias("outcome"))
    told = o.where(k % 7 == 0).select(k.alias("id"), F.explode(F.array(F.lit("red"), F.lit("needs-you"), F.lit("late"))).alias("reason"))
    return jobs.push_candidates(start.unionByName(end), told, "2026-01-01 10:00:00").select("id", "reason")
