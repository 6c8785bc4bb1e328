"""Queries of evaluation, calculation, limits and event states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import calc, graders
from corvane.functions import text as X
from corvane.plans import relational  # noqa: F401  its oracles are used below
from corvane.plans import text as text_plans
from corvane.plans.registry import ORACLES, query, table
from corvane.streaming import windows


@query(
    """SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) * 24 + CASE WHEN l_linenumber > 3 THEN 720 ELSE 1 END, 4)::DECIMAL(34,4) AS value FROM lineitem"""
)
def calculated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions with units, evaluated over decimals."""
    q, p = F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    unit = F.when(F.col("l_linenumber") > 3, "month").otherwise("h")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", calc.calculated(F.concat(q, F.lit(" * "), p, F.lit(" * d + "), unit)).alias("value"))


@query(
    """SELECT s_suppkey, s_acctbal > 0 AS yes_no_ok, s_suppkey % 4 <> 0 AS number_ok, s_suppkey % 3 <> 0 AS list_ok, s_suppkey % 2 = 0 AS cited, s_suppkey % 7 = 0 AS abstained FROM supplier"""
)
def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from the suppliers, graded by each rule."""
    s = table(spark, sf_dir, "supplier")
    k, name = F.col("s_suppkey"), F.col("s_name")
    yes = F.when(F.col("s_acctbal") > 0, "Yes").otherwise("No")
    amount = F.when(k % 4 != 0, k).otherwise(k + 9)
    answer = F.concat(yes, F.lit(", on 2024-05-01 (XY-77) it is "), amount.cast("string"), F.lit(" units of alpha"), F.when(k % 3 != 0, F.lit(" and beta.")).otherwise(F.lit(" and gamma.")), F.when(k % 2 == 0, F.concat(F.lit(" See KB-"), k.cast("string"))).otherwise(F.lit("")), F.when(k % 7 == 0, F.lit(" I do not know.")).otherwise(F.lit("")))
    a = s.select(k, name, answer.alias("answer"), F.array(F.concat(F.lit("KB-"), k.cast("string"))).alias("ids"))
    items, bad = F.array(F.lit("alpha"), F.lit("beta")), F.array(F.lit("gamma"))
    c = F.col("answer")
    return a.select("s_suppkey", graders.yes_no(c, F.lit("yes")).alias("yes_no_ok"), graders.number(c, k.cast("decimal(18,6)"), F.lit(0.5).cast("decimal(18,6)")).alias("number_ok"), graders.all_items(c, items, bad).alias("list_ok"), graders.cited(c, F.col("ids")).alias("cited"), graders.abstained(c).alias("abstained"))


@query(
    f"""WITH a AS ({ORACLES["benchmark_containment"]}), r AS ({ORACLES["ranked_search"]}), q AS (SELECT DISTINCT item_id FROM a),
        f AS (SELECT r.item_id, min(r."rank") AS first_hit FROM r JOIN a ON r.item_id = a.item_id AND r.doc_id = a.doc_id GROUP BY 1)
        SELECT count(*) AS n_questions, count(*) FILTER (WHERE first_hit = 1) AS hit_1, count(*) FILTER (WHERE first_hit <= 5) AS hit_5, count(*) FILTER (WHERE first_hit IS NULL) AS misses FROM q LEFT JOIN f ON q.item_id = f.item_id"""
)
def retrieval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of the ranked search over items that some document contains."""
    accept = text_plans.benchmark_containment(spark, sf_dir).select("item_id", "doc_id")
    ranked = text_plans.ranked_search(spark, sf_dir).select("item_id", "doc_id", "rank")
    first = accept.join(ranked, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("r"))
    return first.agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("r") == 1).alias("hit_1"), F.count_if(F.col("r") <= 5).alias("hit_5"), F.count_if(F.col("r").isNull()).alias("misses"))


_W = "list_distinct(regexp_extract_all(lower(text), '[A-Za-zÀ-ÖØ-öø-ÿ]+'))"


@query(
    f"""WITH b AS (SELECT item_id, {_W} AS w FROM benchmark), u AS (SELECT item_id, len(w) AS size, unnest(w) AS word FROM b),
        p AS (SELECT a.item_id, c.item_id AS other, round(CAST(count(*) AS DOUBLE) / (any_value(a.size) + any_value(c.size) - count(*)), 6) AS overlap FROM u a JOIN u c ON a.word = c.word AND a.item_id <> c.item_id GROUP BY 1, 2)
        SELECT item_id, "rank", other, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, other) AS "rank" FROM p) WHERE "rank" <= 3"""
)
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three items with the highest word overlap (a top-k report)."""
    u = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(X.words(F.col("text"))).alias("w")).select("item_id", F.size("w").alias("size"), F.explode("w").alias("word"))
    v = u.select(F.col("item_id").alias("other"), F.col("size").alias("other_size"), "word")
    p = u.join(v, "word").where("item_id <> other").groupBy("item_id", "other").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("a"), F.first("other_size").alias("b"))
    p = p.select("item_id", "other", F.round(F.col("n").cast("double") / (F.col("a") + F.col("b") - F.col("n")), 6).alias("overlap"))
    order = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "other")
    return p.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 3).select("item_id", "rank", "other", "overlap")


@query(
    """SELECT event_id, user_id, n_before, n_before < 3 AS allowed FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS n_before FROM events)"""
)
def sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a user in the hour before, against a limit."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    before = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, -1))
    return e.select("event_id", "user_id", before.alias("n_before"), (before < 3).alias("allowed"))


@query(
    """SELECT event_id, user_id, was, event_type AS now, gap FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS was, epoch_us(ts) // 1000000 - epoch_us(lag(ts) OVER w) // 1000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE was IS DISTINCT FROM event_type"""
)
def state_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where a user's state changes, with the seconds since the row before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("was", F.lag("event_type").over(w)).withColumn("gap", seconds - F.lag(seconds).over(w))
    return e.where(~F.col("was").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "was", F.col("event_type").alias("now"), "gap")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, round(sum(CAST(value AS DECIMAL(18,4))), 2) AS total FROM events GROUP BY 1, 2")
def streamed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly totals of the event stream, read and grouped by a stream until it has no more."""
    return windows.run_hours(spark, f"{sf_dir}/events.parquet")


@query(ORACLES["start_end_pairs"].replace("SELECT * FROM p WHERE started IS NOT NULL", "SELECT user_id, started, ended, n_starts FROM p WHERE started IS NOT NULL AND ended IS NOT NULL"))
def streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end pairing as a stateful stream; open items stay in the state."""
    return windows.run_pairs(spark, f"{sf_dir}/events.parquet")
