"""Queries of the activity log, of merges and of inventories; orders stand for log entries, events for calls and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import activity as A
from corvane.operators import merges as M
from corvane.plans.registry import query, table

_CUST = "CASE WHEN o_custkey % 6 = 0 THEN 'none' ELSE 'c' || (o_custkey % 20) END"
_LOG = f"SELECT CAST(o_orderdate AS DATE) AS date, lower(substr(o_orderpriority, 3)) AS kind, 'p' || (o_custkey % 40) AS project, {_CUST} AS customer, CASE o_orderkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['net', 'disk', 'net'] WHEN 2 THEN ['net'] ELSE ['auth', 'disk'] END AS tags, o_orderkey AS seq FROM orders"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tags = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("net"), F.lit("disk"), F.lit("net"))).when(k % 4 == 2, F.array(F.lit("net"))).otherwise(F.array(F.lit("auth"), F.lit("disk")))
    customer = F.when(F.col("o_custkey") % 6 == 0, "none").otherwise(F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")))
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.lower(F.substring("o_orderpriority", 3, 100)).alias("kind"), F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string")).alias("project"), customer.alias("customer"), tags.alias("tags"), k.alias("seq"))


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    return table(spark, sf_dir, "supplier").where(k < 35).select(name("p", 35).alias("project"), F.when(k % 7 == 0, "").otherwise(name("c", 20)).alias("customer"), F.when(k % 5 == 0, "query").otherwise("build").alias("kind"), F.when(k % 2 == 0, "active").otherwise("done").alias("state"))


@query(
    f"""WITH e AS ({_LOG}), x AS (SELECT *, unnest(CASE WHEN len(tags) = 0 THEN ['none'] ELSE list_distinct(tags) END) AS grp FROM e)
       SELECT grp, seq, row_number() OVER (PARTITION BY grp ORDER BY date DESC, seq DESC) AS place, isoyear(date) || '-W' || lpad(week(date)::VARCHAR, 2, '0') AS week FROM x"""
)
def log_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries under each of their tags, newest first, and their week."""
    return A.by_key(log(spark, sf_dir), "tech").select("grp", "seq", F.col("place").cast("long").alias("place"), A.week_of(F.col("date")).alias("week"))


@query(f"WITH e AS ({_LOG}) SELECT customer AS grp, count(*) AS n_entries, max(date) AS newest, customer = 'none' AS last FROM e GROUP BY 1")
def log_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.groups(log(spark, sf_dir), "customer")


def _text_sql(rows: str, value: str) -> str:
    return f"(SELECT project, string_agg(v || ' ' || n, ', ' ORDER BY n DESC, v) AS t FROM (SELECT project, {value} AS v, count(*) AS n FROM {rows} GROUP BY 1, 2) GROUP BY 1)"


@query(
    f"""WITH l AS ({_LOG}), e AS (SELECT * FROM l WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'), p AS (SELECT 'p' || (s_suppkey % 35) AS project, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'c' || (s_suppkey % 20) END AS customer, CASE WHEN s_suppkey % 5 = 0 THEN 'query' ELSE 'build' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'done' END AS state FROM supplier WHERE s_suppkey < 35),
            c AS (SELECT 'p' || (user_id % 50) AS project, CAST(ts AS DATE) - 10592 AS day FROM events WHERE event_type = 'view'), k AS (SELECT 'p' || (user_id % 45) AS project, CAST(ts AS DATE) - 10592 AS day FROM events WHERE event_type = 'error'),
            ci AS (SELECT * FROM c WHERE day BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' AND project IN (SELECT project FROM p)),
            d AS (SELECT project, date AS day, 1 AS lg, customer FROM e UNION ALL SELECT project, day, 0, NULL FROM ci),
            s AS (SELECT project, min(day) AS first, max(day) AS last, CAST(sum(lg) AS BIGINT) AS n_log, CAST(sum(1 - lg) AS BIGINT) AS n_commits, max(CASE WHEN customer <> 'none' THEN customer END) AS said FROM d GROUP BY 1),
            n AS (SELECT project, count(*) AS n FROM k WHERE day BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' GROUP BY 1),
            o AS (SELECT s.*, coalesce(p.customer, said, 'none') AS customer, coalesce(p.kind, '-') AS kind, coalesce(p.state, '-') AS state, coalesce(n.n, 0) AS n_calls FROM s LEFT JOIN p ON s.project = p.project LEFT JOIN n ON s.project = n.project)
       SELECT o.project, CASE WHEN kind = 'query' OR customer IN ('', 'none', '-') THEN 3 WHEN state = 'active' AND last >= DATE '1995-06-30' - 29 THEN 1 ELSE 2 END AS block, customer, kind, state, first, last, n_log, n_commits, n_calls, coalesce(a.t, 'none') AS kinds, coalesce(b.t, 'none') AS tech
       FROM o LEFT JOIN {_text_sql('e', 'kind')} a ON o.project = a.project LEFT JOIN {_text_sql('(SELECT project, unnest(tags) AS tag FROM e)', 'tag')} b ON o.project = b.project"""
)
def projects_of_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project with activity in a half-year, with its block."""
    e = table(spark, sf_dir, "events")
    day = F.date_sub(F.to_date("ts"), 10592)
    at = lambda kind, n: e.where(F.col("event_type") == kind).select(F.concat(F.lit("p"), (F.col("user_id") % n).cast("string")).alias("project"), day.alias("day"))
    return A.gather(log(spark, sf_dir), _projects(spark, sf_dir), at("view", 50), at("error", 45), "1995-01-01", "1995-06-30")


@query("SELECT strftime(ts, '%Y-%m') AS month, CAST(sum(value > 5)::BIGINT AS BIGINT) AS refused, count(*) AS calls FROM events GROUP BY 1")
def refused_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two runs added up, then by month."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").alias("day"), (F.col("value") > 5).cast("long").alias("refused"), "event_id")
    run = lambda rows, v: rows.groupBy("month", "day").agg(v.alias("n"))
    first, second = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    refused = A.added(run(first, F.sum("refused")), run(second, F.sum("refused")), ["month", "day"], "n")
    calls = A.added(run(first, F.count(F.lit(1))), run(second, F.count(F.lit(1))), ["month", "day"], "n")
    return refused.groupBy("month").agg(F.sum("n").alias("refused")).join(calls.groupBy("month").agg(F.sum("n").alias("calls")), "month")


@query(
    """WITH b AS (SELECT p_partkey AS id, p_type AS v FROM part WHERE p_partkey % 10 <> 1), o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE p_type END AS v, p_partkey AS pos FROM part WHERE p_partkey % 7 <> 1), t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN p_name ELSE p_type END AS v, p_partkey AS pos FROM part WHERE p_partkey % 8 <> 1),
            j AS (SELECT coalesce(b.id, o.id, t.id) AS id, b.v AS bv, o.v AS ov, t.v AS tv, b.id IS NOT NULL AS bh, o.id IS NOT NULL AS oh, t.id IS NOT NULL AS th FROM b FULL JOIN o ON b.id = o.id FULL JOIN t ON coalesce(b.id, o.id) = t.id),
            k AS (SELECT *, (oh, ov) IS NOT DISTINCT FROM (th, tv) AS ot, (bh, bv) IS NOT DISTINCT FROM (th, tv) AS bt, (bh, bv) IS NOT DISTINCT FROM (oh, ov) AS bo FROM j),
            m AS (SELECT id, CASE WHEN ot OR bt THEN ov WHEN bo THEN tv END AS merged, CASE WHEN ot AND bo THEN 'unchanged' WHEN ot THEN 'both' WHEN bt THEN 'ours' WHEN bo THEN 'theirs' ELSE 'conflict' END AS outcome, CASE WHEN ot OR bt THEN oh WHEN bo THEN th ELSE true END AS has, oh, th FROM k)
       SELECT id, merged, outcome, CASE WHEN oh THEN 0 WHEN th THEN 1 END AS side, CASE WHEN oh OR th THEN id END AS pos FROM m WHERE has"""
)
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed list merged from three versions, with the place of each row."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    side = lambda m, v: p.where(k % m != 1).select(k.alias("id"), v.alias("v"), k.alias("pos"))
    base = side(10, F.col("p_type")).drop("pos")
    return M.merged_tests(base, side(7, F.when(k % 6 == 0, F.col("p_brand")).otherwise(F.col("p_type"))), side(8, F.when(k % 9 == 0, F.col("p_name")).otherwise(F.col("p_type"))), "id", "v")


@query(
    """WITH f AS (SELECT conv_id * 1000 + turn AS line, role || (conv_id % 9) AS sentence FROM conversations WHERE turn <= 3), o AS (SELECT conv_id * 1000 + turn AS number, conv_id * 1000 + turn AS line, role || (conv_id % 9) AS sentence FROM conversations WHERE turn >= 2 AND conv_id % 2 = 0),
            a AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY line) AS n FROM f), b AS (SELECT number, sentence, row_number() OVER (PARTITION BY sentence ORDER BY line) AS n FROM o),
            j AS (SELECT a.line, a.sentence, b.number FROM a LEFT JOIN b ON a.sentence = b.sentence AND a.n = b.n), t AS (SELECT coalesce(max(number), 0) AS top FROM o)
       SELECT line, sentence, 'C-' || coalesce(number, top + row_number() OVER (PARTITION BY number IS NULL ORDER BY line)) AS id, CASE WHEN number IS NULL THEN '' ELSE 'kb:' || number END AS evidence, CASE WHEN number IS NULL THEN '' ELSE 'docs' END AS grade, '' AS verdict, number IS NOT NULL AS kept FROM j, t"""
)
def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    line, sentence = (F.col("conv_id") * 1000 + F.col("turn")).alias("line"), F.concat("role", (F.col("conv_id") % 9).cast("string")).alias("sentence")
    old = c.where("turn >= 2 and conv_id % 2 = 0").select(line.alias("number"), line, sentence, F.concat(F.lit("kb:"), line.cast("string")).alias("evidence"), F.lit("docs").alias("grade"), F.lit("").alias("verdict"))
    return M.merged_claims(c.where("turn <= 3").select(line, sentence), old)


@query(
    """WITH a AS (SELECT o_orderpriority AS kind, count(*) AS n, sum(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT) AS d FROM orders WHERE o_custkey % 10 <> 3 OR o_orderpriority LIKE '2%' GROUP BY 1),
            b AS (SELECT o_orderpriority AS kind, count(*) AS n, sum(('0x' || substr(md5(CASE WHEN o_orderpriority LIKE '4%' THEN o_orderkey + 1 ELSE o_orderkey END::VARCHAR), 1, 8))::BIGINT) AS d FROM orders WHERE o_custkey % 10 <> 3 OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' GROUP BY 1)
       SELECT kind, difference FROM (SELECT coalesce(a.kind, b.kind) AS kind, CASE WHEN coalesce(a.kind, b.kind) LIKE '5%' OR a.n IS NULL OR b.n IS NULL THEN 'unknown' WHEN a.d = b.d THEN NULL WHEN a.n <> b.n THEN '+' || greatest(b.n - a.n, 0) || '/-' || greatest(a.n - b.n, 0) ELSE 'other ids' END AS difference FROM a FULL JOIN b ON a.kind = b.kind) WHERE difference IS NOT NULL"""
)
def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two inventories by kind; one kind could not be read."""
    o, kind = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    some = (F.col("o_custkey") % 10 != 3) | kind.startswith("2")
    after = o.where(some | kind.startswith("3")).withColumn("o_orderkey", F.when(kind.startswith("4"), F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")))
    unread = o.where(kind.startswith("5")).select(kind.alias("kind")).distinct()
    return M.inventory_diff(M.inventory(o.where(some), "o_orderpriority", "o_orderkey"), M.inventory(after, "o_orderpriority", "o_orderkey"), unread)


@query(
    """WITH a AS (SELECT doc_id AS id, text AS s, source AS q FROM documents WHERE doc_id % 8 <> 0), b AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN text || '.' ELSE text END AS s, CASE WHEN doc_id % 11 = 0 THEN 'new' ELSE source END AS q FROM documents WHERE doc_id % 10 <> 0)
       SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'retired' WHEN a.s IS DISTINCT FROM b.s OR a.q IS DISTINCT FROM b.q THEN 'amended' END AS change FROM a FULL JOIN b ON a.id = b.id) WHERE change IS NOT NULL"""
)
def release_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts added, amended and retired between two releases."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    before = d.where(k % 8 != 0).select(k.alias("id"), F.col("text").alias("statement"), "source")
    after = d.where(k % 10 != 0).select(k.alias("id"), F.when(k % 9 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("statement"), F.when(k % 11 == 0, "new").otherwise(F.col("source")).alias("source"))
    return M.release_changes(before, after)
