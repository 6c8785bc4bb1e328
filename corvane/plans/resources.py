"""Queries of the cost of resources: orders stand for items of a snapshot, parts for price records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import resources as R
from corvane.plans.registry import query, table

_ITEMS = """SELECT 't' || (o_custkey % 3) AS tenant, 'h' || o_orderkey AS handle, ['ecs', 'evs', 'eip', 'elb'][1 + o_orderkey % 4] AS kind, 'r' || (o_custkey % 2) AS region,
       CASE o_orderkey % 4 WHEN 0 THEN ['ACTIVE', 'SHUTOFF', 'ACTIVE'][1 + o_orderkey % 3] WHEN 1 THEN ['in-use', 'available'][1 + o_orderkey % 2] WHEN 2 THEN ['ACTIVE', 'DOWN', 'ACTIVE'][1 + o_orderkey % 3] ELSE 'ACTIVE' END AS state,
       CASE o_orderkey % 4 WHEN 0 THEN 's' || (o_custkey % 60) || '.L' WHEN 1 THEN CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE (10 + o_orderkey % 90) || ' GB ' || ['SSD', 'SAS', 'gold'][1 + o_orderkey % 3] END ELSE '' END AS size,
       CASE WHEN o_orderkey % 8 = 0 THEN 'windows' ELSE 'linux' END AS os, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 7 < 5 THEN ['h' || (o_orderkey - 1), 'h' || (o_orderkey + 3)] ELSE CAST([] AS VARCHAR[]) END AS attached,
       CASE WHEN o_orderkey % 5 < 2 THEN 'tcp-a2b' || (2 + o_orderkey % 5) ELSE 'none' END AS project FROM orders"""
_RECORDS = """SELECT 'r' || (p_partkey % 2) AS region, 'P' || p_partkey AS id, ['ecs', 'ecs', 'evs', 'eip', 'vpc'][1 + p_partkey % 5] AS service,
       CASE p_partkey % 5 WHEN 2 THEN CASE WHEN p_partkey < 20 THEN ['VSS.SSD', 'x'][1 + p_partkey // 5 % 2] ELSE 'old' END WHEN 3 THEN CASE WHEN p_partkey < 10 THEN 'eip' ELSE 'Elastic IP' END WHEN 4 THEN 'Bandwidth eip' ELSE 'S' || (p_partkey // 2 % 70) || '.l' END AS flavor,
       CASE WHEN p_partkey % 5 < 2 THEN ['Open Linux', 'Windows', 'Windows SQL'][1 + p_partkey // 10 % 3] ELSE '' END AS os, CASE p_partkey % 5 WHEN 2 THEN CASE WHEN p_partkey < 40 THEN 'GB' ELSE 'GB/h' END ELSE 'h' END AS unit,
       CASE WHEN p_partkey % 17 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN p_partkey % 19 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) / 1000 AS DECIMAL(18,6)) END AS payg, CASE WHEN p_partkey % 5 = 2 AND p_partkey < 40 THEN ['Fast SAS', 'Slow sas', 'Gold plate'][1 + p_partkey // 5 % 3] ELSE 'x' END AS name FROM part"""
_NAMES = "list_distinct(regexp_extract_all(lower(flavor || ' ' || name), '[a-z0-9]+'))"
_PRICED = f"""i AS MATERIALIZED ({_ITEMS}), rec AS MATERIALIZED (SELECT *, regexp_matches(unit, '(^|/)h(/zone)?$') AS hourly, replace(lower(os), ' ', '') AS os1, lower(flavor) AS f1, {_NAMES} AS nm FROM ({_RECORDS}) WHERE payg IS NOT NULL),
       ru AS (SELECT region, 'windows' AS rule, f1 AS what, 0 AS level, id, payg, currency FROM rec WHERE hourly AND os1 = 'windows' UNION ALL SELECT region, 'windows', f1, 1, id, payg, currency FROM rec WHERE hourly AND contains(os1, 'windows') UNION ALL SELECT region, 'linux', f1, 0, id, payg, currency FROM rec WHERE hourly AND os1 = 'openlinux'
              UNION ALL SELECT region, 'disk', substr(f1, 5), 0, id, payg, currency FROM rec WHERE service = 'evs' AND contains(lower(unit), 'gb') AND NOT hourly AND f1 LIKE 'vss.%' UNION ALL SELECT region, 'disk', unnest(nm), 1, id, payg, currency FROM rec WHERE service = 'evs' AND contains(lower(unit), 'gb') AND NOT hourly
              UNION ALL SELECT region, 'address', '', CASE WHEN f1 = 'eip' THEN 0 ELSE 1 END, id, payg, currency FROM rec WHERE service IN ('eip', 'vpc') AND unit = 'h' AND NOT list_contains(nm, 'bandwidth') AND (list_contains(nm, 'eip') OR (list_contains(nm, 'ip') AND (list_contains(nm, 'elastic') OR list_contains(nm, 'public'))))),
       ra AS (SELECT region, rule, what, level, count(*) AS n, min(id) AS id, arg_min(payg, id) AS payg, arg_min(currency, id) AS currency FROM ru GROUP BY region, rule, what, level QUALIFY row_number() OVER (PARTITION BY region, rule, what ORDER BY level) = 1),
       a AS (SELECT *, CASE kind WHEN 'ecs' THEN CASE os WHEN 'windows' THEN 'windows' ELSE 'linux' END WHEN 'evs' THEN 'disk' WHEN 'eip' THEN 'address' END AS rule, CASE kind WHEN 'ecs' THEN lower(size) WHEN 'evs' THEN lower(regexp_extract(size, '^(\\d+) ?GB (\\w+)$', 2)) WHEN 'eip' THEN '' END AS what, TRY_CAST(nullif(regexp_extract(size, '^(\\d+) ?GB (\\w+)$', 1), '') AS BIGINT) AS gb FROM i),
       j AS (SELECT a.*, n, id, payg, currency, kind = 'ecs' AND state IN ('SHUTOFF', 'STOPPED') AS stopped FROM a LEFT JOIN ra ON a.region = ra.region AND a.rule = ra.rule AND a.what = ra.what),
       w AS (SELECT *, CASE WHEN stopped THEN NULL WHEN rule IS NULL THEN 'no rule for the kind' WHEN kind = 'ecs' AND what = '' THEN 'no flavor' WHEN kind = 'evs' AND gb IS NULL THEN 'no size' WHEN n IS NULL THEN 'no record' WHEN n > 1 THEN 'several records' WHEN currency <> 'EUR' THEN 'other currency' END AS reason FROM j),
       p AS MATERIALIZED (SELECT *, CASE WHEN stopped THEN 'stopped' WHEN reason IS NULL THEN 'priced' ELSE 'no price' END AS status, CAST(CASE WHEN stopped THEN 0 WHEN reason IS NULL THEN payg * CASE WHEN kind = 'evs' THEN gb ELSE 720 END END AS DECIMAL(24,6)) AS monthly FROM w)"""
_NOTES = "SELECT CASE WHEN c_custkey % 2 = 0 THEN 't' || (c_custkey % 3) || '/' ELSE '' END || 'h' || c_custkey AS handle, 'kept ' || c_custkey AS note FROM customer WHERE c_custkey % 9 = 0"
_PLACED = f"""n AS ({_NOTES}), o AS MATERIALIZED (SELECT p.*, CASE WHEN regexp_matches(project, '^[a-z]{{3}}-[a-z2-7]{{4}}$') THEN project END AS own, coalesce(n1.note, n2.note) AS note FROM p LEFT JOIN n n1 ON n1.handle = p.tenant || '/' || p.handle LEFT JOIN n n2 ON n2.handle = p.handle),
       d AS (SELECT tenant, handle, unnest(attached) AS server, unnest(range(len(attached))) AS pos FROM o WHERE kind = 'evs'), e AS (SELECT d.tenant, d.handle, d.pos, s.own AS sp, coalesce(s.stopped, false) AS st, n1.note IS NOT NULL OR n2.note IS NOT NULL AS kept FROM d LEFT JOIN o s ON s.kind = 'ecs' AND s.tenant = d.tenant AND s.handle = d.server LEFT JOIN n n1 ON n1.handle = d.tenant || '/' || d.server LEFT JOIN n n2 ON n2.handle = d.server),
       t AS (SELECT tenant, handle, arg_min(sp, pos) FILTER (WHERE sp IS NOT NULL) AS sp, bool_and(st) AS all_stopped, bool_or(kept) AS kept FROM e GROUP BY 1, 2),
       q AS MATERIALIZED (SELECT o.tenant, o.handle, o.kind, o.status, o.monthly, CASE WHEN o.status = 'priced' THEN o.id END AS record, o.reason, coalesce(own, sp, '-') AS project, CASE WHEN own IS NOT NULL THEN 'tag' WHEN sp IS NOT NULL THEN 'server' ELSE 'none' END AS project_source, note,
              CASE WHEN note IS NOT NULL OR coalesce(t.kept, false) THEN NULL WHEN kind = 'evs' AND coalesce(all_stopped, false) THEN 'stopped_server_disks' WHEN kind = 'evs' AND len(attached) = 0 AND state <> 'in-use' THEN 'unattached_disks' WHEN kind = 'eip' AND state IN ('DOWN', 'UNBOUND') THEN 'unbound_eips' END AS waste FROM o LEFT JOIN t ON o.tenant = t.tenant AND o.handle = t.handle)"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the same expressions as the oracle's inputs, with Spark's names for arrays and division
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    of = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (n + 1).cast("int"))
    state = F.when(k % 4 == 0, of(k % 3, "ACTIVE", "SHUTOFF", "ACTIVE")).when(k % 4 == 1, of(k % 2, "in-use", "available")).when(k % 4 == 2, of(k % 3, "ACTIVE", "DOWN", "ACTIVE")).otherwise("ACTIVE")
    size = F.when(k % 4 == 0, text("s", c % 60, ".L")).when((k % 4 == 1) & (k % 13 != 0), text(k % 90 + 10, " GB ", of(k % 3, "SSD", "SAS", "gold"))).otherwise("")
    attached = F.when((k % 4 == 1) & (k % 7 < 5), F.array(text("h", k - 1), text("h", k + 3))).otherwise(F.array().cast("array<string>"))
    items = o.select(text("t", c % 3).alias("tenant"), text("h", k).alias("handle"), of(k % 4, "ecs", "evs", "eip", "elb").alias("kind"), text("r", c % 2).alias("region"), state.alias("state"), size.alias("size"), F.when(k % 8 == 0, "windows").otherwise("linux").alias("os"), attached.alias("attached"), F.when(k % 5 < 2, text("tcp-a2b", k % 5 + 2)).otherwise("none").alias("project"))
    p, m = F.col("p_partkey"), F.col("p_partkey") % 5
    fifth = F.floor(p / 5)
    flavor = F.when(m == 2, F.when(p < 20, of(fifth % 2, "VSS.SSD", "x")).otherwise("old")).when(m == 3, F.when(p < 10, "eip").otherwise("Elastic IP")).when(m == 4, "Bandwidth eip").otherwise(text("S", F.floor(p / 2) % 70, ".l"))
    records = table(spark, sf_dir, "part").select(
        text("r", p % 2).alias("region"), text("P", p).alias("id"), of(m, "ecs", "ecs", "evs", "eip", "vpc").alias("service"), flavor.alias("flavor"), F.when(m < 2, of(F.floor(p / 10) % 3, "Open Linux", "Windows", "Windows SQL")).otherwise("").alias("os"),
        F.when(m == 2, F.when(p < 40, "GB").otherwise("GB/h")).otherwise("h").alias("unit"), F.when(p % 17 == 0, "USD").otherwise("EUR").alias("currency"), F.when(p % 19 != 0, (F.col("p_retailprice").cast("decimal(12,2)") / 1000).cast("decimal(18,6)")).alias("payg"),
        F.when((m == 2) & (p < 40), of(fifth % 3, "Fast SAS", "Slow sas", "Gold plate")).otherwise("x").alias("name"),
    )
    cust = F.col("c_custkey")
    notes = table(spark, sf_dir, "customer").where(cust % 9 == 0).select(F.concat(F.when(cust % 2 == 0, text("t", cust % 3, "/")).otherwise(""), text("h", cust)).alias("handle"), text("kept ", cust).alias("note"))
    return R.placed_items(R.price_items(items, records), notes)


@query(f"WITH {_PRICED}, {_PLACED} SELECT * FROM q")
def resource_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its monthly cost or the reason why there is none, its project, note and group of waste."""
    return _priced(spark, sf_dir).select("tenant", "handle", "kind", "status", "monthly", "record", "reason", "project", "project_source", "note", "waste")


@query(
    f"""WITH {_PRICED}, {_PLACED}, g AS (SELECT grouping(kind) AS gk, grouping(project) AS gp, grouping(tenant) AS gt, grouping(waste) AS gw, kind, project, tenant, waste, CAST(sum(coalesce(monthly, 0)) AS DECIMAL(34,6)) AS amount, count(*) AS n_items, count_if(status = 'no price') AS n_no_price FROM q GROUP BY GROUPING SETS ((), (kind), (project), (tenant), (waste)))
       SELECT CASE WHEN gk = 0 THEN 'kind' WHEN gp = 0 THEN 'project' WHEN gt = 0 THEN 'tenant' WHEN gw = 0 THEN 'waste' ELSE 'all' END AS grouping, kind, project, tenant, waste, amount, n_items, n_no_price FROM g"""
)
def resource_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cost_totals(_priced(spark, sf_dir))
