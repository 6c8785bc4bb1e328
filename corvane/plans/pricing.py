"""Queries of prices: parts stand for price records, orders for lines of a specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import pricing as P
from corvane.plans.registry import query, table

_RECORDS = """SELECT 'r' || (p_partkey % 2) AS region, 'P' || (p_partkey - CASE WHEN p_partkey % 97 = 2 THEN 2 ELSE 0 END) AS id, 'svc' || (p_partkey % 3) AS service, p_brand || '.' || (p_size % 5) AS flavor, ['Open Linux', 'Windows', 'Windows SQL', ''][1 + p_partkey // 6 % 4] AS os,
       ['h', 'GB/month', 'Mbit/h', 'h'][1 + p_partkey % 4] AS unit, CASE WHEN p_partkey % 50 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(12,2)) / 1000 END AS payg0,
       CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(12,2)) / 2 END AS r120, CASE WHEN p_partkey % 13 = 0 THEN 'g1' END AS tier_group FROM part"""
_RECORDS = f"SELECT * EXCLUDE (payg0, r120), CAST(payg0 AS DECIMAL(18,6)) AS payg, CAST(r120 AS DECIMAL(18,6)) AS r12 FROM ({_RECORDS})"
_SOURCE = "(SELECT o_orderkey AS l_orderkey, 1 + o_orderkey % 7 AS l_linenumber, 1 + (o_custkey * 13 + o_orderkey) % 2000 AS l_partkey, o_custkey AS l_suppkey, 1 + o_orderkey % 50 AS l_quantity FROM orders)"
_LINES = """SELECT l_orderkey * 10 + l_linenumber AS line, 'SVC' || (l_partkey % 3) AS service, CASE WHEN l_orderkey % 5 = 0 THEN 'svc1' ELSE '' END AS api, CASE WHEN l_linenumber % 2 = 1 THEN 'P' || l_partkey ELSE '' END AS id, 'r' || (l_partkey % 2) AS region,
       CASE WHEN l_linenumber % 2 = 0 THEN 'BRAND#' || (11 + l_suppkey % 45) || '.' || (l_partkey % 5) ELSE '' END AS flavor, CASE WHEN l_linenumber % 2 = 1 THEN '' ELSE ['', 'windows', 'open', 'Windows SQL', 'bsd'][1 + l_orderkey % 5] END AS os,
       CAST(l_quantity AS DECIMAL(18,6)) AS quantity, CASE WHEN l_linenumber = 3 THEN CAST(100 + l_suppkey % 700 AS DECIMAL(18,6)) END AS hours, CASE WHEN l_linenumber IN (4, 5) THEN 'R12' ELSE 'PAYG' END AS term FROM lineitem""".replace("FROM lineitem", f"FROM {_SOURCE}")


def _of(n: Column, *texts: str) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (n + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)")
    rates = {"payg": F.when(k % 41 != 0, price / 1000), "r12": F.when(k % 6 == 0, F.lit(0)).otherwise(price / 2)}
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("r"), (k % 2).cast("string")).alias("region"), F.concat(F.lit("P"), (k - F.when(k % 97 == 2, 2).otherwise(0)).cast("string")).alias("id"), F.concat(F.lit("svc"), (k % 3).cast("string")).alias("service"),
        F.concat("p_brand", F.lit("."), (F.col("p_size") % 5).cast("string")).alias("flavor"), _of(F.floor(k / 6) % 4, "Open Linux", "Windows", "Windows SQL", "").alias("os"), _of(k % 4, "h", "GB/month", "Mbit/h", "h").alias("unit"),
        F.when(k % 50 == 0, "USD").otherwise("EUR").alias("currency"), *[v.cast("decimal(18,6)").alias(n) for n, v in rates.items()], F.when(k % 13 == 0, "g1").alias("tier_group"),
    )
    return p.select("*", *[F.lit(0).cast("decimal(18,6)").alias(t.lower()) for t in P.TERMS if t.lower() not in rates])


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(o.alias("l_orderkey"), (o % 7 + 1).alias("l_linenumber"), ((c * 13 + o) % 2000 + 1).alias("l_partkey"), c.alias("l_suppkey"), (o % 50 + 1).alias("l_quantity"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, k, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return _source(spark, sf_dir).select(
        (o * 10 + n).alias("line"), text("SVC", k % 3).alias("service"), F.when(o % 5 == 0, "svc1").otherwise("").alias("api"), F.when(n % 2 == 1, text("P", k)).otherwise("").alias("id"), text("r", k % 2).alias("region"),
        F.when(n % 2 == 0, text("BRAND#", s % 45 + 11, ".", k % 5)).otherwise("").alias("flavor"), F.when(n % 2 == 1, "").otherwise(_of(o % 5, "", "windows", "open", "Windows SQL", "bsd")).alias("os"),
        F.col("l_quantity").cast("decimal(18,6)").alias("quantity"), F.when(n == 3, (s % 700 + 100).cast("decimal(18,6)")).alias("hours"), F.when(n.isin(4, 5), "R12").otherwise("PAYG").alias("term"),
    )


_FOUND = f"""r AS MATERIALIZED ({_RECORDS}), l AS MATERIALIZED (SELECT *, CASE WHEN api <> '' THEN api ELSE lower(service) END AS sn FROM ({_LINES})),
       j AS (SELECT l.*, r.id AS rid, r.service AS rs, lower(r.os) AS ros, r.unit, r.currency, r.payg, r.r12, r.tier_group FROM l LEFT JOIN r ON l.region = r.region AND CASE WHEN l.id <> '' THEN l.id = r.id ELSE lower(l.flavor) = lower(r.flavor) END),
       m AS (SELECT *, coalesce(rs = sn, false) AS same, coalesce(rs = sn AND (os = '' OR contains(ros, lower(os))), false) AS part, coalesce(rs = sn AND ros = lower(os), false) AS exact FROM j),
       c AS (SELECT *, count(rid) OVER w AS n_any, count(*) FILTER (same) OVER w AS n_same, count(*) FILTER (part) OVER w AS n_part, count(*) FILTER (exact) OVER w AS n_exact FROM m WINDOW w AS (PARTITION BY line)),
       d AS (SELECT *, os <> '' AND n_part > 1 AND n_exact > 0 AS narrowed FROM c),
       pr AS (SELECT *, CASE WHEN n_any = 0 THEN 'no record' WHEN id <> '' AND n_any > 1 THEN 'several records' WHEN n_same = 0 THEN 'other service' WHEN id <> '' THEN NULL WHEN (CASE WHEN narrowed THEN n_exact ELSE n_part END) = 0 THEN 'no such OS' WHEN (CASE WHEN narrowed THEN n_exact ELSE n_part END) > 1 THEN 'several records' END AS problem FROM d),
       f AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY line ORDER BY problem IS NULL AND NOT CASE WHEN id <> '' THEN true WHEN narrowed THEN exact ELSE part END) = 1)"""


@query(
    f"""WITH {_FOUND}, t AS (SELECT *, CASE term WHEN 'R12' THEN r12 ELSE payg END AS rate, regexp_matches(coalesce(unit, ''), '(^|/)h(/zone)?$') AS hourly FROM f),
       p AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN rate IS NULL THEN 'unreadable rate' WHEN currency <> 'EUR' THEN 'other currency' WHEN term <> 'PAYG' AND rate = 0 THEN 'no rate for the term' WHEN term <> 'PAYG' AND hours IS NOT NULL THEN 'hours with a reserved rate'
              WHEN hours IS NOT NULL AND NOT hourly THEN 'hours with a unit that is not hourly' WHEN hours > 744 THEN 'too many hours' END AS why FROM t),
       q AS (SELECT *, CASE WHEN term = 'PAYG' AND hourly THEN coalesce(hours, 720) END AS counted FROM p),
       v AS (SELECT *, CAST(round(CAST(rate AS DECIMAL(18,6)) * CAST(quantity AS DECIMAL(9,2)) * CAST(coalesce(counted, 1) AS DECIMAL(9,2)), 2) AS DECIMAL(24,2)) AS m FROM q)
       SELECT line, CASE WHEN problem IS NULL THEN rid END AS record_id, CASE WHEN why IS NULL THEN rate END AS unit_price, CASE WHEN why IS NULL THEN CAST(counted AS DECIMAL(18,6)) END AS hours, CASE WHEN why IS NULL THEN m END AS monthly, CASE WHEN why IS NULL THEN m * 12 END AS yearly,
              CASE WHEN why IS NULL THEN CASE WHEN tier_group IS NOT NULL THEN 'tiered rate' ELSE '' END END AS note, why AS problem FROM v"""
)
def priced_specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its one record and price, or the reason why there is none."""
    return P.price_lines(lines(spark, sf_dir), records(spark, sf_dir))


_POOLED = "CAST(100 + (l_orderkey * 7 + l_linenumber * 131) % 4000 AS DECIMAL(18,6))"
_START = "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(l_orderkey % 300 AS INT) END"


@query(
    f"""WITH {_FOUND.replace(_LINES, f"SELECT * EXCLUDE (term, hours), 'R12' AS term, NULL AS hours FROM ({_LINES.replace(f' FROM {_SOURCE}', f', {_POOLED} AS pooled, {_START} AS start FROM {_SOURCE} WHERE l_linenumber % 2 = 1')})")},
       g AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN r12 IS NULL OR payg IS NULL THEN 'unreadable rate' WHEN r12 = 0 THEN 'no rate for the term' WHEN payg <= 0 THEN 'no hourly rate' WHEN NOT regexp_matches(coalesce(unit, ''), '(^|/)h(/zone)?$') THEN 'unit is not hourly' END AS why FROM f),
       ok AS MATERIALIZED (SELECT line, r12, payg, pooled, start FROM g WHERE why IS NULL),
       mo AS (SELECT line, r12, payg, pooled, start, unnest(CASE WHEN start IS NULL THEN list_transform(range(12), lambda i: {{'h': CAST(730 AS DECIMAL(9,2)), 's': CAST(1 AS DECIMAL(20,18))}})
              ELSE list_transform(generate_series(date_trunc('month', start), CAST(start + INTERVAL 12 MONTH AS DATE) - 1, INTERVAL 1 MONTH), lambda d: {{'h': CAST(24 * date_diff('day', greatest(CAST(d AS DATE), start), least(CAST(d + INTERVAL 1 MONTH AS DATE), CAST(start + INTERVAL 12 MONTH AS DATE))) AS DECIMAL(9,2)),
                   's': CAST(CAST(date_diff('day', greatest(CAST(d AS DATE), start), least(CAST(d + INTERVAL 1 MONTH AS DATE), CAST(start + INTERVAL 12 MONTH AS DATE))) AS DOUBLE) / date_diff('day', d, d + INTERVAL 1 MONTH) AS DECIMAL(20,18))}}) END) AS m FROM ok),
       x AS MATERIALIZED (SELECT line, r12, payg, pooled, start, m.h AS h, m.s AS s, round(pooled::DOUBLE * m.s::DOUBLE, 6) AS own FROM mo), tp AS (SELECT line, CAST(max(ceil(own / h::DOUBLE)) AS INT) AS top FROM x GROUP BY 1), cand AS (SELECT line, unnest(range(top + 1)) AS n FROM tp),
       tot AS (SELECT line, n, sum(round(n * r12::DOUBLE * s::DOUBLE + 1e-9, 2) + round(greatest(0, own - n * h::DOUBLE) * payg::DOUBLE + 1e-9, 2)) AS total, avg(greatest(0, own - n * h::DOUBLE)) AS rest FROM x JOIN cand USING (line) GROUP BY 1, 2),
       b AS (SELECT * FROM tot QUALIFY row_number() OVER (PARTITION BY line ORDER BY round(total, 2), n) = 1),
       o AS (SELECT ok.line, n, r12, payg, CASE WHEN start IS NULL THEN greatest(0, pooled::DOUBLE - n * 730) ELSE round(rest + 1e-9, 2) END AS rest_hours FROM ok JOIN b USING (line))
       SELECT g.line, n AS units, CAST(round(n * o.r12::DOUBLE + 1e-9, 2) AS DECIMAL(24,2)) AS units_monthly, CAST(rest_hours AS DECIMAL(18,6)) AS rest_hours, CAST(round(rest_hours * o.payg::DOUBLE + 1e-9, 2) AS DECIMAL(24,2)) AS rest_monthly, CAST(NULL AS DECIMAL(24,2)) AS upfront, why AS problem FROM g LEFT JOIN o ON g.line = o.line"""
)
def pooled_specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in mode pool: the units that cost least over the term, and the hours above them."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    more = _source(spark, sf_dir).where(n % 2 == 1).select((o * 10 + n).alias("line"), ((o * 7 + n * 131) % 4000 + 100).cast("decimal(18,6)").alias("pooled_hours"), F.when(o % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (o % 300).cast("int"))).alias("start"))
    pooled = lines(spark, sf_dir).drop("term", "hours").withColumn("term", F.lit("R12")).join(more, "line")
    return P.pool_lines(pooled, records(spark, sf_dir))


_CLASS = "['general', 'general-dedicated', 'memory', 'disk-intensive', 'large-memory'][1 + p_partkey % 5]"
_FAMILY = "['D', 'E', 'NV', NULL, 'B', 'L', 'M', 'F'][1 + s_suppkey % 8]"


@query(
    f"""WITH r AS (SELECT {_CLASS} AS cls, p_brand || '.' || (p_size % 3) AS flavor, 'P' || p_partkey AS id, CAST(p_size AS DECIMAL(18,6)) AS vcpu, CAST((p_size * 4 + p_partkey % 7 * 8) / CASE WHEN p_partkey % 2 = 0 THEN 1024 ELSE 1 END AS DECIMAL(18,6)) AS ram, CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) / 1000 AS DECIMAL(18,6)) END AS payg FROM part WHERE p_partkey % 11 <> 0),
            f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cls, flavor ORDER BY payg IS NULL, id) = 1), m AS (SELECT s_suppkey AS row, {_FAMILY} AS family, CASE WHEN s_suppkey % 9 <> 0 THEN 1 + s_suppkey % 40 END AS v, CASE WHEN s_suppkey % 10 <> 0 THEN 2 + s_suppkey % 150 END AS g, s_suppkey % 4 = 0 AS noted FROM supplier),
            c AS (SELECT *, CASE family WHEN 'D' THEN 'general-dedicated' WHEN 'F' THEN 'general-dedicated' WHEN 'E' THEN 'memory' WHEN 'NV' THEN 'manual' WHEN 'B' THEN 'general' WHEN 'L' THEN 'disk-intensive' WHEN 'M' THEN 'large-memory' END AS class FROM m),
            a AS (SELECT row, arg_min(flavor, (vcpu, ram, coalesce(payg, 1e9), flavor)) AS flavor FROM c JOIN f ON f.cls = c.class WHERE vcpu >= v AND ram >= g GROUP BY 1), b AS (SELECT row, arg_min(flavor, (vcpu, ram, coalesce(payg, 1e9), flavor)) AS alternative FROM c JOIN f ON f.cls = 'general' AND c.class = 'general-dedicated' WHERE vcpu >= v AND ram >= g GROUP BY 1)
       SELECT c.row, family, class, flavor, CASE WHEN flavor IS NOT NULL THEN alternative END AS alternative, CASE WHEN class IS NULL THEN 'needs-input' WHEN class = 'manual' THEN 'manual' WHEN v IS NULL OR g IS NULL THEN 'needs-input' WHEN flavor IS NULL THEN 'no-fit' WHEN family IN ('B', 'L', 'M') OR noted THEN 'flag' ELSE 'ok' END AS status
       FROM c LEFT JOIN a ON c.row = a.row LEFT JOIN b ON c.row = b.row"""
)
def machine_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines of an inventory mapped to the nearest flavor that is not smaller."""
    k = F.col("p_partkey")
    ram = (F.col("p_size") * 4 + k % 7 * 8).cast("string")
    prices = table(spark, sf_dir, "part").where(k % 11 != 0).select(
        _of(k % 5, "general", "general-dedicated", "memory", "disk-intensive", "large-memory").alias("class"), F.concat("p_brand", F.lit("."), (F.col("p_size") % 3).cast("string")).alias("flavor"), F.concat(F.lit("P"), k.cast("string")).alias("id"),
        F.col("p_size").cast("decimal(18,6)").alias("vcpu"), F.concat(ram, F.when(k % 2 == 0, " MiB").otherwise(" GiB")).alias("ram"), F.when(k % 3 == 0, "Open Linux").otherwise("Windows").alias("os"), (F.col("p_retailprice").cast("decimal(12,2)") / 1000).cast("decimal(18,6)").alias("payg"),
    )
    s = F.col("s_suppkey")
    family = F.when(s % 8 != 3, _of(s % 8, "D", "E", "NV", "", "B", "L", "M", "F"))
    machines = table(spark, sf_dir, "supplier").select(s.alias("row"), family.alias("family"), F.when(s % 9 != 0, s % 40 + 1).cast("decimal(18,6)").alias("vcpu"), F.when(s % 10 != 0, s % 150 + 2).cast("decimal(18,6)").alias("ram"), (s % 4 == 0).alias("noted"))
    return P.map_machines(machines, P.flavors(prices))


_MODES = (("pay as you go", "PAYG"), ("Reserved 24 months", "R24"), ("r12", "R12"), ("up-front 36", "RU36"), ("reserved 12 upfront", "RU12"), ("RU24", "RU24"), ("pool", "POOL"), ("monthly", None))


@query("SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {k} THEN {repr(v) if v else 'NULL'}" for k, (_, v) in enumerate(_MODES)) + " END AS term FROM customer")
def pricing_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a specification may write its terms."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", P.mode_term(_of(k % 8, *[t for t, _ in _MODES])).alias("term"))
