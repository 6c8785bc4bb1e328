"""Queries over the star tables: lookups, versions, totals, ranks, intervals, fits and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import activity, intervals, lookup, totals, versions
from corvane.plans.registry import query, table

CENT = "decimal(18,2)"


def _cents(c: str, scale: int = 2):
    return F.col(c).cast(f"decimal(18,{scale})")


@query(
    """SELECT p.p_partkey, p.p_brand, p.p_size, p.claimed, coalesce(r.n, 0) AS n_records,
              CASE WHEN r.n = 1 THEN r.price END AS found_price,
              CASE WHEN r.n IS NULL THEN 'missing' WHEN r.n > 1 THEN 'ambiguous'
                   WHEN p.claimed IS NULL OR r.price IS NULL THEN 'unknown'
                   WHEN abs(p.claimed - r.price) <= 0.01 THEN 'ok' ELSE 'mismatch' END AS verdict
       FROM (SELECT p_partkey, p_brand, p_size, p_type, CAST(p_retailprice AS DECIMAL(18,2)) AS claimed FROM part) p
       LEFT JOIN (SELECT p_brand, p_size, p_type, count(*) AS n, min(CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(CASE WHEN p_size > 40 THEN '1.05' ELSE '1.00' END AS DECIMAL(3,2)) AS DECIMAL(18,2))) AS price
                  FROM part WHERE p_size > 5 GROUP BY ALL) r
       ON p.p_brand = r.p_brand AND p.p_size = r.p_size AND p.p_type = r.p_type"""
)
def price_sheet_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of all parts against a listing that leaves out the smallest and has other prices for the largest."""
    part = table(spark, sf_dir, "part")
    sheet = part.select("p_partkey", "p_brand", "p_size", "p_type", _cents("p_retailprice").alias("claimed"))
    price = (F.col("p_retailprice").cast("decimal(12,2)") * F.when(F.col("p_size") > 40, "1.05").otherwise("1.00").cast("decimal(3,2)")).cast(CENT)
    listing = part.where("p_size > 5").select("p_brand", "p_size", "p_type", price.alias("price"))
    out = lookup.check_rows(sheet, listing, ["p_brand", "p_size", "p_type"], "claimed", "price", F.lit(0.01).cast(CENT))
    return out.select("p_partkey", "p_brand", "p_size", "claimed", "n_records", "found_price", "verdict")


@query(
    """WITH s AS (SELECT p.p_partkey, CASE WHEN r.n IS NULL THEN 'missing' WHEN r.n > 1 THEN 'ambiguous' ELSE 'ok' END AS verdict
         FROM part p LEFT JOIN (SELECT p_brand, p_size, p_type, count(*) AS n FROM part WHERE p_size > 5 GROUP BY ALL) r
         ON p.p_brand = r.p_brand AND p.p_size = r.p_size AND p.p_type = r.p_type)
       SELECT v.verdict, count(s.p_partkey) AS n_rows FROM (VALUES ('ok'), ('mismatch'), ('missing'), ('ambiguous'), ('unknown')) v(verdict)
       LEFT JOIN s ON s.verdict = v.verdict GROUP BY v.verdict"""
)
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("price", _cents("p_retailprice"))
    listing = part.where("p_size > 5").select("p_brand", "p_size", "p_type", F.lit(1).cast(CENT).alias("listed"))
    sheet = part.select("p_partkey", "p_brand", "p_size", "p_type", F.lit(1).cast(CENT).alias("claimed"))
    checked = lookup.check_rows(sheet, listing, ["p_brand", "p_size", "p_type"], "claimed", "listed")
    return lookup.verdict_counts(checked, ["ok", "mismatch", "missing", "ambiguous", "unknown"])


@query(
    """WITH o AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_type AS kind FROM part WHERE p_size < 45),
            n AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(CASE WHEN p_size BETWEEN 20 AND 25 THEN '1.10' ELSE '1.00' END AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS price,
                         CASE WHEN p_size = 30 THEN upper(p_type) || '!' ELSE p_type END AS kind FROM part WHERE p_size > 4)
       SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey,
              CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed'
                   WHEN o.price IS DISTINCT FROM n.price OR o.kind IS DISTINCT FROM n.kind THEN 'changed' ELSE 'same' END AS change,
              CASE WHEN o.p_partkey IS NULL OR n.p_partkey IS NULL THEN '' ELSE
                   concat_ws(',', CASE WHEN o.price IS DISTINCT FROM n.price THEN 'price' END, CASE WHEN o.kind IS DISTINCT FROM n.kind THEN 'kind' END) END AS fields,
              o.price AS old_price, n.price AS new_price, o.kind AS old_kind, n.kind AS new_kind
       FROM o FULL JOIN n ON o.p_partkey = n.p_partkey"""
)
def listing_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.where("p_size < 45").select("p_partkey", _cents("p_retailprice").alias("price"), F.col("p_type").alias("kind"))
    price = (F.col("p_retailprice").cast("decimal(12,2)") * F.when(F.col("p_size").between(20, 25), "1.10").otherwise("1.00").cast("decimal(3,2)")).cast(CENT)
    kind = F.when(F.col("p_size") == 30, F.concat(F.upper("p_type"), F.lit("!"))).otherwise(F.col("p_type"))
    new = part.where("p_size > 4").select("p_partkey", price.alias("price"), kind.alias("kind"))
    return versions.diff(old, new, "p_partkey", ["price", "kind"])


@query(
    """WITH b AS (SELECT s_suppkey, s_nationkey AS v FROM supplier WHERE s_nationkey < 22),
            o AS (SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN s_nationkey + 100 ELSE s_nationkey END AS v FROM supplier WHERE s_nationkey <> 10),
            t AS (SELECT s_suppkey, CASE WHEN s_nationkey < 4 THEN s_nationkey + 100 WHEN s_nationkey < 6 THEN s_nationkey + 200 WHEN s_nationkey = 12 THEN 0 ELSE s_nationkey END AS v FROM supplier WHERE s_nationkey <> 15),
            j AS (SELECT s_suppkey, b.v AS bv, b.s_suppkey IS NOT NULL AS bh, o.v AS ov, o.s_suppkey IS NOT NULL AS oh, t.v AS tv, t.s_suppkey IS NOT NULL AS th
                  FROM b FULL JOIN o USING (s_suppkey) FULL JOIN t USING (s_suppkey)),
            k AS (SELECT *, (oh = th AND ov IS NOT DISTINCT FROM tv) AS ot, (bh = th AND bv IS NOT DISTINCT FROM tv) AS bt, (bh = oh AND bv IS NOT DISTINCT FROM ov) AS bo FROM j)
       SELECT s_suppkey, CASE WHEN ot OR bt THEN ov WHEN bo THEN tv END AS merged,
              CASE WHEN ot AND bo THEN 'unchanged' WHEN ot THEN 'both' WHEN bt THEN 'ours' WHEN bo THEN 'theirs' ELSE 'conflict' END AS outcome
       FROM k WHERE NOT ((ot OR bt) AND NOT oh) AND NOT (NOT ot AND NOT bt AND bo AND NOT th)"""
)
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = F.col("s_nationkey")
    base = s.where("s_nationkey < 22").select("s_suppkey", n.alias("v"))
    ours = s.where("s_nationkey <> 10").select("s_suppkey", F.when(n < 8, n + 100).otherwise(n).alias("v"))
    theirs = s.where("s_nationkey <> 15").select("s_suppkey", F.when(n < 4, n + 100).when(n < 6, n + 200).when(n == 12, 0).otherwise(n).alias("v"))
    return versions.merge_three(base, ours, theirs, "s_suppkey", "v")


@query(
    """SELECT CASE WHEN g = '' THEN 'all' ELSE g END AS "grouping", day, flag, supplier, amount, quantity, n_rows FROM (
       SELECT concat_ws('+', CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(flag) = 0 THEN 'flag' END, CASE WHEN grouping(supplier) = 0 THEN 'supplier' END) AS g,
              day, flag, supplier, sum(amount) AS amount, sum(quantity) AS quantity, count(*) AS n_rows
       FROM (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, l_suppkey AS supplier, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS amount, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM lineitem)
       GROUP BY GROUPING SETS ((day), (flag), (supplier, flag), ()))"""
)
def billing_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily billing rows summed by day, by consumption type, by resource and type, and in all, in one pass."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("supplier"), (F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("amount"), _cents("l_quantity").alias("quantity")
    )
    sums = {"amount": F.sum("amount"), "quantity": F.sum("quantity"), "n_rows": F.count(F.lit(1))}
    out = totals.grouping_totals(rows, [["day"], ["flag"], ["supplier", "flag"], []], sums)
    return out.select("grouping", "day", "flag", "supplier", "amount", "quantity", "n_rows")


@query(
    """SELECT o_custkey, month, sum(rounded) AS sum_of_rounded, round(sum(day_sum), 0) AS rounded_sum
       FROM (SELECT o_custkey, date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS month, CAST(o_orderdate AS DATE) AS d,
                    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS day_sum, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS rounded FROM orders GROUP BY ALL)
       GROUP BY ALL"""
)
def sum_of_rounded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month is the sum of its rounded days, which differs from the rounded sum."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), _cents("o_totalprice").alias("amount"))
    days = o.groupBy("o_custkey", F.trunc("d", "month").alias("month"), "d").agg(F.sum("amount").alias("day_sum"))
    return days.groupBy("o_custkey", "month").agg(F.sum(F.round("day_sum", 0)).alias("sum_of_rounded"), F.round(F.sum("day_sum"), 0).alias("rounded_sum"))


@query(
    """SELECT p_brand, count(*) AS n_rows, count(price) AS n_known, CASE WHEN count(price) = count(*) THEN sum(price) END AS total, sum(price) AS total_of_known
       FROM (SELECT p_brand, CASE WHEN NOT (p_size = 7 AND p_retailprice > 1500) THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS price FROM part) GROUP BY p_brand"""
)
def unknown_aware_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unreadable price makes a total unknown; the sum of the known ones is given beside it."""
    price = F.when(~((F.col("p_size") == 7) & (F.col("p_retailprice") > 1500)), _cents("p_retailprice"))
    p = table(spark, sf_dir, "part").select("p_brand", price.alias("price"))
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_rows"), F.count("price").alias("n_known"), totals.known_sum(F.col("price")).alias("total"), F.sum("price").alias("total_of_known"))


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey) END AS "rank" FROM orders"""
)
def rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first in each group; withheld rows get no rank."""
    o = table(spark, sf_dir, "orders")
    return versions.ranked(o, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], F.col("o_orderstatus") != "P").select("o_orderkey", "o_custkey", "rank")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return versions.latest(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])


@query(
    """SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00') WHERE n = 1"""
)
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user at a moment."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e = e.withColumn("at", F.struct("ts", "event_id"))
    limit = F.expr("timestamp_ntz'2024-01-15 12:00:00'")
    return versions.latest(e.where(F.col("ts") <= limit), ["user_id"], [F.col("at")], ["ts", "event_id", "event_type"])


_SPANS = "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INT) AS e FROM lineitem"
_ISLANDS = f"""WITH r AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
       n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m),
       i AS (SELECT l_suppkey, min(s) AS s, max(e) AS e, count(*) AS n_rows FROM n GROUP BY l_suppkey, island)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("s"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber").cast("int")).alias("e"))


@query(_ISLANDS + " SELECT l_suppkey, s, e, n_rows FROM i")
def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(_spans(spark, sf_dir), ["l_suppkey"], "s", "e")


@query(_ISLANDS + " SELECT * FROM (SELECT l_suppkey, lag(e) OVER (PARTITION BY l_suppkey ORDER BY s) AS gap_start, s AS gap_end FROM i) WHERE gap_start IS NOT NULL")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(intervals.islands(_spans(spark, sf_dir), ["l_suppkey"], "s", "e"), ["l_suppkey"], "s", "e")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE)::TIMESTAMP AS s, (CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INT))::TIMESTAMP AS e FROM lineitem),
            w AS (SELECT *, greatest(s, TIMESTAMP '1995-03-10 06:00:00') AS cs, least(e, TIMESTAMP '1996-06-20 18:00:00') AS ce FROM r WHERE s < TIMESTAMP '1996-06-20 18:00:00' AND e > TIMESTAMP '1995-03-10 06:00:00')
       SELECT l_suppkey, count(*) AS n_rows, sum(round(CAST(amount * (epoch_us(ce) - epoch_us(cs)) / (epoch_us(e) - epoch_us(s)) AS DECIMAL(18,6)), 2)) AS prorated FROM w GROUP BY l_suppkey"""
)
def prorated_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows clipped to a window, their amounts in proportion."""
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast(CENT).alias("amount"), F.to_date("l_shipdate").cast("timestamp").alias("s"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber").cast("int")).cast("timestamp").alias("e"))
    cut = intervals.clipped(r, "s", "e", F.expr("timestamp'1995-03-10 06:00:00'"), F.expr("timestamp'1996-06-20 18:00:00'"))
    part = F.round((F.col("amount").cast("double") * F.col("share")).cast("decimal(18,6)"), 2)
    return cut.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).alias("prorated"))


_NEED = "SELECT s_suppkey, CAST(s_suppkey * 7 + s_nationkey AS INT) % 55 AS need_size, CAST(1000 + abs(s_acctbal) / 10 AS DECIMAL(18,2)) AS need_price FROM supplier"


@query(
    f"""WITH q AS ({_NEED}), c AS (SELECT q.*, p.p_size, CAST(p.p_retailprice AS DECIMAL(18,2)) AS price, p.p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY p.p_size, CAST(p.p_retailprice AS DECIMAL(18,2)), p.p_partkey) AS n
          FROM q JOIN part p ON p.p_size >= q.need_size AND CAST(p.p_retailprice AS DECIMAL(18,2)) >= q.need_price)
        SELECT q.s_suppkey, q.need_size, q.need_price, c.p_size AS fit_size, c.price AS fit_second, c.p_partkey AS fit_id FROM q LEFT JOIN (SELECT * FROM c WHERE n = 1) c ON q.s_suppkey = c.s_suppkey"""
)
def nearest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest part that is large enough in both measures."""
    s = table(spark, sf_dir, "supplier")
    need = s.select("s_suppkey", ((F.col("s_suppkey") * 7 + F.col("s_nationkey")).cast("int") % 55).alias("need_size"), (F.lit(1000) + F.abs("s_acctbal") / 10).cast(CENT).alias("need_price"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", _cents("p_retailprice").alias("price"))
    return lookup.nearest_fit(need, "s_suppkey", ("need_size", "need_price"), parts, "p_partkey", ("p_size", "price"), 50)


@query(
    """SELECT a.user_id, a.event_type, a.event_id AS left_id, b.event_id AS right_id, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0 AS seconds
       FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 120000000
            AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id))"""
)
def probable_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key within 120 seconds of each other."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return lookup.band_pairs(e, "event_id", ["user_id", "event_type"], "ts", 120)


@query(
    """SELECT d.doc_id, g.keeper, g.n_copies, CASE WHEN g.n_copies = 1 THEN 'alone' WHEN d.doc_id = g.keeper THEN 'keep' ELSE 'remove' END AS action
       FROM documents d JOIN (SELECT md5(text) AS h, min(doc_id) AS keeper, count(*) AS n_copies FROM documents GROUP BY 1) g ON md5(d.text) = g.h"""
)
def identical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of equal content with a keeper and an action. Hashes alone are shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    sets = d.groupBy("h").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n_copies"))
    action = F.when(F.col("n_copies") == 1, "alone").when(F.col("doc_id") == F.col("keeper"), "keep").otherwise("remove")
    return d.join(sets, "h").select("doc_id", "keeper", "n_copies", action.alias("action"))


@query(
    """WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
            m AS (SELECT lo, hi, unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, date_trunc('month', hi)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM b),
            d AS (SELECT month, (CASE WHEN last_day(month) < hi THEN last_day(month) ELSE hi END - CASE WHEN month > lo THEN month ELSE lo END) + 1 AS days FROM m),
            o AS (SELECT date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS month, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders GROUP BY 1)
       SELECT d.month, CAST(d.days AS INT) AS days, CAST(d.days * 24 AS INT) AS hours, coalesce(o.n, 0) AS n_orders, coalesce(o.amount, 0) AS amount FROM d LEFT JOIN o ON d.month = o.month"""
)
def month_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of the term, part months by their days, also months without rows."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), _cents("o_totalprice").alias("amount"))
    term = o.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    months = term.select("lo", "hi", F.explode(intervals.month_spine(F.col("lo"), F.col("hi"))).alias("month"))
    days = F.datediff(F.least(F.last_day("month"), F.col("hi")), F.greatest(F.col("month"), F.col("lo"))) + 1
    by = o.groupBy(F.trunc("d", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return months.join(by, "month", "left").select("month", days.alias("days"), (days * 24).alias("hours"), F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("amount", F.lit(0)).alias("amount"))


_POOL = """WITH h AS (SELECT l_suppkey, date_trunc('month', CAST(l_shipdate AS DATE))::DATE AS month, CAST(sum(l_quantity) AS BIGINT) AS hours FROM lineitem GROUP BY ALL),
       t AS (SELECT l_suppkey, CAST(ceil(max(hours) / 100.0) AS BIGINT) AS most FROM h GROUP BY 1),
       c AS (SELECT h.l_suppkey, n, sum(CAST(n * 60 + greatest(hours - n * 100, 0) AS DECIMAL(18,2))) AS total FROM h JOIN (SELECT l_suppkey, unnest(generate_series(0, most)) AS n FROM t) u ON h.l_suppkey = u.l_suppkey GROUP BY 1, 2)"""


@query(_POOL + " SELECT l_suppkey, n AS units, total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY total, n) AS r FROM c) WHERE r = 1")
def pool_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of reserved units with the least total over all months: 100 hours and 60 a unit and month, the rest at 1 an hour."""
    h = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc(F.to_date("l_shipdate"), "month").alias("month")).agg(F.sum("l_quantity").cast("long").alias("hours"))
    # the cost is linear between the months' kinks, so only the units beside a kink can be the best: two for each month of the term
    rows = h.groupBy("l_suppkey").agg(F.collect_list("hours").alias("hs"))
    beside = F.flatten(F.transform("hs", lambda x: F.array(F.floor(x / 100), F.ceil(x / 100))))
    tried = F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), beside))
    total = lambda n: F.aggregate("hs", F.lit(0).cast("long"), lambda a, x: a + n * 60 + F.greatest(x - n * 100, F.lit(0)))
    best = rows.select("l_suppkey", F.array_min(F.transform(tried, lambda n: F.struct(total(n).alias("total"), n.alias("units")))).alias("b"))
    return best.select("l_suppkey", F.col("b.units").alias("units"), F.col("b.total").cast(CENT).alias("total"))


@query(
    """SELECT event_type, isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS week, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL"""
)
def class_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    week = F.concat(F.expr("extract(YEAROFWEEK FROM ts)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return e.groupBy("event_type", week.alias("week")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"))


_PAIRS = """WITH k AS (SELECT user_id, event_id, ts, CAST(event_type = 'purchase' AS INT) AS fin FROM events WHERE event_type IN ('view', 'purchase')),
       g AS (SELECT *, coalesce(sum(fin) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS item FROM k),
       p AS (SELECT user_id, min(CASE WHEN fin = 0 THEN ts END) AS started, max(CASE WHEN fin = 1 THEN ts END) AS ended, CAST(sum(1 - fin) AS BIGINT) AS n_starts FROM g GROUP BY user_id, item)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return intervals.paired(e, ["user_id"], "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")


@query(_PAIRS + " SELECT * FROM p WHERE started IS NOT NULL")
def start_end_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(_PAIRS + " SELECT user_id, started, n_starts FROM p WHERE started IS NOT NULL AND ended IS NULL")
def running_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("ended is null").select("user_id", "started", "n_starts")


@query(_PAIRS + " SELECT user_id, started, ended FROM p WHERE started IS NOT NULL AND ended >= TIMESTAMP '2024-01-20 00:00:00'")
def ended_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where(F.col("ended") >= F.expr("timestamp'2024-01-20 00:00:00'")).select("user_id", "started", "ended")


@query(
    _PAIRS
    + """ SELECT user_id, round(median(s), 3) AS median_seconds, count(*) AS n_used FROM (SELECT user_id, (epoch_us(ended) - epoch_us(started)) / 1000000.0 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ended DESC) AS n
          FROM p WHERE started IS NOT NULL AND ended IS NOT NULL) WHERE n <= 10 GROUP BY user_id"""
)
def median_of_last_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).where("ended is not null")
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000000.0
    last = p.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ended")))).where("n <= 10")
    return last.groupBy("user_id").agg(F.round(F.percentile(seconds, F.lit(0.5)), 3).alias("median_seconds"), F.count(F.lit(1)).alias("n_used"))


@query(
    """SELECT CAST(ts AS DATE) AS day, count(*) AS n_calls, count(*) FILTER (WHERE event_type = 'error') AS n_errors, round(sum(CAST(value AS DECIMAL(18,4))), 2) AS waited, count(DISTINCT event_type) AS n_kinds,
              sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS sum_k FROM events GROUP BY 1"""
)
def usage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, errors and waiting by day, with a nested field read that never raises."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).alias("waited"), F.countDistinct("event_type").alias("n_kinds"), F.sum(F.expr("try_cast(get_json_object(props, '$.k') as bigint)")).alias("sum_k")
    )


@query(
    """SELECT event_type, count(*) AS n_ids, CAST(sum(CAST('0x' || substr(md5(event_id::VARCHAR), 1, 15) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(md5(event_id::VARCHAR), 16, 15) AS BIGINT)) AS VARCHAR) AS digest FROM events GROUP BY 1"""
)
def inventory_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count and an order-free digest of the id set of each kind."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_ids"), totals.set_digest(F.col("event_id")).alias("digest"))


@query(
    """SELECT s_suppkey, reason, reason = '' AS kept FROM (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'negative' WHEN s_nationkey IN (SELECT n_nationkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA') THEN 'region' WHEN s_acctbal < 1000 THEN 'small' ELSE '' END AS reason FROM supplier)"""
)
def export_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that leaves a row out of an export, or none."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    asia = nation.join(region, nation.n_regionkey == region.r_regionkey).where("r_name = 'ASIA'").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("in_asia"))
    s = table(spark, sf_dir, "supplier").join(asia, "s_nationkey", "left")
    reason = F.when(F.col("s_acctbal") < 0, "negative").when(F.col("in_asia"), "region").when(F.col("s_acctbal") < 1000, "small").otherwise("")
    return s.select("s_suppkey", reason.alias("reason"), (reason == "").alias("kept"))


@query(
    """SELECT n.n_name, count(c.c_custkey) AS n_customers, coalesce(sum(CAST(c.c_acctbal AS DECIMAL(18,2))), 0) AS balance, round(100.0 * count(c.c_custkey) / nullif((SELECT count(*) FROM customer), 0), 1) AS percent
       FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 0 GROUP BY n.n_name"""
)
def counts_every_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per level with every level present, and a percentage that is null for a whole of zero."""
    c = table(spark, sf_dir, "customer")
    by = c.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(_cents("c_acctbal")).alias("balance"))
    whole = c.agg(F.count(F.lit(1)).alias("whole"))
    out = table(spark, sf_dir, "nation").join(by, "n_nationkey", "left").join(F.broadcast(whole))
    n = F.coalesce("n", F.lit(0))
    return out.select("n_name", n.alias("n_customers"), F.coalesce("balance", F.lit(0)).alias("balance"), F.round(F.lit(100.0) * n / F.nullif("whole", F.lit(0)), 1).alias("percent"))


@query(
    """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS last_seven_rows,
              count(*) - lag(count(*)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS change FROM events GROUP BY 1, 2"""
)
def counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-day counters that two runs add to, with a running window and the change against the row before."""
    e = table(spark, sf_dir, "events")
    run = lambda some: e.where(some).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    by = activity.added(run(F.col("event_id") % 3 == 0), run(F.col("event_id") % 3 != 0), ["user_id", "day"], "n")
    order = Window.partitionBy("user_id").orderBy("day")
    return by.select("user_id", "day", "n", F.sum("n").over(order.rowsBetween(-6, 0)).alias("last_seven_rows"), (F.col("n") - F.lag("n").over(order)).alias("change"))


@query(
    """SELECT o_orderpriority, lo AS p90_price, mid AS median_price, hi AS max_price FROM (SELECT o_orderpriority, quantile_disc(CAST(o_totalprice AS DECIMAL(18,2)), 0.9) AS lo, quantile_disc(CAST(o_totalprice AS DECIMAL(18,2)), 0.5) AS mid, max(CAST(o_totalprice AS DECIMAL(18,2))) AS hi FROM orders GROUP BY 1)"""
)
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", _cents("o_totalprice").alias("price"))
    found = totals.nearest_ranks(o, "o_orderpriority", "price", {"p90_price": 0.9, "median_price": 0.5, "max_price": 1.0}, F.floor(F.col("price") / 1000))
    return found.select("o_orderpriority", *[F.col(c).cast(CENT).alias(c) for c in ("p90_price", "median_price", "max_price")])


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS checked, CAST(o_orderdate AS DATE) + CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 180 ELSE 365 END AS expires,
              CAST(o_orderdate AS DATE) + CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 180 ELSE 365 END < DATE '1997-06-30' AS expired,
              CASE WHEN o_orderstatus = 'P' THEN '' WHEN CAST(o_orderdate AS DATE) + CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 180 ELSE 365 END < DATE '1997-06-30' THEN 'V1' WHEN o_orderpriority LIKE '1-%' THEN 'V4' WHEN o_orderpriority LIKE '2-%' THEN 'V3' ELSE 'V2' END AS level FROM orders"""
)
def fact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry by class, strict on the day itself, and a level from grade, expiry and tier."""
    today, checked = F.lit("1997-06-30").cast("date"), F.to_date("o_orderdate")
    expires = F.date_add(checked, F.when(F.col("o_orderstatus") == "F", 30).when(F.col("o_orderstatus") == "O", 180).otherwise(365))
    level = F.when(F.col("o_orderstatus") == "P", "").when(expires < today, "V1").when(F.col("o_orderpriority").startswith("1-"), "V4").when(F.col("o_orderpriority").startswith("2-"), "V3").otherwise("V2")
    return table(spark, sf_dir, "orders").select("o_orderkey", checked.alias("checked"), expires.alias("expires"), (expires < today).alias("expired"), level.alias("level"))


@query(
    """SELECT l_orderkey, l_linenumber, round(rate * qty * 720, 2) AS monthly, round(round(rate * qty * 720, 2) * 12, 2) AS yearly, CAST(d AS DATE) AS due FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DECIMAL(10,4)) AS rate, CAST(l_quantity AS DECIMAL(10,2)) AS qty, CAST(l_shipdate AS DATE) + INTERVAL 1 MONTH AS d FROM lineitem)"""
)
def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly and yearly prices to the cent, and a due date one month on, clamped to the month's end."""
    monthly = F.round(F.col("rate") * F.col("qty") * F.lit(720), 2)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("decimal(10,4)").alias("rate"), F.col("l_quantity").cast("decimal(10,2)").alias("qty"), F.add_months(F.to_date("l_shipdate"), 1).alias("due"))
    return rows.select("l_orderkey", "l_linenumber", monthly.alias("monthly"), F.round(monthly * 12, 2).alias("yearly"), "due")


@query(
    """WITH s AS (SELECT p_partkey, p_retailprice, md5('seed-7:' || p_partkey::VARCHAR) AS h FROM part), t AS (SELECT *, row_number() OVER (ORDER BY h) AS n FROM s)
       SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM t WHERE n <= 50"""
)
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows by a seeded hash: the same ones on every run and partitioning."""
    p = table(spark, sf_dir, "part").withColumn("h", F.md5(F.concat(F.lit("seed-7:"), F.col("p_partkey").cast("string")).cast("binary")))
    return p.orderBy("h").limit(50).select("p_partkey", _cents("p_retailprice").alias("price"))
