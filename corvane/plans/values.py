"""Queries of values read from texts: the inputs are written out from typed columns, and must read back as them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import values as V
from corvane.plans.registry import query, table


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(38,12)) END AS amount,
              CASE WHEN l_quantity % 10 = 0 THEN NULL ELSE CAST(round(CAST(l_tax AS DECIMAL(24,6)) * 10000 / CAST(l_quantity % 10 AS DECIMAL(24,6)) , 1) AS DECIMAL(18,1)) END AS percent FROM lineitem"""
)
def read_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with marks before, behind and between; a comma that could be read two ways is refused."""
    amount = F.col("l_extendedprice").cast("decimal(12,2)")
    kind = F.col("l_linenumber") % 4
    text = F.when(kind == 0, F.concat(F.lit("EUR "), F.format_number(amount, 2))).when(kind == 1, F.concat(F.format_number(amount, 2), F.lit(" €"))).when(kind == 2, amount.cast("string")).otherwise(F.replace(amount.cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.number(text).alias("amount"), V.percent(F.col("l_tax").cast("decimal(24,6)") * 100, F.col("l_quantity") % 10).cast("decimal(18,1)").alias("percent"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(date_trunc('second', ts) - CASE event_id % 3 WHEN 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%SZ') END AS utc,
              CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, CASE WHEN event_id % 7 = 0 THEN NULL ELSE date_diff('day', CAST(ts AS DATE), DATE '2024-06-30') END AS age,
              CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH * (event_id % 30) AS DATE) AS later FROM events"""
)
def read_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, ts = table(spark, sf_dir, "events"), F.col("ts")
    k = F.col("event_id")
    shown = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 5 == 0, F.concat(F.lit("on "), shown)).when(k % 3 == 0, F.concat(shown, F.lit(".000Z"))).when(k % 3 == 1, F.concat(shown, F.lit("+02:00"))).otherwise(shown)
    day = F.when(k % 7 == 0, F.date_format(ts, "dd.MM.yyyy")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    later = F.add_months(ts.cast("date"), (k % 30).cast("int"))
    return e.select("event_id", V.utc_text(text).alias("utc"), V.iso_date(day).alias("day"), V.age_days(F.concat(day, F.lit("T00:00:00")), F.lit("2024-06-30").cast("date")).cast("long").alias("age"), later.alias("later"))


_CUT = "(CASE p_partkey % 6 WHEN 0 THEN ' (2)' WHEN 1 THEN '_final' WHEN 2 THEN ' v12 copy' WHEN 3 THEN '-2024-05-17' WHEN 4 THEN '.Entwurf' ELSE '' END)"


@query(
    f"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[\\s._-]+', '-', 'g'), '^-|-$', '', 'g') AS stem, 'p' || (p_partkey % 3) || '/' || regexp_replace(regexp_replace(lower(p_name), '[\\s._-]+', '-', 'g'), '^-|-$', '', 'g') || '.pdf' AS grp,
               trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS norm, p_size AS major, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 99 ELSE 0 END AS minor FROM part"""
)
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems without copy marks, dates, states and versions; comparable names; version keys."""
    p = table(spark, sf_dir, "part")
    stem = F.concat("p_name", F.expr(_CUT))
    path = F.concat(F.lit("a/b/"), stem, F.lit(".PDF"))
    minor = F.col("p_partkey") % 99
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.when((F.col("p_partkey") % 2 == 0) & (minor > 0), F.concat(F.lit("."), minor.cast("string"))).otherwise(F.lit("")))
    key = V.version_key(version)
    return p.select("p_partkey", V.stem_of_name(stem).alias("stem"), V.group_of_file(F.concat(F.lit("p"), (F.col("p_partkey") % 3).cast("string")), path, F.lit(".pdf")).alias("grp"), V.norm(F.concat(F.lit("- "), F.col("p_type"))).alias("norm"), key["major"].alias("major"), key["minor"].cast("long").alias("minor"))


@query(
    """WITH s AS (SELECT p_partkey, 1 + p_partkey % 64 AS cpu, CASE p_partkey % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'E' WHEN 2 THEN 'NV' WHEN 3 THEN 'DS' WHEN 4 THEN NULL ELSE 'L' END AS family FROM part)
       SELECT p_partkey, family, CASE WHEN family = 'DS' OR family IS NULL THEN NULL ELSE cpu END AS vcpu, CASE WHEN family = 'E' THEN 2 END AS constrained, CASE WHEN family IS NOT NULL THEN coalesce(family = 'L', false) END AS arm,
              CASE p_partkey % 7 WHEN 0 THEN 'windows' WHEN 1 THEN 'red hat' WHEN 2 THEN 'suse for sap' WHEN 3 THEN 'suse linux' WHEN 4 THEN 'oracle linux' ELSE 'open linux' END AS tier, p_partkey % 3 = 1 AS hourly, p_partkey % 5 IN (0, 2) AS gpu FROM s"""
)
def machine_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families, processors and features of size names; OS tiers; hourly units; GPU flavors."""
    k = F.col("p_partkey")
    cpu = (k % 64 + 1).cast("string")
    pick = lambda n, *texts: F.element_at(F.array(*[t if not isinstance(t, str) else F.lit(t) for t in texts]), (k % n + 1).cast("int"))
    size = pick(6, F.concat(F.lit("Standard_D"), cpu, F.lit("s_v5")), F.concat(F.lit("E"), cpu, F.lit("-2s_v4")), F.concat(F.lit("standard_NV"), cpu, F.lit("as_v4")), F.concat(F.lit("DS"), cpu, F.lit("_v2")), F.concat(F.lit("QQ"), cpu), F.concat(F.lit("Standard_L"), cpu, F.lit("pls_v5")))
    os = pick(7, "Windows Server 2022", "RHEL 9", "SLES 15 for SAP", "openSUSE Leap", "Oracle Linux 8", "Ubuntu", "")
    unit, flavor = pick(3, "h/month", "Mbit/h", "GB"), pick(5, "pi2.4xlarge.4", "s3.large.2", "g7v.2xlarge", "c4.pg", "m.p1")
    m = V.machine_size(size)
    return table(spark, sf_dir, "part").select("p_partkey", m["family"].alias("family"), m["vcpu"].cast("long").alias("vcpu"), m["constrained"].alias("constrained"), m["arm"].alias("arm"), V.os_tier(os).alias("tier"), V.is_hourly(unit).alias("hourly"), V.is_gpu(flavor, F.lit("General purpose")).alias("gpu"))


@query(
    """SELECT c_custkey, c_custkey % 4 <> 3 AS is_code, CASE c_custkey % 4 WHEN 0 THEN 'CUST' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'PART' ELSE 'KUST' END AS kind, CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1 END AS n_register, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_project,
              CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'a.b,c+' || (c_custkey % 10) || ',d' END AS tags, substr(sha256('s' || chr(0) || c_name), 1, 16) AS print, 'Made in ' || c_mktsegment || ', fast and small or large' AS plain FROM customer"""
)
def codes_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, also with a wide letter, another dash or a hidden character; tag lists; salted prints; plain style."""
    k = F.col("c_custkey")
    code = F.when(k % 4 == 0, F.lit("CUST-Q7M4-PERS-12")).when(k % 4 == 1, F.lit("MAIL-AB2Z")).when(k % 4 == 2, F.lit("PART-2345")).otherwise(F.lit("KUST-Q7M4"))
    seen = F.when(k % 3 == 0, F.replace(code, F.lit("-"), F.lit("‑"))).when(k % 3 == 1, F.replace(code, F.lit("T-"), F.lit("Ｔ​-"))).otherwise(code)
    text = F.concat(F.lit("see "), seen, F.lit(" of tcp-a2b3"), F.when(k % 2 == 0, F.lit(" and hcs–zz77.")).otherwise(F.lit(" and hcs-1111.")))
    n = V.count_codes(text)
    tags = F.array(F.concat(F.lit(" A.b ,c+"), (k % 10).cast("string"), F.lit(",,a.B")), F.when(k % 9 == 0, F.lit("no tag!")).otherwise(F.lit("D")))
    plain = F.concat(F.lit("Made in "), F.col("c_mktsegment"), F.lit(" — fast, and  small, or large,"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.is_code(code).alias("is_code"), V.kind_of_code(code).alias("kind"), n["n_register"].alias("n_register"), n["n_project"].alias("n_project"), F.array_join(V.clean_tags(tags), ",").alias("tags"), V.salted_hash(F.lit("s"), F.col("c_name")).alias("print"), V.plain(plain).alias("plain"))
