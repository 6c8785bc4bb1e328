"""Lines of a specification against price records: the one record of a line, its price, pooled lines, machines, resources."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import values as V

# Terms with their months, hours of a month, the limits.
TERM_MONTHS = {"R12": 12, "R24": 24, "R36": 36, "RU12": 12, "RU24": 24, "RU36": 36}
TERMS = ("PAYG", *TERM_MONTHS)
CALCULATOR_HOURS, AVERAGE_HOURS, LONGEST_MONTH, MOST_UNITS = 720, 730, 744, 100_000


def mode_term(text: Column) -> Column:
    """``pay as you go``, ``reserved 24``, ``up front 12`` ... as PAYG, R12 ... RU36; ``pool`` as itself; null if unknown."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s_-]+", ""), "months?", "")
    form = r"^(?:ru|(?:reserved)?upfront)(12|24|36)$|^reserved(12|24|36)upfront$"
    upfront = F.concat(F.regexp_extract(s, form, 1), F.regexp_extract(s, form, 2))
    reserved = F.regexp_extract(s, r"^(?:r|reserved)(12|24|36)$", 1)
    return F.when(s.isin("payg", "payasyougo"), "PAYG").when(s == "pool", "POOL").when(reserved != "", F.concat(F.lit("R"), reserved)).when(upfront != "", F.concat(F.lit("RU"), upfront))


def rate(term: Column) -> Column:
    """The record's rate of a term; records have a column for each term, in lower case."""
    return F.coalesce(*[F.when(term == t, F.col(t.lower())) for t in TERMS])


def find_records(lines: DataFrame, records: DataFrame) -> DataFrame:
    """``lines`` with ``record`` (a struct, null if there is no single one) and ``problem``.

    lines: line (a key), service, api, flavor, os, id, region. records: region, id, service, flavor, os and more. A line names a
    record by its id, or by service and flavor, narrowed by a part of the OS text and, where several are left, by the whole of it.
    Lines that ask the same are answered once, and records of one key, service and OS are counted before they meet an ask, so neither
    many lines nor many records of a flavor multiply. Each line stays one row.
    """
    has_id = F.coalesce(F.col("id") != "", F.lit(False))
    asked = {"region": F.col("region"), "named": has_id, "key": F.when(has_id, F.col("id")).otherwise(F.lower("flavor")), "sn": F.col("sn"), "wanted_os": F.lower(F.trim(F.coalesce("os", F.lit(""))))}
    lines = lines.withColumn("sn", F.coalesce(F.when(F.col("api") != "", F.col("api")), F.lower(F.trim("service"))))
    asks = lines.select(*[v.alias(f"a_{k}") for k, v in asked.items()]).distinct()
    first = F.min_by(F.struct(*records.columns), F.col("id")).alias("r")
    kinds = [F.col("region").alias("r_region"), F.col("service").alias("r_service"), F.lower(F.coalesce("os", F.lit(""))).alias("ros")]
    by = lambda named, key: records.groupBy(*kinds, F.lit(named).alias("r_named"), key.alias("r_key")).agg(F.count(F.lit(1)).alias("n"), first)
    kept = by(True, F.col("id")).unionByName(by(False, F.lower("flavor")))
    joined = asks.join(kept, (F.col("a_region") == F.col("r_region")) & (F.col("a_named") == F.col("r_named")) & (F.col("a_key") == F.col("r_key")), "left")
    any_, same = F.col("n").isNotNull(), F.col("r_service") == F.col("a_sn")
    part = same & ((F.col("a_wanted_os") == "") | F.contains("ros", "a_wanted_os"))
    exact = part & (F.col("ros") == F.col("a_wanted_os"))
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    answers = joined.groupBy(*[f"a_{k}" for k in asked]).agg(
        count(any_).alias("n_any"), count(same).alias("n_same"), count(part).alias("n_part"), count(exact).alias("n_exact"),
        F.min_by(F.when(any_, F.col("r")), F.when(any_, F.col("r.id"))).alias("r_any"), F.min_by(F.when(part, F.col("r")), F.when(part, F.col("r.id"))).alias("r_part"), F.min_by(F.when(exact, F.col("r")), F.when(exact, F.col("r.id"))).alias("r_exact"),
    )
    found = lines
    for k, v in asked.items():
        found = found.withColumn(f"q_{k}", v)
    meets = [F.col(f"q_{k}").eqNullSafe(F.col(f"a_{k}")) for k in asked]
    found = found.join(answers, reduce(and_, meets)).drop(*[f"{x}_{k}" for x in "qa" for k in asked])
    narrowed = (F.coalesce("os", F.lit("")) != "") & (F.col("n_part") > 1) & (F.col("n_exact") > 0)
    n = F.when(narrowed, F.col("n_exact")).otherwise(F.col("n_part"))
    id_problem = F.when(F.col("n_any") == 0, "no record").when(F.col("n_any") > 1, "several records").when(F.col("n_same") == 0, "other service")
    problem = F.when(F.col("n_any") == 0, "no record").when(F.col("n_same") == 0, "other service").when(n == 0, "no such OS").when(n > 1, "several records")
    problem = F.when(has_id, id_problem).otherwise(problem)
    record = F.when(has_id, F.col("r_any")).when(narrowed, F.col("r_exact")).otherwise(F.col("r_part"))
    return found.withColumn("problem", problem).withColumn("record", F.when(F.col("problem").isNull(), record)).drop("n_any", "n_same", "n_part", "n_exact", "r_any", "r_part", "r_exact")


def _with_rate(lines: DataFrame) -> DataFrame:
    flat = lines.select("*", *[F.col(f"record.{t.lower()}").alias(t.lower()) for t in TERMS])
    return flat.withColumn("rate", rate(F.col("term"))).drop(*[t.lower() for t in TERMS])


def price_lines(lines: DataFrame, records: DataFrame, hours: int = CALCULATOR_HOURS) -> DataFrame:
    """line, record_id, unit_price, hours, monthly, yearly, note, problem of every line.

    lines also have quantity, hours (null: none given), term. A reserved rate is a flat monthly value; an hourly unit counts the
    line's hours or the default; other units take none. Each line total is rounded half up to the cent.
    """
    found = _with_rate(find_records(lines, records))
    reserved, hourly = F.col("term") != "PAYG", V.is_hourly(F.col("record.unit"))
    given = F.col("hours").isNotNull()
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("rate").isNull(), "unreadable rate").when(F.coalesce("record.currency", F.lit("")).isin("", "EUR") == F.lit(False), "other currency")
        .when(reserved & (F.col("rate") == 0), "no rate for the term").when(reserved & given, "hours with a reserved rate").when(~reserved & given & ~hourly, "hours with a unit that is not hourly").when(given & (F.col("hours") > LONGEST_MONTH), "too many hours")
    )
    counted = F.when(~reserved & hourly, F.coalesce("hours", F.lit(hours).cast("decimal(18,6)")))
    monthly = F.round(F.col("rate") * F.col("quantity") * F.coalesce(counted.cast("decimal(9,6)"), F.lit(1).cast("decimal(9,6)")), 2).cast("decimal(24,2)")
    note = F.concat_ws("; ", F.when((F.col("rate") == 0) & ~reserved, "rate is zero"), F.when(F.col("record.tier_group").isNotNull(), "tiered rate"))
    out = found.withColumn("problem", problem).withColumn("monthly", F.when(F.col("problem").isNull(), monthly))
    ok = F.col("problem").isNull()
    return out.select("line", F.col("record.id").alias("record_id"), F.when(ok, F.col("rate")).alias("unit_price"), F.when(ok, counted).alias("hours"), "monthly", (F.col("monthly") * 12).cast("decimal(24,2)").alias("yearly"), F.when(ok, note).alias("note"), "problem")


def month_parts(months: Column, start: Column) -> Column:
    """The months of a term as structs (hours, share): without a start, months of 730 hours; else the calendar months that it
    touches, 24 hours a day, the first and the last by their share."""
    even = F.transform(F.sequence(F.lit(1), months), lambda i: F.struct(F.lit(AVERAGE_HOURS).cast("decimal(9,2)").alias("hours"), F.lit(1).cast("decimal(20,18)").alias("share")))
    stop = F.add_months(start, months)
    firsts = F.sequence(F.trunc(start, "month"), F.date_sub(stop, 1), F.expr("interval 1 month"))

    def part(first: Column) -> Column:
        days = F.date_diff(F.least(F.add_months(first, 1), stop), F.greatest(first, start))
        of = F.date_diff(F.add_months(first, 1), first)
        return F.struct((days * 24).cast("decimal(9,2)").alias("hours"), (days.cast("decimal(10,0)") / of.cast("decimal(10,0)")).cast("decimal(20,18)").alias("share"))

    return F.when(start.isNull(), even).otherwise(F.transform(firsts, part))


def pool_optimum(months: Column, pooled: Column, payg: Column, reserved: Column) -> Column:
    """units, total, elastic_only: the number of reserved units that costs least over the term, the fewest on a tie.

    A month with n units costs n reserved rates by its share, plus the hours above n times its own at the hourly rate, each
    rounded to the cent. All candidates are tried inside the row (at most ``MOST_UNITS``; null beyond), so nothing is exchanged.
    """
    money = lambda c: F.round(c, 2).cast("decimal(24,2)")
    zero = F.lit(0).cast("decimal(24,2)")
    own = F.transform(months, lambda m: F.struct(m["hours"].alias("hours"), m["share"].alias("share"), (pooled * m["share"]).cast("decimal(24,6)").alias("pooled")))
    top = F.array_max(F.transform(own, lambda m: F.when(m["hours"] > 0, F.ceil(m["pooled"] / m["hours"]).cast("int")).otherwise(0)))

    def total(n: Column, rows: Column) -> Column:
        one = lambda m: money(n * reserved * m["share"]) + money(F.greatest(F.lit(0).cast("decimal(24,6)"), m["pooled"] - n * m["hours"]) * payg)
        return F.aggregate(rows, zero, lambda a, m: (a + one(m)).cast("decimal(24,2)"))

    def best(rows: Column) -> Column:
        tried = F.transform(F.sequence(F.lit(0), top), lambda n: F.struct(total(n, rows).alias("total"), n.alias("units")))
        least = F.array_min(tried)
        return F.struct(least["units"].alias("units"), least["total"].alias("total"), total(F.lit(0), rows).alias("elastic_only"))

    return F.when(top <= MOST_UNITS, F.element_at(F.transform(F.array(own), best), 1))


def pool_lines(lines: DataFrame, records: DataFrame) -> DataFrame:
    """line, units, units_monthly, rest_hours, rest_monthly, upfront, problem of lines in mode pool.

    lines also have term (a reserved one), pooled_hours, start (null: months of 730 hours). The rest hours are those above the units
    in a month, over calendar months their mean, to the cent.
    """
    found = _with_rate(find_records(lines, records)).withColumn("payg", F.col("record.payg"))
    months = F.coalesce(*[F.when(F.col("term") == t, F.lit(m)) for t, m in TERM_MONTHS.items()])
    found = found.withColumn("months", F.when(months.isNotNull(), month_parts(months, F.col("start"))))
    problem = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("months").isNull(), "no reserved term").when(F.col("rate").isNull() | F.col("payg").isNull(), "unreadable rate").when(F.col("rate") == 0, "no rate for the term").when(F.col("payg") <= 0, "no hourly rate").when(~V.is_hourly(F.col("record.unit")), "unit is not hourly")
    found = found.withColumn("problem", problem).withColumn("best", F.when(F.col("problem").isNull(), pool_optimum(F.col("months"), F.col("pooled_hours"), F.col("payg"), F.col("rate"))))
    n, dec = F.col("best.units"), "decimal(24,6)"
    rest = F.aggregate("months", F.lit(0).cast(dec), lambda a, m: (a + F.greatest(F.lit(0).cast(dec), (F.col("pooled_hours") * m["share"]).cast(dec) - n * m["hours"])).cast(dec))
    mean = F.round((rest / F.size("months")).cast("decimal(24,8)"), 2).cast("decimal(18,2)")
    rest = F.when(F.col("start").isNull(), F.greatest(F.lit(0).cast(dec), F.col("pooled_hours") - n * AVERAGE_HOURS).cast("decimal(18,6)")).otherwise(mean)
    found = found.withColumn("rest_hours", F.when(F.col("best").isNotNull(), rest.cast("decimal(18,6)")))
    upfront = F.when(F.col("term").startswith("RU") & F.col("best").isNotNull(), F.round(n * F.col("rate") * months, 2).cast("decimal(24,2)"))
    return found.select("line", n.alias("units"), F.round(n * F.col("rate"), 2).cast("decimal(24,2)").alias("units_monthly"), "rest_hours", F.round(F.col("rest_hours") * F.col("payg"), 2).cast("decimal(24,2)").alias("rest_monthly"), upfront.alias("upfront"), "problem")


def flavors(records: DataFrame) -> DataFrame:
    """class, flavor, vcpu, ram, payg, record_id: one row a flavor, with the rate of its open Linux record where it has one.

    records also have class, vcpu and ram (a text such as ``8 GiB``). Of several records the first id decides."""
    size = F.regexp_extract("ram", r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(GiB|GB|MiB|MB)?\s*$", 1)
    unit = F.lower(F.regexp_extract("ram", r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(GiB|GB|MiB|MB)?\s*$", 2))
    ram = F.when(size != "", size.cast("decimal(18,6)")) / F.when(unit.isin("mib", "mb"), 1024).otherwise(1)
    usable = records.withColumn("gib", ram.cast("decimal(18,6)")).where(F.col("gib").isNotNull() & (F.col("vcpu") > 0) & (F.coalesce("flavor", F.lit("")) != "") & F.col("class").isNotNull())
    linux = F.when(F.contains(F.lower(F.coalesce("os", F.lit(""))), F.lit("open linux")), F.col("payg"))
    first = F.struct(linux.isNull().alias("no_rate"), F.col("id").alias("record_id"), F.col("vcpu"), F.col("gib").alias("ram"), linux.alias("payg"))
    return usable.groupBy("class", "flavor").agg(F.min(first).alias("f")).select("class", "flavor", "f.vcpu", "f.ram", "f.payg", "f.record_id")


def map_machines(machines: DataFrame, flavors_: DataFrame, bin_vcpu: int = 4) -> DataFrame:
    """row, family, class, flavor, alternative, status of every machine: the nearest flavor that is not smaller on either side.

    machines: row, family, vcpu, ram, noted (boolean). Least vCPU first, then memory, then the open Linux rate, then the name. The
    flavors of a class are a price list (hundreds): each machine is joined with the distinct (vcpu, ram) answers of its class only,
    by equality on the class, and keeps one by aggregation.
    """
    of = lambda c, table: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])
    m = machines.withColumn("class", of(F.col("family"), V.FAMILIES)).withColumn("second", of(F.col("class"), V.ALTERNATIVE))
    asked = m.where("class <> 'manual' and vcpu is not null and ram is not null")
    need = asked.select("class", F.col("vcpu").alias("v"), F.col("ram").alias("g")).union(asked.where("second is not null").select("second", "vcpu", "ram")).distinct()
    key = F.struct(F.col("vcpu"), F.col("ram"), F.coalesce("payg", F.lit(1e9).cast("decimal(18,6)")).alias("payg"), F.col("flavor"))
    fit = need.join(flavors_, "class").where("vcpu >= v and ram >= g").groupBy("class", "v", "g").agg(F.min(key).alias("k")).select("class", "v", "g", F.col("k.flavor").alias("flavor"))
    one, two = fit.select(F.col("class").alias("c1"), F.col("v").alias("v1"), F.col("g").alias("g1"), "flavor"), fit.select(F.col("class").alias("c2"), F.col("v").alias("v2"), F.col("g").alias("g2"), F.col("flavor").alias("alternative"))
    out = m.join(one, (F.col("class") == F.col("c1")) & (F.col("vcpu") == F.col("v1")) & (F.col("ram") == F.col("g1")), "left").join(two, (F.col("second") == F.col("c2")) & (F.col("vcpu") == F.col("v2")) & (F.col("ram") == F.col("g2")), "left")
    missing = F.col("vcpu").isNull() | F.col("ram").isNull()
    status = F.when(F.col("class").isNull(), "needs-input").when(F.col("class") == "manual", "manual").when(missing, "needs-input").when(F.col("flavor").isNull(), "no-fit").when(F.col("family").isin(*V.FLAGGED) | F.col("noted"), "flag").otherwise("ok")
    return out.select("row", "family", "class", "flavor", F.when(F.col("flavor").isNotNull(), F.col("alternative")).alias("alternative"), status.alias("status"))


def top_lines(priced: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` biggest lines with their share of the monthly total, in percent."""
    priced_only = priced.where("monthly is not null")
    total = priced_only.agg(F.sum("monthly")).scalar()
    biggest = priced_only.orderBy(F.desc("monthly"), "line").limit(n).withColumn("total", total)
    return biggest.select(F.row_number().over(Window.orderBy(F.desc("monthly"), "line")).alias("place"), "line", "monthly", V.percent(F.col("monthly"), F.col("total")).alias("percent"))
