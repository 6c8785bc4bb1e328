"""The activity log: entries by week, reports by key, projects of a period with their block, counters that are added to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The days that count as recent, and the names that stand for nothing.
RECENT_DAYS, NONE = 30, "none"
ENTRY = "date date, kind string, project string, customer string, partner string, tags array<string>, done string, outcome string, deliverables array<string>, open array<string>, seq long"


def week_of(day: Column) -> Column:
    """The ISO week as ``2026-W53``, by the ISO year."""
    year = F.year(F.date_add(day, 3 - F.weekday(day)))
    return F.format_string("%04d-W%02d", year, F.weekofyear(day))


def inside(day: Column, start: Column | None, end: Column | None) -> Column:
    ok = day.isNotNull()
    if start is not None:
        ok = ok & (day >= start)
    return ok & (day <= end) if end is not None else ok


def write_log(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines in a folder a week."""
    entries.withColumn("week", week_of(F.col("date"))).write.mode("append").partitionBy("week").json(path)


def load_log(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The entries from ``start`` to ``end`` (inclusive). Whole weeks outside are not read: the week is a partition, and its name
    sorts as its days do. A line that is no entry, or that lies in the wrong week, ends the read with an error."""
    schema = T.StructType([*T.StructType.fromDDL(ENTRY).fields, T.StructField("week", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd").json(path)
    if start is not None:
        rows = rows.where(F.col("week") >= week_of(F.lit(start).cast("date")))
    if end is not None:
        rows = rows.where(F.col("week") <= week_of(F.lit(end).cast("date")))
    wrong = F.when(F.col("date").isNull() | (F.col("week") != week_of(F.col("date"))), F.raise_error(F.lit("an entry is not in the week of its file")).cast("date"))
    rows = rows.withColumn("date", F.coalesce(wrong, F.col("date")))
    return rows.where(inside(F.col("date"), F.lit(start).cast("date") if start else None, F.lit(end).cast("date") if end else None)).drop("week")


def by_key(entries: DataFrame, by: str) -> DataFrame:
    """grp, place, and the entry's columns: entries grouped by customer, project, kind or tech (each tag of an entry), newest first,
    the one written later first on a day. Rows are ranked in their group and month first, so a group with most entries spreads."""
    tags = F.when(F.size(F.array_distinct("tags")) > 0, F.array_distinct("tags")).otherwise(F.array(F.lit(NONE)))
    rows = entries.withColumn("grp", F.explode(tags)) if by == "tech" else entries.withColumn("grp", F.col(by))
    rows = rows.withColumn("month", F.trunc("date", "month"))
    before = Window.partitionBy("grp").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    months = rows.groupBy("grp", "month").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("grp", "month").orderBy(F.desc("date"), F.desc("seq")))
    return rows.withColumn("nth", nth).join(months, ["grp", "month"]).withColumn("place", F.col("nth") + F.col("ahead")).drop("nth", "ahead", "month")


def groups(entries: DataFrame, by: str) -> DataFrame:
    """grp, n_entries, newest, last (the group "none" stands last)."""
    rows = by_key(entries, by)
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n_entries"), F.max("date").alias("newest")).withColumn("last", F.col("grp") == NONE)


def counts_text(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, text: ``value n, value n`` by falling count, then by value."""
    by = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))
    return by.groupBy(key).agg(F.array_join(F.transform(order, lambda x: F.concat(x["v"], F.lit(" "), (-x["m"]).cast("string"))), ", ").alias("text"))


def block_of(kind: Column, customer: Column, state: Column, last: Column, end: Column) -> Column:
    """1: active and recent for a customer; 2: other work for a customer; 3: questions and work without one."""
    own = (kind == "query") | customer.isin("", NONE, "-")
    return F.when(own, 3).when((state == "active") & (last >= F.date_sub(end, RECENT_DAYS - 1)), 1).otherwise(2)


def gather(entries: DataFrame, projects: DataFrame, commits: DataFrame, calls: DataFrame, start: str | None, end: str) -> DataFrame:
    """A row for each project with activity in the period: block, first and last day, days by source, kinds and tags with counts,
    calls. entries as above; projects: project, customer, kind, state; commits and calls: project, day."""
    lo, hi = F.lit(start).cast("date") if start else None, F.lit(end).cast("date")
    e = entries.where(inside(F.col("date"), lo, hi))
    c = commits.where(inside(F.col("day"), lo, hi)).join(projects.select("project"), "project", "left_semi")
    days = e.select("project", F.col("date").alias("day"), F.lit(1).alias("log"), "customer").unionByName(c.select("project", "day", F.lit(0).alias("log"), F.lit(None).cast("string").alias("customer")))
    seen = days.groupBy("project").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.sum("log").alias("n_log"), F.sum(1 - F.col("log")).alias("n_commits"), F.max(F.when(F.col("customer") != NONE, F.col("customer"))).alias("said"))
    called = calls.where(inside(F.col("day"), lo, hi)).groupBy("project").agg(F.count(F.lit(1)).alias("n_calls"))
    kinds = counts_text(e, "project", "kind").withColumnRenamed("text", "kinds")
    tech = counts_text(e.select("project", F.explode("tags").alias("tag")), "project", "tag").withColumnRenamed("text", "tech")
    out = seen.join(projects, "project", "left").join(called, "project", "left").join(kinds, "project", "left").join(tech, "project", "left")
    customer, kind, state = F.coalesce("customer", "said", F.lit(NONE)), F.coalesce("kind", F.lit("-")), F.coalesce("state", F.lit("-"))
    block = block_of(kind, customer, state, F.col("last"), hi)
    return out.select("project", block.alias("block"), customer.alias("customer"), kind.alias("kind"), state.alias("state"), "first", "last", "n_log", "n_commits", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("kinds", F.lit("none")).alias("kinds"), F.coalesce("tech", F.lit("none")).alias("tech"))


def added(counts: DataFrame, more: DataFrame, keys: list[str], value: str) -> DataFrame:
    """An upsert of counters: the counts of both tables by key, added where a key is in both."""
    return counts.select(*keys, value).unionByName(more.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def resource_rows(text: Column) -> Column:
    """Data rows of the tables in a Markdown text: lines that begin with a bar, without the first and without rules."""
    lines = F.filter(F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")))
    data = F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~F.regexp_replace(x, r"[|\s:-]", "").eqNullSafe(F.lit("")))
    return F.size(data)
