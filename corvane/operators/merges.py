"""Merges and differences: keyed rows of three versions, change logs, claims with their evidence, inventories, releases."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import versions

ITEM = "week: string, section: string, item: string, nth: int, pos: int, raw: string"
_WEEK = re.compile(r"## Week ([0-9]{1,2}), ([0-9]{4})")


def merged_tests(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """key, merged, outcome, pos: rows of a keyed list from three versions, ours first, what only theirs has behind it.

    ours and theirs have ``pos``. A row that both sides changed differently, or added differently under one key, is a conflict."""
    found = versions.merge_three(base, ours, theirs, key, value)
    at = lambda rows, side: rows.select(key, F.struct(F.lit(side).alias("side"), "pos").alias("o"))
    order = at(ours, 0).unionByName(at(theirs, 1)).groupBy(key).agg(F.min("o").alias("o"))
    return found.join(order, key, "left").select(key, "merged", "outcome", "o.side", "o.pos")


def _parsed(text: str) -> list[dict]:
    week, section, blank, out, seen = "", "", [], [], {}
    for line in text.split("\n"):
        if line.startswith("## "):
            m = _WEEK.match(line)
            week, section, blank, seen = (f"{m.group(2)}-{int(m.group(1)):02d}" if m else line), "", [], {}
        elif line.startswith("### "):
            section, blank = line, []
        elif not line.strip():
            blank.append(line)
        elif out and line[:1] in " \t" and (out[-1]["week"], out[-1]["section"]) == (week, section):
            out[-1]["lines"] += [*blank, line]
            blank = []
        else:
            out.append({"week": week, "section": section, "lines": [*blank, line]})
            blank = []
    for pos, item in enumerate(out):
        lines = item.pop("lines")
        item["item"] = "\n".join(x.strip() for x in lines if x.strip())
        at = (item["week"], item["section"], item["item"])
        item["nth"] = seen[at] = seen.get(at, -1) + 1
        item["pos"], item["raw"] = pos, "\n".join(lines)
    return out


def _items(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("week", pa.string()), ("section", pa.string()), ("item", pa.string()), ("nth", pa.int32()), ("pos", pa.int32()), ("raw", pa.string())]))
    return pa.array([None if t is None else _parsed(t) for t in text.to_pylist()], kind)


def changelog_items(text: Column) -> Column:
    """The items of a change log: their week (year and number), section, text without blank lines, and which of equal ones it is."""
    return F.arrow_udf(_items, f"array<struct<{ITEM}>>")(text)


def merged_changelogs(logs: DataFrame) -> DataFrame:
    """log, week, section, item, outcome, in the order newest week first. logs: log, base, ours, theirs (texts).

    An item that one side dropped goes if the other left it alone; items that both added stand once."""
    keys = ["log", "week", "section", "item", "nth"]

    def side(name: str) -> DataFrame:
        rows = logs.select("log", F.explode(changelog_items(F.col(name))).alias("i")).select("log", "i.*")
        return rows.select(F.struct(*keys).alias("key"), "raw", "pos")

    b, o, t = side("base"), side("ours"), side("theirs")
    found = versions.merge_three(b, o, t, "key", "raw")
    place = o.select("key", F.col("pos").alias("p")).unionByName(t.select("key", (F.col("pos") + 1_000_000).alias("p"))).groupBy("key").agg(F.min("p").alias("p"))
    return found.join(place, "key").select("key.*", F.col("merged").alias("raw"), "outcome", F.row_number().over(Window.partitionBy("key.log").orderBy(F.desc("key.week"), "key.section", "p")).alias("place"))


def merged_claims(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """line, sentence, id, evidence, grade, verdict, kept of the fresh claims: a sentence listed before keeps what is known of it (the
    first of equal ones meets the first), others get numbers after the highest old one, in the order of their lines.

    fresh: line, sentence. old: number, line, sentence, evidence, grade, verdict."""
    nth = lambda: F.row_number().over(Window.partitionBy("sentence").orderBy("line"))
    a, b = fresh.withColumn("nth", nth()), old.withColumn("nth", nth()).drop("line")
    top = old.agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
    both = a.join(b, ["sentence", "nth"], "left").withColumn("top", top)
    fresh_rows = both.where("number is null").withColumn("part", F.floor(F.col("line") / 100_000))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    parts = fresh_rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = fresh_rows.join(parts, "part").withColumn("number", F.col("top") + F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("line")))
    columns = ["line", "sentence", F.concat(F.lit("C-"), F.col("number").cast("string")).alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("evidence", "grade", "verdict")]]
    return both.where("number is not null").select(*columns, F.lit(True).alias("kept")).unionByName(numbered.select(*columns, F.lit(False).alias("kept")))


def inventory(items: DataFrame, kind: str, item: str) -> DataFrame:
    """kind, n, digest: a count and a digest of the ids of each kind that does not depend on their order."""
    part = F.conv(F.substring(F.md5(F.col(item).cast("string").cast("binary")), 1, 8), 16, 10).cast("decimal(38,0)")
    return items.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("digest"))


def inventory_diff(before: DataFrame, after: DataFrame, unread: DataFrame) -> DataFrame:
    """kind, difference: what differs between two inventories, in counts only. unread: kinds that one side could not read."""
    a, b = (d.select("kind", F.col("n").alias(f"n_{s}"), F.col("digest").alias(f"d_{s}")) for d, s in ((before, "a"), (after, "b")))
    j = a.join(b, "kind", "full").join(unread.select("kind").distinct().withColumn("unread", F.lit(True)), "kind", "left")
    unknown = F.col("unread").isNotNull() | F.col("n_a").isNull() | F.col("n_b").isNull()
    more, fewer = F.greatest(F.col("n_b") - F.col("n_a"), F.lit(0)), F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0))
    text = F.when(unknown, "unknown").when(F.col("d_a") == F.col("d_b"), None).when(more + fewer > 0, F.format_string("+%d/-%d", more, fewer)).otherwise("other ids")
    return j.select("kind", text.alias("difference")).where("difference is not null")


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """path: added, gone, or with another digest."""
    return versions.diff(before, after, "path", ["digest"]).where("change <> 'same'").select("path", "change")


def release_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """id, change: added, amended (another statement or source) or retired between two releases."""
    change = F.when(F.col("change") == "added", "added").when(F.col("change") == "removed", "retired").when(F.col("change") == "changed", "amended")
    return versions.diff(previous, current, "id", ["statement", "source"]).select("id", change.alias("change")).where("change is not null")
