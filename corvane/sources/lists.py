"""Readers of the small files around a corpus: fact releases, question sets, synonyms, tag lists, service catalogs, registers, price
sheets, snapshots, word lists, inventories, event lines, candidate reports. Each gives a DataFrame; lines are parsed by Spark.

Files of lines keep their order in ``line`` (from 1) where it matters. Where a header is part of a format, another header ends the
read with an error. A missing file is an error here: the caller decides whether it may be missing.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import content
from corvane.functions import values as V

FACT = "id string, statement string, scope string, grade string, checked string, class string, expires string, tags array<string>, source string, level string"
QUESTIONS = "array<struct<question:string,accept:array<string>>>"
#: The columns of a price sheet, of a catalog line and of a register, and the words of a class.
SHEET_COLUMNS = ("id", "service", "flavor", "os", "region", "term", "unit_price", "quantity", "hours", "total", "source", "date")
CATALOG_COLUMNS = ("number", "name", "area", "status", "aliases", "ends", "end_kind")
REGISTER_COLUMNS = ("code", "kind", "form", "added", "status")


class Unreadable(ValueError):
    """A file that is not what its format asks for."""


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text: the lines of every file, in order. A file is one row first, so these files are small ones."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    rows = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("k", "text"))
    return rows.select("file", (F.col("k") + 1).alias("line"), "text")


def _texts_of_zips(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for raw in batch.column("content").to_pylist():
            if raw[:4] != b"PK\x03\x04":
                out.append(raw.decode("utf-8"))
                continue
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                named = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == "facts.jsonl"]
                if len(named) != 1:
                    raise Unreadable(f"the archive holds {len(named)} files of facts, not one")
                out.append(z.read(named[0]).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "text"])


def fact_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, record, meta, broken of releases as JSON lines, plain or as the one such file of an archive. The first object
    without an id, before all others, describes the release; a line that is no object has a null record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_texts_of_zips, "path string, text string")
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("k", "text")).where(F.trim("text") != "")
    is_object = F.coalesce(F.trim("text").startswith("{") & F.get_json_object("text", "$").isNotNull(), F.lit(False))
    lines = lines.select("file", (F.col("k") + 1).alias("line"), "text", is_object.alias("object"))
    first = lines.groupBy("file").agg(F.min("line").alias("first"))
    has_id = F.get_json_object("text", "$.id").isNotNull()
    lines = lines.join(first, "file").withColumn("meta", F.col("object") & ~has_id & (F.col("line") == F.col("first")))
    record = F.when(F.col("object") & ~F.col("meta"), F.from_json("text", FACT))
    return lines.select("file", "line", record.alias("record"), F.when(F.col("meta"), F.from_json("text", "map<string,string>")).alias("meta"), (~F.col("object")).alias("broken"))


def facts(spark: SparkSession, path: str) -> DataFrame:
    """The records of releases, and the release's date where its first line gives one."""
    rows = fact_lines(spark, path)
    release = rows.where("meta is not null").groupBy("file").agg(F.max(F.col("meta")["date"]).alias("release"))
    return rows.where("record is not null").join(release, "file", "left").select("record.*", "release")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question, accept: a JSON list of questions with the ids that answer them, or an object that has it under ``questions``."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("text"))
    listed = F.when(F.startswith(F.col("text"), F.lit("[")), F.col("text")).otherwise(F.get_json_object("text", "$.questions"))
    parsed = F.from_json(listed, QUESTIONS)
    bad = parsed.isNull() | F.exists(parsed, lambda q: q["question"].isNull() | q["accept"].isNull())
    checked = F.when(bad, F.raise_error(F.lit("the file holds no list of questions")).cast(QUESTIONS)).otherwise(parsed)
    return whole.select(F.explode(checked).alias("q")).select("q.question", "q.accept")


def bare_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text without comments behind ``#`` and without empty lines."""
    return numbered(spark, path).select("file", "line", F.trim(F.regexp_replace("text", "#.*$", "")).alias("text")).where("text <> ''")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """grp, term: a group a line, terms between commas; a group of fewer than two terms with content words is none."""
    rows = bare_lines(spark, path).select(F.concat_ws(":", F.regexp_extract("file", "[^/]+$", 0), "line").alias("grp"), F.explode(F.split("text", ",")).alias("term"))
    rows = rows.select("grp", F.trim("term").alias("term")).where((F.col("term") != "") & (F.size(content.words(F.col("term"))) > 0))
    return rows.join(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp"), "grp", "left_semi")


def tags(spark: SparkSession, path: str) -> DataFrame:
    """tag: the controlled list, each once."""
    return numbered(spark, path).select(F.trim("text").alias("tag")).where("tag <> '' and tag not like '#%'").distinct()


def _cells(mark: str, columns: tuple[str, ...]) -> list[Column]:
    parts = F.split("text", mark, -1)
    return [F.coalesce(F.get(parts, k), F.lit("")).alias(c) for k, c in enumerate(columns)]


def tsv(spark: SparkSession, path: str, columns: tuple[str, ...], strict: bool = True) -> DataFrame:
    """line and the columns of tab-separated files with this header. strict: another header, a byte order mark, a blank line or a row
    of another width ends the read; else rows are filled up and cut."""
    rows = numbered(spark, path)
    width = F.size(F.split("text", "\t", -1))
    wrong = (F.col("line") == 1) & (F.col("text") != "\t".join(columns)) | (F.col("line") > 1) & (width != len(columns))
    if strict:
        # the number of the line is what raises, so that the filter below meets every line
        rows = rows.withColumn("line", F.when(wrong, F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" is not of the format"))).cast("int")).otherwise(F.col("line")))
    return rows.where("line > 1 and text is not null and trim(text) <> ''").select("line", *_cells("\t", columns))


def register(spark: SparkSession, path: str) -> DataFrame:
    """code, kind, form, added, status of a register of names; codes of another form than the grammar end the read."""
    rows = tsv(spark, path, REGISTER_COLUMNS)
    code = F.when(V.is_code(F.col("code")) & (V.kind_of_code(F.col("code")) == F.col("kind")), F.col("code")).otherwise(F.raise_error(F.lit("a code is not of the grammar")).cast("string"))
    return rows.withColumn("code", code)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """number, name, area, status, aliases (array), ends, end_kind, revision: a service a line, comments with the revision."""
    rows = numbered(spark, path)
    revision = rows.where("text like '#%'").select(F.regexp_extract("text", r"revision (\d{4}-\d{2}-\d{2})", 1).alias("r")).where("r <> ''").agg(F.max("r")).scalar()
    rows = rows.where("text not like '#%' and trim(text) <> ''").select(*_cells("\t", CATALOG_COLUMNS))
    aliases = F.filter(F.transform(F.split("aliases", r"\|"), lambda x: F.trim(x)), lambda a: a != "")
    return rows.withColumn("aliases", aliases).withColumn("revision", F.coalesce(revision, F.lit("")))


def listed_services(spark: SparkSession, path: str) -> DataFrame:
    """name, forms (array), offered, status, ends: a Markdown list of services, with a section of those that are not offered."""
    rows = numbered(spark, path)
    heads = rows.where("text like '## %'").select("file", F.col("line").alias("at"), F.lower("text").contains("not offered").alias("gone"))
    above = F.when(F.col("at") < F.col("line"), F.col("at"))
    last = rows.where("text like '- %'").join(heads, "file", "left").groupBy("file", "line", "text").agg(F.max_by("gone", above).alias("gone"))
    gone = F.coalesce("gone", F.lit(False))
    form = r"^- (?:\S+ )(.+?)(?: \(([^()]*)\))?(?:, (optional|preview))?(?:; (.+))?$"
    gone_form = r"^- (.+?)(?: \(([^()]*)\))?$"
    part = lambda k: F.regexp_extract("text", form, k)
    name = F.when(gone, F.regexp_extract("text", gone_form, 1)).otherwise(part(1))
    group = F.when(gone, F.regexp_extract("text", gone_form, 2)).otherwise(part(2))
    other = F.filter(F.transform(F.split(group, ","), lambda x: F.trim(x)), lambda a: a != "")
    former = F.transform(F.filter(other, lambda a: F.lower(a).startswith("former ")), lambda a: F.substring(a, 8, 1000))
    whole = F.when(group != "", F.array(F.concat(name, F.lit(" ("), group, F.lit(")")))).otherwise(F.array().cast("array<string>"))
    status = F.when(gone, "not offered").otherwise(F.coalesce(F.when(part(3) != "", part(3)), F.lit("offered")))
    return last.select(name.alias("name"), F.concat(F.array(name), other, former, whole).alias("forms"), (~gone).alias("offered"), status.alias("status"), F.when(gone, "").otherwise(part(4)).alias("ends")).where("name <> ''")


def price_sheet(spark: SparkSession, path: str) -> DataFrame:
    """line and the known columns of sheets with tabs, semicolons or commas, by their own header; empty rows and comments are skipped.

    A sheet without unit_price and quantity, or without an id or service and flavor, ends the read."""
    rows = numbered(spark, path)
    head = rows.where("line = 1").select("file", F.col("text").alias("head"))
    mark = F.when(F.col("head").contains("\t"), "\t").when(F.col("head").contains(";") & ~F.col("head").contains(","), ";").otherwise(",")
    rows = rows.where("line > 1").join(head, "file").withColumn("mark", mark)
    cells = lambda c: F.transform(F.when(F.col("mark") == "\t", F.split(c, "\t", -1)).when(F.col("mark") == ";", F.split(c, ";", -1)).otherwise(F.split(c, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))
    names = F.transform(cells(F.col("head")), lambda h: F.regexp_replace(F.lower(h), r"[\s-]+", "_"))
    rows = rows.select("line", cells(F.col("text")).alias("cells"), names.alias("names")).where(F.exists("cells", lambda c: c != "") & ~F.startswith(F.get("cells", F.lit(0)), F.lit("#")))
    lacking = lambda *c: ~F.array_contains("names", c[0]) if len(c) == 1 else ~(F.array_contains("names", c[0]) & F.array_contains("names", c[1]))
    bad = lacking("unit_price") | lacking("quantity") | (lacking("id") & lacking("service", "flavor"))
    value = lambda c: F.coalesce(F.get("cells", F.array_position("names", c).cast("int") - 1), F.lit(""))
    first = F.when(bad, F.raise_error(F.lit("the sheet has not the columns that it needs")).cast("int")).otherwise(F.col("line"))
    return rows.select(first.alias("line"), *[F.when(F.array_contains("names", c), value(c)).otherwise(F.lit("")).alias(c) for c in SHEET_COLUMNS])


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """day, data (JSON text): the snapshots of a folder by the day in their names; other files are left out."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([0-9]{4}-[0-9]{2}-[0-9]{2})\.json$", 1).alias("day"), F.col("value").alias("data"))
    return rows.where("day <> ''")


def latest_snapshot(spark: SparkSession, folder: str, on: str | None = None) -> DataFrame:
    """The newest snapshot, or the newest up to a day."""
    rows = snapshots(spark, folder)
    return (rows.where(F.col("day") <= on) if on else rows).orderBy(F.desc("day")).limit(1)


def snapshot_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a snapshot file, with its other fields as ``meta``; a file without records ends the read."""
    whole = spark.read.text(path, wholetext=True).select("value")
    rows = F.from_json(F.get_json_object("value", "$.records"), f"array<struct<{schema}>>")
    checked = F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, F.raise_error(F.lit("the snapshot holds no records")).cast(f"array<struct<{schema}>>")).otherwise(rows)
    meta = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: k != "records")
    return whole.select(meta.alias("meta"), F.explode(checked).alias("r")).select("r.*", "meta")


def word_list(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """word: entries of a counted list that stand in at least ``least`` files, lower case."""
    cells = F.split("text", "\t")
    rows = numbered(spark, path).where("text <> '' and text not like '#%'").select(F.lower(F.get(cells, F.lit(0))).alias("word"), F.expr("try_cast(get(split(text, '\t'), 1) as int)").alias("n"))
    return rows.where(F.col("n") >= least).select("word").distinct()


def plain_list(spark: SparkSession, path: str, fold: bool = True) -> DataFrame:
    """entry: a hand-written list, one a line, blanks inside collapsed."""
    entry = F.trim(F.regexp_replace("text", r"\s+", " "))
    return numbered(spark, path).select((F.lower(entry) if fold else entry).alias("entry")).where("entry <> '' and entry not like '#%'").distinct()


def candidates(spark: SparkSession, path: str, kept: DataFrame | None = None) -> DataFrame:
    """place, candidate: the second column of the table under "## Candidates" of a report, each once, in the order of the report.

    kept: entries (column ``entry``) that are decided already; they go."""
    rows = numbered(spark, path)
    heads = rows.where("text like '## %'").select("file", F.col("line").alias("at"), (F.trim("text") == "## Candidates").alias("inside"))
    body = rows.where("text like '|%' and text not like '| part id%' and text not like '| ---%'").join(heads, "file").where("at < line").groupBy("file", "line", "text").agg(F.max_by("inside", "at").alias("inside")).where("inside")
    cells = F.split(F.regexp_replace("text", r"^\||\|\s*$", ""), r"(?<!\\)\|")
    found = body.where(F.size(cells) == 2).select("line", F.trim(F.regexp_replace(F.get(cells, F.lit(1)), r"\\\|", "|")).alias("candidate")).where("candidate <> ''")
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Punct}]+", " "))
    once = found.withColumn("key", key(F.col("candidate"))).groupBy("key").agg(F.min("line").alias("place"), F.min_by("candidate", "line").alias("candidate"))
    if kept is not None:
        once = once.join(kept.select(key(F.col("entry")).alias("key")), "key", "left_anti")
    return once.select("place", "candidate")


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """t, ev, kind, id, project, eta, auto_end, outcome of the event lines of the right shape; others are skipped."""
    shape = "t string, ev string, kind string, id string, project string, eta string, auto_end boolean, outcome string"
    rows = spark.read.text(path).select(F.from_json("value", shape).alias("e"), F.json_object_keys("value").alias("keys"))
    start = F.array(*map(F.lit, ("t", "ev", "kind", "id", "project", "eta", "auto_end")))
    end = F.array(*map(F.lit, ("t", "ev", "kind", "id", "project", "outcome")))
    same = lambda a, b: F.array_sort(a) == F.array_sort(b)
    time = F.col("e.t").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    good = ((F.col("e.ev") == "start") & same(F.col("keys"), start) & F.col("e.auto_end").isNotNull()) | ((F.col("e.ev") == "end") & same(F.col("keys"), end) & F.col("e.outcome").isin("ok", "red", "stopped", "needs-you"))
    return rows.where(time & good).select("e.*")
