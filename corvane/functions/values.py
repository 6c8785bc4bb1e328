"""Values read from texts: numbers, dates, times, versions, sizes of machines, names and codes. Spark's own functions only; what
cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import let

# The accepted forms, the words that end a file name, the machine families with their classes, the kinds of codes.
NUMBER = r"^-?(?:\d+(?:\.\d+)?|[1-9]\d{0,2}(?:,\d{3})+\.\d+)$"
LAST_WORDS = ("kopie", "copy", "final", "neu", "new", "alt", "old", "draft", "entwurf")
FAMILIES = {
    "A": "general", "B": "general", "D": "general-dedicated", "DS": "general-dedicated", "DC": "manual", "F": "general-dedicated", "FX": "memory", "E": "memory", "EC": "manual", "M": "large-memory", "L": "disk-intensive",
    "NC": "manual", "ND": "manual", "NG": "manual", "NV": "manual", "NP": "manual", "HB": "manual", "HC": "manual", "HX": "manual",
}
#: Families whose mapping needs a second look, and classes with a second choice.
FLAGGED, ALTERNATIVE = ("B", "DC", "FX", "EC", "M", "L", "NC", "ND", "NG", "NV", "NP", "HB", "HC", "HX"), {"general-dedicated": "general"}
SIZE = r"(?i)^(?:standard_|basic_)?([A-Z]{1,3}?)([0-9]{1,3})(?:-([0-9]{1,3}))?([a-z]*)(?:_([A-Za-z0-9_]*))?$"
ENTITY_KINDS = ("CUST", "PART", "ORG", "PERS", "DOM", "SITE", "REF")
DATA_KINDS = ("MAIL", "URL", "IP", "MAC", "IBAN", "BIC", "VAT", "PHONE", "HRB", "TAX")
CODE = rf"(?:{'|'.join(ENTITY_KINDS + DATA_KINDS)})-[A-Z2-7]{{4}}(?:-(?:{'|'.join(ENTITY_KINDS)})-\d{{1,3}})?"
TAG = r"^[a-z0-9][a-z0-9.+-]{0,47}$"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def number(text: Column) -> Column:
    """``0.085``, ``12``, ``1,234.56``, ``12 EUR``, ``EUR 12``. A comma counts only as a thousands mark beside a decimal point,
    since ``1,085`` alone could be read two ways."""
    bare = F.trim(text)
    for mark in ("EUR", "€"):
        bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, f"{mark}$", "")), f"^{mark}", ""))
    return let(bare, lambda t: F.when(t.rlike(NUMBER), F.replace(t, F.lit(","), F.lit("")).cast("decimal(38,12)")))


def percent(part: Column, whole: Column) -> Column:
    """The part of the whole in percent, one place, half up; null for a whole of zero."""
    return F.when(whole != 0, F.round(part.cast("decimal(24,6)") * 100 / whole.cast("decimal(24,6)"), 1))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def utc_text(text: Column) -> Column:
    """A time with or without a zone (then UTC) as ``2026-10-03T07:58:12Z``; empty when it cannot be read."""
    zoned = F.regexp_replace(F.trim(text), r"(?<=[0-9])Z$", "+00:00")
    zoned = F.when(zoned.rlike(r"(?:[+-][0-9]{2}:[0-9]{2})$"), zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?[+-][0-9]{2}:[0-9]{2}$"
    time = F.to_utc_timestamp(F.try_to_timestamp(zoned), F.current_timezone())
    return F.coalesce(F.when(zoned.rlike(form), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit(""))


def age_days(created: Column, today: Column) -> Column:
    return F.date_diff(today, iso_date(F.substring(created, 1, 10)))


def plain(text: Column) -> Column:
    """Long dashes become commas, a comma before "and" or "or" goes, runs of blanks become one."""
    t = F.regexp_replace(text, "\\s*\u2014\\s*|\\s+\u2013\\s+", ", ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i),\s*(?=(?:and|or)\b)", " "), "[ \t]{2,}", " ")
    t = F.replace(F.replace(t, F.lit(" ,"), F.lit(",")), F.lit(",,"), F.lit(","))
    return F.regexp_replace(F.regexp_replace(t, r"^[\s]*,*\s*|\s+$", ""), r"\s*,*$", "")


def norm(text: Column) -> Column:
    """A name for comparing: lower case, ligatures undone, everything but letters and digits a blank."""
    t = F.replace(F.replace(text, F.lit("\ufb01"), F.lit("fi")), F.lit("\ufb02"), F.lit("fl"))
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def stem_of_name(stem: Column) -> Column:
    """A file's stem without its copy mark, dates, and the version and state words at its end, but never without any word."""
    t = F.lower(F.regexp_replace(F.trim(stem), r"\s*\(\d+\)$", ""))
    t = F.regexp_replace(t, r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{2}\.\d{2}\.\d{4})(?!\d)", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s._-]+", "-"), "^-|-$", "")
    return F.regexp_replace(t, rf"(?<=[^-])(?:-(?:{'|'.join(LAST_WORDS)}|v[1-9][0-9]?))+$", "")


def group_of_file(project: Column, path: Column, suffix: Column) -> Column:
    """``project/stem.suffix`` of a path; withheld paths stay withheld."""
    name = F.element_at(F.split(path, "/"), -1)
    bare = F.when((suffix != "") & F.endswith(F.lower(name), suffix), F.substring(name, F.lit(1), F.length(name) - F.length(suffix))).otherwise(name)
    stem = F.coalesce(_or_null(stem_of_name(bare)), F.lit("-"))
    return F.when(path == "[withheld]", path).otherwise(F.concat(F.coalesce(_or_null(project), F.lit("-")), F.lit("/"), stem, suffix))


def version_key(text: Column) -> Column:
    """``v3.12`` as (3, 12), ``v3`` as (3, 0), anything else as (0, 0): a struct that sorts."""
    form = r"^v([1-9][0-9]{0,3})(?:\.([1-9][0-9]{0,3}))?$"
    part = lambda k: F.coalesce(_or_null(F.regexp_extract(text, form, k)).cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"))


def is_hourly(unit: Column) -> Column:
    return F.coalesce(unit.rlike("(?:^|/)h(?:/zone)?$"), F.lit(False))


def is_gpu(flavor: Column, name: Column) -> Column:
    """The families g and p by name, or GPU in the name of the record."""
    family = F.lower(F.substring_index(F.coalesce(flavor, F.lit("")), ".", 1))
    return family.rlike(r"^(?:g|p|pi)\d+[a-z]*$") | F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("gpu"))


def os_tier(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    suse = t.rlike("suse|sles")
    return F.when(t.contains("windows"), "windows").when(t.rlike("red hat|rhel"), "red hat").when(t.contains("sap") & suse, "suse for sap").when(suse, "suse linux").when(t.contains("oracle"), "oracle linux").otherwise("open linux")


def machine_size(text: Column) -> Column:
    """family, vcpu, constrained, arm of a size name; null where it is none. The early D and DS sizes count by size, so no vcpu."""
    t = F.trim(text)
    at = lambda k: F.regexp_extract(t, SIZE, k)
    letters = F.upper(at(1))
    by_length = sorted(FAMILIES, key=lambda f: (-len(f), f))
    family = F.coalesce(*[F.when(F.startswith(letters, F.lit(f)) & (F.length(letters) - len(f) <= 1), F.lit(f)) for f in by_length])
    version = _or_null(F.regexp_extract(at(5), r"(?i)(?:^|_)v([0-9]+)$", 1)).cast("int")
    early = family.isin("D", "DS") & (F.coalesce(version, F.lit(0)) < 3)
    whole = F.struct(family.alias("family"), F.when(~early, _or_null(at(2)).cast("int")).alias("vcpu"), F.when(~early, _or_null(at(3)).cast("int")).alias("constrained"), (~early & at(4).contains("p")).alias("arm"))
    return F.when(t.rlike(SIZE) & family.isNotNull(), whole)


def is_code(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^(?:{CODE})$"), F.lit(False))


def kind_of_code(code: Column) -> Column:
    return F.substring_index(code, "-", 1)


_DASHES = "[\u2010-\u2015\u2043\u2212\u2e3a\u2e3b\ufe58\ufe63\uff0d\u058a\u05be\u1806\u2e17\u2e1a\u301c\u3030\u30a0\ufe31\ufe32]"


def folded_for_codes(text: Column) -> Column:
    """A text as codes are read in it: fullwidth forms as ASCII, format characters gone, every dash a hyphen."""
    wide = "".join(map(chr, range(0xFF10, 0xFF1A))) + "".join(map(chr, range(0xFF21, 0xFF3B))) + "".join(map(chr, range(0xFF41, 0xFF5B)))
    narrow = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    t = F.translate(F.coalesce(text, F.lit("")), wide, narrow)
    return F.regexp_replace(F.regexp_replace(t, r"\p{Cf}", ""), _DASHES, "-")


def count_codes(text: Column, prefixes: tuple[str, ...] = ("tcp", "hcs")) -> Column:
    """n_register, n_project: codes in a text, as it stands or folded, whichever shows more."""
    found = lambda t, p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    register, project = rf"\b{CODE}\b", rf"\b(?:{'|'.join(prefixes)})-[a-z2-7]{{4}}\b"
    plain_text = F.coalesce(text, F.lit(""))
    return let(folded_for_codes(text), lambda f: F.struct(F.greatest(found(plain_text, register), found(f, register)).alias("n_register"), F.greatest(found(plain_text, project), found(f, project)).alias("n_project")))


def clean_tags(tags: Column) -> Column:
    """Tags of an array of texts: comma lists split, lower case, no repeats; null if one of them is no tag."""
    parts = F.flatten(F.transform(tags, lambda t: F.transform(F.split(t, ","), lambda p: F.lower(F.trim(p)))))
    return let(F.array_distinct(F.filter(parts, lambda p: p != "")), lambda out: F.when(F.forall(out, lambda p: p.rlike(TAG)), out))


def salted_hash(salt: Column, text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat(salt, F.lit("\0"), text).cast("binary"), 256), 1, length)
