"""Graders of answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yes_no(answer: Column, expected: Column) -> Column:
    """The first yes or no equals the expected one."""
    return F.lower(F.regexp_extract(answer, "(?i)\\b(yes|no)\\b", 1)) == expected


def number(answer: Column, expected: Column, tolerance: Column) -> Column:
    """The first number within the tolerance; dates and identifiers such as AB-12 are taken out first."""
    bare = F.regexp_replace(F.regexp_replace(answer, "\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b", " "), "\\b[A-Z]+-[0-9]+\\b", " ")
    found = F.regexp_extract(bare, "-?[0-9]+(\\.[0-9]+)?", 0)
    return F.coalesce(F.abs(found.try_cast("decimal(18,6)") - expected) <= tolerance, F.lit(False))


def all_items(answer: Column, items: Column, forbidden: Column) -> Column:
    """All items as whole words and none of the forbidden."""
    has = lambda w: F.regexp(F.lower(answer), F.concat(F.lit("(^|[^a-z0-9])"), F.lower(w), F.lit("([^a-z0-9]|$)")))
    return F.forall(items, has) & ~F.exists(forbidden, has)


def cited(answer: Column, ids: Column) -> Column:
    return F.exists(ids, lambda i: F.contains(answer, i))


def abstained(answer: Column) -> Column:
    return answer.rlike("(?i)\\b(i do not know|i don't know|cannot say|no answer)\\b")
