"""Fact files: header lines, ``---``, the statement, and perhaps a check block after another ``---``."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("id", "scope", "grade", "checked", "class", "source")
OPTIONAL = ("tags", "tried", "expires", "retired", "why", "tier", "needs")
GRADES = ("documented", "tested", "reported")
#: Days that a fact of a class stands: fixed values.
DAYS = {"price": 30, "limit": 90, "api": 180, "concept": 365}
FACT = "id string, scope string, grade string, checked date, expires date, class string, source string, tags array<string>, tried array<string>, retired date, why string, tier string, needs string, statement string, check map<string,string>, problem string"


class Malformed(ValueError):
    """A fact file that doesn't stand."""


def parse_block(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for n, line in enumerate(lines, 1):
        key, colon, value = line.partition(":")
        if not colon or not key.strip() or key.strip() in out:
            raise Malformed(f"check line {n}")
        out[key.strip()] = value.strip()
    return out


def parse(text: str) -> dict:
    """Strict: unknown, repeated or missing keys, a bad date or grade, or an empty statement are errors."""
    head, mark, rest = text.partition("\n---\n")
    if not mark:
        raise Malformed("no statement")
    statement, _, block = rest.partition("\n---\n")
    fields = parse_block([x for x in head.split("\n") if x.strip()])
    if unknown := fields.keys() - {*REQUIRED, *OPTIONAL}:
        raise Malformed(f"unknown key {min(unknown)}")
    if missing := [k for k in REQUIRED if not fields.get(k)]:
        raise Malformed(f"missing key {missing[0]}")
    if fields["grade"] not in GRADES or fields["class"] not in DAYS or not statement.strip():
        raise Malformed("grade, class or statement")
    out: dict = {**dict.fromkeys(OPTIONAL), **fields}
    for k in ("checked", "expires", "retired"):
        if out[k]:
            try:
                out[k] = datetime.date.fromisoformat(out[k])
            except ValueError as error:
                raise Malformed(k) from error
    out["expires"] = out["expires"] or out["checked"] + datetime.timedelta(DAYS[out["class"]])
    for k in ("tags", "tried"):
        out[k] = [x.strip() for x in (out[k] or "").split(",") if x.strip()]
    return out | {"statement": statement.strip(), "check": parse_block([x for x in block.split("\n") if x.strip()]), "problem": None}


def render(fact: dict) -> str:
    """The inverse of ``parse``."""
    lines = []
    for k in (*REQUIRED, *OPTIONAL):
        v = fact.get(k)
        if v:
            lines.append(f"{k}: {', '.join(v) if isinstance(v, (list, tuple)) else v}")
    block = "".join(f"\n{k}: {v}" for k, v in (fact.get("check") or {}).items())
    return "\n".join(lines) + "\n---\n" + fact["statement"] + ("\n---" + block if block else "")


def load(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """A row a file. FAILFAST raises at a malformed one, PERMISSIVE keeps it with its problem, DROPMALFORMED leaves it out."""
    names = [x.split()[0] for x in FACT.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for text in pdf["value"]:
                try:
                    rows.append(parse(text))
                except Malformed as error:
                    if mode == "FAILFAST":
                        raise
                    if mode == "PERMISSIVE":
                        rows.append({**dict.fromkeys(names), "problem": str(error)})
            yield pd.DataFrame(rows, columns=names)

    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).mapInPandas(read, FACT)
