"""Four read-only tools over tables, with argument schemas: search of facts, check of a service, price lookup, calculator."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import calc
from corvane.functions import text as X
from corvane.operators import search

SHOWN = 20
TOOLS: dict[str, dict] = {
    "facts_search": {"query": {"type": "string", "required": True, "max": 500}, "tag": {"type": "string"}, "grade": {"type": "string", "enum": ["documented", "tested", "reported"]}},
    "service_check": {"name": {"type": "string", "required": True, "max": 100}},
    "price_find": {"query": {"type": "string", "required": True, "max": 200}, "region": {"type": "string"}, "service": {"type": "string"}},
    "calculate": {"expression": {"type": "string", "required": True, "max": 1000}},
}
_TYPES = {"string": str, "integer": int, "boolean": bool}


def problems(tool: str, args: Any) -> list[str]:
    """Why the arguments don't stand; nothing when they do."""
    if tool not in TOOLS:
        return [f"no tool {tool}"]
    if not isinstance(args, dict):
        return ["arguments are no object"]
    schema, out = TOOLS[tool], []
    out += [f"unknown argument {k}" for k in args if k not in schema]
    for name, rule in schema.items():
        if name not in args:
            out += [f"missing argument {name}"] if rule.get("required") else []
        elif not isinstance(args[name], _TYPES[rule["type"]]):
            out.append(f"{name} is no {rule['type']}")
        elif "enum" in rule and args[name] not in rule["enum"]:
            out.append(f"{name} is none of {', '.join(rule['enum'])}")
        elif len(str(args[name])) > rule.get("max", 1 << 30):
            out.append(f"{name} is too long")
    return out


class Dataset:
    """facts (id, statement, tags, grade, checked, expires), services (name, offered), prices (id, service, region, name, price)."""

    def __init__(self, facts: DataFrame, services: DataFrame, prices: DataFrame):
        self.facts, self.services, self.prices = facts, services, prices
        self.spark = facts.sparkSession

    def facts_search(self, query: str, tag: str | None = None, grade: str | None = None) -> DataFrame:
        """Filters come before the ranking, so document frequencies are those of the rows left."""
        rows = self.facts
        if tag is not None:
            rows = rows.where(F.array_contains("tags", tag))
        if grade is not None:
            rows = rows.where(F.col("grade") == grade)
        asked = self.spark.createDataFrame([(0, query)], "q long, text string").select("q", F.array_distinct(X.words(F.col("text"))).alias("w"))
        hits = search.ranked(asked, "q", rows.select("id", F.array_distinct(X.words(F.col("statement"))).alias("w")), "id", SHOWN)
        out = hits.join(rows, "id").withColumn("expired", F.col("expires") < F.current_date())
        return out.select("rank", "id", "statement", "grade", "score", "expired").orderBy("rank")

    def service_check(self, name: str) -> DataFrame:
        """By the exact key, else by containment of the keys, else unclear."""
        key = self.spark.createDataFrame([(name,)], "asked string").select("asked", X.name_key(F.col("asked")).alias("k"))
        listed = self.services.select("name", "offered", X.name_key(F.col("name")).alias("key"))
        near = listed.join(F.broadcast(key), F.contains("key", F.col("k")) | F.contains("k", F.col("key")))
        best = near.withColumn("exact", F.col("key") == F.col("k")).agg(F.max(F.struct("exact", "offered", "name")).alias("b"))
        verdict = F.when(F.col("b").isNull(), "unclear").when(~F.col("b.exact"), "unclear").when(F.col("b.offered"), "offered").otherwise("not offered")
        return best.select(F.lit(name).alias("asked"), verdict.alias("verdict"), F.col("b.name").alias("nearest"))

    def price_find(self, query: str, region: str | None = None, service: str | None = None) -> DataFrame:
        """Every word of the query is in the id, service or name."""
        rows = self.prices
        for column, value in (("region", region), ("service", service)):
            if value is not None:
                rows = rows.where(F.lower(column) == value.lower())
        hay = F.lower(F.concat_ws(" ", "id", "service", "name"))
        for word in query.lower().split():
            rows = rows.where(hay.contains(word))
        return rows.orderBy("service", "name", "id").limit(SHOWN)

    def call(self, tool: str, args: dict) -> list[dict]:
        """Rows of an answer: ``SHOWN`` at most, so they may reach the driver."""
        if found := problems(tool, args):
            return [{"error": "; ".join(found)}]
        if tool == "calculate":
            try:
                value: Decimal = calc.evaluate(args["expression"])
            except calc.Refused as error:
                return [{"error": f"refused: {error}"}]
            return [{"value": f"{value.normalize() if value else Decimal(0):f}"}]
        return [r.asDict() for r in getattr(self, tool)(**args).limit(SHOWN).collect()]

    def handle(self, line: str) -> str:
        """One JSON line in, one out."""
        try:
            message = json.loads(line)
            tool, args = message["tool"], message.get("arguments", {})
        except (ValueError, KeyError, TypeError):
            return json.dumps({"error": "no request"})
        return json.dumps({"id": message.get("id"), "rows": self.call(tool, args)}, default=str)
