"""The command line: ``python -m corvane.cli``. Exit codes: 0 done, 1 findings, 2 an error or an unknown state."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from corvane.functions import calc


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shown(df, out: str | None) -> int:
    if out:
        df.write.mode("errorifexists").parquet(out)
        return 0
    rows = df.limit(1000).toJSON().collect() if hasattr(df, "toJSON") else []
    print("\n".join(rows))
    return 0


def _run(args) -> int:
    from corvane.plans import activity, base, checks, facts, planted, pricing, registry, relational, resources, search, text, values  # noqa: F401

    if args.name not in registry.QUERIES:
        print("\n".join(sorted(registry.QUERIES)))
        return 0 if args.name == "list" else 2
    return _shown(registry.QUERIES[args.name](_session(), args.data), args.out)


def _calc(args) -> int:
    try:
        value = calc.evaluate(args.expression, calc.bind(args.let))
        print(calc.plain(value, args.places))
    except calc.Refused as error:
        print(f"refused: {error}", file=sys.stderr)
        return 2
    return 0


def _find(args) -> int:
    from pyspark.sql import functions as F

    from corvane.operators import factsearch
    from corvane.sources import lists

    spark = _session()
    facts = lists.facts(spark, args.facts).withColumn("checked", F.try_to_date("checked", "yyyy-MM-dd"))
    synonyms = lists.synonyms(spark, args.synonyms) if args.synonyms else None
    asked = spark.createDataFrame([(0, args.question)], "question_id int, question string")
    found = factsearch.search(asked, facts, synonyms, args.top).join(facts.select("id", "statement", "source", "checked"), "id").orderBy("rank")
    return _shown(found, args.out)


def _price(args) -> int:
    from corvane.operators import pricing

    spark = _session()
    priced = pricing.price_lines(spark.read.parquet(args.lines), spark.read.parquet(args.records))
    _shown(priced, args.out)
    return 1 if priced.where("problem is not null").limit(1).count() else 0


def _log(args) -> int:
    from corvane.operators import activity

    entries = activity.load_log(_session(), args.log, args.start, args.end)
    return _shown(activity.by_key(entries, args.by).orderBy("grp", "place"), args.out)


def _check(args) -> int:
    from corvane.functions import patterns, secrets, writing

    with open(args.file, encoding="utf-8") as f:
        text = f.read()
    found = {"spans": patterns.find(text), "secrets": secrets.spans(text), "tells": {k: n for k, n in writing.tells(text).items() if n}, "claims": writing.claims(text)}
    print(json.dumps(found, ensure_ascii=False))
    return 1 if found["spans"] or found["secrets"] or found["tells"] else 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane", description=__doc__)
    every = top.add_subparsers(required=True)

    def command(name: str, function, *options: tuple) -> None:
        p = every.add_parser(name)
        for flags, more in options:
            p.add_argument(*flags, **more)
        p.set_defaults(function=function)

    out = (("--out",), {})
    command("run", _run, (("name",), {}), (("--data",), {"default": "."}), out)
    command("calc", _calc, (("expression",), {}), (("--let",), {"action": "append", "default": []}), (("--places",), {"type": int}))
    command("find", _find, (("question",), {}), (("--facts",), {"required": True}), (("--synonyms",), {}), (("--top",), {"type": int, "default": 5}), out)
    command("price", _price, (("--lines",), {"required": True}), (("--records",), {"required": True}), out)
    command("log", _log, (("--log",), {"required": True}), (("--by",), {"default": "project", "choices": ["customer", "project", "kind", "tech"]}), (("--start",), {}), (("--end",), {}), out)
    command("check", _check, (("file",), {}))
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.function(args)


if __name__ == "__main__":
    sys.exit(main())
