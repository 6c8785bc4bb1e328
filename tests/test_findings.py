"""Odd inputs and plans that earlier rounds got wrong."""

import random

import duckdb
import numpy as np
import oracle
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.functions import checks, writing
from corvane.functions.text import name_key
from corvane.operators import factsearch, pricing, search
from corvane.plans import base, facts, registry, text  # noqa: F401  the modules add their queries
from corvane.plans import search as search_plans


def test_tells_of_whole_texts(spark, tmp_path):
    texts = ["`a, and b — c`", "see http://x.org/a—b, and c—d@e.org", "```\nx, or y\n```", "x, oré, andé, and_", "plain, and — so", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert oracle.same(base.writing_tells(spark, str(tmp_path)), con, registry.ORACLES["writing_tells"]) is None
    assert writing.tells(texts[0])["em_dash"] == 0 and writing.tells(texts[0], True)["em_dash"] == 1


def test_mentions_broadcast_the_register(spark):
    services = spark.createDataFrame([("Old Thing", ["Old Thing", "OTX"], False)], "name string, forms array<string>, offered boolean")
    found = checks.mentioned(spark.range(9).selectExpr("id", "'use the old-thing, OTX' AS text"), "id", services, name_key)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    at = [p for p in plan.split("\n") if "HashJoin" in p and "Inner" in p]
    assert len(at) == 2 and all("Broadcast" in p and "BuildRight" in p for p in at)
    assert found.count() == 9


def _widest(plan):
    """The most rows that a node of an executed plan gave out."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _widest(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _widest(plan.plan())
    rows, kids = plan.metrics().get("numOutputRows"), plan.children()
    return max([rows.get().value() if rows.isDefined() else 0, *[_widest(kids.apply(i)) for i in range(kids.size())]])


def test_records_of_one_flavor_do_not_multiply_lines(spark):
    dec = "cast(%s as decimal(18,6))"
    records = spark.range(400).selectExpr("'r' region", "concat('P', id) id", "'svc' service", "'F.1' flavor", "if(id = 7, 'Windows', 'Linux') os", "'h' unit", "'EUR' currency", "cast(null as string) tier_group", *[f"{dec % '1.5'} {t.lower()}" for t in pricing.TERMS])
    lines = spark.range(400).selectExpr("id line", "'SVC' service", "'' api", "'' id", "'r' region", "'f.1' flavor", "case id % 3 when 0 then 'windows' when 1 then 'linux' else 'bsd' end os", f"{dec % 2} quantity", f"{dec % 'null'} hours", "'PAYG' term")
    priced = pricing.price_lines(lines, records)
    got = {r.line: (r.record_id, r.problem) for r in priced.collect()}
    assert got == {i: (("P7", None), (None, "several records"), (None, "no such OS"))[i % 3] for i in range(400)}
    assert _widest(priced._jdf.queryExecution().executedPlan()) <= 800


def test_containment_compares_no_sequence_with_each(spark):
    rows = lambda name, *texts: spark.createDataFrame(list(enumerate(texts)), f"{name} long, text string").select(name, F.split("text", " ").alias("w"))
    inner = search.grams(rows("i", "a b c d a b c d a b c", "x y", "p q r s"), "i", 3)
    outer = search.grams(rows("d", "a b c d a b c", "q r s q r s", "none of it", ""), "d", 3)
    found = search.containment(inner, "i", outer, "d", 0.3)
    assert "array_distinct" not in found._jdf.queryExecution().analyzed().toString()
    assert {tuple(r) for r in found.collect()} == {(0, 0, 4, 1.0), (2, 1, 1, 0.5)}


def test_near_duplicates_in_blocks_make_no_row_for_a_shared_word(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(factsearch, "BLOCK_WORDS", (300, 300), raising=False)
    rng = random.Random(3)
    word = lambda n: "w" + "".join(chr(97 + int(x)) for x in str(n))
    texts = [[word(n) for n in rng.sample(range(60), rng.randint(1, 25))] for _ in range(120)]
    texts += [[*t[: rng.randint(1, len(t))], *[word(60 + rng.randrange(9)) for _ in range(rng.randint(0, 4))]] for t in texts for _ in range(2)]
    texts = [" ".join(t) for t in texts] + ["the of", "", None, None, texts[0][0], texts[0][0]]
    rows = [(i if i < 363 else 7, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]  # the last rows repeat an id
    spark.createDataFrame([*rows, (None, texts[1], "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = search_plans.fact_duplicates(spark, str(tmp_path))
    assert oracle.same(found, con, registry.ORACLES["fact_duplicates"]) is None
    n = found.count()
    assert n > 300 and _widest(found._jdf.queryExecution().executedPlan()) <= 4 * n


def _tables(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    return con


def test_ranking_pairs_no_document_with_each_query(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("Öl und ab bc cd de ef fg gh hi ij jk kl lm".split()) for _ in range(n))
    docs = [(i, "the " + prose(20)) for i in range(300)]
    items = [(f"i{i}", f"The {prose(12)}, {d[1][:60]}") for i, d in enumerate(docs[:40])]
    docs += [(7, docs[7][1]), (8, docs[8][1]), (8, docs[8][1]), (900, None), (901, ""), (902, "none of it"), (None, docs[3][1]), (903, items[5][1])]
    items += [("null", None), ("empty", ""), ("strange", "zz yy xx")]
    con = _tables(spark, str(tmp_path), docs, items)
    for name in ("ranked_search", "benchmark_containment", "retrieval_hits"):
        assert oracle.same(registry.QUERIES[name](spark, str(tmp_path)), con, registry.ORACLES[name]) is None
    words = lambda t, i: spark.read.parquet(f"{tmp_path}/{t}.parquet").dropDuplicates([i]).select(i, F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    found = search.ranked(words("benchmark", "item_id"), "item_id", words("documents", "doc_id"), "doc_id", 3)
    assert found.count() and len(found.collect()) >= 120
    assert _widest(found._jdf.queryExecution().executedPlan()) < 1000


def test_best_of_tiles_and_batches(monkeypatch):
    monkeypatch.setattr(search, "ROWS", 3)
    monkeypatch.setattr(search, "QUERIES", 2)
    rng = np.random.default_rng(2)
    words, top = list("abcdefgh"), 3
    asked = [sorted(rng.choice(8, rng.integers(1, 6), replace=False).tolist()) for _ in range(7)]
    query, word = (np.array(x) for x in zip(*[(k, i) for k, a in enumerate(asked) for i in a]))
    docs = [rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", "other", "more"], rng.integers(0, 7), replace=False).tolist() for _ in range(60)]
    ids, weight = rng.permutation(60), rng.integers(1, 4, 8).astype(float)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 13]), pa.array(docs[k : k + 13], pa.list_(pa.string()))], names=["d", "w"]) for k in range(0, 60, 13)]
    got = {}
    for batch in search._best(iter(batches), words, weight, (query, word, np.ones(len(word))), 7, top):
        for r in batch.to_pylist():
            got.setdefault(r["q"], []).append((r["score"], r["overlap"], r["d"]))
    for k, a in enumerate(asked):
        rows = []
        for i, w in zip(ids.tolist(), docs):
            both = [x for x in a if words[x] in w]
            if both:
                rows.append((round(sum(weight[both]) / sum(weight[a]), 6), round(len(both) / (len(a) + len(w) - len(both)), 6), i))
        rows = sorted(rows, key=lambda r: (-r[0], -r[1], r[2]))[:top]
        assert [tuple(round(x, 6) for x in r) for r in got[k]] == rows
