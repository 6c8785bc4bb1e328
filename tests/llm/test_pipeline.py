import corpus_pipeline


def test_stages(spark, sf_dir):
    from corvane.llm import common as C

    docs = C.read(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = C.written(stage(spark, docs, sf_dir), name)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert 0 < docs.count() < n


def test_near_dedup_stage_links_from_80_percent(spark):
    words = [f"w{i}" for i in range(54)]
    near = [*words[:25], "other", *words[26:]]  # 45 of 55 shingles: 0.818
    far = [*words[:10], "x", *words[11:25], "y", *words[26:40], "z", *words[41:]]  # 35 of 65
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()} == {1, 3}


def test_near_dedup_stage_keeps_one_row_of_each_component(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    near = {k: t.replace(f"{k}30", "other") for k, t in text.items()}
    found = [(1, text["a"]), (1, text["a"]), (2, near["a"]), (None, text["a"]), (None, near["a"])]
    found += [(None, text["b"]), (None, text["b"]), (None, near["b"]), (3, text["c"]), (3, text["d"]), (None, near["d"]), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, f"x{k}", "clash") for k, (i, t) in enumerate(found)], "doc_id long, text string, row string, id string").repartition(3)
    out = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "-")[:1]) for r in out.collect())
    assert got == [(0, "b"), (1, "a"), (3, "c"), (3, "d"), (4, "-"), (5, "-")]


def test_near_dedup_stage_over_the_corner_cases(spark, docs, rows):
    out = corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()
    texts = [r.text for r in out if r.text and len(r.text.split()) > 4]
    assert len(texts) == len(set(texts)) and {r.doc_id for r in out} >= {1, 2, 30} and sum(r.doc_id == 1 for r in out) == 1


def test_filters_over_the_corner_cases(spark, docs, no_docs, sf_dir):
    """Nulls, clashing names, repeated rows and empty tables: rows come back whole, or not at all."""
    from collections import Counter

    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.language_id, corpus_pipeline.suffix_array_dedup):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.where("block <> 'clash' or carried <> 'clash'").count() == 0
        assert not Counter(r.doc_id for r in out.collect()) - Counter(r.doc_id for r in docs.collect())
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert corpus_pipeline.minhash_near_dedup(spark, no_docs, sf_dir).count() == 0


def test_packing_carries_the_rows(spark, docs, rows, no_docs):
    out = corpus_pipeline.packing(spark, docs, "")
    assert out.columns[:6] == ["doc_id", "n_tokens", "bucket", "batch", "place", "padding"] and {"text", "lang", "source", "block"} <= set(out.columns)
    got = out.collect()
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.text or "") for r in got) == sorted(((-1 if i is None else i), t or "") for i, t in rows)
    assert len({(r.bucket, r.batch, r.place) for r in got}) == len(rows) and all(r.block == "clash" for r in got)
    assert corpus_pipeline.packing(spark, no_docs, "").count() == 0


def test_language_stage_keeps_what_it_learned_and_drops_the_rest(spark, sf_dir):
    from corvane.llm import common as C

    known = C.read(spark, sf_dir, "documents").where("length(text) > 300 and lang is not null")
    odd = spark.createDataFrame([(10**9, "qxzj wqkx zzxq jqwz " * 40, "en"), (10**9 + 1, "12 34 56", "en"), (10**9 + 2, None, "en")], "doc_id long, text string, lang string")
    out = corpus_pipeline.language_id(spark, known.select("doc_id", "text", "lang").unionByName(odd), sf_dir)
    assert out.where("doc_id >= 1000000000").count() == 0 and out.count() >= 0.98 * known.count()
