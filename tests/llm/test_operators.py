"""Each operator against a brute-force version, on rows with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import bpe, fingerprints, hyperlang, minhash, packing, quality, sharding, substring, suffixarray, vafile
from corvane.llm import common as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_substring_dedup(docs, rows, no_docs):
    length, count = 35, Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        want[i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert Counter(tuple(r)[:4] for r in substring.substring_dedup(docs, n_blocks=5).collect()) == want
    assert substring.substring_dedup(no_docs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array(symbols):
    s = [*symbols, 0]
    assert suffixarray.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [32, 0])
def test_suffix_array_dedup(docs, rows, no_docs, hot, monkeypatch):
    monkeypatch.setattr(suffixarray, "HOT_BLOCKS", hot)
    last, length = 1 << 63, 50
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], last), last if i is None else i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (last if i is None else i):
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))] += 1
    assert Counter(tuple(r)[:5] for r in suffixarray.suffix_array_dedup(docs, n_blocks=5).collect()) == want
    assert suffixarray.suffix_array_dedup(no_docs).count() == 0


def test_seeds_across_steps(rows, monkeypatch):
    texts = [(t or "").encode() for _, t in rows]
    data, start = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = suffixarray.seeds_of(data, start)
    monkeypatch.setattr(suffixarray, "STEP", 37)
    assert all((a == b).all() for a, b in zip(want, suffixarray.seeds_of(data, start)))
    strings = [k for s, e in zip(start[:-1], start[1:]) for k in range(s, e - suffixarray.LENGTH + 1)]
    assert [k for a, z in zip(want[1], want[2]) for k in range(a, z + 1)] == strings
    seeds = C.runs_hash(C._TABLES[0][data], suffixarray.SEED) >> np.uint64(32)
    assert all(seeds[p] == seeds[k : k + suffixarray.SPAN].min() for p, a, z in zip(*want[:3]) for k in range(a, z + 1))


def test_only_pieces_that_may_share_a_string_are_sorted(monkeypatch):
    seen = []
    sort = suffixarray.suffix_array
    monkeypatch.setattr(suffixarray, "suffix_array", lambda s: seen.append(len(s)) or sort(s))
    rng = np.random.default_rng(3)
    records = np.zeros(40, suffixarray._RECORD)
    records["left"], records["right"] = rng.integers(97, 123, (40, 26)), rng.integers(97, 123, (40, 50))
    records["right"][:, :24] = records["right"][0, :24]  # one seed, other surroundings
    records["n_left"], records["n_right"] = 26, 50
    records[39] = records[0]
    records["left"][39, 5:] = 65  # strings with up to five bytes before the seed are shared

    def gone(rec):
        blob = suffixarray._packed(rec, np.arange(len(rec)))
        table = pa.table({"bucket": pa.array([0], pa.int32()), "block": pa.array([0], pa.int32()), "blob": [blob]})
        bits = suffixarray._decide(table).column("blob")[0].as_py()
        return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(rec), -1), axis=1, count=27)

    assert not gone(records[:39]).any() and not seen
    got = gone(records)
    assert got[39].tolist() == [1] * 6 + [0] * 21 and not got[:39].any() and 0 < max(seen) < 30


def test_rows_of_the_exchange_do_not_grow_with_the_square():
    small, large = (np.prod(suffixarray.sizes(n)) for n in (800 << 20, 10 << 30))
    assert suffixarray.sizes(100 << 20) == (50, 25)  # small inputs keep their blocks
    assert large / small < 12.8 * 1.1


def test_without_repeats_keeps_rows_whole(docs, rows):
    out = suffixarray.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = out.collect()
    assert all(r.block == "clash" and r.carried == "clash" for r in got)
    assert all(r.text is None or len(r.text) == r.n_chars for r in got)


def components(rows, percent=85):
    sets = defaultdict(list)
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        if i is not None:
            sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sets, {i: root(i) for i in ids}


@pytest.mark.parametrize("rounds", [3, 0])
def test_minhash(docs, rows, no_docs, rounds, monkeypatch):
    """rounds 0: everything goes through the tiles."""
    monkeypatch.setattr(minhash, "ROUNDS", max(rounds, 1))
    if not rounds:
        monkeypatch.setattr(minhash, "TILE", 2)
        monkeypatch.setattr(minhash, "verified", lambda pairs, sets, percent: pairs.limit(0))
    sets, comp = components(rows)
    got = minhash.minhash_near_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]} and r.component_id == comp[r.doc_id] and r.kept == (comp[r.doc_id] == r.doc_id)
    assert minhash.minhash_near_dedup(no_docs).count() == 0


def test_keep_one(docs, rows):
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    _, comp = components(rows)
    want = Counter(i for i, _ in rows if i is None or comp[i] == i)
    assert Counter(r.doc_id for r in out.collect()) == want


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900, dtype=np.int64).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 1 << 63, 200, dtype=np.int64).astype(np.uint64)])
    s = minhash.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 900]), 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1100) < 0.08


def test_sharding(docs, rows, no_docs):
    got = sharding.kd_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.kd_shards(no_docs).count() == 0


def test_sharding_near_equal_with_a_hot_source(spark):
    docs = spark.createDataFrame([(i, "w" * (50 + i * 37 % 400), "en", "hot" if i % 3 else f"s{i}") for i in range(4000)], "doc_id long, text string, lang string, source string")
    size = Counter()
    for r in sharding.kd_shards(docs).collect():
        size[r.shard] += r.size
    assert len(size) == 16 and max(size.values()) < 1.02 * min(size.values())


def test_packing(docs, rows, no_docs):
    got = packing.pack(docs, 4, 500).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(words(t))) for i, t in rows)
    place = Counter((r.bucket, r.batch, r.place) for r in got)
    assert max(place.values()) == 1 and all(r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens for r in got)
    for (bucket, _), n in Counter((r.bucket, r.batch) for r in got).items():
        assert n == 1 or n * bucket <= 500
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_bounds_are_optimal(hist, buckets):
    from itertools import combinations

    lengths = sorted(hist)
    cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())
    got = packing.best_bounds(np.array(lengths), np.array([hist[x] for x in lengths]), buckets)
    best = min(cost([*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
    assert len(got) <= buckets and cost(got) == best


@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 16])
def test_bounds_over_many_lengths_are_optimal(buckets):
    rng = np.random.default_rng(buckets)
    lengths = np.sort(rng.choice(6000, 150, replace=False))
    counts = rng.integers(1, 9, 150)
    best = np.r_[0, np.full(150, 1 << 60)]
    for _ in range(buckets):
        best = np.array([0, *[min(best[i] + int(((lengths[j - 1] - lengths[i:j]) * counts[i:j]).sum()) for i in range(j)) for j in range(1, 151)]])
    got = np.array(packing.best_bounds(lengths, counts, buckets))
    assert len(got) == buckets and int(((got[np.searchsorted(got, lengths)] - lengths) * counts).sum()) == best[-1]


def test_packing_is_optimal_over_long_texts(spark):
    from itertools import combinations

    hist = {1024: 3, 1027: 9, 1029: 1, 1031: 8, 1033: 1, 1038: 7, 1041: 2, 1100: 4}
    docs = spark.createDataFrame([(100 * k + i, "w " * x) for k, (x, n) in enumerate(hist.items()) for i in range(n)], "doc_id long, text string")
    cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())
    assert sum(r.padding for r in packing.pack(docs, 4).collect()) == min(cost([*c, 1100]) for c in combinations(sorted(hist)[:-1], 3))


def test_quality(docs, rows, no_docs, spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1, 60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.quality_scores(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in got)
    assert quality.quality_scores(no_docs, model).count() == 0 and quality.train(no_docs, labels).share == 0.5
    assert quality.keep_good(docs, model).count() == sum(r.predicted for r in got)


@pytest.mark.parametrize(("most", "rows"), [(quality.MOST, 6), (100, 3), (1, 1)])
def test_quality_learns_from_whole_texts(spark, most, rows, monkeypatch):
    ids = [i for i in range(30) if not held_out(i)][:6]
    docs = spark.createDataFrame([(i, "word " * 8192) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit", lambda bags, labels: [len(b) for b in bags])
    assert quality.train(docs, labels, most=most) == [40] * rows


def test_quality_held_out_accuracy(spark, sf_dir):
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.quality_scores(docs, quality.train(docs, labels)).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.9 * len(got)


def test_attention_gradient():
    rng = np.random.default_rng(2)
    model = quality.AttentionModel(np.zeros(5), np.ones(5))
    x, first, y, w = rng.normal(size=(7, 5)), np.array([0, 3, 4, 7]), np.array([1.0, 0, 1]), np.ones(3)
    loss = lambda: -np.mean(y * np.log(model.forward(x, first)["y"]) + (1 - y) * np.log(1 - model.forward(x, first)["y"]))
    g = model.gradient(x, first, y, w)
    for k, v in model.w.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_languages(docs, rows, no_docs):
    model = hyperlang.train(docs)
    got = hyperlang.languages(docs, model).collect()
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        if len(texts[r.doc_id]) == 1:
            (t,) = texts[r.doc_id]
            assert (r.lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))
        assert 0 <= r.score <= 1 and r.held_out == held_out(r.doc_id)
    assert hyperlang.languages(no_docs, model).count() == 0
    assert {r.lang_pred for r in hyperlang.languages(docs, hyperlang.train(no_docs)).collect()} == {"und"}


def test_language_held_out_accuracy(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in hyperlang.languages(docs, hyperlang.train(docs)).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)


def test_known_languages_are_kept_and_others_rejected(spark, sf_dir):
    import random

    docs = C.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model, rng = hyperlang.train(docs), random.Random(1)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    foreign = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
        "wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach są oni obdarzeni rozumem i sumieniem",
    ]
    bad = spark.createDataFrame([(k, None, t) for k, t in enumerate([*[noise(n) for n in (20, 30, 100, 1000)], *foreign, None, "12 34"])], docs.schema)
    assert hyperlang.keep_known(bad, model).count() == 0
    clean = docs.where("lang is not null and length(text) >= 100").where(quality.held_out(docs["doc_id"]))
    assert hyperlang.keep_known(clean, model).count() >= 0.98 * clean.count() > 0
    unlearned = hyperlang.train(docs.where("lang <> 'de'"))
    german = docs.where("lang = 'de' and length(text) >= 300")
    assert hyperlang.keep_known(german, unlearned).count() <= 0.1 * german.count()


def test_bpe(docs, rows, no_docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(exact.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.digest(bpe.encode_decode(docs, path)).collect()) == want
    assert bpe.encode_decode(no_docs, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=30))
def test_lexicon_is_exact_and_minimal(tmp_path_factory, found):
    listed = sorted(found)
    arrays = bpe.compile_lexicon(listed, [[k, k + 1] for k in range(len(listed))])
    path = str(tmp_path_factory.mktemp("lexicon") / "x.bin")
    bpe.Lexicon.write(arrays, path)
    lexicon = bpe.Lexicon(path)
    asked = [*listed, b"", b"not in it at all"]
    ends = np.cumsum([len(w) for w in asked])
    places = lexicon.places(np.frombuffer(b"".join(asked), np.uint8), ends - [len(w) for w in asked], ends)
    assert places.tolist() == [*range(len(listed)), -1, -1]
    assert [lexicon.ids[lexicon.out[k] : lexicon.out[k + 1]].tolist() for k in range(len(listed))] == [[k, k + 1] for k in range(len(listed))]
    suffixes = {frozenset(w[len(p) :] for w in listed if w.startswith(p)) for w in listed for p in (w[:i] for i in range(len(w) + 1))}
    assert len(arrays["ends"]) == max(1, len(suffixes))


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(130)]
    vectors += [(200, [1.0] * 8), (220, [1.0] * 8), (240, None), (260, [float("nan")] * 8), (280, [float("inf")] + [0.0] * 7), (300, [None] + [0.0] * 7), (320, [1.0] * 3), (None, [0.5] * 8)]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, rank string")
    usable = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in usable:
        if q % 20 == 0:
            best = sorted((-int(usable[q] @ x), i) for i, x in usable.items() if i != q)[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in vafile.exact_top_k(table).collect()} == want
    assert vafile.exact_top_k(table.limit(0)).count() == 0


def test_fingerprints(docs, rows, no_docs):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    unique = [x for x in rows if sum(i == x[0] for i, _ in rows) == 1]
    ordered = sorted(((i if i is not None else 1 << 63, t or "") for i, t in rows), key=lambda x: (-x[0], x[1]))
    at = {i: k for k, (i, _) in enumerate(ordered)}
    by = {r.doc_id: r for r in got}
    for i, t in unique:
        t, following = t or "", ordered[(at[i] + 1) % len(ordered)][1]
        half = len(t) // 2
        assert by[i].edited_sha256 == sha(t[: len(t) - half] + following[:half])
        assert 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
    prints = defaultdict(set)
    for i, t in unique:
        prints[t or ""].add(by[i].fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    assert by[40].near_next == pytest.approx(len(shingles(rows, 40) & shingles(rows, 33)) / len(shingles(rows, 40) | shingles(rows, 33)), abs=0.2)
    assert fingerprints.fingerprint_edits(no_docs).count() == 0


def shingles(rows, doc_id):
    w = words(next(t for i, t in rows if i == doc_id))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_sketch_algebra(spark):
    from pyspark.sql import functions as F

    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(200, 600))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"), fingerprints.sketch(F.concat_ws(" ", "a", "b")).alias("c"))
    r = df.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("in"), fingerprints.distinct_count(F.col("a")).alias("n"), fingerprints.merge(F.col("a"), F.col("b")).alias("m"), "c").head()
    assert abs(r.j - 196 / 596) < 0.2 and abs(r["in"] - 196 / 396) < 0.25 and 250 < r.n < 600
    parts = spark.createDataFrame([(1, [1, 5]), (1, [2, 5]), (2, [7])], "k int, s array<bigint>")
    assert {x.k: x.s for x in fingerprints.merge_parts(parts, ["k"], "s", 2).collect()} == {1: [1, 2], 2: [7]}


def test_pieces_encode_as_the_whole(tmp_path):
    import json
    import random

    import pyarrow as pa

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        merger = bpe.Merger(json.load(f))
    listed = sorted([b" bc", b"a", b" a", b" 12", b"bc!", " é".encode()])
    maker = bpe.Encoder(None, merger)
    bpe.Lexicon.write(bpe.compile_lexicon(listed, [maker.plain(w.decode()) for w in listed]), str(tmp_path / "x.bin"))
    encoder = bpe.Encoder(bpe.Lexicon(str(tmp_path / "x.bin")), merger, 20_000)
    exact, rng = Tokenizer.from_file(path), random.Random(1)
    parts = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\u2028", "\u205f", "\u1680", "\x1c", "a", "bc", "'s", "'ll", "12", "!", "..", "é", "漢", "—", "«", "🙂", "\r\n", "\x0b", "\x85", "X", "don't", "z" * 300, "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        got = bpe.encoded_batch(pa.table({"doc_id": pa.array(range(len(some)), pa.int64()), "text": some}), encoder)
        for text, ids, n, decoded in zip(some, got.column("ids").to_pylist(), got.column("n_tokens").to_pylist(), got.column("decoded").to_pylist()):
            want = exact.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, np.uint32).tolist() == want and n == len(want) and decoded == exact.decode(want, skip_special_tokens=False), text


def test_word_hashes_tell_structured_words_apart():
    """A Thue-Morse word and its complement collide in every polynomial hash modulo a power of two; words of one prefix differ."""
    import pyarrow as pa

    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    listed = [word, word.translate(str.maketrans("ab", "ba")), word[:256], word[:257], "x", "x\x00", "abcdefgh", "abcdefghi", "ABCDEFGH", *(f"w{i}" for i in range(5000))]
    block = C.Block(pa.table({"doc_id": [1], "text": [" ".join(listed)]}))
    starts, ends, first = C.words_of(block)
    assert first.tolist() == [0, len(listed)]
    for which in (0, 1):
        assert len(set(C.word_hashes(block, starts, ends, which).tolist())) == len(listed)
    lowered = C.word_hashes(block, starts, ends, lower=True)
    assert lowered[6] == lowered[8] and len(set(lowered.tolist())) == len(listed) - 1
    values = np.arange(60, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 5, 8, 35):
        got, want = C.windows_hash(values, size), [tuple(values[i : i + size].tolist()) for i in range(60 - size + 1)]
        assert len(got) == len(want) and len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_words_end_with_their_document():
    import pyarrow as pa

    texts = ["ab", "cd ", "", None, " e", "f\ng", "h"]
    block = C.Block(pa.table({"doc_id": pa.array(range(7), pa.int64()), "text": pa.array(texts, pa.string())}))
    starts, ends, first = C.words_of(block)
    data = block.data.tobytes().decode()
    assert [data[a:z] for a, z in zip(starts, ends)] == ["ab", "cd", "e", "f", "g", "h"] and first.tolist() == [0, 1, 2, 2, 2, 3, 5, 6]


def test_texts_longer_than_a_block_and_one_id_for_most_rows(spark, rows):
    """40 blocks for some 90 KB: the longest text is many times a block. One id stands for three quarters of all rows."""
    from pyspark.sql import types as T

    text = dict(enumerate(t for _, t in rows))
    found = [(7, t) for t in text.values()] * 3 + [(i, t) for i, t in enumerate(text.values())]
    docs = spark.createDataFrame(found, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    blocks, heads = C.in_blocks(docs, 40)
    per = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert sum(per) == len(found) and max(per) < len(found) / 4 and heads.count() == len(set(text.values()))
    by_doc = {(r.doc_id, r.kept_sha256) for r in substring.substring_dedup(docs, n_blocks=40).collect()}
    assert len(by_doc) > 10
    kept = suffixarray.suffix_array_dedup(docs, n_blocks=40).collect()
    assert len(kept) == len(found) and all(r.n_removed == 0 or r.n_bytes >= 50 for r in kept)
    assert len(packing.pack(docs).collect()) == len(found)
    assert minhash.minhash_near_dedup(docs).count() == len(found)


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 10)
    rows = spark.createDataFrame([(1, i) for i in range(95)] + [(k, 1000 + k) for k in range(2, 30)], "band long, cls long")
    hot = minhash.hot_keys(rows, "band")
    assert [tuple(r) for r in hot.collect()] == [(1, 10)]
    other = rows.select("band").distinct().withColumn("mark", rows["band"] * 10)
    out = minhash.spread(rows, "band", other, hot)
    assert out.columns == ["band", "cls", "mark"] and out.count() == 123 and out.where("mark <> band * 10").count() == 0


def test_top_k_over_chunks_and_lengths(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("CHUNK", 40), ("CHUNKS", 2), ("QUERY_BLOCK", 3)):
        monkeypatch.setattr(vafile, name, value)
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.normal(size=4 + i % 2)]) for i in range(200)] + [(40, [1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in vectors]
    want = Counter()
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-int(v @ x), i) for i, x in whole if i != q and len(x) == len(v))[:20]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter(tuple(r) for r in vafile.exact_top_k(table).collect()) == want


def test_bottom_k_against_brute_force(spark):
    """Prints and likeness, from the distinct hashes of the shingles themselves."""
    from pyspark.sql import functions as F

    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(n)) for i, n in enumerate((0, 3, 5, 40, 200, 300, 300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hashes = {r.doc_id: sorted(set(r.h)) for r in df.select("doc_id", fingerprints.shingle_hashes(F.col("text")).alias("h")).collect()}
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df, 16).collect()}
    for i, h in hashes.items():
        assert got[i].fingerprint == "".join(f"{x & (2**64 - 1):016x}" for x in h[:16])
        a, b = h[:16], hashes[(i - 1) % len(texts)][:16]
        union = sorted(set(a) | set(b))[:16]
        assert got[i].near_next == (len([x for x in union if x in a and x in b]) / len(union) if union else 1.0)


def test_ranges_of_ids_beyond_the_marks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "MARKS", 3)
    ids = [*range(0, 400, 3), 10_000, None, None]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    out = fingerprints.with_next(df, 12).collect()
    order = sorted(((2**63 if i is None else i), f"text {k}") for k, i in enumerate(ids))
    order.sort(key=lambda x: (-x[0], x[1]))
    following = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert {r.text: r.next_text for r in out} == following


def test_texts_of_wanted_ids_are_not_exchanged(spark, monkeypatch):
    source = spark.range(5000).selectExpr("if(id = 4999, null, id) doc_id", "concat('text ', id) text")
    wanted = spark.range(0, 5000, 50).withColumnRenamed("id", "doc_id")
    found = minhash.among(source, wanted)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.text for r in found.collect()}
    assert {i: got.get(i) for i in range(0, 5000, 50)} == {i: f"text {i}" for i in range(0, 5000, 50)} and len(got) < 300
    monkeypatch.setattr(minhash, "MOST_BITS", 0)
    assert minhash.among(source, wanted).count() == 100
