"""Document fingerprints: bottom-k sketches of shingle hashes, made by DataFrame functions only.

A sketch is the ``k`` smallest distinct hashes of a text's five-word shingles (a text with fewer words is one shingle; without
words the sketch is empty), as a sorted array. Sketches of parts merge to the sketch of the union; two sketches estimate
resemblance, containment and, one alone, the number of distinct shingles. Below k hashes every estimate is exact.

Only hashes under a threshold that leaves about 4k of them are sorted; if fewer than k were left, all are. So the sort is
short and the result the same.

A null text is empty, a null id comes first in the descending order of ``with_next``; among rows that repeat an id the order is
by text. Two empty sketches have likeness 1, an empty and another one 0. An empty table gives no rows. Extra columns don't
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import common as C

WORDS, K = 5, 128
#: Quantiles of the ids that are looked up; between them ranges are of one width.
MARKS = 2048
#: Ranges whose table (24 bytes each) is broadcast; beyond, it is joined by exchange.
BROADCAST = 100_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """One 64-bit hash a shingle, repeats included."""
    parts = F.filter(F.split(text, C.WORD_BREAK), lambda w: w != "")
    return F.transform(
        F.array(F.transform(parts, lambda w: F.xxhash64(w))),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < words, F.array(F.xxhash64(h)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(words)]))),
    )[0]


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct values, sorted."""
    low = -(1 << 63)
    span = F.lit(float(1 << 64)) * (4 * k)

    def least(h: Column) -> Column:
        edge = (F.lit(float(low)) + span / F.size(h)).cast("bigint")
        some = F.array_sort(F.array_distinct(F.filter(h, lambda x: x <= edge)))
        return F.transform(F.array(some), lambda s: F.when(F.size(s) >= k, s).otherwise(F.array_sort(F.array_distinct(h))))[0]

    return F.transform(F.array(hashes), lambda h: F.slice(F.when(F.size(h) > 8 * k, least(h)).otherwise(F.array_sort(F.array_distinct(h))), 1, k))[0]


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return bottom_k(shingle_hashes(F.coalesce(text, F.lit("")), words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches describe."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts: distinct hashes, then the k smallest by rank. Equal hashes of a key meet
    before anything is exchanged, and the ranks are cut in 64 slices of a key first (by the hash's low bits), so neither a list nor a
    task grows with the parts of one key."""
    each = parts.select(*keys, F.explode(column).alias("_h")).distinct().withColumn("_slice", F.pmod("_h", F.lit(64)))
    cut = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_n") <= k).drop("_n")
    least = cut(cut(each, [*keys, "_slice"]), keys).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))
    return parts.select(*keys).distinct().join(least, keys, "left").select(*keys, F.coalesce(column, F.array().cast("array<bigint>")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.array_intersect(merge(a, b, k), F.array_intersect(a, b))
    total = F.least(F.size(F.array_union(a, b)), F.lit(k))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.size(both) / total).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact under k, else from the k-th smallest hash."""
    kth = (F.element_at(a, k).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _range_of(marks: list[int], fine: int) -> Column:
    """The number of the range that ``_key`` falls in, ranges with the largest keys first: between two marks (quantiles) are
    ``fine`` ranges of one width."""
    if not marks:
        return F.lit(0).cast("long")
    coarse = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m >= F.col("_key")))
    falling = [F.lit(m) for m in reversed(marks)]
    high, low = F.array(*falling), F.array(*falling[1:], falling[-1])
    inner = (coarse >= 1) & (coarse < len(marks))
    lo, hi = F.element_at(low, coarse), F.element_at(high, coarse)
    share = (hi.cast("double") - F.col("_key").cast("double")) / (hi.cast("double") - lo.cast("double"))
    sub = F.when(inner, F.least(F.floor(share * fine), F.lit(fine - 1))).otherwise(F.lit(0))
    return (coarse.cast("long") * fine + F.greatest(sub, F.lit(0))).cast("long")


def with_next(docs: DataFrame, parts: int, k: int = K) -> DataFrame:
    """doc_id, text, its sketch ``a``, and ``next_text`` and ``next_a`` of the next row by descending id (after the last: the first).

    Ids are cut into ranges: at most ``MARKS`` quantiles, and ranges of one width between them where more are wanted. Each range is
    ordered by itself, and the first row of a range is also given to the range before it, so no range needs another one and no task
    holds the order of all. What is known of the ranges stays in a table (a row a range).
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("_key"))
    coarse = min(parts, MARKS)
    ends = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    found = rows.agg(*ends, F.percentile_approx("_key", [i / coarse for i in range(1, coarse)], 10000).alias("inner")).head() if coarse > 1 else None
    marks = sorted({found["low"] - 1, found["high"], *found["inner"]}) if found and found["low"] is not None and found["low"] > -(1 << 63) else []
    fine = -(-parts // coarse)
    rows = rows.withColumn("_part", _range_of(marks, fine))
    tops = rows.groupBy("_part").agg(F.max("_key").alias("_key"))
    turn = Window.orderBy("_part")
    tops = tops.withColumn("_to", F.coalesce(F.lag("_part").over(turn), F.max("_part").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    # of rows that repeat the first id of a range, the smallest text is the first
    known = F.broadcast(tops) if parts <= BROADCAST else tops  # a row a range
    guests = rows.join(known, ["_part", "_key"]).groupBy("_to").agg(F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("_key"), F.col("_to").alias("_part"), F.lit(True).alias("_guest"))
    order = Window.partitionBy("_part").orderBy("_guest", F.desc("_key"), "text")
    every = rows.withColumn("_guest", F.lit(False)).unionByName(guests).repartition(parts, "_part")
    every = every.withColumn("a", sketch(F.col("text"), k))
    following = every.withColumn("next_text", F.lead("text").over(order)).withColumn("next_a", F.lead("a").over(order))
    return following.where(~F.col("_guest")).select("doc_id", "text", "a", "next_text", "next_a")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``."""
    parts = C.block_count(C.text_bytes(docs))
    paired = with_next(docs, parts, k)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    rows = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "a", F.col("next_a").alias("c"))
    rows = rows.withColumn("b", sketch(F.col("edited"), k))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("c"), k).alias("near_next"))
