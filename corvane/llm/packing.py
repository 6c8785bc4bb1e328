"""Packing into optimal length buckets.

The histogram of all lengths goes to a dynamic programme, which chooses at most ``buckets`` upper bounds so that padding every
document up to its bucket's bound costs the fewest tokens. Inside a bucket of bound b, documents are taken in a fixed order and
every floor(budget / b) of them (one at least) are a batch, which so holds ``budget`` tokens at most after padding.

A length is the number of words (maximal runs of anything but ASCII white space). The histogram has every distinct length, and the
optimum is exact: k distinct lengths need k (k - 1) / 2 words, so a table of W words has at most sqrt(2 W) + 1 of them (some 110,000
for 30 GB). The cost of a bucket is Monge, so the best cut moves one way with the length, and the programme takes ``buckets`` x k x
log k steps. A document longer than the budget is a batch of its own.

Ranks are taken in sub-ranges of a hash of id and text, so neither a bucket nor an id with most of the documents is a single task. A null text has
length 0; null ids and rows that repeat an id are placed like any others. Equal optima go to the larger last bucket. An empty
table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common as C

BUCKETS, BUDGET = 16, 32768
#: Rows of a sub-range at most, on average.
RANGE = 500_000
FAR = 1 << 62


def word_count(text: Column) -> Column:
    """Each word becomes one letter, the blanks go, and the letters are counted: no array of words is built."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), "[^ \\x09-\\x0D]++", "x")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")


def _layer(best: np.ndarray, lengths: np.ndarray, docs: np.ndarray, tokens: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j lengths in b buckets and the smallest best cut, from ``best`` in b - 1 buckets. Divide and
    conquer: a middle j is solved over the cuts that its neighbours leave, all the middles of one depth at once."""
    n = len(lengths)
    new, back = np.full(n + 1, FAR), np.zeros(n + 1, np.int64)
    low, high, least, most = (np.array([x]) for x in (b, n, b - 1, n - 1))
    while len(low):
        j = (low + high) // 2
        size = np.minimum(most, j - 1) - least + 1
        start = np.r_[0, np.cumsum(size)[:-1]]
        of = np.repeat(np.arange(len(j)), size)
        i, to = np.arange(len(of)) - (start - least)[of], j[of]
        cost = best[i] + lengths[to - 1] * (docs[to] - docs[i]) - (tokens[to] - tokens[i])
        new[j] = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == new[to])
        cut = back[j] = i[hit[np.unique(of[hit], return_index=True)[1]]]
        low, high, least, most = np.r_[low, j + 1], np.r_[j - 1, high], np.r_[least, cut], np.r_[cut, most]
        left = low <= high
        low, high, least, most = low[left], high[left], least[left], most[left]
    return new, back


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The bounds, ascending, of at most ``buckets`` buckets with the least padding in all. lengths: sorted and distinct."""
    n = len(lengths)
    if n == 0:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    docs, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    buckets = min(buckets, n)
    # best[j]: least padding of the first j lengths; the padding of i .. j-1 is lengths[j-1] * docs - tokens
    best = np.r_[0, np.full(n, FAR)]
    back = np.zeros((buckets + 1, n + 1), np.int64)
    for b in range(1, buckets + 1):
        best, back[b] = _layer(best, lengths, docs, tokens, b)
    out, j = [], n
    for b in range(buckets, 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[b, j])
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, whole: bool = False) -> DataFrame:
    """doc_id, n_tokens, bucket (its bound), batch, place, padding of every row of ``docs`` (doc_id, text).

    whole: the other columns of ``docs`` come along (behind these; a name that is taken gets ``doc_`` before it), so that what is
    packed can be read batch by batch without a join."""
    keys = ("doc_id", "n_tokens", "bucket", "batch", "place", "padding")
    rest = [c for c in docs.columns if c != "doc_id"] if whole else []
    carried = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_carried")] if rest else []
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(text).alias("n_tokens"), F.xxhash64("doc_id", text).alias("_row"), *carried)
    rows = C.written(rows, "lengths")
    found = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()  # sqrt(2 W) rows, see above
    counts = np.asarray(found.column("n"))
    bounds = best_bounds(np.asarray(found.column("n_tokens")), counts, buckets) or [0]
    bound = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]).cast("long")
    n_sub = max(64, int(counts.sum()) // RANGE)
    sub = F.pmod(F.col("_row"), F.lit(n_sub)).cast("int")
    placed = C.ranked(rows.withColumn("bucket", bound), "bucket", [F.col("doc_id"), F.col("n_tokens"), F.col("_row")], sub, n_sub, "rank")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    along = [F.col(f"_carried.`{c}`").alias(f"doc_{c}" if c in keys else c) for c in rest]
    return placed.select("doc_id", "n_tokens", "bucket", F.floor(F.col("rank") / each).cast("long").alias("batch"), F.pmod(F.col("rank"), each).cast("long").alias("place"), (F.col("bucket") - F.col("n_tokens")).alias("padding"), *along)
