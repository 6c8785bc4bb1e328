"""Sharding by k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension.

Dimensions of a row: its size (log2 of the bytes), its language and its source (places of the value's hash), each scaled to
0 .. 1 over the table. A node takes the dimension in which its rows lie widest and is cut where half of its bytes are on either
side, until there are ``shards`` leaves (a power of two) of the target bytes. A value may hold most of a node's bytes (one hot
source): behind the value the order goes on by a hash of the text, then of the id, then by a number of the row, so the cut falls
inside the value and leaves stay equal, and equal texts of one language and source lie side by side: only the one group that a
node's median falls into is cut, since the law ``bytes`` asks for it.

Medians are exact to one row: the 62-bit order key (20 bits of the dimension, 26 of the text, 12 of the id, 4 of the row) is
narrowed by six histograms of all nodes of a level at once, a few thousand rows each; only those reach the driver. What the driver
chose for the nodes (``shards`` of them at most) goes into the plan as literals, so no Python runs on executors.

A null text has no bytes (size 1), null languages and sources are values of their own, null ids are hashed as one id. Rows that
repeat an id and a text spread by the number that they got when the metadata was written. An empty table gives no rows. Extra
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common as C

DIMENSIONS = ("size", "lang", "source")
HASH_BITS, VALUE_BITS = 42, 20
#: Rows of a sub-range of a shard at most, on average.
RANGE = 500_000


def _metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    has = set(docs.columns)
    value = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(c), F.col(c).cast("string") if c in has else F.lit(None).cast("string")), 44).cast("double") / (1 << 20)
    size = (F.octet_length(text) + 1).cast("long")
    bits = lambda h, n: F.shiftrightunsigned(h, 64 - n)
    # the row's number is read from the written table, so it is the same in all that follows
    tie = F.shiftleft(bits(F.xxhash64(text), 26), 16).bitwiseOR(F.shiftleft(bits(F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)), 12), 4)).bitwiseOR(bits(F.xxhash64(F.monotonically_increasing_id()), 4))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).cast("long").alias("text_crc32"), (F.log2(size.cast("double")) / 40).alias("d_size"), value("lang").alias("d_lang"), value("source").alias("d_source"), tie.alias("tie"))


def _by_node(values: dict[int, object], kind: str) -> Column:
    """A column with a literal for each node; null for others."""
    return F.coalesce(*[F.when(F.col("node") == n, F.lit(v).cast(kind)) for n, v in values.items()])


def _cut(keyed: DataFrame, nodes: dict[int, int]) -> dict[int, int]:
    """By node, the key at or below which half of the node's bytes lie, as nearly as a row allows. keyed: node, key, size.

    Histograms from the highest bits down; a step counts 11 bits, so at most nodes x 2**11 rows reach the driver.
    """
    prefix, below, last = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), 62
    for shift in (51, 40, 29, 18, 7, 0):
        inside = keyed
        if last < 62:
            inside = keyed.where(F.shiftright("key", last) == _by_node(prefix, "long"))
        bins = inside.groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("size"))
        got: dict[int, list] = {n: [] for n in nodes}
        for r in bins.collect():
            got[r["node"]].append((r["bin"], r["size"]))
        for n in nodes:
            top = max(got[n])[0]
            for b, size in sorted(got[n]):
                if 2 * (below[n] + size) >= nodes[n] or b == top:
                    # at the last bit, the row at the median goes to the side that leaves the two nearer to equal
                    prefix[n] = b - (shift == 0 and nodes[n] - 2 * below[n] < 2 * (below[n] + size) - nodes[n])
                    break
                below[n] += size
        last = shift
    return prefix


def kd_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text; lang and source if there)."""
    assert shards & (shards - 1) == 0
    rows = C.written(_metadata(docs).withColumn("node", F.lit(1)), "metadata")
    depth = shards.bit_length() - 1
    for _ in range(depth):
        stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"d_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))])
        nodes, places = {}, {}
        for r in stats.collect():  # a row a node: ``shards`` at most
            wide = {d: r[f"hi_{d}"] - r[f"lo_{d}"] for d in DIMENSIONS}
            d = max(DIMENSIONS, key=lambda d: (wide[d], d))
            nodes[r["node"]] = r["bytes"]
            places[r["node"]] = (F.col(f"d_{d}") - r[f"lo_{d}"]) / max(wide[d], 1e-12)
        if not nodes:
            break
        top = (1 << VALUE_BITS) - 1
        place = F.coalesce(*[F.when(F.col("node") == n, p) for n, p in places.items()])
        at = F.least(F.greatest(F.floor(place * top), F.lit(0)), F.lit(top)).cast("long")
        keyed = C.written(rows.withColumn("key", F.shiftleft(at, HASH_BITS).bitwiseOR(F.col("tie"))), "keyed")
        cut = _cut(keyed.select("node", "key", "size"), nodes)
        right = F.col("key") > _by_node(cut, "long")
        rows = C.written(keyed.withColumn("node", F.col("node") * 2 + right.cast("int")).drop("key"), "split")
    rows = rows.withColumn("shard", (F.col("node") - (1 << depth)).cast("int"))
    n_sub = max(64, rows.count() // RANGE)
    placed = C.ranked(rows, "shard", [F.col("doc_id"), F.col("tie"), F.col("text_crc32"), F.col("size")], F.pmod(F.col("tie"), F.lit(n_sub)).cast("int"), n_sub)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
