"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

A signature takes two permutations of the 32-bit ring: ``_first`` spreads the shingles once, and coordinate k is the minimum of
``_second(_first(x) + k)``, the second permutation read from a start shifted by k. Sets of ``bands`` x ``rows`` coordinates:
two sets with a Jaccard of 0.85 share no band with a chance of 8e-5 (20 bands of 6).

Documents with one set of shingles are one *class* (class id: the smallest doc_id). Only classes with a shared band go on.
Their sets are made from their texts again, found by bits of hashed ids, so that no text is exchanged and of the other documents only
the sets of the few that share bits are stored.
Links between classes are found without listing the pairs of a band group: in each round every member is paired with two
pivots of its group (the ends by a hash of band, round and class), the pairs are verified on the full sets, and the links
joined to components. Groups that hold more than one component go on. After the last round, what is left is compared across
components only: members of a large component are dealt over tiles of their own, those of small ones over mixed tiles, and a pair
of tiles of one component is never made, so one giant component beside a few others costs rows in proportion to its size. No
partner or candidate is capped, so nothing is lost to a large group.

Hot bands and pivots: a key with more than ``HOT`` members and more than a ten-thousandth of all rows is spread over as many salts
as it has times ``HOT``; there are at most 10,000 such keys, so their list is broadcast. A pair's set of the member is joined
first, by keys that nothing makes hot, then the pivot's, by key and salt.

A null text or one without words has the empty set, links with nothing and is its own component. A null doc_id has no place in
the order of ids: such rows come back with their shingle count, a null component and kept true. Rows that repeat an id share
its component: their sets all count. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common as C

WORDS, PERCENT = 5, 85
BANDS, ROWS = 20, 6
#: Percent, bands and rows of a stage that no contract holds to 85: at a Jaccard of 0.80 no shared band has a chance of 7e-6.
STAGE = 80, 30, 5
ROUNDS, TILE, HOT = 3, 256, 20_000
#: Bits of the ids whose sets are made again, at most: 64 MB.
MOST_BITS = 1 << 29
SIGNED = "doc_id long, n_shingles long, set_key binary, bands binary"


def _mixed32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit values, in place."""
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(13)
    return x


def signatures(shingles: np.ndarray, first: np.ndarray, n_coordinates: int) -> np.ndarray:
    """By set (``first``: place of each set's first shingle; no set is empty) and coordinate, the circulant minimum."""
    ring = _mixed32((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.empty((len(first), n_coordinates), np.uint32)
    bounds = np.r_[first, len(ring)]
    at = 0
    while at < len(first):  # pieces that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 65536, side="right")) - 1)
        piece, heads = ring[bounds[at] : bounds[to]], bounds[at:to] - bounds[at]
        for k in range(n_coordinates):
            out[at:to, k] = np.minimum.reduceat(_mixed32(piece + np.uint32(k), 0x9E3779B1, 0x27D4EB2F), heads)
        at = to
    return out


def shingle_sets(block: C.Block) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document end to end, and their offsets."""
    starts, ends, first = C.words_of(block)
    hashes = C.word_hashes(block, starts, ends, lower=True)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(block.n), n_words)
    made: dict[int, np.ndarray] = {}
    runs = C.windows_hash(hashes, WORDS, made)
    fits = np.flatnonzero(np.arange(len(runs)) + WORDS <= first[1:][doc[: len(runs)]])
    values, of = [runs[fits]], [doc[fits]]
    for size in range(1, WORDS):  # the whole sequence is the one shingle
        at = np.flatnonzero(n_words == size)
        values.append(C.mixed(C.windows_hash(hashes, size, made)[first[at]] + np.uint64(size)) if len(at) else np.zeros(0, np.uint64))
        of.append(at)
    value, of = np.concatenate(values), np.concatenate(of)
    by = np.lexsort((value, of))
    value, of = value[by], of[by]
    keep = np.r_[True, (np.diff(value) != 0) | (np.diff(of) != 0)][: len(value)]
    return value[keep], np.searchsorted(of[keep], np.arange(block.n + 1))


def _sign(batches, n_bands: int, n_rows: int):
    for table in C.cut_batches(batches):
        yield _signed(C.Block(table), n_bands, n_rows)


def _sets(batches):
    for table in C.cut_batches(batches):
        block = C.Block(table)
        value, bounds = shingle_sets(block)
        sets = [value[s:e].tobytes() if e > s else None for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        rows = list(dict.fromkeys((i, x) for i, x in zip(block.ids.tolist(), sets) if x is not None))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["cls", "shingles"])


def among(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of ``source`` whose id ``wanted`` (doc_id, distinct) has, and a few others (1 in 70), so that no text
    is exchanged: 16 bits and more an id, two of them set. Beyond ``MOST_BITS`` the texts are joined."""
    n_bits = 1 << max(10, (16 * wanted.count()).bit_length())
    if n_bits > MOST_BITS:
        return source.join(wanted, "doc_id", "left_semi")
    places = lambda: [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(n_bits)) for k in (0, 1)]
    set_bits = wanted.select(F.explode(F.array(*places())).alias("p")).groupBy(F.floor(F.col("p") / 8).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(p % 8 as int))")).alias("bits")).toArrow()
    bits = np.zeros(n_bits // 8, np.uint8)
    bits[set_bits.column("at").to_numpy()] = set_bits.column("bits").to_numpy().astype(np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(bits)
    rows = source.where("doc_id is not null").select("doc_id", "text", *[p.alias(name) for p, name in zip(places(), "pq")])
    return rows.mapInArrow(lambda it: _among(it, shared.value), "doc_id long, text string")


def _among(batches, bits: np.ndarray):
    for batch in batches:
        p, q = np.asarray(batch.column("p")), np.asarray(batch.column("q"))
        ok = bits[p >> 3] >> (p & 7).astype(np.uint8) & bits[q >> 3] >> (q & 7).astype(np.uint8) & 1
        yield batch.select(["doc_id", "text"]).filter(pa.array(ok.astype(bool)))


def _signed(block: C.Block, n_bands: int, n_rows: int) -> pa.RecordBatch:
    value, bounds = shingle_sets(block)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    sig = signatures(value, bounds[:-1][full], n_bands * n_rows) if len(full) else np.zeros((0, n_bands * n_rows), np.uint32)
    bands = np.zeros((len(full), n_bands), np.uint64)
    for k in range(n_bands):
        h = np.full(len(full), k + 1, np.uint64)
        for c in range(n_rows):
            h = C.mixed(h + sig[:, k * n_rows + c].astype(np.uint64))
        bands[:, k] = h
    total = np.zeros((len(full), 2), np.uint64)
    if len(full):
        total[:, 0] = np.add.reduceat(C.mixed(value), bounds[:-1][full])
        total[:, 1] = np.bitwise_xor.reduceat(C.mixed(value + np.uint64(0x51ED270B)), bounds[:-1][full])
    row = np.full(block.n, -1)
    row[full] = np.arange(len(full))
    keys = [total[r].tobytes() if r >= 0 else None for r in row.tolist()]
    return pa.RecordBatch.from_arrays([block.id_column(), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array([bands[r].tobytes() if r >= 0 else None for r in row.tolist()], pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands"])


def _unrolled(batches):
    for batch in batches:
        blobs = batch.column("bands")
        flat = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in blobs]) if len(blobs) else np.zeros(0, np.int64)
        n_bands = len(flat) // max(1, len(blobs))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("cls")), n_bands)), pa.array(flat)], names=["cls", "band"])


def _linked(batches, percent: int):
    for batch in batches:
        ok = []
        for a, b in zip(batch.column("sa"), batch.column("sb")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            if 100 * len(small) < percent * len(large):
                ok.append(False)
                continue
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, salts: the keys that many of the rows have; 10,000 at most, so the table can be broadcast."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("n")).head()["n"] or 0
    return C.written(counted.where((F.col("n") > HOT) & (F.col("n") * 10_000 > total)).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "hot")


def spread(rows: DataFrame, key: str, other: DataFrame, hot: DataFrame, by: str = "cls") -> DataFrame:
    """``rows`` joined with ``other`` on ``key``; a hot key's rows are dealt over its salts by ``by``, and what ``other`` has is copied."""
    hot = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0)).alias("salt")
    dealt = rows.join(hot, key, "left").select(*rows.columns, salt)
    copies = other.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [key, "salt"]).drop("salt")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, a member and its pivot, whose full sets reach the threshold."""
    one, two = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    pivots = two.join(pairs.select("b").distinct(), "b", "left_semi")
    met = spread(pairs.join(one, "a"), "b", pivots, hot_keys(pairs, "b"), "a")
    return met.select("a", "b", "sa", "sb").mapInArrow(lambda it: _linked(it, percent), "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cls, comp: the smallest node that links reach. By hooking to the smallest neighbour and pointer jumping; each step is a
    written table, and steps grow with the logarithm of the longest chain."""
    label = C.written(nodes.select("cls", F.col("cls").alias("comp")).distinct(), "labels")
    while True:
        la, lb = label.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), label.select(F.col("cls").alias("b"), F.col("comp").alias("cb"))
        roots = links.join(la, "a").join(lb, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("comp"), F.least("ca", "cb").alias("low"))
        hook = C.written(roots.groupBy("comp").agg(F.min("low").alias("low")), "hooks")
        if not hook.take(1):
            return label
        while True:  # chains of hooks are flattened
            up = hook.select(F.col("comp").alias("low"), F.col("low").alias("lower"))
            step = C.written(hook.join(up, "low", "left").select("comp", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")), "hooks")
            hook = step.drop("moved")
            if not step.where("moved").take(1):
                break
        label = C.written(label.join(hook, "comp", "left").select("cls", F.coalesce("low", "comp").alias("comp")), "labels")


def _tile(table: pa.Table, percent: int) -> pa.Table:
    """Links between different components of the members of two tiles of one band group; a spanning set of them is enough."""
    comp = np.asarray(table.column("comp"))
    cls, side = np.asarray(table.column("cls")), np.asarray(table.column("side"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    by = np.argsort(flat, kind="stable")
    flat, of = flat[by], of[by]
    same = (side == 2).all()
    for i in range(len(sets)):
        if not same and side[i] != 0:
            continue
        lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
        n = hi - lo
        reach = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(of[reach], minlength=len(sets))
        for j in np.flatnonzero(100 * both >= percent * (size + size[i] - both)).tolist():
            if j != i and (same or side[j] == 1) and root(int(comp[i])) != root(int(comp[j])):
                parent[root(int(comp[i]))] = root(int(comp[j]))
                out.append((int(cls[i]), int(cls[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _tiled(live: DataFrame, label: DataFrame, hot: DataFrame) -> DataFrame:
    """band, cls, comp, i, j, side: the members of each pair of tiles of a band that can hold a link between two components."""
    member = live.join(label, "cls")
    sizes = member.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.when(F.col("n") >= TILE, F.col("comp")))
    parts = sizes.groupBy("band", "part").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    same = (F.col("s.band") == F.col("p.band")) & F.col("s.part").eqNullSafe(F.col("p.part"))
    placed = sizes.alias("s").join(parts.alias("p"), same).select("s.band", "s.comp", "s.part", "p.tiles")
    name = lambda part, k: F.xxhash64(F.coalesce(part, F.lit(-1)), part.isNull(), k)
    dealt = member.join(placed, ["band", "comp"]).select("band", "cls", "comp", "part", name(F.col("part"), F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).alias("tile"))
    tiles = parts.select("band", F.col("part").alias("mate_part"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("k"))
    tiles = tiles.select("band", "mate_part", name(F.col("mate_part"), F.col("k")).alias("mate"))
    mates = spread(dealt, "band", tiles, hot).where(F.col("part").isNull() | F.col("mate_part").isNull() | (F.col("part") != F.col("mate_part")))
    side = F.when(F.col("tile") == F.col("mate"), 2).when(F.col("tile") < F.col("mate"), 0).otherwise(1)
    return mates.select("band", "cls", "comp", F.least("tile", "mate").alias("i"), F.greatest("tile", "mate").alias("j"), side.alias("side"))


def minhash_near_dedup(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = C.written(source.mapInArrow(lambda it: _sign(it, bands, rows), SIGNED), "signed")
    own = signed.where("doc_id is not null and set_key is not null")
    member = C.written(own.groupBy("set_key").agg(F.min("doc_id").alias("cls")), "classes")
    # an id that occurs with two texts ties their classes together
    placed = C.written(own.select("doc_id", "set_key").join(member, "set_key").groupBy("doc_id").agg(F.min("cls").alias("cls"), F.max("cls").alias("other")), "placed")
    heads = own.join(member.withColumnRenamed("cls", "doc_id"), ["doc_id", "set_key"]).select(F.col("doc_id").alias("cls"), "bands")
    groups = C.written(heads.mapInArrow(_unrolled, "cls long, band long").distinct(), "bands")
    hot = hot_keys(groups, "band")
    counted = groups.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    live = C.written(spread(groups, "band", counted, hot), "bands")
    wanted = live.select(F.col("cls").alias("doc_id")).distinct()
    sets = C.written(among(source, wanted).mapInArrow(_sets, "cls long, shingles binary"), "sets")
    links = C.written(placed.where("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")), "ties")
    nodes = wanted.select(F.col("doc_id").alias("cls")).unionByName(links.select(F.col("a").alias("cls"))).unionByName(links.select(F.col("b").alias("cls"))).distinct()
    label = None
    for turn in range(ROUNDS):
        mark = F.struct((F.xxhash64("band", "cls", F.lit(turn)) if turn else F.col("cls")).alias("h"), F.col("cls").alias("p"))
        pivot = live.groupBy("band").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).select("band", F.explode(F.array("lo.p", "hi.p")).alias("p"))
        pairs = spread(live, "band", pivot, hot).where("cls <> p").select(F.col("cls").alias("a"), F.col("p").alias("b")).distinct()
        if label is not None:
            la, lb = label.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), label.select(F.col("cls").alias("b"), F.col("comp").alias("cb"))
            pairs = pairs.join(la, "a").join(lb, "b").where("ca <> cb").select("a", "b")
        pairs = C.written(pairs, "pairs")
        links = links.unionByName(C.written(verified(pairs, sets, percent), "links"))
        label = components(nodes, links)
        several = live.join(label, "cls").groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
        live = C.written(spread(live, "band", several, hot), "bands")
        if not live.take(1):
            break
    else:  # what is left is compared in full, tile by tile
        mates = _tiled(live, label, hot)
        tiles = mates.join(sets, "cls").groupBy("band", "i", "j").applyInArrow(lambda t: _tile(t, percent), "a long, b long")
        label = components(nodes, links.unionByName(C.written(tiles, "links")))
    whole = placed.select("doc_id", "cls").join(label, "cls", "left").select("doc_id", F.coalesce("comp", "cls").alias("comp"))
    out = signed.select("doc_id", "n_shingles").join(whole, "doc_id", "left").withColumn("component_id", F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs``, all columns, with the smallest id of each component only. Rows without an id stay; rows that repeat a kept id
    stay together."""
    found = minhash_near_dedup(docs, percent, bands, rows)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def one_of_each(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs``, all columns, with one row of each component, rows without an id and rows that repeat an id included.

    Here a document is a distinct pair of id and text, so of equal rows the smallest stays, and two texts of one id are linked only
    if they are alike. Of a component the smallest id stays. Documents that cannot have their own id come after all others: further
    texts of an id (its first text by hash keeps the id), then those without an id, both by a hash of the text."""
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    odd = C.written(whole.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select("id"), "odd")
    if not odd.take(1):
        return keep_one(docs, percent, bands, rows)
    some = odd.where("id is not null")
    again = whole.where("id is null").unionByName(whole.join(some, "id", "left_semi"))
    key = F.md5(F.col("row.text").cast("string").cast("binary"))
    single = C.written(again.groupBy("id", key.alias("key")).agg(F.min("row").alias("row")), "single")
    first = single.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("key").isNotNull().alias("has"), "key")).alias("first"))
    marked = single.join(first, "id", "left").withColumn("own", F.coalesce(F.col("key").eqNullSafe(F.col("first.key")), F.lit(False)) & F.col("id").isNotNull())
    n_sub = max(64, 2 * C.partitions(docs.sparkSession))
    late = F.pmod(F.xxhash64("key"), F.lit(n_sub)).cast("int") + F.when(F.col("id").isNull(), n_sub).otherwise(0)
    rest = C.ranked(marked.where("not own").select(F.lit(0).alias("all"), "id", "key", "row"), "all", [F.col("key"), F.col("id")], late, 2 * n_sub, "rank")
    top = whole.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    numbered = whole.where("id is not null").join(some, "id", "left_anti").unionByName(marked.where("own").select("id", "row"))
    numbered = numbered.unionByName(C.written(rest.select((F.col("rank") + F.lit(top) + 1).alias("id"), "row"), "rest"))
    found = minhash_near_dedup(numbered.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), percent, bands, rows)
    return numbered.join(found.where(~F.col("kept")).select(F.col("doc_id").alias("id")), "id", "left_anti").select("row.*")
