"""Suffix-array dedup of byte strings, with suffix arrays built by linear Lyndon grouping.

``suffix_array`` sorts suffixes in two phases. First, groups of suffixes that share a Lyndon prefix are taken in descending
order; each suffix's previous-smaller pointer finds the suffix whose prefix grows, and those are moved behind the rest of
their group. Then one ascending pass emits every group's own order along the same pointers. Nothing is renamed or recursed.

Over a corpus no machine holds one suffix array. A 50-byte string always contains a seed: the 24-byte piece with the smallest
hash among its 27, a choice made from the string alone, so equal strings have equal seeds at equal places. Of each group of
equal texts only the one with the smallest id is looked at; the others lose every string to it. Three exchanges:

1. Blocks of documents send the distinct hashes of their seeds. A seed that one document alone has is dropped: no string
   around it is shared. This is a filter only, with as many bytes a hash as the input's size asks for (``C.key_bytes``).
2. Blocks send, for each seed left, the bytes from the first to the last 50-byte string that the seed stands for (62 on
   average), each distinct piece once, with its smallest id. Pieces with one seed meet in one bucket. Those whose surroundings
   no other piece has share no string and stand alone (again a filter only); a suffix array over the rest, with LCPs, gives the
   groups of equal strings and the smallest id of each. Seeds that very many blocks hold are
   dealt by seed, place and surrounding bytes instead, in six ranges of places, so that one passage spreads over buckets.
3. A bit for each string comes back, and blocks cut their own texts.

Blocks and buckets follow the bytes of text and grow with it up to four times, and what one block sends to one bucket is one row,
so there are never more rows than seeds or pieces. The pieces' bytes are compared themselves, so the result is exact. A null text is empty; a null id counts
as larger than any other; rows that share an id don't remove from each other (ties: the same id is no smaller id); texts under
50 bytes stay; a text of any length is read whole, as a part of one block; an empty table gives no rows. Other columns don't
matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common as C

LENGTH, SEED = 50, 24
SPAN = LENGTH - SEED + 1
#: Bytes of text in a block (one Python call), and bytes for each bucket. What one block sends to one bucket is a row, so their sizes
#: grow with the input up to ``GROWN`` times, from ``FEW`` blocks on: else the rows would grow with its square.
BLOCK, BUCKET = 2 << 20, 4 << 20
GROWN, FEW = 4, 400
#: Records that are made at once, and strings whose seeds are.
SLICE, STEP = 32768, 1 << 15
#: A seed that more blocks than this hold is dealt over six ranges of places.
HOT_BLOCKS = 32
RANGES = ((0, 2), (3, 5), (6, 12), (13, 19), (20, 22), (23, 26))
#: Places whose strings are told apart at once before the suffix arrays.
NEAR = 3
#: Bytes that a symbol of the suffix arrays holds, and the most symbols of a row.
SYMBOL, WIDE = 7, 8
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_array(symbols: Sequence[int] | np.ndarray) -> list[int]:
    """The starts of all suffixes of ``symbols`` in ascending order. The last symbol must be the smallest and occur once."""
    values = np.asarray(symbols)
    n = len(values)
    by = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.r_[True, values[by][1:] != values[by][:-1]])
    counts = np.diff(np.r_[cut, n])
    start, of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    of[by], start[by] = np.arange(n), np.repeat(cut, counts)
    sizes = np.zeros(n, np.int64)
    sizes[cut] = counts
    order, place, head, size = by.tolist(), of.tolist(), start.tolist(), sizes.tolist()
    smaller = [-1] * n
    top = n
    while top:
        low = head[order[top - 1]]
        if top - low == 1:  # a group of one moves one suffix at most
            i = order[low]
            j = i - 1
            while j >= 0 and head[j] >= low:
                j = smaller[j]
            smaller[i] = j
            top = low
            if j >= 0:
                old = head[j]
                total = size[old]
                if total > 1:
                    end, p = old + total - 1, place[j]
                    other = order[end]
                    order[p], place[other] = other, p
                    order[end], place[j] = j, end
                    head[j] = end
                    size[end], size[old] = 1, total - 1
            continue
        grown: dict[int, int] = {}
        most = 1
        for i in sorted(order[low:top]):
            j = i - 1
            while j >= 0 and head[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                if j in grown:
                    grown[j] = c = grown[j] + 1
                    if c > most:
                        most = c
                else:
                    grown[j] = 1
        top = low
        for times in range(most, 0, -1):
            parts: dict[int, list[int]] = {}
            for j, c in grown.items():
                if c == times:
                    parts.setdefault(head[j], []).append(j)
            for old, moved in parts.items():
                total, m = size[old], len(moved)
                if m == total:
                    continue
                end = old + total - 1
                for j in moved:
                    p, other = place[j], order[end]
                    order[p], place[other] = other, p
                    order[end], place[j] = j, end
                    end -= 1
                new = old + total - m
                for j in moved:
                    head[j] = new
                size[new], size[old] = m, total - m
    out, done, free = [-1] * n, [False] * n, {}
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            group = head[j]
            p = free.get(group, group)
            out[p] = j
            free[group] = p + 1
            done[j] = True
            j = smaller[j]
    return out


def _sorted_seeds(right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of the rows of ``right`` (bytes, zeros behind each row's length), from the suffix array of all distinct rows end to end.

    A symbol is ``SYMBOL`` bytes read as one number, never a rank, so nothing is renamed; a row ends in a number smaller than any of
    these, its length, so it comes before its own extensions.
    """
    digest = _digest(right, lengths)
    _, first_row, back = np.unique(digest, return_index=True, return_inverse=True)
    if not ((right == right[first_row][back]).all() and (lengths == lengths[first_row][back]).all()):
        first_row = back = np.arange(len(right))  # two rows of one digest: all rows are sorted
    one, n_one = right[first_row], lengths[first_row]
    padded = np.zeros((len(one), WIDE * SYMBOL), np.int64)
    padded[:, : one.shape[1]] = one
    table = np.empty((len(one), WIDE + 1), np.int64)
    table[:, :-1] = (padded.reshape(len(one), WIDE, SYMBOL) << (8 * np.arange(SYMBOL)[::-1])).sum(axis=2) + LENGTH + 2
    table[:, -1] = n_one + 1
    keep = np.concatenate([n_one[:, None] > SYMBOL * np.arange(WIDE), np.ones((len(one), 1), bool)], axis=1)
    symbols = np.append(table[keep], 0)
    row_of = np.full(len(symbols), -1, np.int64)
    row_of[np.r_[0, np.cumsum(keep.sum(axis=1))[:-1]]] = np.arange(len(one))
    rows = row_of[np.array(suffix_array(symbols), np.int64)]
    rows = rows[rows >= 0]
    rank = np.empty(len(one), np.int64)
    rank[rows] = np.arange(len(one))
    return np.argsort(rank[back], kind="stable")


def smallest_sharing(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """By piece and place (bytes of a string before the seed), the smallest id with the same 50 bytes there.

    left: bytes before the seed, the nearest first. right: from the seed on. Both with zeros behind.
    """
    n = len(ids)
    best = np.full((n, SPAN), np.iinfo(np.int64).max, np.int64)
    if not n:
        return best
    order = _sorted_seeds(right, n_right)
    r, m = right[order], n_right[order]
    common = np.minimum(m[1:], m[:-1])
    differ = r[1:] != r[:-1]
    lcp = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1]), common)
    before = np.zeros(n, np.int64)
    for j in range(SPAN):
        if j:
            before = np.unique(before * 256 + left[:, j - 1], return_inverse=True)[1]
        need = LENGTH - j
        group = np.empty(n, np.int64)
        group[order] = np.r_[0, np.cumsum(lcp < need)]
        has = np.flatnonzero((n_left >= j) & (n_right >= need))
        if not len(has):
            continue
        key = group[has] * (int(before.max()) + 1) + before[has]
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(key[by]) != 0])
        least = np.minimum.reduceat(ids[has][by], new)
        best[has[by], j] = np.repeat(least, np.diff(np.r_[new, len(by)]))
    return best


_RECORD = np.dtype([("left", "u1", SPAN - 1), ("right", "u1", LENGTH), ("n_left", "u1"), ("n_right", "u1"), ("none", "u1", 2)])


def _digest(rows: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each row of bytes, eight at a time."""
    wide = -(-rows.shape[1] // 8) * 8
    if wide != rows.shape[1] or not rows.flags.c_contiguous:
        padded = np.zeros((len(rows), wide), np.uint8)
        padded[:, : rows.shape[1]] = rows
        rows = padded
    eights = rows.view(np.uint64)
    h = np.full(len(rows), np.uint64(wide)) if start is None else start.astype(np.uint64)
    for k in range(eights.shape[1]):
        h = C.mixed(h ^ eights[:, k])
    return h


def seeds_of(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the seeds in ascending order, the first and the last string that each stands for, and the seeds' hashes.

    The hashes are made of ``STEP`` strings at a time, so that they stay in a core's cache."""
    n = len(data) - LENGTH + 1
    whole = np.ones(max(n, 0), bool)  # strings that end in their own document
    past = start[1:, None] - np.arange(1, LENGTH)[None, :]
    whole[past[(past >= 0) & (past < n)]] = False
    found = []
    for at in range(0, n, STEP):
        inside = np.flatnonzero(whole[at : at + STEP])
        if not len(inside):
            continue
        seeds = C.runs_hash(C._TABLES[0][data[at : at + STEP + LENGTH - 1]], SEED)
        own = C.owners(seeds, SPAN)[inside]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        last = np.r_[first[1:], len(own)] - 1
        found.append((own[first] + at, inside[first] + at, inside[last] + at, seeds[own[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    place, lo, hi, value = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # a seed may go on in the next step
    return place[new], lo[new], hi[np.r_[new[1:], len(place)] - 1], value[new]


class _Pieces:
    """Seeds of a block, and after the first answers the pieces around those that other documents have too."""

    def __init__(self, b: C.Block, n_buckets: int, width: int, answers: dict[int, bytes] | None):
        self.block = b
        self.keys, self.records = None, None
        place, lo, hi, value = seeds_of(b.data, b.start)
        if not len(place):
            return
        ids = b.ids[np.searchsorted(b.start, place, side="right") - 1]
        by = np.argsort(value)
        new = np.r_[True, np.diff(value[by]) != 0]
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        edges = np.flatnonzero(new)
        twice = np.minimum.reduceat(ids[by], edges) != np.maximum.reduceat(ids[by], edges)
        self.keys = C.Keys(value[by][edges], twice, n_buckets, width)
        if answers is None:
            return
        got = self.keys.answers(answers, 2)[group]
        parts = []
        for hot in (False, True):
            at = np.flatnonzero((got & 1 > 0) & ((got & 2 > 0) == hot))
            for first, last in RANGES if hot else ((0, SPAN - 1),):
                a = np.maximum(lo[at], place[at] - last)
                z = np.minimum(hi[at], place[at] - first)
                ok = a <= z
                parts.append((at[ok], a[ok], z[ok], np.full(ok.sum(), first if hot else 0), np.full(ok.sum(), last if hot else -1)))
        at, lo, hi, first, last = (np.concatenate(x) for x in zip(*parts))
        self.lo, self.hi, self.place, self.ids = lo, hi, place[at], ids[at]
        rec = np.zeros(len(at), _RECORD)
        rec["n_left"], rec["n_right"] = self.place - lo, hi + LENGTH - self.place
        data = np.concatenate([np.zeros(SPAN, np.uint8), b.data, np.zeros(LENGTH, np.uint8)])
        back, on = np.arange(SPAN - 1), np.arange(LENGTH)
        for part in (slice(k, k + SLICE) for k in range(0, len(at), SLICE)):
            where, r = self.place[part, None] + SPAN, rec[part]
            rec["left"][part] = np.where(back[None, :] < r["n_left"][:, None], data[where - 1 - back[None, :]], 0)
            rec["right"][part] = np.where(on[None, :] < r["n_right"][:, None], data[where + on[None, :]], 0)
        # hot seeds: dealt by the bytes that every string of the range has
        deal = value[at].copy()
        for f, g in RANGES:
            hot = np.flatnonzero((first == f) & (last == g))
            if not len(hot):
                continue
            h = deal[hot] + np.uint64(f + 1)
            for i in range(f):
                h = C.mixed(h ^ rec["left"][hot, i].astype(np.uint64))
            for i in range(SEED, LENGTH - g):
                h = C.mixed(h + rec["right"][hot, i].astype(np.uint64))
            deal[hot] = h
        flat = np.ascontiguousarray(rec).view(np.uint8).reshape(len(rec), _RECORD.itemsize)
        digest = _digest(flat)
        key = np.lexsort((self.ids, digest, deal))
        if len(key):
            same = (digest[key][1:] == digest[key][:-1]) & (deal[key][1:] == deal[key][:-1]) & (flat[key][1:] == flat[key][:-1]).all(axis=1)
            new = np.r_[True, ~same]
        else:
            new = np.zeros(0, bool)
        self.group = np.empty(len(key), np.int64)
        self.group[key] = np.cumsum(new) - 1
        self.records, self.least = rec[key[new]], self.ids[key[new]]
        bucket = (deal[key[new]] % np.uint64(n_buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.bounds = np.searchsorted(bucket[self.order], np.arange(n_buckets + 1))


def _meeting(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Which pieces may share a string with another one: in some ``NEAR`` places, what all strings there have in common has a hash
    that another piece has too. Others share none, so the suffix arrays need not hold them."""
    out = np.zeros(len(left), bool)
    for first in range(0, SPAN, NEAR):
        least = LENGTH - min(first + NEAR, SPAN) + 1
        has = np.flatnonzero((n_left >= first) & (n_right >= least))
        h = _digest(np.concatenate([left[has, :first], right[has, :least]], axis=1))
        by = np.argsort(h)
        same = h[by][1:] == h[by][:-1]
        out[has[by[1:][same]]] = out[has[by[:-1][same]]] = True
    return out


_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(records: np.ndarray, ids: np.ndarray) -> bytes:
    raw = np.int64(len(records)).tobytes() + records.tobytes() + ids.tobytes()
    return np.int64(len(raw)).tobytes() + _ZSTD.compress(raw).to_pybytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _ZSTD.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.int64)[0])).to_pybytes()
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    return np.frombuffer(raw, _RECORD, n, 8), np.frombuffer(raw, np.int64, n, 8 + n * _RECORD.itemsize)


@C.freed
def _send_seeds(table: pa.Table, heads: pa.Table, n_buckets: int, width: int) -> pa.Table:
    if not table.num_rows:
        return C.sent(0, {})
    p = _Pieces(C.Rows(table, C.by_level(heads)).looked, n_buckets, width, None)
    return C.sent(table.column("block")[0].as_py(), p.keys.blobs() if p.keys is not None else {})


@C.freed
def _send_pieces(table: pa.Table, replies: pa.Table, n_buckets: int, width: int) -> pa.Table:
    if not table.num_rows:
        return C.sent(0, {})
    p = _Pieces(C.Rows(table, C.by_level(replies)).looked, n_buckets, width, C.replies_by_level(replies).get(0, {}))
    blobs = {}
    if p.records is not None:
        for b in np.flatnonzero(np.diff(p.bounds)):
            at = p.order[p.bounds[b] : p.bounds[b + 1]]
            blobs[int(b)] = _packed(p.records[at], p.least[at])
    return C.sent(table.column("block")[0].as_py(), blobs)


@C.freed
def _decide(table: pa.Table) -> pa.Table:
    """A bit for each piece and place of a bucket: a smaller id has the same 50 bytes."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_pylist()
    got = [_unpacked(x.as_buffer().to_pybytes()) for x in table.column("blob")]
    rec, ids = np.concatenate([r for r, _ in got]), np.concatenate([i for _, i in got])
    flat = np.ascontiguousarray(rec).view(f"V{_RECORD.itemsize}")
    one, back = np.unique(flat, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, back, ids)
    one = one.view(_RECORD)
    n_left, n_right = one["n_left"].astype(np.int64), one["n_right"].astype(np.int64)
    places = np.arange(SPAN)
    best = np.where((places <= n_left[:, None]) & (LENGTH - places <= n_right[:, None]), least[:, None], np.iinfo(np.int64).max)
    with_others = np.flatnonzero(_meeting(one["left"], one["right"], n_left, n_right))
    at = one[with_others]
    best[with_others] = smallest_sharing(at["left"], at["right"], n_left[with_others], n_right[with_others], least[with_others])
    gone = best[back] < ids[:, None]
    bits = np.packbits(gone, axis=1)
    out, at = {}, 0
    for b, (r, _) in zip(blocks, got):
        out[b] = bits[at : at + len(r)].tobytes()
        at += len(r)
    return C.replied(1, bucket, out)


@C.freed
def _cut(table: pa.Table, replies: pa.Table, n_buckets: int, width: int) -> pa.Table:
    by = C.replies_by_level(replies)
    rows = C.Rows(table, C.by_level(replies))
    b, p = rows.block, _Pieces(rows.looked, n_buckets, width, by.get(0, {}))
    edge = np.zeros(len(p.block.data) + 1, np.int32)
    if p.records is not None and len(p.records):
        gone = np.zeros((len(p.records), SPAN), bool)
        for bucket, blob in by.get(1, {}).items():
            at = p.order[p.bounds[bucket] : p.bounds[bucket + 1]]
            gone[at] = np.unpackbits(np.frombuffer(blob, np.uint8).reshape(len(at), -1), axis=1, count=SPAN)
        for part in (slice(k, k + SLICE) for k in range(0, len(p.ids), SLICE)):
            mine = gone[p.group[part]] | (p.ids[part] > p.least[p.group[part]])[:, None]
            where = p.place[part, None] - np.arange(SPAN)[None, :]
            mine &= (where >= p.lo[part, None]) & (where <= p.hi[part, None])
            starts = where[mine]  # each string once: it has one seed, and one range of places
            edge[starts] += 1
            edge[starts + LENGTH] -= 1
    keep_of = np.cumsum(edge[:-1], dtype=np.int32) == 0
    size = np.diff(b.start)
    keep = np.repeat(size < LENGTH, size)  # a row that isn't looked at repeats the text of a smaller id
    for i in np.flatnonzero(rows.same >= 0).tolist():
        k = rows.same[i]
        keep[b.start[i] : b.start[i + 1]] = keep_of[p.block.start[k] : p.block.start[k + 1]]
    lone = ~keep
    runs = lone.copy()
    runs[1:] &= keep[:-1]
    heads = b.start[:-1][size > 0]
    runs[heads] = lone[heads]
    count = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), b.start))
    texts = [b.data[s:e][keep[s:e]].tobytes() for s, e in zip(b.start[:-1].tolist(), b.start[1:].tolist())]
    columns = [b.id_column(), pa.array(size, pa.int64()), pa.array(count(lone), pa.int64()), pa.array(count(runs), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array(texts, pa.binary())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    if "carried" in table.column_names:
        columns.append(table.column("carried").combine_chunks().take(pa.array(b.order)))
        names.append("carried")
    return pa.Table.from_arrays(columns, names=names)


def sizes(n_bytes: int) -> tuple[int, int]:
    """Numbers of blocks and of buckets."""
    grown = min(GROWN, max(1.0, n_bytes / BLOCK / FEW))
    return C.block_count(n_bytes, int(BLOCK * grown)), C.block_count(n_bytes, int(BUCKET * grown))


def suffix_array_dedup(docs: DataFrame, n_blocks: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every row of ``docs`` (doc_id, text).

    carry: names of columns that come back with each row, as the struct ``carried``.
    """
    n_bytes = C.text_bytes(docs)
    n_made, n_buckets = sizes(n_bytes)
    n_blocks, width = n_blocks or n_made, C.key_bytes(n_bytes)
    blocks, heads = C.in_blocks(docs, n_blocks, carry)
    schema = T.StructType([*T.StructType.fromDDL(SCHEMA).fields, *([blocks.schema["carried"]] if carry else [])])
    none = F.lit(None)
    heads = heads.select("block", "level", none.cast("int").alias("bucket"), none.cast("binary").alias("blob"), "key")
    whole = lambda df: df.withColumn("key", none.cast("long"))
    with_replies = lambda replies: blocks.groupBy("block").cogroup(replies.groupBy("block"))
    seeds = with_replies(heads).applyInArrow(lambda t, r: _send_seeds(t, r, n_buckets, width), C.EXCHANGE)
    shared = heads.unionByName(whole(C.answered(seeds, n_buckets, 0, width, HOT_BLOCKS)))
    pieces = with_replies(shared).applyInArrow(lambda t, r: _send_pieces(t, r, n_buckets, width), C.EXCHANGE)
    gone = pieces.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _decide(t), C.REPLY)
    return with_replies(shared.unionByName(whole(gone))).applyInArrow(lambda t, r: _cut(t, r, n_buckets, width), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with what ``suffix_array_dedup`` keeps as the text and its length as n_chars if there is one.

    A cut inside a character leaves bytes that are no UTF-8; they go too. A text that is null stays null.
    """
    out = suffix_array_dedup(docs, carry=docs.columns)
    kept = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    kept = F.when(F.col("carried.text").isNull(), F.lit(None).cast("string")).when(F.col("n_removed") == 0, F.col("carried.text")).otherwise(kept)
    rows = out.select("carried", kept.alias("kept"))
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[(made[c] if c in made else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])
