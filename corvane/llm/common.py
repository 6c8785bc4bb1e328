"""What the operators share: sizes, written tables, gapless ranks and Arrow blocks."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of text that one block (one Python call) holds; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Words are maximal runs of anything but ASCII white space.
WORD_BREAK = "[ \\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def block_count(n_bytes: int, size: int = BLOCK_BYTES) -> int:
    """Blocks follow the bytes alone, never the number of partitions."""
    return max(1, -(-n_bytes // size))


def row_id() -> Column:
    """The id of a row in orders: a null id is larger than any other."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def in_blocks(docs: DataFrame, n_blocks: int, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows in blocks, and the heads of their groups of equal texts.

    Rows: doc_id, text, ``row`` (a hash of id and text) and the block that it falls in, so any key, source or group of copies
    spreads over all blocks. carry: columns that come along as the struct ``carried``, for operators that give rows back whole.
    Heads: the smallest id of each text, as ``key`` (its ``row``) and block; ``level`` -2 if the text has more rows, else -1.
    Texts are told apart by 128 bits; the groups are counted by Spark before anything is exchanged.
    """
    text = F.col("text").cast("string")
    marks = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    row = F.xxhash64("h1", "h2", "id")
    block = lambda key: F.pmod(F.col(key), F.lit(n_blocks)).cast("int").alias("block")
    heads = docs.select(row_id().alias("id"), *marks).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    heads = heads.select(row.alias("key"), F.when(F.col("n") > 1, -2).otherwise(-1).alias("level")).select(block("key"), "level", "key")
    whole = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *marks, row_id().alias("id"), *whole)
    rows = rows.select("doc_id", "text", row.alias("row"), *(["carried"] if carry else [])).withColumn("block", block("row"))
    return rows.repartition(n_blocks, "block"), heads


def ranked(df: DataFrame, group: str, order: list[Column], sub: Column, n_sub: int, name: str = "slot") -> DataFrame:
    """A gapless rank from 0 within ``group`` in the order (sub, *order).

    ``sub`` is in 0 .. n_sub - 1 and splits every group, so that a group with most of the rows has no task of its own.
    The offsets table has groups x n_sub rows at most, groups being few (shards or length buckets).
    """
    df = df.withColumn("_sub", sub)
    before = Window.partitionBy(group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(group, "_sub").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(group, "_sub").orderBy(*order)) - 1
    out = df.withColumn("_rank", inner).join(F.broadcast(offsets), [group, "_sub"])
    return out.withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_sub", "_rank", "_before")


class Block:
    """The documents of one block in the order of (id, text): ids (null: the largest), UTF-8 bytes end to end, offsets."""

    def __init__(self, table: pa.Table):
        ids, text = table.column("doc_id").combine_chunks(), table.column("text").combine_chunks()
        text = pa.array([], pa.string()) if isinstance(text, pa.ChunkedArray) and not text.num_chunks else text
        plain = np.asarray(ids.fill_null(np.iinfo(np.int64).max)).astype(np.int64)
        raw = text.fill_null("").cast(pa.large_binary())
        order = np.argsort(plain, kind="stable")
        if len(plain) > 1 and (np.diff(plain[order]) == 0).any():  # repeated ids: the text decides, so that every pass sees one order
            blobs = raw.to_pylist()
            order = np.array(sorted(range(len(plain)), key=lambda i: (plain[i], blobs[i])))
        raw = raw.take(pa.array(order))
        self.order = order
        self.null_id = np.asarray(ids.is_null())[order]
        self.ids = plain[order]
        self.n = len(order)
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = raw.buffers()[2] if self.n else None
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.start = (offsets - offsets[0]).astype(np.int64)

    def taken(self, at: np.ndarray) -> Block:
        """The block of the rows ``at`` (ascending)."""
        out = object.__new__(Block)
        out.order, out.null_id, out.ids, out.n = at, self.null_id[at], self.ids[at], len(at)
        size = np.diff(self.start)
        out.start = np.r_[0, np.cumsum(size[at])].astype(np.int64)
        if len(at) == self.n:
            out.data = self.data
        else:
            wanted = np.zeros(self.n, bool)
            wanted[at] = True
            out.data = self.data[np.repeat(wanted, size)]
        return out

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null_id)


def cut_batches(batches):
    """Tables of at most ``BLOCK_BYTES`` of text each, from Arrow batches of whole rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.cumsum(np.asarray(pc.binary_length(table.column("text")).fill_null(0)), dtype=np.int64)
        at = 0
        while at < table.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES)))
            yield table.slice(at, to - at)
            at = to
    trim()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_TABLES = np.random.default_rng(20240607).integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def runs_hash(values: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of all runs of ``length`` values; by doubling, without a loop over positions.

    For filters only: runs built to collide do, so what decides uses ``windows_hash`` or the values themselves."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    n, power, span, acc, done, level = len(values) - length + 1, base, 1, None, 0, values
    while True:
        if length & span:
            piece = level[done : done + n] if acc is not None else level[:n]
            acc = piece.copy() if acc is None else acc * np.uint64(pow(base, span, 1 << 64)) + piece
            done += span
        span *= 2
        if span > length:
            return mixed(acc)
        level = level[: len(level) - span // 2] * np.uint64(power) + level[span // 2 :]
        power = power * power % (1 << 64)


def owners(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` keys the place of its smallest key, the leftmost of equals. It depends on the window alone."""
    packed = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[: len(packed) - span], packed[span:])
        span *= 2
    if span < width:
        packed = np.minimum(packed[: len(packed) - (width - span)], packed[width - span :])
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def windows_hash(values: np.ndarray, length: int, longest: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of all runs of ``length`` values by doubling: a run is the mixed pair of two runs of half its length, or for other
    lengths of the two longest that begin and end it. longest: runs of powers of two that were made before, and room for more."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    made = {1: values} if longest is None else longest
    made.setdefault(1, values)
    span = 1
    while span * 2 <= length:
        if span * 2 not in made:
            half = made[span]
            made[span * 2] = mixed(half[:-span] * np.uint64(_BASE) + half[span:])
        span *= 2
    if span == length:
        return made[span]
    rest = length - span
    return mixed(made[span][:-rest] * np.uint64(0xD1342543DE82EF95) + made[span][rest:])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each document (with the total at the end)."""
    n = len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
    blank = _BLANK[block.data]
    edges = [np.flatnonzero(blank[1:] != blank[:-1]) + 1]
    if not blank[0]:
        edges.insert(0, np.zeros(1, np.int64))
    if not blank[-1]:
        edges.append(np.full(1, n))
    cuts = np.unique(block.start)
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[~(blank[cuts - 1] | blank[cuts])]  # a word ends where its document ends
    edge = np.concatenate(edges)
    if len(cuts):
        edge = np.sort(np.concatenate([edge, cuts, cuts]), kind="stable")
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, block.start)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def word_hashes(block: Block, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight at a time, each eight mixed into what came before. lower: with A-Z as a-z.

    The two hashes (``which``) share no collisions but by chance. Words over 256 bytes are hashed one by one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = _LOWER[block.data] if lower else block.data
    padded = np.zeros(-(-len(data) // 8) * 8 + 16, np.uint8)
    padded[: len(data)] = data
    eights = padded.view(np.uint64)
    size = ends - starts

    def lane(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        shift = (8 * (at & 7)).astype(np.uint64)
        place = at >> 3
        value = eights[place] >> shift
        value |= (eights[place + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return value & _MASKS[np.minimum(left, 8)]

    h = mixed((size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(_SEEDS[which])) ^ lane(starts, size))
    more = np.flatnonzero((size > 8) & (size <= 256))
    done = 8
    while len(more):
        h[more] = mixed(h[more] ^ lane(starts[more] + done, size[more] - done))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > 256).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([which + 1])).digest(), "little")
    return h


def freed(function):
    """``function``; then what it has allocated goes back to the system, so that an idle worker holds little."""

    @functools.wraps(function)
    def wrapped(*args):
        try:
            return function(*args)
        finally:
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # only glibc has it
except (OSError, AttributeError):
    _LIBC = None


class Rows:
    """The rows of a block, and those among them whose text has to be looked at: one for each text that has its head here.

    All other rows share their result (``same``: by row the place of the row that is looked at) or repeat a text of a smaller id.
    """

    def __init__(self, table: pa.Table, heads: dict[int, np.ndarray]):
        self.block = Block(table)
        row = np.asarray(table.column("row")).astype(np.int64)[self.block.order]
        many = np.isin(row, heads.get(-2, _NO_KEYS))
        head = many | np.isin(row, heads.get(-1, _NO_KEYS))
        at = np.flatnonzero(head)
        _, first, back = np.unique(row[at], return_index=True, return_inverse=True)
        kept = np.sort(first)
        self.at = at[kept]
        self.same = np.full(self.block.n, -1, np.int64)
        self.same[at] = np.searchsorted(kept, first[back])
        self.many = many[self.at]
        self.looked = self.block.taken(self.at)


_NO_KEYS = np.zeros(0, np.int64)


def by_level(table: pa.Table | None) -> dict[int, np.ndarray]:
    """The keys that came back for a block, sorted, by level."""
    if table is None or not table.num_rows:
        return {}
    table = table.filter(pc.is_valid(table.column("key")))
    level, key = np.asarray(table.column("level")), np.asarray(table.column("key")).astype(np.int64)
    return {int(k): np.sort(key[level == k]) for k in np.unique(level)}


EXCHANGE = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("blob", T.BinaryType())])
REPLY = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())])
_EXCHANGE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
_REPLY = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def sent(block: int, blobs: dict[int, bytes]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(blobs), pa.int32()), pa.array([block] * len(blobs), pa.int32()), pa.array(list(blobs.values()), pa.binary())], schema=_EXCHANGE)


def replied(level: int, bucket: int, blobs: dict[int, bytes]) -> pa.Table:
    n = len(blobs)
    return pa.Table.from_arrays([pa.array(list(blobs), pa.int32()), pa.array([level] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(list(blobs.values()), pa.binary())], schema=_REPLY)


def key_bytes(n_bytes: int) -> int:
    """Bytes of a hash that sorts out: 64 times as many values as the text has bytes, five bytes at least and eight at most."""
    return min(8, max(5, -(-(max(1, n_bytes).bit_length() + 6) // 8)))


class Keys:
    """The distinct keys of one block, dealt over buckets: what is sent, and where an answer for a key is found.

    ``flags`` marks keys that the block itself already holds twice.
    """

    def __init__(self, keys: np.ndarray, twice: np.ndarray, n_buckets: int, width: int):
        """keys: sorted and distinct 64-bit values; width: bytes of a key that are sent."""
        bucket = (keys % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)  # 16 bits are sorted faster
        self.order = np.argsort(bucket, kind="stable")
        self.bounds = np.searchsorted(bucket[self.order], np.arange(n_buckets + 1))
        self.keys, self.twice, self.width = keys, twice, width

    def blobs(self, second: np.ndarray | None = None) -> dict[int, bytes]:
        sent_keys = mixed(self.keys)
        body = ((sent_keys & ~np.uint64(1)) | self.twice.astype(np.uint64))[self.order]
        raw = body.view(np.uint8).reshape(-1, 8)[:, : min(8, self.width)]
        if second is not None:
            raw = np.concatenate([raw, second[self.order].view(np.uint8).reshape(-1, 8)], axis=1)
        raw = np.ascontiguousarray(raw)
        return {int(b): raw[self.bounds[b] : self.bounds[b + 1]].tobytes() for b in np.flatnonzero(np.diff(self.bounds))}

    def answers(self, replies: dict[int, bytes], bits: int = 1) -> np.ndarray:
        """By key, 0 .. 2**bits - 1."""
        out = np.zeros(len(self.keys), np.uint8)
        for b, blob in replies.items():
            at = self.order[self.bounds[b] : self.bounds[b + 1]]
            got = np.unpackbits(np.frombuffer(blob, np.uint8), count=bits * len(at)).reshape(bits, -1)
            out[at] = sum(got[i] << i for i in range(bits))
        return out


@freed
def repeats_in_bucket(table: pa.Table, level: int, width: int, hot: int) -> pa.Table:
    """Which keys of a bucket more than one block holds, or one block twice (bit 0), and more than ``hot`` blocks (bit 1)."""
    bucket = table.column("bucket")[0].as_py()
    order = np.argsort(np.asarray(table.column("block")), kind="stable")
    blocks = np.asarray(table.column("block"))[order]
    blobs = [table.column("blob")[int(i)].as_buffer() for i in order]
    counts = [len(b) // width for b in blobs]
    raw = np.concatenate([np.frombuffer(b, np.uint8) for b in blobs]).reshape(-1, width)
    low = np.zeros((len(raw), 8), np.uint8)
    low[:, : min(8, width)] = raw[:, : min(8, width)]
    key = low.view(np.uint64)[:, 0]
    flag = (key & np.uint64(1)).astype(bool)
    key = key & ~np.uint64(1)
    if width > 8:
        key2 = np.ascontiguousarray(raw[:, 8:16]).view(np.uint64)[:, 0]
        by = np.lexsort((key2, key))
        new = np.r_[True, (np.diff(key[by]) != 0) | (np.diff(key2[by]) != 0)]
    else:
        by = np.argsort(key, kind="stable")
        new = np.r_[True, np.diff(key[by]) != 0]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    any_flag = np.bincount(group, weights=flag[by]) > 0
    multi, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
    multi[by] = ((size > 1) | any_flag)[group]
    many[by] = (size > hot)[group]
    out, at = {}, 0
    for b, n in zip(blocks.tolist(), counts):
        out[b] = np.packbits(np.concatenate([multi[at : at + n], many[at : at + n]])).tobytes()
        at += n
    return replied(level, bucket, out)


def replies_by_level(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    table = table.filter(pc.greater_equal(table.column("level"), 0))
    for level, bucket, blob in zip(table.column("level").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist()):
        out.setdefault(level, {})[bucket] = blob
    return out


def answered(keys: DataFrame, n_buckets: int, level: int, width: int, hot: int = 1 << 62) -> DataFrame:
    return keys.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: repeats_in_bucket(t, level, width, hot), REPLY)


def arrow_column(function, kind: str):
    """A column function over Arrow arrays."""

    def column(text: pa.Array) -> pa.Array:
        return function(text)

    return F.arrow_udf(column, kind)
