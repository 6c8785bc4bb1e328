"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Words of the corpus that occur most (counted over all documents) are encoded once on the driver and compiled into a minimal
acyclic automaton: equal suffixes share states, and numbers on the arcs add up to a word's place in the table of id outputs.
The arrays go to every executor as one file that is memory-mapped, so its pages are shared by the workers. A block's distinct
words walk through the automaton together, a byte a step. A word outside the lexicon is merged exactly, rank by rank. Either
way the ids are those of the tokenizer's file. Decoding looks every id's bytes up in one flat table.

A null text is empty. Any text, of any length, with any characters is encoded whole. Repeated rows are encoded alike, rows keep
their doc_id (also null), an empty table gives no rows, and extra columns don't matter.
"""

from __future__ import annotations

import atexit
import json
import mmap
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common as C

#: Entries of the lexicon, and words that one partition reports for it.
LEXICON, REPORTED = 131072, 32768
#: Bytes of the longest word in the lexicon, and bytes that a worker keeps for words merged before.
LONGEST, MERGED_BYTES = 64, 96 << 20
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
#: The published split of byte-level BPE: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The published mapping of bytes to printable characters: printable Latin-1 stands for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Exact merging by rank, from the tokenizer's file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda t: bytes(back[c] for c in t)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.single = [self.ids.get(bytes([b]), -1) for b in range(256)]
        #: By pair of ids (the first 2**20 times) its rank, and by rank the id that it makes.
        self.rank = {self.ids[raw(a)] << 20 | self.ids[raw(b)]: k for k, (a, b) in enumerate(pairs)}
        self.made = [self.ids[raw(a) + raw(b)] for a, b in pairs]

    def merge(self, word: bytes) -> list[int]:
        """The pair with the lowest rank, the leftmost of equals, is merged until no pair has one. A merge changes two pairs only."""
        ids = [self.single[b] for b in word]
        if len(ids) > 256:
            return self._merge_long(ids)
        get, none = self.rank.get, len(self.made)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            new = self.made[best]
            ids[at : at + 2] = [new]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, none)
            if at < len(ranks):
                ranks[at] = get(new << 20 | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links: n log n for very long words."""
        import heapq

        n, get = len(ids), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := get(ids[x] << 20 | ids[after[x]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return [ids[i] for i in range(n) if alive[i]]


def compile_lexicon(words: list[bytes], outputs: list[list[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of sorted distinct ``words``: states with the same right language are one state.

    Arrays: arcs of state s are first[s] .. first[s + 1] - 1, each with a byte, a target and a count of the words that come
    before through the state; ends tells if a word ends in a state. The counts on a path sum to the word's place.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of the last word: ends, arcs

    def close(to: int) -> None:
        while len(path) > to:
            ends, arcs = path.pop()
            key = (ends, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same + 1)
        for byte in word[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(1)
    states.append((path[0][0], tuple(path[0][1])))
    size = []
    for ends, arcs in states:
        size.append(int(ends) + sum(size[t] for _, t in arcs))
    first = np.zeros(len(states) + 1, np.int32)
    label, target, skip = [], [], []
    for s, (ends, arcs) in enumerate(states):
        n = int(ends)
        for byte, t in arcs:
            label.append(byte)
            target.append(t)
            skip.append(n)
            n += size[t]
        first[s + 1] = len(label)
    flat = np.array([i for ids in outputs for i in ids], np.uint32)
    return {"first": first, "label": np.array(label, np.uint8), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32), "ends": np.array([e for e, _ in states], np.uint8), "out": np.r_[0, np.cumsum([len(x) for x in outputs])].astype(np.int32), "ids": flat}


class Lexicon:
    """The memory-mapped automaton. Arcs are kept by state and byte, so an arc is found by bisection, for many words at once."""

    NAMES = {"arcs": np.int64, "target": np.int32, "skip": np.int32, "ends": np.uint8, "out": np.int32, "ids": np.uint32}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, 2 * len(self.NAMES))
        for k, (name, kind) in enumerate(self.NAMES.items()):
            setattr(self, name, np.frombuffer(self.map, kind, int(head[2 * k + 1]), int(head[2 * k])))

    @classmethod
    def write(cls, arrays: dict[str, np.ndarray], path: str) -> None:
        state = np.repeat(np.arange(len(arrays["ends"])), np.diff(arrays["first"]))
        arrays = {**arrays, "arcs": state * 256 + arrays["label"]}
        at, head, body = 16 * len(cls.NAMES), [], []
        for name, kind in cls.NAMES.items():
            raw = np.ascontiguousarray(arrays[name], kind).tobytes()
            head += [at, len(arrays[name])]
            body.append(raw + b"\0" * (-len(raw) % 8))
            at += len(body[-1])
        with open(path, "wb") as f:
            f.write(np.array(head, np.int64).tobytes() + b"".join(body))

    def places(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word (bytes begin .. end of ``data``) in the table of outputs, -1 for words that are not there."""
        found, place = np.full(len(begin), -1, np.int64), np.zeros(len(begin), np.int64)
        state = np.full(len(begin), len(self.ends) - 1, np.int64)
        on, at = np.flatnonzero(end - begin <= LONGEST), 0
        while len(on):
            over = end[on] - begin[on] == at
            last = on[over]
            here = last[self.ends[state[last]] > 0]
            found[here] = place[here]
            on = on[~over]
            if not len(on) or not len(self.arcs):
                break
            wanted = state[on] * 256 + data[begin[on] + at]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            goes = self.arcs[arc] == wanted
            on, arc = on[goes], arc[goes]
            place[on] += self.skip[arc]
            state[on] = self.target[arc]
            at += 1
        return found


def _table(*pairs: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, z in pairs:
        out[a : z + 1] = True
    return out


# White space as UTF-8, letters and marks of ASCII: fixed values of Unicode.
_SPACES, _SINGLE, _C2, _E280 = _table((9, 13), (32, 32)), _table((9, 13)), _table((0x85, 0x85), (0xA0, 0xA0)), _table((0x80, 0x8A), (0xA8, 0xA9), (0xAF, 0xAF))
_LETTERS, _MARKS = _table((65, 90), (97, 122)), _table((33, 47), (58, 64), (91, 96), (123, 126))


def piece_starts(block: C.Block) -> np.ndarray:
    """Where the pieces of a block begin: at each document, and at places where every match of the published split ends.

    These are: before white space that follows anything else; between a letter (ASCII, or two bytes of Latin-1) and an ASCII mark;
    behind a single line break or tab between two other characters. A space beyond ASCII ends no piece and lets none begin.
    """
    d = block.data
    n = len(d)
    edge = np.zeros(n + 1, bool)
    edge[block.start] = True
    if n < 2:
        return np.flatnonzero(edge[:n])
    inner = ~edge[1:n]  # between d[:-1] and d[1:] of one document
    back = lambda at, k: d[np.maximum(at - k, 0)]

    def ends_wide(at: np.ndarray) -> np.ndarray:
        """Whether a space beyond ASCII ends before ``at``."""
        a, b, c = back(at, 3), back(at, 2), back(at, 1)
        return ((b == 0xC2) & _C2[c]) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x80) & _E280[c]) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))

    space = _SPACES[d]
    run = np.flatnonzero(space[1:] & ~space[:-1] & inner) + 1
    high = np.flatnonzero(back(run, 1) >= 0x80)
    wide = np.zeros(len(run), bool)
    wide[high] = ends_wide(run[high])
    run = run[~wide]
    edge[run] = True
    # a single break: the character behind it is no space of any kind (a lead byte that could begin one does not count)
    one = run[_SINGLE[d[run]] & (run + 1 < n)]
    nxt = d[np.minimum(one + 1, n - 1)]
    one = one[~edge[one + 1] & ~_SPACES[nxt] & ~np.isin(nxt, (0xC2, 0xE1, 0xE2, 0xE3))]
    edge[one + 1] = True
    mark = np.flatnonzero(_MARKS[d[1:]] & inner) + 1
    latin = (back(mark, 2) == 0xC3) & (back(mark, 1) != 0x97) & (back(mark, 1) != 0xB7) & (back(mark, 1) >= 0x80)
    edge[mark[_LETTERS[back(mark, 1)] | latin]] = True
    return np.flatnonzero(edge[:n])


def _distinct(block: C.Block, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By piece the number of its text among the distinct ones, and their bytes end to end with offsets."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.append(starts, len(block.data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(block.data)])
    coded = pieces.dictionary_encode()
    words = coded.dictionary
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.asarray(coded.indices).astype(np.int64), np.frombuffer(words.buffers()[2], np.uint8), bounds


def frequent_words(docs: DataFrame, size: int = LEXICON, reported: int = REPORTED) -> list[bytes]:
    """Words (pieces between blanks, with the blank before them) that occur most in all documents. A partition reports its
    ``reported`` commonest; what falls below costs speed only."""

    def counted(batches):
        kept = pa.table({"word": pa.array([], pa.large_binary()), "n": pa.array([], pa.int64())})
        for table in C.cut_batches(batches):
            block = C.Block(table)
            piece, data, bounds = _distinct(block, piece_starts(block))
            n = np.bincount(piece, minlength=len(bounds) - 1)
            often = np.flatnonzero((n > 1) & (np.diff(bounds) <= LONGEST))
            words = pa.array([data[a:z].tobytes() for a, z in zip(bounds[often].tolist(), bounds[often + 1].tolist())], pa.large_binary())
            kept = pa.concat_tables([kept, pa.table({"word": words, "n": pa.array(n[often], pa.int64())})])
            if kept.num_rows > 32 * reported:
                kept = _commonest(kept, 8 * reported)
        kept = _commonest(kept, reported)
        yield pa.RecordBatch.from_arrays([kept.column("word").combine_chunks().cast(pa.binary()), kept.column("n").combine_chunks()], names=["word", "n"])

    source = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = source.mapInArrow(counted, "word binary, n long")
    best = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return sorted(best.select("word").toArrow().column("word").to_pylist())


def _commonest(words: pa.Table, most: int) -> pa.Table:
    summed = words.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
    return summed.take(pc.select_k_unstable(summed, k=min(most, summed.num_rows), sort_keys=[("n", "descending"), ("word", "ascending")])) if summed.num_rows else summed


class Encoder:
    """One worker's automaton and merger, and the ids of short words that were merged lately (bounded by their bytes)."""

    def __init__(self, lexicon: Lexicon, merger: Merger, most: int = MERGED_BYTES):
        self.lexicon, self.merger, self.most = lexicon, merger, most
        self.split, self.merged, self.held = regex.compile(SPLIT), {}, 0
        top = max(merger.bytes) + 1
        table = [merger.bytes.get(i, b"") for i in range(top)]
        self.letters, self.at = np.frombuffer(b"".join(table), np.uint8), np.r_[0, np.cumsum([len(x) for x in table])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(merger.special, key=len, reverse=True)))) if merger.special else None

    def ids_of(self, word: bytes) -> bytes:
        """The ids, four bytes each, of a word that the lexicon doesn't have."""
        found = self.merged.get(word)
        if found is not None:
            return found
        ids = np.array(self.plain(word.decode()), np.uint32).tobytes()
        if len(word) <= LONGEST:
            self.held += len(word) + len(ids) + 200
            if self.held > self.most:
                self.merged.clear()
                self.held = 0
            self.merged[word] = ids
        return ids

    def with_special(self, text: str) -> list[int]:
        """A text in which the names of special tokens stand."""
        ids, at = [], 0
        for m in self.special.finditer(text):
            ids += self.plain(text[at : m.start()]) + [self.merger.special[m.group()]]
            at = m.end()
        return ids + self.plain(text[at:])

    def plain(self, text: str) -> list[int]:
        return [i for w in self.split.findall(text) for i in self.merger.merge(w.encode())]

    def encoded(self, block: C.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents end to end, and where each document's begin."""
        starts = piece_starts(block)
        piece, data, bounds = _distinct(block, starts)
        n_words = len(bounds) - 1
        places = self.lexicon.places(data, bounds[:-1], bounds[1:])
        known, other = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
        merged = [self.ids_of(data[a:z].tobytes()) for a, z in zip(bounds[other].tolist(), bounds[other + 1].tolist())]
        size, at = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        out = self.lexicon.out.astype(np.int64)
        at[known], size[known] = out[places[known]], out[places[known] + 1] - out[places[known]]
        size[other] = [len(x) // 4 for x in merged]
        at[other] = len(self.lexicon.ids) + np.r_[0, np.cumsum(size[other])[:-1]][: len(other)]
        source = np.concatenate([self.lexicon.ids, np.frombuffer(b"".join(merged), np.uint32)])
        ids, first = _gathered(source, at[piece], size[piece])
        return ids, first[np.searchsorted(starts, block.start)]

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin."""
        return _gathered(self.letters, self.at[ids], self.at[ids.astype(np.int64) + 1] - self.at[ids])


def _gathered(source: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``source`` that begin at ``at``, end to end, and where each begins (with the total at the end)."""
    first = np.r_[0, np.cumsum(size)]
    return source[np.repeat(at - first[:-1], size) + np.arange(first[-1])], first


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    bounds = np.ascontiguousarray(bounds, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def encoded_batch(table: pa.Table, encoder: Encoder) -> pa.RecordBatch:
    """doc_id, n_tokens, ids, decoded of the rows of a table, in the order of a block."""
    block = C.Block(table)
    ids, first = encoder.encoded(block)
    if encoder.special is not None:
        raw = block.data.tobytes()
        names = [n.encode() for n in encoder.merger.special]
        if any(n in raw for n in names):
            parts = [ids[a:z] for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
            for i, (a, z) in enumerate(zip(block.start[:-1].tolist(), block.start[1:].tolist())):
                if any(n in raw[a:z] for n in names):
                    parts[i] = np.array(encoder.with_special(raw[a:z].decode()), np.uint32)
            ids, first = np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
    letters, at = encoder.decoded(ids)
    texts = _binary(letters, at[first])
    try:
        texts = texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
    return pa.RecordBatch.from_arrays([block.id_column(), pa.array(np.diff(first), pa.int64()), _binary(ids.astype("<u4").view(np.uint8), 4 * first).cast(pa.binary()), texts], names=["doc_id", "n_tokens", "ids", "decoded"])


#: One worker's encoder, kept between its tasks.
_KNOWN: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, tokenizer_path: str, lexicon_size: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    encoder = Encoder(None, Merger(json.loads(raw)))
    words = frequent_words(docs, lexicon_size)
    folder = tempfile.mkdtemp(prefix="corvane-lexicon-")
    atexit.register(shutil.rmtree, folder, True)
    name = f"lexicon-{os.path.basename(folder)}.bin"
    Lexicon.write(compile_lexicon(words, [encoder.plain(w.decode()) for w in words]), f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")  # a few MB: at most ``lexicon_size`` words; executors fetch it from the driver
    spec = spark.sparkContext.broadcast(raw)  # the vocabulary file: its size doesn't depend on the data

    def encoded(batches):
        if name not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[name] = Encoder(Lexicon(SparkFiles.get(name)), Merger(json.loads(spec.value)))
        for table in C.cut_batches(batches):
            yield encoded_batch(table, _KNOWN[name])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(encoded, ENCODED)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
