"""Substring dedup by level-wise doubling over word windows.

Level 8: of every window of ``length`` words the 8-word part with the smallest hash stands for it (a choice that depends on the
words of the window alone), and only these parts are counted. Windows whose part is repeated are extended to 16 words and
counted by their 16-word part with the smallest hash, the repeated ones to 32, and so on, until ``length`` is reached, where
every window counts itself; no level looks at a window whose shorter part was alone. When no window survives, nothing is sent.

A level is one exchange of plain rows: each block of documents sends its distinct keys (64 bits, 128 at the last level, which
decides), Spark counts them by key, and the blocks get back the shorter list: at level 8 the repeated keys, later the lone ones.
Rows follow the words, never blocks times buckets. A text that occurs in many rows sends its windows once, counted twice.

Nulls: a null text has no words; a null id is a document like any other. Repeated rows are documents of their own, so the rows
of a repeated text lose their windows in every copy (ties: no copy is preferred). Texts under ``length`` words keep all words.
A text of any length is read whole, as a part of one block. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import common as C

FIRST = 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
KEYS = "key long, second long, block int, n int"
_KEYS = pa.schema([("key", pa.int64()), ("second", pa.int64()), ("block", pa.int32()), ("n", pa.int32())])


def levels(length: int) -> list[int]:
    out = [FIRST]
    while out[-1] * 2 < length:
        out.append(out[-1] * 2)
    return out + [length]


class _Windows:
    """The windows of a block that have survived the levels answered so far, and their distinct keys at the next one."""

    def __init__(self, rows: C.Rows, length: int, answered: dict[int, np.ndarray], n_answered: int):
        b = rows.looked
        self.starts, self.ends, self.first = C.words_of(b)
        n, per = len(self.starts), np.diff(self.first)
        last = np.repeat(self.first[1:], per)
        at = np.flatnonzero(np.arange(n) + length <= last)
        many = np.repeat(rows.many, per)
        self.keys = self.second = self.n = None
        steps = levels(length)
        if len(at):
            hashes = C.word_hashes(b, self.starts, self.ends)
            made: dict[int, np.ndarray] = {}
        for k, size in enumerate(steps):
            if not len(at):
                break
            values = C.windows_hash(hashes, size, made)
            if size < length:
                owner = C.owners(values, length - size + 1)[at]
                place = np.unique(owner)
                back = np.searchsorted(place, owner)
            else:
                place, back = at, np.arange(len(at))
            value, second = values[place], None
            if size == length and k == n_answered:
                second = C.windows_hash(C.word_hashes(b, self.starts, self.ends, 1), size)[place]
            by = np.argsort(value, kind="stable") if second is None else np.lexsort((second, value))
            new = np.r_[True, np.diff(value[by]) != 0]
            if second is not None:
                new[1:] |= np.diff(second[by]) != 0
            group = np.cumsum(new) - 1
            keys = value[by][new].view(np.int64)
            if k == n_answered:
                times = np.bincount(group, weights=1 + many[place][by])
                self.keys, self.second, self.n = keys, None if second is None else second[by][new].view(np.int64), np.minimum(times, 2).astype(np.int32)
                break
            found = np.isin(keys, answered.get(k, C._NO_KEYS))
            alive = np.empty(len(by), bool)
            alive[by] = (found if k == 0 else ~found)[group]
            at = at[alive[back]]
        self.at = at


@C.freed
def _send(table: pa.Table, replies: pa.Table, length: int, level: int) -> pa.Table:
    if not table.num_rows:
        return _KEYS.empty_table()
    answered = C.by_level(replies)
    w = _Windows(C.Rows(table, answered), length, answered, level)
    if w.keys is None:
        return _KEYS.empty_table()
    n = len(w.keys)
    second = pa.nulls(n, pa.int64()) if w.second is None else pa.array(w.second)
    return pa.Table.from_arrays([pa.array(w.keys), second, pa.array(np.full(n, table.column("block")[0].as_py(), np.int32)), pa.array(w.n)], schema=_KEYS)


@C.freed
def _cut(table: pa.Table, replies: pa.Table, length: int) -> pa.Table:
    answered = C.by_level(replies)
    rows = C.Rows(table, answered)
    b, looked = rows.block, _Windows(rows, length, answered, len(levels(length)))
    edge = np.zeros(len(looked.starts) + 1, np.int64)
    np.add.at(edge, looked.at, 1)
    np.add.at(edge, looked.at + length, -1)
    keep_of = np.cumsum(edge[:-1]) == 0
    starts, ends, first = C.words_of(b)
    n_words = np.diff(first)
    keep = np.repeat(n_words < length, n_words)  # a row that isn't looked at repeats a text: all its windows go
    for i in np.flatnonzero(rows.same >= 0).tolist():
        k = rows.same[i]
        keep[first[i] : first[i + 1]] = keep_of[looked.first[k] : looked.first[k + 1]]
    texts, data = [], b.data.tobytes()
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        k = keep[lo:hi]
        texts.append(b" ".join([data[s:e] for s, e in zip(starts[lo:hi][k].tolist(), ends[lo:hi][k].tolist())]))
    kept = np.r_[0, np.cumsum(keep)][first]
    return pa.Table.from_arrays([b.id_column(), pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(kept), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, length: int = 35, n_blocks: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of ``docs`` (doc_id, text)."""
    assert length > FIRST
    n_blocks = n_blocks or C.block_count(C.text_bytes(docs))
    blocks, replies = C.in_blocks(docs, n_blocks)
    last = len(levels(length)) - 1

    def sender(level: int):
        return lambda t, r: _send(t, r, length, level)

    for level in range(last + 1):
        keys = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(sender(level), KEYS)
        by = ["key", "second"] if level == last else ["key"]
        total = F.sum("n").over(Window.partitionBy(*by))
        told = keys.select(*by, "block", "n").repartition(n_blocks, "key").withColumn("total", total).where("total > 1" if level == 0 else "total = 1")
        replies = replies.unionByName(told.select("block", F.lit(level).alias("level"), "key"))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda t, r: _cut(t, r, length), SCHEMA)
