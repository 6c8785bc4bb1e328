"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from a seed and the letter's code point, so no alphabet is listed). A
trigram's vector is the product of its letters' vectors, the first rotated by two places and the second by one; a text's vector
is the sum of its trigrams' vectors, and a language's prototype is the sum of its texts' unit vectors. A text gets the language
of the prototype with the highest cosine, after the prototypes' common mean is taken off both.

A text is accepted as its language (``accepted``, the pipeline's filter) when the mean likeness of its trigrams to the language's
prototype, which does not grow with the text's length, reaches ``SHARE`` of that language's median over the learning rows, each
compared with a prototype that it has no part in. Chance spreads the mean of n trigrams by 1 / sqrt(n x SIZE); so much less is
still accepted, so that a text of a few words is not lost. A language with one learning row takes the lowest level of the others.

Prototypes are learned from at most ``sample`` rows with a language (the smallest by a hash of the id); every whole text is
compared. A text that is null or has no letter gets ``und`` and score 0, as does every text when nothing was learned. Equal
cosines go to the language that sorts first. Repeated rows are treated alike; a text of any length is compared whole; an empty table
gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common as C
from corvane.llm.quality import held_out

SIZE, SAMPLE, SEED = 512, 4000, 11
#: Of a language's median likeness: random letters reach 0.1 of it, related languages that were not learned 0.3.
SHARE = 0.4
#: Texts that are bundled in one product.
CHUNK = 64
UNKNOWN = "und"
_LETTER: dict[int, int] = {}
_VECTORS: dict[int, np.ndarray] = {}


def _code(point: int) -> int:
    """The lower-case code point of a letter, 32 for anything else."""
    c = chr(point)
    low = c.lower()
    return ord(low[0]) if c.isalpha() else 32


_LOW = np.array([_code(i) for i in range(0x3000)], np.int64)


def letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, every run of other characters as one blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = _LOW[np.minimum(points, 0x2FFF)]
    far = np.flatnonzero(points >= 0x3000)
    if len(far):
        kinds, back = np.unique(points[far], return_inverse=True)
        out[far] = np.array([_code(int(i)) for i in kinds])[back]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def _vector(point: int) -> np.ndarray:
    v = _VECTORS.get(point)
    if v is None:
        v = _VECTORS[point] = (np.random.default_rng((SEED, point)).integers(0, 2, SIZE) * 2 - 1).astype(np.int8)
    return v


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.concatenate([[32], letters(text), [32]])
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)


def bound(keys: np.ndarray) -> np.ndarray:
    """The vectors of trigrams."""
    parts = []
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        points, back = np.unique((keys >> shift) & 0x1FFFFF, return_inverse=True)
        parts.append(np.stack([np.roll(_vector(int(p)), turn) for p in points])[back])
    return (parts[0] * parts[1] * parts[2]).astype(np.float32)


class Trigrams:
    """Bundles of texts. Trigram vectors met before are kept, ``limit`` of them at most."""

    def __init__(self, limit: int = 16384):
        self.limit, self.keys, self.rows = limit, np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32)

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of at most ``limit`` sorted trigrams."""
        fresh = np.setdiff1d(keys, self.keys, assume_unique=True)
        if len(fresh):
            if len(self.keys) + len(fresh) > self.limit:
                self.keys, self.rows = keys, bound(keys)
            else:
                joined = np.concatenate([self.keys, fresh])
                order = np.argsort(joined)
                self.keys, self.rows = joined[order], np.concatenate([self.rows, bound(fresh)])[order]
        return self.rows[np.searchsorted(self.keys, keys)]

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A vector for each text, whether it has a letter, and its number of trigrams. Counts by text and trigram times vectors by trigram: one product
        for all texts."""
        has = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        found = [_trigrams(t) if ok else None for t, ok in zip(texts, has)]
        out = np.zeros((len(texts), SIZE), np.float32)
        every = np.unique(np.concatenate([k for k, _ in filter(None, found)])) if has.any() else np.zeros(0, np.int64)
        for at in range(0, len(every), self.limit):
            part = every[at : at + self.limit]
            counts = np.zeros((len(texts), len(part)), np.float32)
            for i in np.flatnonzero(has):
                keys, n = found[i]
                lo, hi = np.searchsorted(keys, part[0]), np.searchsorted(keys, part[-1], side="right")
                counts[i, np.searchsorted(part, keys[lo:hi])] = n[lo:hi]
            out += counts @ self._rows(part)
        return out, has, np.array([f[1].sum() if f else 0 for f in found], np.int64)


def likeness(v: np.ndarray, n: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """By text and prototype (of length 1), the mean cosine of the text's n trigrams with the prototype."""
    return (v @ prototypes.T) / (np.maximum(n, 1) * np.sqrt(SIZE))[:, None]


class LanguageModel:
    def __init__(self, names: list[str], prototypes: np.ndarray, levels: np.ndarray | None = None):
        self.names = names
        self.raw, self.levels = prototypes, np.zeros(len(names)) if levels is None else levels
        self.mean = prototypes.mean(axis=0) if len(names) else np.zeros(SIZE)
        centred = prototypes - self.mean if len(names) > 1 else prototypes
        self.prototypes = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9) if len(names) else centred

    def _cosines(self, bundles: np.ndarray) -> np.ndarray:
        v = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
        if len(self.names) > 1:
            v = v - self.mean
        return (v @ self.prototypes.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None], cache: Trigrams) -> tuple[list[str], np.ndarray]:
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names:
            return out, score
        v, has, _ = cache.bundles(texts)
        cosine = self._cosines(v)
        for i in np.flatnonzero(has):
            k = int(np.argmax(cosine[i]))
            out[i], score[i] = self.names[k], min(1.0, max(0.0, (float(cosine[i, k]) + 1) / 2))
        return out, score

    def accepted(self, texts: list[str | None], cache: Trigrams, share: float = SHARE) -> np.ndarray:
        """Whether each text is like the language that it gets. Nothing is, when nothing was learned."""
        if not self.names or not len(texts):
            return np.zeros(len(texts), bool)
        v, has, n = cache.bundles(texts)
        best = np.argmax(self._cosines(v), axis=1)
        found = likeness(v, n, self.raw)[np.arange(len(texts)), best]
        return has & (found >= share * self.levels[best] - 1 / np.sqrt(np.maximum(n, 1) * SIZE))


def median_likeness(v: np.ndarray, n: np.ndarray) -> float | None:
    """Of one language's learning rows, each against the sum of the others' unit vectors."""
    if len(v) < 2:
        return None
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    rest = unit.sum(axis=0) - unit
    rest /= np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9)
    return float(np.median((v * rest).sum(axis=1) / (np.maximum(n, 1) * np.sqrt(SIZE))))


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Prototypes from at most ``sample`` rows outside the held-out quarter. Executors make the texts' vectors, so the driver gets
    a vector a row, never a text."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    known = known.where(~held_out(F.col("doc_id")))
    # ids first: ``sample`` of them at most, so they are broadcast and no text is sorted
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def bundled(batches):
        cache = Trigrams()
        for batch in batches:
            made = []
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                v, has, n = cache.bundles(part.column("text").to_pylist())
                made += [(i, lang, x.tobytes(), k) for i, lang, x, k, ok in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), v, n.tolist(), has) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.int64()))], names=["doc_id", "lang", "v", "n"])

    rows = known.join(F.broadcast(chosen), known["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi").mapInArrow(bundled, "doc_id long, lang string, v binary, n long")
    sums: dict[str, np.ndarray] = {}
    learned: dict[str, list[tuple[np.ndarray, int]]] = {}
    for row in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "v").limit(sample).toArrow().to_pylist():
        x = np.frombuffer(row["v"], np.float32)
        v = x.astype(np.float64)
        sums[row["lang"]] = sums.get(row["lang"], 0) + v / max(float(np.linalg.norm(v)), 1e-9)
        learned.setdefault(row["lang"], []).append((x, row["n"]))
    names = sorted(sums)
    table = np.array([sums[k] / max(float(np.linalg.norm(sums[k])), 1e-9) for k in names]).reshape(len(names), SIZE)
    medians = [median_likeness(np.stack([x for x, _ in learned[k]]).astype(np.float64), np.array([n for _, n in learned[k]])) for k in names]
    least = min((m for m in medians if m is not None), default=0.0)
    return LanguageModel(names, table, np.array([least if m is None else m for m in medians]))


def languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""

    def predicted(batches):
        cache = Trigrams()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                names, score = model.predict(part.column("text").to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = source.mapInArrow(predicted, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: LanguageModel, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that are like the language they get: at ``share`` or more of its median likeness. Texts that are
    null or have no letter go; null ids and rows that repeat are rows like any others; an empty table stays empty."""
    kept: dict[str, Trigrams] = {}

    def like(text: pa.Array) -> pa.Array:
        cache = kept.setdefault("cache", Trigrams())
        out = [model.accepted(text.slice(at, CHUNK).to_pylist(), cache, share) for at in range(0, len(text), CHUNK)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool), pa.bool_())

    return docs.where(C.arrow_column(like, "boolean")(F.col("text").cast("string")))
