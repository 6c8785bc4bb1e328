"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage becomes a vector of byte statistics and of its words and pairs of
words, hashed; a hidden layer encodes it, and a gated attention (tanh times sigmoid) weighs the passages; the weighted mean goes to
one logistic output. Only the document has a label; the weights of passages are learned from it.

The model is fitted on the driver by Adam, on at most ``sample`` labelled rows (the smallest by a hash of the id), fewer once they
have ``most`` passages (80 MB), each with all its passages; scoring reads every passage of every document. A null or empty text is one
passage without bytes and gets a score too. Rows without a usable label teach nothing; with no labels, or one label only, the
score is the share of label 1 (0.5 without labels). Repeated rows are scored alike; a score at the threshold is accepted; a text of
any length is scored whole; an empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import common as C

PASSAGE, HIDDEN, GATE = 1024, 16, 8
SAMPLE, MOST, EPOCHS = 6000, 200_000, 60
THRESHOLD = 0.7


def held_out(doc_id):
    """The rows that no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _classes() -> np.ndarray:
    """Byte by class: lower, upper, digit, blank, line break, comma or full stop, other marks, control, UTF-8 lead, UTF-8 rest."""
    kind = np.full(256, 7)
    kind[97:123], kind[65:91], kind[48:58], kind[32], kind[9] = 0, 1, 2, 3, 3
    kind[[10, 13]] = 4
    for a, z in ((33, 48), (58, 65), (91, 97), (123, 127)):
        kind[a:z] = 6
    kind[[44, 46, 39, 45]] = 5
    kind[128:192], kind[192:] = 9, 8
    return kind


KINDS = _classes()
#: Words and pairs of words are hashed into so many places each.
PLACES = 32
N_FEATURES = 10 + 10 + 10 + 6 + 2 * PLACES


def passages(block: C.Block) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all passages of a block, and the place of each document's first (with the total at the end)."""
    length = np.diff(block.start)
    per = np.maximum(1, -(-length // PASSAGE))
    first = np.r_[0, np.cumsum(per)]
    n = int(first[-1])
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(block.data):
        return out, first
    k = np.arange(n) - np.repeat(first[:-1], per)
    begin = np.repeat(block.start[:-1], per) + k * PASSAGE
    end = np.minimum(begin + PASSAGE, np.repeat(block.start[1:], per))
    size = np.maximum(end - begin, 1).astype(np.float32)
    passage = np.repeat(np.arange(n), end - begin)
    kind = KINDS[block.data]
    counts = np.bincount(passage * 10 + kind, minlength=n * 10).reshape(n, 10)
    out[:, :10] = counts / size[:, None]
    pair = (kind[1:] == kind[:-1]) & (passage[1:] == passage[:-1])
    same = np.bincount(passage[1:][pair] * 10 + kind[1:][pair], minlength=n * 10).reshape(n, 10)
    out[:, 10:20] = same / size[:, None]
    step = np.bincount(passage[1:] * 10 + kind[1:], weights=(kind[:-1] == 3) & (passage[1:] == passage[:-1]), minlength=n * 10).reshape(n, 10)
    out[:, 20:30] = step / size[:, None]
    starts, ends, _ = C.words_of(block)
    of = passage[starts] if len(starts) else np.zeros(0, np.int64)
    words = np.bincount(of, minlength=n).astype(np.float32)
    long = np.maximum(words, 1)
    width = (ends - starts).astype(np.float32)
    out[:, 30] = np.bincount(of, weights=width, minlength=n) / long / 10
    out[:, 31] = np.sqrt(np.bincount(of, weights=width * width, minlength=n) / long) / 10
    hashes = C.word_hashes(block, starts, ends)
    place = np.lexsort((hashes, of))
    fresh = np.r_[True, (np.diff(of[place]) != 0) | (np.diff(hashes[place].astype(np.int64)) != 0)][: len(place)]
    out[:, 32] = np.bincount(of[place][fresh], minlength=n) / long
    again = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    out[:, 33] = np.bincount(of[1:][again], minlength=n) / long
    if len(hashes) > 4:
        far = (hashes[4:] == hashes[:-4]) & (of[4:] == of[:-4])
        out[:, 34] = np.bincount(of[4:][far], minlength=n) / long
    out[:, 35] = np.log1p(words) / 5
    place_of = lambda h: (h >> np.uint64(59)).astype(np.int64)
    pairs = C.windows_hash(hashes, 2)
    inside = of[1:] == of[:-1]
    out[:, 36 : 36 + PLACES] = np.bincount(of * PLACES + place_of(hashes), minlength=n * PLACES).reshape(n, PLACES) / long[:, None]
    out[:, 36 + PLACES :] = np.bincount((of[1:] * PLACES + place_of(pairs))[inside], minlength=n * PLACES).reshape(n, PLACES) / long[:, None]
    return out, first


def _segments(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


class AttentionModel:
    """Hidden layer, gated attention over a document's passages, logistic output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale, self.share = mean, scale, None
        self.w = {"h": rng.normal(0, d**-0.5, (d, HIDDEN)), "hb": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, GATE**-0.5, GATE), "o": rng.normal(0, HIDDEN**-0.5, HIDDEN), "ob": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, r = self.w, {}
        r["x"] = np.clip((x - self.mean) / self.scale, -6, 6)
        r["h"] = np.tanh(r["x"] @ w["h"] + w["hb"])
        r["t"], r["g"] = np.tanh(r["h"] @ w["v"]), 1 / (1 + np.exp(-(r["h"] @ w["u"])))
        score = (r["t"] * r["g"]) @ w["a"]
        n = np.diff(first)
        e = np.exp(score - np.repeat(np.maximum.reduceat(score, first[:-1]), n))
        r["p"] = e / np.repeat(_segments(e, first), n)
        r["z"] = _segments(r["h"] * r["p"][:, None], first)
        r["y"] = 1 / (1 + np.exp(-(r["z"] @ w["o"] + w["ob"])))
        return r

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, r, n = self.w, self.forward(x, first), np.diff(first)
        d = (r["y"] - label) * weight / len(label)
        dz = np.repeat(d[:, None] * w["o"], n, axis=0)
        dp = (dz * r["h"]).sum(axis=1)
        ds = r["p"] * (dp - np.repeat(_segments(r["p"] * dp, first), n))
        tg = ds[:, None] * w["a"]
        dv, du = tg * r["g"] * (1 - r["t"] ** 2), tg * r["t"] * r["g"] * (1 - r["g"])
        dh = dz * r["p"][:, None] + dv @ w["v"].T + du @ w["u"].T
        dx = dh * (1 - r["h"] ** 2)
        return {"h": r["x"].T @ dx, "hb": dx.sum(axis=0), "v": r["h"].T @ dv, "u": r["h"].T @ du, "a": (ds[:, None] * r["t"] * r["g"]).sum(axis=0), "o": r["z"].T @ d, "ob": np.array([d.sum()])}

    def scores(self, block: C.Block) -> np.ndarray:
        if self.share is not None:
            return np.full(block.n, self.share)
        return self.forward(*passages(block))["y"]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> AttentionModel:
    """A model from bags of passage vectors and their documents' labels."""
    if not len(labels) or labels.min() == labels.max():
        model = AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES))
        model.share = float(labels.mean()) if len(labels) else 0.5
        return model
    x = np.concatenate(bags)
    ends = np.cumsum([len(b) for b in bags])
    picks = [np.arange(z - len(b), z) for b, z in zip(bags, ends.tolist())]
    model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 1e-3, seed)
    rng, weight = np.random.default_rng(seed), np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    weight = np.sqrt(weight)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    s, t = {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 128):
            docs = order[at : at + 128]
            rows = np.concatenate([picks[i] for i in docs])
            g = model.gradient(x[rows], np.r_[0, np.cumsum([len(picks[i]) for i in docs])], labels[docs], weight[docs])
            t += 1
            for k, v in g.items():
                v = v + 1e-4 * model.w[k]
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                model.w[k] = model.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> AttentionModel:
    """A model from at most ``sample`` labelled rows outside the held-out quarter. Executors make the vectors of the passages, so
    the driver gets 400 bytes a passage, never a text. Rows are taken whole, in order, until they have ``most`` passages."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def bags(batches):
        for table in C.cut_batches(batches):
            block = C.Block(table)
            x, first = passages(block)
            rows = [x[a:z].tobytes() for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([block.id_column(), table.column("label").combine_chunks().take(pa.array(block.order)), pa.array(rows, pa.binary())], names=["doc_id", "label", "bag"])

    # ``chosen`` has ``sample`` rows at most, so it is broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("bag")]
    taken = rows.mapInArrow(bags, "doc_id long, label int, bag binary").orderBy(*order).limit(sample)
    before = F.coalesce(F.sum(F.octet_length("bag")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = taken.withColumn("before", before).where(F.col("before") < most * 4 * N_FEATURES).orderBy("before").toArrow()
    vectors = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, N_FEATURES) for x in found.column("bag")]
    return fit(vectors, np.asarray(found.column("label")).astype(np.float64))


def quality_scores(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""

    def scored(batches):
        for table in C.cut_batches(batches):
            block = C.Block(table)
            yield pa.RecordBatch.from_arrays([block.id_column(), pa.array(model.scores(block).astype(np.float64))], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = source.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the model accepts. The score is a column made beside the text: no join. Null and empty texts
    are scored as one passage without bytes; null ids and rows that repeat are rows like any others; an empty table stays empty."""

    def flagged(text: pa.Array) -> pa.Array:
        out = []
        for table in C.cut_batches([pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text], names=["doc_id", "text"])]):
            out.append(model.scores(C.Block(table)))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.where(C.arrow_column(flagged, "double")(F.col("text").cast("string")) >= threshold)
