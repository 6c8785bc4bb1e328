"""Exact top-k by inner product over a vector-approximation file.

Components are floor(64 x), so scores are whole numbers and exact. Each block of candidates is quantised: every dimension is cut
into ``CELLS`` cells between its smallest and largest value in the block, and a vector is kept as one byte a dimension. For a
query, the cells alone bound a vector's score from above (in each dimension the better edge of the cell): a bound is the product of
the vector's bytes with the query's steps, plus a constant of the query. So a block is scanned by its cells first; vectors are then
read exactly, the best bounds first, until the k-th score found is above the next bound.

Queries and candidates meet chunk by chunk: each block of queries is sent to every chunk of candidates. A task goes through the
blocks of its chunk with the k best of each query so far, whose last score is the bar for all later blocks, and answers with k rows
a query; one merge keeps the k best. Chunks grow with the table up to ``CHUNK`` vectors, so what is merged is k rows for each query
and chunk. Memory is one chunk, one block's bounds and k rows a query. This is the stated query set against all rows, not a join of
all pairs.

Vectors that are null or empty, or that hold null or non-finite components, take no part; vectors of different lengths have no
product and don't meet. A null id takes no part. Rows that repeat an id are candidates of their own, and different vectors of one
query id are queries of their own, each with its ranks; a query's own row is every row with its id. Ties go to the smaller id. An
empty table gives no rows; a query without candidates gives none. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS, BLOCK, CHUNK, CHUNKS, QUERY_BLOCK, QUERIES = 64, 4096, 65536, 32, 8192, 256
FOUND = "query_id long, query long, vec_id long, score long"


def usable(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and whole-numbered components of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table.column("vec_id")).astype(np.int64)
    flat = table.column("v").combine_chunks()
    return ids, np.asarray(flat.flatten()).astype(np.int64).reshape(len(ids), -1)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


class Approximation:
    """Cells of a block of vectors, and the search through them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cells: int = CELLS):
        self.ids, self.vectors = ids, vectors
        self.low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.step = np.maximum(1, -(-(high - self.low + 1) // cells))
        self.cell = ((vectors - self.low) // self.step).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """By query and vector the highest score its cells allow. Whole numbers under 2**53, so the products are exact."""
        edge = np.where(queries > 0, queries * (self.low + self.step - 1), queries * self.low).sum(axis=1)
        return (queries * self.step).astype(np.float64) @ self.cell.T.astype(np.float64) + edge[:, None]

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best whose score is ``bar`` or more, and how many vectors were read."""
        bound = np.where((self.ids != query_id) & (bound >= bar), bound, -np.inf)
        n, take = int((bound > -np.inf).sum()), min(len(bound), 4 * k)
        while True:
            at = np.argpartition(-bound, take - 1)[:take] if take < len(bound) else np.arange(len(bound))
            at = at[bound[at] > -np.inf]
            score = self.vectors[at] @ query
            best = _best(self.ids[at], score, k)
            rest = -np.inf
            if len(at) < n:
                unread = bound.copy()
                unread[at] = -np.inf
                rest = unread.max()
            if len(at) >= n or (len(best) == k and score[best[-1]] > rest):
                return self.ids[at][best], score[best], len(at)
            take = min(len(bound), take * 4)


def _meet(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    out: list[tuple[np.ndarray, ...]] = []
    if left.num_rows and right.num_rows:
        ids, queries = _matrix(right)
        marks = np.asarray(right.column("query")).astype(np.int64)
        best_ids, best_scores = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0, np.int64)] * len(ids)
        for start in range(0, left.num_rows, BLOCK):
            file = Approximation(*_matrix(left.slice(start, BLOCK)))
            for at in range(0, len(ids), QUERIES):
                bounds = file.bounds(queries[at : at + QUERIES])
                for i, bound in zip(range(at, len(ids)), bounds):
                    full = len(best_ids[i]) == k
                    bar = best_scores[i][-1] if full else -np.inf
                    if full and bound.max() < bar:
                        continue
                    found, score, _ = file.search(int(ids[i]), queries[i], bound, k, bar)
                    found, score = np.r_[best_ids[i], found], np.r_[best_scores[i], score]
                    order = _best(found, score, k)
                    best_ids[i], best_scores[i] = found[order], score[order]
        out = [(np.full(len(f), q), np.full(len(f), m), f, s) for q, m, f, s in zip(ids, marks, best_ids, best_scores)]
    names = ("query_id", "query", "vec_id", "score")
    return pa.table({n: pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64), pa.int64()) for k, n in enumerate(names)})


def exact_top_k(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``."""
    rows = usable(table).withColumn("d", F.size("v"))
    n_rows = rows.count()
    chunk = min(CHUNK, max(BLOCK, -(-n_rows // CHUNKS)))
    n_chunks, n_sets = max(1, -(-n_rows // chunk)), max(1, -(-n_rows // (every * QUERY_BLOCK)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # candidates that repeat id and vector spread by a number of the row: it only deals them out
    apart = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(n_chunks)).cast("int")
    cells = rows.withColumn("chunk", apart).withColumn("set", each(n_sets))
    queries = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("query", F.xxhash64("v")).withColumn("set", dealt(n_sets)).withColumn("chunk", each(n_chunks))
    keys = ["d", "set", "chunk"]
    met = cells.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(lambda a, b: _meet(a, b, k), FOUND)
    # k rows a query and chunk come in; the rank is over one query's own
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
