"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, fingerprints, hyperlang, quality
from corvane.llm import common as C
from corvane.llm.minhash import minhash_near_dedup
from corvane.llm.packing import pack
from corvane.llm.sharding import kd_shards
from corvane.llm.substring import substring_dedup
from corvane.llm.suffixarray import suffix_array_dedup
from corvane.llm.vafile import exact_top_k


#: The tokenizer that op6 must match; its path is a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def op1_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(C.read(spark, sf_dir, "documents")).drop("kept_text")


def op3_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(C.read(spark, sf_dir, "documents"))


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_dedup(C.read(spark, sf_dir, "documents"))


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, C.read(spark, sf_dir, "labels")))


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(bpe.encode_decode(C.read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op7_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(C.read(spark, sf_dir, "embeddings"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(C.read(spark, sf_dir, "documents")).drop("kept")


def op9_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return hyperlang.languages(docs, hyperlang.train(docs))


def op10_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(C.read(spark, sf_dir, "documents"))


QUERIES = (
    op1_length_bucket_packing,
    op2_substring_dedup,
    op3_kd_tree_sharding,
    op4_circulant_minhash,
    op5_attention_quality,
    op6_transducer_bpe,
    op7_va_file_topk,
    op8_suffix_array_dedup,
    op9_hyperdimensional_langid,
    op10_bottom_k_fingerprints,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_WORDS = "'[^\\x20\\x09-\\x0D]+'"
_LAST_ID = 9223372036854775807
#: Runs of removed places from the starts of removed windows (key, i), and what stays between them. {n}: places of a window.
_RUNS = """st AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + {n}, false) AS far FROM gone), il AS (SELECT rid, i, count_if(far) OVER (PARTITION BY rid ORDER BY i) AS g FROM st),
       runs AS (SELECT rid, min(i) AS a, max(i) + {n} AS z FROM il GROUP BY rid, g), total AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed FROM runs GROUP BY rid),
       gaps AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS a, a AS z FROM runs UNION ALL SELECT rid, max(z), {big} FROM runs GROUP BY rid)"""
_RUNS_OF_WORDS, _RUNS_OF_BYTES = _RUNS.format(n=35, big=1 << 30), _RUNS.format(n=50, big=1 << 30)

ORACLES = {
    "op2_substring_dedup": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
       x AS MATERIALIZED (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)), gone AS (SELECT rid, i FROM x WHERE k IN (SELECT k FROM x GROUP BY k HAVING count(*) > 1)), {_RUNS_OF_WORDS},
       kept AS (SELECT rid, string_agg(array_to_string(w[g.a:g.z - 1], ' '), ' ' ORDER BY g.a) AS t FROM gaps g JOIN d USING (rid) WHERE g.a < least(g.z, len(w) + 1) GROUP BY rid)
       SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256 FROM d LEFT JOIN total USING (rid) LEFT JOIN kept USING (rid)""",
    "op4_circulant_minhash": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
       s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
       p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2), l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
       r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), m AS (SELECT x AS doc_id, least(x, min(y)) AS c FROM r GROUP BY x)
       SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id""",
    "op7_va_file_topk": """WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
       s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
       SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op8_suffix_array_dedup": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {_LAST_ID}) AS id, hex(coalesce(text, '')) AS h FROM documents), x AS MATERIALIZED (SELECT rid, id, i, hash(substr(h, 2 * i - 1, 100)) AS k FROM (SELECT rid, id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d)),
       m AS (SELECT k, min(id) AS least FROM x GROUP BY k), gone AS MATERIALIZED (SELECT rid, i FROM x JOIN m USING (k) WHERE id > least), {_RUNS_OF_BYTES}, kept AS (SELECT rid, string_agg(substr(h, 2 * g.a - 1, 2 * (g.z - g.a)), '' ORDER BY g.a) AS t FROM gaps g JOIN d USING (rid) WHERE g.a < least(g.z, len(h) // 2 + 1) GROUP BY rid)
       SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(t, '') END)) AS kept_sha256 FROM d LEFT JOIN total USING (rid) LEFT JOIN kept USING (rid)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can give a query's rows; hashes, models and tokenizers are held against brute force in the tests."""
    return dict(ORACLES)
