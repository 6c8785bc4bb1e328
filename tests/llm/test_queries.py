"""The registered queries run whole and keep their columns."""

import pytest

from corvane.llm import queries

COLUMNS = {
    "op2_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op3_kd_tree_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op5_attention_quality": {"doc_id", "held_out", "score", "predicted"},
    "op6_transducer_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7_va_file_topk": {"query_id", "rank", "vec_id", "score"},
    "op8_suffix_array_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op9_hyperdimensional_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_bottom_k_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(name, spark, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    assert set(df.columns) >= COLUMNS[name]
    if "doc_id" in df.columns:
        assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
