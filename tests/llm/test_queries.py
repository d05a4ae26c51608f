"""Queries with SQL give the rows that DuckDB gives; all queries keep what they promise about columns."""

import duckdb
import pytest

from trajspark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash_near_dedup": "doc_id fingerprint component_id",
    "op2_shard_mixture": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_html_extraction": "page_id url text n_chars",
    "op4_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_token_id_output": "doc_id start n_tokens ids_crc32",
    "op6_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7_quality_classifier": "doc_id held_out score predicted",
    "op8_bpe_encode_decode": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_pii_surrogates": "doc_id text",
    "op13_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op12_importance_resampling": "doc_id n_features weight score rank",
    "op11_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_as_in_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    wanted = COLUMNS[name].split()
    assert [c for c in got.columns if c in wanted] == wanted
    source, each = {"page_id": ("pages", 1), "vec_id": ("embeddings", 4)}.get(wanted[0], ("documents", 1))
    assert got.count() == each * spark.read.parquet(f"{SF}/{source}.parquet").count()
