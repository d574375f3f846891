"""The registered training-data queries: names, results and SQL over the test tables."""

import duckdb

import corpus_pipeline
from docweave.llm import catalog

SF01 = "/root/testdata/sf0.01"
COLUMNS = {
    "op1_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_mixing": ["doc_id", "tokens", "posteriors", "rate", "copies"],
    "op7_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_wavelet_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept"],
    "op11_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op12_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         "ends_sha256"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}
TYPES = {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "offset": "bigint",
         "held_out": "boolean", "lang_pred": "string", "score": "double", "size": "bigint", "text_crc32": "bigint",
         "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "keep_id": "bigint",
         "group_size": "bigint", "kept": "boolean", "text_sha256": "string", "n_email": "bigint", "n_ip": "bigint",
         "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "fingerprint": "string",
         "component_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint",
         "kept_sha256": "string", "n_tokens": "bigint", "n_words": "bigint", "word_chars": "bigint",
         "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean",
         "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "conv_id": "bigint", "depth": "bigint",
         "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint",
         "saved_tokens": "bigint", "ends_sha256": "string", "anchor_id": "bigint", "positive_id": "bigint",
         "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
OTHER_TABLES = ("op12_prefix_trie", "op13_hard_negatives")


def test_contract_of_every_query(spark):
    assert list(catalog.QUERIES) == list(COLUMNS)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").count()
    for name, columns in COLUMNS.items():
        out = catalog.QUERIES[name](spark, SF01)
        types = dict(out.dtypes)
        assert set(columns) <= set(out.columns), name
        assert all(types[c] == TYPES[c] for c in columns if c in TYPES), (name, types)
        assert out.count() >= (100 if name in OTHER_TABLES else docs), name


def test_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF01}/{table}.parquet'")
    for name, sql in catalog.ORACLES.items():
        out = catalog.QUERIES[name](spark, SF01)
        cols = sorted(out.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in out.collect())


def test_pipeline_is_registered():
    import __spark_entry__
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
