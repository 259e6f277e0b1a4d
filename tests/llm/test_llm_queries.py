"""The registered queries on the smallest tables: against DuckDB where SQL can say it, and the contracts' columns."""

import duckdb
import pytest

from evalweave.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"},
    "op3_sentencepiece": {"doc_id", "n_tokens", "ids_crc32", "parity", "units_round_trip"},
    "op4_simple8b": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op5_substring": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op6_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_exact_duplicates": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op9_quality": {"doc_id", "held_out", "score", "predicted"},
    "op10_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    assert set(df.columns) >= COLUMNS[name]
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name != "op6_packing":
        assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in queries.oracle_sql():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        found = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
