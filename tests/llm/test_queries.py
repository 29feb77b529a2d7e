"""The registered queries over the smallest tables: their columns, and SQL where there is some."""

import duckdb
import pytest

from chapterloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_iblt_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_topk_impact": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3_pack_curve": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_pseudo_likelihood": "doc_id bigint, n_tokens bigint, log_likelihood double",
    "op6_section_tokens": "doc_id bigint, section bigint, start bigint, end bigint, n_tokens bigint",
    "op7_simhash_groups": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_suffix_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_disclosing_terms": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


def test_all_ten_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    asked = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    assert frame.dtypes[: len(asked)] == asked
    got = [tuple(r) for r in frame.collect()]
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name not in ("op2_topk_impact", "op3_pack_curve", "op6_section_tokens"):
        assert len(got) == documents
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        assert sorted(got, key=repr) == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall(), key=repr)
