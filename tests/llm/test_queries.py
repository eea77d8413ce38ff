"""The registered queries on the smallest tables: against SQL where there is some, else their contract's columns."""

import pathlib

import duckdb
import pytest
from tests.conftest import SF
from tests.test_catalogue import table

from tidemark.llm.queries import CHECKS, QUERIES

COLUMNS = {
    "op1_pieces": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op2_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op3_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op7_jaccard": {"doc_id", "n_shingles", "component_id"},
    "op8_order_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_quality": {"doc_id", "held_out", "score", "predicted"},
    "op10_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op11_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op12_mask_search": {"item_id", "rank", "doc_id", "score"},
    "op13_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert COLUMNS.get(name, set()) <= set(df.columns)
    if name in COLUMNS and name != "op12_mask_search":
        source = "pages" if name == "op5_warc" else "documents"
        assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name in CHECKS:
        connection = duckdb.connect()
        for path in pathlib.Path(SF).glob("*.parquet"):
            connection.execute(f"create view {path.stem} as select * from '{path}'")
        result = connection.execute(CHECKS[name])
        assert table(df.columns, rows) == table([d[0] for d in result.description], result.fetchall())


def test_every_dealt_number_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
