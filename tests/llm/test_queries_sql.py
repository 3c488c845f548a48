"""The contract's queries by name on the smallest tables: against their SQL where there is some, and their columns everywhere."""

import duckdb
import pytest

from grainmill.llm import queries

COLUMNS = {
    "op2_quality": {"doc_id", "held_out", "score", "predicted"},
    "op3_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op8_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    rows = df.collect()
    ids = sorted(r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall())
    assert set(df.columns) == COLUMNS[name] and sorted({r["doc_id"] for r in rows}) == ids
    if name in ("op2_quality", "op5_toxicity"):
        import zlib

        n, k, least = (5, 0, 0.3) if name == "op2_quality" else (3, 1, 0.7)
        assert len(rows) == len(ids) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == k) for r in rows)
