import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query for each family; the driver compares all of them.
CHOSEN = ["fin_ohlc", "fin_chunks", "fin_cagg_rt", "iot_30m_loc", "iot_tier", "oee_7d_cagg", "wel_q3", "wel_geo_radius", "wdb_p9", "cmp_q4", "bio_abnormal", "bio_cagg_after_retention", "btc_q6", "ai_vec_topk", "series_each", "json_field", "outliers", "oee_1h", "oee_2mo_explain", "fin_describe", "ai_vec_index", "wel_refresh_changed", "wel_refresh_pending", "oee_day_from_hours", "stream_ingest", "stream_live", "cmp_incidents", "cmp_shift_incidents", "wel_geo_cells", "wel_geo_pairs", "wel_geo_nearest", "ai_vec_index_filtered", "ai_vec_recall", "ai_vectorizer_pending", "ai_vectorizer_changes", "iot_clustered", "oee_2mo_timing", "iot_stats_whole", "src_csv", "constraints_violated", "ai_geo_spheroid", "ai_geo_rag_rows", "ai_rag_context", "cmp_update", "src_convert"]


def plain(names, rows):
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for _, v in sorted(zip(names, r))) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", CHOSEN)
def test_rows_equal_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    found = db.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, df.collect()) == plain(names, found.fetchall())


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunk_rows_of_the_last_half_second_are_told_as_in_sql(spark, tmp_path):
    times = ["2024-01-10 23:59:59.4", "2024-01-10 23:59:59.5", "2024-01-10 23:59:59.999999", "2024-01-11 00:00:00", "2024-01-17 23:59:59.7"]
    rows = ", ".join(f"({k}, TIMESTAMP '{t}', {k}, 'view', 1.0, '')" for k, t in enumerate(times))
    duckdb.sql(f"COPY (SELECT CAST(a AS BIGINT) AS event_id, b AS ts, CAST(c AS BIGINT) AS user_id, d AS event_type, CAST(e AS DOUBLE) AS value, f AS props FROM (VALUES {rows}) v(a, b, c, d, e, f)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = duckdb.connect()
    want.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("iot_chunk_stats", "wel_chunk_stats", "cmp_chunk_stats"):
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want.sql(catalogue.SQL[name]).fetchall())
