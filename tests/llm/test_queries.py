import os

import duckdb
import pytest

from tests.test_catalogue import DATA, TABLES, plain
from tidemark.llm import queries as Q


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_rows_equal_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DATA)
    found = db.execute(Q.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, df.collect()) == plain(names, found.fetchall())
