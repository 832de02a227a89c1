from collections import Counter
from pathlib import Path

import duckdb
import pytest

from wayline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_their_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    twin = con.sql(SQL[name])
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert sorted(twin.columns) == columns
    spots = [twin.columns.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in spots) for r in twin.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
