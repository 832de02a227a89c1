import math
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from wayline.queries import QUERIES, SQL, user_boxes, user_tracks


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if isinstance(v, int | None) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_their_sql(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    twin = sql.sql(SQL[name])
    assert sorted(twin.columns) == columns
    spots = [twin.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in spots) for r in twin.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_queries_without_sql(spark, sf):
    """Held against brute force in test_operators; here by what their tables say."""
    assert sorted(set(QUERIES) - set(SQL)) == ["localized", "speakers", "suppressed_boxes", "tracked_objects"]
    got = {name: QUERIES[name](spark, sf).collect() for name in set(QUERIES) - set(SQL)}
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert len(got["speakers"]) == len(got["localized"]) == vectors
    boxes = user_boxes(spark, sf).count()
    assert 0 < len(got["suppressed_boxes"]) < boxes and len(got["tracked_objects"]) == user_tracks(spark, sf).count()


def test_the_entry_has_rows(spark):
    assert entry.entry(spark).count() == 69
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_entry_without_the_corpus_operators(tmp_path):
    """With the subpackage and its pipeline gone, everything else is still there."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "wayline", tmp_path / "wayline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(SQL))]
