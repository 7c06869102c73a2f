"""Every registered query with SQL against DuckDB on the smallest tables, where these are present."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TRACKLAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def lake():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, lake, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = lake.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_imports_without_the_training_subpackage():
    import pathlib

    for p in pathlib.Path("tracklake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tracklake.llm" not in p.read_text(), p


def test_build_command(spark, tmp_path):
    from tracklake.__main__ import build
    from tracklake.sources import store

    build(spark, DATA, str(tmp_path), 10)
    t = store.read(spark, str(tmp_path), "entries", "track_tags", "challenges")
    held = {r.playlist_id for r in t["challenges"].select("playlist_id").distinct().collect()}
    assert held and not held & {r.playlist_id for r in t["entries"].select("playlist_id").distinct().collect()}
    assert t["track_tags"].count() > 0 and (tmp_path / "build_meta.json").exists()
