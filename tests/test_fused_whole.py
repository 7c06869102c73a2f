"""Fused lists are whole, however long, in the reranker's features and in what else reads them."""

import os

import pytest

import __spark_entry__ as entry
from tests.test_entry import plain

DATA = os.environ.get("TRACKLAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", ["rerank_features", "ranking_auc"])
def test_a_list_of_1600_candidates(spark, tmp_path, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        if f != "candidates.parquet":
            os.symlink(f"{DATA}/{f}", tmp_path / f)
    q = c.execute(f"SELECT min(query_id) FROM '{DATA}/challenges.parquet' WHERE len(held_out) > 0").fetchone()[0]
    more = f"SELECT CAST({q} AS INTEGER), 'fused', CAST(100000 + i AS INTEGER), CAST(i AS INTEGER), CAST(1 / (1e3 + i) AS DOUBLE) FROM range(1600) x(i)"
    c.execute(f"COPY (SELECT query_id, channel, track_id, rank, score FROM '{DATA}/candidates.parquet' WHERE query_id <> {q} OR channel <> 'fused' UNION ALL {more}) TO '{tmp_path}/candidates.parquet' (FORMAT parquet)")
    for f in os.listdir(tmp_path):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{tmp_path}/{f}'")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=repr)
    rel = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(plain(r[names.index(x)]) for x in columns) for r in rel.fetchall()), key=repr)
    assert got == want
    if name == "rerank_features":
        assert sum(r[columns.index("query_id")] == q for r in got) == 1600
