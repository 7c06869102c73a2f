from tracklake.llm import queries


def test_every_pair_has_count_and_surprise(spark, tmp_path):
    sequences = [(1, [1, 2, 3]), (2, [1, 2]), (3, [1, 4]), (4, [5])]
    spark.createDataFrame(sequences, "pid int, tracks array<int>").write.parquet(str(tmp_path / "sequences.parquet"))
    spark.createDataFrame([(i, f"u{i}") for i in range(1, 6)], "track_id int, track_uri string").write.parquet(str(tmp_path / "tracks.parquet"))
    want = {(1, 2): 2, (1, 3): 1, (2, 3): 1, (1, 4): 1}
    counts = {(r.track_a, r.track_b): r.n_ab for r in queries.p6_counts(spark, str(tmp_path)).collect()}
    rows = queries.p6_surprise(spark, str(tmp_path)).collect()
    assert counts == want and {(r.track_a, r.track_b): r.n_ab for r in rows} == want
    assert all(r.expected > 0 and r.surprise >= 0 and r.npmi is not None and r.significant is not None and r.track_uri_a == f"u{r.track_a}" for r in rows)
