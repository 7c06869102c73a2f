"""Recall of the cold tracks counts hits within the tasks, whichever way the lists are made."""

import numpy as np

from tracklake.operators import coldstart, retrieve


def test_only_hits_leave_tasks_of_whole_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, q, k = rng.normal(size=(300, 8)), rng.normal(size=(40, 8)), 20
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "entity_id int, v array<double>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id int, v array<double>")
    held = {i: rng.choice(300, 10, replace=False).tolist() for i in range(0, 45, 2)}
    truth = spark.createDataFrame([(i, int(t)) for i, ts in held.items() for t in ts], "query_id int, track_id int")
    score = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    best = np.argsort(-score, axis=1)[:, :k]
    want = {(i, t) for i, ts in held.items() if i < 40 for t in ts if t in best[i]}
    assert want
    for most in (10**12, 0):
        monkeypatch.setattr(retrieve, "SENT_BYTES", most)
        found = retrieve.dense(queries, vectors, k, wanted=truth)
        assert {(r.query_id, r.track_id) for r in found.collect()} == want and found.count() == len(want)
        one = coldstart.recall(queries, truth, {"all": vectors}, k).first()
        mine = [len(set(ts) & set(best[i].tolist())) / 10 for i, ts in held.items() if i < 40]
        assert one.n == len(mine) and abs(one.recall - np.mean(mine)) < 1e-6


def test_files_of_a_system_are_gone_before_the_next(spark, monkeypatch):
    done = []
    monkeypatch.setattr(coldstart, "released", lambda s: done.append(s))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, v array<double>")
    vectors = spark.createDataFrame([(7, [1.0, 0.5])], "entity_id int, v array<double>")
    truth = spark.createDataFrame([(1, 7)], "query_id int, track_id int")
    got = coldstart.recall(queries, truth, {"a": vectors, "b": vectors}, 1)
    assert len(done) == 3 and {(r.system, r.n, r.recall) for r in got.collect()} == {("a", 1, 1.0), ("b", 1, 1.0)}
