import numpy as np
from pyspark.sql import functions as F

from tracklake.llm import knn

SCHEMA = "space string, entity_id int, v array<double>, label string"


def table(spark, x, space="s"):
    return spark.createDataFrame([(space, int(i), [float(z) for z in r] if r is not None else None, "a") for i, r in x], SCHEMA)


def brute(x, limit):
    ids = list(x)
    u = {i: np.asarray(v, float) / np.linalg.norm(v) for i, v in x.items()}
    return {(a, b) for a in ids for b in ids if a < b and u[a] @ u[b] >= limit}


def test_pairs_and_lists_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 16))
    x = {i: base[i] for i in range(400)}
    x |= {1000 + i: base[i] * 3 + 0.02 * rng.standard_normal(16) for i in range(50)}  # near copies
    x |= {2000 + i: base[7] * (i + 1) for i in range(40)}  # one direction, many lengths
    rows = [*x.items(), (5000, None), (5001, np.zeros(16)), (3, base[3])]
    df = table(spark, rows).unionByName(spark.createDataFrame([("s", 6000, [1.0, 0.0], "x"), ("s", 6001, [float("nan")] * 16, "x"), (None, 1, [1.0], "x"), ("t", 1, [1.0, 2.0], "x")], SCHEMA))
    index = knn.build_index(df, leaf_rows=64)
    assert index.forests["s", 16].depth >= 2
    got = {(r.id_a, r.id_b) for r in knn.similar_pairs(index, 0.9, 16).collect() if r.space == "s"}
    assert got == brute(x, 0.9)
    near = knn.nearest(index, 10, 1000).where("space = 's'").collect()
    per = {}
    for r in near:
        per.setdefault(r.entity_id, []).append(r)
    assert set(per) == set(x)  # dead, lone-length and other-space rows ask nothing and are no neighbours
    u = {i: v / np.linalg.norm(v) for i, v in x.items()}
    for i in (0, 7, 1003, 2005, 39):
        want = sorted(((round(-float(u[i] @ u[j]), 4), j) for j in x if j != i))[:10]
        have = sorted((round(-r.cosine, 4), r.neighbour_id) for r in per[i])
        assert [w[0] for w in want] == [h[0] for h in have] and len({h[1] for h in have}) == 10
    # Copies are ordered by id.
    assert [r.neighbour_id for r in sorted(per[2000], key=lambda r: r.rank)][:3] == [7, 2001, 2002]


def test_recall_on_query_set(spark):
    rng = np.random.default_rng(2)
    df = table(spark, list(enumerate(rng.standard_normal((3000, 24)))))
    index = knn.build_index(df, trees=8, leaf_rows=100)
    chosen = F.col("id") % 50 == 0
    exact = {(r.entity_id, r.neighbour_id) for r in knn.nearest_exact(index, 10, chosen).collect()}
    found = {(r.entity_id, r.neighbour_id) for r in knn.nearest(index, 10, 128, chosen).collect()}
    assert len(exact) == 600 and len(exact & found) / len(exact) >= 0.9


def test_queue_order_is_that_of_popping():
    import heapq

    rng = np.random.default_rng(3)
    sample = rng.standard_normal((500, 8)).astype(np.float32)
    forest = knn.fit_forest(sample, 3, 4, 1)
    for row in sample[:20]:
        margin = forest.planes @ row - forest.cuts
        heap = [(-np.inf, t, 0) for t in range(3)]
        popped = []
        while len(popped) < 7:
            p, t, node = heapq.heappop(heap)
            if node >= 15:
                popped.append(t * 16 + node - 15)
                continue
            m = margin[t * 15 + node]
            heapq.heappush(heap, (-min(-p, -m), t, 2 * node + 1))
            heapq.heappush(heap, (-min(-p, m), t, 2 * node + 2))
        got = forest.best_leaves(row[None, :], 7)[0].tolist()
        # The leaf of each tree comes first, in any order; then the order is that of the queue.
        assert sorted(got[:3]) == sorted(popped[:3]) == sorted(forest.own_leaves(row[None, :])[0])
        # Then the order is that of the queue, where nodes of equal priority may come in any.

        def worth(leaf):
            t, node, least = leaf // 16, leaf % 16 + 15, np.inf
            while node:
                node, right = (node - 1) // 2, node % 2 == 0
                least = min(least, margin[t * 15 + node] * (1 if right else -1))
            return least

        assert np.allclose([worth(x) for x in got[3:]], [worth(x) for x in popped[3:]])


def test_walks_below_the_upper_levels_are_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    sample = rng.standard_normal((2000, 8)).astype(np.float32)
    forest = knn.fit_forest(sample, 3, 6, 1)
    own, best = forest.own_leaves(sample), forest.best_leaves(sample, 9)
    monkeypatch.setattr(knn, "TOP_LEVELS", 2)
    # The last bits of a margin may differ, so a row on a plane may change sides.
    assert (forest.own_leaves(sample) == own).mean() > 0.999 and (forest.best_leaves(sample, 9) == best).mean() > 0.999
    assert np.bincount(own[:, 0], minlength=64).max() <= 40


def test_large_leaves_are_cut_and_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((600, 12))
    x = {i: base[i] for i in range(600)} | {1000 + i: base[i] + 0.03 * rng.standard_normal(12) for i in range(80)}
    df = table(spark, list(x.items()))
    index = knn.build_index(df, leaf_rows=400, trees=2)
    whole = {(r.id_a, r.id_b) for r in knn.similar_pairs(index, 0.9, 4).collect()}
    assert whole == brute(x, 0.9)
    monkeypatch.setattr(knn, "PART_MEMBERS", 100)
    assert {(r.id_a, r.id_b) for r in knn.similar_pairs(index, 0.9, 4).collect()} == whole
    index.leaf_rows = 8  # every part through a tree of its own
    found = {(r.id_a, r.id_b) for r in knn.similar_pairs(index, 0.9, 4).collect()}
    assert found <= whole and len(found) >= 0.97 * len(whole)


def test_rounding_error_is_known():
    rng = np.random.default_rng(10)
    u = rng.standard_normal((200, 33)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    packed, error = knn._rounded(u)
    import pyarrow as pa

    back = knn._opened(pa.array(packed, pa.binary()), 33)
    assert np.allclose(np.linalg.norm(back - u, axis=1), error, atol=1e-6)
    gap = np.abs(back @ back.T - u @ u.T)
    assert (gap <= error[:, None] * (1 + error) + error + 1e-5).all()


def test_empty(spark):
    index = knn.build_index(spark.createDataFrame([], SCHEMA))
    assert knn.similar_pairs(index).count() == 0 and knn.nearest(index).count() == 0
