import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from tracklake.llm import pairs

SCHEMA = "pid int, tracks array<int>, items string"


def baskets(seed=1, n=120, items=40):
    rng = random.Random(seed)
    return [(i, [min(int(rng.paretovariate(0.7)), items) for _ in range(rng.randint(0, 15))], "x") for i in range(n)]


def diagonal(groups):
    """Numbers of the blocks of one group."""
    return [sum(groups - k for k in range(g)) for g in range(groups)]


def test_counts_against_counting(spark, monkeypatch):
    rows = baskets()
    rows += rows[:10] + [(500, None, "x"), (501, [], "x"), (502, [7, 7, None, 7], "x"), (None, [1, 2], "x"), (0, [38, 39], "x"), (600, list(range(100, 100 + 1200)), "x"), (601, [1299, 100, 700], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    held = {}
    for p, t, _ in rows:
        if p is not None and t:
            held.setdefault(p, set()).update(x for x in t if x is not None)
    want = {}
    for s in held.values():
        for a, b in combinations(sorted(s), 2):
            want[a, b] = want.get((a, b), 0) + 1
    bags = pairs.baskets(df, "pid", "tracks")
    assert {(r.item_a, r.item_b): r.n_ab for r in pairs.pair_counts(bags).collect()} == want
    # By groups of items and by shuffled codes the counts are the same, also where a list is too long to be met whole.
    monkeypatch.setattr(pairs, "BLOCK_PAIRS", 1000)
    lists = pa.array([sorted(s) for s in held.values()], pa.list_(pa.int32()))
    for groups in (1, 2, 5):
        codes = [c for block, packed in pairs._packed_blocks(lists, groups) for c in pairs._block_codes(packed, (block, block) in [(k, k) for k in diagonal(groups)], None)]
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        assert {(int(c >> 32), int(c & 0xFFFFFFFF)): int(m) for c, m in zip(code, n, strict=True)} == want

    def finish(code, n):
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    by_code = pairs._counted_by_code(bags, finish, "code long, n long", 3, None).collect()
    assert {(r.code >> 32, r.code & 0xFFFFFFFF): r.n for r in by_code} == want


def test_null_model_keeps_degrees():
    rng = np.random.default_rng(0)
    m = rng.random((30, 80)) < rng.random((30, 1)) * 0.5
    k, s = m.sum(1), m.sum(0)
    (dk, dm), (sk, sm) = (np.unique(v[v > 0], return_counts=True) for v in (k, s))
    model = pairs.fit_null(dk.astype(float), dm.astype(float), sk.astype(float), sm.astype(float))
    p = model.chance(dk)
    assert np.allclose((p * model.size_n).sum(1), dk, rtol=1e-6)
    assert np.allclose((p * dm[:, None]).sum(0), sk, rtol=1e-6)


def plain_tail(q, k):
    law = np.ones(1)
    for x in q:
        law = np.convolve(law, [1 - x, x])
    return law[k:].sum()


def test_tail_is_poisson_binomial():
    rng = np.random.default_rng(1)
    for top in (0.02, 0.2, 0.9):
        q = rng.random((4, 6)) * top
        m = np.array([5.0, 30, 2, 8, 1, 60])
        for k in (1, 3, 8, 25):
            mean = (q * m).sum(1)
            got = pairs._tails(q, m[None, :], mean, np.full(4, k))
            want = [plain_tail(np.repeat(row, m.astype(int)), k) for row in q]
            assert np.allclose(got, want, rtol=1e-6, atol=1e-14), (top, k)


def test_surprise(spark):
    rows = baskets(3, 200) + [(1000 + i, [901, 902], "x") for i in range(6)]
    together = {(r.item_a, r.item_b): r for r in pairs.surprise(pairs.baskets(spark.createDataFrame(rows, SCHEMA), "pid", "tracks"), 5).collect()}
    bags = [set(t) for _, t, _ in rows if t]
    n = len(bags)
    for (a, b), r in together.items():
        na, nb, nab = sum(a in s for s in bags), sum(b in s for s in bags), sum(a in s and b in s for s in bags)
        assert (r.n_a, r.n_b, r.n_ab, r.n_baskets) == (na, nb, nab, n) and nab >= 5
        assert math.isclose(r.npmi, math.log(nab * n / (na * nb)) / -math.log(nab / n), rel_tol=1e-9)
    assert together[901, 902].significant and together[901, 902].p_value < 1e-6 and together[901, 902].npmi > 0.99
    common = max(together.values(), key=lambda r: r.n_ab)
    assert common.p_value > together[901, 902].p_value


def test_empty_and_full(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pairs.surprise(pairs.baskets(empty, "pid", "tracks")).count() == 0
    always = spark.createDataFrame([(i, [1, 2], "x") for i in range(6)], SCHEMA)
    (r,) = pairs.surprise(pairs.baskets(always, "pid", "tracks")).collect()
    assert r.npmi == 1.0 and not r.significant


def test_limits_known_beforehand_lose_nothing(spark, monkeypatch):
    rows = baskets(4, 300) + [(2000 + i, [901, 902, 903][: 2 + i % 2], "x") for i in range(9)] + [(3000, list(range(5000, 6100)), "x"), (3001, list(range(5000, 6100, 3)), "x")]
    bags = pairs.baskets(spark.createDataFrame(rows, SCHEMA), "pid", "tracks")
    every = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, round(r.npmi, 9)) for r in pairs.associations(bags).collect()}
    plain = {(r.item_a, r.item_b): r.n_ab for r in pairs.pair_counts(bags).collect()}
    assert {k: v[0] for k, v in every.items()} == plain
    for least, npmi in ((2, 0.3), (5, 0.75), (1, 0.9)):
        want = {k: v for k, v in every.items() if v[0] >= least and v[3] >= npmi}
        for most in (64_000_000, 0):
            monkeypatch.setattr(pairs, "NUMBER_BYTES", most)
            got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, round(r.npmi, 9)) for r in pairs.surprise(bags, least, min_npmi=npmi).collect()}
            assert got == want, (least, npmi, most)


def test_frequent_items_keep_their_own_chance():
    """Above the classes of the fit, an item of frequency n is expected n times, not as often as its bin."""
    degrees, degree_n = np.array([1.0, 40, 3001, 3017, 9000]), np.array([500.0, 60, 2, 1, 1])
    sizes, size_n = np.array([1.0, 2, 5]), np.array([9000.0, 4000, 1000])
    model = pairs.fit_null(degrees, degree_n, sizes, size_n)
    assert np.allclose((model.chance(degrees) * model.size_n).sum(1), degrees, rtol=1e-9)
