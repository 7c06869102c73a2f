"""Skew helpers, aggregates and joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracklake.operators import heavy, skew


def test_per_key_and_share(spark):
    rows = [("hot", 1)] * 500 + [(f"k{i}", i) for i in range(490)] + [(None, 3)] * 10
    df = spark.createDataFrame(rows, "key string, x int")
    counts = heavy.per_key(df, ["key"], F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
    got = {r.key: (r.n, r.x) for r in counts.collect()}
    assert got["hot"] == (500, 500) and got[None] == (10, 30) and len(got) == 492
    assert {r.key for r in heavy.at_least_share(counts, "n", 10, df).collect()} == {"hot", None}
    assert {r.key for r in heavy.at_least_share(counts, "n", 11, df).collect()} == {"hot"}
    assert heavy.at_least_share(heavy.per_key(df.limit(0), ["key"], F.count(F.lit(1)).alias("n")), "n", 1, df.limit(0)).count() == 0
    for bad in (F.collect_list("x"), F.percentile("x", 0.5), F.collect_set("x")):
        with pytest.raises(ValueError):
            heavy.per_key(df, ["key"], bad)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_join(spark, how):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 2, 3, 4, None]), i) for i in range(600)]
    right = [(1, "a"), (2, "b"), (2, "c"), (9, "d"), (None, "e")]
    a, b = spark.createDataFrame(left, "k int, i int"), spark.createDataFrame(right, "k int, v string")
    assert sorted(map(tuple, skew.salted_join(a, b, ["k"], [F.col("i")], how).collect()), key=repr) == sorted(map(tuple, a.join(b, "k", how).collect()), key=repr)


def test_heavy_keys_are_few(spark):
    df = spark.createDataFrame([(1,)] * 900 + [(i,) for i in range(2, 102)] + [(None,)] * 1000, "k int")
    assert [r.k for r in skew.heavy_keys(df, ["k"], 0.1).collect()] == [1]
    assert skew.heavy_keys(df.limit(0), ["k"]).count() == 0


def test_expand_pairs(spark):
    rng = random.Random(2)
    members = [("g", rng.choice("abcd"), i * 700) for i in range(40)]
    links = [("g", "a", "b"), ("g", "c", "c"), ("g", "b", "d")]
    got = {tuple(r) for r in skew.expand_pairs(spark.createDataFrame(members, "g string, l string, i long"), spark.createDataFrame(links, "g string, label_a string, label_b string"), ["g"], "l", "i").collect()}
    linked = {frozenset(x[1:]) for x in links}
    want = {("g", x, y) for _, p, x in members for _, q, y in members if x < y and frozenset((p, q)) in linked}
    assert got == want


def test_no_row_number_over_everything():
    """No operator orders all rows in one task."""
    import pathlib
    import re

    for p in pathlib.Path("tracklake").rglob("*.py"):
        for m in re.finditer(r"Window\.orderBy\(\"(\w+)\"\)", p.read_text()):
            assert m[1] == "g", (p, m[0])  # the bounded table of range sums in the loop
