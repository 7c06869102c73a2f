import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracklake.llm import capping, terms


def test_terms_against_counting(spark):
    rng = random.Random(1)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)] + [""]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), "x") for i in range(400)]
    rows += [(900, None, "x"), (901, "", "x"), (902, "   ", "x"), (None, "lost", "x"), (903, "big " * 20_000, "x")] + rows[:50]
    df = spark.createDataFrame(rows, "id int, value string, n_records string")
    got = {r.value: (r.n_occurrences, r.n_records, r.is_rare, r.is_common) for r in terms.frequencies(df, "id", "value", " ").collect()}
    recs = {i: v for i, v, _ in rows if i is not None and v is not None}
    occ, held = {}, {}
    for i, v in recs.items():
        for w in v.split(" "):
            if w:
                occ[w] = occ.get(w, 0) + 1
                held.setdefault(w, set()).add(i)
    assert got == {w: (occ[w], len(held[w]), len(held[w]) < 3, len(held[w]) * 100 > 7 * len(recs)) for w in occ}
    assert got["big"][0] == 20_000
    whole = {r.value: r.n_records for r in terms.frequencies(df, "id", "value").collect()}
    assert whole[""] == sum(v == "" for v in recs.values())


def test_heavy_terms_only_change_the_way(spark):
    df = spark.createDataFrame([(i, "a b" if i % 2 else "a c") for i in range(100)], "id int, value string")
    recs = terms.records(df, "id", "value")
    for heavy in ([], ["a"], ["a", "b", "c", "zz"]):
        parts = terms.partial_counts(recs, " ", heavy).groupBy("term").sum("n_occurrences", "n_records").collect()
        assert {r[0]: r[1:] for r in parts if r[1]} == {"a": (100, 100), "b": (50, 50), "c": (50, 50)}


def test_terms_empty_and_marks(spark):
    df = spark.createDataFrame([], "id int, value string")
    assert terms.frequencies(df, "id", "value", " ").count() == 0
    few = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, value string")
    marked = {(r.value, r.mark) for r in terms.marks(terms.frequencies(few, "id", "value", " ")).collect()}
    assert marked == {("x", "rare"), ("x", "common"), ("y", "rare"), ("y", "common")}


def over(rows):
    """The plain rule."""
    groups = {}
    for g, i, s, cap in rows:
        if g is None or i is None or cap is None:
            continue
        best, low = groups.setdefault(g, {}), None
        s = None if s is None or s != s else s
        if i not in best or (s is not None and (best[i] is None or s > best[i])):
            best[i] = s
    caps = {}
    for g, _, _, cap in rows:
        if cap is not None and g is not None:
            caps[g] = min(cap, caps.get(g, cap))
    out = set()
    for g, best in groups.items():
        order = sorted(best, key=lambda i: (best[i] is None, -(best[i] if best[i] is not None else 0), i))
        out |= {(g, i) for i in order[max(0, caps[g]) :]}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "artist string, track_id int, score double, cap int").selectExpr("*", "'x' as id", "1 as want", "2 as lo", "3 as cut")
    return {(r.artist, r.track_id) for r in capping.over_cap(df, ["artist"], "cap", "track_id", "score").collect()}


def test_caps_against_sorting(spark):
    rng = random.Random(2)
    scores = [None, float("nan"), -1e300, -2.5, 0.0, 1e-9, 0.1, 0.5, 0.5000001, 3.0, 1e300, float("inf")]
    caps = {"a": 3, "b": 1, "c": 0, "d": 50, "e": None, "f": -2, "g": 40, None: 2}
    rows = []
    for g, cap in caps.items():
        for i in range(120):
            rows.append((g, i if g != "b" else -i, rng.choice(scores) if g != "g" else 1.0, cap))
    rows += [("h", i, float(i), 100) for i in range(3000)] + rows[:30] + [("a", None, 1.0, 3)]
    rng.shuffle(rows)
    assert run(spark, rows) == over(rows)


def test_caps_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", 1, 1.0, 1)]) == set()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from("ab"), st.integers(-(2**31), 2**31 - 1), st.one_of(st.none(), st.floats(allow_nan=False)), st.just(2)), max_size=25))
def test_caps_random(spark, rows):
    assert run(spark, rows) == over(rows)
