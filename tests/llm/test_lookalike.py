import pytest

from tracklake.llm import lookalike as la


@pytest.mark.parametrize(
    "a, b",
    [
        ("ｈａｒｂｏｕｒ", "harbour"), ("cafe\u0301", "café"), ("a\u00a0b", "a b"), ("a\u3000b", "a b"), ("a\tb", "a b"), ("so\u200bft\u00ad", "soft"), ("ﬁre ﬂow", "fire flow"),
        ("Part Ⅱ", "Part II"), ("and then…", "and then..."), ("wi‐fi", "wi-fi"), ("wi‑fi", "wi-fi"), ("\u1107\u1161", "바"), ("ⅽoffee", "coffee"), ("ﾊﾞ", "バ"),
    ],
)
def test_folding(a, b):
    assert la.folded(a) == la.folded(b)


@pytest.mark.parametrize("a, b", [("x²", "x2"), ("A", "a"), ("e", "é"), ("a b", "ab"), ("a.", "a"), ("½", "1/2"), ("™", "TM"), ("①", "1"), ("a  b", "a b"), ("´", " ")])
def test_kept_apart(a, b):
    assert la.look(la.folded(a)) != la.look(la.folded(b))


def test_dominant_script():
    assert la.describe("hаrbour")[1][0] == "harbour" == la.describe("hаrbour")[2]  # one Cyrillic letter
    assert la.describe("театp")[1][0] == "театр"  # one Latin letter
    assert la.describe("harbour")[0] is False and la.describe("ɡreen")[:2] == (True, ["green"])
    assert la.look("é") == la.look("е\u0301")


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "id int, name string, canonical string")
    recs = la.records(df, "name", "id", "name")
    got = {(r.id_a, r.id_b) for r in la.same_look_pairs(recs).collect()}
    forms = {r.id: r.canonical for r in la.canonical(recs).collect()}
    return got, forms


def test_pairs_against_all_pairs(spark):
    texts = [
        "Harbour of Zo", "Hаrbour of Zo", "Ｈａｒｂｏｕｒ\u3000of\u3000Zo", "harbour of Zo", "Harbour of Zo!", "Нarbоur оf Zо", "Harbour of Zo", None, "", "  ", "\u3000 ", "театр", "театp", "тeатр", "сор", "cop", "cор", "Ρονi", "Povi",
        "nеver сlean", "nevеr clеan", "x" * 50_000, "х" + "x" * 49_999,
    ]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z"), (None, "Harbour of Zo", "z")] + [(3000 + 1500 * k, "Harbour of Zo", "z") for k in range(5)]
    got, forms = pairs(spark, rows)
    known = {i: t for i, t, _ in rows if i is not None and t is not None}
    key = {i: la.look(la.folded(t)) for i, t in known.items()}
    want = {(a, b) for a in known for b in known if a < b and key[a] == key[b] and known[a] != known[b]}
    assert got == want
    assert set(forms) == set(known)
    for a in known:
        for b in known:
            assert (forms[a] == forms[b]) == (key[a] == key[b]), (known[a][:20], known[b][:20])
    assert forms[1] == "Harbour of Zo" and forms[12] == "театр" and forms[8] == ""


def test_empty(spark):
    assert pairs(spark, []) == (set(), {})


def test_each_token_is_settled_by_the_step_that_can(spark):
    """Script and vocabulary first; the class step only where no clean spelling occurs or two clean ones look the same."""
    texts = ["harbour", "hаrbour", "nevеr clean", "nеver clean", "сор", "cop", "cор", "plain word", "ｗｉｄｅ"]
    recs = la.records(spark.createDataFrame(list(enumerate(texts)), "id int, name string"), "name", "id", "name")
    cut = la.folded_texts(recs.select("field", "text").distinct())
    step = {r.token: (r.fix, r.step) for r in la.repairs(cut).collect()}
    assert step["hаrbour"] == ("harbour", "script") and "harbour" not in step and "plain" not in step and "clean" not in step
    assert {s[1] for t, s in step.items() if t in ("nevеr", "nеver")} == {"class"}
    assert len({step.get(t, (t,))[0] for t in ("сор", "cop", "cор")}) == 1 == len({step.get(t, (t,))[0] for t in ("nevеr", "nеver")})
    told = {r.step: (r.n_tokens, r.n_texts) for r in la.steps(recs).collect()}
    assert told["fold"] == (None, 1) and told["script"][0] >= 1 and told["class"][0] >= 2
