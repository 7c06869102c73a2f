import math
import random

import numpy as np
import pytest

from tracklake.llm import mixing, splitting, tokens

DOCS = "id long, source string, n int, n_tokens string"
GOALS = "source string, target_share double, max_repeats int"


def mix(spark, docs, goals):
    planned, mixed = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(goals, GOALS), "id", "source", "n")
    return {r.source: r for r in mixing.shares(planned, mixed).collect()}, {r.id: r for r in mixed.collect()}


def test_budgets(spark):
    rng = random.Random(1)
    docs = [(i, "big" if i % 3 else ("small" if i % 2 else None), rng.randint(0, 90), "x") for i in range(3000)]
    docs += [(9000, "tiny", 10, "x"), (9001, "unwanted", 50, "x"), (9002, "big", None, "x"), (None, "big", 5, "x")] + docs[:20]
    goals = [("big", 0.3, 2), ("small", 0.35, 4), ("tiny", 0.2, 3), ("nobody", 0.15, 2), ("nobody", 0.15, 2), (None, 0.1, 1)]
    shares, mixed = mix(spark, docs, goals)
    once = {i: (s, n or 0) for i, s, n, _ in docs if i is not None}
    total = sum(n for _, n in once.values())
    have = {}
    for s, n in once.values():
        have[s] = have.get(s, 0) + n
    assert {s for s, r in shares.items() if r.is_short} == {"tiny", "nobody"}
    for s, share, most in (("big", 0.3, 2), ("small", 0.35, 4)):
        budget = share * total
        assert 0 <= budget - shares[s].n_used <= 90 and shares[s].most_uses <= most
        uses = {r.n_uses for r in mixed.values() if r.source == s}
        assert uses <= {math.floor(budget / have[s]), math.floor(budget / have[s]) + 1}
    assert mixed[9000].n_uses == 3 and 9001 not in mixed and shares["nobody"].n_used == 0
    assert abs(sum(r.share_reached for r in shares.values()) - 1) < 1e-4


def test_prefix_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    docs = [(i, "s", 7, "x") for i in range(5000)] + [(10_000 + i, None, 7, "x") for i in range(5000)]
    shares, mixed = mix(spark, docs, [("s", 0.25, 1)])
    assert shares["s"].n_used == 2500 * 7 and len(mixed) == 2500


def test_mix_empty(spark):
    shares, mixed = mix(spark, [], [("s", 0.5, 2)])
    assert mixed == {} and shares["s"].n_used == 0
    assert mix(spark, [(1, "s", 5, "x")], [])[1] == {}


TEXTS = [
    "word " * 900, "a" * 12_000, "漢字" * 3000, "😀" * 1500, "\n" * 3000, "One. Two! Three?\n\n" * 200, ("Line of words here\n" * 5 + "\n") * 60, " " * 4000 + "x", "日本語の文。" * 400, "x" * 3 + " 12 " * 1500,
]


@pytest.mark.parametrize("limit, overlap", [(512, 64), (128, 0), (100, 40)])
def test_pieces_cover_and_fit(limit, overlap):
    enc, lengths = tokens.encoder(tokens.DEFAULT_VOCABULARY), splitting._byte_lengths(tokens.DEFAULT_VOCABULARY)
    for t in TEXTS:
        n, cuts = splitting.cut(t, enc, lengths, limit, overlap)
        assert n == enc.count([t])[0] > 0
        assert cuts[0][0] == 0 and cuts[-1][1] == len(t)
        for a, b, m in cuts:
            assert m == enc.count([t[a:b]])[0] <= limit
        for (a, b, _), (c, d, _) in zip(cuts, cuts[1:], strict=False):
            assert a < c <= b < d and enc.count([t[c:b]])[0] <= overlap


def test_cuts_are_natural():
    enc, lengths = tokens.encoder(tokens.DEFAULT_VOCABULARY), splitting._byte_lengths(tokens.DEFAULT_VOCABULARY)
    t = ("This is a sentence of words. " * 6 + "\n\n") * 40
    strong = splitting.strengths(t)
    assert all(strong[b] >= 2 for _, b, _ in splitting.cut(t, enc, lengths, 512, 64)[1])


def test_strengths():
    s = splitting.strengths("Hi you.  Go\nnow\r\n\r\nEnd “yes.” ok。次x")
    text = "Hi you.  Go\nnow\r\n\r\nEnd “yes.” ok。次x"
    assert s[text.index(" you")] == 1 and s[text.index("  Go")] == 2 and s[text.index("now")] == 3 and s[text.index("End")] == 4 and s[text.index(" ok")] == 2 and s[text.index("次")] == 2


def test_pieces_table(spark):
    df = spark.createDataFrame([(1, "word " * 900, 5), (2, None, 5), (3, "", 5), (4, "short", 5), (4, "short", 5)], "doc_id long, text string, piece int")
    rows = splitting.pieces(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {1, 4} and sum(r.doc_id == 4 for r in rows) == 2
    assert all(r.text == ("word " * 900)[r.start : r.end] for r in rows if r.doc_id == 1)
    assert splitting.pieces(df.limit(0), "doc_id", "text").count() == 0


def test_parts_are_measured_as_encoded_alone():
    rng = np.random.default_rng(4)
    alphabet = list("ab C1 9.,'\n\t -é日🔥") + ["'ll ", "'s", "  ", "don't ", "\r\n", "hello ", " world"]
    enc = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    for _ in range(60):
        text = "".join(rng.choice(alphabet, rng.integers(5, 120)))
        parts = [tuple(sorted(map(int, rng.integers(0, len(text) + 1, 2)))) for _ in range(20)]
        starts = tokens.slice_starts([text])[0].tolist()
        parts += [(a, int(rng.integers(a, len(text) + 1))) for a in starts]
        got = splitting.Measure(text, enc, enc.encode([text])[0][1]).counts(parts)
        assert got == enc.count([text[a:b] for a, b in parts]), repr(text)
