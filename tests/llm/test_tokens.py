"""The transducer against the reference library, on hand-made and random texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklake.llm import tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


HARD = ["", " ", "  ", "\n", " \n x", "a's 'll x've !'s  's\n's 't'", "it's  we'll\tthey've", "'''s's", "x  y", "x \n", "12ab34 5", "é́ ½Ⅷ漢字かな", "<|endoftext|> a", "\u00a0a \u3000b", "\x1cq\x85", "a" * 5000, "あ" * 3000, "😀" * 500]


def test_hard_texts(library):
    got = tokens.encoder(tokens.DEFAULT_VOCABULARY).encode(HARD)
    assert [g for g, _ in got] == library(HARD)
    assert tokens.encoder(tokens.DEFAULT_VOCABULARY).count(HARD) == [len(g) for g, _ in got]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abst'lrevdm 12!?\n\t\u3000é漢.")), max_size=40), max_size=5))
def test_random_texts(texts):
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json") if not hasattr(test_random_texts, "t") else test_random_texts.t
    test_random_texts.t = t
    t.encode_special_tokens = True
    got = tokens.encoder(tokens.DEFAULT_VOCABULARY).encode(texts)
    assert [g for g, _ in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] if texts else got == []


def test_scan_equals_plain_walk():
    rng = np.random.default_rng(0)
    for n in (0, 1, 15, 16, 17, 1000, 70_000):
        symbols = rng.integers(0, 9, n).astype(np.uint8)
        state, plain = 0, []
        for s in symbols:
            plain.append(state)
            state = tokens.NEXT[s, state]
        assert tokens.scan(symbols).tolist() == plain


def test_offsets_point_at_slices():
    (ids, offsets), = tokens.encoder(tokens.DEFAULT_VOCABULARY).encode(["Hello there world"])
    assert len(ids) == len(offsets) and offsets[0] == 0 and set(offsets) <= {0, 5, 11}


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello world", None), (3, "Hello world", None)], "doc_id long, text string, n_tokens string")
    rows = {(r.doc_id, r.text): r for r in tokens.with_ids(df, offsets="at").collect()}
    assert rows[1, None].ids == [] and rows[2, ""].ids == [] and len(rows[3, "Hello world"].ids) == 2 and rows[3, "Hello world"].at == [0, 5]
    assert [r.n_tokens for r in tokens.with_token_count(df).orderBy("doc_id").collect()] == [0, 0, 2, 2]  # replaces the clashing column
    counts = tokens.with_token_count(df, count="n").orderBy("doc_id").collect()
    assert [r.n for r in counts] == [0, 0, 2, 2] and "text" not in counts[0]
    assert tokens.with_ids(df.limit(0)).count() == 0
