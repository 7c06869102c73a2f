"""Encoding a whole corpus with a public byte-level BPE vocabulary.

Pre-tokenisation is a finite transducer run over code-point arrays, not a regular expression:

1. a batch of texts becomes one ``uint32`` array of code points, texts separated by a reset symbol;
2. a class table turns code points into symbols (letter, number, blank, other, contraction mark ...),
   with the two characters of look-ahead that the split rule needs folded into the symbol;
3. every symbol is a transition function on eight states. Function composition is associative, so the
   states come from a blocked scan: compose each block, scan the block totals, then replay each block
   from its known entry state. All blocks advance together as NumPy columns;
4. ``(state, symbol)`` says whether a new slice starts at that character.

Slices are merged into ids once per distinct slice (a bounded cache per worker) and the start offset of
every id's slice is kept, so a token range can be turned back into a character range.

Results: a null or an empty text gives an empty list. Strings that look like special tokens are ordinary
text. Repeated rows are encoded again (once, through the cache). Any other column passes through; one that has
the name of a result is replaced by it.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Distinct slices a worker remembers; beyond that the cache starts anew (a speed bound, never a result bound).
CACHE_SLICES = 200_000
#: Characters that one scan works on at a time, unless a single text is longer.
SCAN_CHARS = 1_000_000

# Symbols of the transducer.
LETTER, NUMBER, OTHER, MARK1, MARK2, JOIN, LONE, INNER, RESET = range(9)
# States: nothing open; a run of letters, numbers, others, blanks; a blank waiting to join; inside a contraction.
FREE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_BLANK, WAITING, ONE_LEFT, TWO_LEFT = range(8)

# The contraction tails of the public split pattern, after an apostrophe.
TAILS_1 = "sdmt"
TAILS_2 = ("ll", "ve", "re")
# The White_Space code points of Unicode.
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a slice start here), both indexed [symbol, state]."""
    to = np.zeros((9, 8), np.uint8)
    new = np.ones((9, 8), bool)
    run_of = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}
    for symbol, run in run_of.items():
        to[symbol, :] = run
        new[symbol, [run, WAITING]] = False
    for symbol, opened in ((MARK1, ONE_LEFT), (MARK2, TWO_LEFT)):
        to[symbol, :] = opened
        # Inside a run of others, or after a joining blank, the mark is just one more other character.
        to[symbol, [IN_OTHER, WAITING]] = IN_OTHER
        new[symbol, [IN_OTHER, WAITING]] = False
    to[JOIN, :], to[LONE, :], to[INNER, :] = WAITING, FREE, IN_BLANK
    new[INNER, IN_BLANK] = False
    for symbol in range(RESET):
        to[symbol, TWO_LEFT], to[symbol, ONE_LEFT] = ONE_LEFT, FREE
        new[symbol, [TWO_LEFT, ONE_LEFT]] = False
    to[RESET, :] = FREE
    return to, new


NEXT, STARTS = _transitions()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 blank."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = 1
        elif kind == "N":
            out[c] = 2
    out[BLANKS] = 3
    return out


def symbols(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``last`` marks the final character of each text."""
    cls = _classes()[points]
    out = np.array([OTHER, LETTER, NUMBER, INNER], np.uint8)[cls]
    one = np.append(points[1:], 0)
    two = np.append(points[2:], [0, 0])[: len(points)]
    one_ok = ~last
    two_ok = one_ok & ~np.append(last[1:], True)
    # A blank whose next character is no blank: a plain space joins it, any other blank stands alone.
    closing = (cls == 3) & one_ok & (np.append(cls[1:], 0) != 3)
    out[closing] = np.where(points[closing] == 0x20, JOIN, LONE)
    mark = points == 0x27
    tail1 = np.zeros(len(points), bool)
    for c in TAILS_1:
        tail1 |= one == ord(c)
    tail2 = np.zeros(len(points), bool)
    for a, b in TAILS_2:
        tail2 |= (one == ord(a)) & (two == ord(b))
    out[mark & two_ok & tail2] = MARK2
    out[mark & one_ok & tail1] = MARK1
    return out


def scan(symbol: np.ndarray) -> np.ndarray:
    """The state before each symbol, starting FREE: a blocked scan over composed transition functions."""
    n = len(symbol)
    if n == 0:
        return np.zeros(0, np.uint8)
    block = min(1024, max(16, int(n**0.5)))
    rows = -(-n // block)
    grid = np.full(rows * block, RESET, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(block):
        function = NEXT[grid[j, :, None], function]
    entry = np.zeros(rows, np.uint8)
    state = FREE
    for r, f in enumerate(function.tolist()):
        entry[r] = state
        state = f[state]
    out = np.empty((block, rows), np.uint8)
    now = entry
    for j in range(block):
        out[j] = now
        now = NEXT[grid[j], now]
    return out.T.reshape(-1)[:n]


def slice_starts(texts: list[str]) -> list[np.ndarray]:
    """Character offsets at which the slices of each text start (empty for an empty text)."""
    joined = "".join(t + "\x00" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    last = np.zeros(len(points), bool)
    last[ends] = True
    last[ends[lengths > 0] - 1] = True
    symbol = symbols(points, last)
    symbol[ends] = RESET
    start = STARTS[symbol, scan(symbol)]
    start[ends] = False
    at = np.flatnonzero(start)
    cuts = np.searchsorted(at, ends)
    begins = ends - lengths
    return [at[a:b] - s for a, b, s in zip(np.append(0, cuts[:-1]), cuts, begins, strict=True)]


class Encoder:
    """Slices to ids with a cache of merged slices; the vocabulary file is a path, never part of this code."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # The pattern takes a slice whole, so that the library only merges pairs; splitting is ours.
        self._merge = tiktoken.Encoding("slices", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self._cache: dict[str, list[int]] = {}

    def merged(self, piece: str) -> list[int]:
        ids = self._cache.get(piece)
        if ids is None:
            ids = self._merge.encode_ordinary(piece)
            if len(piece) <= 64:
                if len(self._cache) >= CACHE_SLICES:
                    self._cache.clear()
                self._cache[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """(ids, character offset of each id's slice) of every text."""
        out: list[tuple[list[int], list[int]]] = []
        for group in _groups(texts):
            for text, starts in zip(group, slice_starts(group), strict=True):
                bounds = [*starts.tolist(), len(text)]
                ids: list[int] = []
                offsets: list[int] = []
                merged = self.merged
                for a, b in zip(bounds, bounds[1:], strict=False):
                    piece = merged(text[a:b])
                    ids += piece
                    offsets += [a] * len(piece)
                out.append((ids, offsets))
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of every text."""
        merged = self.merged
        return [
            sum(len(merged(text[a:b])) for a, b in zip(starts, [*starts[1:], len(text)], strict=False))
            for group in _groups(texts)
            for text, starts in zip(group, (s.tolist() for s in slice_starts(group)), strict=True)
        ]


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about SCAN_CHARS characters; a longer text forms a run of its own. Null is ''."""
    group, size = [], 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > SCAN_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker; workers are reused between tasks."""
    return Encoder(vocabulary)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Short slices of the batches, so that a worker never holds the ids of a whole batch as Python lists."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _with(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns of the new fields' names, which the result replaces, and the schema with the fields."""
    kept = df.drop(*[f.name for f in fields])
    return kept, T.StructType([*kept.schema.fields, *fields])


def with_ids(df: DataFrame, text: str = "text", ids: str = "ids", offsets: str | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` plus the token ids of ``text`` and, on request, the character offset of each id's slice."""
    ints = T.ArrayType(T.IntegerType(), False)
    df, schema = _with(df, [T.StructField(c, ints, False) for c in (ids, *([offsets] if offsets else []))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in _parts(batches):
            done = enc.encode(batch.column(at).to_pylist())
            new = [pa.array([d[k] for d in done], pa.list_(pa.int32())) for k in range(1 + bool(offsets))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def with_token_count(df: DataFrame, text: str = "text", count: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY, keep_text: bool = False) -> DataFrame:
    """``df`` plus the number of tokens of ``text`` (0 for null and empty); the text is dropped unless kept."""
    df, full = _with(df, [T.StructField(count, T.IntegerType(), False)])
    at = df.columns.index(text)
    schema = full if keep_text else T.StructType([f for f in full.fields if f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in _parts(batches):
            n = pa.array(enc.count(batch.column(at).to_pylist()), pa.int32())
            columns = [c for k, c in enumerate(batch.columns) if keep_text or k != at]
            yield pa.RecordBatch.from_arrays([*columns, n], names=schema.names)

    return df.mapInArrow(run, schema)
