"""Cutting oversized texts into pieces at natural boundaries, with an overlap.

Balanced targets: the smallest number of pieces that can hold the text gives equal lengths; each cut is placed at
its target and snapped to the strongest boundary nearby (paragraph, line, sentence, word, then any token), and
the next piece starts at the strongest boundary among the last ``overlap`` tokens. Every piece is then measured as
encoded on its own; if one is over the limit, the text is laid out again with one piece more. A piece that starts
with a slice of the whole text has the same slices but for its last few characters, so only those are encoded again.

Cases. A text within the limit is one piece. Null and empty texts have no piece. Pieces are contiguous slices of
the text: together they cover it, and what two neighbours share has at most ``overlap`` tokens. A text without any break is
cut between tokens that end on a whole character. Repeated rows are cut alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracklake.llm.tokens import BLANKS, DEFAULT_VOCABULARY, Encoder, _parts, encoder

# Characters that end a sentence, those that do so without a following blank, and closing marks.
STOPS = ".!?…。！？"
FULL_STOPS = "。！？"
CLOSERS = "\"')]}»”’」』）"


@lru_cache(maxsize=2)
def _byte_lengths(vocabulary: str) -> np.ndarray:
    import base64

    with open(vocabulary, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = np.zeros(max(int(b) for _, b in pairs) + 1, np.int64)
    for a, b in pairs:
        out[int(b)] = len(base64.b64decode(a))
    return out


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character: 4 paragraph, 3 line, 2 sentence, 1 word, 0 none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    blank = np.isin(points, BLANKS)
    line = (points == 0x0A) | ((points == 0x0D) & (np.append(points[1:], 0) != 0x0A))
    out = np.zeros(n + 1, np.int8)
    prev_blank = np.append(True, blank[:-1])
    out[:n][blank != prev_blank] = 1
    closer = np.isin(points, [ord(c) for c in CLOSERS])
    index = np.arange(n)
    # The last character up to each place that is no closing mark.
    anchor = np.maximum.accumulate(np.where(closer, -1, index))
    ends = np.isin(points, [ord(c) for c in STOPS])[np.maximum(anchor, 0)] & (anchor >= 0)
    full = np.isin(points, [ord(c) for c in FULL_STOPS])[np.maximum(anchor, 0)] & (anchor >= 0)
    after = np.append(False, ends[:-1]) & blank | np.append(False, full[:-1]) & ~closer & ~np.isin(points, [ord(c) for c in STOPS])
    out[:n][after] = 2
    # Line ends in the run of blanks before each place that is no blank.
    lines = np.cumsum(line)
    word = np.maximum.accumulate(np.where(~blank, index, -1))
    last = np.append(-1, word[:-1])
    count = np.append(0, lines[:-1]) - np.where(last >= 0, lines[np.maximum(last, 0)], 0)
    start = ~blank & prev_blank
    out[:n][start & (count == 1)] = 3
    out[:n][start & (count > 1)] = 4
    out[0] = out[n] = 4
    return out


class Measure:
    """Token counts of parts of one text, each as if encoded on its own."""

    def __init__(self, text: str, enc: Encoder, offsets: list[int]):
        self.text, self.enc = text, enc
        starts, first = np.unique(np.asarray(offsets, np.int64), return_index=True)
        # Slice starts, and the number of tokens before each slice.
        self.starts, self.before = np.append(starts, len(text)), np.append(first, len(offsets))
        head = np.fromiter((text[i].isalnum() for i in starts), bool, len(starts))
        self.plain = starts[head]

    def counts(self, parts: list[tuple[int, int]]) -> list[int]:
        """A part from a slice start has the slices of the whole text up to any place whose neighbours two characters on are its own."""
        sure, tails = [], []
        for a, b in parts:
            i = int(np.searchsorted(self.starts, a))
            k = int(np.searchsorted(self.plain, b - 4, side="right")) - 1
            c = int(self.plain[k]) if k >= 0 and self.starts[i] == a else -1
            if c > a:
                sure.append(int(self.before[np.searchsorted(self.starts, c)] - self.before[i]))
                tails.append(self.text[c:b])
            else:
                sure.append(0)
                tails.append(self.text[a:b])
        return [m + n for m, n in zip(sure, self.enc.count(tails), strict=True)]


def cut(text: str, enc: Encoder, lengths: np.ndarray, limit: int, overlap: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(tokens of the text, [(start, end, tokens)] of its pieces in characters), for a text over the limit."""
    ids, offsets = enc.encode([text])[0]
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
    char_at = np.append(0, np.cumsum(width))
    token_at = np.append(0, np.cumsum(lengths[ids]))
    place = np.searchsorted(char_at, token_at)
    whole = char_at[np.minimum(place, len(points))] == token_at
    # Token starts that fall on a character: the only places where a cut can be.
    at = np.flatnonzero(whole)
    where, strong = place[at], strengths(text)[place[at]]
    measure = Measure(text, enc, offsets)
    pieces = max(2, 1 + -(-(n - limit) // max(1, limit - overlap)))
    while True:
        laid = _lay(n, pieces, limit, overlap, at, where, strong, measure)
        if laid is not None:
            return n, laid
        pieces += 1


def _lay(n: int, pieces: int, limit: int, overlap: int, at: np.ndarray, where: np.ndarray, strong: np.ndarray, measure: Measure) -> list[tuple[int, int, int]] | None:
    """Pieces for a given count, or None if one of them exceeds the limit when encoded on its own."""
    shared = min(overlap, max(0, n // pieces // 4))
    length = (n + (pieces - 1) * shared) / pieces
    near = max(1, int((length - shared) / 4))
    spans: list[tuple[int, int]] = []
    begin = 0  # index into ``at``
    for k in range(1, pieces + 1):
        if k == pieces:
            end = len(at) - 1
        else:
            target = length + (k - 1) * (length - shared)
            top = min(target + near, at[begin] + limit)
            lo, hi = np.searchsorted(at, target - near), np.searchsorted(at, top, side="right")
            lo = max(lo, begin + 1)
            if lo >= len(at):
                return None
            hi = max(hi, lo + 1)
            end = int(lo + np.lexsort((np.abs(at[lo:hi] - target), -strong[lo:hi]))[0])
        spans.append((begin, end))
        if end == len(at) - 1:
            break
        lo = max(int(np.searchsorted(at, at[end] - shared)), begin + 1)
        # The strongest start, the longest overlap among equals.
        begin = lo + int(np.argmax(strong[lo:end])) if lo < end else end
    chars = [(int(where[a]), int(where[b])) for a, b in spans]
    counts = measure.counts(chars + [(c, b) for (_, b), (c, _) in zip(chars, chars[1:], strict=False)])
    over = [k for k, m in enumerate(counts[: len(chars)]) if m > limit and spans[k][1] - spans[k][0] > 1]
    if over:
        return None
    for k, m in enumerate(counts[len(chars) :], 1):
        if m > overlap:
            # What is shared grew when encoded on its own: start later, at the next place that fits.
            b = chars[k - 1][1]
            a = next(c for c in range(spans[k][0] + 1, spans[k - 1][1] + 1) if measure.counts([(int(where[c]), b)])[0] <= overlap)
            chars[k] = (int(where[a]), chars[k][1])
            counts[k] = measure.counts([chars[k]])[0]
            if counts[k] > limit:
                return None
    return [(a, b, m) for (a, b), m in zip(chars, counts, strict=False)]


def pieces(df: DataFrame, ident: str, text: str, limit: int = 512, overlap: int = 64, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, doc_tokens, piece, start, end, n_tokens, text): ``start`` and ``end`` in characters, ``piece`` from 0."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    rows = df.select(ident, text)
    schema = rows.select(ident).schema
    for name in ("doc_tokens", "piece", "start", "end", "n_tokens"):
        schema = schema.add(name, T.IntegerType())
    schema = schema.add("text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(vocabulary), _byte_lengths(vocabulary)
        for batch in _parts(batches, 200):
            row: list[int] = []
            out: list[list] = [[], [], [], [], [], []]
            texts = batch.column(1).to_pylist()
            for i, (t, m) in enumerate(zip(texts, enc.count(texts), strict=True)):
                if not t:
                    continue
                n, cuts = (m, [(0, len(t), m)]) if m <= limit else cut(t, enc, lengths, limit, overlap)
                for k, (a, b, m) in enumerate(cuts):
                    row.append(i)
                    for o, v in zip(out, (n, k, a, b, m, t[a:b]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(o, pa.int32()) for o in out[:5]), pa.array(out[5], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
