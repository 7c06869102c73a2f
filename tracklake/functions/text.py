"""Text normalisation and title tokens as column expressions.

Everything but Unicode decomposition is built from native expressions; decomposition has no native
counterpart and is one Arrow-batched function, which leaves ASCII text alone.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no musical meaning in a title.
STOPWORDS = """
    a an and the of for to in on my me you your our it its is are be with by at as
    playlist playlists list lists mix mixes music musica songs song track tracks
    tunes stuff things thing new old good great best fav favs favorite favorites
    favourite favourites vol volume pt part no na da de la el los las un une
    spotify shuffle random misc other others more all every some what that this
    now then just too very really much many one two three four five
""".split()


def fold_text(text: str | None) -> str | None:
    """Compatibility decomposition, combining marks dropped, lower case."""
    if text is None or text.isascii():
        return text.lower() if text is not None else None
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded_all(s: pd.Series) -> pd.Series:
    return s.map(lambda texts: [fold_text(t) for t in texts], na_action="ignore")


def _plain(c: Column) -> Column:
    """What is left of a folded text."""
    kept = F.regexp_replace(c, r"[^a-z0-9'&\s]+", " ")
    return F.trim(F.regexp_replace(F.replace(kept, F.lit("&"), F.lit(" and ")), r"\s+", " "))


def normalize(c: Column) -> Column:
    """Lower case without accents, marks or symbols, one space between words; null stays null."""
    return _plain(folded(c))


def normalize_all(c: Column) -> Column:
    """``normalize`` of every text of an array."""
    return F.transform(_folded_all(c), _plain)


def decade_tags(c: Column) -> Column:
    """Decades named in the text, as '1990s', in order of mention, decades before years."""
    low = F.lower(c)
    named = F.regexp_extract_all(low, F.lit(r"\b((?:19|20)?[0-9]0)'?s\b"), F.lit(1))
    full = F.transform(
        named,
        lambda d: F.when(F.length(d) == 4, F.concat(d, F.lit("s")))
        .when(d.isin("50", "60", "70", "80", "90"), F.concat(F.lit("19"), d, F.lit("s")))
        .when(d.isin("00", "10", "20"), F.concat(F.lit("20"), d, F.lit("s"))),
    )
    years = F.regexp_extract_all(low, F.lit(r"\b(19[5-9][0-9]|20[0-2][0-9])\b"), F.lit(1))
    return F.array_distinct(F.concat(F.array_compact(full), F.transform(years, lambda y: F.concat(F.substring(y, 1, 3), F.lit("0s")))))


def tokenize(c: Column, min_len: int = 2) -> Column:
    """Decade tags, content words and word pairs of the text, without repeats; an empty list for null or blank text."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    raw = F.filter(F.split(F.coalesce(normalize(c), F.lit("")), " "), lambda w: F.length(w) >= min_len)
    digits = "^[0-9]+$"
    words = F.filter(raw, lambda w: ~F.array_contains(stop, w) & ~w.rlike(digits))
    n = F.greatest(F.size(raw) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(raw, 1, n).alias("a"), F.slice(raw, 2, n).alias("b"))
    kept = F.filter(pairs, lambda p: ~(F.array_contains(stop, p["a"]) & F.array_contains(stop, p["b"])) & ~(p["a"].rlike(digits) & p["b"].rlike(digits)))
    return F.array_distinct(F.concat(decade_tags(F.coalesce(c, F.lit(""))), words, F.transform(kept, lambda p: F.concat_ws(" ", p["a"], p["b"]))))


def title_tokens(c: Column, most: int = 6) -> Column:
    """The first ``most`` tokens of a title, so that a long title cannot dominate."""
    return F.slice(tokenize(c), 1, most)


def uri_tail(c: Column) -> Column:
    return F.substring_index(c, ":", -1)


def lexical_text(*fields: Column) -> Column:
    """Fields joined by spaces, genre separators opened."""
    return F.translate(F.concat_ws(" ", *fields), "|", " ")
