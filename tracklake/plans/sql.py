"""Common parts of the checking SQL."""

from tracklake.functions.text import STOPWORDS

TRACKS = "t AS (SELECT DISTINCT * FROM tracks)"
PLAYLISTS = "p AS (SELECT DISTINCT * FROM playlists)"
CHALLENGES = "ch AS (SELECT DISTINCT * FROM challenges)"
INTENTS = "it AS (SELECT DISTINCT * FROM intents)"
CANDIDATES = "cand AS (SELECT DISTINCT * FROM candidates)"
SEQUENCES = "sq AS (SELECT DISTINCT * FROM sequences)"
VECTORS = "vec AS (SELECT DISTINCT * FROM vectors)"
INTER = "inter AS (SELECT playlist_id, track_id, min(position) AS position FROM entries WHERE playlist_id IS NOT NULL AND track_id IS NOT NULL GROUP BY 1, 2)"
SUPPORT = "sup AS (SELECT track_id, count(*) AS support FROM inter GROUP BY 1)"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "ⅰⅴⅼⅽⅿⅭⅯ"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + "ivlcmCM"
_PAIRS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "Ⅱ": "II", "Ⅳ": "IV", "…": "..."}


def fold(x: str) -> str:
    """SQL of a text without accents, in lower case."""
    folded = f"translate({x}, '{_WIDE.replace(chr(39), chr(39) * 2)}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"
    for a, b in _PAIRS.items():
        folded = f"replace({folded}, '{a}', '{b}')"
    return f"lower(strip_accents({folded}))"


def norm(x: str) -> str:
    """SQL of the normalised form of a text."""
    kept = rf"regexp_replace({fold(x)}, '[^a-z0-9''&\s]+', ' ', 'g')"
    return rf"trim(regexp_replace(replace({kept}, '&', ' and '), '\s+', ' ', 'g'))"


def tokens(source: str, key: str, x: str, most: int = 6, name: str = "tok") -> str:
    """CTEs ending in ``name(key, place, token)``: the first ``most`` tokens of text ``x`` of each row of ``source``."""
    stop = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
    decade = "CASE WHEN length(d) = 4 THEN d || 's' WHEN d IN ('50', '60', '70', '80', '90') THEN '19' || d || 's' WHEN d IN ('00', '10', '20') THEN '20' || d || 's' END"
    return rf"""
        raw_{name} AS (
            SELECT {key} AS key, list_filter(string_split({norm(f"coalesce({x}, '')")}, ' '), lambda w: length(w) >= 2) AS w,
                list_filter(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '\b((?:19|20)?[0-9]0)''?s\b', 1), lambda d: {decade}), lambda d: d IS NOT NULL) AS d,
                list_transform(regexp_extract_all(lower(coalesce({x}, '')), '\b(19[5-9][0-9]|20[0-2][0-9])\b', 1), lambda y: y[1:3] || '0s') AS y FROM {source}
        ),
        listed_{name} AS (
            SELECT key, list_concat(list_concat(d, y), list_concat(
                list_filter(w, lambda a: NOT list_contains({stop}, a) AND NOT regexp_full_match(a, '[0-9]+')),
                list_transform(list_filter(range(1, len(w)), lambda i: NOT (list_contains({stop}, w[i]) AND list_contains({stop}, w[i + 1])) AND NOT (regexp_full_match(w[i], '[0-9]+') AND regexp_full_match(w[i + 1], '[0-9]+'))), lambda i: w[i] || ' ' || w[i + 1])
            )) AS l FROM raw_{name}
        ),
        spread_{name} AS (SELECT key, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM listed_{name}),
        firsts_{name} AS (SELECT key, token, min(i) AS i FROM spread_{name} GROUP BY 1, 2),
        {name} AS (SELECT key, token, place FROM (SELECT key, token, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS place FROM firsts_{name}) WHERE place < {most})"""
