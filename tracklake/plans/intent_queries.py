"""Titles and a battery of requests read as intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import moods
from tracklake.functions import sound as sd
from tracklake.operators import build as b
from tracklake.operators import intent as it
from tracklake.plans import sql as q
from tracklake.plans.registry import query
from tracklake.plans.retrieve_queries import titled
from tracklake.session import table

#: Requests that state every kind of constraint, alone and together.
BATTERY = (
    "20 chill acoustic songs for a rainy day",
    "45 minutes of upbeat workout music, 120-160 bpm",
    "1.5 hours of deep house for driving, nothing explicit",
    "12 sad piano tracks that wind down",
    "party bangers over 125 bpm, 30 songs",
    "study music, 25 instrumental tracks under 95 bpm",
    "15 songs for a summer road trip from the 1990s",
    "family friendly dinner music for 60 minutes",
    "8 slow love songs",
    "40 fast running tracks between 150 and 175 bpm",
    "2 hours of background music for the coffee shop",
    "10 angry metal tunes, no slow ones",
    "happy morning mix, 18 songs, keep it clean",
    "late night driving, 35 tracks, around 110 bpm",
    "90 min of 80s party hits",
    "dreamy instrumental focus set at least 70 bpm, 16 tracks",
    "22 danceable club tracks that builds up",
    "romantic dinner, 14 tunes, no swearing",
    "5 moody dark songs at most 100 bpm",
    "50 feel good singalong songs from the 2000s",
)
CURVES = ", ".join(f"('{p}', '{c}', {i})" for i, (p, c) in enumerate(moods.CURVE_PHRASES.items()))
_IMPLIED = ", ".join(f"('{p}', '{c}', {i})" for i, (p, c) in enumerate((p, moods.MOOD_CURVE[p]) for p in sorted(moods.MOODS, key=len, reverse=True) if p in moods.MOOD_CURVE))


def _bounds(tables: dict[str, tuple], order: list[str]) -> str:
    return ", ".join("('" + p + "', " + ", ".join("NULL::DOUBLE" if x is None else f"{float(x)}e0" for x in tables[p]) + f", {i})" for i, p in enumerate(order))


_MOOD_ROWS = ", ".join("('" + p + "', " + ", ".join(f"CAST({v.get(c, 'NULL')} AS DOUBLE)" for c in sd.AUDIO) + ")" for p, v in moods.MOODS.items())


def wishes_sql(source: str) -> str:
    """SQL of the wishes stated in numbers, phrases and moods, of a CTE ``source`` (query_id, text)."""

    def among(names) -> str:
        return "(" + ", ".join(f"'{n}'" for n in names) + ")"

    def first(cond: str) -> str:
        return f"list_filter(range(1, len(w) + 1), lambda i: coalesce({cond}, false))[1]"

    def beats(k: str) -> str:
        return f"regexp_full_match(rtrim(w[{k}], '-'), '[0-9]{{2,3}}')"

    def lead(names) -> str:
        one, two = [n for n in names if " " not in n], [n for n in names if " " in n]
        return f"(w[i] IN {among(one)} AND {beats('i + 1')} AND w[i + 2] = 'bpm') OR (w[i] || ' ' || w[i + 1] IN {among(two)} AND {beats('i + 2')} AND w[i + 3] = 'bpm')"

    counted = f"w[i + 4] IN {among(it.NOUNS)}"
    for k in (3, 2, 1):
        counted = f"(w[i + {k}] IN {among(it.NOUNS)} OR (regexp_full_match(w[i + {k}], '[a-z]+') AND {counted}))"
    spaced = rf"regexp_replace(regexp_replace(replace(translate({q.fold("coalesce(text, '')")}, '–—''’', '--  '), '&', ' and '), '\s*-\s*', '-', 'g'), '{it.JOINED}', '\1 \2', 'g')"

    def number(at: str) -> str:
        return f"CAST(rtrim(w[{at}], '-') AS DOUBLE)"

    def after(at: str) -> str:
        return f"CASE WHEN {beats(at + ' + 1')} THEN {number(at + ' + 1')} ELSE {number(at + ' + 2')} END"

    return f"""
        lex AS (SELECT query_id, {q.norm("coalesce(text, '')")} AS normal, regexp_extract_all({spaced}, '{it.WORD}') AS w FROM {source}),
        said AS (SELECT *, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrases,
            {first(f"regexp_full_match(rtrim(w[i], '-'), '[0-9]{{1,3}}') AND {counted}")} AS c,
            {first(f"regexp_full_match(rtrim(w[i], '-'), '[0-9]+([.][0-9]+)?') AND w[i + 1] IN {among(it.HOURS)}")} AS h,
            {first(f"regexp_full_match(rtrim(w[i], '-'), '[0-9]{{1,3}}') AND w[i + 1] IN {among(it.MINUTES)}")} AS m,
            {first(f"suffix(w[i], '-') AND {beats('i')} AND {beats('i + 1')} AND w[i + 2] = 'bpm'")} AS rd,
            {first(f"{beats('i')} AND w[i + 1] IN ('to', 'and') AND {beats('i + 2')} AND w[i + 3] = 'bpm'")} AS rs,
            {first(lead(it.AT_LEAST))} AS lo, {first(lead(it.AT_MOST))} AS hi, {first(f"{beats('i')} AND w[i + 1] = 'bpm'")} AS one FROM lex),
        moods(phrase, {", ".join(sd.AUDIO)}) AS (VALUES {_MOOD_ROWS}),
        felt AS (SELECT query_id, {", ".join(f"avg({c}) AS {c}" for c in sd.AUDIO)} FROM said, moods WHERE list_contains(phrases, phrase) GROUP BY 1),
        paced(phrase, a, b, i) AS (VALUES {_bounds(moods.TEMPO_WORDS, list(moods.TEMPO_WORDS))}),
        moved(phrase, a, b, i) AS (VALUES {_bounds(moods.MOOD_TEMPO, sorted(moods.MOOD_TEMPO, key=len, reverse=True))}),
        word AS (SELECT query_id, min_by(struct_pack(a := a, b := b), i) AS t FROM said, paced WHERE list_contains(phrases, phrase) GROUP BY 1),
        mood AS (SELECT query_id, min_by(struct_pack(a := a, b := b), i) AS t FROM said, moved WHERE list_contains(phrases, phrase) GROUP BY 1),
        stated(phrase, curve, i) AS (VALUES {CURVES}), implied(phrase, curve, i) AS (VALUES {_IMPLIED}),
        sc AS (SELECT query_id, min_by(curve, i) AS s FROM said, stated WHERE contains(normal, phrase) GROUP BY 1),
        ic AS (SELECT query_id, min_by(curve, i) AS s FROM said, implied WHERE list_contains(phrases, phrase) GROUP BY 1),
        pick AS (SELECT *, CASE WHEN coalesce(rd, rs) IS NOT NULL THEN
                CASE WHEN coalesce(rd <= rs, rd IS NOT NULL) THEN struct_pack(a := {number('rd')}, b := {number('rd + 1')}) ELSE struct_pack(a := {number('rs')}, b := {number('rs + 2')}) END
            WHEN lo IS NOT NULL THEN struct_pack(a := {after('lo')}, b := NULL::DOUBLE) WHEN hi IS NOT NULL THEN struct_pack(a := NULL::DOUBLE, b := {after('hi')})
            WHEN one IS NOT NULL THEN struct_pack(a := greatest(30e0, {number('one')} - 8), b := least(250e0, {number('one')} + 8)) END AS r FROM said)
        SELECT p.query_id, CASE WHEN c IS NOT NULL THEN CAST(least(greatest({number('c')}, 1), 100) AS INTEGER) END AS track_count,
            CASE WHEN h IS NOT NULL OR m IS NOT NULL THEN least(coalesce({number('h')} * 60, 0) + coalesce({number('m')}, 0), 600) END AS target_duration_minutes,
            CASE WHEN r IS NOT NULL THEN r.a WHEN word.t IS NOT NULL THEN word.t.a ELSE mood.t.a END AS min_bpm, CASE WHEN r IS NOT NULL THEN r.b WHEN word.t IS NOT NULL THEN word.t.b ELSE mood.t.b END AS max_bpm,
            {" OR ".join(f"contains(normal, '{p}')" for p in moods.CLEAN_PHRASES)} AS exclude_explicit,
            coalesce(sc.s, CASE WHEN (ic.s = 'build' AND energy < 0.45e0) OR (ic.s = 'wind_down' AND energy > 0.62e0) THEN 'steady' ELSE ic.s END, 'steady') AS energy_curve,
            {", ".join(f"round({c}, 6) AS {c}" for c in sd.AUDIO)}
        FROM pick p LEFT JOIN word USING (query_id) LEFT JOIN mood USING (query_id) LEFT JOIN felt USING (query_id) LEFT JOIN sc USING (query_id) LEFT JOIN ic USING (query_id)"""


def _wishes(plan: DataFrame) -> DataFrame:
    return plan.select("query_id", "track_count", "target_duration_minutes", "min_bpm", "max_bpm", "exclude_explicit", "energy_curve", *[F.round(F.col("audio")[c], 6).alias(c) for c in sd.AUDIO])


def battery(spark: SparkSession) -> DataFrame:
    """(query_id, text) of the battery."""
    return spark.createDataFrame(list(enumerate(BATTERY)), "query_id int, text string")


@query(f"WITH {q.CHALLENGES}, asked AS (SELECT query_id, title AS text FROM ch WHERE trim(title) <> ''), {wishes_sql('asked')}")
def planned_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every title states in numbers, tempo, clean wishes and moods, read as a request."""
    return _wishes(it.plan(titled(spark, sf_dir)))


@query("WITH asked(query_id, text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(BATTERY)) + f"), {wishes_sql('asked')}")
def battery_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the battery of requests."""
    return _wishes(it.plan(battery(spark)))


@query()
def planned_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes, names, eras and copy of every title, with the known tags of the corpus."""
    vocabulary = b.tag_vocabulary(b.playlist_tokens(table(spark, sf_dir, "playlists")), 5)
    return it.plan(titled(spark, sf_dir), vocabulary).select("query_id", "themes", "seed_artists", "avoid_artists", "eras", "title", "description")
