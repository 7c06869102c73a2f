"""Catalog building over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import sound as sd
from tracklake.functions import text as tx
from tracklake.operators import build as b
from tracklake.plans import sql as q
from tracklake.plans.registry import query
from tracklake.session import table


def inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.interactions(table(spark, sf_dir, "entries"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.once(table(spark, sf_dir, "tracks"), "track_id")


def tags(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    tokens = b.playlist_tokens(table(spark, sf_dir, "playlists"))
    return b.track_tags(inter(spark, sf_dir), tokens, b.tag_vocabulary(tokens, least))


TAGS = f"""{q.INTER}, {q.PLAYLISTS}, {q.tokens("p", "playlist_id", "name")},
    vocab AS (SELECT token, count(DISTINCT key) AS df FROM tok GROUP BY token HAVING count(DISTINCT key) >= 5),
    tags AS (SELECT track_id, token AS tag, count(*) AS n FROM inter JOIN tok ON playlist_id = key WHERE token IN (SELECT token FROM vocab) GROUP BY 1, 2)"""


@query(f"WITH {q.INTER} SELECT playlist_id, track_id, position FROM inter")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inter(spark, sf_dir)


@query(
    "SELECT playlist_id, position, track_id, artist_uri, weight, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id, position"
    " ORDER BY loaded_at DESC, coalesce(track_id, 2147483647)) AS r FROM entries WHERE playlist_id IS NOT NULL AND position IS NOT NULL) WHERE r = 1"
)
def current_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.current_entries(table(spark, sf_dir, "entries")).select("playlist_id", "position", "track_id", "artist_uri", "weight", "loaded_at")


@query(f"WITH {q.INTER} SELECT playlist_id, count(*) AS n_tracks FROM inter GROUP BY 1 HAVING count(*) BETWEEN 5 AND 250")
def playlist_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.length_between(inter(spark, sf_dir), "playlist_id", 5, 250)


@query(f"WITH {q.INTER} SELECT track_id, count(*) AS support FROM inter GROUP BY 1 HAVING count(*) >= 4")
def catalog_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.support(inter(spark, sf_dir), 4)


@query(f"""WITH {q.INTER},
    a AS (SELECT * FROM inter WHERE playlist_id IN (SELECT playlist_id FROM inter GROUP BY 1 HAVING count(*) BETWEEN 5 AND 250)),
    s AS (SELECT * FROM a WHERE track_id IN (SELECT track_id FROM a GROUP BY 1 HAVING count(*) >= 4)),
    k AS (SELECT * FROM s WHERE playlist_id IN (SELECT playlist_id FROM s GROUP BY 1 HAVING count(*) >= 5))
    SELECT playlist_id, count(*) AS n_tracks, CAST(sum(track_id) AS BIGINT) AS track_sum FROM k GROUP BY 1""")
def compacted_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each playlist after the three filters."""
    kept = b.supported(inter(spark, sf_dir))
    return kept.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("track_id").alias("track_sum"))


@query(f"WITH {q.PLAYLISTS} SELECT playlist_id, {q.norm('name')} AS title FROM p WHERE name IS NOT NULL")
def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.once(table(spark, sf_dir, "playlists"), "playlist_id").where("name IS NOT NULL")
    return p.select("playlist_id", tx.normalize(F.col("name")).alias("title"))


@query(f"WITH {q.PLAYLISTS}, {q.tokens('p', 'playlist_id', 'name')} SELECT key AS playlist_id, CAST(place AS INTEGER) AS place, token FROM tok")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.playlist_tokens(table(spark, sf_dir, "playlists"))


@query(f"WITH {TAGS} SELECT token, df FROM vocab")
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.tag_vocabulary(b.playlist_tokens(table(spark, sf_dir, "playlists")), 5)


@query(f"WITH {TAGS} SELECT track_id, tag, n FROM tags")
def folksonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir)


@query(f"WITH {TAGS} SELECT track_id, tag, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, tag) AS r FROM tags) WHERE r <= 6")
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.operators.retrieve import top_per

    return top_per(tags(spark, sf_dir), ["track_id"], [F.desc("n"), F.col("tag")], 6, start=1)


@query(f"""WITH {q.TRACKS}, g AS (SELECT artist_uri, unnest(string_split(genre, '|')) AS g FROM t WHERE artist_uri IS NOT NULL AND genre IS NOT NULL),
    s AS (SELECT artist_uri, string_agg(DISTINCT g, '|' ORDER BY g) AS genres FROM g GROUP BY 1)
    SELECT a.artist_uri, coalesce(genres, '') AS genres FROM (SELECT DISTINCT artist_uri FROM t WHERE artist_uri IS NOT NULL) a LEFT JOIN s USING (artist_uri)""")
def artist_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.genre_sets(tracks(spark, sf_dir).where("artist_uri IS NOT NULL"), "artist_uri")


@query(f"""WITH {q.TRACKS}, a AS (SELECT track_id, energy, tempo FROM t WHERE has_audio), s AS (SELECT track_id, energy, tempo, valence, explicit, genre FROM t WHERE explicit_known)
    SELECT a.track_id, coalesce(a.energy, s.energy) AS energy, coalesce(a.tempo, s.tempo) AS tempo, s.valence, coalesce(s.explicit, false) AS explicit, s.track_id IS NOT NULL AND s.explicit IS NOT NULL AS explicit_known, s.genre
    FROM a LEFT JOIN s USING (track_id)""")
def merged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feature sources in one: a wide one without labels (every track with audio) and one with labels (where they are known)."""
    t = tracks(spark, sf_dir)
    wide = t.where("has_audio").select("track_id", "energy", "tempo")
    labelled = t.where("explicit_known").select("track_id", "energy", "tempo", "valence", "explicit", "genre")
    return b.merged_features(wide, labelled, "track_id", ["energy", "tempo", "valence"])


@query(f"WITH {q.TRACKS}, k AS (SELECT *, row_number() OVER (PARTITION BY artist_uri ORDER BY popularity DESC NULLS LAST, track_id) AS r FROM t WHERE artist_uri IS NOT NULL AND track_id IN (SELECT track_id FROM entries)) SELECT artist_uri, track_id, popularity FROM k WHERE r = 1")
def reduced_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected scan, semi-join on the ids in use, the most popular of each artist."""
    used = table(spark, sf_dir, "entries").where("track_id IS NOT NULL").select("track_id").distinct()
    t = tracks(spark, sf_dir).select("artist_uri", "track_id", "popularity").where("artist_uri IS NOT NULL").join(used, "track_id", "left_semi")
    return b.keep_most_popular(t, "artist_uri", [F.desc_nulls_last("popularity"), F.col("track_id")]).select("artist_uri", "track_id", "popularity")


@query(f"""WITH {q.INTER}, {q.TRACKS}, s AS (SELECT count(*) AS n FROM inter GROUP BY playlist_id)
    SELECT (SELECT count(*) FROM s) AS n_playlists, CAST((SELECT sum(n) FROM s) AS BIGINT) AS n_interactions, round((SELECT quantile_cont(n, 0.5) FROM s), 4) AS median_length, count(*) AS n_tracks,
    round(avg(CAST(has_audio AS INTEGER)), 4) AS audio_coverage, round(sum(CAST(has_audio AS INTEGER) * coalesce(n_playlists, 0)) / sum(coalesce(n_playlists, 0)), 4) AS audio_coverage_impressions,
    round(avg(CAST(explicit_known AS INTEGER)), 4) AS explicit_coverage FROM t""")
def build_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.provenance(inter(spark, sf_dir), tracks(spark, sf_dir))


HOLDOUT = f"""{q.INTER}, {q.PLAYLISTS},
    held AS (SELECT playlist_id, name AS title FROM p WHERE trim(name) <> '' AND playlist_id IN (SELECT playlist_id FROM inter GROUP BY 1 HAVING count(*) >= 30)
        ORDER BY md5(CAST(playlist_id AS VARCHAR) || ':holdout'), playlist_id LIMIT 100)"""


@query(f"""WITH {HOLDOUT}, l AS (SELECT playlist_id, title, list(track_id ORDER BY position, track_id) AS l FROM inter JOIN held USING (playlist_id) GROUP BY 1, 2),
    e AS (SELECT *, unnest([0, 1, 5, 10, 25]) AS k FROM l)
    SELECT CAST(k AS INTEGER) AS k, playlist_id, title, l[1:k] AS seed_tracks, l[k + 1:] AS held_out FROM e WHERE len(l) >= k + 5""")
def challenge_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout playlists chosen by hash, cut after their first k tracks."""
    i = inter(spark, sf_dir)
    return b.challenges(i, b.holdout(i, table(spark, sf_dir, "playlists"), 100))


@query(f"""WITH {HOLDOUT}, p2 AS (SELECT * FROM p WHERE playlist_id NOT IN (SELECT playlist_id FROM held)), {q.tokens("p2", "playlist_id", "name")},
    vocab AS (SELECT token FROM tok GROUP BY token HAVING count(DISTINCT key) >= 5)
    SELECT track_id, token AS tag, count(*) AS n FROM inter JOIN tok ON playlist_id = key WHERE token IN (SELECT token FROM vocab) GROUP BY 1, 2""")
def holdout_free_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag table served to evaluation: the holdout is gone before anything is derived."""
    i, p = inter(spark, sf_dir), table(spark, sf_dir, "playlists")
    held = b.holdout(i, p, 100)
    tokens = b.playlist_tokens(b.without(p, held))
    return b.track_tags(b.without(i, held), tokens, b.tag_vocabulary(tokens, 5))


@query(f"WITH {q.TRACKS}, s AS (SELECT max(ln(1 + n_playlists)) AS hi, min(ln(1 + n_playlists)) AS lo FROM t WHERE n_playlists IS NOT NULL) SELECT track_id, round(ln(1 + n_playlists) / hi, 6) AS prior, round((ln(1 + n_playlists) - lo) / (hi - lo), 6) AS scaled FROM t, s WHERE n_playlists IS NOT NULL")
def popularity_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log popularity over its maximum, and scaled to 0-1. The extremes are one broadcast row, not a window."""
    t = tracks(spark, sf_dir).where("n_playlists IS NOT NULL").select("track_id", F.log1p("n_playlists").alias("l"))
    ends = t.agg(F.max("l").alias("hi"), F.min("l").alias("lo"))
    hi, lo = ends.select("hi").scalar(), ends.select("lo").scalar()
    return t.select("track_id", F.round(F.col("l") / hi, 6).alias("prior"), F.round((F.col("l") - lo) / (hi - lo), 6).alias("scaled"))


_Z = ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} < 1e-6 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in sd.AUDIO)
_M = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in sd.AUDIO)


@query(f"WITH {q.TRACKS}, m AS (SELECT {_M} FROM t WHERE has_audio) SELECT track_id, {_Z} FROM t, m WHERE has_audio")
def audio_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.operators.model import standardized

    return standardized(tracks(spark, sf_dir).where("has_audio"), "track_id", list(sd.AUDIO))


@query(f"WITH {q.TRACKS} SELECT track_id, CASE WHEN key BETWEEN 0 AND 11 THEN list_transform(range(12), lambda i: CASE WHEN i = key THEN 1 ELSE 0 END) ELSE list_transform(range(12), lambda i: 0) END AS one_hot FROM t")
def key_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("track_id", sd.one_hot_key(F.col("key")).alias("one_hot"))


@query(f"WITH {q.TRACKS} SELECT track_uri, string_split(track_uri, ':')[-1] AS tail, name, CASE WHEN isnan(energy) THEN NULL ELSE energy END AS energy FROM t WHERE track_id IN (SELECT unnest(seed_tracks) FROM challenges)")
def track_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups of the seeds of all queries."""
    wanted = table(spark, sf_dir, "challenges").select(F.explode("seed_tracks").alias("track_id")).distinct()
    return tracks(spark, sf_dir).join(wanted, "track_id", "left_semi").select("track_uri", tx.uri_tail(F.col("track_uri")).alias("tail"), "name", F.nanvl("energy", F.lit(None)).alias("energy"))
