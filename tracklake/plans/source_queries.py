"""Nested sources and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import build as b
from tracklake.plans import sql as q
from tracklake.plans.build_queries import tracks
from tracklake.plans.registry import query
from tracklake.sources import playlists_json as js
from tracklake.session import table
from tracklake.streaming import popularity as pop


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences as JSON slices of about 100 playlists."""
    t = tracks(spark, sf_dir).select("track_id", "track_uri", F.col("name").alias("track_name"), F.col("artist").alias("artist_name"), "artist_uri", F.col("album").alias("album_name"), "duration_ms")
    s = b.once(table(spark, sf_dir, "sequences"), "pid").select("pid", F.posexplode("tracks").alias("pos", "track_id")).where("track_id IS NOT NULL").join(t, "track_id")
    one = F.struct("pos", "track_uri", "track_name", "artist_name", "artist_uri", "album_name", "duration_ms")
    lists = s.groupBy("pid").agg(F.array_sort(F.collect_list(one)).alias("tracks")).select(F.struct("pid", F.lit(None).cast("string").alias("name"), "tracks").alias("p"), F.floor(F.col("pid") / 100).alias("slice"))
    return lists.groupBy("slice").agg(F.to_json(F.struct(F.collect_list("p").alias("playlists"))).alias("text"))


_JSON = f"{q.SEQUENCES}, e AS (SELECT pid, track_id, min(i) AS i, count(*) AS c FROM (SELECT pid, unnest(tracks) AS track_id, generate_subscripts(tracks, 1) - 1 AS i FROM sq) WHERE track_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT pid FROM e GROUP BY 1 HAVING sum(c) BETWEEN 5 AND 250), {q.TRACKS}"


@query(f"WITH {_JSON} SELECT pid, count(*) AS n_tracks, count(DISTINCT artist_uri) AS n_artists FROM e JOIN t USING (track_id) WHERE pid IN (SELECT pid FROM r) GROUP BY 1")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON to entries: length filter, explode, first occurrence."""
    es = js.entries(js.parse(_slices(spark, sf_dir), "text"))
    return es.groupBy("pid").agg(F.count(F.lit(1)).alias("n_tracks"), F.countDistinct("artist_uri").alias("n_artists"))


@query(f"""WITH {_JSON}, k AS (SELECT track_uri, count(*) AS n_playlists, min(pid) AS pid, min({{'a': pid, 'b': i}}) AS f FROM e JOIN t USING (track_id) WHERE pid IN (SELECT pid FROM r) GROUP BY 1 HAVING count(*) >= 4)
    SELECT track_uri, n_playlists, CAST(row_number() OVER (ORDER BY f.a, (SELECT count(*) FROM (SELECT unnest(tracks) AS x, generate_subscripts(tracks, 1) - 1 AS y FROM sq WHERE sq.pid = f.a) z WHERE z.y < f.b AND z.x IS NOT NULL), track_uri) - 1 AS INTEGER) AS track_id FROM k""")
def json_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids in order of first sight, of tracks on at least four playlists."""
    return js.catalog(js.entries(js.parse(_slices(spark, sf_dir), "text")), 4).select("track_uri", "n_playlists", "track_id")


@query("SELECT date_trunc('day', ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type: the batch form of the windowed stream."""
    return pop.windowed(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a pause of half an hour."""
    s = pop.sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
