"""Results by artist over the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators.heavy import at_least_share, per_key
from tracklake.plans.registry import query
from tracklake.session import table


@query("SELECT artist_uri FROM entries WHERE artist_uri IS NOT NULL GROUP BY artist_uri HAVING count(*) * 1000 >= 15 * (SELECT count(*) FROM entries)")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "entries")
    counts = per_key(entries, ["artist_uri"], F.count(F.lit(1)).alias("n_rows"))
    return at_least_share(counts, "n_rows", 15, entries).where("artist_uri IS NOT NULL").select("artist_uri")


@query(
    "SELECT artist_uri, count(*) AS n_rows, count(track_id) AS n_tracked, CAST(min(position) AS BIGINT) AS first_position, max(position) AS last_position,"
    " round(sum(weight), 4) AS weight, max(loaded_at) AS last_loaded FROM entries GROUP BY artist_uri"
)
def p1_artist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of entries by artist, with their extent."""
    return per_key(
        table(spark, sf_dir, "entries"),
        ["artist_uri"],
        F.count(F.lit(1)).alias("n_rows"),
        F.count("track_id").alias("n_tracked"),
        F.min("position").cast("long").alias("first_position"),
        F.max("position").alias("last_position"),
        F.round(F.sum("weight"), 4).alias("weight"),
        F.max("loaded_at").alias("last_loaded"),
    )


@query(
    "SELECT artist_uri, count(*) AS n_tracks, count(n_playlists) AS n_counted, CAST(sum(n_playlists) AS BIGINT) AS n_playlists, max(n_playlists) AS most_playlists"
    " FROM (SELECT track_id, min(artist_uri) AS artist_uri, min(n_playlists) AS n_playlists FROM tracks GROUP BY track_id) GROUP BY artist_uri"
)
def p1_artist_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_playlists by artist, each track once however often its row is repeated."""
    once = per_key(table(spark, sf_dir, "tracks"), ["track_id"], F.min("artist_uri").alias("artist_uri"), F.min("n_playlists").alias("n_playlists"))
    return per_key(
        once,
        ["artist_uri"],
        F.count(F.lit(1)).alias("n_tracks"),
        F.count("n_playlists").alias("n_counted"),
        F.sum("n_playlists").alias("n_playlists"),
        F.max("n_playlists").alias("most_playlists"),
    )
