"""Catalog building: entries, support, tags, features, provenance, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import text as tx
from tracklake.operators.skew import salted_join


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key, for tables whose repeated rows are equal. Rows with a null key are kept as one."""
    return df.dropDuplicates(list(keys))


def interactions(entries: DataFrame) -> DataFrame:
    """(playlist_id, track_id, position): each track once a playlist, at its first position. Null ids are left out."""
    return entries.where("playlist_id IS NOT NULL AND track_id IS NOT NULL").groupBy("playlist_id", "track_id").agg(F.min("position").alias("position"))


def current_entries(entries: DataFrame) -> DataFrame:
    """The latest delivery of each place of a playlist: by loaded_at, then the smallest track. A max over a struct, so it combines map-side."""
    latest = F.max_by(F.struct("track_id", "artist_uri", "weight", "added_at", "loaded_at"), F.struct("loaded_at", -F.coalesce(F.col("track_id"), F.lit(2147483647))))
    return entries.where("playlist_id IS NOT NULL AND position IS NOT NULL").groupBy("playlist_id", "position").agg(latest.alias("e")).select("playlist_id", "position", "e.*")


def length_between(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Keys whose number of rows lies in [low, high]."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_tracks")).where(F.col("n_tracks").between(low, high))


def support(inter: DataFrame, least: int = 1) -> DataFrame:
    """(track_id, support): number of playlists that hold the track, from ``least`` on."""
    return inter.groupBy("track_id").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def supported(inter: DataFrame, least_support: int = 4, low: int = 5, high: int = 250) -> DataFrame:
    """Interactions after the length filter, the support filter and the second length filter, in this order."""
    first = inter.join(length_between(inter, "playlist_id", low, high).drop("n_tracks"), "playlist_id", "left_semi")
    strong = salted_join(first, support(first, least_support).drop("support"), ["track_id"], [F.col("playlist_id")], "left_semi")
    return strong.join(length_between(strong, "playlist_id", low, 2**31 - 1).drop("n_tracks"), "playlist_id", "left_semi")


def playlist_tokens(playlists: DataFrame, most: int = 6) -> DataFrame:
    """(playlist_id, place, token) of every title."""
    titled = once(playlists, "playlist_id").select("playlist_id", F.posexplode(tx.title_tokens(F.col("name"), most)).alias("place", "token"))
    return titled


def tag_vocabulary(tokens: DataFrame, least: int = 5) -> DataFrame:
    """(token, df): tokens on at least ``least`` playlists."""
    return tokens.groupBy("token").agg(F.countDistinct("playlist_id").alias("df")).where(F.col("df") >= least)


def track_tags(inter: DataFrame, tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(track_id, tag, n): playlists that hold the track and bear the tag."""
    known = tokens.join(vocabulary.select("token"), "token", "left_semi").select("playlist_id", F.col("token").alias("tag"))
    return inter.select("playlist_id", "track_id").join(known, "playlist_id").groupBy("track_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def merged_features(primary: DataFrame, secondary: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every row of ``primary`` with each feature filled from ``secondary`` where missing, and what is known of ``explicit``."""
    other = secondary.select(key, *[F.col(c).alias(f"__{c}") for c in columns if c in secondary.columns], F.col("explicit").alias("__explicit"), F.col("genre").alias("__genre"))
    out = primary.join(other, key, "left")
    filled = [F.coalesce(F.col(c) if c in primary.columns else F.lit(None), F.col(f"__{c}") if c in secondary.columns else F.lit(None)).alias(c) for c in columns]
    return out.select(key, *filled, F.coalesce("__explicit", F.lit(False)).alias("explicit"), F.col("__explicit").isNotNull().alias("explicit_known"), F.col("__genre").alias("genre"))


def genre_sets(df: DataFrame, key: str, genre: str = "genre") -> DataFrame:
    """(key, genres): all genres of a key, sorted and joined by ``|``; empty text when none is known."""
    each = df.select(key, F.explode_outer(F.split(genre, r"\|")).alias("g"))
    return each.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("g")), "|").alias("genres"))


def keep_most_popular(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def provenance(inter: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row of counts and coverages of a build."""
    sizes = inter.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n"))
    a = sizes.agg(F.count(F.lit(1)).alias("n_playlists"), F.sum("n").alias("n_interactions"), F.round(F.percentile("n", 0.5), 4).alias("median_length"))
    weight = F.coalesce(F.col("n_playlists"), F.lit(0))
    b = tracks.agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.round(F.avg(F.col("has_audio").cast("int")), 4).alias("audio_coverage"),
        F.round(F.sum(F.col("has_audio").cast("int") * weight) / F.sum(weight), 4).alias("audio_coverage_impressions"),
        F.round(F.avg(F.col("explicit_known").cast("int")), 4).alias("explicit_coverage"),
    )
    # Two single rows side by side.
    return a.withColumn("one", F.lit(1)).join(F.broadcast(b.withColumn("one", F.lit(1))), "one").drop("one")


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows with the smallest hash of key and seed: the same on any partitioning."""
    return df.withColumn("__h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))).orderBy("__h", key).limit(n).drop("__h")


def holdout(inter: DataFrame, playlists: DataFrame, n: int, seed: str = "holdout", seeds: tuple[int, ...] = (0, 1, 5, 10, 25), least_rest: int = 5) -> DataFrame:
    """Playlists set aside for evaluation: long enough, with a title, chosen by hash."""
    long = inter.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(seeds) + least_rest)
    titled = once(playlists, "playlist_id").where("trim(name) <> ''").select("playlist_id", "pid", F.col("name").alias("title"))
    return hash_sample(titled.join(long, "playlist_id", "left_semi"), "playlist_id", n, seed)


def challenges(inter: DataFrame, held: DataFrame, seeds: tuple[int, ...] = (0, 1, 5, 10, 25), least_rest: int = 5) -> DataFrame:
    """(k, playlist_id, title, seed_tracks, held_out): the first k tracks by position and the rest, for each k."""
    listed = inter.join(held, "playlist_id").groupBy("playlist_id", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "track_id"))), lambda x: x["track_id"]).alias("tracks"))
    each = listed.withColumn("k", F.explode(F.array(*[F.lit(k) for k in seeds])))
    rest = F.greatest(F.size("tracks") - F.col("k"), F.lit(0))
    return each.where(F.size("tracks") >= F.col("k") + least_rest).select("k", "playlist_id", "title", F.slice("tracks", 1, F.col("k")).alias("seed_tracks"), F.slice("tracks", F.col("k") + 1, rest).alias("held_out"))


def without(df: DataFrame, held: DataFrame, key: str = "playlist_id") -> DataFrame:
    """``df`` without the held-out playlists; to be applied to every input of a model, tags included."""
    return df.join(held.select(key), key, "left_anti")
