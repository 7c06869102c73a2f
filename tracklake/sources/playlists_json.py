"""Playlists as nested JSON: ``{"playlists": [{pid, name, tracks: [{pos, track_uri, ...}]}]}`` in numbered slice files."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACK = "pos int, track_uri string, track_name string, artist_name string, artist_uri string, album_name string, duration_ms int"
PLAYLIST = f"pid int, name string, tracks array<struct<{', '.join(f.replace(' ', ':', 1) for f in TRACK.split(', '))}>>"
SLICE = f"playlists array<struct<{PLAYLIST.split(', ', 2)[0].replace(' ', ':')}, name:string, {PLAYLIST.split(', ', 2)[2].replace(' ', ':', 1)}>>"


def slice_paths(folder: str, most: int | None = None) -> list[str]:
    """Slice files of a folder in the numeric order of their first number, the first ``most`` of them."""

    def number(p: Path) -> tuple[int, str]:
        found = re.search(r"(\d+)", p.name)
        return (int(found[1]) if found else 0, p.name)

    return [str(p) for p in sorted(Path(folder).glob("*.json"), key=number)][:most]


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pid, name, tracks) of all playlists; a missing name is an empty one. The schema is given, so files are read once."""
    raw = spark.read.schema(SLICE).option("multiLine", True).json(paths)
    return from_slices(raw)


def from_slices(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("playlists").alias("p")).select("p.pid", F.coalesce("p.name", F.lit("")).alias("name"), "p.tracks")


def parse(texts: DataFrame, column: str) -> DataFrame:
    """The same from a column of JSON slices."""
    return from_slices(texts.select(F.from_json(column, SLICE).alias("s")).select("s.*"))


def entries(playlists: DataFrame, low: int = 5, high: int = 250) -> DataFrame:
    """(pid, track_uri, position, metadata): each track once a playlist at its first place, of playlists of ``low`` to ``high`` raw tracks."""
    kept = playlists.where(F.size("tracks").between(low, high)).select("pid", F.posexplode("tracks").alias("position", "t")).where("t.track_uri IS NOT NULL")
    first = F.min(F.struct("position", "t")).alias("f")
    return kept.groupBy("pid", F.col("t.track_uri").alias("track_uri")).agg(first).select("pid", "track_uri", "f.position", F.col("f.t.track_name").alias("name"), F.col("f.t.artist_name").alias("artist"), F.col("f.t.artist_uri").alias("artist_uri"), F.col("f.t.album_name").alias("album"), F.col("f.t.duration_ms").alias("duration_ms"))


def numbered(keys: DataFrame, key: str, order: list, out: str = "track_id") -> DataFrame:
    """Dense ids from 0 in a total order, without sorting all rows in one task.

    Rows are range-partitioned by the order; each range's size, one number a range, gives its first id.
    """
    from tracklake.session import checkpointed

    ranged = checkpointed(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    first = F.coalesce(*[F.when(F.col("__part") == p, F.lit(s)) for p, s in start.items()], F.lit(0))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.select(key, (first + place).cast("int").alias(out))


def catalog(es: DataFrame, least_support: int = 1) -> DataFrame:
    """(track_id, track_uri, metadata, n_playlists): ids in order of first sight (pid, then place), of tracks on enough playlists."""
    seen = es.groupBy("track_uri").agg(F.count(F.lit(1)).alias("n_playlists"), F.min(F.struct("pid", "position", "name", "artist", "artist_uri", "album", "duration_ms")).alias("f")).where(F.col("n_playlists") >= least_support)
    flat = seen.select("track_uri", "n_playlists", "f.*")
    ids = numbered(flat.select("track_uri", "pid", "position"), "track_uri", [F.col("pid"), F.col("position"), F.col("track_uri")])
    return flat.drop("pid", "position").join(ids, "track_uri")
