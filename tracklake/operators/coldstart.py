"""Content-based cold start: predict the vector of a track nobody has played, and test whether that helps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions import sound as sd
from tracklake.operators.model import Ridge, fit_ridge, standardized
from tracklake.operators.retrieve import dense
from tracklake.session import checkpointed, released


def usable(tracks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(track_id, has_descriptors, has_vector): the two reasons a track can be left out of a fit."""
    described = F.lit(True)
    for c in sd.DESCRIPTORS:
        described = described & F.col(c).isNotNull()
    live = vectors.select("track_id", (sd.norm(F.col("v")) > 0).alias("__live"))
    return tracks.join(live, "track_id", "left").select("track_id", described.alias("has_descriptors"), F.coalesce("__live", F.lit(False)).alias("has_vector"))


def descriptors(tracks: DataFrame) -> DataFrame:
    """(track_id, x): nine standardised numbers, the key as twelve flags, the mode, and 1; only fully described tracks."""
    full = tracks.dropna(subset=list(sd.DESCRIPTORS))
    z = standardized(full, "track_id", list(sd.DESCRIPTORS), 12)
    flags = full.select("track_id", sd.one_hot_key(F.col("key")).alias("k"), F.coalesce("mode", F.lit(0.0)).alias("m"))
    return z.join(flags, "track_id").select("track_id", F.concat(F.array(*sd.DESCRIPTORS), F.transform("k", lambda i: i.cast("double")), F.array(F.col("m"), F.lit(1.0))).alias("x"))


def fit(tracks: DataFrame, vectors: DataFrame, cold: DataFrame, alphas: tuple[float, ...] = (1.0, 10.0, 100.0, 1000.0)) -> tuple[Ridge, DataFrame]:
    """(ridge from descriptors to unit vectors, predicted (entity_id, v) of the cold tracks). Cold tracks take no part in the fit."""
    x = checkpointed(descriptors(tracks))
    y = vectors.select("track_id", sd.unit(F.col("v")).alias("y")).where("y IS NOT NULL")
    rows = x.join(y, "track_id").join(cold.select("track_id"), "track_id", "left_anti")
    held = F.pmod(F.xxhash64("track_id"), F.lit(10)) == 0
    model = fit_ridge(rows.where(~held), rows.where(held), "x", "y", alphas)
    ahead = model.predict(x.join(cold.select("track_id"), "track_id", "left_semi"), "x")
    return model, ahead.select(F.col("track_id").alias("entity_id"), F.col("predicted").alias("v"))


def recall(queries: DataFrame, truth: DataFrame, systems: dict[str, DataFrame], k: int = 100) -> DataFrame:
    """(system, n, recall): mean recall@k of the cold tracks held out, among cold tracks only.

    ``queries`` is (query_id, v); each system is (entity_id, v) of the cold tracks.
    """
    asked = checkpointed(queries.select("query_id", "v"))
    truth = checkpointed(truth.select("query_id", "track_id"))
    released(asked.sparkSession)
    size = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("g")).join(asked.select("query_id"), "query_id", "left_semi")
    out = None
    for name, vectors in systems.items():
        # Lists stay in the tasks: only their hits are shuffled. Each system is done before the next begins.
        hits = dense(asked, vectors, k, wanted=truth).groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
        one = checkpointed(size.join(hits, "query_id", "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("h", F.lit(0)) / F.col("g")).alias("recall")).withColumn("system", F.lit(name)))
        out = one if out is None else out.unionByName(one)
        del hits, one
        released(asked.sparkSession)
    return out.select("system", "n", F.round("recall", 6).alias("recall"))
