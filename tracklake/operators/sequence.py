"""Ordered continuation: prefixes, slots, horizons and the ordered-prefix model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.skew import salted_join


def sequences(df: DataFrame, keep_repeats: bool = False, least: int = 2) -> DataFrame:
    """(pid, tracks): one list per pid, nulls out, repeats out unless kept, at least ``least`` long."""
    tracks = F.array_compact("tracks")
    clean = df.where("pid IS NOT NULL").dropDuplicates(["pid"]).select("pid", (tracks if keep_repeats else F.array_distinct(tracks)).alias("tracks"))
    return clean.where(F.size("tracks") >= least)


def prefixes(seq: DataFrame, k: int, least_rest: int = 5) -> DataFrame:
    """(pid, seeds, held_out): the first k tracks and the rest, of lists with at least ``least_rest`` left."""
    return seq.where(F.size("tracks") >= k + least_rest).select("pid", F.slice("tracks", 1, k).alias("seeds"), F.slice("tracks", k + 1, 2**31 - 1 - k).alias("held_out"))


def slots(seq: DataFrame, window: int = 3) -> DataFrame:
    """(pid, position, track_id, slot_1 .. slot_w, has_1 .. has_w): the tracks just before each, newest first."""
    at = seq.select("pid", F.posexplode("tracks").alias("position", "track_id"))
    w = Window.partitionBy("pid").orderBy("position")
    back = {f"slot_{i}": F.lag("track_id", i).over(w) for i in range(1, window + 1)}
    out = at.withColumns(back)
    return out.withColumns({f"has_{i}": F.col(f"slot_{i}").isNotNull().cast("int") for i in range(1, window + 1)})


def _with_vectors(seq: DataFrame, units: DataFrame) -> DataFrame:
    """(pid, steps): each list as (position, u), u null without a vector; one list is one input row, so bounded by it."""
    at = seq.select("pid", F.posexplode("tracks").alias("position", "track_id"))
    joined = salted_join(at, units, ["track_id"], [F.col("pid")], "left")
    return joined.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("position", "u"))).alias("steps"))


def _lists(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, positions, vectors with zeros where there is none, presence) of each list of a batch."""
    steps = batch.column(1)
    offsets = steps.offsets.to_numpy()
    inner = steps.values
    position, u = inner.field(0).to_numpy(), inner.field(1)
    has = u.is_valid().to_numpy(zero_copy_only=False)
    v = np.zeros((len(u), dim))
    v[has] = u.drop_null().flatten().to_numpy().reshape(-1, dim)
    for row, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        yield row, position[a:b], v[a:b], has[a:b]


def _toward(v: np.ndarray, has: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, length of the mean, direction) of the present vectors among each place and the next ones."""
    total = np.vstack([np.zeros(v.shape[1]), np.cumsum(v, 0)])
    count = np.append(0, np.cumsum(has))
    end = np.minimum(np.arange(len(v)) + horizon, len(v))
    n = count[end] - count[: len(v)]
    mean = (total[end] - total[: len(v)]) / np.maximum(n, 1)[:, None]
    size = np.linalg.norm(mean, axis=1)
    return n, size, np.divide(mean, size[:, None], out=np.zeros_like(mean), where=size[:, None] > 1e-12)


def _arrays(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _dim(units: DataFrame) -> int:
    one = units.select(F.size("u").alias("d")).limit(1).first()
    return one.d if one else 0


def examples(seq: DataFrame, units: DataFrame, window: int = 3, horizon: int = 3) -> DataFrame:
    """(pid, position, x, y): features of the prefix before each position and the mean direction of what follows.

    x: unit vectors of the last ``window`` tracks (zeros where there is none, or no vector), their presence flags,
    the direction of the mean of the whole prefix, and 1. y: direction of the mean of the next ``horizon`` tracks,
    clipped at the end of the list. ``units`` is (track_id, u). Lists are worked on as matrices.
    """
    dim = _dim(units)
    kind = seq.schema["pid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, position, v, has in _lists(batch, dim):
                n, size, y = _toward(v, has, horizon)
                at = np.flatnonzero((np.arange(len(v)) > 0) & (n > 0) & (size > 1e-12))
                if not len(at):
                    continue
                back = at[:, None] - np.arange(1, window + 1)[None, :]
                slot = np.where((back >= 0)[:, :, None], v[np.maximum(back, 0)], 0).reshape(len(at), -1)
                centre = np.cumsum(v, 0)[at - 1]
                length = np.linalg.norm(centre, axis=1, keepdims=True)
                centre = np.divide(centre, length, out=np.zeros_like(centre), where=length > 1e-12)
                x = np.hstack([slot, (back >= 0).astype(float), centre, np.ones((len(at), 1))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), row))), pa.array(position[at], pa.int32()), _arrays(x), _arrays(y[at])], names=["pid", "position", "x", "y"])

    return _with_vectors(seq, units).mapInArrow(run, f"pid {kind}, position int, x array<double>, y array<double>")


def horizon_mean(seq: DataFrame, units: DataFrame, horizon: int = 3) -> DataFrame:
    """(pid, position, n, spread, y): mean of the vectors at each position and the next ones, as length and direction; positions without any vector ahead have no row."""
    dim = _dim(units)
    kind = seq.schema["pid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, position, v, has in _lists(batch, dim):
                n, size, y = _toward(v, has, horizon)
                at = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(at), row))), pa.array(position[at], pa.int32()), pa.array(n[at], pa.int32()), pa.array(size[at]), _arrays(y[at])], names=["pid", "position", "n", "spread", "y"]
                )

    return _with_vectors(seq, units).mapInArrow(run, f"pid {kind}, position int, n int, spread double, y array<double>")


def shuffled(seq: DataFrame, seed: str = "control") -> DataFrame:
    """The same lists with their order destroyed by hash: the control for any use of order."""
    keyed = F.transform("tracks", lambda t: F.struct(F.md5(F.concat_ws(":", F.col("pid").cast("string"), t.cast("string"), F.lit(seed))).alias("h"), t.alias("t")))
    return seq.withColumn("tracks", F.transform(F.array_sort(keyed), lambda x: x["t"]))
