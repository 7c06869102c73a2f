"""At most a given number of records per contributor, the best by score.

Parallel bisection. Every contributor with more records than its cap has bounds on the key of its first record
beyond the cap. One pass counts, for all contributors together, the records between evenly spaced midpoints of
the bounds (native counts, combined map-side), moves the bounds to the cell that holds the first record too
many, and snaps them to the records in it. A contributor is settled when a key separates exactly its cap, or when its bounds have met on one score; the
ties on that score are then resolved by the same bisection over identifiers. The first pass reads its bounds beside
the records; each later one joins only contributors not yet settled. No contributor is ever sorted or held in one
task: what is counted is combined within tasks, and joins spread contributors with more than HOT_SHARE of the rows.

A limit by share is a limit by count: ``with_share`` turns a share of all records of a scope into one.

Scores are compared exactly, through the order-preserving 64-bit integer of a double.

Cases. Higher scores first; a null or NaN score comes after all others; equal scores go by identifier, smallest
first. A null contributor, a null cap and a null identifier mean no limit: the record stays. A cap below zero
counts as 0. Repeated rows of (contributor, identifier) count once, with their best score. Identifiers must be
integers. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.operators.skew import held_heavy_keys, salted_join
from tracklake.session import checkpointed

WAYS, HOT_SHARE = 64, 0.001


def ordered_key(df: DataFrame, score: str = "score") -> DataFrame:
    """``df`` with ``score`` replaced by ``key``: a long in the order of the scores, null and NaN lowest."""
    names = [c for c in df.columns if c != score]
    schema = df.select(*names).schema.add("key", T.LongType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(score)
            x = batch.column(at).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero
            bits = x.view(np.int64)
            key = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            key[np.isnan(x)] = np.iinfo(np.int64).min + 1
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(key)], names=[*names, "key"])

    return df.mapInArrow(run, schema)


def _cell() -> Column:
    """Cell 0 to WAYS of ``key`` between ``lo`` and ``hi``: rises with the key, tells lo from hi, cannot overflow."""
    half = F.shiftright("hi", 1) - F.shiftright("lo", 1)
    near = half < WAYS // 2
    return F.when(near, F.col("key") - F.when(near, F.col("lo")).otherwise(F.col("key"))).otherwise(F.expr(f"(shiftright(key, 1) - shiftright(lo, 1)) div (({WAYS} + shiftright(hi, 1) - shiftright(lo, 1)) div {WAYS})"))


def _cutoffs(rows: DataFrame, group: list[str], heavy: DataFrame | None) -> DataFrame:
    """(group, cut, ties): records with key > cut stay; of those equal to cut, the first ``ties`` by identifier.

    ``rows`` has (group, key, id, lo, hi, want) of groups of more than ``want`` rows, want >= 0, lo and hi the bounds
    of their keys. Kept true in every pass: ``above`` records lie above hi, at most ``want``; more than ``want`` lie
    at or above lo.
    """
    done: list[DataFrame] = []
    inside = rows.withColumn("above", F.lit(0).cast("long"))
    while True:
        cells = inside.groupBy(*group, _cell().alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("want").alias("want"), F.first("above").alias("above"))
        # At most WAYS + 1 rows a group: the cell that holds the first record beyond the cap, and what lies above it.
        upto = cells.withColumn("upto", F.col("above") + F.sum("n").over(Window.partitionBy(*group).orderBy(F.desc("cell"))))
        crossing = upto.where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("n") <= F.col("want")))
        state = checkpointed(crossing.select(*group, "lo", "hi", "want", (F.col("upto") - F.col("n")).alias("above")))
        met = F.col("want") == F.col("above")
        done.append(state.where("want = above OR lo = hi").select(*group, F.when(met, F.col("hi")).otherwise(F.col("lo")).alias("cut"), (F.col("want") - F.col("above")).alias("ties")))
        active = state.where("want > above AND lo < hi")
        if active.isEmpty():
            break
        inside = salted_join(rows.select(*group, "key", "id"), active, group, [F.col("id")], heavy=heavy).where(F.col("key").between(F.col("lo"), F.col("hi")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def with_share(rows: DataFrame, scope: list[str], share: float, cap: str = "cap") -> DataFrame:
    """``rows`` with the limit that each contributor may hold ``share`` of the records of its scope, rounded down.

    The records of a scope are counted before anything is dropped, as often as they are delivered.
    """
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    sizes = rows.groupBy(*scope).agg(F.floor(F.count(F.lit(1)) * F.lit(share) + F.lit(1e-9)).cast("long").alias(cap))
    return salted_join(rows.drop(cap), sizes, scope, [F.xxhash64(*[c for c in rows.columns if c != cap])])


def over_cap(rows: DataFrame, group: list[str], cap: str, ident: str, score: str) -> DataFrame:
    """(group, ident): the records that must go.

    ``cap`` is a column of ``rows``, equal for all rows of a group (of different values the smallest counts).
    """
    sound = " AND ".join(f"`{c}` IS NOT NULL" for c in [*group, cap, ident])
    clean = rows.where(sound).select(*group, F.col(ident).cast("long").alias("id"), F.col(cap).cast("long").alias("want"), F.col(score).cast("double").alias("score"))
    once = clean.groupBy(*group, "id").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"), F.min("want").alias("want"))
    base = checkpointed(ordered_key(once))
    heavy = held_heavy_keys(base, group, HOT_SHARE)
    sizes = base.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.min("want"), F.lit(0)).alias("want"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    crowded = checkpointed(salted_join(base.drop("want"), sizes.where("n > want").drop("n"), group, [F.col("id")], heavy=heavy))
    first = _cutoffs(crowded, group, heavy)
    cut = checkpointed(salted_join(crowded.drop("lo", "hi", "want"), first, group, [F.col("id")], heavy=heavy).where("key <= cut"))
    # Among ties the smallest identifiers stay, so the identifier bisection runs on their negatives.
    tied = cut.where("key = cut AND ties > 0")
    ids = tied.select(*group, (-F.col("id")).alias("key"), "id", "ties")
    bounds = ids.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("ties").alias("want"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    some = checkpointed(bounds.where("n > want").drop("n"))
    gone = cut.where("key < cut OR ties = 0").select(*group, "id")
    if not some.isEmpty():
        open_ = checkpointed(salted_join(ids.drop("ties"), some, group, [F.col("id")], heavy=heavy))
        second = _cutoffs(open_, group, heavy)
        # Identifiers are unique in a group: a single one at the cut either fits (ties = 1) or not.
        lost = salted_join(open_.drop("lo", "hi", "want"), second, group, [F.col("id")], heavy=heavy).where("key < cut OR (key = cut AND ties = 0)")
        gone = gone.unionByName(lost.select(*group, "id"))
    return gone.select(*group, F.col("id").alias(ident))
