"""Mixing sources so that each contributes its target share of all tokens.

Every record gets a hash-random key from its id. Within a source the records are ordered by that key; ranges of
keys are the parts of the sort. Token sums by (source, range) are prefix-summed, records of a range are
prefix-summed within it, and the two add up to each record's place in its source. A source's budget
is its share of the tokens of all records: whole passes (epochs) over the source first, then the records whose
place lies within the rest. No record is used more often than the cap of its source; a source that cannot fill
its budget is used in full and reported as short.

A source with a third of all records is many ranges, each about ``RANGE_ROWS`` records; only sums by (source,
range) are ordered in one place.

Cases. A null or empty text has 0 tokens; such a record is used like any other once its place is reached. A null
source has no target, its tokens count in the total. A source without target is not used; a target without records is short.
Null shares count as 0, null or negative caps as 0. Repeated rows of an id count once; null ids are left out.
Of repeated target rows of a source the largest share and cap count. An empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.skew import salted_join
from tracklake.session import checkpointed

RANGE_ROWS = 50_000
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame, ident: str, source: str, tokens: str) -> DataFrame:
    """(id, source, n_tokens): one row per record."""
    rows = docs.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n_tokens"))
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: what it holds, its budget, whole epochs, the rest, and whether it is short."""
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()[0]
    goal = targets.where("source IS NOT NULL").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).cast("long").alias("max_repeats"))
    held = rows.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("n_available"), F.count(F.lit(1)).alias("n_records"))
    known = goal.join(held, "source", "left").fillna(0, ["n_available", "n_records"]).withColumn("budget", F.col("target_share") * F.lit(float(total)))
    short = F.col("n_available") * F.col("max_repeats") < F.col("budget")
    epochs = F.when(short | (F.col("n_available") == 0), F.col("max_repeats")).otherwise(F.floor(F.col("budget") / F.col("n_available"))).cast("long")
    return known.withColumns({"is_short": short, "epochs": F.when(F.col("budget") > 0, epochs).otherwise(F.lit(0).cast("long"))}).withColumn(
        "rest", F.when(F.col("is_short"), F.lit(0.0)).otherwise(F.col("budget") - F.col("epochs") * F.col("n_available"))
    )


def mixture(rows: DataFrame, planned: DataFrame, seed: int = 11) -> DataFrame:
    """(id, source, n_tokens, n_uses): the records used and how often.

    ``rows`` and ``planned`` are as returned by ``sized`` and ``plan``, materialised by the caller.
    """
    few = planned.count() <= BROADCAST_SOURCES
    wanted = planned.where("budget > 0").select("source", "epochs", "rest", "max_repeats")
    known = rows.where("source IS NOT NULL")
    joined = known.join(F.broadcast(wanted), "source") if few else salted_join(known, wanted, ["source"], [F.col("id")])
    bits = max(6, (max(1, rows.count()) // RANGE_ROWS).bit_length())
    # Signed keys are moved to an unsigned order before their leading bits name the range.
    keyed = joined.withColumn("key", F.xxhash64("id", F.lit(seed))).withColumn("range", F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63)).cast("long")), 64 - bits))
    by_range = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("n"))
    before = by_range.select("source", "range", (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("within", F.sum("n_tokens").over(inside)).join(before, ["source", "range"])
    fits = (F.col("rest") > 0) & (F.col("before") + F.col("within") <= F.col("rest"))
    uses = F.least(F.col("max_repeats"), F.col("epochs") + F.when(fits, 1).otherwise(0))
    return placed.select("id", "source", "n_tokens", uses.alias("n_uses")).where("n_uses > 0")


def shares(planned: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row per target source with what the mixture really took from it, and its share of the mixture.

    A source is short when the mixture used all it may, every record as often as allowed, and is still below the
    source's budget.
    """
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n_used"), F.sum("n_uses").alias("n_records_used"), F.max("n_uses").alias("most_uses"))
    whole = used.agg(F.sum("n_used").alias("t"))
    exhausted = (F.col("n_used") >= F.col("n_available") * F.col("max_repeats")) & (F.col("n_used") < F.col("budget"))
    return (
        planned.join(used, "source", "left")
        .fillna(0, ["n_used", "n_records_used", "most_uses"])
        .select("source", "target_share", "max_repeats", "n_available", F.round("budget", 3).alias("budget"), "n_used", "n_records_used", "most_uses", F.round(F.col("n_used") / whole.scalar(), 6).alias("share_reached"), exhausted.alias("is_short"))
    )


def mix(docs: DataFrame, targets: DataFrame, ident: str, source: str, tokens: str, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(plan, mixture) of ``docs`` with a token count column."""
    rows = checkpointed(sized(docs, ident, source, tokens))
    planned = checkpointed(plan(rows, targets))
    return planned, mixture(rows, planned, seed)
