"""How often every distinct value or term occurs, and in how many records.

Heavy-light aggregation. Terms that a bounded sample shows to be heavy are broadcast; every task counts them
exactly in local arrays, one slot a term. All other terms are combined a batch at a time and shuffled. The two
count tables are then united. Which terms are taken as heavy decides the speed, never the counts.

Cases. A record is a distinct non-null key with a non-null value; repeated rows of a key count once (of
different values of one key the smallest counts). A term is a non-empty piece between separators; a record
whose value is empty or blank counts as a record without terms. No separator: the value is one term, also
when empty. Very long values are split column-wise. An empty table gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.session import checkpointed

SAMPLE_RECORDS, MAX_HEAVY, HEAVY_SHARE = 50_000, 1024, 0.002


def records(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): one row per record."""
    return df.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value")).where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.min("value").alias("value"))


def _terms(values: pa.Array, separator: str | None) -> tuple[pa.Array, np.ndarray]:
    """Terms of a batch and the row each comes from."""
    if separator is None:
        return values, np.arange(len(values))
    split = pc.split_pattern(values, separator)
    row = pc.list_parent_indices(split).to_numpy()
    term = pc.list_flatten(split)
    some = pc.not_equal(term, "")
    return term.filter(some), row[some.to_numpy(zero_copy_only=False)]


def heavy_terms(recs: DataFrame, separator: str | None, n_records: int) -> list[str]:
    """At most MAX_HEAVY terms that hold at least HEAVY_SHARE of a hash-chosen sample of about SAMPLE_RECORDS records."""
    keep = int(min(1.0, SAMPLE_RECORDS / max(1, n_records)) * 1_000_000)
    sample = recs.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < keep)
    term = F.explode(F.split("value", separator, -1)) if separator else F.col("value")
    sampled = sample.select(term.alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    least = HEAVY_SHARE * min(SAMPLE_RECORDS, n_records)
    return [r.term for r in sampled.where(F.col("n") >= max(2.0, least)).orderBy(F.desc("n"), "term").limit(MAX_HEAVY).collect()]


def partial_counts(recs: DataFrame, separator: str | None, heavy: list[str]) -> DataFrame:
    """(term, n_occurrences, n_records, heavy): exact counts of one task for heavy terms, of one batch for light ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(heavy, pa.string())
        occurrences, holders = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)

        def out(term: pa.Array, n: np.ndarray, r: np.ndarray, flag: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(np.full(len(term), flag))], names=["term", "n_occurrences", "n_records", "heavy"])

        for batch in batches:
            term, row = _terms(batch.column(0), separator)
            slot = pc.fill_null(pc.index_in(term, known), -1).to_numpy(zero_copy_only=False)
            at = slot >= 0
            occurrences += np.bincount(slot[at], minlength=len(heavy)).astype(np.int64)
            seen = np.unique(row[at].astype(np.int64) * max(1, len(heavy)) + slot[at])
            holders += np.bincount(seen % max(1, len(heavy)), minlength=len(heavy)).astype(np.int64)[: len(heavy)]
            rest = term.filter(pa.array(~at))
            if len(rest):
                coded = rest.dictionary_encode()
                code, words = coded.indices.to_numpy(), coded.dictionary
                n = np.bincount(code, minlength=len(words))
                pairs = np.unique(row[~at].astype(np.int64) * len(words) + code)
                yield out(words, n, np.bincount(pairs % len(words), minlength=len(words)), False)
        if len(heavy):
            yield out(known, occurrences, holders, True)

    return recs.select("value").mapInArrow(run, "term string, n_occurrences long, n_records long, heavy boolean")


def frequencies(df: DataFrame, key: str, value: str, separator: str | None = None, rare_below: int = 3, common_per_cent: int = 7) -> DataFrame:
    """(value, n_occurrences, n_records, is_rare, is_common) of every distinct term.

    ``is_rare``: in fewer than ``rare_below`` records. ``is_common``: in more than ``common_per_cent`` per cent of
    the records, by integer arithmetic. Both can hold when there are few records.
    """
    recs = checkpointed(records(df, key, value))
    n_records = recs.count()
    heavy = heavy_terms(recs, separator, n_records)
    partial = checkpointed(partial_counts(recs, separator, heavy))
    sums = [F.sum(c).alias(c) for c in ("n_occurrences", "n_records")]
    # Heavy terms: one row a task and term. Light terms: only these meet in a real shuffle.
    counted = partial.where("heavy").groupBy("term").agg(*sums).where("n_occurrences > 0").unionByName(partial.where("NOT heavy").groupBy("term").agg(*sums))
    return counted.select(
        F.col("term").alias("value"),
        "n_occurrences",
        "n_records",
        (F.col("n_records") < rare_below).alias("is_rare"),
        (F.col("n_records") * 100 > F.lit(n_records) * common_per_cent).alias("is_common"),
    )


def marks(freq: DataFrame, *keep: str) -> DataFrame:
    """(value, mark) and the columns in ``keep``: one row for each mark that a value bears."""
    return freq.select(*keep, "value", F.explode(F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))).alias("mark"))
