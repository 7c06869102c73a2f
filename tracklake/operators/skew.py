"""Joins and pair expansion that keep working when one key holds a third of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy when it holds at least this share of the rows, so at most 1 / HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 0.001
SALTS = 64
#: Ids that one list of a pair expansion may span.
SPAN = 1024
#: Bytes of queries that one task holds, and rows of the other side that one group holds.
BLOCK_BYTES, PART_ROWS = 64_000_000, 200_000


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """Keys holding at least ``share`` of the rows of ``df``: at most ``1 / share`` rows, whatever the data.

    Map-side combining leaves one partial row per key and task before the shuffle; the total is summed from the
    counts, so ``df`` is read once. Null keys never join, so they are not counted as keys.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("n"))
    known = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return counts.where(known & (F.col("__n") >= F.greatest(total.scalar() * F.lit(share), F.lit(2)))).drop("__n")


def held_heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame | None:
    """``heavy_keys``, worked out now and held by the driver (at most 1 / share rows); None where there are none."""
    found = heavy_keys(df, keys, share)
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[Column], how: str = "inner", salts: int = SALTS, heavy: DataFrame | None | str = "find") -> DataFrame:
    """``left`` joined to ``right`` on ``keys`` where ``left`` may be skewed and ``right`` has few rows per key.

    Rows of a heavy key of ``left`` are spread over ``salts`` tasks by the hash of ``spread``; the matching
    rows of ``right`` are repeated that often. The broadcast holds heavy keys only (see ``heavy_keys``); they are
    found at once, unless given, and without any the join is a plain one.
    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing.
    """
    heavy = held_heavy_keys(left, keys) if isinstance(heavy, str) else heavy
    if heavy is None:
        return left.join(right, keys, how)
    heavy = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))
    salted = left.join(heavy, keys, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("__heavy")
    copies = right.join(heavy, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__heavy")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def expand_pairs(members: DataFrame, links: DataFrame, group: list[str], label: str, ident: str) -> DataFrame:
    """Pairs (``group``, id_a, id_b) with id_a < id_b of members whose labels are linked.

    ``members`` has (group, label, ident), ``links`` has (group, label_a, label_b), each linked pair of labels
    once; a label linked with itself pairs its own members. Members travel as lists of at most SPAN ids, so a
    label with a third of all rows is many short lists and no task or row ever holds it whole.
    """
    lists = members.groupBy(*group, label, F.floor(F.col(ident) / SPAN).alias("__span")).agg(F.collect_set(ident).alias("__ids"))
    a = lists.select(*group, F.col(label).alias("label_a"), F.col("__span").alias("__sa"), F.col("__ids").alias("__a"))
    b = lists.select(*group, F.col(label).alias("label_b"), F.col("__span").alias("__sb"), F.col("__ids").alias("__b"))
    both = links.join(a, [*group, "label_a"]).join(b, [*group, "label_b"]).where((F.col("label_a") != F.col("label_b")) | (F.col("__sa") <= F.col("__sb")))
    one = both.select(*group, F.explode("__a").alias("__x"), "__b", (F.col("label_a") == F.col("label_b")).alias("__own"))
    two = one.select(*group, "__x", F.explode("__b").alias("__y"), "__own")
    # Within one label a pair of spans comes once, in one order only; equal ids never pair.
    return two.where((F.col("__x") < F.col("__y")) | (~F.col("__own") & (F.col("__x") > F.col("__y")))).select(*group, F.least("__x", "__y").alias("id_a"), F.greatest("__x", "__y").alias("id_b"))


def against_all(queries: DataFrame, rows: DataFrame, run: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, n_bytes: Column) -> DataFrame:
    """``run(block of queries, batches of rows)`` of every query against every row, for a stated set of queries.

    ``n_bytes`` is the size of a query. Queries of at most BLOCK_BYTES in all, by measure, are sent to every task.
    More are cut into blocks and the rows into parts by hash; each block meets each part in a group of its own, so
    no task and no driver ever holds more than one block and one part. Both ways call ``run`` with whole queries.
    Both inputs are read more than once.
    """
    spark = rows.sparkSession
    size = queries.agg(F.sum(n_bytes).alias("s")).first().s or 0
    if size <= BLOCK_BYTES:
        sent = spark.sparkContext.broadcast(queries.toArrow())
        return rows.mapInArrow(lambda batches: run(sent.value, batches), schema)
    blocks = int(-(-size // BLOCK_BYTES))
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS)))
    cell = ["__block", "__part"]

    def placed(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        at = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(n)).cast("int")
        return df.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out.empty_table()
        found = list(run(left.drop_columns(cell), iter(right.drop_columns(cell).to_batches(max_chunksize=10_000))))
        return pa.Table.from_batches(found).cast(out) if found else out.empty_table()

    a, b = placed(queries, "__block", blocks, "__part", parts), placed(rows, "__part", parts, "__block", blocks)
    return a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(one, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of ``least`` rows or more but for the last; the rows of a group lie next to one another."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            t = pa.Table.from_batches(held)
            same = pc.equal(t[key], t[key][-1]).combine_chunks().to_numpy(zero_copy_only=False)
            end = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
            if end:
                yield t.slice(0, end)
                held, size = t.slice(end).to_batches(), len(t) - end
    if size:
        yield pa.Table.from_batches(held)
