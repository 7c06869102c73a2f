"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, keys: list[str], *measures: Column) -> DataFrame:
    """Aggregates by ``keys`` that only ever shuffle one partial row per key and task.

    ``measures`` must be algebraic (count, sum, min, max, avg, variances ...): each task combines its rows in a
    bounded hash table, falls back to sorted runs on disk when that is full, and sends mergeable states only, so
    a key with a third of all rows reaches its final task as one state per map task. Set-valued and ordered
    aggregates have states that grow with the key and are refused. Null keys form one group of their own; an
    empty table gives no groups; repeated rows count as often as they occur.
    """
    growing = ("collect_", "array_agg", "listagg", "string_agg", "percentile(", "median", "mode(", "count(DISTINCT", "sum(DISTINCT")
    for m in measures:
        text = str(m)
        if any(g.lower() in text.lower() for g in growing):
            raise ValueError(f"not a constant-size partial state: {text}")
    return df.groupBy(*keys).agg(*measures)


def at_least_share(counts: DataFrame, n: str, per_mille: int, rows: DataFrame) -> DataFrame:
    """Rows of ``counts`` whose ``n`` is at least ``per_mille`` thousandths of the rows of ``rows``.

    Integer arithmetic, so a key exactly at the limit is in. The total is a scalar subquery that reads no column.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.where(F.col(n) * 1000 >= total.scalar() * F.lit(per_mille))
