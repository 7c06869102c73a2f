"""Long Parquet tables of a built catalog, written and read by name."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ("tracks", "playlists", "entries", "track_tags", "vocabulary", "vectors", "challenges")


def write(tables: dict[str, DataFrame], folder: str, partition: dict[str, list[str]] | None = None, bucket_rows: dict[str, int] | None = None) -> None:
    """Writes each table as Parquet; ``partition`` names partition columns, ``bucket_rows`` a bound of rows a file."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if bucket_rows and name in bucket_rows:
            w = w.option("maxRecordsPerFile", bucket_rows[name])
        if partition and name in partition:
            w = w.partitionBy(*partition[name])
        w.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def write_meta(one_row: DataFrame, path: str) -> None:
    """A one-row table as a JSON file on the driver (build provenance)."""
    Path(path).write_text(json.dumps(one_row.first().asDict(), indent=2, default=str))


def write_model(beta, folder: str, spark: SparkSession) -> None:
    """Model coefficients as a table (row, values); no pickles."""
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(beta)]
    spark.createDataFrame(rows, "row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(folder)


def read_model(spark: SparkSession, folder: str):
    import numpy as np

    return np.array([r["values"] for r in sorted(spark.read.parquet(folder).collect(), key=lambda r: r["row"])])
