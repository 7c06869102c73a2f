"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the local bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracklake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TRACKLAKE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut through the folder in ``spark.checkpoint.dir``.

    The folder the cluster names is used as it is; only where none is set and the master is local (tests, local
    runs) is a temporary one made. Checkpoint files live in shared storage, so losing an executor
    loses nothing; on a cluster without such a folder this is refused.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracklake-ckpt-"))
    return df.checkpoint(eager=eager)


def released(spark: SparkSession) -> None:
    """Lets shuffle, broadcast and checkpoint files that nothing refers to any more be deleted now.

    Spark deletes them when the driver collects its garbage, which may be after a long job has filled the disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it.

    The archive is made where the driver runs and is served by Spark itself; a cluster that already has the
    package on its path loses nothing by it.
    """
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_tracklake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tracklake-code-")) / "tracklake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._tracklake_shipped = True
