"""Session defaults for local runs; a cluster brings its own configuration."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Give the executors' Python workers this package; Spark hands the file out from the driver. Once for each application."""
    spark = spark or SparkSession.getActiveSession()
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        name = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(name)
        _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, only a local master gets one of its own; a cluster has to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df`, written as Parquet into the shared folder and read again: what follows has a short lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with UTC, adaptive execution and as many shuffle partitions as cores."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
