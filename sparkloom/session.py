"""Session settings shared by the command line, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]


def build_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC and adaptive execution.

    Nothing here sizes a cluster: partitions and memory come from the deployment.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 1_000) -> None:
    """Whole texts reach Python workers in small batches: lowers the session's limit to ``most`` rows, if it is higher."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, unless their path has it already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_sparkloom_sent", False):
        return
    path = Path(tempfile.mkdtemp()) / "sparkloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((ROOT / "sparkloom").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    context.addPyFile(str(path))
    context._sparkloom_sent = True
