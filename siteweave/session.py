"""A Spark session with the settings that the engine's plans count on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, wherever the session was started."""
    here = Path(__file__).resolve().parent
    own = Path(tempfile.mkdtemp(prefix="siteweave-code-")) / "siteweave.zip"
    with zipfile.ZipFile(own, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(own))  # Spark copies the driver's file to each worker


def session(app: str = "siteweave", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC; partitions are left to the cluster unless given in conf (dots as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = builder.config(map=own | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
    ship(spark)
    return spark
