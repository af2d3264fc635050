"""Sessions: UTC, adaptive execution, and the package shipped to executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "spark.abacora.shipped"


def build(app: str = "abacora", master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; master and sizes only where given, so that a cluster's own stay."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        b = b.config("spark.driver.memory", memory)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors' Python once a session."""
    if spark.conf.get(_SHIPPED, None) != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="abacora-"), "abacora_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
    return spark
