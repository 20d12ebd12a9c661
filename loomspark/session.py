"""Session helpers: the package on the workers, and a session for tests and scripts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to all executors, once per application (the driver serves the archive)."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="loomspark-"), f"{top.name}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(top.rglob("*.py")):
                archive.write(file, file.relative_to(top.parent))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark


def local_session(cores: str = "8", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A single-machine session with the settings that the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
