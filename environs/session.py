"""Sessions: settings for one machine, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("environs")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # rows are narrow and the work is in them: small partitions are not merged until they are tiny
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch() -> str:
    """A folder for files that the driver sends to executors; it goes when the driver ends."""
    path = tempfile.mkdtemp(prefix="environs-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: Python functions there can then import it."""
    sc = spark.sparkContext
    if getattr(sc, "_environs_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # it runs from an archive that was sent already
        return
    path = os.path.join(scratch(), "environs.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._environs_shipped = True
