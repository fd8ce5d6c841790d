"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from functools import cache

from pyspark.sql import SparkSession

# Settings that suit file-shaped data: AQE for runtime partition counts and
# skewed joins, UTC so epoch arithmetic is unambiguous, Arrow for Python tasks.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "codeshoal") -> SparkSession:
    """A session for one machine (tests and the benchmark)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers import the package by name; a worker on another machine,
    or one started elsewhere, has it only if it is sent.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="codeshoal-"), "codeshoal.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names.  Only a local master may
    leave it unset; a temporary folder of this machine is taken then, once per session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_scratch()
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="codeshoal-")
