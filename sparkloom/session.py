"""Session helpers: a tuned local session, and shipping this package to Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigurationError

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "sparkloom.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def _give_back() -> None:
    """Hand free memory back to the system: a worker lives on after its task, beside others."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of a batch on its way to a worker, where the session leaves Spark's own bound (64 MB) as it is: several batches are in memory at once, in both processes.
BATCH_BYTES = "8m"
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the workers, which give back what memory they no longer need.

    A session that has Spark's default for the bytes of an Arrow batch gets BATCH_BYTES.
    """
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_KEY, None) == _BATCH_DEFAULT:
        df.sparkSession.conf.set(_BATCH_KEY, BATCH_BYTES)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``; where none is set and all runs in one process (tests), a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/scratch/{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ConfigurationError("No shared folder is known", "Set spark.checkpoint.dir.")
    return tempfile.mkdtemp(prefix="sparkloom-scratch-")


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, name: str = "sparkloom", shared: str | None = None) -> SparkSession:
    """``shared``: a folder for checkpoints and indexes."""
    session = (
        SparkSession.builder.config(map={"spark.checkpoint.dir": shared} if shared else {}).master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
