"""Sessions with the settings that the operators are tuned for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to a Python worker, about.
BATCH_BYTES = 4_000_000


def session(app: str = "siftprint", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow batches bounded by bytes.

    conf: further settings, with ``__`` for dots in their names.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless it has a bound of its own.

    Rows alone don't bound them: 10,000 whole texts take tens of MB, several times over in the JVM
    (a buffer doubles as it grows) and again in the worker, for each core.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def info(spark: SparkSession) -> dict[str, str]:
    """Where and how a session runs."""
    sc = spark.sparkContext
    return {
        "spark": spark.version,
        "pyspark": pyspark.__version__,
        "master": sc.master,
        "application": sc.applicationId,
        "parallelism": str(sc.defaultParallelism),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "arrow_rows": spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"),
    }


def ship(spark: SparkSession) -> None:
    """Give the package's source to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_siftprint_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="siftprint-")) / "siftprint.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._siftprint_shipped = True
