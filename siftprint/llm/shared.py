"""The folder that driver and executors share, and small helpers on top of it.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
again, so that a lost executor costs its running tasks only.  The setting is read
from the session; where it is unset (a single machine, tests) a temporary folder
is set up once for the session.
"""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, bound_batches  # noqa: F401  the pipeline's

_count = itertools.count()
#: Rows of one key that may meet in a task of a join.
KEY_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; see the module's docstring."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftprint-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") if ":" in base.split("/")[0] else "file://" + os.path.abspath(base)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/siftprint/{what}-{next(_count)}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def make_dirs(spark: SparkSession, *uris: str) -> None:
    for uri in uris:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def table(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends here."""
    path = fresh_path(df.sparkSession, what) + "/table"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove the files of a ``table`` that nothing reads any more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``, a written table with one row a key and ``c``, its number of rows.

    A key with more than a thousandth of all rows (and more than ``KEY_ROWS``, which no task minds)
    is dealt over tasks by the hash of columns ``by``; there are a thousand such keys at most, so
    they go to every task.  ``c`` is dropped.
    """
    total, most = keys.agg(F.sum("c"), F.max("c")).first()
    share = max(KEY_ROWS, (total or 0) // 1000 + 1)
    if (most or 0) <= share:
        return rows.join(keys.drop("c"), on, how)
    hot = F.broadcast(keys.where(F.col("c") > share).select(*on, F.expr(f"CAST(c div {share} + 1 AS INT)").alias("salts_")))
    a = rows.join(hot, on, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts_")), F.lit(0)).cast("int")).drop("salts_")
    b = keys.drop("c").join(hot, on, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts_") - 1, F.lit(0))))).drop("salts_")
    return a.join(b, [*on, "salt_"], how).drop("salt_")


def file_system(uri: str):
    """pyarrow's file system and inner path for a URI; works in any process."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def if_there(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """A table of a folder; None where the folder doesn't have it."""
    try:
        return documents(spark, sf_dir, name) if sf_dir else None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts take about ``most`` bytes; one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
