"""Image batches that can be built alike in Spark and in SQL from the test tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_images(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each text's whole UTF-8 bytes as an image, about square, with black behind the end."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    d = df.select(F.col(id_col).cast("long").alias("id"), data.alias("data")).withColumn("n", F.octet_length("data"))
    d = d.withColumn("width", F.greatest(F.lit(1), F.ceil(F.sqrt("n"))).cast("int"))
    d = d.withColumn("height", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("width"))).cast("int"))
    return d.select("id", "width", "height", F.expr("rpad(data, width * height, X'00')").alias("pixels"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_images(table(spark, sf_dir, "documents"), "doc_id", "text")


def embedding_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's 64 numbers as a grid of 8 by 8: id, p."""
    grey = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", grey).alias("p"))


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a single machine one of its own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftprint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
