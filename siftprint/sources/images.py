"""Image files as image batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels

#: Endings of image files, in any case.
ENDINGS = ("jpg", "jpeg", "png", "bmp")
_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in ENDINGS) + "}"
GRAY = "path string, width int, height int, pixels binary"


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """All image files below a folder, decoded: path, width, height, n_channels, data (blue, green, red).

    Files that can't be decoded are left out.
    """
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(folder)
    i = F.col("image")
    return df.select(i["origin"].alias("path"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("n_channels"), i["data"].alias("data"))


def _convert(lanczos: tuple[int, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {"path": [], "width": [], "height": [], "pixels": []}
            for r in b.to_pylist():
                image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
                if lanczos:
                    image = pixels.resize_lanczos(image, *lanczos)
                gray = pixels.to_gray(image)
                for k, v in zip(rows, (r["path"], gray.shape[1], gray.shape[0], gray.tobytes()), strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    return run


def to_gray(images: DataFrame, lanczos: tuple[int, int] | None = None) -> DataFrame:
    """Gray images (path, width, height, pixels); resampled to a size first, in colour, if one is given."""
    return images.mapInArrow(_convert(lanczos), GRAY)
