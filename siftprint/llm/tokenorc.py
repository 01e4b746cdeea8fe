"""Token ids of documents in ORC files, and what is read back from them.

Rows are ranged by doc_id, the text's hash and the row's number over the files and ascend in
each file, so file and row order together are the order of doc_id, and rows that share a
doc_id or have none are dealt over many files too.  Ids are a list of integers, which ORC stores
in run-length encoding; stripes can be read by different tasks; row indexes and Bloom
filters on doc_id let a reader skip files, stripes and row groups.

Edge cases: null and empty texts have the end id alone; rows with one doc_id keep an
order that the files fix (column ``row``) and each has its own ids; null doc_ids come
first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, tokens

SCHEMA = "doc_id long, row long, ids array<int>"
OPTIONS = {"compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
#: Documents' text that is encoded at a time, in bytes.
ENCODE_BYTES = 4_000_000


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's text and write the files of folder ``out``."""
    path = path or tokens.word_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = tokens.word_encoder(path), 0
        for batch in batches:
            for b in shared.slices(batch, "text", ENCODE_BYTES):
                ids, texts = shared.columns(b, "doc_id", "text")
                flat, ends = enc.encode_array(texts)
                values = pa.array(np.insert(flat, ends, end_id).view("<i4"))
                places = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype("i4")
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(row, row + len(ends))), pa.ListArray.from_arrays(pa.array(places), values)], names=["doc_id", "row", "ids"])
                row += len(ends)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("nth", F.monotonically_increasing_id())
    ranged = docs.repartitionByRange("doc_id", F.xxhash64("text"), "nth").sortWithinPartitions("doc_id", F.xxhash64("text"), "nth")
    ranged.mapInArrow(run, SCHEMA).write.options(**OPTIONS).orc(out)


def read(spark: SparkSession, out: str, ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, row and ids; of given documents only, for which the files' metadata prune."""
    df = spark.read.schema(SCHEMA).orc(out)
    return df if ids is None else df.where(F.col("doc_id").isin(list(ids)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        file, doc, row, ids = shared.columns(b, "file", "doc_id", "row", "ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([file, doc, row, pa.array(np.diff(ends).astype("i8")), pa.array(crc, pa.int64())], names=["file", "doc_id", "row", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored row, from the files."""
    rows = read(spark, out).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "doc_id", "row", "ids")
    rows = shared.table(rows.mapInArrow(_digest, "file string, doc_id long, row long, n_tokens long, ids_crc32 long"), "orc-digest")
    # a row for each file: the window over all of them is bounded by the number of files
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # a task writes several files where the session bounds their rows
    order = [F.regexp_extract("file", p, 1).cast("long") for p in (r"part-(\d+)", r"-c(\d+)\.")]
    files = files.withColumn("before", F.sum("n").over(Window.orderBy(*order)) - F.col("n")).select("file", "before")
    inner = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inner", inner).join(files, "file").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def store_and_digest(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    out = shared.fresh_path(spark, "token-orc") + "/ids"
    write(docs, out, path, end_id)
    return digest(spark, out)
