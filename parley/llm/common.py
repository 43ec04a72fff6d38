"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import share_code as share_package
from parley.session import shared_dir

#: At most this many text bytes are looked at together in a Python worker.
CHUNK_BYTES = 2 << 20


#: Bytes of a batch on its way to a Python worker, and of an allocation that goes back to the system when it is freed.
BATCH_BYTES, LARGE = 4 << 20, 1 << 18


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and keep them small.

    Batches are bounded by bytes, since texts differ much in length, and freed buffers go back to the system, as
    a worker lives on between tasks.
    """
    share_package(spark)
    env = spark.sparkContext.environment
    env |= {"MALLOC_MMAP_THRESHOLD_": str(LARGE), "MALLOC_TRIM_THRESHOLD_": str(LARGE), "ARROW_DEFAULT_MEMORY_POOL": "system"}
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: executors may be lost after that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() made and nothing needs any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The size of the folders that df's files are in, an upper bound of what is read; without files, no bound."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folders = [jvm.org.apache.hadoop.fs.Path(x) for x in {os.path.dirname(f) for f in df.inputFiles()}]
    return sum(f.getFileSystem(conf).getContentSummary(f).getLength() for f in folders) if folders else 1 << 62


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def byte_rows(column: pa.Array) -> list[bytes | None]:
    """A string column as Python bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that the text of a slice has at most limit bytes (or is a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
