"""What the corpus operators share: table access, shared tables and batch slicing."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a numpy kernel works on at once; longer texts make a slice of their own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java_dir.get() if java_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'touchline-checkpoints')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def stored(df: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them from there.

    A lost executor then costs a re-read and never a recomputation. ``kept`` gets the path,
    for a caller that removes the table with ``forget`` when a later one replaces it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with row_id: the key itself where it is a whole number and names each row, else a stored row number in its order, null last."""
    whole = dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint")
    if whole and df.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or `{key}` is null").isEmpty():
        return df.withColumn("row_id", F.col(key).cast("long"))
    return stored(df.orderBy(F.col(key).asc_nulls_last()).withColumn("row_id", F.monotonically_increasing_id()))


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that no name of theirs can clash with one of an operator."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files of plans that are finished and no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast where a count shows at most ``rows`` rows, else left to a shuffle join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows; it reads no more than that plus one."""
    return df.limit(limit + 1).count() <= limit


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sliced(
    fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], column: str = "text", limit: int = SLICE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that hands ``fn`` slices of about ``limit`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ends = offsets_of(batch.column(column))
            begin = 0
            while begin < n:
                end = begin + 1
                while end < n and ends[end + 1] - ends[begin] <= limit and end - begin < 8192:
                    end += 1
                yield from fn(batch.slice(begin, end - begin))
                begin = end

    return run


def offsets_of(array: pa.Array):
    """The n + 1 byte offsets of a string or binary array, as int64."""
    import numpy as np

    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def bytes_of(array: pa.Array):
    """(bytes, offsets) of a string array as numpy: the offsets start at 0; a null is empty."""
    import numpy as np

    if array.null_count:
        empty = b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else ""
        array = array.fill_null(empty)
    offsets = offsets_of(array)
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
