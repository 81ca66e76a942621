"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the operators' word rule `[^\x20\x09-\x0D]+`.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_root: str | None = None
_cleanups: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may go without it (tests, local runs); a temporary folder is made there.
    """
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="foliomill-")
    return _own_root


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there goes when the driver ends."""
    path = f"{scratch_root(spark)}/foliomill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if path not in _cleanups:
        if not _cleanups:
            atexit.register(_remove_folders, spark)
        _cleanups.add(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _cleanups.discard(path)


def _remove_folders(spark: SparkSession) -> None:
    for path in list(_cleanups):
        try:
            remove_folder(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    The files survive lost executors, cut the lineage, and give later joins real sizes.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that no frame still to be used reads."""
    for frame in frames:
        remove_folder(frame.sparkSession, frame.scratch_path)


def free_name(df: DataFrame, stem: str) -> str:
    """`stem`, with more underscores if a column of `df` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str | Column = "text") -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit(""))


def id_crc32(column: str) -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def gapless_positions(df: DataFrame, key: str, order: list[str], out: str, chunk: str) -> DataFrame:
    """Number the rows of each key from 0 without a gap, however many rows a key has.

    `chunk` is a stored column that deals the rows into pieces of bounded size (such as the
    partition that wrote them).  Rows are numbered inside (key, chunk); a small table of
    counts then gives each piece its offset.  No task needs all the rows of one key.
    """
    counts = df.groupBy(key, chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(key).alias("_key"), F.col(chunk).alias("_chunk"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start"),
    )
    inner = Window.partitionBy(key, chunk).orderBy(*order)
    numbered = df.withColumn("_at", F.row_number().over(inner).cast("long") - F.lit(1))
    joined = numbered.join(starts, (F.col(key) == F.col("_key")) & (F.col(chunk) == F.col("_chunk")))
    return joined.withColumn(out, F.col("_start") + F.col("_at")).drop("_at", "_key", "_chunk", "_start")


def ragged_take(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs values[offsets[i]:offsets[i+1]] for i in index; also their new offsets."""
    taken = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values)).take(pa.array(index))
    new = taken.offsets.to_numpy()
    return taken.flatten().to_numpy(), new - new[0]


def sub_batches(batch: pa.RecordBatch, text_index: int, target_bytes: int = 4 << 20):
    """Cut a batch into slices of about target_bytes of text, so that buffers stay small."""
    if batch.num_rows == 0:
        return
    lengths = pc.binary_length(batch.column(text_index)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(lengths) // target_bytes
    edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]])
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))
    give_back()


def give_back() -> None:
    """Return what a reused worker has freed to the system; its peak would stay otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with more fields, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
