"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space between words: space and the controls 9 to 13.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of the Arrow batches that go to Python tasks, where the session says nothing else.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_plumbline_scratch", None)
        if root is None:
            root = spark.sparkContext._plumbline_scratch = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    return f"{root.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that materialize() wrote in this application; call it once their results are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most so many rows, which bounds the memory that a task needs beside its input."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


Batches = Iterator[pa.RecordBatch]


def arrow_map(df: DataFrame, function: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes; a task gives its free memory back when it ends, as workers are used again."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo a number; null keys count as 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0))


_kept: dict[str, Callable[[], object]] = {}


def claim(owner: str, forget: Callable[[], object] | None = None) -> None:
    """Say that an operator's tasks use this Python worker now: what other operators keep between tasks is dropped.

    Spark uses its Python workers again, so that caches of one operator would stay beside the next one's.
    """
    for other, drop in list(_kept.items()):
        if other != owner:
            drop()
            del _kept[other]
            release()
    if forget is not None:
        _kept[owner] = forget


Query = Callable[[SparkSession, str], DataFrame]
