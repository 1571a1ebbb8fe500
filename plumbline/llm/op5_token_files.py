"""Token-ID output: Parquet files of token lists in document order, with controlled encodings, row groups and pages.

write_tokens() deals the documents out by ranges of doc_id, encodes them where they land and lets Spark's Parquet
writer lay them down: dictionary indexes for the ids (a vocabulary fits one dictionary page), delta packing for the
sorted numbers, bounded row groups and small pages whose column indexes let a reader skip all pages but those of the
documents or columns it wants. Each file also says which part of the order it is, so that the start of a document is
its start within its part plus the lengths of the parts before it (one number for each part).

Cases: a null text is empty (only the end id); a null doc_id sorts first; repeated doc_ids keep one row for each, in
unspecified order among themselves; an empty table gives an empty file set; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import arrow_map, scratch_path, sliced, table

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 500
#: Documents that are encoded at once (their words are looked up once), within the bytes of an Arrow batch.
ENCODED_ROWS = 4096

_FILE = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Encode docs (doc_id, text) and write them to path in ascending doc_id order; returns path."""
    tokenizer = tokenizer or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc, part, at = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.uint32(end_id).tobytes()
        for batch in sliced(batches, ENCODED_ROWS):
            ids = [x + end for x in enc.encode_all(batch.column(1).to_pylist())]
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(lengths)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
            columns = [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(at + ends - lengths), pa.array(lengths), lists]
            at += int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writer = arrow_map(ordered, encode, _FILE).write
    for key, value in {
        "compression": "zstd",
        "parquet.writer.version": "v2",  # delta packing where there is no dictionary
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.dictionary.page.size": 4 << 20,
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; first and last bound doc_id and prune row groups and pages."""
    rows = spark.read.schema(_FILE).parquet(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # one row for each written part, so it is as small as the list of files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each row's ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in sliced(batches):
            lists = batch.column(3)
            flat, ends = np.asarray(lists.values, dtype="<u4"), np.asarray(lists.offsets)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(rows, crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"))
    return digest(read_tokens(spark, path))
