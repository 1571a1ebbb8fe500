"""Vector code compression: each vector becomes one byte for each of its parts, the number of the nearest codebook entry.

1. Components become integers, floor(256 * x); a vector is cut into PARTS consecutive parts of equal width.
2. Arrow batches become columnar part blocks: one matrix of components by vectors for each length of vectors.
3. An RDD treeAggregate over the blocks finds the codebooks' first entries (the vectors with the ENTRIES smallest ids)
   and the size of the numbers. In each of ROUNDS rounds another one assigns the parts (distances accumulate dimension
   by dimension, over all vectors and entries of a block) and adds them with np.add.at to int64 tensors of sums and
   counts, which merge through a tree: what reaches the driver are single tensors of the codebooks' size.
4. A last pass assigns again and writes the codes. Errors are summed by label in the JVM.

Only codebooks (PARTS x ENTRIES vectors of one part) are sent to tasks. Each pass reads its input anew, without a
shuffle of vectors and without anything kept on executors: a lost one costs its tasks. Whoever has an expensive input
writes it to a table first.

Cases: rows whose vector is null or holds a null, NaN or infinite component (or one whose multiple by 256 is no finite
double) are dropped. Shorter vectors, and lengths that PARTS does not divide, count as if zeros followed up to the next
multiple of PARTS of the longest length. Rows that share an id, and equal vectors, are all encoded; the first entries
are taken in the order of id (nulls last), then vector. With fewer vectors than ENTRIES the codebooks are that much smaller; an empty table gives no rows. Numbers too
large for 64 bits are computed with Python's integers; an error, or a label's sum, that a long cannot hold is null.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_map, claim, materialize, sliced, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block: bounds the memory of a task (a table of distances has so many rows and ENTRIES columns).
BLOCK_ROWS = 4096
#: Labels that are sent to every task; beyond it rows are joined by a shuffle.
BROADCAST_LABELS = 500_000
#: Levels of the reduction tree.
DEPTH = 3

_LONG = 1 << 63


def _kept(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, components by vectors) of the usable vectors of a batch, for each length; components are whole numbers as doubles."""
    starts = vectors.offsets.to_numpy()
    lengths = np.diff(starts)
    with np.errstate(over="ignore"):
        values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[starts[1:]] == bad[starts[:-1]])
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        yield rows, np.floor(values[starts[rows][:, None] + np.arange(length)].T)


def _blocks(rows: DataFrame) -> RDD:
    """The part blocks of rows (id, vector): (ids as bytes, which are null, width, components by vectors as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vectors")
        for batch in sliced(batches, BLOCK_ROWS):
            ids = batch.column(0)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            found = [(ids[own].tobytes(), null[own].tobytes(), len(values), np.ascontiguousarray(values).tobytes()) for own, values in _kept(batch.column(1))]
            if found:
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["ids", "missing", "width", "parts"])

    return arrow_map(rows, run, "ids binary, missing binary, width int, parts binary").rdd.map(lambda r: (np.frombuffer(r[0], np.int64), np.frombuffer(r[1], bool), np.frombuffer(r[3]).reshape(r[2], len(r[1]))))


@dataclass
class Shape:
    """What one pass tells of all usable vectors."""

    count: int = 0
    width: int = 0
    size: float = 0.0  # of the largest number
    first: tuple = ()  # of the vectors with the smallest ids: (id is null, id, components)

    def seen(self, block: tuple[np.ndarray, np.ndarray, np.ndarray], entries: int) -> Shape:
        ids, missing, values = block
        order = np.lexsort((ids, missing))
        if len(order) > entries:  # and all that tie with the last of them
            last = order[entries - 1]
            order = np.flatnonzero((missing < missing[last]) | ((missing == missing[last]) & (ids <= ids[last])))
        own = [(bool(missing[i]), int(ids[i]), tuple(values[:, i].tolist())) for i in order]
        return self.merged(Shape(len(ids), len(values), float(np.abs(values).max(initial=0.0)), tuple(heapq.nsmallest(entries, own))), entries)

    def merged(self, other: Shape, entries: int) -> Shape:
        first = tuple(heapq.nsmallest(entries, self.first + other.first))
        return Shape(self.count + other.count, max(self.width, other.width), max(self.size, other.size), first)

    @property
    def part(self) -> int:
        """The width of a part."""
        return -(-self.width // PARTS)

    @property
    def fits(self) -> bool:
        """Whether sums and squared distances fit into 64 bits."""
        size = int(self.size) + 1
        return 4 * size * size * max(1, self.width) < _LONG and size * max(1, self.count) < _LONG


def _whole(values: np.ndarray, fits: bool) -> np.ndarray:
    return values.astype(np.int64) if fits else np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def padded(values: np.ndarray, part: int, fits: bool) -> np.ndarray:
    """Components by vectors as whole numbers, (PARTS, part, vectors)."""
    out = np.zeros((PARTS * part, values.shape[1]), np.int64 if fits else object)
    out[: len(values)] = _whole(values, fits)
    return out.reshape(PARTS, part, values.shape[1])


def nearest(block: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one part, (part, vectors) against (entries, part): the nearest entry of each vector, the lowest of equals, and its distance."""
    distance = np.zeros((block.shape[1], len(codebook)), codebook.dtype)
    for values, entries in zip(block, codebook.T, strict=True):
        apart = values[:, None] - entries
        distance += apart * apart
    code = distance.argmin(axis=1) if len(distance) else np.zeros(0, np.int64)
    return code, distance[np.arange(len(code)), code]


def _assigned(codebooks: np.ndarray, fits: bool) -> Callable:
    """The step of a round's aggregate: adds a block's parts to the sums and counts of their nearest entries."""

    def step(total: tuple[np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total
        for p, own in enumerate(padded(block[2], codebooks.shape[2], fits)):
            code, _ = nearest(own, codebooks[p])
            np.add.at(sums[p], code, own.T)
            np.add.at(counts[p], code, 1)
        return total

    return step


def _merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return one[0] + two[0], one[1] + two[1]


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, bool] | None:
    """The codebooks (PARTS, entries, part) of rows (id, vector), and whether 64 bits suffice; None where no vector is usable."""
    blocks = _blocks(rows)
    shape = blocks.treeAggregate(Shape(), lambda s, b: s.seen(b, entries), lambda s, t: s.merged(t, entries), DEPTH)
    if not shape.count:
        return None
    fits = shape.fits
    first = np.zeros((shape.part * PARTS, len(shape.first)))
    for at, (_, _, values) in enumerate(shape.first):
        first[: len(values), at] = values
    codebooks = padded(first, shape.part, fits).transpose(0, 2, 1)
    for _ in range(rounds):
        zero = (np.zeros(codebooks.shape, codebooks.dtype), np.zeros(codebooks.shape[:2], np.int64))
        sums, counts = blocks.treeAggregate(zero, _assigned(codebooks, fits), _merged, DEPTH)
        used = counts > 0
        codebooks = codebooks.copy()
        codebooks[used] = sums[used] // (counts[used].astype(codebooks.dtype)[:, None])
    return codebooks, fits


def encode(rows: DataFrame, codebooks: np.ndarray, fits: bool) -> DataFrame:
    """id, code, error and the label of rows (id, vector, label), for each usable vector."""
    schema = StructType([StructField("vec_id", LongType()), StructField("code", StringType()), StructField("error", LongType()), StructField("label", rows.schema[2].dataType)])
    part = codebooks.shape[2]
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vectors")
        for batch in sliced(batches, BLOCK_ROWS):
            for own, values in _kept(batch.column(1)):
                codes, error = [], 0
                for p, block in enumerate(padded(values, part, fits)):
                    code, apart = nearest(block, codebooks[p])
                    codes.append(digits[code])
                    error = error + apart
                text = pa.array(map("".join, zip(*codes, strict=True)), pa.string())
                known = pa.array([int(x) if x < _LONG else None for x in error] if not fits else error, pa.int64())
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), text, known, batch.column(2).take(at)], schema.names)

    return arrow_map(rows, run, schema)


def digest(codebooks: np.ndarray) -> str:
    """sha256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in codebooks.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label, label_error and codebooks_sha256 of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label"))
    trained = train(rows.select("vec_id", "embedding"))
    if trained is None:
        own = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label").filter(F.lit(False))
        return own.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    coded = materialize(encode(rows, *trained), "codes")
    # a sum for each label; the rows of a frequent label are not brought together
    whole = F.when(F.count("*") == F.count("error"), F.try_sum("error"))
    sums = coded.groupBy(F.col("label").alias("own_label")).agg(whole.alias("label_error"))
    if rows.select("label").distinct().limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("own_label")), "left").drop("own_label")
    return met.withColumn("codebooks_sha256", F.lit(digest(trained[0])))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_ROUND = """
near{r} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM cells c JOIN book{r} b ON b.part = c.part AND b.pos = c.pos GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_NEXT = """
book{n} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT c.part, n.best.entry AS entry, c.pos, floor(sum(c.v)::DECIMAL(30, 0) / count(*))::BIGINT AS v
    FROM cells c JOIN near{r} n ON n.vec_id = c.vec_id AND n.part = c.part GROUP BY 1, 2, 3) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""

ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT vec_id, (i // (n // {PARTS}))::INT AS part, (i % (n // {PARTS}))::INT AS pos, v FROM (
    SELECT vec_id, len(v) AS n, unnest(range(len(v))) AS i, unnest(v) AS v FROM kept)),
book0 AS MATERIALIZED (
  SELECT part, entry, pos, v FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}) USING (vec_id)),
{_ROUND.format(r=0)}, {_NEXT.format(r=0, n=1)}, {_ROUND.format(r=1)}, {_NEXT.format(r=1, n=2)}, {_ROUND.format(r=2)},
coded AS MATERIALIZED (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY vec_id),
errors AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN coded USING (vec_id) GROUP BY label)
SELECT c.vec_id, c.code, c.error, e.label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM coded c JOIN kept k USING (vec_id) JOIN errors e ON e.label IS NOT DISTINCT FROM k.label
"""
