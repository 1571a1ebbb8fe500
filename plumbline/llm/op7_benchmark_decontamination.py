"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by the size of their shingle set (a factor of two each). For a partition whose largest items
have u shingles, documents are cut into windows of 2u shingles that start every u, so an item that stands in a
document fills a known share of one window whatever the document's length, and the Jaccard similarity of item and
window stays high. Windows and items get HASHES minima; one equal minimum makes a candidate. Candidates are verified
with the exact share of the item's shingles that occur anywhere in the whole document. An item of which THRESHOLD is
contained in one place is missed with a probability of at most (1 - THRESHOLD / 5) ** HASHES, under 0.00003.

Items are the stated query set: they are held in blocks of bounded size, each block against all documents. A task holds
one block's index at a time; with several blocks it takes documents in groups of GROUP_BYTES through one after the other.

Cases: null or blank texts contain nothing and are contained nowhere; items under five words are one shingle and are
found in documents that consist of just these words; repeated items count once for each item_id; a null item_id is
ignored; an empty benchmark leaves all documents clean; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, Batches, arrow_map, claim, crc_mod, sliced, table
from .op8_ngram_jaccard_join import WORDS, mixed, shingles

#: The least share of an item's shingles, as a fraction of 100.
THRESHOLD = 75
HASHES = 64
#: Bound of the items held at once, in words of their texts.
BLOCK_WORDS = 1_000_000
#: Shingles of documents that are searched together.
BATCH_SHINGLES = 1 << 17
#: With several blocks: bytes of texts that go through one block before the next one's index is made.
GROUP_BYTES = 32 << 20

_BITS = 22
_SCRAMBLE = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


@dataclass
class _Partition:
    span: int  # the size of its largest items
    minima: list[np.ndarray]  # for each hash function the sorted minima
    items: list[np.ndarray]  # and the items that they belong to
    bitmap: np.ndarray


class Index:
    """MinHash signatures of a block of items, by size."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.sets = [shingles(t) for t in texts]
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                groups.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        self.partitions = []
        for span, own in sorted(groups.items()):
            bitmap = np.zeros(1 << _BITS, bool)
            minima, items = [], []
            for factor in _FACTORS:
                least = np.array([(self.sets[i] * factor).min() for i in own], np.uint64)
                order = np.argsort(least, kind="stable")
                minima.append(least[order])
                items.append(np.array(own)[order])
                bitmap[self._slot(least)] = True
            self.partitions.append(_Partition(span, minima, items, bitmap))

    @staticmethod
    def _slot(least: np.ndarray) -> np.ndarray:
        return (least * _SCRAMBLE) >> np.uint64(64 - _BITS)

    def candidates(self, sequences: list[np.ndarray]) -> set[tuple[int, int]]:
        """Pairs (place in sequences, item) with an equal minimum."""
        found: set[tuple[int, int]] = set()
        lengths = np.array([len(s) for s in sequences], np.int64)
        if not lengths.sum():
            return found
        flat, begins = np.concatenate(sequences), np.cumsum(lengths) - lengths
        for part in self.partitions:
            blocks = -(-lengths // part.span)
            owner = np.repeat(np.arange(len(sequences)), blocks)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = begins[owner] + within * part.span
            following = np.minimum(np.arange(1, len(owner) + 1), len(owner) - 1)
            following = np.where(owner[following] == owner, following, np.arange(len(owner)))
            for factor, minima, items in zip(_FACTORS, part.minima, part.items, strict=True):
                least = np.minimum.reduceat(flat * factor, starts)
                least = np.minimum(least, least[following])
                for at in np.flatnonzero(part.bitmap[self._slot(least)]):
                    lo, hi = np.searchsorted(minima, least[at], side="left"), np.searchsorted(minima, least[at], side="right")
                    found.update((int(owner[at]), int(i)) for i in items[lo:hi])
        return found

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text the items contained: (item_id, shingles in common, shingles of the item)."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        group: list[int] = []
        sequences: list[np.ndarray] = []
        size = 0
        for n, text in enumerate(texts):
            own = sequence(text)
            group.append(n)
            sequences.append(own)
            size += len(own)
            if size >= BATCH_SHINGLES or n == len(texts) - 1:
                sets: dict[int, np.ndarray] = {}
                for at, item in sorted(self.candidates(sequences)):
                    if at not in sets:
                        sets[at] = np.unique(sequences[at])
                    want = self.sets[item]
                    common = len(np.intersect1d(want, sets[at], assume_unique=True))
                    if 100 * common >= THRESHOLD * len(want):
                        out[group[at]].append((self.ids[item], common, len(want)))
                group, sequences, size = [], [], 0
        return out


def sequence(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles in their order, repeats included."""
    return shingles(text, ordered=True)


def blocks(items: DataFrame) -> list[tuple[list[int], list[str]]]:
    """Items (item_id, text) in blocks of about BLOCK_WORDS words, as a lazy sequence of bounded lists."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    words = items.agg(F.sum(F.size(F.split("text", WORD_GAP)))).first()[0] or 0
    many = max(1, -(-words // BLOCK_WORDS))
    for k in range(many):
        rows = items.filter(crc_mod(F.col("item_id"), many) == k).orderBy("item_id", "text").collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["text"] for r in rows]


@lru_cache(maxsize=1)
def _index(ids: tuple[int, ...], texts: tuple[str, ...]) -> Index:
    return Index(list(ids), list(texts))


Found = list[tuple[int, int, int]]


def _shared(items: DataFrame) -> list[Broadcast]:
    context = items.sparkSession.sparkContext
    return [context.broadcast((tuple(ids), tuple(texts))) for ids, texts in blocks(items)]  # each is bounded by BLOCK_WORDS


def _searched(batches: Batches, held: list[Broadcast], at: int) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
    """Each batch with the items that its texts (column `at`) contain, from all blocks."""

    def through(group: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
        found: list[list[Found]] = [[[] for _ in range(b.num_rows)] for b in group]
        for block in held:
            claim("benchmark", _index.cache_clear)
            index = _index(*block.value)
            for batch, own in zip(group, found, strict=True):
                for mine, more in zip(own, index.search(batch.column(at).cast(pa.string()).to_pylist()), strict=True):
                    mine += more
        yield from zip(group, found, strict=True)

    group, size = [], 0
    for batch in sliced(batches):
        group.append(batch)
        size += batch.column(at).nbytes
        if len(held) == 1 or size >= GROUP_BYTES:
            yield from through(group)
            group, size = [], 0
    if group:
        yield from through(group)


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and the items contained (item_id, common, size) for every row of docs (doc_id, text)."""
    held = _shared(items)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("common", pa.int32()), ("size", pa.int32())]))

    def find(batches: Batches) -> Batches:
        for batch, found in _searched(batches, held, 1):
            rows = [[{"item_id": a, "common": b, "size": c} for a, b, c in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), find, "doc_id long, found array<struct<item_id:long,common:int,size:int>>")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: whether it holds a benchmark item, how many, which, and the largest share."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"])))
    share = F.array_max(F.transform("found", lambda x: x["common"] / x["size"]))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("item_ids"), F.coalesce(share, F.lit(0.0)).alias("containment"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    held, at = _shared(table(spark, sf_dir, "benchmark")), docs.columns.index("text")

    def keep(batches: Batches) -> Batches:
        for batch, found in _searched(batches, held, at):
            yield batch.filter(pa.array([not own for own in found], pa.bool_()))

    return arrow_map(docs, keep, docs.schema)


_WORDS_SQL = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"""
_SETS_SQL = f"""unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN ['=' || array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END)"""
ORACLE_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, {_SETS_SQL} AS s FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents)),
b AS (SELECT DISTINCT item_id, {_SETS_SQL} AS s FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark)),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS c, any_value(n) AS n FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= {THRESHOLD} * any_value(n)),
g AS (SELECT doc_id, count(*) AS k, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids, max(c / n) AS share FROM f GROUP BY doc_id)
SELECT doc_id, k IS NOT NULL AS contaminated, coalesce(k, 0)::BIGINT AS n_items, coalesce(ids, '') AS item_ids, coalesce(share, 0.0)::DOUBLE AS containment
FROM documents LEFT JOIN g USING (doc_id)
"""
