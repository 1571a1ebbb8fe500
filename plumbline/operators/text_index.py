"""Lexical search by a stored inverted index: posting lists by term, in buckets and blocks, written in segments.

A segment has a row for each term and block of ids (SPAN ids in a row of numbers), in a folder for each bucket of terms,
in the order of terms; and how often each term occurs. A query reads its terms' buckets only, and in these its rarest
terms first: once a text without any of them could not be among the best, the frequent terms are looked up for the
texts found so far, in their blocks, and not listed. Segments are added and merged; a newer segment hides the ids that it
holds or removes from older ones. A manifest names the segments of each version, so that readers see whole versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialized
from .retrieval import CHANNEL_LIMIT, _blocks, tokens_of

BUCKETS = 64
#: Ids of a block: bounds the length of a list in one row.
SPAN = 4096

_POSTINGS = "term string, block long, docs array<long>, bucket int"
_TERMS = "term string, n long, bucket int"
_LISTS = "term string, block long, docs array<long>"
#: Texts that a task cuts into terms at once, and the terms of a block that it keeps before it drops the repeated ones.
LISTED_ROWS, LISTED_TERMS = 1024, 4 << 20
#: Bytes of a lower-cased text that are no part of a term become spaces.
_APART = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block(doc: Column) -> Column:
    return F.floor(doc / F.lit(SPAN)).cast("long")


def _terms_of(part: pa.RecordBatch) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of texts (doc_id, block, lower-cased text), as token_set() finds them, and the id of each; repeated ones too."""
    text = part.column(2).cast(pa.string())
    cuts = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2].to_pybytes()[cuts[0] : cuts[-1]] if cuts[-1] > cuts[0] else b""
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), pa.py_buffer(cuts - cuts[0]), pa.py_buffer(data.translate(_APART))))
    flat = words.flatten()
    kept = pc.greater_equal(pc.binary_length(flat), 3)
    return flat.filter(kept), np.asarray(part.column(0))[np.asarray(pc.list_parent_indices(words).filter(kept))]


def _distinct(terms: list[pa.StringArray], ids: list[np.ndarray]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The different pairs of term and id, in this order: the terms, and the place among them and the id of each pair."""
    coded = pa.concat_arrays(terms).dictionary_encode()
    every, rank = np.unique(np.concatenate(ids), return_inverse=True)
    term, own = np.divmod(np.unique(np.asarray(coded.indices).astype(np.int64) * max(1, len(every)) + rank), max(1, len(every)))
    return coded.dictionary, term, every[own]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, block, docs of texts that come block by block."""
    block, terms, ids = None, [], []

    def whole() -> Iterator[pa.RecordBatch]:
        if sum(map(len, terms)):
            names, term, docs = _distinct(terms, ids)
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(term)).astype(np.int32)), pa.array(docs))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term[starts])), pa.array(np.full(len(starts), block, np.int64)), lists], ["term", "block", "docs"])

    for batch in batches:
        blocks = np.asarray(batch.column(1))
        for start, end in pairwise([0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)] if len(blocks) else []):
            if blocks[start] != block:
                yield from whole()
                block, terms, ids = blocks[start], [], []
            for at in range(start, end, LISTED_ROWS):
                found, owners = _terms_of(batch.slice(at, min(LISTED_ROWS, end - at)))
                terms.append(found)
                ids.append(owners)
                if sum(map(len, terms)) > LISTED_TERMS:  # only repeated ids add up to many
                    names, term, docs = _distinct(terms, ids)
                    terms, ids = [names.take(pa.array(term))], [docs]
    yield from whole()


class TextIndex:
    """An index at a path: segments/<name>/{postings,terms,docs,gone} and manifest/version=N."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[str]:
        """The names of the newest version's segments, oldest first."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return []
        rows = self.spark.read.schema("segments array<string>, version long").parquet(f"{self.path}/manifest")
        return rows.agg(F.max_by("segments", "version")).first()[0]

    def _publish(self, segments: list[str]) -> None:
        rows = self.spark.createDataFrame([(segments,)], "segments array<string>")
        before = 0
        if self.segments():
            before = self.spark.read.schema("segments array<string>, version long").parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0]
        # a version that exists already was published by another writer meanwhile: this fails
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={before + 1}")

    def _read(self, segment: str, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/segments/{segment}/{what}")

    def _write(self, lists: DataFrame, docs: DataFrame, gone: DataFrame) -> str:
        """lists (term, block, docs: their ids in order) as a segment that holds docs and hides gone."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        lists = lists.select("term", "block", "docs", _bucket(F.col("term")).alias("bucket"))
        lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{at}/postings")
        terms = self._read(name, "postings", _POSTINGS).groupBy("bucket", "term").agg(F.sum(F.size("docs")).alias("n"))
        terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")
        docs.select("doc_id").distinct().write.parquet(f"{at}/docs")
        gone.select("doc_id").distinct().write.parquet(f"{at}/gone")
        return name

    def add(self, corpus: DataFrame) -> str:
        """A segment of corpus (doc_id, text): new texts, and those that replace older ones with the same id. Null ids are left out, null texts have no terms."""
        rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
        texts = rows.select("doc_id", _block(F.col("doc_id")).alias("block"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        # a block has at most SPAN ids: its texts meet in one task, which turns them over, so that postings are no rows
        name = self._write(texts.repartition("block").sortWithinPartitions("block").mapInArrow(_lists, _LISTS), rows, rows)
        self._publish([*self.segments(), name])
        return name

    def remove(self, ids: DataFrame) -> str:
        """A segment without texts that hides ids (doc_id)."""
        nothing = self.spark.createDataFrame([], f"{_LISTS}, doc_id long")
        name = self._write(nothing, nothing, ids.filter("doc_id is not null"))
        self._publish([*self.segments(), name])
        return name

    def merge(self) -> str:
        """One segment of all that is alive, in place of the others."""
        segments = self.segments()
        alive = self._alive(segments, lambda s: self._read(s, "postings", _POSTINGS).select("term", F.explode("docs").alias("doc_id")))
        docs = self._alive(segments, lambda s: self._read(s, "docs", "doc_id long"))
        # a list has at most SPAN ids, so a frequent term is many rows and no group is large
        lists = alive.groupBy("term", _block(F.col("doc_id")).alias("block")).agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
        name = self._write(lists, docs, docs.filter(F.lit(False)))
        self._publish([name])
        return name

    def _hidden(self, segments: list[str]) -> dict[str, DataFrame]:
        """For each segment but the last what newer ones hide."""
        out = {}
        for k, segment in enumerate(segments[:-1]):
            out[segment] = reduce(DataFrame.union, [self._read(s, "gone", "doc_id long") for s in segments[k + 1 :]]).distinct()
        return out

    def _alive(self, segments: list[str], rows) -> DataFrame:
        """The rows (with a doc_id) of each segment that no newer one hides."""
        hidden = self._hidden(segments)
        return reduce(DataFrame.unionByName, [rows(s).join(hidden[s], "doc_id", "left_anti") if s in hidden else rows(s) for s in segments])

    def _asked(self, wanted: list[tuple[int, str]]) -> DataFrame:
        """Queries' terms (query_id, term) with their buckets."""
        return self.spark.createDataFrame(wanted, "query_id long, term string").withColumn("bucket", _bucket(F.col("term")))

    def _listed(self, segments: list[str], wanted: list[tuple[int, str]], what: str, schema: str) -> DataFrame:
        """The rows of the queries' terms; only their buckets' folders are read."""
        asked = self._asked(wanted)
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        one = lambda s: self._read(s, what, schema).filter(F.col("bucket").isin(buckets)).join(F.broadcast(asked), ["bucket", "term"]).withColumn("segment", F.lit(s))
        return reduce(DataFrame.unionByName, [one(s) for s in segments])

    def _counted(self, segments: list[str], wanted: list[tuple[int, str]]) -> DataFrame:
        """query_id, doc_id, n: how many of the wanted terms each text has."""
        rows = self._listed(segments, wanted, "postings", _POSTINGS)
        alive = self._alive(segments, lambda s: rows.filter(F.col("segment") == s).select("query_id", F.explode("docs").alias("doc_id")))
        return alive.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))

    def _looked_up(self, segments: list[str], candidates: DataFrame, wanted: list[tuple[int, str]]) -> DataFrame:
        """query_id, doc_id, n: the same for candidates (query_id, doc_id) alone; of the lists only their blocks are opened."""
        asked = self._asked(wanted)
        keys = candidates.select("query_id", "doc_id", _block(F.col("doc_id")).alias("block")).join(F.broadcast(asked), "query_id")
        rows = self._listed(segments, sorted({(0, t) for _, t in wanted}), "postings", _POSTINGS).drop("query_id")
        met = keys.join(rows, ["bucket", "term", "block"]).filter(F.array_contains("docs", F.col("doc_id")))
        alive = self._alive(segments, lambda s: met.filter(F.col("segment") == s).select("query_id", "doc_id"))
        return alive.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))

    def search(self, queries: DataFrame, limit: int = CHANNEL_LIMIT) -> DataFrame:
        """query_id, doc_id, score, rank: what retrieval.lexical() finds in the texts that are alive."""
        found, segments = [], self.segments()
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).filter("query_id is not null and text is not null")
        empty = self.spark.createDataFrame([], "query_id long, doc_id long, n long")
        for block in _blocks(asked) if segments else []:
            tokens = {r["query_id"]: tokens_of(r["text"]) for r in block.collect()}  # bounded by BROADCAST_QUERIES
            every = sorted({(0, t) for own in tokens.values() for t in own})
            if not every:
                continue
            frequent = {r["term"]: r["n"] for r in self._listed(segments, every, "terms", _TERMS).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the queries' terms
            ordered = {q: sorted((t for t in own if t in frequent), key=lambda t: (frequent[t], t)) for q, own in tokens.items()}
            listed = {q: -(-len(own) // 2) for q, own in ordered.items()}
            counts, least = self._rounds(segments, ordered, listed, limit, empty)
            rest = [(q, t) for q, own in ordered.items() for t in own[listed[q] :]]
            told = self.spark.createDataFrame([(q, len(tokens[q]), len(own) - listed[q], least.get(q, 0)) for q, own in ordered.items()], "query_id long, size long, rest long, least long")
            near = counts.join(F.broadcast(told), "query_id").filter(F.col("n") + F.col("rest") >= F.col("least"))
            if rest:
                near = materialized(near, "candidates")
                more = self._looked_up(segments, near, rest).withColumnRenamed("n", "more")
                near = near.join(more, ["query_id", "doc_id"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
            found.append(near.select("query_id", "doc_id", (F.col("n") / F.col("size")).alias("score")))
        rows = reduce(DataFrame.unionByName, found) if found else empty.select("query_id", "doc_id", F.col("n").cast("double").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)

    def _rounds(self, segments: list[str], ordered: dict[int, list[str]], listed: dict[int, int], limit: int, empty: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        """Counts over each query's first listed[q] terms, and the limit-th best. Terms are added until a text without any of them cannot be as good."""
        counts, done, least = empty, dict.fromkeys(ordered, 0), {}
        best = Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id")
        while wanted := [(q, t) for q, own in ordered.items() for t in own[done[q] : listed[q]]]:
            counts = materialized(counts.union(self._counted(segments, wanted)).groupBy("query_id", "doc_id").agg(F.sum("n").alias("n")), "counts")
            done = dict(listed)
            ranked = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == limit)
            least = {r["query_id"]: r["n"] for r in ranked.collect()}  # one row a query
            for q, own in ordered.items():
                # others have at most len(own) - listed[q] of the terms
                listed[q] = max(listed[q], min(len(own), len(own) - least.get(q, 0) + 1))
        return counts, least
