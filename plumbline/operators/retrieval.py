"""Hybrid retrieval: understanding a query, semantic, lexical and graph channels, rank fusion, compression, evaluation.

All operators work on any number of queries at once. Queries are sent to every task in blocks of a bounded number; a
task keeps the best of each query of all the rows that it reads, so that only these are shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of retrieval.
RRF = 60
CHANNEL_LIMIT, CANDIDATES, EVIDENCE, CLIP = 50, 100, 8, 600
STOP_WORDS = "a an and are for from how in is of on or the this that to what where which who does do with".split()
RULE_ID = r"\b(?:SEO|AEO|GEO)-[A-Z0-9]+(?:-[A-Z0-9]+)*-[0-9]{3}\b"
PATHS = r"(?:[A-Za-z0-9_.-]+/)+[^ ]+"
IDENTIFIERS = r"\b(?:[A-Z][a-z0-9]+(?:[A-Z][a-zA-Z0-9]+)+|[a-z]+(?:[A-Z][a-zA-Z0-9]+)+)\b"
#: Queries that are sent to every task at once; more are taken in blocks of about half as many.
BROADCAST_QUERIES = 2_000
#: Rows of the corpus that are scored at once.
SCORED_ROWS = 1024


def understand(query: Column) -> dict[str, Column]:
    """What a query asks for: its plain form, rule ids, identifiers and tokens."""
    plain = F.trim(F.regexp_replace(query, r"[ \t\n\r\f]+", " "))
    every = lambda p: F.regexp_extract_all(plain, F.lit(p), F.lit(0))
    names = F.array_distinct(F.concat(every(RULE_ID), every(PATHS), every(IDENTIFIERS)))
    words = F.transform(F.filter(every("[a-zA-Z0-9_]+"), lambda w: F.length(w) >= 3), lambda w: F.lower(w))
    return {
        "plain": plain,
        "rule_ids": every(RULE_ID),
        "identifiers": names,
        "tokens": F.filter(words, lambda w: ~w.isin(STOP_WORDS)),
        "rewritten": F.when(F.size(names) > 0, F.concat_ws(" ", plain, F.array_join(names, " "))).otherwise(plain),
    }


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized_vector(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def _top(rows: DataFrame, n: int) -> DataFrame:
    """The n best of each query. Each task keeps its own n best before the shuffle (a window with a rank limit does so)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries as they are up to BROADCAST_QUERIES rows, else in blocks by a hash of their id."""
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        return [queries]
    parts = -(-2 * n // BROADCAST_QUERIES)
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


_RANKED = "query_id long, doc_id long, score double"


def _rows(ids: list, docs: list, scores: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "doc_id", "score"])


class _Best:
    """The best rows of each query that a task has met: by score, then by the least doc_id."""

    def __init__(self, limit: int):
        self.limit, self.heaps = limit, defaultdict(list)

    def add(self, query: int, doc: int, score: float) -> None:
        heap, item = self.heaps[query], (score, -doc)
        if len(heap) < self.limit:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)

    def rows(self) -> pa.RecordBatch:
        found = [(q, -d, s) for q, heap in self.heaps.items() for s, d in heap]
        return _rows(*(list(c) for c in zip(*found, strict=True))) if found else _rows([], [], [])


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def semantic(queries: DataFrame, corpus: DataFrame, limit: int = CHANNEL_LIMIT) -> DataFrame:
    """query_id, doc_id, score, rank by exact cosine: queries (query_id, vector) against all of corpus (doc_id, vector).

    Each task multiplies blocks of its vectors with those of the queries. Rows with a null vector or id match nothing.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null and query_id is not null")
    d = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null and doc_id is not null")
    context, ranked = queries.sparkSession.sparkContext, []
    for block in _blocks(q):  # all rows of a query are in one block, so that each block ranks its own
        asked = sorted(block.collect(), key=lambda r: r["query_id"])  # bounded by BROADCAST_QUERIES
        if not asked:
            continue
        held = context.broadcast(([r["query_id"] for r in asked], _unit(np.array([r["vector"] for r in asked], dtype=np.float64))))

        def score(batches, held=held):
            ids, wanted = held.value
            best = _Best(limit)
            for batch in batches:
                for at in range(0, batch.num_rows, SCORED_ROWS):
                    part = batch.slice(at, SCORED_ROWS)
                    docs = np.asarray(part.column(0))
                    own = _unit(np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(len(docs), -1))
                    products = own @ wanted.T
                    for j, query in enumerate(ids):
                        column = products[:, j]
                        heap = best.heaps[query]
                        near = np.flatnonzero(column >= heap[0][0]) if len(heap) >= limit else range(len(docs))
                        for i in near:
                            best.add(query, int(docs[i]), float(column[i]))
            yield best.rows()

        ranked.append(_top(d.mapInArrow(score, _RANKED), limit))
    return reduce(DataFrame.unionByName, ranked) if ranked else _top(queries.sparkSession.createDataFrame([], _RANKED), limit)


def tokens_of(text: str | None) -> list[str]:
    """token_set() for a text in a task."""
    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) >= 3)) if text else []


def lexical(queries: DataFrame, corpus: DataFrame, limit: int = CHANNEL_LIMIT) -> DataFrame:
    """query_id, doc_id, score, rank by the share of a query's tokens that a text has: queries (query_id, text), corpus (doc_id, text).

    Each task counts the common tokens of its texts by postings of the queries; texts without any are not rows.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).filter("query_id is not null and text is not null")
    d = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    context, ranked = queries.sparkSession.sparkContext, []
    for block in _blocks(q):
        wanted = {r["query_id"]: tokens_of(r["text"]) for r in block.collect()}  # bounded by BROADCAST_QUERIES
        postings = defaultdict(list)
        for query, tokens in sorted(wanted.items()):
            for token in tokens:
                postings[token].append(query)
        held = context.broadcast((dict(postings), {k: len(v) for k, v in wanted.items()}))

        def score(batches, held=held):
            lists, sizes = held.value
            best = _Best(limit)
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    met = defaultdict(int)
                    for token in set(tokens_of(text)) & lists.keys():
                        for query in lists[token]:
                            met[query] += 1
                    for query, k in met.items():
                        best.add(query, doc, k / sizes[query])
            yield best.rows()

        ranked.append(_top(d.mapInArrow(score, _RANKED), limit))
    return reduce(DataFrame.unionByName, ranked)


def channel(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.select("query_id", "doc_id", "score", "rank", F.lit(name).alias("channel"))


def fused(*channels: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion: query_id, doc_id, rrf, best channel and raw score. A document met twice counts twice."""
    rows = reduce(DataFrame.unionByName, channels)
    best = F.max_by(F.struct("channel", "score"), F.struct("score", "channel"))
    merged = rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), best.alias("best"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "doc_id")
    ranked = merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "doc_id", "rank", "rrf", F.col("best.channel").alias("channel"), F.col("best.score").alias("score"))


def reranked(candidates: DataFrame, score: Column, limit: int = EVIDENCE) -> DataFrame:
    """Candidates by another score; ties keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    rows = candidates.withColumn("rerank_score", score).withColumn("final_rank", F.row_number().over(w))
    return rows.filter(F.col("final_rank") <= limit)


def compressed(items: DataFrame, corpus: DataFrame, clip: int = CLIP) -> DataFrame:
    """Items with the first characters of their text."""
    return items.join(corpus.select("doc_id", "text"), "doc_id").withColumn("excerpt", F.substring("text", 1, clip)).drop("text")


def evaluated(ranked: DataFrame, relevant: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """recall, precision, reciprocal rank and nDCG at k: ranked (query_id, doc_id, rank), relevant (query_id, doc_id)."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    return measured(total, ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"], "left_semi"), k)


def measured(total: DataFrame, hits: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """The metrics of evaluated() from the number of relevant rows (query_id, n) and the relevant ones among the first k (query_id, rank)."""
    got = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    rows = total.join(got, "query_id", "left")
    zero = F.lit(0.0)
    return rows.select(
        "query_id",
        F.coalesce(F.col("hits") / F.col("n"), zero).alias("recall"),
        F.coalesce(F.col("hits") / F.lit(k), zero).alias("precision"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
    )


def scoped(corpus: DataFrame, **equal: object) -> DataFrame:
    """The rows that meet every given equality; a list means any of its values, an empty one or None everything."""
    for name, value in equal.items():
        if isinstance(value, (list, tuple)):
            corpus = corpus.filter(F.col(name).isin(list(value))) if value else corpus
        elif value is not None:
            corpus = corpus.filter(F.col(name) == value)
    return corpus


def hash_embedding(text: Column, dimensions: int = 384) -> Column:
    """A deterministic vector for tests: the digest's bytes repeated, with unit length."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    values = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)
    return normalized_vector(values)
