"""Queries of stored indexes and of state that streams keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex, recall
from ..session import scratch
from ..sources.tables import table
from ..streaming import changes
from . import retrieval as flat

_DAY = 86_400.0


def stream_progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's events tell anew, replayed as a stream of files in any order."""
    told = changes.replayed(spark, f"{sf_dir}/events.parquet", "user_id", "ts", "event_id", "event_type", heartbeat=1000 * _DAY)
    return told.select("user_id", F.col("number").alias("event_id"), F.col("value").alias("event_type"))


def stream_progress_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with daily heartbeats; a purchase closes its user."""
    told = changes.replayed(spark, f"{sf_dir}/events.parquet", "user_id", "ts", "event_id", "event_type", terminal=("purchase",), heartbeat=_DAY)
    return told.select("user_id", F.unix_micros("at").alias("micros"), F.coalesce("number", F.lit(-1)).alias("event_id"), F.col("value").alias("event_type"), "kind")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """An index of two thirds of the vectors to which the others are added, and every hundredth vector as a query."""
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    index = VectorIndex.build(corpus.filter("doc_id % 3 <> 1"), scratch(spark, "vectors")).add(corpus.filter("doc_id % 3 = 1"))
    return index, corpus.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")


def retr_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors, exactly, with the cells that cannot hold one left out."""
    index, asked = _vectors(spark, sf_dir)
    return index.search(asked, share=None).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def retr_vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the nearest vectors that a search of the nearest cells finds."""
    index, asked = _vectors(spark, sf_dir)
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return recall(index.search(asked), retrieval.semantic(asked, corpus))


def retr_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's lexical hits by an index of three segments: texts, some of them in another form, that form's correction and removals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = TextIndex(spark, scratch(spark, "texts"))
    index.add(docs.filter("doc_id % 5 <> 2").withColumn("text", F.when(F.col("doc_id") % 5 == 3, F.reverse("text")).otherwise(F.col("text"))))
    index.add(docs.filter("doc_id % 5 in (2, 3)"))
    index.remove(docs.filter("doc_id % 10 = 4"))
    index.merge()
    index.remove(docs.filter("doc_id % 10 = 6"))
    return index.search(asked).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


QUERIES = {q.__name__: q for q in (stream_progress_changes, stream_progress_closed, retr_vector_index, retr_vector_index_recall, retr_text_index)}

ORACLES = {
    "stream_progress_changes": flat.ORACLES["progress_changes"],
    "stream_progress_closed": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM e WHERE b IS DISTINCT FROM event_type OR b = 'purchase'),
u AS (SELECT make_timestamp((epoch_us(max(ts)) // 1000 + 1) * 1000) AS until FROM events),
beats AS (SELECT user_id, unnest(generate_series(ts + INTERVAL 1 DAY, coalesce(nxt, until), INTERVAL 1 DAY)) AS beat, event_type, coalesce(nxt, until) AS stop FROM n, u WHERE event_type <> 'purchase')
SELECT user_id, epoch_us(ts) AS micros, event_id, event_type, CASE WHEN event_type = 'purchase' THEN 'closed' ELSE 'change' END AS kind FROM n
UNION ALL SELECT user_id, epoch_us(beat), -1, event_type, 'heartbeat' FROM beats WHERE beat < stop""",
    "retr_vector_index": flat.ORACLES["retr_semantic_topk"],
    "retr_text_index": flat.ORACLES["retr_lexical_overlap"].replace("unnest(" + flat._TOKENS + ") AS t FROM documents)", "unnest(" + flat._TOKENS + ") AS t FROM documents WHERE doc_id % 10 NOT IN (4, 6))"),
}
