"""Queries that replay: a crawl under a budget, changes of texts block by block, schedules over a stream of ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import block_diff, crawl, index
from ..session import scratch
from ..sources.store import KeyedStore
from ..sources.tables import pages, table
from ..streaming import ticks

#: The crawl's budget of pages.
BUDGET = 120


def crawl_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from every tenth page by the pages' links: some urls failed, some are refused, those without a page failed too."""
    rows = pages(spark, sf_dir).select("page_id", urls.normalized(F.col("url")).alias("url"), "links").filter("url is not null")
    links = rows.select(F.col("url").alias("source"), F.posexplode("links").alias("nth", "link")).filter("link.internal").select("source", F.col("link.href").alias("target"), "nth")
    known = rows.groupBy("url").agg(F.min("page_id").alias("page_id"))
    targets = links.select(F.col("target").alias("url")).distinct()
    failed = known.filter("page_id % 7 = 0").select("url").union(targets.join(known, "url", "left_anti").filter(F.xxhash64("url") % 3 == 0))
    return crawl.bounded(links, rows.filter("page_id % 10 = 0").select("url", F.col("page_id").alias("nth")), failed, known.filter("page_id % 11 = 0").select("url"), BUDGET)


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as they were and as they are: some fell out, some were said twice, changed or moved."""
    k, lines = F.col("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n")
    after = (
        F.when(k % 4 == 0, F.concat(F.slice(lines, 2, 1000000), F.slice(lines, 1, 1)))
        .when(k % 4 == 1, F.filter(lines, lambda x, i: (i + k) % 5 != 0))
        .when(k % 4 == 2, F.concat(F.slice(lines, 1, 2), F.transform(lines, lambda x, i: F.when(i % 7 == 3, F.concat(x, F.lit("!"))).otherwise(x))))
        .otherwise(lines)
    )
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    sides = [docs.select(k.alias("pair"), F.lit(s).alias("side"), F.posexplode(own).alias("place", "text")) for s, own in enumerate((lines, after))]
    rows = sides[0].union(sides[1]).filter(F.trim("text") != "")
    return rows.withColumns({"first": F.col("place") + 1, "last": F.col("place") + 1, "label": F.when(F.col("text").rlike("^[A-Z].{0,60}$"), F.col("text"))})


def change_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_diff.units(_versions(spark, sf_dir))


def schedule_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule for each nation, over the events as ticks."""
    start = F.to_timestamp(F.lit("2024-01-03 00:00:00")) + F.make_dt_interval(hours=F.col("n_nationkey"))
    schedules = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("schedule_id"), start.alias("start"), (F.lit(3600) + F.col("n_nationkey") * 1800).alias("every"), (F.col("n_nationkey") % 6 != 5).alias("enabled"))
    return ticks.replayed(spark, f"{sf_dir}/events.parquet", "ts", schedules).select("schedule_id", "slot", F.unix_micros("fired_at").alias("micros"))


def _chunk_key() -> Column:
    return F.concat_ws(":", F.lit("7"), F.lit("3"), urls.path(F.col("url")), F.lit("page"), F.coalesce(F.lit(None).cast("string"), F.lit("")), F.col("page_id").cast("string"))


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of the pages' chunks."""
    return table(spark, sf_dir, "pages").select("page_id", index.point_id(_chunk_key()).alias("id"))


def store_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of customers and nations in a store: a third is written again with another type, new ones are added, some are deleted."""
    edges = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("IN").alias("type"), "c_custkey")
    own = KeyedStore(spark, scratch(spark, "graph"), ["src", "dst"], edges.drop("c_custkey").schema, buckets=16)
    own.merge(edges.filter("c_custkey % 5 <> 4"))
    own.merge(edges.filter("c_custkey % 3 = 0").withColumn("type", F.lit("AT")))
    own.delete(F.col("dst") == "n7")
    own.merge(edges.filter("c_custkey = 1").withColumn("type", F.lit("ONE")))
    return own.read()


QUERIES = {q.__name__: q for q in (crawl_bounded, change_units, schedule_slots, point_ids, store_merged)}

ORACLES = {
    "schedule_slots": """WITH s AS (SELECT n_nationkey::BIGINT AS schedule_id, epoch_us(TIMESTAMP '2024-01-03 00:00:00' + to_hours(n_nationkey)) AS start, (3600 + n_nationkey * 1800)::BIGINT * 1000000 AS every FROM nation WHERE n_nationkey % 6 <> 5)
SELECT schedule_id, ((epoch_us(ts) - start) // every)::BIGINT AS slot, min(epoch_us(ts)) AS micros FROM events, s WHERE epoch_us(ts) >= start GROUP BY 1, 2""",
    "store_merged": """SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, CASE WHEN c_custkey = 1 THEN 'ONE' WHEN c_custkey % 3 = 0 THEN 'AT' ELSE 'IN' END AS type
FROM customer WHERE (c_custkey % 5 <> 4 OR c_custkey % 3 = 0) AND c_nationkey <> 7 OR c_custkey = 1""",
    "point_ids": r"""WITH k AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('7:3:' || coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') || ':page::' || page_id)) AS h FROM pages)
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM k""",
}
