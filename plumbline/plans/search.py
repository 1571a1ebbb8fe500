"""Queries of search analytics over events: views are impressions, clicks are clicks, the value stands for the position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import findings, search
from ..sources.tables import table
from ..streaming import events as stream
from . import sql


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facts_from_events(table(spark, sf_dir, "events"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in rows.dtypes])


def _by(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(*search.totals())


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by query, with an id and a position from 1 on."""
    return _by(_facts(spark, sf_dir), "query").select(F.col("query").cast("long").alias("id"), "query", "impressions", "clicks", "ctr", "position")


def search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_facts(spark, sf_dir))


def search_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.dimensions(_facts(spark, sf_dir)))


def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_facts(spark, sf_dir).agg(*search.totals()))


def search_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by(_facts(spark, sf_dir), "day").withColumn("id", F.datediff("day", F.lit("2000-01-01")).cast("long"))
    return _rounded(search.daily_series(rows))


def search_period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.period_comparisons(_by(_facts(spark, sf_dir), "day")))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = _facts(spark, sf_dir)
    late = F.dayofmonth("day") > 15
    return _by(facts.filter(late), "query"), _by(facts.filter(~late & (F.col("query").cast("int") % 5 != 0)), "query")


def search_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = _halves(spark, sf_dir)
    rows = search.movement(current, previous, "query")
    return _rounded(rows.withColumn("tone", search.movement_tone("position", F.round("delta_position", 6))))


def search_top_queries_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by(_facts(spark, sf_dir), "page", "query").filter("query is not null")
    return search.top_queries_per_page(rows).select("page", "query", "impressions", "clicks", "rank")


def keyword_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _queries(spark, sf_dir).withColumn("position", F.round("position", 6)).withColumn("ctr", F.round("ctr", 6))
    found = search.keyword_opportunities(rows.filter("query is not null"))
    return found.withColumn("filters", F.array_join("filters", ",")).drop("reason")


def keyword_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the list of opportunities says about each: halves of a digit may round differently elsewhere, so no SQL equivalent."""
    return search.keyword_opportunities(_queries(spark, sf_dir)).select("query", "reason")


def _snapshot(spark: SparkSession, facts: DataFrame) -> DataFrame:
    one = facts.agg(*search.totals())
    pairs = F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in ("impressions", "clicks", "ctr", "position")])
    return search.snapshot(spark, one.select(F.explode(pairs).alias("m")).select("m.*"))


def metric_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    late = F.dayofmonth("day") > 15
    return _rounded(search.compare_metrics(_snapshot(spark, facts.filter(~late)), _snapshot(spark, facts.filter(late))))


def experiment_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = _halves(spark, sf_dir)
    rows = current.select("query", F.col("impressions").alias("after")).join(previous.select("query", F.col("impressions").alias("before")), "query", "left")
    return rows.select("query", "before", "after", search.result_confidence(F.col("before"), F.col("after")).alias("confidence"))


def search_page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of pages whose urls are spelled in several ways meet under one key."""
    spelled = F.concat(F.when(F.col("user_id") % 2 == 0, "https://Site.example/P").otherwise("https://site.example/P"), (F.col("user_id") % 50).cast("string"), F.when(F.col("user_id") % 3 == 0, "/").otherwise("?x=1"))
    rows = table(spark, sf_dir, "events").select(spelled.alias("page"), F.when(F.col("event_type") == "view", 1).otherwise(0).cast("long").alias("impressions"), F.when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("clicks"), F.col("value").alias("position"))
    return _rounded(search.page_keys(rows))


def findings_with_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules meet the search metrics of all pages by page key, else by path."""
    from .pages import _findings

    own = _findings(spark, sf_dir)
    metrics = table(spark, sf_dir, "pages").select(urls.page_key(F.col("url")).alias("page_key"), urls.path(F.col("url")).alias("path"), (F.col("page_id") * 10).alias("impressions"), F.col("page_id").alias("position_in_input"))
    return findings.attach_impressions(own, metrics).select("finding_id", "impressions", F.round(findings.reach_of_impressions(F.col("impressions")), 9).alias("reach"))


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.daily_counts(spark, sf_dir)


QUERIES = {q.__name__: q for q in (search_facts, search_dimensions, search_totals, search_daily_series, search_period_comparison, search_movement, search_top_queries_per_page, keyword_opportunities, keyword_reasons, metric_compare, experiment_confidence, search_page_keys, findings_with_impressions, stream_daily_counts)}

_FACTS = """f AS MATERIALIZED (SELECT ts::DATE AS day, user_id::VARCHAR AS page, props->>'$.k' AS query, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks, avg(value) AS position FROM events GROUP BY ALL)"""
_TOTALS = "sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, round(coalesce(sum(clicks) / nullif(sum(impressions), 0), 0.0), 6) AS ctr, round(coalesce(sum(position * impressions) / nullif(sum(impressions), 0), 0.0), 6) AS position"
_RAW = _TOTALS.replace("round(coalesce", "(coalesce").replace("0.0), 6)", "0.0))")
_PERIOD_ROWS = ", ".join(f"('{p}', {n})" for p, n in search.PERIODS)


def _period(half: str, low: str, high: str) -> str:
    return f"(SELECT length, min(day) AS {half}_start, max(day) AS {half}_end, {_RAW.replace(' AS impressions', f' AS {half}_impressions').replace(' AS clicks', f' AS {half}_clicks').replace(' AS ctr', f' AS {half}_ctr').replace(' AS position', f' AS {half}_position')} FROM n, w WHERE n.n > {low} AND n.n <= {high} GROUP BY length)"



def _key(u: str) -> str:
    """The page key of a full URL."""
    return f"({sql.origin(u)} || regexp_replace({sql.part(u, 4)}, '/+$', ''))"


ORACLES = {
    "search_facts": f"WITH {_FACTS} SELECT day::VARCHAR AS day, page, query, impressions, clicks, round(position, 6) AS position FROM f",
    "search_dimensions": f"WITH {_FACTS} SELECT 'date' AS dimension, day::VARCHAR AS day, NULL AS page, NULL AS query, {_TOTALS} FROM f GROUP BY day UNION ALL SELECT 'page', NULL, page, NULL, {_TOTALS} FROM f GROUP BY page UNION ALL SELECT 'query', NULL, NULL, query, {_TOTALS} FROM f GROUP BY query UNION ALL SELECT 'page_query', NULL, page, query, {_TOTALS} FROM f GROUP BY page, query",
    "search_totals": f"WITH {_FACTS} SELECT {_TOTALS} FROM f",
    "search_daily_series": f"WITH {_FACTS} SELECT day::VARCHAR AS day, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, round(coalesce(sum(position * impressions) / nullif(sum(impressions), 0), 0.0), 6) AS position, date_diff('day', DATE '2000-01-01', day) AS id FROM f GROUP BY day",
    "search_period_comparison": f"""WITH {_FACTS}, w(period, length) AS (VALUES {_PERIOD_ROWS}), d AS (SELECT day, {_RAW} FROM f GROUP BY day), n AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS n, count(*) OVER () AS have FROM d),
x AS (SELECT w.*, (SELECT count(*) FROM d) AS have, c.* EXCLUDE (length), p.* EXCLUDE (length) FROM w LEFT JOIN {_period("current", "0", "length")} c USING (length) LEFT JOIN {_period("previous", "length", "2 * length")} p USING (length))
SELECT period, length, CASE WHEN have >= 2 * length THEN 'observed' ELSE 'unavailable' END AS status, CASE WHEN have < 2 * length THEN 'need ' || 2 * length || ' daily rows, have ' || have END AS detail,
  {", ".join(f"CASE WHEN have >= 2 * length THEN {h}_{e}::VARCHAR END AS {h}_{e}" for h in ("current", "previous") for e in ("start", "end"))},
  {", ".join(f"CASE WHEN have >= 2 * length THEN {'round(' if m in ('ctr', 'position') else ''}current_{m}{', 6)' if m in ('ctr', 'position') else ''} END AS current_{m}" for m in ("impressions", "clicks", "ctr", "position"))},
  {", ".join(f"CASE WHEN have >= 2 * length THEN {'round(' if m in ('ctr', 'position') else ''}current_{m} - previous_{m}{', 6)' if m in ('ctr', 'position') else ''} END AS delta_{m}" for m in ("impressions", "clicks", "ctr", "position"))} FROM x""",
    "search_movement": f"""WITH {_FACTS}, c AS (SELECT query, {_RAW} FROM f WHERE day(day) > 15 GROUP BY query), b AS (SELECT query, {_RAW} FROM f WHERE day(day) <= 15 AND query::INT % 5 <> 0 GROUP BY query)
SELECT c.query, c.impressions, c.clicks, round(c.ctr, 6) AS ctr, round(c.position, 6) AS position, CASE WHEN (SELECT count(*) FROM b) = 0 THEN 'unknown' WHEN b.query IS NULL THEN 'new' WHEN c.impressions > b.impressions THEN 'up' WHEN c.impressions < b.impressions THEN 'down' ELSE 'flat' END AS movement,
  c.impressions - b.impressions AS delta_impressions, c.clicks - b.clicks AS delta_clicks, round(c.ctr - b.ctr, 6) AS delta_ctr, round(c.position - b.position, 6) AS delta_position,
  CASE WHEN b.query IS NULL OR round(c.position - b.position, 6) = 0 THEN 'flat' WHEN round(c.position - b.position, 6) < 0 THEN 'up' ELSE 'down' END AS tone FROM c LEFT JOIN b USING (query)""",
    "search_top_queries_per_page": f"WITH {_FACTS}, t AS (SELECT page, query, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks FROM f WHERE query IS NOT NULL GROUP BY ALL) SELECT page, query, impressions, clicks, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY impressions DESC, query) AS rank FROM t) WHERE rank <= 5",
    "keyword_opportunities": f"WITH {_FACTS}, q AS (SELECT query, {_TOTALS} FROM f WHERE query IS NOT NULL GROUP BY query) SELECT query::BIGINT AS id, query, impressions, clicks, ctr, position, CASE WHEN position >= 8 AND ctr < 0.02 THEN 'position,ctr' WHEN position >= 8 THEN 'position' ELSE 'ctr' END AS filters FROM q WHERE position >= 8 OR ctr < 0.02",
    "metric_compare": f"""WITH {_FACTS}, b AS (SELECT {_RAW} FROM f WHERE day(day) <= 15), a AS (SELECT {_RAW} FROM f WHERE day(day) > 15),
m AS (SELECT 'impressions' AS key, b.impressions::DOUBLE AS before, a.impressions::DOUBLE AS after FROM a, b UNION ALL SELECT 'clicks', b.clicks, a.clicks FROM a, b UNION ALL SELECT 'ctr', b.ctr, a.ctr FROM a, b UNION ALL SELECT 'position', b.position, a.position FROM a, b),
k(key, detail) AS (VALUES {", ".join(f"('{k}', '{search.UNMEASURED.get(k, 'not measured')}')" for k in search.METRICS)})
SELECT key, CASE WHEN m.before IS NULL THEN 'unavailable' ELSE 'observed' END AS status, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, CASE WHEN m.before IS NULL THEN detail END AS detail FROM k LEFT JOIN m USING (key)""",
    "experiment_confidence": f"""WITH {_FACTS}, c AS (SELECT query, sum(impressions)::BIGINT AS after FROM f WHERE day(day) > 15 GROUP BY query), b AS (SELECT query, sum(impressions)::BIGINT AS before FROM f WHERE day(day) <= 15 AND query::INT % 5 <> 0 GROUP BY query)
SELECT query, before, after, CASE WHEN before IS NULL OR after IS NULL THEN 0.2 WHEN least(before, after) >= 10000 THEN 0.7 WHEN least(before, after) >= 1000 THEN 0.5 WHEN least(before, after) >= 100 THEN 0.35 ELSE 0.25 END::DOUBLE AS confidence FROM c LEFT JOIN b USING (query)""",
    "search_page_keys": "SELECT 'https://site.example/P' || (user_id % 50) AS page_key, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(coalesce(count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 0.0), 6) AS ctr, round(coalesce(sum(value) FILTER (WHERE event_type = 'view') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 0.0), 6) AS position FROM events GROUP BY 1",
    "findings_with_impressions": f"""WITH {sql.FINDINGS}, fu AS (SELECT finding_id, CASE WHEN regexp_matches(string_split(affected_resource, ' ')[1], '^https?://') THEN string_split(affected_resource, ' ')[1] END AS u FROM f),
m AS (SELECT page_id, page_id * 10 AS impressions, {_key("url")} AS page_key, {sql.path("url")} AS path FROM pages),
mk AS (SELECT page_key, arg_min(impressions, page_id) AS by_key FROM m GROUP BY 1), ml AS (SELECT path, arg_min(impressions, page_id) AS by_path FROM m GROUP BY 1),
j AS (SELECT finding_id, coalesce(by_key, by_path) AS impressions FROM fu LEFT JOIN mk ON mk.page_key = {_key("u")} LEFT JOIN ml ON ml.path = {sql.path("u")})
SELECT finding_id, impressions, round(CASE WHEN impressions <= 0 THEN 0.0 ELSE least(1.0, ln(1.0 + impressions) / ln(1.0 + {float(findings.IMPRESSIONS_CAP)})) END, 9) AS reach FROM j""",
    "stream_daily_counts": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}
