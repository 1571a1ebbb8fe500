"""Search analytics: facts, totals, period comparisons, movement, keyword opportunities and metric snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from .findings import ranked_within

# Fixed values of search analytics.
PERIODS = [("day", 1), ("week", 7), ("four_weeks", 28), ("month", 30)]
POSITION_FROM, CTR_BELOW = 8.0, 0.02
TOP_QUERIES = 5
METRICS = "ctr impressions clicks position crawlability technical_errors answer_retrieval_benchmark entity_recognition_benchmark citation_retrieval_benchmark structured_data_validity page_performance".split()
UNMEASURED = {m: f"{m.split('_benchmark')[0].replace('_', ' ')} benchmark is not measured in this phase" for m in METRICS if m.endswith("_benchmark")}


def totals(*more: Column) -> list[Column]:
    """Aggregates over facts: impressions, clicks, click rate, impression-weighted position; zero where nothing was shown."""
    shown = F.sum("impressions")
    return [
        F.coalesce(shown, F.lit(0)).alias("impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.coalesce(F.try_divide(F.sum("clicks"), shown), F.lit(0.0)).alias("ctr"),
        F.coalesce(F.try_divide(F.sum(F.col("position") * F.col("impressions")), shown), F.lit(0.0)).alias("position"),
        *more,
    ]


def facts_from_events(events: DataFrame) -> DataFrame:
    """Daily facts by page and query: day, page, query, impressions, clicks, position (views, clicks, mean value)."""
    rows = events.select(F.col("ts").cast("date").alias("day"), F.col("user_id").cast("string").alias("page"), F.get_json_object("props", "$.k").alias("query"), "event_type", "value")
    return rows.groupBy("day", "page", "query").agg(F.count_if(F.col("event_type") == "view").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.avg("value").alias("position"))


def dimensions(facts: DataFrame) -> DataFrame:
    """One long table of facts by date, page, query and page with query, told apart by `dimension`."""
    def one(name: str, keys: list[str]) -> DataFrame:
        rows = facts.groupBy(*keys).agg(*totals())
        return rows.select(F.lit(name).alias("dimension"), *[(F.col(k) if k in keys else F.lit(None)).cast("string").alias(k) for k in ("day", "page", "query")], "impressions", "clicks", "ctr", "position")

    return reduce(DataFrame.unionByName, [one("date", ["day"]), one("page", ["page"]), one("query", ["query"]), one("page_query", ["page", "query"])])


def daily_series(rows: DataFrame) -> DataFrame:
    """The last written row (largest id) of each day: day, impressions, clicks, position, id."""
    return rows.groupBy("day").agg(F.max_by(F.struct("impressions", "clicks", "position"), "id").alias("r"), F.max("id").alias("id")).select("day", "r.*", "id")


def period_comparisons(daily: DataFrame) -> DataFrame:
    """For each length the last so many rows against as many before them; unavailable with too little history.

    daily has one row for each day of one property, so numbering all of it in order is bounded by the calendar.
    """
    spark = daily.sparkSession
    lengths = spark.createDataFrame(PERIODS, "period string, length int")
    newest = daily.withColumn("n", F.row_number().over(Window.orderBy(F.desc("day"))))
    have = newest.agg(F.count("*").alias("have"))
    spans = newest.join(F.broadcast(lengths), F.col("n") <= 2 * F.col("length"))  # four lengths
    half = F.when(F.col("n") <= F.col("length"), "current").otherwise("previous")
    sums = spans.withColumn("half", half).groupBy("period", "length").pivot("half", ["current", "previous"]).agg(*totals(), F.min("day").alias("start"), F.max("day").alias("end"))
    joined = lengths.crossJoin(F.broadcast(have)).join(sums.drop("length"), "period", "left")  # `have` is one row
    seen = F.col("have") >= 2 * F.col("length")
    out = [F.when(seen, F.lit("observed")).otherwise(F.lit("unavailable")).alias("status"), F.when(~seen, F.concat(F.lit("need "), (2 * F.col("length")).cast("string"), F.lit(" daily rows, have "), F.col("have").cast("string"))).alias("detail")]
    out += [F.when(seen, F.col(f"{h}_{e}").cast("string")).alias(f"{h}_{e}") for h in ("current", "previous") for e in ("start", "end")]
    out += [F.when(seen, F.col(f"current_{m}")).alias(f"current_{m}") for m in ("impressions", "clicks", "ctr", "position")]
    out += [F.when(seen, F.col(f"current_{m}") - F.col(f"previous_{m}")).alias(f"delta_{m}") for m in ("impressions", "clicks", "ctr", "position")]
    return joined.select("period", "length", *out)


def movement(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """current with its differences to previous: unknown without any previous row, new without one of the key, else by impressions."""
    any_row = previous.limit(1).agg((F.count("*") > 0).alias("any_previous"))  # one row
    before = previous.select(key, *[F.col(m).alias(f"before_{m}") for m in ("impressions", "clicks", "ctr", "position")])
    rows = current.join(before, key, "left").crossJoin(F.broadcast(any_row))
    change = F.col("impressions") - F.col("before_impressions")
    kind = F.when(~F.col("any_previous"), "unknown").when(F.col("before_impressions").isNull(), "new").when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return rows.select(*current.columns, kind.alias("movement"), *[(F.col(m) - F.col(f"before_{m}")).alias(f"delta_{m}") for m in ("impressions", "clicks", "ctr", "position")])


def movement_tone(metric: str, delta: Column) -> Column:
    """Whether a change is good: a lower position is better, more of the others is."""
    better = -delta if metric == "position" else delta
    return F.when(delta.isNull() | (delta == 0), "flat").when(better > 0, "up").otherwise("down")


def top_queries_per_page(rows: DataFrame, n: int = TOP_QUERIES) -> DataFrame:
    """The n queries with most impressions of each page."""
    return ranked_within(rows, "page", [F.desc("impressions"), F.asc("query")], n)


def matched_filters(position: Column, ctr: Column) -> Column:
    return F.array_compact(F.array(F.when(position >= POSITION_FROM, F.lit("position")), F.when(ctr < CTR_BELOW, F.lit("ctr"))))


def reason(impressions: Column, position: Column, ctr: Column) -> Column:
    return F.concat(F.format_number(impressions, 0), F.lit(" impressions, position "), F.format_string("%.1f", position), F.lit(", CTR "), F.format_string("%.1f", ctr * 100), F.lit("%"))


def keyword_opportunities(rows: DataFrame) -> DataFrame:
    """Queries seen low on the page or seldom clicked: rows has id, query, impressions, clicks, ctr, position."""
    asked = F.trim(F.coalesce("query", F.lit("")))
    found = matched_filters(F.col("position"), F.col("ctr"))
    kept = rows.filter((asked != "") & (F.size(found) > 0))
    return kept.select("id", asked.alias("query"), "impressions", "clicks", "ctr", "position", found.alias("filters"), reason(F.col("impressions"), F.col("position"), F.col("ctr")).alias("reason"))


def top_rows(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("impressions"), F.desc("id")).limit(n)


def crawl_metrics(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """crawlability and technical_errors of a crawl: pages has status_code, failed has url; one row each is joined."""
    a = pages.agg(F.count("*").alias("fetched"), F.count_if(F.col("status_code") >= 400).alias("bad"))
    b = failed.agg(F.count("*").alias("failed"))
    return a.crossJoin(b).select(F.coalesce(F.try_divide(F.col("fetched"), F.col("fetched") + F.col("failed")), F.lit(0.0)).alias("crawlability"), (F.col("failed") + F.col("bad")).alias("technical_errors"))


def structured_data_validity(pages: DataFrame) -> DataFrame:
    blocks = pages.select(F.explode("structured_data").alias("b"))
    return blocks.agg(F.try_divide(F.count_if(F.col("b.parse_error").isNull()), F.count("*")).alias("structured_data_validity"))


def snapshot(spark: SparkSession, measured: DataFrame) -> DataFrame:
    """All metrics as (key, status, value, detail); measured has (key, value), and what it lacks is unavailable."""
    keys = spark.createDataFrame([(k, UNMEASURED.get(k, "not measured")) for k in METRICS], "key string, detail string")
    rows = keys.join(measured, "key", "left")
    known = F.col("value").isNotNull()
    return rows.select("key", F.when(known, "measured").otherwise("unavailable").alias("status"), "value", F.when(~known, F.col("detail")).alias("detail"))


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, status, before, after, delta, detail; what is unavailable on either side stays so."""
    b, a = before.select("key", F.col("status").alias("s1"), F.col("value").alias("before"), F.col("detail").alias("d1")), after.select("key", F.col("status").alias("s2"), F.col("value").alias("after"), F.col("detail").alias("d2"))
    rows = b.join(a, "key", "full_outer")
    gone = (F.coalesce("s1", F.lit("unavailable")) == "unavailable") | (F.coalesce("s2", F.lit("unavailable")) == "unavailable")
    return rows.select("key", F.when(gone, "unavailable").otherwise("observed").alias("status"), "before", "after", F.when(~gone, F.col("after") - F.col("before")).alias("delta"), F.when(gone, F.coalesce("d1", "d2", F.lit("missing snapshot"))).alias("detail"))


def page_keys(rows: DataFrame) -> DataFrame:
    """Facts by page key: spellings of one page are added up."""
    return rows.groupBy(urls.page_key(F.col("page")).alias("page_key")).agg(*totals())


def latest_run(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("analysis_run_id").alias("analysis_run_id"))


def previous_run(rows: DataFrame, current: int) -> DataFrame:
    """The largest other run, which may be a later one."""
    return rows.filter((F.col("analysis_run_id") != current) & (F.col("dimension") == "query")).agg(F.max("analysis_run_id").alias("analysis_run_id"))


def replace_runs(rows: DataFrame, path: str) -> None:
    """Write facts by run: runs that are written again are replaced, others stay."""
    rows.write.partitionBy("analysis_run_id", "dimension").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def result_confidence(before: Column, after: Column) -> Column:
    """How much a comparison says, by the smaller number of impressions; null where not measured."""
    least = F.least(before, after)
    return F.when(before.isNull() | after.isNull(), F.lit(0.2)).when(least >= 10_000, F.lit(0.7)).when(least >= 1_000, F.lit(0.5)).when(least >= 100, F.lit(0.35)).otherwise(F.lit(0.25))
