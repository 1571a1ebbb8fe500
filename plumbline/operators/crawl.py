"""Crawl evidence: robots rules, sitemaps, llms.txt and a replay of the breadth-first crawl over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..session import materialized

# Fixed values of crawling.
AI_BOTS = "gptbot chatgpt-user google-extended ccbot anthropic-ai claudebot perplexitybot bytespider".split()
MAX_URLS, MAX_DEPTH, MAX_SITEMAP_URLS, MAX_CHILDREN = 200, 4, 500, 20
W3C_DATE = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2}))?)?)?$"


def robots_lines(robots: DataFrame) -> DataFrame:
    """origin, line, field, value for every line of robots files (origin, text) that says something."""
    rows = robots.select("origin", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("line", "raw"))
    plain = F.trim(F.regexp_replace("raw", "#.*$", ""))
    cut = rows.select("origin", "line", F.lower(F.trim(F.regexp_extract(plain, "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(plain, "^[^:]*:(.*)$", 1)).alias("value"), plain.contains(":").alias("said"))
    return cut.filter("said").drop("said")


def robots_groups(lines: DataFrame) -> DataFrame:
    """Agents and rules of each group: a user-agent line after a rule opens the next one."""
    w = Window.partitionBy("origin").orderBy("line")
    kept = lines.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    numbered = kept.withColumn("opens", opens).withColumn("grp", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # groups are as long as a robots file, whose size the crawler bounds
    agent = F.when((F.col("field") == "user-agent") & (F.col("value") != ""), F.struct("line", F.lower("value").alias("agent")))
    rule = F.when(F.col("field") != "user-agent", F.struct("line", F.col("field").alias("directive"), F.col("value").alias("path")))
    return numbered.filter("grp > 0").groupBy("origin", "grp").agg(F.array_sort(F.collect_list(agent)).alias("agents"), F.array_sort(F.collect_list(rule)).alias("rules"))


def rules_for(groups: DataFrame, agent: str) -> DataFrame:
    """origin, directive, path of the most specific groups for an agent."""
    name = agent.lower().split("/")[0].split(" ")[0]
    fit = lambda a: F.when(a["agent"] == "*", F.lit(0)).when(F.lit(name).startswith(a["agent"]), F.length(a["agent"])).otherwise(F.lit(-1))
    scored = groups.withColumn("fit", F.array_max(F.transform("agents", fit)))
    best = scored.groupBy("origin").agg(F.max("fit").alias("best"))
    chosen = scored.join(best, "origin").filter("fit = best and fit >= 0")
    return chosen.select("origin", F.explode("rules").alias("r")).select("origin", "r.directive", "r.path").filter("path <> ''")


def path_pattern(path: Column) -> Column:
    """A robots path as a pattern: only * is special, and it fits from the start."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(path, r"([.+?^$(){}|\\\[\]])", r"\\$1"), F.lit("*"), F.lit(".*")))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url) with `allowed`: the longest rule that fits decides, allow wins a tie, and no rule allows."""
    own = pages.withColumn("origin", urls.origin(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    listed = rules.groupBy("origin").agg(F.collect_list(F.struct(F.length("path").alias("n"), F.when(F.col("directive") == "allow", 1).otherwise(0).alias("yes"), path_pattern(F.col("path")).alias("pattern"))).alias("rules"))
    rows = own.join(listed, "origin", "left")
    fitting = F.filter(F.coalesce("rules", F.array().cast("array<struct<n:int,yes:int,pattern:string>>")), lambda r: F.regexp_like(F.col("path"), r["pattern"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["n"], r["yes"])))
    return rows.select(*pages.columns, (best.isNull() | (best["yes"] == 1)).alias("allowed"))


def ai_bots_shut_out(groups: DataFrame) -> DataFrame:
    """origin, bots: the known AI crawlers whose group disallows everything, in the order they are named."""
    shut = groups.filter(F.exists("rules", lambda r: (r["directive"] == "disallow") & (r["path"] == "/")))
    named = shut.select("origin", F.explode("agents").alias("a")).filter(F.col("a.agent").isin(AI_BOTS)).groupBy("origin", F.col("a.agent").alias("agent")).agg(F.min("a.line").alias("line"))
    return named.groupBy("origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "agent"))), lambda x: x["agent"]).alias("bots"))


def robots_state(status: Column) -> Column:
    return F.when(status == 404, "missing").when(status.between(200, 299), "fetched").otherwise("unavailable")


def sitemap_records(files: DataFrame) -> DataFrame:
    """One record for each sitemap file (url, origin, xml): state, kind, distinct same-site urls, duplicates, lastmods that are no dates."""
    xml = F.coalesce("xml", F.lit(""))
    kind = F.when(F.col("xml").rlike(r"(?is)<(?:\w+:)?urlset[\s>]"), "urlset").when(F.col("xml").rlike(r"(?is)<(?:\w+:)?sitemapindex[\s>]"), "index").otherwise("unknown")
    closed = F.col("xml").rlike(r"(?is)</(?:\w+:)?(?:urlset|sitemapindex)>\s*$")
    state = F.when(F.trim(xml) == "", "unavailable").when((kind != "unknown") & closed, "valid").when(kind != "unknown", "invalid").when(F.col("xml").rlike(r"(?s)^\s*<"), "not_xml").otherwise("invalid")
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1)), lambda u: urls.aligned(urls.normalized(F.replace(u, F.lit("&amp;"), F.lit("&"))), F.col("origin")))
    mods = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?lastmod>\s*(.*?)\s*</(?:\w+:)?lastmod>"), F.lit(1))
    rows = files.select("url", "origin", state.alias("parse_state"), kind.alias("kind"), F.array_compact(locs).alias("locs"), mods.alias("mods"))
    good = F.col("parse_state") == "valid"
    none = F.array().cast("array<string>")
    distinct = F.array_distinct("locs")
    return rows.select(
        "url",
        "parse_state",
        F.when(good, F.col("kind")).otherwise("unknown").alias("kind"),
        F.when(good & (F.col("kind") == "urlset"), F.slice(distinct, 1, MAX_SITEMAP_URLS)).otherwise(none).alias("page_urls"),
        F.when(good & (F.col("kind") == "index"), F.slice(distinct, 1, MAX_CHILDREN)).otherwise(none).alias("child_sitemaps"),
        F.when(good, F.size("locs") - F.size(distinct)).otherwise(0).alias("duplicate_loc_count"),
        F.when(good, F.size(F.filter("mods", lambda m: ~m.rlike(W3C_DATE)))).otherwise(0).alias("invalid_lastmod_count"),
        F.when(good, F.size("mods")).otherwise(0).alias("lastmod_present_count"),
    )


def llms_text_state(status: Column, text: Column) -> Column:
    return F.when(status == 404, "missing").when(~status.between(200, 299), "unavailable").when(text.rlike(r"(?m)^\s*#\s+\S"), "present").otherwise("malformed")


def sample_outcome(status: Column, redirects: Column) -> Column:
    return F.when(status.isNull(), "unavailable").when(~status.between(200, 299), "non_200").when(redirects > 0, "redirected").otherwise("ok")


def is_html(content_type: Column, head: Column) -> Column:
    """By the declared type, or by the first characters where none is declared."""
    return F.when(F.coalesce(content_type, F.lit("")) != "", content_type.rlike("(?i)text/html|application/xhtml")).otherwise(F.coalesce(head, F.lit("")).rlike(r"(?is)^\s*(<!doctype html|<html)"))


def bfs(links: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """url, depth: what a crawl from seeds (url) over links (source, target) visits, and how deep; blocked urls are not entered.

    One join for each level, whose result is written to the shared folder; visited urls are excluded by an anti join, so cycles end.
    """
    links = materialized(links.select("source", "target"), "links")
    edges = links if blocked is None else links.join(blocked.select(F.col("url").alias("target")).distinct(), "target", "left_anti")
    found = frontier = materialized(seeds.select("url", F.lit(0).alias("depth")).distinct(), "frontier")
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct()
        frontier = step.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialized(frontier, "frontier")
        found = found.union(frontier)
    return found


def ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `place`, their number in the order of some columns, from 0; no task sees more than its share.

    Rows are dealt out in ranges of the order and numbered in each; the counts of the ranges (one row for each) tell
    how many come before.
    """
    # no column of rows is named so
    dealt = materialized(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1)
    return numbered.join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("nth")).drop("range", "before", "nth")


def bounded(links: DataFrame, seeds: DataFrame, failed: DataFrame, refused: DataFrame, max_urls: int = MAX_URLS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """A crawl under a budget, replayed: url, depth, outcome and, for pages, their number.

    links (source, target, nth: the target's number on its page) and seeds (url, nth) are queued in the order in which
    a crawler that works through its queue meets them, each url once. A url deeper than max_depth is skipped, one in
    refused (by robots rules) is not fetched, one in failed could not be; what is left is a page, whose links are queued.
    Once there are max_urls pages the rest of the queue stays. Outcomes: page, failed, robots_disallow, max_depth, url_cap.
    One level of depth at a time: its urls are numbered in their order over all tasks, so exactly the first pages enter.
    """
    links = materialized(links.select("source", "target", "nth").filter("source is not null and target is not null"), "links")
    told = failed.select("url", F.lit("failed").alias("told")).union(refused.select("url", F.lit("robots_disallow").alias("told")))
    told = materialized(told.groupBy("url").agg(F.max("told").alias("told")), "told")  # refused ones are not fetched
    queue = seeds.filter("url is not null").groupBy("url").agg(F.min("nth").alias("by"), F.lit(0).cast("long").alias("nth"))
    seen, pages, capped = None, 0, False
    for depth in range(max_depth + 2):
        level = ordered(queue.join(told, "url", "left"), ["by", "nth", "url"])
        if depth > max_depth:
            # all of these are beyond the depth, and none takes of the budget
            level = level.select("url", F.lit(depth).alias("depth"), F.lit("url_cap" if capped else "max_depth").alias("outcome"), F.lit(None).cast("long").alias("page"))
        else:
            # a url is taken from the queue while there are fewer pages than the budget
            fetched = ordered(level.filter("told is null").select("url", F.col("place").alias("at")), ["at"]).select("url", "place")
            last = fetched.join(level.select("url", F.col("place").alias("at")), "url").filter(F.col("place") == max_urls - pages - 1).select("at").first()
            end = -1 if pages >= max_urls else last["at"] if last else None
            within = F.lit(True) if end is None else F.col("place") <= end
            own = level.join(fetched.select("url", F.col("place").alias("page")), "url", "left").withColumn("outcome", F.when(~within, "url_cap").otherwise(F.coalesce("told", F.lit("page"))))
            level = own.select("url", F.lit(depth).alias("depth"), "outcome", F.when(F.col("outcome") == "page", F.col("page") + pages).alias("page"))
        level = materialized(level, "level")
        seen = level if seen is None else seen.union(level)
        entered = level.filter("outcome = 'page'")
        pages += entered.count()
        capped = capped or not level.filter("outcome = 'url_cap'").isEmpty() or pages >= max_urls
        queue = links.join(entered.select(F.col("url").alias("source"), F.col("page").alias("by")), "source").select(F.col("target").alias("url"), "by", "nth").join(seen.select("url"), "url", "left_anti")
        queue = materialized(queue.groupBy("url").agg(F.min(F.struct("by", "nth")).alias("first")).select("url", "first.by", F.col("first.nth").cast("long").alias("nth")), "queue")
        if queue.isEmpty():
            break
    return seen


def rendered(pages: DataFrame, renders: DataFrame) -> DataFrame:
    """Pages with a rendered extraction in place of the raw one where it changed; crawl columns stay. renders has url and rendered_* columns."""
    names = [c.removeprefix("rendered_") for c in renders.columns if c.startswith("rendered_") and c.removeprefix("rendered_") in pages.columns]
    joined = pages.join(renders, "url", "left")
    changed = F.col("changed") & F.col("changed").isNotNull()
    return joined.select(*[F.when(changed, F.coalesce(F.col(f"rendered_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in pages.columns])
