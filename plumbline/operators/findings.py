"""Findings: hits joined with their rules, with stable ids, evidence, priorities, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rules

# Fixed values of scores and priorities.
DEDUCTION = {"low": 2, "medium": 5, "high": 10, "critical": 18}
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
IMPACT = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
CONFIDENCE = {"low": 0.34, "medium": 0.67, "high": 1.0}
ACTIONABILITY = {"recommend_only": 0.6, "code_change": 1.0, "code_or_platform_change": 1.0}
RISK = {"recommend_only": 0.15, "code_change": 0.6, "code_or_platform_change": 0.6}
DEFAULT_ACTIONABILITY, DEFAULT_RISK = 0.5, 0.4
REACH_CAP, IMPRESSIONS_CAP = 50, 1_000_000
SCORES = [("technical_seo", "technical_seo"), ("content_aeo", "content_seo"), ("content_aeo", "aeo"), ("ai_geo", "geo")]
ACTIONABLE = ("OPEN", "REJECTED", "ROLLED_BACK")


def mapped(values: dict, key: Column, default: object = None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def finding_id(rule: Column, resource: Column) -> Column:
    return F.concat(rule, F.lit(":"), F.substring(F.sha1(F.concat(rule, F.lit("\n"), resource).cast("binary")), 1, 16))


def affected_url(resource: Column) -> Column:
    """The first word of a resource, if it is a URL."""
    first = F.split(resource, " ")[0]
    return F.when(first.rlike("^https?://"), first)


def assemble(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """One finding for each hit whose rule is known (the newest version), with its evidence; the catalog has a bounded number of rules."""
    meta = rules.latest_versions(catalog).select("rule_id", F.col("version").alias("rule_version"), "category", "severity", "confidence", "actionability")
    joined = hits.join(F.broadcast(meta), "rule_id")  # one row for each rule
    excerpt = F.concat_ws(" ", F.lit("observed"), F.coalesce("observed_value", F.lit("nothing")), F.lit("where"), "expected_condition", F.lit("was expected"))
    return joined.select(
        finding_id(F.col("rule_id"), F.col("affected_resource")).alias("finding_id"),
        F.col("rule_id").alias("rule"),
        "rule_version",
        "category",
        "severity",
        "confidence",
        "affected_resource",
        affected_url(F.col("affected_resource")).alias("affected_url"),
        "actionability",
        F.lit("OPEN").alias("status"),
        F.lit(None).cast("long").alias("impressions"),
        F.array(F.struct(F.lit("measurement").alias("source"), excerpt.alias("excerpt"), F.col("observed_value").alias("value"), F.lit("direct").alias("confidence"))).alias("evidence"),
    )


def with_evidence(findings: DataFrame) -> DataFrame:
    """Refuse findings without evidence."""
    return findings.filter(F.assert_true(F.size("evidence") > 0, "a finding has no evidence").isNull())


def reach_of_count(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(n, F.lit(1))) / F.log1p(F.lit(float(REACH_CAP))))


def reach_of_impressions(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.log1p(n) / F.log1p(F.lit(float(IMPRESSIONS_CAP)))))


def prioritized(findings: DataFrame, reach_scope: str = "run", condition: Column | None = None) -> DataFrame:
    """Factors and priority of each finding. Reach counts a rule's findings in the whole run, or (reach_scope='filtered') only those that meet the condition."""
    if condition is not None and reach_scope == "filtered":
        findings, condition = findings.filter(condition), None
    # counted by an aggregate that is joined back: a rule with most of the findings must not fill one task, as a window over it would
    counts = findings.groupBy("rule").agg(F.count("*").alias("affected_pages"))
    rows = findings.join(F.broadcast(counts), "rule")  # one row for each rule
    if condition is not None:
        rows = rows.filter(condition)
    rows = rows.withColumns(
        {
            "impact": mapped(IMPACT, F.col("severity")),
            "confidence_score": mapped(CONFIDENCE, F.col("confidence")),
            "reach": F.when(F.col("impressions").isNotNull(), reach_of_impressions(F.col("impressions"))).otherwise(reach_of_count(F.col("affected_pages"))),
            "reach_input": F.when(F.col("impressions").isNotNull(), F.lit("impressions")).otherwise(F.lit("affected_page_count")),
            "actionability_score": mapped(ACTIONABILITY, F.col("actionability"), DEFAULT_ACTIONABILITY),
            "risk": mapped(RISK, F.col("actionability"), DEFAULT_RISK),
        }
    )
    return rows.withColumn("priority", F.col("impact") * F.col("confidence_score") * F.col("reach") * F.col("actionability_score") / F.col("risk"))


def top_findings(ranked: DataFrame, n: int = 50) -> DataFrame:
    return ranked.orderBy(F.desc("priority"), "finding_id").limit(n)


def filtered(findings: DataFrame, category: str | None = None, severity: str | None = None, confidence: str | None = None, status: str | None = None, rule: str | None = None, url: str | None = None) -> DataFrame:
    """Equality on the given fields, and a case-insensitive part of the url."""
    for name, value in {"category": category, "severity": severity, "confidence": confidence, "status": status, "rule": rule}.items():
        if value is not None:
            findings = findings.filter(F.col(name) == value)
    if url is not None:
        findings = findings.filter(F.lower("affected_resource").contains(url.lower()))
    return findings


def signals(findings: DataFrame) -> DataFrame:
    """What each rule takes from each score: score_key, rule, severity, finding_count, deduction."""
    keys = findings.sparkSession.createDataFrame(SCORES, "score_key string, category string")
    by_rule = findings.join(F.broadcast(keys), "category").groupBy("score_key", "rule").agg(F.max(mapped(SEVERITY_RANK, F.col("severity"))).alias("rank"), F.count("*").alias("finding_count"))  # `keys` has four rows
    severity = mapped({v: k for k, v in SEVERITY_RANK.items()}, F.col("rank"))
    base = mapped(DEDUCTION, severity)
    return by_rule.select("score_key", "rule", severity.alias("severity"), "finding_count", F.bround(base * (1 + F.log1p((F.col("finding_count") - 1).cast("double"))), 0).cast("long").alias("deduction"))


def scores(findings: DataFrame) -> DataFrame:
    """score_key, value, max_value; a score without findings is 100."""
    keys = findings.sparkSession.createDataFrame(sorted({(k,) for k, _ in SCORES}), "score_key string")
    taken = signals(findings).groupBy("score_key").agg(F.sum("deduction").alias("taken"))
    return keys.join(taken, "score_key", "left").select("score_key", F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("taken", F.lit(0)))).cast("long").alias("value"), F.lit(100).cast("long").alias("max_value"))


def total_score(scored: DataFrame) -> DataFrame:
    return scored.agg(F.sum("value").alias("value"), F.sum("max_value").alias("max_value")).withColumn("percent", F.round(100 * F.col("value") / F.col("max_value"), 6))


def histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category", "severity").agg(F.count("*").alias("n"))


def evidence_by_rule(findings: DataFrame) -> DataFrame:
    """rule, finding_id, affected_resource, excerpt: one row for each piece of evidence."""
    return findings.select("rule", "finding_id", "affected_resource", F.explode("evidence").alias("e")).select("rule", "finding_id", "affected_resource", F.col("e.excerpt").alias("excerpt"))


def attach_impressions(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """Findings with the impressions of their page: by page key, else by path; metrics has page_key, path, impressions, position_in_input.

    metrics is first cut to one row for each key and one for each path (the first of the input), so the joins are 1:1.
    """
    from ..functions import urls

    exact = metrics.groupBy("page_key").agg(F.min_by("impressions", "position_in_input").alias("by_key"))
    loose = metrics.groupBy("path").agg(F.min_by("impressions", "position_in_input").alias("by_path"))
    rows = findings.drop("impressions").withColumn("page_key", urls.page_key(F.col("affected_url"))).withColumn("path", urls.path(F.col("affected_url")))
    joined = rows.join(exact, "page_key", "left").join(loose, "path", "left")
    return joined.withColumn("impressions", F.coalesce("by_key", "by_path")).drop("page_key", "path", "by_key", "by_path")


def upgraded_actionability(stored: Column, has_repository: Column, is_platform: Column) -> Column:
    """A recommendation becomes a change where there is something to change."""
    return F.when(stored != "recommend_only", stored).when(has_repository & is_platform, F.lit("code_or_platform_change")).when(has_repository, F.lit("code_change")).otherwise(F.coalesce(stored, F.lit("recommend_only")))


def selected(ranked: DataFrame, categories: tuple[str, ...], topic: tuple[str, ...] = (), n: int = 8) -> DataFrame:
    """The first n actionable findings of the categories; a topic narrows them unless nothing would be left."""
    rows = ranked.filter(F.col("status").isin(list(ACTIONABLE)) & F.col("category").isin(list(categories)))
    if topic:
        text = F.lower(F.concat_ws(" ", "rule", "affected_resource", "category"))
        hit = F.lit(False)
        for token in topic:
            hit = hit | text.contains(token.lower())
        some = rows.filter(hit).limit(1).agg((F.count("*") > 0).alias("narrow"))  # one row
        rows = rows.withColumn("_hit", hit).crossJoin(F.broadcast(some)).filter(~F.col("narrow") | F.col("_hit")).drop("_hit", "narrow")
    return rows.orderBy(F.desc("priority"), "finding_id").limit(n)


def completeness(findings: DataFrame) -> DataFrame:
    """finding_id and the fields that a complete finding must answer and this one does not."""
    needed = ["rule", "category", "severity", "confidence", "affected_resource", "actionability", "status"]
    missing = F.array_compact(F.array(*[F.when(rules.is_blank(F.col(c)), F.lit(c)) for c in needed], F.when(F.size("evidence") == 0, F.lit("evidence"))))
    return findings.select("finding_id", missing.alias("missing"))


def empty_findings(spark: SparkSession) -> DataFrame:
    none = spark.createDataFrame([], rules.HIT)
    return assemble(none, rules.rule_table(spark))


def newest_first(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(key))


def latest(rows: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """The row with the largest id of each group."""
    names = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*names), key).alias("r"))
    return picked.select(*by, "r.*")


def ranked_within(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
