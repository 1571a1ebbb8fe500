import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import pages
from plumbline.operators import findings, rules


def page(body="", head="", url="https://e.com/a"):
    return (url, f"<html lang='x'><head>{head}</head><body>{body}</body></html>")


def model(spark, *rows):
    return pages.page_model(spark.createDataFrame(list(rows), "url string, html string"))


def hits_of(df, rule):
    return sorted(r["affected_resource"] for r in df.filter(F.col("rule_id") == rule).collect())


@pytest.mark.parametrize(
    "operator, kind, value, expected, result",
    [
        ("is_null", T.StringType(), " ", None, True),
        ("not_null", T.StringType(), "a", None, True),
        ("equals", T.StringType(), None, "a", False),
        ("not_equals", T.StringType(), None, "a", True),
        ("lt", T.StringType(), "x", 5, None),
        ("gte", T.IntegerType(), 5, 5, True),
        ("length_gt", T.StringType(), "abcd", 3, True),
        ("length_gt", T.StringType(), None, 3, None),
        ("count_gt", T.ArrayType(T.StringType()), ["a", "b"], 1, True),
        ("count_eq", T.ArrayType(T.StringType()), ["a"], 2, False),
        ("contains", T.ArrayType(T.StringType()), ["a"], "a", True),
        ("contains", T.StringType(), "xay", "a", True),
        ("not_contains", T.MapType(T.StringType(), T.StringType()), {"k": "v"}, "k", False),
        ("regex_match", T.StringType(), "abc1", "[0-9]$", True),
        ("in", T.StringType(), None, ["a"], False),
        ("not_in", T.StringType(), "b", ["a"], True),
    ],
)
def test_predicates(spark, operator, kind, value, expected, result):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    assert df.select(rules.predicate(operator, F.col("v"), kind, expected).alias("x")).first()["x"] is result


def test_unknown_operator():
    with pytest.raises(ValueError):
        rules.predicate("near", F, T.StringType())


def test_page_rules(spark):
    body = "<h1>a</h1><h1>b</h1><h4>c</h4><img src='no'><img src=\"/i.png\"><img src=\"/i.png\"><img src=\"/1.gif\" width=\"1\" height=\"1\"><script type=\"application/ld+json\">{bad</script>"
    head = '<meta property="og:title" content="t"><meta property="og:image:url" content="i"><link rel="canonical" href="https://other.org/">'
    found = rules.evaluate(model(spark, page(body, head)))
    assert hits_of(found, "SEO-H1-MULTIPLE-001") == ["https://e.com/a"]
    assert hits_of(found, "SEO-HEADING-SKIP-001") == ["https://e.com/a"]
    assert hits_of(found, "SEO-IMAGE-ALT-001") == ["https://e.com/a img:https://e.com/i.png", "https://e.com/a img:https://e.com/no"]
    assert hits_of(found, "SEO-STRUCTUREDDATA-INVALID-001") == ["https://e.com/a structured_data[0]"]
    assert hits_of(found, "SEO-CANONICAL-CROSSDOMAIN-001") == ["https://e.com/a"]
    og = found.filter("rule_id = 'SEO-OG-INCOMPLETE-001'").first()
    assert og["observed_value"] == "type,url"
    assert hits_of(found, "SEO-CANONICAL-001") == []


def test_site_rules(spark):
    rows = [
        page('<a href="/b">x</a><a href="/gone">y</a>', "<title>Same</title>", "https://e.com/"),
        page("", "<title> sAME </title>", "https://e.com/b"),
        page("", "<title>Other</title>", "https://e.com/c"),
    ]
    failed = spark.createDataFrame([("https://e.com/gone",)], "url string")
    found = rules.evaluate(model(spark, *rows), failed)
    assert hits_of(found, "SEO-TITLE-DUPLICATE-001") == ["https://e.com/", "https://e.com/b"]
    assert hits_of(found, "SEO-ORPHAN-PAGE-001") == ["https://e.com/c"]
    assert hits_of(found, "SEO-BROKEN-INTERNAL-LINK-001") == ["https://e.com/ -> https://e.com/gone"]


def test_hreflang_and_duplicates(spark):
    link = lambda to: f'<link rel="alternate" hreflang="x" href="{to}">'
    rows = [page("", link("/b"), "https://e.com/a"), page("", link("/a"), "https://e.com/b"), page("same", "", "https://e.com/d"), page("same", "", "https://e.com/e"), page("", link("/d"), "https://e.com/c")]
    found = rules.evaluate(model(spark, *rows))
    assert hits_of(found, "SEO-HREFLANG-NOT-RECIPROCAL-001") == ["https://e.com/c hreflang:https://e.com/d"]
    assert hits_of(found, "SEO-CONTENT-DUPLICATE-001") == ["https://e.com/d", "https://e.com/e"]


def test_crawl_rules(spark):
    crawl = spark.createDataFrame([("run1", ("unavailable", ["gptbot"]), [("s.xml", "invalid"), ("t.xml", "valid")])], "run_url string, robots struct<state:string,ai_bot_disallows:array<string>>, sitemaps array<struct<url:string,parse_state:string>>")
    found = rules.crawl_hits(crawl, rules.CATALOG)
    assert hits_of(found, "SEO-ROBOTS-UNAVAILABLE-001") == ["run1"] and hits_of(found, "GEO-AI-CRAWLER-ACCESS-001") == ["run1"] and hits_of(found, "SEO-SITEMAP-INVALID-001") == ["s.xml"]


def made(spark, *rows):
    return spark.createDataFrame([(f"id{i}", *r) for i, r in enumerate(rows)], "finding_id string, rule string, category string, severity string, confidence string, actionability string, impressions long")


@pytest.mark.parametrize("severity, taken", [("low", 2), ("medium", 5), ("high", 10), ("critical", 18)])
def test_one_finding_takes_its_severity(spark, severity, taken):
    got = {r["score_key"]: r["value"] for r in findings.scores(made(spark, ("R", "technical_seo", severity, "high", "code_change", None))).collect()}
    assert got == {"technical_seo": 100 - taken, "content_aeo": 100, "ai_geo": 100}


def test_scores_without_findings_and_breadth(spark):
    assert {r["value"] for r in findings.scores(findings.empty_findings(spark)).collect()} == {100}
    many = made(spark, *[("R", "geo", "medium", "low", "recommend_only", None)] * 10)
    assert findings.signals(many).first()["deduction"] == round(5 * (1 + math.log1p(9)))


def test_priorities(spark):
    rows = made(spark, ("A", "geo", "high", "high", "code_change", 1000), ("B", "geo", "low", "low", "odd", None), ("B", "geo", "low", "low", "odd", 0))
    got = {r["finding_id"]: r["priority"] for r in findings.prioritized(rows).collect()}
    assert got["id0"] == pytest.approx(0.75 * math.log1p(1000) / math.log1p(1_000_000) / 0.6)
    assert got["id1"] == pytest.approx(0.25 * 0.34 * math.log1p(2) / math.log1p(50) * 0.5 / 0.4)
    assert got["id2"] == 0.0


def test_catalog_merge_and_versions(spark):
    catalog = rules.rule_table(spark)
    stored = catalog.filter("rule_id = 'SEO-TITLE-MISSING-001'").withColumn("severity", F.lit("low")).withColumn("version", F.lit(2))
    got = {r["rule_id"]: (r["version"], r["severity"]) for r in rules.merged_catalog(stored, catalog).collect()}
    assert got["SEO-TITLE-MISSING-001"] == (2, "low") and len(got) == len(rules.CATALOG) == 43
