"""Audit rules as data, evaluated over page records in one pass.

A rule is either generic (field, operator, value; see predicate()) or a named check. Page checks give an array of hits
for each page; all of them are evaluated in a single projection and exploded once. Checks that look beyond a page
(duplicates, broken links, orphans, hreflang) are joins or groupings of their own.

Predicates have three values: a hit, no hit, and inapplicable (the value is missing). What could not be judged is
reported as a skip with its reason, never guessed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import urls
from .text import with_missing_keywords

HIT = "rule_id string, affected_resource string, observed_value string, expected_condition string"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    confidence: str
    scope: str
    expected: str
    field: str | None = None
    operator: str | None = None
    value: object = None
    check: str | None = None
    actionability: str = "recommend_only"
    version: int = 1


# The rule catalog with its thresholds.
CATALOG = [
    Rule("SEO-BROKEN-INTERNAL-LINK-001", "technical_seo", "medium", "high", "website", "internal links resolve", check="broken_internal_link"),
    Rule("SEO-CANONICAL-001", "technical_seo", "medium", "high", "page", "canonical is present", "canonical", "is_null"),
    Rule("SEO-CANONICAL-CROSSDOMAIN-001", "technical_seo", "medium", "medium", "page", "canonical stays on the page's domain", check="canonical_cross_domain"),
    Rule("SEO-CONTENT-DUPLICATE-001", "content_seo", "medium", "high", "website", "no other page has the same html", check="exact_duplicate_content"),
    Rule("SEO-CONTENT-INTENT-001", "content_seo", "medium", "low", "page", "content answers the intent", check="content_intent_alignment"),
    Rule("SEO-CONTENT-THIN-001", "content_seo", "medium", "medium", "page", "at least 250 words", "word_count", "lt", 250),
    Rule("SEO-H1-MISSING-001", "technical_seo", "low", "medium", "page", "one h1", check="h1_missing"),
    Rule("SEO-H1-MULTIPLE-001", "technical_seo", "low", "low", "page", "one h1", check="h1_multiple"),
    Rule("SEO-HEADING-SKIP-001", "technical_seo", "low", "high", "page", "heading levels go down by one", check="heading_level_skip"),
    Rule("SEO-HREFLANG-NOT-RECIPROCAL-001", "technical_seo", "medium", "medium", "website", "alternates link back", check="hreflang_not_reciprocal"),
    Rule("SEO-IMAGE-ALT-001", "technical_seo", "medium", "high", "page", "images have an alt text", check="image_missing_alt"),
    Rule("SEO-IMAGE-DIMENSIONS-001", "technical_seo", "low", "high", "page", "images have a width and a height", check="image_missing_dimensions"),
    Rule("SEO-KEYWORD-FOCUS-001", "content_seo", "low", "low", "page", "dominant terms are in title or description", check="keyword_focus"),
    Rule("SEO-LANG-MISSING-001", "technical_seo", "low", "high", "page", "language is present", "language", "is_null"),
    Rule("SEO-METADESC-DUPLICATE-001", "technical_seo", "low", "medium", "crawl_run", "descriptions differ", check="meta_description_duplicate_across_pages"),
    Rule("SEO-METADESC-LENGTH-001", "technical_seo", "low", "medium", "page", "at most 160 characters", "meta_description", "length_gt", 160),
    Rule("SEO-METADESC-MISSING-001", "technical_seo", "low", "medium", "page", "meta_description is present", "meta_description", "is_null"),
    Rule("SEO-NOINDEX-UNEXPECTED-001", "technical_seo", "critical", "high", "page", "sitemap pages may be indexed", check="noindex_on_sitemap_page"),
    Rule("SEO-OG-INCOMPLETE-001", "technical_seo", "low", "high", "page", "open graph has title, type, image and url", check="open_graph_incomplete"),
    Rule("SEO-ORPHAN-PAGE-001", "technical_seo", "medium", "high", "website", "another page links here", check="orphan_page"),
    Rule("SEO-REDIRECT-CHAIN-001", "technical_seo", "low", "high", "page", "at most one redirect", "redirect_chain", "count_gt", 1),
    Rule("SEO-ROBOTS-UNAVAILABLE-001", "technical_seo", "low", "high", "crawl_run", "robots.txt is readable", "robots.state", "equals", "unavailable"),
    Rule("SEO-SITEMAP-COVERAGE-GAP-001", "technical_seo", "low", "medium", "page", "page is in the sitemap", "sitemap_member", "equals", False),
    Rule("SEO-SITEMAP-INVALID-001", "technical_seo", "medium", "high", "crawl_run", "sitemaps are valid", check="sitemap_invalid"),
    Rule("SEO-STRUCTUREDDATA-INVALID-001", "technical_seo", "medium", "high", "page", "structured data can be read", check="structured_data_parse_error"),
    Rule("SEO-STRUCTUREDDATA-MISSING-001", "technical_seo", "low", "low", "page", "structured data is present", check="structured_data_absent"),
    Rule("SEO-TITLE-DUPLICATE-001", "technical_seo", "medium", "high", "crawl_run", "titles differ", check="title_duplicate_across_pages"),
    Rule("SEO-TITLE-LENGTH-001", "technical_seo", "low", "medium", "page", "at most 60 characters", "title", "length_gt", 60),
    Rule("SEO-TITLE-MISSING-001", "technical_seo", "high", "high", "page", "title is present", "title", "is_null"),
    Rule("SEO-URL-COMPLEXITY-001", "technical_seo", "low", "low", "page", "at most 3 parameters and 6 segments", check="url_structure_complex"),
    Rule("SEO-VIEWPORT-MISSING-001", "technical_seo", "medium", "high", "page", "viewport is present", "viewport", "is_null"),
    Rule("AEO-ANSWER-LEAD-001", "aeo", "low", "low", "page", "answers have 20 to 160 words", check="answer_lead_missing_or_verbose"),
    Rule("AEO-AUTHORSHIP-DATE-001", "aeo", "low", "medium", "page", "articles name author or date", check="authorship_date_markup_missing"),
    Rule("AEO-FAQ-SCHEMA-001", "aeo", "low", "low", "page", "answered questions have FAQ markup", check="faq_schema_absent_with_faq_content"),
    Rule("AEO-QUESTION-HEADING-001", "aeo", "low", "medium", "page", "a heading asks a question", check="no_question_headings"),
    Rule("GEO-AI-CRAWLER-ACCESS-001", "geo", "medium", "high", "crawl_run", "no AI crawler is shut out", "robots.ai_bot_disallows", "count_gt", 0),
    Rule("GEO-ENTITY-CLARITY-001", "geo", "low", "low", "page", "entities are marked up", check="entity_markup_absent"),
    Rule("GEO-SOURCE-ATTRIBUTION-001", "geo", "low", "low", "page", "long pages cite others", check="no_external_references"),
    Rule("GEO-STRUCTURED-DENSITY-001", "geo", "low", "low", "page", "long pages have structured data", check="structured_data_density_low"),
    Rule("AGENT-TOOL-ANNOTATION-001", "agent_accessibility", "low", "high", "page", "tools have annotations", check="agent_tool_annotation_missing"),
    Rule("AGENT-TOOL-DESCRIPTION-001", "agent_accessibility", "medium", "high", "page", "tools have a description", check="agent_tool_description_missing"),
    Rule("AGENT-TOOL-INPUT-SCHEMA-001", "agent_accessibility", "medium", "high", "page", "tools have an input schema", check="agent_tool_input_schema_missing"),
    Rule("AGENT-TOOLS-DISCOVERED-001", "agent_accessibility", "low", "high", "page", "tools are offered to agents", check="agent_tools_discovered"),
]
BY_ID = {r.rule_id: r for r in CATALOG}
OG_REQUIRED = ("title", "type", "image", "url")
OG_IMAGES = ("image:url", "image:secure_url")
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting")
FAQ_TYPES = ("FAQPage", "QAPage")
ENTITY_TYPES = ("Organization", "Person", "LocalBusiness")
OPERATORS = "is_null not_null equals not_equals gt gte lt lte length_gt length_lt count_gt count_eq count_lt contains not_contains regex_match in not_in".split()


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def predicate(operator: str, actual: Column, kind: T.DataType, expected: object = None) -> Column:
    """Whether a value meets a condition: true, false, or null where the operator does not apply to it."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    listed, mapped = isinstance(kind, T.ArrayType), isinstance(kind, T.MapType)
    size = F.when(actual.isNull(), None).otherwise(F.size(actual) if listed or mapped else F.length(actual.cast("string")))
    if operator in ("is_null", "not_null"):
        blank = is_blank(actual) if isinstance(kind, T.StringType) else actual.isNull()
        return blank if operator == "is_null" else ~blank
    if operator in ("equals", "not_equals"):
        same = actual.eqNullSafe(F.lit(expected))
        return same if operator == "equals" else ~same
    if operator in ("gt", "gte", "lt", "lte"):
        number = actual.cast("string").try_cast("double")
        return {"gt": number > expected, "gte": number >= expected, "lt": number < expected, "lte": number <= expected}[operator]
    if operator.startswith(("length_", "count_")):
        return {"gt": size > expected, "lt": size < expected, "eq": size == expected}[operator.split("_")[1]]
    if operator in ("contains", "not_contains"):
        held = F.array_contains(actual, expected) if listed else F.map_contains_key(actual, expected) if mapped else actual.contains(F.lit(expected))
        return held if operator == "contains" else ~held
    if operator == "regex_match":
        return actual.cast("string").rlike(expected)
    member = F.coalesce(actual.isin(list(expected)), F.lit(False))
    return member if operator == "in" else ~member


# Page checks: each gives an array of (resource, observed) for the columns of a page.


def _hits(condition: Column, observed: Column, resource: Column | None = None) -> Column:
    resource = F.col("url") if resource is None else resource
    return F.when(condition, F.array(F.struct(resource.alias("resource"), observed.cast("string").alias("observed")))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<resource:string,observed:string>>")


def _each(items: Column, condition: Callable[[Column], Column], resource: Callable[[Column, Column], Column], observed: Callable[[Column], Column]) -> Column:
    """One hit for each item of an array that meets a condition."""
    marked = F.transform(items, lambda x, i: F.when(condition(x), F.struct(resource(x, i).alias("resource"), observed(x).cast("string").alias("observed"))))
    return F.coalesce(F.array_compact(marked), _none())


def _types() -> Column:
    return F.transform("structured_data", lambda b: b["type"])


def _has_type(names: tuple[str, ...]) -> Column:
    return F.exists("structured_data", lambda b: F.coalesce(F.arrays_overlap(F.split(b["type"], r"[,\s]+"), F.array(*map(F.lit, names))), F.lit(False)))  # unreadable blocks have no type


def heading_skips(levels: Column) -> Column:
    """Pairs (previous, current) where a level is more than one below the one before it."""
    n = F.size(levels)
    pairs = F.zip_with(F.slice(levels, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(levels, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("previous"), b.alias("current")))
    return F.filter(pairs, lambda p: p["current"] > p["previous"] + 1)


def _content_images() -> Column:
    pixel = lambda i: (i["width"] == 1) & (i["height"] == 1)
    shown = F.filter("images", lambda i: ~(i["src"].isNull() | (F.trim(i["src"]) == "") | i["src"].startswith("data:") | F.coalesce(pixel(i), F.lit(False))))
    return shown


def _first_by_src(images: Column) -> Column:
    """The first of the images with the same source."""
    sources = F.transform(images, lambda i: i["src"])
    return F.filter(F.transform(images, lambda i, k: F.struct(i["src"].alias("src"), (F.array_position(sources, i["src"]) == k + 1).alias("first"))), lambda i: i["first"])


def _og_keys() -> Column:
    bare = F.transform(F.map_keys(F.map_filter("open_graph", lambda _, v: ~is_blank(v))), lambda k: F.regexp_replace(F.lower(F.trim(k)), "^og:", ""))
    return F.array_union(bare, F.when(F.arrays_overlap(bare, F.array(*map(F.lit, OG_IMAGES))), F.array(F.lit("image"))).otherwise(F.array().cast("array<string>")))


def _answer_words(answer: Column) -> Column:
    return F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))


PAGE_CHECKS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "canonical_cross_domain": (("canonical",), lambda: _hits(~is_blank(F.col("canonical")) & (urls.registrable_domain(F.col("canonical")) != urls.registrable_domain(F.col("url"))), F.col("canonical"))),
    "h1_missing": (("headings",), lambda: _hits(~F.exists("headings", lambda h: h["level"] == 1), F.lit("0"))),
    "h1_multiple": (("headings",), lambda: _hits(F.size(F.filter("headings", lambda h: h["level"] == 1)) > 1, F.size(F.filter("headings", lambda h: h["level"] == 1)))),
    "heading_level_skip": (("headings",), lambda: _hits(F.size(heading_skips(F.transform("headings", lambda h: h["level"]))) > 0, F.array_join(F.transform("headings", lambda h: h["level"].cast("string")), ","))),
    "image_missing_alt": (("images",), lambda: _each(_first_by_src(F.filter(_content_images(), lambda i: is_blank(i["alt"]))), lambda i: F.lit(True), lambda i, k: F.concat(F.col("url"), F.lit(" img:"), i["src"]), lambda i: i["src"])),
    "image_missing_dimensions": (("images",), lambda: _each(_first_by_src(F.filter(_content_images(), lambda i: i["width"].isNull() | i["height"].isNull())), lambda i: F.lit(True), lambda i, k: F.concat(F.col("url"), F.lit(" img:"), i["src"]), lambda i: i["src"])),
    "noindex_on_sitemap_page": (("sitemap_member", "robots_meta"), lambda: _hits(F.col("sitemap_member") & F.array_contains(F.split(F.lower(F.coalesce("robots_meta", F.lit(""))), r"[,\s]+"), "noindex"), F.col("robots_meta"))),
    "open_graph_incomplete": (("open_graph",), lambda: _hits((F.size(F.map_keys("open_graph")) > 0) & (F.size(F.array_except(F.array(*map(F.lit, OG_REQUIRED)), _og_keys())) > 0), F.array_join(F.array_except(F.array(*map(F.lit, OG_REQUIRED)), _og_keys()), ","))),
    "structured_data_parse_error": (("structured_data",), lambda: _each(F.col("structured_data"), lambda b: b["parse_error"].isNotNull(), lambda b, i: F.concat(F.col("url"), F.lit(" structured_data["), i.cast("string"), F.lit("]")), lambda b: b["parse_error"])),
    "structured_data_absent": (("structured_data",), lambda: _hits(F.size("structured_data") == 0, F.lit("0"))),
    "url_structure_complex": (("url",), lambda: _hits((F.size(urls.query_params(F.col("url"))) > 3) | (F.size(urls.path_segments(F.col("url"))) > 6), F.concat_ws(",", F.size(urls.query_params(F.col("url"))).cast("string"), F.size(urls.path_segments(F.col("url"))).cast("string")))),
    "answer_lead_missing_or_verbose": (("questions",), lambda: _each(F.col("questions"), lambda q: q["text"].isNotNull() & (q["answer"].isNull() | ~_answer_words(q["answer"]).between(20, 160)), lambda q, i: F.concat(F.col("url"), F.lit(" questions["), i.cast("string"), F.lit("]")), lambda q: q["text"])),
    "authorship_date_markup_missing": (("structured_data",), lambda: _hits(_has_type(ARTICLE_TYPES) & ~F.exists("structured_data", lambda b: b["author"].isNotNull() | b["date_published"].isNotNull()), F.array_join(_types(), ","))),
    "faq_schema_absent_with_faq_content": (("questions", "structured_data"), lambda: _hits((F.size(F.filter("questions", lambda q: q["answer"].isNotNull())) >= 2) & ~_has_type(FAQ_TYPES), F.size(F.filter("questions", lambda q: q["answer"].isNotNull())))),
    "no_question_headings": (("headings", "questions"), lambda: _hits(~F.exists("headings", lambda h: (h["level"] >= 2) & F.trim(h["text"]).endswith("?")) & (F.size("questions") == 0), F.lit("0"))),
    "entity_markup_absent": (("word_count", "entities", "structured_data"), lambda: _hits((F.col("word_count") >= 250) & (F.size("entities") == 0) & ~_has_type(ENTITY_TYPES), F.col("word_count"))),
    "no_external_references": (("word_count", "links"), lambda: _hits((F.col("word_count") >= 400) & ~F.exists("links", lambda x: ~x["internal"]), F.col("word_count"))),
    "structured_data_density_low": (("word_count", "structured_data"), lambda: _hits((F.col("word_count") >= 800) & (F.size("structured_data") == 0), F.col("word_count"))),
    "agent_tool_annotation_missing": (("agent_tools",), lambda: _each(F.col("agent_tools"), lambda t: ~t["semantic_annotation"], lambda t, i: F.concat(F.col("url"), F.lit(" tool:"), F.coalesce(t["name"], F.lit(""))), lambda t: t["name"])),
    "agent_tool_description_missing": (("agent_tools",), lambda: _each(F.col("agent_tools"), lambda t: t["description_missing"], lambda t, i: F.concat(F.col("url"), F.lit(" tool:"), F.coalesce(t["name"], F.lit(""))), lambda t: t["name"])),
    "agent_tool_input_schema_missing": (("agent_tools",), lambda: _each(F.col("agent_tools"), lambda t: ~t["input_schema"], lambda t, i: F.concat(F.col("url"), F.lit(" tool:"), F.coalesce(t["name"], F.lit(""))), lambda t: t["name"])),
    "keyword_focus": (("missing",), lambda: _hits(F.size("missing") > 0, F.to_json(F.struct(F.col("keywords").alias("dominant_terms"), F.col("missing").alias("missing_from_title_and_description"))))),
    "agent_tools_discovered": (("agent_tools",), lambda: _hits(F.size("agent_tools") > 0, F.size("agent_tools"))),
}


# Checks beyond a page: DataFrames of (affected_resource, observed_value).


def duplicate_groups(pages: DataFrame, field: str) -> DataFrame:
    """Pages whose text equals another page's, but for case and outer white space: url, group size and the group's urls."""
    key = F.regexp_replace(F.lower(F.trim(F.col(field))), "ß", "ss")
    keyed = pages.filter(~is_blank(F.col(field))).select("url", key.alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("url").alias("first")).filter("n >= 2")
    return keyed.join(groups, "key").select("url", "key", "n", "first")


def _duplicates(field: str) -> Callable[[DataFrame], DataFrame]:
    return lambda pages: duplicate_groups(pages, field).select(F.col("url").alias("affected_resource"), F.concat_ws(" | ", F.col("n").cast("string"), "key").alias("observed_value"))


def duplicate_content(pages: DataFrame) -> DataFrame:
    """Pages with the same html as another one, unless one of the group names the other as canonical."""
    own = pages.select("url", "raw_html_hash", "canonical")
    groups = own.groupBy("raw_html_hash").agg(F.count("*").alias("n")).filter("n >= 2")
    members = own.join(groups, "raw_html_hash")
    # an alternate names, or is named by, a member of its group: two equi-joins instead of all pairs
    named = members.select("raw_html_hash", F.col("canonical").alias("url"), F.col("url").alias("by")).filter("url is not null and url <> by")
    hit = named.join(own.select("url", "raw_html_hash"), ["url", "raw_html_hash"])
    alternates = hit.select("url").union(hit.select(F.col("by"))).distinct()
    return members.join(alternates, "url", "left_anti").select(F.col("url").alias("affected_resource"), F.concat_ws(" | ", F.col("n").cast("string"), "raw_html_hash").alias("observed_value"))


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct internal links (source, target) between pages, as normal forms."""
    rows = pages.select(urls.normalized(F.col("url")).alias("source"), F.explode("links").alias("link"))
    return rows.filter(F.col("link.internal")).select("source", F.col("link.href").alias("target")).distinct()


def broken_links(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """Internal links to pages that answered with an error or could not be fetched; failed has url."""
    errors = failed.select(urls.normalized(F.col("url")).alias("target"))
    if "status_code" in pages.columns:
        errors = errors.union(pages.filter("status_code >= 400").select(urls.normalized(F.col("url"))))
    rows = pages.select("url", F.explode("links").alias("link")).filter(F.col("link.internal") & ~urls.is_infrastructure(F.col("link.href")))
    found = rows.select("url", F.col("link.href").alias("target")).distinct().join(errors.distinct(), "target", "left_semi")
    return found.select(F.concat_ws(" -> ", "url", "target").alias("affected_resource"), F.col("target").alias("observed_value"))


def orphan_pages(pages: DataFrame) -> DataFrame:
    """Pages that no other page links to; the site's root is exempt."""
    linked = page_links(pages).filter("source <> target").select("target").distinct()
    own = pages.select("url", urls.normalized(F.col("url")).alias("target"), urls.path(F.col("url")).alias("path"))
    return own.filter("path <> '/'").join(linked, "target", "left_anti").select(F.col("url").alias("affected_resource"), F.lit("0").alias("observed_value"))


def hreflang_not_reciprocal(pages: DataFrame) -> DataFrame:
    """Alternates that are known pages and do not link back."""
    own = pages.select("url", urls.normalized(F.col("url")).alias("here"))
    pairs = pages.select("url", urls.normalized(F.col("url")).alias("here"), F.explode("hreflang").alias("h")).select("url", "here", F.col("h.href").alias("there")).filter("here <> there").distinct()
    known = pairs.join(own.select(F.col("here").alias("there")).distinct(), "there")
    back = pairs.select(F.col("here").alias("there"), F.col("there").alias("here"))
    return known.join(back, ["here", "there"], "left_anti").select(F.concat(F.col("url"), F.lit(" hreflang:"), F.col("there")).alias("affected_resource"), F.col("there").alias("observed_value"))


SITE_CHECKS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "title_duplicate_across_pages": (("title",), _duplicates("title")),
    "meta_description_duplicate_across_pages": (("meta_description",), _duplicates("meta_description")),
    "exact_duplicate_content": (("raw_html_hash", "canonical"), duplicate_content),
    "orphan_page": (("links",), orphan_pages),
    "hreflang_not_reciprocal": (("hreflang",), hreflang_not_reciprocal),
}


#: What rules read of a page record.
RULE_FIELDS = "url title meta_description canonical robots_meta headings links images structured_data entities questions language hreflang open_graph viewport word_count raw_html_hash agent_tools status_code redirect_chain sitemap_member keywords missing".split()


def judged_records(pages: DataFrame) -> DataFrame:
    """Page records as rules read them: with dominant terms, without content and raw structured data."""
    rows = with_missing_keywords(pages) if {"content", "word_count"} <= set(pages.columns) else pages
    if "structured_data" in rows.columns:
        rows = rows.withColumn("structured_data", F.transform("structured_data", lambda b: F.struct(b["type"], b["author"], b["date_published"], b["parse_error"])))
    return rows.select(*[c for c in rows.columns if c in RULE_FIELDS])


def _tagged(own: Column, rule: Rule) -> Column:
    return F.transform(F.coalesce(own, _none()), lambda h: F.struct(F.lit(rule.rule_id).alias("rule_id"), h["resource"].alias("affected_resource"), h["observed"].alias("observed_value"), F.lit(rule.expected).alias("expected_condition")))


def page_hits(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of all page rules, from one pass over the pages."""
    fields = {f.name: f.dataType for f in pages.schema.fields}
    found = []
    for rule in rules:
        if rule.field in fields:
            own = _hits(F.coalesce(predicate(rule.operator, F.col(rule.field), fields[rule.field], rule.value), F.lit(False)), F.to_json(F.struct(F.col(rule.field).alias("v"))) if isinstance(fields[rule.field], (T.ArrayType, T.MapType)) else F.col(rule.field))
        elif rule.check in PAGE_CHECKS and set(PAGE_CHECKS[rule.check][0]) <= set(fields):
            own = PAGE_CHECKS[rule.check][1]()
        else:
            continue
        found.append(_tagged(own, rule))
    # outer, as else the size of the array would be a filter that judges each page twice
    return pages.select(F.explode_outer(F.concat(*found)).alias("hit")).filter("hit is not null").select("hit.*")


def site_hits(pages: DataFrame, rules: list[Rule], failed: DataFrame | None = None) -> DataFrame | None:
    parts = []
    for rule in rules:
        if rule.check in SITE_CHECKS and set(SITE_CHECKS[rule.check][0]) <= set(pages.columns):
            own = SITE_CHECKS[rule.check][1](pages)
        elif rule.check == "broken_internal_link" and failed is not None:
            own = broken_links(pages, failed)
        else:
            continue
        parts.append(own.select(F.lit(rule.rule_id).alias("rule_id"), "affected_resource", "observed_value", F.lit(rule.expected).alias("expected_condition")))
    return reduce(DataFrame.union, parts) if parts else None


def crawl_hits(crawl: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of the rules over crawl runs: run_url, robots struct<state, ai_bot_disallows>, sitemaps array<struct<url, parse_state>>."""
    invalid = F.filter("sitemaps", lambda s: s["parse_state"].isin("invalid", "not_xml"))
    checks = {
        "SEO-ROBOTS-UNAVAILABLE-001": _hits(F.col("robots.state") == "unavailable", F.col("robots.state"), F.col("run_url")),
        "GEO-AI-CRAWLER-ACCESS-001": _hits(F.size("robots.ai_bot_disallows") > 0, F.array_join("robots.ai_bot_disallows", ","), F.col("run_url")),
        "SEO-SITEMAP-INVALID-001": F.transform(invalid, lambda s: F.struct(s["url"].alias("resource"), s["parse_state"].alias("observed"))),
    }
    found = [_tagged(checks[r.rule_id], r) for r in rules if r.rule_id in checks]
    return crawl.select(F.explode(F.concat(*found)).alias("hit")).select("hit.*")


def evaluate(pages: DataFrame, failed: DataFrame | None = None, crawl: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """All hits of all rules that can be judged: rule_id, affected_resource, observed_value, expected_condition."""
    rules = CATALOG if rules is None else rules
    parts = [page_hits(pages, rules), site_hits(pages, rules, failed)]
    if crawl is not None:
        parts.append(crawl_hits(crawl, rules))
    return reduce(DataFrame.union, [p for p in parts if p is not None])


def canonical_order(hits: DataFrame) -> DataFrame:
    """Hits in the order in which a replay gives the same bytes."""
    return hits.orderBy("rule_id", "affected_resource", "observed_value", "expected_condition")


def skips(pages: DataFrame, has_failed: bool = False, has_crawl: bool = False, rules: list[Rule] | None = None) -> DataFrame:
    """What could not be judged: rule_id, reason, n (pages, or 1 for a whole rule)."""
    rules = CATALOG if rules is None else rules
    fields = {f.name: f.dataType for f in pages.schema.fields}
    whole: list[tuple[str, str]] = []
    counts = []
    for rule in rules:
        needed = (PAGE_CHECKS | SITE_CHECKS).get(rule.check, ((), None))[0]
        if rule.check == "content_intent_alignment":
            whole.append((rule.rule_id, "llm_interpreted"))
        elif rule.scope == "crawl_run" and rule.check not in SITE_CHECKS:
            if not has_crawl:
                whole.append((rule.rule_id, "missing_context"))
        elif rule.check == "broken_internal_link":
            if not has_failed:
                whole.append((rule.rule_id, "missing_context"))
        elif rule.field and rule.field not in fields or set(needed) - set(fields):
            whole.append((rule.rule_id, "unknown_field"))
        elif rule.check and rule.check not in PAGE_CHECKS and rule.check not in SITE_CHECKS:
            whole.append((rule.rule_id, "unknown_check"))
        elif rule.field:
            counts.append(F.count_if(predicate(rule.operator, F.col(rule.field), fields[rule.field], rule.value).isNull()).alias(rule.rule_id))
    fixed = pages.sparkSession.createDataFrame([(*w, 1) for w in whole], "rule_id string, reason string, n long")
    if not counts:
        return fixed
    summed = pages.agg(*counts)
    judged = summed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule_id"), F.col(f"`{c}`").alias("n")) for c in summed.columns])).alias("x")).select("x.rule_id", F.lit("inapplicable").alias("reason"), "x.n").filter("n > 0")
    return fixed.union(judged)


def rule_table(spark, rules: list[Rule] | None = None) -> DataFrame:
    rows = [(r.rule_id, r.version, r.category, r.severity, r.confidence, r.scope, r.expected, r.actionability) for r in (CATALOG if rules is None else rules)]
    return spark.createDataFrame(rows, "rule_id string, version int, category string, severity string, confidence string, scope string, expected string, actionability string")


def merged_catalog(stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stored rules override the catalog's by rule_id."""
    names = [c for c in catalog.columns if c != "rule_id"]
    joined = stored.alias("s").join(catalog.alias("c"), "rule_id", "full_outer")
    here = F.col("s.version").isNotNull()
    return joined.select("rule_id", *[F.when(here, F.col(f"s.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in names])


def latest_versions(rules: DataFrame) -> DataFrame:
    newest = Window.partitionBy("rule_id").orderBy(F.desc("version"))
    return rules.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
