"""Queries over small generated inputs whose right answers are known in advance: rules, parsers and kernels that the
test tables do not exercise. Each query returns (item, value); its SQL is the list of expected rows, written by hand."""

from __future__ import annotations

import datetime as dt
import gzip
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import pages as page_functions
from plumbline.functions import urls
from plumbline.operators import changes, crawl, findings, graph, index, records, retrieval, rules, search, text

SITE = "https://site.test"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def fixture(*expected: tuple[str, object]):
    """Register a query and the rows that it has to give."""

    def register(query: Callable[[SparkSession], DataFrame]):
        QUERIES[query.__name__] = lambda spark, _: query(spark)
        rows = ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in expected)
        ORACLES[query.__name__] = f"SELECT item::VARCHAR AS item, value::VARCHAR AS value FROM (VALUES {rows}) t(item, value)"
        return query

    return register


def _one(spark: SparkSession, **columns: Column) -> DataFrame:
    """One row of kernels as (item, value)."""
    row = spark.range(1).select(*[c.cast("string").alias(n) for n, c in columns.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in columns])).alias("x")).select("x.*")


def _pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """The first column as item and the others, joined, as value."""
    return rows.select(F.col(columns[0]).cast("string").alias("item"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns[1:]]).alias("value"))


def _words(n: int) -> str:
    """So many words that are no keywords."""
    return " ".join(str(10 + i % 80) for i in range(n))


def _page(path: str, **change: str | None) -> tuple[str, str]:
    """A page that breaks no rule, but for what is changed."""
    url = SITE + path
    own = {
        "html": '<html lang="en">',
        "title": f"<title>1 {path}</title>",
        "description": f'<meta content="2 {path}" name=description>',
        "canonical": f"<link href='{url}' rel=canonical>",
        "viewport": "<meta name='viewport' content='width=device-width'>",
        "robots": "<meta name=robots content=index>",
        "og": "".join(f"<meta property='og:{k}' content='{v}'>" for k, v in (("title", "t"), ("type", "website"), ("image", "/i.png"), ("url", url))),
        "ld": """<script type='application/ld+json'>{"@graph": [{"@type": "Organization", "name": "S"}]}</script>""",
        "h1": "<h1>1</h1>",
        "question": f"<h2>5 ?</h2><p>{_words(30)}</p>",
        "body": f"<p>{_words(260)}</p>",
        "image": "<img alt=a width=10 height='10' src=/i.png>",
        "more": "",
    } | {k: v or "" for k, v in change.items()}
    head = "".join(own[k] for k in ("title", "description", "canonical", "viewport", "robots", "og", "ld"))
    return url, f"{own['html']}<head>{head}</head><body>{''.join(own[k] for k in ('h1', 'question', 'body', 'image', 'more'))}</body></html>"


_TWIN = dict(title="<title>1 twin</title>", description="<meta name=description content='2 twin'>", canonical=f"<link rel=canonical href={SITE}/third>", og="".join(f"<meta property=og:{k} content={k}>" for k in ("title", "type", "image", "url")))
_PAGES = [
    _page("/clean"),
    _page("/canonical-none", canonical=""),
    _page("/canonical-cross", canonical="<link rel='alternate canonical' href='https://other.example/x'>"),
    _page("/broken", more="<a href=/gone>x</a><a href='/cdn-cgi/gone'>y</a>"),
    _page("/twin-1", **_TWIN),
    _page("/twin-2", **_TWIN),
    _page("/thin", body=""),
    _page("/h1-none", h1=""),
    _page("/h1-two", more="<h1>2</h1>"),
    _page("/skip", more="<h4>4</h4>"),
    _page("/lang-a", more=f"<link rel=alternate hreflang=de href='{SITE}/lang-b'>"),
    _page("/lang-b", more=f"<link rel=alternate hreflang=en href='{SITE}/clean'><link rel=alternate hreflang=fr href='{SITE}/unknown'>"),
    _page("/alt", image="<img src='/a.png' width=9 height=9><img src='/a.png' width=9 height=9><img src=data:x><img src=/dot width=1 height=1>"),
    _page("/size", image="<img alt=a src='/_next/image?url=%2Fb.png&amp;w=9' style='width:20px; max-height: 3px'>"),
    _page("/keyword", body=f"<p>{_words(260)}{' zebra' * 5}</p>"),
    _page("/html-bare", html="<html>"),
    _page("/description-long", description=f"<meta name=description content='{'9' * 161}'>"),
    _page("/description-none", description=""),
    _page("/noindex", robots="<meta content='NOINDEX, follow' name=robots>"),
    _page("/og", og="<meta property=og:title content=t><meta property=og:type content=t><meta property=og:image:url content=i>"),
    _page("/orphan"),
    _page("/hops"),
    _page("/unlisted"),
    _page("/ld-bad", ld="<script type=application/ld+json>[{\"@type\": [\"Organization\", \"Store\"]}]</script><script type='application/ld+json'>{bad</script>"),
    _page("/ld-none", ld=""),
    _page("/title-long", title=f"<title>{'8' * 61}</title>"),
    _page("/title-none", title="<title> </title>"),
    _page("/1/2/3/4/5/6/7"),
    _page("/viewport-none", viewport=""),
    _page("/answer-none", question="<h2>6?</h2><p>7</p>"),
    _page("/article", ld="<script type='application/ld+json'>[{\"@type\": \"Organization\"}, {\"@type\": \"Article\"}]</script>"),
    _page("/faq", question=f"<h2>5?</h2><p>{_words(30)}</p><h2>6?</h2>"),
    _page("/question-none", question=""),
    _page("/entity-none", ld="<script type='application/ld+json'>{\"@type\": \"WebPage\"}</script>"),
    _page("/sources", body=f"<p>{_words(420)}</p>"),
    _page("/dense", body=f"<p>{_words(820)}</p>", ld="", more="<a href=https://cited.example/>c</a>"),
    _page("/tools", more="<script>registerTool({ name: 'x' })</script><form toolname=y tooldescription='d'></form>"),
]
_HOME = _page("/", more="".join(f"<a href='{u}'>p</a>" for u, _ in _PAGES if not u.endswith("/orphan")))


def _site(spark: SparkSession) -> DataFrame:
    rows = page_functions.page_model(spark.createDataFrame([_HOME, *_PAGES], "url string, html string").repartition(4))
    at = lambda path: F.col("url") == SITE + path
    answered = F.array(*[F.struct(F.lit(q).alias("text"), F.lit(_words(30)).alias("answer")) for q in ("5?", "6?")])
    return rows.withColumns(
        {
            "questions": F.when(at("/faq"), answered).otherwise(F.col("questions")),
            "sitemap_member": ~at("/unlisted"),
            "redirect_chain": F.when(at("/hops"), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")),
            "status_code": F.lit(200),
        }
    )


def _crawl(spark: SparkSession) -> DataFrame:
    row = "array(named_struct('url', '{0}/s1.xml', 'parse_state', 'valid'), named_struct('url', '{0}/s2.xml', 'parse_state', '{1}'))"
    good, bad = row.format(SITE, "valid"), row.format(SITE, "not_xml")
    return spark.sql(f"SELECT '{SITE}' AS run_url, named_struct('state', 'unavailable', 'ai_bot_disallows', array('gptbot')) AS robots, {bad} AS sitemaps UNION ALL SELECT 'https://fine.test', named_struct('state', 'fetched', 'ai_bot_disallows', array()), {good}")


_IMG = f"{SITE}/size img:{SITE}/b.png"


@fixture(
    ("SEO-BROKEN-INTERNAL-LINK-001", f"{SITE}/broken -> {SITE}/gone"),
    ("SEO-CANONICAL-001", f"{SITE}/canonical-none"),
    ("SEO-CANONICAL-CROSSDOMAIN-001", f"{SITE}/canonical-cross"),
    ("SEO-CONTENT-DUPLICATE-001", f"{SITE}/twin-1"),
    ("SEO-CONTENT-DUPLICATE-001", f"{SITE}/twin-2"),
    ("SEO-TITLE-DUPLICATE-001", f"{SITE}/twin-1"),
    ("SEO-TITLE-DUPLICATE-001", f"{SITE}/twin-2"),
    ("SEO-METADESC-DUPLICATE-001", f"{SITE}/twin-1"),
    ("SEO-METADESC-DUPLICATE-001", f"{SITE}/twin-2"),
    ("SEO-CONTENT-THIN-001", f"{SITE}/thin"),
    ("SEO-H1-MISSING-001", f"{SITE}/h1-none"),
    ("SEO-H1-MULTIPLE-001", f"{SITE}/h1-two"),
    ("SEO-HEADING-SKIP-001", f"{SITE}/skip"),
    ("SEO-HREFLANG-NOT-RECIPROCAL-001", f"{SITE}/lang-a hreflang:{SITE}/lang-b"),
    ("SEO-HREFLANG-NOT-RECIPROCAL-001", f"{SITE}/lang-b hreflang:{SITE}/clean"),
    ("SEO-IMAGE-ALT-001", f"{SITE}/alt img:{SITE}/a.png"),
    ("SEO-IMAGE-DIMENSIONS-001", _IMG),
    ("SEO-KEYWORD-FOCUS-001", f"{SITE}/keyword"),
    ("SEO-LANG-MISSING-001", f"{SITE}/html-bare"),
    ("SEO-METADESC-LENGTH-001", f"{SITE}/description-long"),
    ("SEO-METADESC-MISSING-001", f"{SITE}/description-none"),
    ("SEO-NOINDEX-UNEXPECTED-001", f"{SITE}/noindex"),
    ("SEO-OG-INCOMPLETE-001", f"{SITE}/og"),
    ("SEO-ORPHAN-PAGE-001", f"{SITE}/orphan"),
    ("SEO-REDIRECT-CHAIN-001", f"{SITE}/hops"),
    ("SEO-SITEMAP-COVERAGE-GAP-001", f"{SITE}/unlisted"),
    ("SEO-STRUCTUREDDATA-INVALID-001", f"{SITE}/ld-bad structured_data[1]"),
    ("SEO-STRUCTUREDDATA-MISSING-001", f"{SITE}/ld-none"),
    ("GEO-ENTITY-CLARITY-001", f"{SITE}/ld-none"),
    ("SEO-TITLE-LENGTH-001", f"{SITE}/title-long"),
    ("SEO-TITLE-MISSING-001", f"{SITE}/title-none"),
    ("SEO-URL-COMPLEXITY-001", f"{SITE}/1/2/3/4/5/6/7"),
    ("SEO-VIEWPORT-MISSING-001", f"{SITE}/viewport-none"),
    ("AEO-ANSWER-LEAD-001", f"{SITE}/answer-none questions[0]"),
    ("AEO-AUTHORSHIP-DATE-001", f"{SITE}/article"),
    ("AEO-FAQ-SCHEMA-001", f"{SITE}/faq"),
    ("AEO-QUESTION-HEADING-001", f"{SITE}/question-none"),
    ("GEO-ENTITY-CLARITY-001", f"{SITE}/entity-none"),
    ("GEO-SOURCE-ATTRIBUTION-001", f"{SITE}/sources"),
    ("GEO-STRUCTURED-DENSITY-001", f"{SITE}/dense"),
    ("SEO-STRUCTUREDDATA-MISSING-001", f"{SITE}/dense"),
    ("GEO-ENTITY-CLARITY-001", f"{SITE}/dense"),
    ("AGENT-TOOL-ANNOTATION-001", f"{SITE}/tools tool:x"),
    ("AGENT-TOOL-ANNOTATION-001", f"{SITE}/tools tool:y"),
    ("AGENT-TOOL-DESCRIPTION-001", f"{SITE}/tools tool:x"),
    ("AGENT-TOOL-INPUT-SCHEMA-001", f"{SITE}/tools tool:x"),
    ("AGENT-TOOL-INPUT-SCHEMA-001", f"{SITE}/tools tool:y"),
    ("AGENT-TOOLS-DISCOVERED-001", f"{SITE}/tools"),
    ("SEO-ROBOTS-UNAVAILABLE-001", SITE),
    ("GEO-AI-CRAWLER-ACCESS-001", SITE),
    ("SEO-SITEMAP-INVALID-001", f"{SITE}/s2.xml"),
)
def rules_on_generated_site(spark: SparkSession) -> DataFrame:
    """Every mechanical rule on a site in which each page breaks one rule, and the first one none."""
    failed = spark.createDataFrame([(f"{SITE}/gone",), (f"{SITE}/cdn-cgi/gone",)], "url string")
    from plumbline.session import materialized

    hits = rules.evaluate(materialized(rules.judged_records(_site(spark)), "generated"), failed, _crawl(spark))
    return hits.select(F.col("rule_id").alias("item"), F.col("affected_resource").alias("value"))


_HTML = """<HTML LANG=de><head><TITLE>A &amp; B</TITLE><meta content="d &quot;q&quot;" name='Description'><meta name=author content=x><meta property='article:published_time' content=2024>
<link rel='canonical' href='../c'><link hreflang=fr rel=alternate href="/fr/"><script type="application/ld+json">[{"@type":"FAQPage","mainEntity":[{"name":"What is <b>it</b>?","acceptedAnswer":{"text":"<p>A thing</p>"}},{"name":"Other?","acceptedAnswer":[{"text":"Yes"}]}]},{"@graph":[{"@type":["Organization","Brand"]},3]}]</script></head>
<body><!-- <h1>no</h1> --><h2>What  is it</h2><h2>What is it?</h2><h3>Why?</h3><p>""" + _words(25) + """</p><a href='/x' rel='nofollow author'>x</a><a href=//other.test/y>y</a><area href="mailto:a@b"><time datetime=2024></time><img src='/_next/image?url=https%3A%2F%2Fcdn.test%2Fp.png&w=3' alt width=abc style="width: 12.5px"></body></HTML>"""


@fixture(
    ("title", "A & B"),
    ("meta_description", 'd "q"'),
    ("canonical", "https://a.test/d/../c"),
    ("language", "de"),
    ("headings", "2 What is it|2 What is it?|3 Why?"),
    ("types", "FAQPage|Organization,Brand|-"),
    ("errors", "-|-|JSON-LD root is not an object"),
    ("questions", f"What is it?=A thing|Why?={_words(25)}|Other?=Yes"),
    ("hreflang", "fr https://a.test/fr"),
    ("links", "https://a.test/x true nofollow author|https://other.test/y false -"),
    ("images", "https://cdn.test/p.png [] 12 -"),
    ("authorship", "author meta tag|author relationship link"),
    ("dates", "article date metadata|time datetime markup"),
)
def page_fields_of_ordinary_html(spark: SparkSession) -> DataFrame:
    """Attributes in any order and quoting, structured data in lists and graphs, questions with their answers."""
    source = spark.createDataFrame([("https://a.test/d/e", _HTML)], "url string, html string")
    row = page_functions.page_model(source.withColumn("seen", page_functions.observations(F.col("html"))))
    show = lambda items, *parts: F.array_join(F.transform(items, lambda x: F.concat_ws(" ", *[F.coalesce(p(x).cast("string"), F.lit("-")) for p in parts])), "|")
    fields = {
        **{c: F.col(c) for c in ("title", "meta_description", "canonical", "language")},
        "headings": show(F.col("headings"), lambda h: h["level"], lambda h: h["text"]),
        "types": show(F.col("structured_data"), lambda b: b["type"]),
        "errors": show(F.col("structured_data"), lambda b: b["parse_error"]),
        "questions": F.array_join(F.transform("questions", lambda q: F.concat_ws("=", q["text"], q["answer"])), "|"),
        "hreflang": show(F.col("hreflang"), lambda h: h["lang"], lambda h: h["href"]),
        "links": show(F.col("links"), lambda x: x["href"], lambda x: x["internal"], lambda x: x["rel"]),
        "images": show(F.col("images"), lambda i: i["src"], lambda i: F.concat(F.lit("["), i["alt"], F.lit("]")), lambda i: i["width"], lambda i: i["height"]),
        "authorship": F.array_join("seen.authorship", "|"),
        "dates": F.array_join("seen.dates", "|"),
    }
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), c.alias("value")) for k, c in fields.items()])).alias("x")).select("x.*")


@fixture(("root", "empty application root"), ("bundles", "multiple client script bundles"), ("noscript", "noscript fallback"), ("plain", None))
def spa_shells(spark: SparkSession) -> DataFrame:
    rows = [("root", "<body><div class=a id='app'> </div></body>"), ("bundles", "<body>" + "<script src=a.js></script>" * 3 + "x</body>"), ("noscript", "<body><noscript>on</noscript>few</body>"), ("plain", "<body><div id=root>x</div></body>")]
    return spark.createDataFrame(rows, "item string, html string").select("item", page_functions.spa_shell_reason(F.col("html")).alias("value"))


@fixture(("runtime", "r imperative,a declarative"), ("no_runtime", "x imperative,a declarative,b declarative"), ("empty_runtime", "a declarative,b declarative"))
def agent_tools_merged(spark: SparkSession) -> DataFrame:
    def tools(*own: tuple[str, str]) -> str:
        return "array(" + ", ".join(f"named_struct('registration', '{r}', 'name', '{n}')" for n, r in own) + ")"

    html = tools(("x", "imperative"), ("x", "imperative"), ("a", "declarative"), ("b", "declarative"))
    b = tools(("r", "imperative"), ("b", "imperative"))
    rows = spark.sql(f"SELECT 'runtime' AS item, {html} AS h, filter({b}, t -> true) AS r UNION ALL SELECT 'no_runtime', {html}, null UNION ALL SELECT 'empty_runtime', {html}, filter({b}, t -> false)")
    merged = page_functions.merged_tools(F.col("h"), F.col("r"))
    shown = F.filter(merged, lambda t: ~((t["name"] == "b") & (t["registration"] == "imperative")))
    return rows.select("item", F.array_join(F.transform(shown, lambda t: F.concat_ws(" ", t["name"], t["registration"])), ",").alias("value"))


_ROBOTS = "User-agent: *\nDisallow: /private/*.pdf\nAllow: /private/open\n\nUser-Agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nuser-agent: mybot\nDisallow: /shop # all\nAllow: /shop/open\nSitemap: https://r.test/s.xml"


@fixture(("/private/a.pdf", "false"), ("/private/a.txt", "true"), ("/private/open/a.pdf", "false"), ("/shop/x", "true"))
def robots_allowed(spark: SparkSession) -> DataFrame:
    lines = crawl.robots_lines(spark.createDataFrame([("https://r.test", _ROBOTS)], "origin string, text string"))
    pages = spark.createDataFrame([(f"https://r.test{p}",) for p in ("/private/a.pdf", "/private/a.txt", "/private/open/a.pdf", "/shop/x")], "url string")
    return crawl.allowed(pages, crawl.rules_for(crawl.robots_groups(lines), "someone/1.0")).select(urls.path(F.col("url")).alias("item"), F.col("allowed").cast("string").alias("value"))


@fixture(("/shop/x", "false"), ("/shop/open/y", "true"), ("/private/a.pdf", "true"))
def robots_allowed_for_agent(spark: SparkSession) -> DataFrame:
    lines = crawl.robots_lines(spark.createDataFrame([("https://r.test", _ROBOTS)], "origin string, text string"))
    pages = spark.createDataFrame([(f"https://r.test{p}",) for p in ("/shop/x", "/shop/open/y", "/private/a.pdf")], "url string")
    return crawl.allowed(pages, crawl.rules_for(crawl.robots_groups(lines), "MyBot/2.0 (x)")).select(urls.path(F.col("url")).alias("item"), F.col("allowed").cast("string").alias("value"))


@fixture(("https://r.test", "gptbot,ccbot"))
def robots_ai_bots(spark: SparkSession) -> DataFrame:
    lines = crawl.robots_lines(spark.createDataFrame([("https://r.test", _ROBOTS)], "origin string, text string"))
    return crawl.ai_bots_shut_out(crawl.robots_groups(lines)).select(F.col("origin").alias("item"), F.array_join("bots", ",").alias("value"))


@fixture(("s1", "valid,urlset,2,0,1,1,2"), ("s2", "valid,index,0,1,0,0,0"), ("s3", "invalid,unknown,0,0,0,0,0"), ("s4", "not_xml,unknown,0,0,0,0,0"), ("s5", "valid,urlset,1,0,0,0,0"), ("s6", "unavailable,unknown,0,0,0,0,0"))
def sitemap_files(spark: SparkSession) -> DataFrame:
    """Sitemaps as they are fetched, gzip included: state, kind, pages, children, repeats, bad dates, dates."""
    loc = lambda *u: "".join(f"<url><loc>{x}</loc>{m}</url>" for x, m in u)
    files = {
        "s1": "<urlset>" + loc(("https://w.test/a", "<lastmod>2024-01-02</lastmod>"), ("http://www.w.test/b?utm_source=x", "<lastmod>soon</lastmod>"), ("https://w.test/a/", ""), ("https://else.test/", "")) + "</urlset>",
        "s2": "<sitemapindex><sitemap><loc>https://w.test/s1.xml</loc></sitemap></sitemapindex>",
        "s3": "<urlset><url>",
        "s4": "<html><body>not found</body></html>",
        "s5": gzip.compress(b"<urlset><url><loc>https://w.test/z</loc></url></urlset>", mtime=0),
        "s6": "",
    }
    rows = spark.createDataFrame([(k, bytearray(v if isinstance(v, bytes) else v.encode())) for k, v in files.items()], "url string, body binary")
    found = crawl.sitemap_records(records.inflated(rows).withColumn("origin", F.lit("https://w.test")))
    return _pairs(found.select("url", "parse_state", "kind", F.size("page_urls").alias("p"), F.size("child_sitemaps").alias("c"), "duplicate_loc_count", "invalid_lastmod_count", "lastmod_present_count"), "url", "parse_state", "kind", "p", "c", "duplicate_loc_count", "invalid_lastmod_count", "lastmod_present_count")


@fixture(
    ("aligned", "https://a.test/x?y=1"), ("not_aligned", None), ("private", "true,true,true,false"), ("infra", "true,false"), ("skipped", "true,false"), ("route", "/shop/[id]"), ("no_route", None), ("posix", "a/c"), ("llms", "present,malformed,missing,unavailable"),
    ("sample", "unavailable,non_200,redirected,ok"), ("html", "true,false,true"), ("robots_state", "missing,fetched,unavailable"), ("sitemap_html", "true"), ("preview", "http://p.test:3000/a/b"), ("equal", "true,false"),
)
def url_and_fetch_kernels(spark: SparkSession) -> DataFrame:
    lit, many = F.lit, lambda *c: F.concat_ws(",", *[x.cast("string") for x in c])
    return _one(
        spark,
        aligned=urls.aligned(lit("http://www.a.test/x?y=1"), lit("https://a.test/")),
        not_aligned=urls.aligned(lit("http://b.test/x"), lit("https://a.test/")),
        private=many(*[urls.is_private_host(lit(h)) for h in ("localhost", "10.1.2.3", "172.20.0.1", "172.40.0.1")]),
        infra=many(*[urls.is_infrastructure(lit(u)) for u in ("https://a.test/cdn-cgi/x", "https://a.test/cdn-cgix")]),
        skipped=many(*[urls.is_skipped_path(lit(u)) for u in ("https://a.test/.well-known/x", "https://a.test/x")]),
        route=urls.app_route(lit("src/app/(main)/shop/[id]/page.tsx")),
        no_route=urls.app_route(lit("src/lib/page.tsx")),
        posix=graph.posix_normal(lit("./a/b/../c")),
        llms=many(*[crawl.llms_text_state(lit(s), lit(t)) for s, t in ((200, "x\n# Title"), (200, "no title"), (404, ""), (500, ""))]),
        sample=many(*[crawl.sample_outcome(F.lit(s).cast("int"), lit(r)) for s, r in ((None, 0), (404, 0), (200, 1), (200, 0))]),
        html=many(*[crawl.is_html(lit(c), lit(h)) for c, h in (("text/html; charset=x", ""), ("image/png", "<html"), ("", " <!DOCTYPE html>"))]),
        robots_state=many(*[crawl.robots_state(lit(s)) for s in (404, 200, 503)]),
        sitemap_html=records.is_sitemap_page(lit("application/xml"), lit(" <!doctype HTML><html>")),
        preview=records.on_preview(lit("https://live.test/a/b?x=1"), lit("http://p.test:3000/")),
        equal=many(records.urls_equal(lit("HTTPS://a.test/x/"), lit("https://a.test/x")), records.urls_equal(lit(""), lit(""))),
    )


_OPERATORS = [("is_null", " ", None), ("not_null", "a", None), ("equals", "a", "a"), ("not_equals", "a", "b"), ("gt", "5", 4), ("gte", "5", 5), ("lt", "5", 6), ("lte", "5", 5), ("length_gt", "abc", 2), ("length_lt", "abc", 4), ("count_gt", "abc", 2), ("count_eq", "abc", 3), ("count_lt", "abc", 4), ("contains", "abc", "b"), ("not_contains", "abc", "x"), ("regex_match", "abc", "^a.c$"), ("in", "a", ["a", "b"]), ("not_in", "c", ["a", "b"])]
_OPPOSITES = [("is_null", "a", None), ("not_null", " ", None), ("equals", "a", "b"), ("not_equals", "a", "a"), ("gt", "5", 5), ("gte", "5", 6), ("lt", "5", 5), ("lte", "5", 4), ("length_gt", "abc", 3), ("length_lt", "abc", 3), ("count_gt", "abc", 3), ("count_eq", "abc", 2), ("count_lt", "abc", 3), ("contains", "abc", "x"), ("not_contains", "abc", "b"), ("regex_match", "abc", "^b"), ("in", "c", ["a", "b"]), ("not_in", "a", ["a", "b"])]


@fixture(*[(op, "true,false") for op, _, _ in _OPERATORS])
def predicate_operators(spark: SparkSession) -> DataFrame:
    """Each operator on a value that meets its condition and on one that does not."""
    from pyspark.sql.types import StringType

    met = lambda o, v, e: rules.predicate(o, F.lit(v), StringType(), e).cast("string")
    return _one(spark, **{yes[0]: F.concat_ws(",", met(*yes), met(*no)) for yes, no in zip(_OPERATORS, _OPPOSITES, strict=True)})


@fixture(("a.b", "1"), ("a.m.k", "v"), ("a.x", "no field"), ("a.m.none", None))
def dotted_fields(spark: SparkSession) -> DataFrame:
    rows = spark.sql("SELECT named_struct('b', 1, 'm', map('k', 'v')) AS a")
    found = {p: records.resolved(rows.schema, p) for p in ("a.b", "a.m.k", "a.x", "a.m.none")}
    return rows.select(F.explode(F.array(*[F.struct(F.lit(p).alias("item"), (F.lit("no field") if c is None else c.cast("string")).alias("value")) for p, c in found.items()])).alias("x")).select("x.*")


@fixture(("stats_json.crawl.robots.state", "missing"), ("crawl.page_count", "7"), ("page_count", "7"), ("stats_json.none", None))
def crawl_statistics(spark: SparkSession) -> DataFrame:
    stats = F.lit('{"robots": {"state": "missing"}, "page_count": 7}')
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(f).alias("item"), records.crawl_stat(stats, f).alias("value")) for f in ("stats_json.crawl.robots.state", "crawl.page_count", "page_count", "stats_json.none")])).alias("x")).select("x.*")


@fixture(("A-1", ""), ("A-2", "field without operator|file name is not the rule_id"), ("A-3", "unknown operator|category does not fit the folder|no attributed source"), ("A-4", "no note on what is judged"))
def rule_files(spark: SparkSession) -> DataFrame:
    schema = "folder string, stem string, rule struct<rule_id:string,category:string,applies_to:string,evaluation:string,check:string,field:string,operator:string,note:string,source:string,source_url:string>"
    own = lambda i, c="seo", e="mechanical", f="title", o="is_null", n=None, s="S": (i, c, "page", e, "c", f, o, n, s, "https://s.test")
    rows = [("seo", "A-1", own("A-1")), ("seo", "A-2", own("A-9", o=None)), ("seo", "A-3", own("A-3", c="geo", o="near", s=" ")), ("seo", "A-4", own("A-4", e="llm_interpreted", f=None, o=None))]
    found = records.rule_problems(spark.createDataFrame(rows, schema), {"seo": ("seo",)})
    return found.select(F.col("stem").alias("item"), F.array_join("problems", "|").alias("value"))


@fixture(("r1", "3"), ("r2", "1"), ("r3", "2"))
def rule_catalog_merged(spark: SparkSession) -> DataFrame:
    """Stored rules, newest versions first, override the catalog's."""
    own = spark.createDataFrame([("r1", 2), ("r1", 3), ("r3", 2)], "rule_id string, version int")
    return _pairs(rules.merged_catalog(rules.latest_versions(own), spark.createDataFrame([("r1", 1), ("r2", 1)], "rule_id string, version int")), "rule_id", "version")


@fixture(("code", "code:a.py:f:3|a.py:3#f"), ("page", "page:https://p|https://p"), ("knowledge", "knowledge:R|R"), ("other", "other:id|id"), ("clip", "600"), ("metadata", "file_path=a.py,start_line=3"), ("graph", "graph:n K file|code"), ("collections", "knowledge;code;code,page,knowledge"))
def retrieval_kernels(spark: SparkSession) -> DataFrame:
    p = lambda **own: F.struct(*[F.lit(own.get(f)).cast("int" if f == "start_line" else "string").alias(f) for f in ("file_path", "symbol", "name", "start_line", "url", "rule_id")])
    code = p(file_path="a.py", name="f", start_line=3)
    both = lambda s, x: F.concat_ws("|", records.dedupe_key(F.lit(s), F.lit("id"), x), records.locator(F.lit(s), F.lit("id"), x))
    clip = records.compressed(F.lit("x" * 700), code, ["file_path", "start_line", "url"])
    hit = records.graph_hit({c: F.lit({"name": "n", "kind": "K", "file_path": "file"}.get(c)).cast("string") for c in ("name", "kind", "file_path", "url", "title", "rule_id", "relation", "stable_id")})
    routed = ";".join(",".join(records.collections(t, project)) for t, project in (([], None), (["code"], 1), ([], 1)))
    return _one(spark, code=both("code", code), page=both("page", p(url="https://p")), knowledge=both("knowledge", p(rule_id="R")), other=both("other", p()), clip=F.length(clip["summary"]), metadata=F.array_join(F.transform(F.array_sort(F.map_entries(clip["metadata"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ","), graph=F.concat_ws("|", hit["id"], hit["source_type"]), collections=F.lit(routed))


@fixture(("plain", "R on u: expected e; observed 1."), ("keyword", 'SEO-KEYWORD-FOCUS-001 on u: expected e; observed {"missing_from_title_and_description":["a","b"]}. Missing keyword(s) from title and meta description: "a", "b".'), ("open", "severity,evidence"), ("template", "true,false"), ("research", "true,true,true,false"), ("gaps", "qdrant,neo4j,retrieval"), ("distinct", "a:1,b:2"), ("derived", "loc|sum|derived|high"), ("upgrade", "code_change,code_or_platform_change,recommend_only,code_change"), ("type", "meta_description"), ("status", "failed,partial,succeeded"), ("redacted", "[redacted]"), ("fingerprint", '{"a":1,"b":null}'))
def finding_kernels(spark: SparkSession) -> DataFrame:
    lit, many = F.lit, lambda *c: F.concat_ws(",", *[x.cast("string") for x in c])
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    gap = lambda a, b: F.struct(F.lit(a).alias("capability"), F.lit(b).alias("detail"))
    full = {f: lit("x") for f in records.TEMPLATE_FIELDS}
    item = F.struct(*[lit(v).alias(k) for k, v in (("id", "i"), ("source_type", "page"), ("channel", "c"), ("score", "1"), ("locator", "loc"), ("summary", "sum"), ("authority", "high"))])
    got = F.get(records.retrieved_rows(F.array(item)), lit(0))
    hits = records.hit_bytes(spark.sql("SELECT null AS b, 1 AS a"))
    return _one(
        spark,
        plain=records.observation(lit("R"), lit("u"), lit("e"), lit("1")),
        keyword=records.observation(lit("SEO-KEYWORD-FOCUS-001"), lit("u"), lit("e"), lit('{"missing_from_title_and_description":["a","b"]}')),
        open=F.array_join(records.unanswered({"rule": lit("r"), "severity": lit(" ")}, words()), ","),
        template=many(records.can_template(lit("HIGH"), full), records.can_template(lit("high"), full | {"risk": lit(" ")})),
        research=many(*[records.matches_research(lit("https://a.test/x/"), lit("SEO-T-1"), words(*p), words(*n)) for p, n in (((), ()), (("https://A.test/x",), ()), ((), ("seo-t",)), (("https://b.test",), ("geo",)))]),
        gaps=many(*[records.gap_capability(lit(x)) for x in ("Qdrant down", "graph timeout", "x")]),
        distinct=F.array_join(F.transform(records.distinct_gaps(F.array(gap("a", "1"), gap("b", "2"), gap("a", "1"))), lambda g: F.concat_ws(":", g["capability"], g["detail"])), ","),
        derived=F.concat_ws("|", got["source"], got["excerpt"], got["confidence"], got["source_authority"]),
        upgrade=many(*[findings.upgraded_actionability(lit(s), lit(r), lit(p)) for s, r, p in (("recommend_only", True, False), ("recommend_only", True, True), ("recommend_only", False, True), ("code_change", False, False))]),
        type=changes.experiment_type(lit("SEO-METADESC-MISSING-001")),
        status=many(*[changes.report_status(lit(r), words(*g)) for r, g in ((False, ()), (True, ("x",)), (True, ()))]),
        redacted=changes.redacted(lit("my API_KEY is 1")),
    ).union(hits.select(lit("fingerprint"), "canonical"))


@fixture(("window", "2024-02-02..2024-02-29"), ("series", "2023-12-02..2024-02-29"), ("day", "2024-01-02,-"), ("excerpt", "Page p: 10 impressions, 5.0% CTR, avg position 3.3; top query 'q' (7 impressions)"), ("signed", "+1.50pp|-2.00|+0.25|+1,200|-3|—"), ("tone", "good,fair,poor,unavailable"), ("index", "7,9"), ("clock", "09:00|07:30|-"), ("zone", "2024-03-01 05:30:00"), ("scale", "25"), ("authority", "1,0,-1"))
def report_kernels(spark: SparkSession) -> DataFrame:
    lit, day = F.lit, F.lit(dt.date(2024, 3, 1))
    span = lambda n: F.concat_ws("..", records.window_of(day, n)["start"].cast("string"), records.window_of(day, n)["end"].cast("string"))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    at = lambda raw: F.coalesce(F.format_string("%02d:%02d", records.clock(F.lit(raw))["hour"], records.clock(F.lit(raw))["minute"]), F.lit("-")) if raw != "25:00" else dash(records.clock(F.lit(raw))["hour"])
    block = records.indexability(lit('{"page_count": 7, "sitemap": {"page_url_count": 9}}'), lit("done"), lit(None).cast("string"), lit(1.0), lit(0))
    return _one(
        spark,
        window=span(records.LOOKBACK_DAYS),
        series=span(records.SERIES_DAYS),
        day=F.concat_ws(",", dash(records.search_day(lit(" 2024-01-02T05:00"))), dash(records.search_day(lit("soon")))),
        excerpt=records.search_excerpt(lit("p"), lit(10), lit(0.05), lit(3.3), F.array(F.struct(lit("q").alias("query"), lit(7).alias("impressions")))),
        signed=F.concat_ws("|", records.signed(lit(0.015), "percent"), records.signed(lit(-2.0), "position"), records.signed(lit(0.25)), records.signed(lit(1200)), records.signed(lit(-3)), records.signed(lit(None).cast("double"))),
        tone=F.concat_ws(",", *[records.score_tone(lit(v).cast("double"), lit(m)) for v, m in ((80, 100), (35, 50), (1, 0), (None, 100))]),
        index=F.concat_ws(",", block["crawled_pages"].cast("string"), block["sitemap_url_count"].cast("string")),
        clock=F.concat_ws("|", F.format_string("%02d:%02d", records.clock(lit(None).cast("string"))["hour"], records.clock(lit(None).cast("string"))["minute"]), at("7:30"), at("25:00")),
        zone=records.in_zone(lit("2024-03-01 00:00:00").cast("timestamp"), lit("Asia/Kolkata")),
        scale=records.rescaled(lit(50), 20, 30),
        authority=F.concat_ws(",", *[records.authority_compare(lit(a), lit(b)).cast("string") for a, b in (("standard", "research"), ("research", "research"), ("community", "standard"))]),
    )


@fixture(("locators", "/h|/s|https://t|x.png"), ("needles", "https://a.test/b|/b"), ("located", "true"), ("folded", "true,true,false"), ("noop", "no_files,no_op,comment_only_diff,-"), ("stats", "2,1,6"), ("types", "FooBar,BazQux"), ("ld_text", "N D"), ("symbols", "a,b,c"), ("scope", "token"))
def change_kernels(spark: SparkSession) -> DataFrame:
    lit = F.lit
    diff = lambda a, r, d: F.struct(F.lit(a).alias("lines_added"), F.lit(r).alias("lines_removed"), F.lit(d).alias("unified_diff"))
    none = F.array().cast("array<struct<lines_added:int,lines_removed:int,unified_diff:string>>")
    stats = records.diff_stats(lit("a\nb"), lit("a\nc\nd\n"))
    return _one(
        spark,
        locators=F.concat_ws("|", F.array_join(records.evidence_locators(F.array(lit('{"href": "/h", "src": "/s"}'), lit('{"href": "/h"}')), lit("p -> https://t")), "|"), F.get(records.evidence_locators(F.array(lit("{}")), lit("p img:x.png")), lit(0))),
        needles=F.array_join(records.locator_needles(lit("https://a.test/b")), "|"),
        located=records.located(F.array(lit("<a href=/b>")), records.locator_needles(lit("https://a.test/b"))),
        folded=F.concat_ws(",", records.text_in_content(lit("It&rsquo;s  a — Test"), lit("it's a - TEST")).cast("string"), records.text_in_content(lit("y" * 40), lit("x" * 10 + "y" * 40)).cast("string"), records.text_in_content(lit("a"), lit(" ")).cast("string")),
        noop=F.concat_ws(",", records.noop(none), records.noop(F.array(diff(0, 0, ""))), records.noop(F.array(diff(1, 0, "+++ b/x\n+// note\n+"))), F.coalesce(records.noop(F.array(diff(1, 0, "+ code"))), lit("-"))),
        stats=F.concat_ws(",", *[stats[c].cast("string") for c in ("added", "removed", "bytes")]),
        types=F.array_join(records.type_names(lit("FooBar is not BazQux or FooBar, Type x")), ","),
        ld_text=records.json_ld_text(lit('{"name": "N", "x": {"description": "D", "url": "u"}}')),
        symbols=F.array_join(records.symbol_union(F.array(lit("c"), lit("a")), F.array(lit("b"), lit("a"))), ","),
        scope=F.array_join(retrieval.token_set(lit("Token to")), ","),
    )


@fixture(("imports", "a/b.ts>a/c.ts"), ("imports", "a/b.ts>lib/index.ts"), ("calls", "s1>t1"), ("calls", "s2>t1"), ("calls", "s2>t2"), ("support", "b:1"), ("support", "c:2"), ("needle", "n1:0"), ("needle", "n2:1"), ("routes", "p"), ("files", "x"), ("count", "3"))
def code_graph(spark: SparkSession) -> DataFrame:
    """Imports and calls resolved, what files need, nodes by needle, and scans of stored collections."""
    pair = lambda rows, kind, a, b, sep=">": rows.select(F.lit(kind).alias("item"), F.concat_ws(sep, F.col(a).cast("string"), F.col(b).cast("string")).alias("value"))
    files = spark.createDataFrame([("a/c.ts",), ("lib/index.ts",), ("a/b.ts",)], "path string")
    imports = graph.resolved_imports(spark.createDataFrame([("a/b.ts", "./c"), ("a/b.ts", "../lib"), ("a/b.ts", "react")], "file_path string, target string"), files)
    symbols = spark.createDataFrame([("t1", "f", "x.py"), ("t2", "f", "y.py")], "stable_id string, name string, file_path string")
    calls = graph.code_edges(symbols, spark.createDataFrame([("s1", "x.py", "f"), ("s2", "z.py", "f")], "src string, file_path string, callee string"))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([("n1", "Shop page"), ("n2", "other"), ("n3", "x")], "node string, text string")
    near = records.needle_hits(nodes, spark.createDataFrame([("n1", "n2")], "src string, dst string"), ["SHOP"])
    rows = spark.createDataFrame([("p", "route", 1), ("x", "file", 1), ("x2", "file", 2)], "name string, kind string, project_id int")
    scan = lambda kind: records.stored(rows, ["name"], project_id=1, kind=kind)
    out = pair(imports, "imports", "file_path", "resolved").union(pair(calls, "calls", "src", "dst")).union(pair(records.supporting_files(edges, spark.sql("SELECT 'a' AS path")), "support", "path", "depth", ":")).union(pair(near, "needle", "node", "hop", ":"))
    return out.union(scan("route").select(F.lit("routes"), "name")).union(scan("file").select(F.lit("files"), "name")).union(rows.agg(F.count("*").cast("string").alias("n")).select(F.lit("count"), "n"))


@fixture(("next", "2024-01-01 00:15:00"), ("due", "1"), ("slot", "1:b:9"), ("slot", "2:c:8"), ("active", "1"), ("run", "1:failed"), ("run", "2:running"), ("run", "3:cancelled"), ("experiment", "proposed"), ("experiment", "running"), ("treated", "1:200:0.5"), ("treated", "2:-:0.2"), ("projects", "1"), ("sibling", "https://a.test/z"), ("gone", "f2:CLOSED"), ("ranked", "f2:2"), ("languages", "python"), ("skips", "directory:1"))
def jobs_and_changes(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame
    pair = lambda rows, kind, *c: rows.select(F.lit(kind).alias("item"), F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c]).alias("value"))
    now = spark.sql("SELECT 1 AS schedule_id, timestamp '2024-01-01 00:01:30' AS now")
    due = changes.due(spark.sql("SELECT 1 AS schedule_id, timestamp '2024-01-01 00:15:10' AS now, '2024-01-01T00:14' AS last_slot UNION ALL SELECT 2, timestamp '2024-01-01 00:15:10', '2024-01-01T00:15'"), "*/15 * * * *")
    state = records.marked(df([(1, "a", 7), (2, "c", 8)], "schedule_id int, slot string, job_id int"), df([(1, "b", 9)], "schedule_id int, slot string, job_id int"))
    jobs = df([(1, 1, "queued"), (2, 1, "running"), (3, 2, "failed")], "job_id int, project_id int, status string")
    runs = records.reconciled(df([(1, 3, "running"), (2, 2, "running"), (3, 4, "cancelled")], "run_id int, job_id int, status string"), jobs)
    experiments = records.created_experiments(df([(None, "h"), (5, "h")], "change_set_id int, hypothesis string"), df([(5, 1000.0)], "change_set_id int, baseline double"))
    treated = records.treated(df([(1, 1000), (2, None)], "experiment_id int, baseline int"), df([(1, 1200)], "experiment_id int, treatment int"))
    own = df([("f1", "seo", "OPEN", "r", 2.0), ("f2", "seo", "CLOSED", "r", 1.0)], "finding_id string, category string, status string, rule string, priority double")
    sibling = records.siblings(df([(0, "https://a.test/x/"), (1, "https://a.test/z"), (2, "https://a.test/z/")], "place int, url string"), spark.sql("SELECT 'https://a.test/x' AS url"), 5)
    files = df([(1, "a.py"), (1, "b.py"), (1, "c.ts")], "project int, path string")
    skipped = df([("node_modules/x.js", 5), ("a.py", 5)], "path string, length long").groupBy(changes.skip_reason(F.col("path"), F.col("length")).alias("reason")).agg(F.count("*").alias("n")).filter("reason is not null")
    parts = [pair(changes.next_fire(now, "*/15 * * * *", days=1), "next", "next_at"), pair(due, "due", "schedule_id"), pair(state, "slot", "schedule_id", "slot", "job_id"), pair(records.has_active(jobs), "active", "project_id"), pair(runs, "run", "run_id", "status"), pair(experiments, "experiment", "status")]
    parts += [pair(treated, "treated", "experiment_id", "delta", "confidence"), pair(records.visible_projects(df([(1, 7), (2, 8)], "id int, owner_id int"), 7, False), "projects", "id"), pair(sibling, "sibling", "url"), pair(records.omitted(own, ("seo",), findings.ACTIONABLE), "gone", "finding_id", "status"), pair(records.with_siblings(own, "f2"), "ranked", "finding_id", "rank"), pair(changes.language_majority(files, "project"), "languages", "language"), pair(skipped, "skips", "reason", "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@fixture(("replaced", "b"), ("kept", "a,c"), ("created", "1"), ("unchanged", "1"), ("versioned", "1"), ("absent", "k1:old,k2:new"), ("text", "T C|u"), ("rows", "page:p1,query:q1"), ("latest", "2"), ("previous", "1"), ("top", "q1"), ("document", '{"a":1}'), ("total", "150:200:75.0"), ("excerpts", "e1"), ("rerank", "d2,d1"), ("embedding", "1.0"))
def index_and_report_plans(spark: SparkSession) -> DataFrame:
    df, lit = spark.createDataFrame, F.lit
    joined = lambda rows, kind, c: rows.agg(F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), ",").alias("value")).select(F.lit(kind).alias("item"), "value")
    store = df([("a",), ("b",), ("c",)], "k string")
    versions = index.outcome_counts(df([("k1", 1, "x"), ("k2", 1, "x")], "k string, version int, v string"), df([("k1", "x"), ("k2", "y"), ("k3", "z")], "k string, v string"), "k", ["v"])
    absent = index.inserted_if_absent(df([("k1", "old")], "k string, v string"), df([("k1", "new"), ("k2", "new")], "k string, v string"), "k")
    facts = df([(1, 2, "page", "p1", None, 5), (2, 2, "query", None, "q1", 9), (3, 1, "query", None, "q0", 99)], "id int, analysis_run_id int, dimension string, page string, query string, impressions int")
    shown = records.default_rows(facts, 5).select(F.concat_ws(":", "dimension", F.coalesce("page", "query")).alias("v"))
    ranked = df([("q", "d1", 1, 0.2), ("q", "d2", 2, 0.9)], "query_id string, doc_id string, rank int, s double")
    order = retrieval.reranked(ranked, F.col("s")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "doc_id"))), lambda x: x["doc_id"]).alias("d")).select(lit("rerank"), F.array_join("d", ","))
    vector = retrieval.hash_embedding(lit("x"), 384)
    evidence = findings.evidence_by_rule(spark.sql("SELECT 'r' AS rule, 'f' AS finding_id, 'u' AS affected_resource, array(named_struct('excerpt', 'e1')) AS evidence"))
    parts = [
        joined(store.filter("k = 'b'"), "replaced", "k"), joined(index.without(store, F.col("k") == "b"), "kept", "k"), versions.select("outcome", F.col("n").cast("string")), joined(absent.select(F.concat_ws(":", "k", "v").alias("x")), "absent", "x"),
        _one(spark, text=F.concat_ws("|", index.page_text(lit("T"), lit("C"), lit("u")), index.page_text(lit(""), lit(" "), lit("u")))), joined(shown, "rows", "v"), search.latest_run(facts).select(lit("latest"), F.col("analysis_run_id").cast("string")),
        search.previous_run(facts, 2).select(lit("previous"), F.col("analysis_run_id").cast("string")), search.top_rows(facts.filter("analysis_run_id = 2"), 1).select(lit("top"), "query"),
        records.report_document(part=spark.sql("SELECT 1 AS a")).select(lit("document"), F.regexp_replace("part", r"^\[|\]$", "")), findings.total_score(df([(70, 100), (80, 100)], "value int, max_value int")).select(lit("total"), F.concat_ws(":", F.col("value").cast("string"), F.col("max_value").cast("string"), F.col("percent").cast("string"))),
        evidence.select(lit("excerpts"), "excerpt"), order, _one(spark, embedding=F.round(retrieval.dot(vector, vector), 6)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@fixture(("h", "3,2"), ("gap", "4-5"), ("stuff", "keyword_stuffing:zap 6 0"), ("stat", "unsupported_statistic:40%"), ("removed", "content_removed:"), ("packs", "0,0,1"))
def text_kernels(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame
    heads = records.source_headings(df([("f.tsx", 'a\n<h2>x</h2>\n<EText as="h3">')], "path string, text string")).filter("level = 3 or level = 2").agg(F.concat_ws(",", F.max("line").cast("string"), F.min("line").cast("string")).alias("value")).select(F.lit("h").alias("item"), "value")
    left = text.uncovered(text.lines(df([(1, "a\nb\nc\nd\ne")], "doc_id int, text string")), df([(1, 1, 3)], "doc_id int, first int, last int")).select(F.lit("gap"), F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    said = text.content_changes(df([("stuff", "a", "zap zap zap zap zap zap"), ("stat", "b", "now 40% more"), ("removed", "c", " ")], "doc_id string, before string, after string"))
    packs = text.packed(df([("k", 1, 2), ("k", 2, 2), ("k", 3, 2)], "k string, o int, c int"), "k", "o", "c", most=2, budget=9).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "batch"))), lambda x: x["batch"].cast("string")), ",").alias("v"))
    return heads.union(left).union(said.select("doc_id", F.concat_ws(":", "rule", "detail"))).union(packs.select(F.lit("packs"), "v"))
