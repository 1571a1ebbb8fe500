from pyspark.sql import functions as F

from plumbline.functions import pages, urls


def _one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first()["x"]


def test_normalized_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a#frag": "http://www.example.com/a/b?b=2&a=",
        "https://example.com": "https://example.com/",
        "https://example.com:8443/": "https://example.com:8443/",
        "ftp://example.com/x": None,
        "not a url": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.normalized(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in rows} == cases


def test_absolute_hrefs(spark):
    base = "https://e.com/a/b?x=1"
    cases = {"/c": "https://e.com/c", "c": "https://e.com/a/c", "?y=2": "https://e.com/a/b?y=2", "//f.org/z": "https://f.org/z", "http://g.net": "http://g.net", "": "https://e.com/a/b"}
    rows = spark.createDataFrame([(h, base) for h in cases], "h string, b string").select("h", urls.absolute(F.col("h"), F.col("b")).alias("a")).collect()
    assert {r["h"]: r["a"] for r in rows} == cases


def test_hosts_and_routes(spark):
    assert _one(spark, urls.registrable_domain(F.col("u")), u="https://www.shop.example.com/x") == "example.com"
    assert _one(spark, urls.page_key(F.col("u")), u="HTTPS://E.com/Path/?q=1") == "https://e.com/Path"
    assert _one(spark, urls.same_site(F.col("a"), F.col("b")), a="http://www.e.com/x", b="https://e.com/") is True
    assert _one(spark, urls.route_pattern(F.col("r")), r="/p/[id]/[...rest]") == "^/p/[^/]+/.*/?$"
    assert _one(spark, urls.app_route(F.col("f")), f="src/app/(shop)/items/[id]/page.tsx") == "/items/[id]"
    assert _one(spark, urls.app_route(F.col("f")), f="src/lib/page.ts") is None
    assert [_one(spark, urls.is_private_host(F.col("h")), h=h) for h in ("127.0.0.1", "10.1.2.3", "localhost", "example.com", "172.20.0.1")] == [True, True, True, False, True]


LEAD = " ".join(["It is this and that."] * 5)
HTML = """<html lang="en"><head><title> A  &amp; B </title><meta name="description" content="about"><meta property="og:title" content="T1"><meta property="og:title" content="T2">
<meta property="og:url" content="u"><link rel="canonical" href="/canon"><link rel="alternate" hreflang="de" href="/de">
<script type="application/ld+json">{"@type": "Organization", "name": "Acme"}</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="/menu">m</a></nav><h1>One</h1><h3>What is it?</h3><p>{LEAD}</p><h3>Why so short?</h3><p>It is this.</p><img src="/i.png" alt=""><img src="data:x"><img src="/j.png" width="10" style="height: 20px">
<a href="https://other.org/x">o</a><script>navigator.registerTool({name: "buy", description: "Buy it"})</script><form toolname="find"></form></body></html>""".replace("{LEAD}", LEAD)


def test_page_model(spark):
    row = pages.page_model(spark.createDataFrame([(1, "https://e.com/a", HTML)], "page_id long, url string, html string")).first()
    assert (row["language"], row["meta_description"], row["canonical"]) == ("en", "about", "https://e.com/canon")
    assert [(h["level"], h["text"]) for h in row["headings"]] == [(1, "One"), (3, "What is it?"), (3, "Why so short?")]
    assert [(x["href"], x["internal"]) for x in row["links"]] == [("https://e.com/menu", True), ("https://other.org/x", False)]
    assert [(i["src"], i["alt"], i["width"], i["height"]) for i in row["images"]] == [("https://e.com/i.png", "", None, None), ("data:x", None, None, None), ("https://e.com/j.png", None, 10, 20)]
    assert [b["parse_error"] is None for b in row["structured_data"]] == [True, False]
    assert [(q["text"], q["answer"]) for q in row["questions"]] == [("What is it?", LEAD), ("Why so short?", None)]
    assert row["open_graph"] == {"og:title": "T2", "og:url": "u"}
    assert [(h["lang"], h["href"]) for h in row["hreflang"]] == [("de", "https://e.com/de")]
    assert [(t["name"], t["registration"], t["description_missing"]) for t in row["agent_tools"]] == [("buy", "imperative", False), ("find", "declarative", True)]
    assert "menu" not in row["content"] and LEAD in row["content"]


def test_empty_and_null_pages(spark):
    rows = pages.page_model(spark.createDataFrame([("https://e.com/", None), (None, ""), ("x", "<p><b>")], "url string, html string")).collect()
    assert [r["word_count"] for r in rows] == [0, 0, 0] and all(r["title"] is None for r in rows)
