"""The page model: raw HTML to a nested page record with Column expressions only.

Tags are found by patterns and attributes inside a tag in any order and any quoting (double, single, none). JSON-LD is
read as a variant: lists and @graph give one block for each object. Malformed markup gives empty fields, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls
from .agent_tools import detected

SPACES = r"[ \t\n\r\f]+"
#: Elements whose text a reader does not see as content.
CHROME = ("script", "style", "noscript", "nav", "footer", "head")
FAQ_TYPES = ("FAQPage", "QAPage")
#: Words of a paragraph that answers the question above it.
LEAD_WORDS = (20, 120)
SPA_ROOTS, SPA_SCRIPTS, SPA_WORDS = ("root", "app", "__next"), 3, 20
_HEADING = r"(?is)<h([0-9])\b[^>]*>(.*?)</h[0-9]\s*>"
_COMMENT = r"(?s)<!--.*?-->"
#: Entities that are decoded; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain(markup: Column) -> Column:
    """Text without tags, with the common entities decoded."""
    return collapsed(unescaped(F.regexp_replace(markup, "<[^>]*>", " ")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def tags(html: Column, name: str) -> Column:
    """The start tags of an element, as they are written."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, however it is quoted; empty if it has none, null where the attribute is missing."""
    here = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))"
    value = F.concat(*[F.regexp_extract(tag, here, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(here), unescaped(value)).when(tag.rlike(rf"(?is)\s{name}(?=[\s/>])"), F.lit(""))


def visible_text(html: Column) -> Column:
    """What a reader sees as content: no comments, scripts, styles, navigation, footer or head."""
    return plain(F.regexp_replace(html, rf"(?is)<({'|'.join(CHROME)})\b[^>]*>.*?</\1\s*>", " "))


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).cast("int")


def metas(html: Column) -> Column:
    """All meta tags: name and property as written and their content."""
    return F.transform(tags(html, "meta"), lambda t: F.struct(F.trim(attribute(t, "name")).alias("name"), F.trim(attribute(t, "property")).alias("property"), attribute(t, "content").alias("content")))


def meta(found: Column, name: str) -> Column:
    """The content of the first meta of a name that has one."""
    own = F.filter(found, lambda m: (F.lower(m["name"]) == name) & m["content"].isNotNull())
    return blank_to_null(F.trim(F.get(own, F.lit(0))["content"]))


def _prefixed(found: Column, key: str, prefix: str) -> Column:
    """Metas with a prefix as a map; the last one of a name wins."""
    own = F.filter(found, lambda m: F.lower(m[key]).startswith(prefix) & m["content"].isNotNull())
    last = F.filter(F.transform(own, lambda m, i: F.struct(m[key].alias("k"), m["content"].alias("v"), i.alias("i"))), lambda m: ~F.exists(F.slice(own, m["i"] + 2, F.size(own) + 1), lambda o: o[key] == m["k"]))
    return F.map_from_entries(F.transform(last, lambda m: F.struct(m["k"], m["v"])))


def headings(html: Column) -> Column:
    """Levels and texts in the order of the page; what has no text is no heading."""
    levels, texts = F.regexp_extract_all(html, F.lit(_HEADING), F.lit(1)), F.regexp_extract_all(html, F.lit(_HEADING), F.lit(2))
    return F.filter(F.zip_with(levels, texts, lambda level, text: F.struct(level.cast("int").alias("level"), plain(text).alias("text"))), lambda h: h["text"] != "")


def links(html: Column, base: Column) -> Column:
    """Targets in the order of the page, given the parts of its url, whether they stay on its site, and their rel."""

    def link(x: Column) -> Column:
        return F.struct(urls.normal_of(x["p"]).alias("href"), (urls.site_of(x["p"]) == urls.site_of(base)).alias("internal"), x["rel"].alias("rel"))

    found = F.filter(F.transform(tags(html, "a(?:rea)?"), lambda t: F.struct(attribute(t, "href").alias("href"), attribute(t, "rel").alias("rel"))), lambda t: t["href"] != "")
    split = F.transform(found, lambda t: F.struct(urls.parts(urls.absolute_of(F.trim(t["href"]), base)).alias("p"), t["rel"]))
    return F.filter(F.transform(split, link), lambda x: x["href"].isNotNull())


def _pixels(tag: Column, name: str) -> Column:
    styled = F.regexp_extract(attribute(tag, "style"), rf"(?i)(?:^|[;\s]){name}\s*:\s*([0-9]+(?:\.[0-9]+)?)px", 1)
    found = F.coalesce(*[F.when(x > 0, x) for x in (F.trim(attribute(tag, name)).try_cast("double").try_cast("int"), styled.try_cast("double").try_cast("int"))])
    return found


def images(html: Column, base: Column) -> Column:
    """Images with a source: resolved (of an optimiser's address the asset inside), alt (null where missing), width and height."""

    def image(tag: Column) -> Column:
        src = F.trim(attribute(tag, "src"))
        inner = F.try_url_decode(F.regexp_extract(src, r"/_next/image/?\?(?:[^#]*&)?url=([^&#]*)", 1))
        real = F.when(inner.rlike("^(https?://|/)"), inner).otherwise(src)
        resolved = F.when(real.startswith("data:"), real).otherwise(urls.absolute_of(real, base))
        return F.struct(resolved.alias("src"), attribute(tag, "alt").alias("alt"), _pixels(tag, "width").alias("width"), _pixels(tag, "height").alias("height"))

    return F.transform(F.filter(tags(html, "img"), lambda t: attribute(t, "src") != ""), image)


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def json_ld(html: Column) -> Column:
    """The scripts of structured data, as they are written."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>.*?</script\s*>"), F.lit(0))
    own = F.filter(scripts, lambda s: F.lower(F.trim(attribute(F.regexp_extract(s, r"(?is)^<script\b[^>]*>", 0), "type"))) == "application/ld+json")
    return F.transform(own, lambda s: F.trim(F.regexp_extract(s, r"(?is)^<script\b[^>]*>\s*(.*?)\s*</script\s*>$", 1)))


def structured_data(raw: Column) -> Column:
    """JSON-LD blocks with their type: lists and @graph are opened, a block that cannot be read or is no object says so."""

    def opened(values: Column) -> Column:
        return F.flatten(F.transform(values, lambda v: F.coalesce(_get(v, "$", "array<variant>"), F.array(v))))

    def graphs(values: Column) -> Column:
        inner = lambda v: _get(v, "$['@graph']", "array<variant>")
        return F.flatten(F.transform(values, lambda v: F.when(F.size(inner(v)) > 0, inner(v)).otherwise(F.array(v))))

    def block(v: Column) -> Column:
        # a list of types is one text
        kind = F.coalesce(F.array_join(_get(v, "$['@type']", "array<string>"), ","), _get(v, "$['@type']"))
        wrong = F.when(_get(v, "$", "map<string,variant>").isNull(), F.lit("JSON-LD root is not an object"))
        return F.struct(F.lit("json-ld").alias("format"), kind.alias("type"), F.to_json(v).alias("raw"), _get(v, "$.author").alias("author"), _get(v, "$.datePublished").alias("date_published"), wrong.alias("parse_error"))

    def blocks(text: Column) -> Column:
        value = F.try_parse_json(text)
        nothing = F.lit(None).cast("string")
        bad = F.struct(F.lit("json-ld").alias("format"), nothing.alias("type"), text.alias("raw"), nothing.alias("author"), nothing.alias("date_published"), F.lit("not valid JSON").alias("parse_error"))
        return F.when(value.isNull(), F.array(bad)).otherwise(F.transform(graphs(opened(graphs(opened(F.array(value))))), block))

    return F.flatten(F.transform(raw, blocks))


def clean_text(markup: Column) -> Column:
    """Text of a structured answer: no tags, single spaces, null if nothing is left."""
    return blank_to_null(collapsed(F.regexp_replace(markup, "<[^>]+>", " ")))


def question_key(text: Column) -> Column:
    """What two spellings of a question have in common."""
    return F.trim(F.regexp_replace(collapsed(F.lower(text)), r"\?+$", ""))


def faq_pairs(blocks: Column) -> Column:
    """Questions with answers from structured data of the FAQ types: array of (text, answer)."""

    def pair(v: Column) -> Column:
        answer = F.coalesce(_get(v, "$.acceptedAnswer", "variant"), _get(v, "$.suggestedAnswer", "variant"))
        first = F.coalesce(F.get(_get(answer, "$", "array<variant>"), F.lit(0)), answer)
        said = F.when(_get(first, "$", "map<string,variant>").isNotNull(), _get(first, "$.text")).otherwise(_get(first, "$"))
        return F.struct(clean_text(_get(v, "$.name")).alias("text"), clean_text(said).alias("answer"))

    own = F.filter(blocks, lambda b: F.arrays_overlap(F.split(b["type"], r"[,\s]+"), F.array(*map(F.lit, FAQ_TYPES))))
    listed = F.flatten(F.transform(own, lambda b: F.coalesce(_get(F.try_parse_json(b["raw"]), "$.mainEntity", "array<variant>"), F.array().cast("array<variant>"))))
    return F.filter(F.transform(listed, pair), lambda p: p["text"].isNotNull() & p["answer"].isNotNull())


def answer_lead(html: Column) -> Column:
    """The paragraph after the first question heading that has one, if it is as long as an answer."""
    texts, levels = F.regexp_extract_all(html, F.lit(_HEADING), F.lit(2)), F.regexp_extract_all(html, F.lit(_HEADING), F.lit(1))
    after = F.slice(F.split(html, _HEADING), F.lit(2), F.size(texts))
    parts = F.zip_with(F.arrays_zip(levels.alias("l"), texts.alias("t")), after, lambda h, s: F.struct(h["l"].isin("2", "3").alias("deep"), plain(h["t"]).endswith("?").alias("asks"), F.regexp_extract(s, r"(?is)<p\b[^>]*>(.*?)</p\s*>", 0).alias("p")))
    first = plain(F.get(F.filter(parts, lambda x: x["deep"] & x["asks"] & (x["p"] != "")), F.lit(0))["p"])
    return F.when(F.size(F.split(first, " ")).between(*LEAD_WORDS), first)


def questions(heads: Column, pairs: Column, lead: Column) -> Column:
    """Question headings with their structured answer, the first one without with the lead, then structured questions that no heading asks."""
    asked = F.filter(heads, lambda h: h["level"].isin(2, 3) & h["text"].endswith("?"))
    answers = F.transform(pairs, lambda p: F.struct(question_key(p["text"]).alias("k"), p["answer"].alias("a")))
    met = F.transform(asked, lambda h: F.struct(h["text"].alias("text"), F.try_element_at(F.filter(answers, lambda a: a["k"] == question_key(h["text"])), F.lit(-1))["a"].alias("answer")))
    open_at = F.array_position(F.transform(met, lambda q: q["answer"].isNull()), True)
    led = F.transform(met, lambda q, i: F.struct(q["text"].alias("text"), F.when(i + 1 == open_at, F.coalesce(q["answer"], lead)).otherwise(q["answer"]).alias("answer")))
    more = F.filter(pairs, lambda p: ~F.exists(asked, lambda h: question_key(h["text"]) == question_key(p["text"])))
    return F.concat(led, more)


def hreflangs(found: Column, base: Column) -> Column:
    """Alternates from the link tags: language and normalised address."""
    own = F.filter(found, lambda t: (attribute(t, "hreflang") != "") & (attribute(t, "href") != ""))
    return F.transform(own, lambda t: F.struct(F.trim(attribute(t, "hreflang")).alias("lang"), urls.normalized(urls.absolute_of(F.trim(attribute(t, "href")), base)).alias("href")))


def canonical(found: Column, base: Column) -> Column:
    """The address of the first canonical link tag; null if that has none."""
    own = F.filter(found, lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    href = attribute(F.get(own, F.lit(0)), "href")
    return F.when(href != "", urls.absolute_of(F.trim(href), base))


def spa_shell_reason(html: Column) -> Column:
    """Why a page looks like the shell of a script application, or null."""
    root = rf"(?is)<(\w+)\b[^>]*\sid\s*=\s*[\"']?(?:{'|'.join(SPA_ROOTS)})[\"']?(?:\s[^>]*)?>\s*</\1\s*>"
    sources = F.size(F.filter(tags(html, "script"), lambda t: attribute(t, "src") != ""))
    body = plain(F.regexp_replace(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)", 1), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "))
    return (
        F.when(html.rlike(root), "empty application root")
        .when(sources >= SPA_SCRIPTS, "multiple client script bundles")
        .when(html.rlike(r"(?i)<noscript\b") & html.rlike(r"(?i)<body\b") & (word_count(body) < SPA_WORDS), "noscript fallback")
    )


def observations(html: Column) -> Column:
    """struct(question_headings, answer_lead, authorship, dates, spa_shell) of a page."""
    found, said = metas(html), lambda c, name: F.array_compact(F.array(F.when(c, F.lit(name))))
    tagged = lambda prefix: F.exists(found, lambda m: F.lower(m["property"]).startswith(prefix) & m["content"].isNotNull())
    by = F.exists(tags(html, "a"), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "author"))
    authorship = F.concat(said(meta(found, "author").isNotNull(), "author meta tag"), said(tagged("article:author"), "article:author meta tag"), said(by, "author relationship link"))
    dates = F.concat(said(tagged("article:published_time") | tagged("article:modified_time"), "article date metadata"), said(F.exists(tags(html, "time"), lambda t: attribute(t, "datetime").isNotNull()), "time datetime markup"))
    asked = F.transform(F.filter(headings(html), lambda h: h["level"].isin(2, 3) & h["text"].endswith("?")), lambda h: h["text"])
    return F.struct(asked.alias("question_headings"), answer_lead(html).alias("answer_lead"), authorship.alias("authorship"), dates.alias("dates"), spa_shell_reason(html).alias("spa_shell"))


def first_tools(tools: Column) -> Column:
    """The first tool of each registration and name."""
    key = lambda t: F.struct(t["registration"], t["name"])
    keys = F.transform(tools, key)
    return F.filter(tools, lambda t, i: F.array_position(keys, key(t)) == i + 1)


def merged_tools(declared: Column, runtime: Column) -> Column:
    """Tools of the html and of a browser's run: where there was a run its tools come first, and only forms whose name it does not have are added."""
    names = F.transform(runtime, lambda t: t["name"])
    forms = F.filter(declared, lambda t: (t["registration"] == "declarative") & ~F.coalesce(F.array_contains(names, t["name"]), F.lit(False)))
    return F.when(runtime.isNull(), first_tools(declared)).otherwise(first_tools(F.concat(runtime, forms)))


def page_model(pages: DataFrame) -> DataFrame:
    """Page records from pages (url, html); other columns are kept, html is not."""
    whole, html, url, base = F.coalesce(F.col("html"), F.lit("")), F.col("_html"), F.col("url"), F.col("_base")
    # comments say nothing; what later fields read several times comes first, so that none computes it anew
    rows = pages.withColumn("_html", F.regexp_replace(whole, _COMMENT, " "))
    rows = rows.withColumns({"_base": urls.parts(url), "_metas": metas(html), "_links": tags(html, "link"), "content": visible_text(html), "structured_data": structured_data(json_ld(html)), "headings": headings(html)})
    rows = rows.withColumn("_faq", faq_pairs(F.col("structured_data")))
    return rows.withColumns(
        {
            "title": blank_to_null(plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))),
            "meta_description": meta(F.col("_metas"), "description"),
            "canonical": canonical(F.col("_links"), base),
            "robots_meta": meta(F.col("_metas"), "robots"),
            "links": links(html, base),
            "images": images(html, base),
            "entities": F.array().cast("array<struct<name:string,type:string>>"),
            "questions": questions(F.col("headings"), F.col("_faq"), answer_lead(html)),
            "language": blank_to_null(F.trim(attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang"))),
            "hreflang": hreflangs(F.col("_links"), base),
            "open_graph": _prefixed(F.col("_metas"), "property", "og:"),
            "twitter": _prefixed(F.col("_metas"), "name", "twitter:"),
            "viewport": meta(F.col("_metas"), "viewport"),
            "word_count": word_count(F.col("content")),
            "raw_html_hash": F.sha2(whole, 256),
            "agent_tools": detected(html),
        }
    ).drop("html", "_html", "_base", "_metas", "_links", "_faq")


def crawled_rows(crawl: DataFrame) -> DataFrame:
    """Rows for page_model() from a crawl's (url, body binary, headers map): html as UTF-8, and the robots header."""
    header = F.try_element_at(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == "x-robots-tag"), F.lit(1))["value"]
    more = [c for c in crawl.columns if c not in ("body", "headers")]
    return crawl.select(*more, F.decode("body", "UTF-8").alias("html"), header.alias("x_robots_tag"))
