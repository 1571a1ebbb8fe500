"""Kernels of evidence, search facts, reports, changes and stored collections, as Column expressions and small plans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import urls
from . import rules

# Fixed values.
SUMMARY_CHARS, TEXT_CHARS, RERANK_CHARS, TAIL_CHARS = 600, 4000, 2000, 40
LOOKBACK_DAYS, SERIES_DAYS = 28, 90
METADATA = "file_path symbol start_line end_line url page_id rule_id authority source_url language chunk_type kind".split()
TEMPLATE_FIELDS = "finding_id observation recommended_action expected_mechanism risk".split()
SITE_CHECKS = "title_duplicate_across_pages meta_description_duplicate_across_pages exact_duplicate_content hreflang_not_reciprocal".split()
SYMBOL_KINDS = "Component Function Class Method Hook".split()


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def given(c: Column) -> Column:
    """A text, or null where it is blank."""
    return F.nullif(c.cast("string"), F.lit(""))


# Retrieval hits: id, source_type and the payload's fields.


def dedupe_key(source: Column, id_: Column, payload: Column) -> Column:
    """What makes two hits one: place in the code, page or rule."""
    code = F.concat(F.lit("code:"), _text(payload["file_path"]), F.lit(":"), F.coalesce(given(payload["symbol"]), given(payload["name"]), F.lit("")), F.lit(":"), _text(payload["start_line"]))
    return F.when(source == "code", code).when(source == "page", F.concat(F.lit("page:"), F.coalesce(given(payload["url"]), id_))).when(source == "knowledge", F.concat(F.lit("knowledge:"), F.coalesce(given(payload["rule_id"]), id_))).otherwise(F.concat(source, F.lit(":"), id_))


def locator(source: Column, id_: Column, payload: Column) -> Column:
    """Where a hit is, for a reader."""
    line = F.when(payload["start_line"].isNotNull(), F.concat(F.lit(":"), payload["start_line"].cast("string"))).otherwise("")
    symbol = F.coalesce(F.concat(F.lit("#"), F.coalesce(given(payload["symbol"]), given(payload["name"]))), F.lit(""))
    code = F.concat(F.coalesce(given(payload["file_path"]), given(payload["name"]), id_), line, symbol)
    return F.when(source == "code", code).when(source == "page", F.coalesce(given(payload["url"]), id_)).when(source == "knowledge", F.coalesce(given(payload["rule_id"]), id_)).otherwise(id_)


def compressed(text: Column, payload: Column, fields: list[str]) -> Column:
    """struct(summary, metadata): the first characters of a text, and what is known of the fields that evidence names."""
    known = F.map_from_entries(F.array_compact(F.array(*[F.when(payload[f].isNotNull(), F.struct(F.lit(f).alias("key"), payload[f].cast("string").alias("value"))) for f in METADATA if f in fields])))
    return F.struct(F.substring(text, 1, SUMMARY_CHARS).alias("summary"), known.alias("metadata"))


def graph_hit(row: Mapping[str, Column]) -> Column:
    """struct(id, text, source_type, score) of a graph row."""
    kind = _text(row["kind"])
    source = F.when((kind == "OptimizationRule") | given(row["rule_id"]).isNotNull(), "knowledge").when(kind.isin("Page", "URL", "Website") | given(row["url"]).isNotNull(), "page").otherwise("code")
    text = F.concat_ws(" ", *[given(row[c]) for c in ("name", "kind", "file_path", "url", "title", "rule_id", "relation")])
    return F.struct(F.concat(F.lit("graph:"), F.coalesce(given(row["stable_id"]), text)).alias("id"), text.alias("text"), source.alias("source_type"), F.lit(1.0).alias("score"))


def retrieved_rows(items: Column) -> Column:
    """Evidence of retrieved items (id, source_type, channel, score, locator, summary, authority): derived, not measured."""
    value = lambda i: F.to_json(F.struct(i["id"], i["source_type"], i["channel"], i["score"]))
    return F.transform(items, lambda i: F.struct(i["locator"].alias("source"), i["summary"].alias("excerpt"), i["locator"].alias("selector"), value(i).alias("value"), F.lit("derived").alias("confidence"), i["authority"].alias("source_authority")))


def collections(source_types: list[str], project_id: int | None) -> list[str]:
    """Which collections a scope searches: code and pages belong to a project, knowledge to none; no types means all."""
    wanted = lambda s: not source_types or s in source_types
    return [s for s in ("code", "page", "knowledge") if wanted(s) and (s == "knowledge" or project_id is not None)]


def needle_hits(nodes: DataFrame, edges: DataFrame, needles: list[str], seeds: int = 50, near: int = 50) -> DataFrame:
    """Nodes (node, text) that hold a needle and their neighbours: node, hop. Both are limited, least nodes first, as reports are."""
    hit = F.lit(False)
    for needle in needles[:12]:
        hit = hit | F.lower("text").contains(needle.lower())
    found = nodes.filter(hit).select("node").distinct().orderBy("node").limit(seeds)
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    next_to = both.join(F.broadcast(found), both["src"] == found["node"]).select(F.col("dst").alias("node")).distinct().join(F.broadcast(found), "node", "left_anti").orderBy("node").limit(near)  # `found` is limited
    return found.select("node", F.lit(0).alias("hop")).union(next_to.select("node", F.lit(1)))


def top_per_query(ranked: DataFrame, rules_: DataFrame, n: int = 8) -> DataFrame:
    """Evidence for each distinct rule: rules_ (rule_id) with hits ranked (rule_id, doc_id, score)."""
    w = Window.partitionBy("rule_id").orderBy(F.desc("score"), "doc_id")
    return ranked.join(rules_.select("rule_id").distinct(), "rule_id", "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# Findings.


def observation(rule: Column, resource: Column, expected: Column, observed_json: Column) -> Column:
    """A finding in words; of keyword findings with the keywords that are missing."""
    text = F.concat(rule, F.lit(" on "), resource, F.lit(": expected "), expected, F.lit("; observed "), F.coalesce(observed_json, F.lit("null")), F.lit("."))
    missing = F.from_json(F.get_json_object(observed_json, "$.missing_from_title_and_description"), "array<string>")
    quoted = F.array_join(F.transform(missing, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    return F.when((rule == "SEO-KEYWORD-FOCUS-001") & (F.size(missing) > 0), F.concat(text, F.lit(" Missing keyword(s) from title and meta description: "), quoted, F.lit("."))).otherwise(text)


def unanswered(fields: Mapping[str, Column], evidence: Column) -> Column:
    """The questions that a finding leaves open, in their order."""
    blank = [F.when(rules.is_blank(c), F.lit(q)) for q, c in fields.items()]
    return F.array_compact(F.array(*blank, F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, F.lit("evidence"))))


def can_template(confidence: Column, fields: Mapping[str, Column]) -> Column:
    whole = F.lit(True)
    for name in TEMPLATE_FIELDS:
        whole = whole & ~rules.is_blank(fields[name])
    return (F.lower(confidence) == "high") & whole


def urls_equal(a: Column, b: Column) -> Column:
    plain = lambda x: F.regexp_replace(F.lower(F.trim(x)), "/+$", "")
    return F.coalesce((a != "") & (b != "") & (plain(a) == plain(b)), F.lit(False))


def matches_research(resource: Column, rule: Column, pages: Column, needles: Column) -> Column:
    """Whether a finding is what research was about: one of its pages, or a rule whose name holds or is held by a needle; all if there are neither."""
    name = F.lower(F.coalesce(rule, F.lit("")))
    near = F.exists(needles, lambda n: (n != "") & (name != "") & (name.contains(n) | n.contains(name)))
    return ((F.size(pages) == 0) & (F.size(needles) == 0)) | F.exists(pages, lambda p: urls_equal(resource, p)) | near


def omitted(findings: DataFrame, categories: tuple[str, ...], actionable: tuple[str, ...]) -> DataFrame:
    """Findings of the categories that are closed: finding_id, status, rule."""
    return findings.filter(F.col("category").isin(list(categories)) & ~F.col("status").isin(list(actionable))).select("finding_id", "status", F.coalesce("rule", F.lit("")).alias("rule"))


def with_siblings(ranked: DataFrame, finding_id: str) -> DataFrame:
    """One finding with its rank in the whole run."""
    above = ranked.crossJoin(F.broadcast(ranked.filter(F.col("finding_id") == finding_id).select(F.col("finding_id").alias("_id"), F.col("priority").alias("_p")).limit(1)))  # one row
    place = above.agg(F.count_if((F.col("priority") > F.col("_p")) | ((F.col("priority") == F.col("_p")) & (F.col("finding_id") < F.col("_id")))).alias("before"))
    return ranked.filter(F.col("finding_id") == finding_id).crossJoin(F.broadcast(place)).withColumn("rank", F.col("before") + 1).drop("before")  # one row


def gap_capability(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.contains("qdrant"), "qdrant").when(low.contains("neo4j") | low.contains("graph"), "neo4j").otherwise("retrieval")


def distinct_gaps(gaps: Column) -> Column:
    """Each (capability, detail) once, in the order met."""
    return F.array_distinct(F.transform(gaps, lambda g: F.struct(_text(g["capability"]).alias("capability"), _text(g["detail"]).alias("detail"))))


def hit_bytes(hits: DataFrame) -> DataFrame:
    """One row for each hit: its canonical JSON (sorted keys) and the fingerprint of that."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(hits.columns)]), {"ignoreNullFields": "false"})
    return hits.select("*", body.alias("canonical"), F.sha2(body, 256).alias("fingerprint"))


# Fields by dotted path.


def resolved(schema: T.StructType, path: str) -> Column | None:
    """A field of nested structs or maps by its dotted path, or None where the schema has no such field."""
    kind: T.DataType = schema
    out: Column | None = None
    for part in path.split("."):
        if isinstance(kind, T.StructType) and part in kind.fieldNames():
            out = F.col(f"`{part}`") if out is None else out.getField(part)
            kind = kind[part].dataType
        elif isinstance(kind, T.MapType) and out is not None:
            out, kind = F.try_element_at(out, F.lit(part)), kind.valueType
        else:
            return None
    return out


def crawl_stat(stats: Column, field: str) -> Column:
    """A value of a crawl's statistics (JSON), which rules name with or without the prefixes under which they were stored."""
    bare = field
    for prefix in ("stats_json.crawl.", "stats_json.", "crawl."):
        if field.startswith(prefix):
            bare = field[len(prefix) :]
            break
    return F.coalesce(F.get_json_object(stats, f"$.crawl.{bare}"), F.get_json_object(stats, f"$.{bare}"), F.get_json_object(stats, f"$.{field}"))


def rule_problems(files: DataFrame, categories: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """folder, stem, problems of rule files (folder, stem, rule: struct of rule_id, category, applies_to, evaluation, check, field, operator, note, source, source_url)."""
    r = lambda c: F.col(f"rule.{c}")
    allowed = F.lit(False)
    for folder, own in categories.items():
        allowed = allowed | ((F.col("folder") == folder) & r("category").isin(list(own)))
    said = lambda c, text: F.when(F.coalesce(c, F.lit(True)), F.lit(text))
    return files.select(
        "folder",
        "stem",
        F.array_compact(
            F.array(
                said(rules.is_blank(r("check")), "conditions.check is blank"),
                said(~r("applies_to").isin("page", "crawl_run", "website"), "unknown applies_to"),
                said(~r("evaluation").isin("mechanical", "llm_interpreted"), "unknown evaluation"),
                F.when(r("operator").isNotNull() & ~r("operator").isin(rules.OPERATORS), F.lit("unknown operator")),
                F.when(r("field").isNotNull() & r("operator").isNull(), F.lit("field without operator")),
                F.when(r("field").isNull() & (r("evaluation") == "mechanical") & rules.is_blank(r("note")), F.lit("neither field nor note")),
                F.when((r("evaluation") == "llm_interpreted") & rules.is_blank(r("note")), F.lit("no note on what is judged")),
                said(r("rule_id") != F.col("stem"), "file name is not the rule_id"),
                said(~allowed, "category does not fit the folder"),
                said(rules.is_blank(r("source")) | ~r("source_url").rlike("^https?://"), "no attributed source"),
            )
        ).alias("problems"),
    )


# Search facts and reports.


def window_of(today: Column, days: int = LOOKBACK_DAYS) -> Column:
    """struct(start, end) of so many days that end yesterday."""
    return F.struct(F.date_sub(today, days).alias("start"), F.date_sub(today, 1).alias("end"))


def search_day(raw: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(raw), 1, 10), "yyyy-MM-dd")


def search_excerpt(page: Column, impressions: Column, ctr: Column, position: Column, queries: Column) -> Column:
    top = F.get(queries, F.lit(0))
    more = F.when(F.size(queries) > 0, F.concat(F.lit("; top query '"), top["query"], F.lit("' ("), top["impressions"].cast("string"), F.lit(" impressions)"))).otherwise("")
    return F.concat(F.lit("Page "), page, F.lit(": "), impressions.cast("string"), F.lit(" impressions, "), F.format_string("%.1f", ctr * 100), F.lit("% CTR, avg position "), F.format_string("%.1f", position), more)


def signed(value: Column, kind: str = "number") -> Column:
    """A difference as reports show it; a dash where there is none."""
    if kind == "percent":
        text = F.format_string("%+.2fpp", value.cast("double") * 100)
    elif kind == "position":
        text = F.format_string("%+.2f", value.cast("double"))
    else:
        small = F.regexp_replace(F.regexp_replace(F.format_string("%+.4f", value.cast("double")), "0+$", ""), r"\.$", "")
        text = F.when((F.abs(value) < 1) & (value != F.floor(value)), small).otherwise(F.concat(F.when(value > 0, "+").otherwise(""), F.format_number(value, 0)))
    return F.when(value.isNull(), F.lit("—")).otherwise(text)


def score_tone(value: Column, ceiling: Column) -> Column:
    share = 100 * value / F.coalesce(F.nullif(ceiling, F.lit(0)), F.lit(100))
    return F.when(value.isNull(), "unavailable").when(share >= 80, "good").when(share >= 60, "fair").otherwise("poor")


def indexability(stats: Column, status: Column, cap_reason: Column, crawlability: Column, errors: Column) -> Column:
    return F.struct(status.alias("crawl_status"), cap_reason.alias("cap_reason"), crawl_stat(stats, "page_count").try_cast("int").alias("crawled_pages"), crawl_stat(stats, "sitemap.page_url_count").try_cast("int").alias("sitemap_url_count"), crawlability.alias("crawlability"), errors.alias("technical_errors"))


def breakdown(rows: DataFrame, label: str, n: int | None = None) -> DataFrame:
    """label and the four metrics, most impressions first; with n the first ones, as a chart shows them."""
    out = rows.orderBy(F.desc("impressions"), label).select(F.col(label).alias("label"), "impressions", "clicks", "ctr", "position")
    return out if n is None else out.limit(n)


def latest_dimension_rows(rows: DataFrame, dimension: str, n: int) -> DataFrame:
    """Rows of a dimension of the newest run, most impressions first: the first n, which a reader asks for."""
    newest = rows.filter(F.col("dimension") == dimension).agg(F.max("analysis_run_id").alias("analysis_run_id"))
    return rows.filter(F.col("dimension") == dimension).join(F.broadcast(newest), "analysis_run_id").orderBy(F.desc("impressions"), F.desc("id")).limit(n)  # one row


def default_rows(rows: DataFrame, n: int) -> DataFrame:
    """What is shown without a chosen dimension: pages, then queries."""
    return latest_dimension_rows(rows, "page", n).unionByName(latest_dimension_rows(rows, "query", n))


def report_document(**sections: DataFrame) -> DataFrame:
    """One row with a JSON text of each section's rows (bounded report tables), in the order given."""
    out = None
    for name, rows in sections.items():
        one = rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


# Changes.


def evidence_locators(values: Column, resource: Column) -> Column:
    """Addresses that a finding is about: href and src of its evidence (JSON), then what its resource points to; each once."""
    listed = F.flatten(F.transform(values, lambda v: F.array(F.get_json_object(v, "$.href"), F.get_json_object(v, "$.src"))))
    after = lambda mark: F.when(resource.contains(mark), F.regexp_extract(resource, f"(?s){mark}(.*)$", 1))
    every = F.transform(F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.array(after(" -> "), after(" img:"))), lambda x: F.trim(x))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def locator_needles(address: Column) -> Column:
    """What to look for in source files: the address, then its path."""
    path = F.coalesce(given(F.regexp_extract(address, urls.URL, 4)), F.when(~address.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_extract(address, "^([^?#]*)", 1)))
    return F.array_distinct(F.array_compact(F.array(address, F.when((path != "") & (path != "/"), path))))


def located(files: Column, needles: Column) -> Column:
    """Whether one of the files holds one of the needles."""
    return F.exists(files, lambda f: F.exists(needles, lambda n: f.contains(n)))


def folded(text: Column) -> Column:
    """Text whose case, spaces, entities, quotes and dashes do not count."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "-"), ("&ndash;", "-"), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    plain = F.translate(text, "‘’‚‛“”„‟–—‐‑− ", "''''\"\"\"\"----- ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def text_in_content(content: Column, text: Column) -> Column:
    """Whether a text, or the end of it, is in a content."""
    wanted, held = folded(text), folded(content)
    return (wanted != "") & (held.contains(wanted) | held.contains(F.substr(wanted, F.greatest(F.length(wanted) - TAIL_CHARS + 1, F.lit(1)))))


def noop(diffs: Column) -> Column:
    """Why changed files (lines_added, lines_removed, unified_diff) are no change, or null."""
    total = F.aggregate(diffs, F.lit(0).cast("long"), lambda s, d: s + d["lines_added"] + d["lines_removed"])
    real = lambda x: x.rlike(r"^[+-](?![+-]{2}( |$))") & ~F.trim(F.substring(x, 2, 1 << 30)).rlike(r"^($|//|#|/\*|\*|<!--|\{/\*)")
    said = F.exists(diffs, lambda d: F.exists(F.split(d["unified_diff"], "\n"), real))
    return F.when(F.size(diffs) == 0, "no_files").when(total == 0, "no_op").when(~said, "comment_only_diff")


def diff_stats(before: Column, after: Column) -> Column:
    """struct(added, removed, bytes): lines by their counts, whatever their place, and the size of the new text."""
    lines = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x != "")
    extra = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.greatest(F.size(F.filter(a, lambda y: y == x)) - F.size(F.filter(b, lambda y: y == x)), F.lit(0)))
    return F.struct(extra(lines(after), lines(before)).alias("added"), extra(lines(before), lines(after)).alias("removed"), F.octet_length(F.coalesce(after, F.lit(""))).alias("bytes"))


def on_preview(live: Column, base: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), urls.path(live))


def siblings(crawled: DataFrame, targeted: DataFrame, n: int) -> DataFrame:
    """Other crawled pages (place, url) than the targeted (url), each once, the first n of the crawl."""
    key = F.coalesce(urls.normalized(F.col("url")), F.col("url"))
    rest = crawled.withColumn("key", key).join(targeted.select(key.alias("key")).distinct(), "key", "left_anti")
    return rest.groupBy("key").agg(F.min_by("url", "place").alias("url"), F.min("place").alias("place")).orderBy("place").limit(n).select("url")


def page_with_siblings(page: DataFrame, others: DataFrame) -> DataFrame:
    """A page among its siblings: a sibling with the page's url gives way."""
    return page.unionByName(others.join(page.select("url"), "url", "left_anti").select(*page.columns))


def source_headings(files: DataFrame) -> DataFrame:
    """path, line, level, code of heading tags, or components told to be one, in source files (path, text)."""
    pattern = r"<h([1-6])\b|\bas=[\"']h([1-6])[\"']"
    rows = files.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("i", "code"))
    level = F.zip_with(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)), F.regexp_extract_all("code", F.lit(pattern), F.lit(2)), lambda a, b: F.concat(a, b).cast("int"))
    return rows.select("path", (F.col("i") + 1).alias("line"), F.explode(level).alias("level"), F.substring(F.trim("code"), 1, 110).alias("code"))


def navigation_excerpts(files: DataFrame, pattern: str, around: int = 2, n: int = 5) -> DataFrame:
    """path, line, excerpt: the first n hits of a pattern in source files with the lines around them."""
    lines = F.split("text", "\n")
    hits = F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)))
    rows = files.select("path", lines.alias("lines"), F.explode(hits).alias("i"))
    start = F.greatest(F.col("i") - around, F.lit(0))
    return rows.select("path", (F.col("i") + 1).alias("line"), F.array_join(F.slice("lines", start + 1, F.col("i") - start + 1 + around), "\n").alias("excerpt")).orderBy("path", "line").limit(n)


def type_names(message: Column, noise: tuple[str, ...] = ("Type", "Property", "Error", "Promise", "Argument")) -> Column:
    """Names of types in a compiler's message, each once, the first twelve."""
    found = F.regexp_extract_all(message, F.lit(r"\b[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+\b"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~x.isin(list(noise)))), 1, 12)


def json_ld_text(raw: Column, keys: tuple[str, ...] = ("name", "text", "description", "headline", "articleBody")) -> Column:
    """The texts under the keys that hold content, at any depth, in the order of the document."""
    pattern = rf"\"(?:{'|'.join(keys)})\"\s*:\s*\"((?:[^\"\\]|\\.)*)\""
    return F.when(F.try_parse_json(raw).isNull(), raw).otherwise(F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), lambda x: F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" "))), " "))


def symbol_union(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_union(before, after))


def supporting_files(imports: DataFrame, targets: DataFrame, depth: int = 2, n: int = 8) -> DataFrame:
    """path, depth of the files that targets (path) import, directly or through others; imports (src, dst). The first n by depth and name, as a prompt holds no more."""
    found = frontier = targets.select("path", F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        step = imports.join(frontier.select(F.col("path").alias("src")), "src").select(F.col("dst").alias("path")).distinct()
        frontier = step.join(found.select("path"), "path", "left_anti").withColumn("depth", F.lit(d))
        found = found.union(frontier)
    return found.filter("depth > 0").orderBy("depth", "path").limit(n)


def detected_cms(files: DataFrame, markers: list[tuple[str, str]]) -> DataFrame:
    """The first content system, in the order of markers (name, pattern), whose pattern a file's text meets; files has project, path, text."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, p) in enumerate(markers)]))
    return files.groupBy("project").agg(F.min(F.array_min(hits))["name"].alias("cms"))


# Schedules and jobs.


def clock(raw: Column) -> Column:
    """struct(hour, minute) of HH:MM, nine o'clock where it is missing; null where it is none."""
    text = F.trim(F.coalesce(raw, F.lit("09:00")))
    hour, minute = F.regexp_extract(text, r"^(\d{1,2}):(\d{1,2})$", 1).try_cast("int"), F.regexp_extract(text, r"^(\d{1,2}):(\d{1,2})$", 2).try_cast("int")
    return F.when(hour.between(0, 23) & minute.between(0, 59), F.struct(hour.alias("hour"), minute.alias("minute")))


def in_zone(moment: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(moment, F.coalesce(given(F.trim(zone)), F.lit("UTC")))


def marked(state: DataFrame, fired: DataFrame) -> DataFrame:
    """The last slot of each schedule (schedule_id, slot, job_id): what fired replaces what was."""
    return fired.unionByName(state.join(fired.select("schedule_id"), "schedule_id", "left_anti").select(*fired.columns))


def has_active(jobs: DataFrame) -> DataFrame:
    """project_id of projects with a queued or running job."""
    return jobs.filter(F.col("status").isin("queued", "running")).select("project_id").distinct()


def reconciled(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs (run_id, job_id, status) that still run although their job has ended take the job's end."""
    ended = jobs.select("job_id", F.col("status").alias("_job"))
    end = F.when((F.col("status") == "running") & (F.col("_job").isNull() | F.col("_job").isin("failed", "succeeded")), "failed").when((F.col("status") == "running") & (F.col("_job") == "cancelled"), "cancelled").otherwise(F.col("status"))
    return runs.join(ended, "job_id", "left").withColumn("status", end).drop("_job")


def rescaled(percent: Column, low: int, high: int) -> Column:
    return F.lit(low) + F.floor((F.lit(high) - F.lit(low)) * percent / 100)


def authority_compare(a: Column, b: Column) -> Column:
    from .changes import authority_rank

    return F.signum((authority_rank(a) - authority_rank(b)).cast("double")).cast("int")


def created_experiments(changes: DataFrame, baselines: DataFrame) -> DataFrame:
    """Experiments of changes (change_set_id null: none yet, hypothesis) with their baselines (change_set_id, baseline)."""
    rows = changes.join(baselines, "change_set_id", "left")
    return rows.select("change_set_id", "hypothesis", "baseline", F.when(F.col("change_set_id").isNull(), "proposed").when(F.col("baseline").isNull(), "awaiting_baseline").otherwise("running").alias("status"))


def treated(experiments: DataFrame, treatments: DataFrame) -> DataFrame:
    """Experiments (experiment_id, baseline) with the same metric after the change (experiment_id, treatment): difference and confidence."""
    from .search import result_confidence

    rows = experiments.join(treatments, "experiment_id", "left")
    return rows.select("experiment_id", "baseline", "treatment", (F.col("treatment") - F.col("baseline")).alias("delta"), result_confidence(F.col("baseline"), F.col("treatment")).alias("confidence"))


def visible_projects(projects: DataFrame, user: int, admin: bool) -> DataFrame:
    return projects if admin else projects.filter(F.col("owner_id") == user)


# Stored collections.


def stored(rows: DataFrame, order: list[str], **equal: object) -> DataFrame:
    """Rows of a stored collection that meet all given equalities (None: any), in order: chunks, pages, rules, files, symbols, routes."""
    for name, value in equal.items():
        if isinstance(value, (list, tuple)):
            rows = rows.filter(F.col(name).isin(list(value)))
        elif value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(*order)


def inflated(files: DataFrame, most: int = 2_000_000) -> DataFrame:
    """url, xml of fetched sitemaps (url, body binary): gzip is told by its first bytes and opened. Longer than `most` characters is no sitemap and gives null."""
    import gzip
    import io
    import zlib

    import pyarrow as pa

    def read(body: bytes | None) -> str | None:
        if body is None:
            return None
        if body[:2] == b"\x1f\x8b":
            try:
                with gzip.GzipFile(fileobj=io.BytesIO(body)) as file:
                    body = file.read(4 * most + 1)
            except (OSError, EOFError, zlib.error):
                return None
        text = body.decode("utf-8", "replace")
        return None if len(text) > most else text

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read(x) for x in b.column(1).to_pylist()], pa.string())], ["url", "xml"])

    return files.select("url", "body").mapInArrow(run, "url string, xml string")


def is_sitemap_page(content_type: Column, text: Column) -> Column:
    """An html page where a sitemap was asked for, whatever its type says."""
    return F.coalesce(content_type, F.lit("")).rlike("(?i)text/html") | F.coalesce(text, F.lit("")).rlike(r"(?is)^\s*(<!doctype html|<html)")
