"""Pieces of DuckDB SQL that the oracles share: the page model, URL kernels, hits and findings."""

from __future__ import annotations

from ..functions import urls
from ..operators import findings as fd

# Patterns of their own for the well-formed pages of the test data, with attributes in double quotes: they share nothing
# with the library's reading of tags.
SPACES = r"[ \t\n\r\f]+"
CHROME = ("script", "style", "noscript", "nav", "footer", "head")
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
ANCHOR = r"(?is)<a(?:rea)?\s[^>]*?href=\"([^\"]*)\"[^>]*>"
LD_JSON = r"(?is)<script[^>]*type=\"application/ld\+json\"[^>]*>(.*?)</script>"
QUESTION = r"(?is)<h[2-6][^>]*>([^<]*\?)\s*</h[2-6]>"
META = r"(?is)<meta[^>]*name=\"{name}\"[^>]*content=\"([^\"]*)\""
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _replace_all(expression: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expression}, '{pattern}', '{by}', 'g')"


def collapsed(x: str) -> str:
    return f"trim({_replace_all(x, SPACES, ' ')})"


def plain(x: str) -> str:
    x = _replace_all(x, "<[^>]*>", " ")
    for entity, char in ENTITIES:
        quoted = char.replace("'", "''")
        x = f"replace({x}, '{entity}', '{quoted}')"
    return collapsed(x)


def visible(x: str) -> str:
    for tag in CHROME:
        x = _replace_all(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return plain(x)


def part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{urls.URL}', {n})"


def scheme(u: str) -> str:
    return f"lower({part(u, 1)})"


def host(u: str) -> str:
    return f"lower({part(u, 2)})"


def netloc(u: str) -> str:
    p = part(u, 3)
    return f"({host(u)} || CASE WHEN {p} = '' OR ({scheme(u)} = 'http' AND {p} = '80') OR ({scheme(u)} = 'https' AND {p} = '443') THEN '' ELSE ':' || {p} END)"


def origin(u: str) -> str:
    return f"({scheme(u)} || '://' || {netloc(u)})"


def site(u: str) -> str:
    return f"regexp_replace({netloc(u)}, '^www\\.', '')"


def path(u: str) -> str:
    return f"coalesce(nullif({part(u, 4)}, ''), '/')"


def normalized(u: str) -> str:
    dropped = ", ".join(f"'{p}'" for p in urls.DROPPED_PARAMS)
    kept = f"list_filter(string_split({part(u, 5)}, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({dropped}))"
    query = f"array_to_string(list_transform({kept}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
    trimmed = f"regexp_replace({path(u)}, '/+$', '')"
    return f"(CASE WHEN {scheme(u)} IN ('http', 'https') AND {host(u)} <> '' THEN {origin(u)} || CASE WHEN {trimmed} = '' THEN '/' ELSE {trimmed} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END)"


def absolute(href: str, base: str) -> str:
    folder = f"regexp_replace({path(base)}, '[^/]*$', '')"
    return f"(CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '//') THEN {scheme(base)} || ':' || {href} WHEN starts_with({href}, '/') THEN {origin(base)} || {href} WHEN {href} = '' OR regexp_matches({href}, '^[?#]') THEN {origin(base)} || {path(base)} || {href} ELSE {origin(base)} || {folder} || {href} END)"


def meta(name: str) -> str:
    return f"nullif(regexp_extract(html, '{META.format(name=name)}', 1), '')"


PAGES = f"""
pm AS MATERIALIZED (
  SELECT page_id, url, nullif({plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title, {meta("description")} AS meta_description, {meta("viewport")} AS viewport,
    nullif(regexp_extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), '') AS canonical, nullif(regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1), '') AS language,
    regexp_extract_all(html, '{HEADING}', 1) AS levels, {visible("html")} AS content, sha256(html) AS raw_html_hash, regexp_extract_all(html, '{ANCHOR}', 1) AS hrefs,
    len(regexp_extract_all(html, '{LD_JSON}', 1)) AS n_blocks, len(regexp_extract_all(html, '{QUESTION}', 1)) AS n_questions FROM pages),
p AS MATERIALIZED (SELECT *, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, ' ')) END AS word_count, {normalized("url")} AS here FROM pm),
a AS MATERIALIZED (SELECT url, here, {absolute("trim(h)", "url")} AS target FROM (SELECT url, here, unnest(hrefs) AS h FROM p)),
l AS MATERIALIZED (SELECT url, here, {normalized("target")} AS href, {site(normalized("target"))} = {site("url")} AS internal FROM a WHERE {normalized("target")} IS NOT NULL)"""



def keywords(rows: str, key: str, text: str) -> str:
    """CTEs kt, kf, kw(key, keywords): dominant terms of rows, chosen one after the other."""
    from ..operators import text as kernels

    stop = ", ".join(f"'{w}'" for w in kernels.KEYWORD_STOP_WORDS)
    return f"""kt AS (SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[a-zA-Z][a-zA-Z''-]{{2,}}'), lambda w: w NOT IN ({stop})) AS t FROM {rows}),
kf AS (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest(t) AS term FROM kt UNION ALL SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM kt) GROUP BY ALL),
kw AS MATERIALIZED (SELECT {key}, list_reduce(list_prepend([]::VARCHAR[], list([term] ORDER BY n DESC, term)), lambda a, x: CASE WHEN len(a) >= {kernels.KEYWORDS} OR len(list_filter(a, lambda c: contains(c, x[1]))) > 0 THEN a ELSE list_concat(a, x) END) AS keywords FROM kf GROUP BY {key})"""


_SEGMENTS = f"len(list_filter(string_split({part('url', 4)}, '/'), lambda x: x <> ''))"
_PARAMS = f"len(list_filter(string_split({part('url', 5)}, '&'), lambda x: x <> ''))"
#: rule, condition, observed value, for the rules whose fields the pages table has.
_PAGE_RULES = [
    ("SEO-CANONICAL-001", "canonical IS NULL OR trim(canonical) = ''", "canonical"),
    ("SEO-CONTENT-THIN-001", "word_count < 250", "word_count::VARCHAR"),
    ("SEO-H1-MISSING-001", "NOT list_contains(levels, '1')", "'0'"),
    ("SEO-H1-MULTIPLE-001", "len(list_filter(levels, lambda x: x = '1')) > 1", "len(list_filter(levels, lambda x: x = '1'))::VARCHAR"),
    ("SEO-LANG-MISSING-001", "language IS NULL OR trim(language) = ''", "language"),
    ("SEO-METADESC-LENGTH-001", "length(meta_description) > 160", "meta_description"),
    ("SEO-METADESC-MISSING-001", "meta_description IS NULL OR trim(meta_description) = ''", "meta_description"),
    ("SEO-STRUCTUREDDATA-MISSING-001", "n_blocks = 0", "'0'"),
    ("SEO-TITLE-LENGTH-001", "length(title) > 60", "title"),
    ("SEO-TITLE-MISSING-001", "title IS NULL OR trim(title) = ''", "title"),
    ("SEO-URL-COMPLEXITY-001", f"{_PARAMS} > 3 OR {_SEGMENTS} > 6", f"{_PARAMS}::VARCHAR || ',' || {_SEGMENTS}::VARCHAR"),
    ("SEO-VIEWPORT-MISSING-001", "viewport IS NULL OR trim(viewport) = ''", "viewport"),
    ("AEO-QUESTION-HEADING-001", "n_questions = 0", "'0'"),
    ("GEO-ENTITY-CLARITY-001", "word_count >= 250 AND n_blocks = 0", "word_count::VARCHAR"),
    ("GEO-SOURCE-ATTRIBUTION-001", "word_count >= 400 AND url NOT IN (SELECT url FROM l WHERE NOT internal)", "word_count::VARCHAR"),
    ("GEO-STRUCTURED-DENSITY-001", "word_count >= 800 AND n_blocks = 0", "word_count::VARCHAR"),
]
ORPHANS = f"SELECT url FROM p WHERE {path('url')} <> '/' AND here NOT IN (SELECT href FROM l WHERE internal AND here <> href)"
TITLE_GROUPS = "SELECT url, key, count(*) OVER (PARTITION BY key) AS n FROM (SELECT url, replace(lower(trim(title)), 'ß', 'ss') AS key FROM p WHERE trim(title) <> '')"
BROKEN = f"SELECT DISTINCT url, href FROM l WHERE internal AND NOT regexp_matches({path('href')}, '^/cdn-cgi(/|$)') AND href IN (SELECT here FROM p WHERE page_id % 7 = 0)"
MISSING = f"""{keywords("(SELECT * FROM p WHERE word_count >= 250)", "page_id", "content")},
km AS MATERIALIZED (SELECT page_id, url, keywords, list_filter(keywords, lambda t: NOT contains({_replace_all("lower(coalesce(title, ''))", "\\s+", " ")}, t) AND NOT contains({_replace_all("lower(coalesce(meta_description, ''))", "\\s+", " ")}, t)) AS missing FROM kw JOIN p USING (page_id))"""
HITS = (
    PAGES
    + ",\n"
    + MISSING
    + ",\nhits AS MATERIALIZED (\n"
    + "\nUNION ALL ".join(f"SELECT '{rule}' AS rule_id, url AS affected_resource, {seen} AS observed_value FROM p WHERE {condition}" for rule, condition, seen in _PAGE_RULES)
    + f"""
UNION ALL SELECT 'SEO-KEYWORD-FOCUS-001', url, '{{"dominant_terms":["' || array_to_string(keywords, '","') || '"],"missing_from_title_and_description":["' || array_to_string(missing, '","') || '"]}}' FROM km WHERE len(missing) > 0
UNION ALL SELECT 'SEO-TITLE-DUPLICATE-001', url, n::VARCHAR || ' | ' || key FROM ({TITLE_GROUPS}) WHERE n >= 2
UNION ALL SELECT 'SEO-CONTENT-DUPLICATE-001', url, n::VARCHAR || ' | ' || raw_html_hash FROM (SELECT url, raw_html_hash, count(*) OVER (PARTITION BY raw_html_hash) AS n FROM p) WHERE n >= 2
UNION ALL SELECT 'SEO-ORPHAN-PAGE-001', url, '0' FROM ({ORPHANS})
UNION ALL SELECT 'SEO-BROKEN-INTERNAL-LINK-001', url || ' -> ' || href, href FROM ({BROKEN}))"""
)


def case(values: dict, key: str, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default} END"


def _rules() -> str:
    from ..operators import rules

    rows = ", ".join(f"('{r.rule_id}', '{r.category}', '{r.severity}', '{r.confidence}', '{r.actionability}', '{r.expected}')".replace("page's", "page''s") for r in rules.CATALOG)
    return f"r(rule_id, category, severity, confidence, actionability, expected) AS (VALUES {rows})"


FINDINGS = (
    HITS
    + ",\n"
    + _rules()
    + f""",
f AS MATERIALIZED (SELECT rule_id || ':' || substr(sha1(rule_id || chr(10) || affected_resource), 1, 16) AS finding_id, rule_id AS rule, category, severity, confidence, actionability, affected_resource, observed_value,
  count(*) OVER (PARTITION BY rule_id) AS affected_pages FROM hits JOIN r USING (rule_id)),
ranked AS MATERIALIZED (SELECT *, {case(fd.IMPACT, "severity")} * {case(fd.CONFIDENCE, "confidence")} * least(1.0, ln(1.0 + affected_pages) / ln({1.0 + fd.REACH_CAP})) * {case(fd.ACTIONABILITY, "actionability", "0.5")} / {case(fd.RISK, "actionability", "0.4")} AS priority FROM f)"""
)
