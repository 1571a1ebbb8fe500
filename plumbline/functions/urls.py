"""URL kernels as Column expressions: host, origin, site, normal form, keys and structure counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that do not name another page.
DROPPED_PARAMS = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid gbraid wbraid fbclid mc_cid mc_eid _ga _gl search q query s keyword keywords sort order orderby dir filter filters facet ref referrer source share".split()
)
DEFAULT_PORTS = {"http": "80", "https": "443"}

#: scheme, host, port, path, query.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value that an expression reads several times and that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(url: Column) -> Column:
    """scheme and host in lower case, port without the default, path and query as they are."""
    port = F.regexp_extract(url, URL, 3)
    default = (port == "") | F.lower(F.concat_ws(":", _part(url, 1), port)).isin([f"{k}:{v}" for k, v in DEFAULT_PORTS.items()])
    return F.struct(F.lower(_part(url, 1)).alias("scheme"), F.lower(_part(url, 2)).alias("host"), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)).alias("port"), _part(url, 4).alias("path"), _part(url, 5).alias("query"))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    """The path, `/` where there is none."""
    return F.coalesce(F.nullif(_part(url, 4), F.lit("")), F.lit("/"))


def canonical_host(name: Column) -> Column:
    """Lower case, without dots at the end and one www. at the start."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"\.+$", "")
    return F.when(plain == "", None).when(plain == "www.", plain).otherwise(F.regexp_replace(plain, r"^www\.", ""))


def origin_of(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["host"], p["port"])


def site_of(p: Column) -> Column:
    return F.regexp_replace(F.concat(p["host"], p["port"]), r"^www\.", "")


def origin(url: Column) -> Column:
    return let(parts(url), origin_of)


def site(url: Column) -> Column:
    """What two URLs of one site have in common: the canonical host and a port that is not the default."""
    return let(parts(url), site_of)


def same_site(left: Column, right: Column) -> Column:
    return site(left) == site(right)


def registrable_domain(url: Column) -> Column:
    """The last two labels of the canonical host."""
    labels = F.split(canonical_host(host(url)), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def query_params(url: Column) -> Column:
    """All parameters, blank values included."""
    return F.filter(F.split(_part(url, 5), "&"), lambda p: p != "")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(_part(url, 4), "/"), lambda p: p != "")


def absolute_of(href: Column, base: Column) -> Column:
    """An href as a URL, given the parts of its base: as it is, or with the base's scheme, origin or folder in front."""
    place = F.coalesce(F.nullif(base["path"], F.lit("")), F.lit("/"))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin_of(base), href))
        .when(href.rlike(r"^[?#]") | (href == ""), F.concat(origin_of(base), place, href))
        .otherwise(F.concat(origin_of(base), F.regexp_replace(place, "[^/]*$", ""), href))
    )


def absolute(href: Column, base: Column) -> Column:
    return let(parts(base), lambda p: absolute_of(href, p))


def normal_of(p: Column) -> Column:
    kept = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~F.lower(F.split(q, "=")[0]).isin(DROPPED_PARAMS))
    query = F.array_join(F.transform(kept, lambda q: F.when(q.contains("="), q).otherwise(F.concat(q, F.lit("=")))), "&")
    trimmed = F.coalesce(F.nullif(F.regexp_replace(p["path"], "/+$", ""), F.lit("")), F.lit("/"))
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.when(p["scheme"].isin("http", "https") & (p["host"] != ""), F.concat(origin_of(p), trimmed, tail))


def normalized(url: Column) -> Column:
    """The normal form of an absolute http(s) URL, else null: lower host, no default port, no slash at the end, without dropped parameters and fragment."""
    return let(parts(url), normal_of)


def page_key(url: Column) -> Column:
    """The key by which search facts and pages meet: lower scheme and host, path without a slash at the end; a bare path in lower case."""
    full = let(parts(url), lambda p: F.concat(origin_of(p), F.regexp_replace(p["path"], "/+$", "")))
    return F.when(_part(url, 1) != "", full).otherwise(F.lower(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")))


def aligned(url: Column, onto: Column) -> Column:
    """A URL of the same site with the scheme and host of an origin, else null."""
    return F.when(same_site(url, onto), F.concat(origin(onto), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")))


def is_infrastructure(url: Column) -> Column:
    return path(url).rlike(r"^/cdn-cgi(/|$)")


def is_skipped_path(url: Column) -> Column:
    return path(url).rlike(r"^/(cdn-cgi|\.well-known)/")


def is_private_host(name: Column) -> Column:
    """Loopback, link-local, private or unnamed hosts, told from their spelling."""
    return name.isNull() | (name == "") | (F.lower(name) == "localhost") | name.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[?::1\]?$|\[?f[cd][0-9a-fA-F]{2}:|\[?fe80:)")


def route_pattern(route: Column) -> Column:
    """A route with [parameters] as a pattern of whole paths."""
    parts = F.transform(
        F.filter(F.split(route, "/"), lambda p: p != ""),
        lambda p: F.when(p.rlike(r"^\[\.\.\..*\]$"), F.lit(".*")).when(p.rlike(r"^\[.*\]$"), F.lit("[^/]+")).otherwise(F.regexp_replace(p, r"([.+*?^$(){}|\\\[\]])", r"\\$1")),
    )
    return F.concat(F.lit("^/"), F.array_join(parts, "/"), F.lit("/?$"))


def app_route(file: Column) -> Column:
    """The route of a page file below an app folder; groups in brackets do not count. Null for other files."""
    inner = F.regexp_extract(file, r"(?:^|/)app/(.*/)?page\.(?:tsx|ts|jsx|js)$", 1)
    is_page = file.rlike(r"(?:^|/)app/(.*/)?page\.(?:tsx|ts|jsx|js)$")
    segments = F.filter(F.split(inner, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    return F.when(is_page, F.concat(F.lit("/"), F.array_join(segments, "/")))
