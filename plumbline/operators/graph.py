"""Link and code graphs as node and edge tables with bounded traversals.

Edges are (type, src, dst). Traversals take a fixed number of hops, each a join with the edges; the frontier is
reduced to distinct nodes after every hop, so a hub is visited once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..session import materialized


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("type", "src", "dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, neighbour for every node next to a seed, in either direction."""
    return undirected(edges).join(seeds.select(F.col("node").alias("src")).distinct(), "src").select(F.col("src").alias("seed"), F.col("dst").alias("neighbour"))


def incoming(edges: DataFrame, kind: str, target: Column) -> DataFrame:
    """Distinct sources of edges of a kind whose end meets a condition: callers, importers, what renders a route."""
    return edges.filter((F.col("type") == kind) & target).select("src", "dst").distinct()


def outgoing(edges: DataFrame, kinds: list[str], source: Column) -> DataFrame:
    return edges.filter(F.col("type").isin(kinds) & source).select("type", "src", "dst").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """node, hops: the fewest hops from any seed, up to a bound, over undirected edges."""
    both = materialized(undirected(edges), "edges")
    found = frontier = materialized(seeds.select("node", F.lit(0).alias("hops")).distinct(), "frontier")
    for hop in range(1, hops + 1):
        step = both.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        frontier = materialized(frontier, "frontier")
        found = found.union(frontier)
    return found


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to, in order; the root is no exception and self links count."""
    linked = edges.select(F.col("dst").alias("node")).distinct()
    return nodes.join(linked, "node", "left_anti").orderBy("node")


def inbound_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def matched_routes(routes: DataFrame, pages: DataFrame, each: int = 5) -> DataFrame:
    """The first `each` pages of every route: routes (route_id, route), pages (url); a page goes to its first route.

    Routes are matched by pattern, after an equi-join on the number of segments and on the first one where it is
    fixed, so that a page meets few routes. A catch-all route fits any number, and is joined by its first segment only.
    """
    parts = F.filter(F.split("route", "/"), lambda p: p != "")
    wild = F.exists(parts, lambda p: p.rlike(r"^\[\.\.\."))
    head = F.when(F.size(parts) == 0, F.lit("")).when(parts[0].rlike(r"^\["), F.lit("*")).otherwise(parts[0])
    r = routes.select("route_id", "route", urls.route_pattern(F.col("route")).alias("pattern"), F.when(wild, F.lit(-1)).otherwise(F.size(parts)).alias("n"), head.alias("head"))
    segments = urls.path_segments(F.col("url"))
    first = F.when(F.size(segments) > 0, F.get(segments, F.lit(0))).otherwise(F.lit(""))
    keys = F.array(*[F.struct(n.alias("n"), h.alias("head")) for n in (F.size(segments), F.lit(-1)) for h in (first, F.lit("*"))])
    p = pages.select("url", urls.path(F.col("url")).alias("path"), F.explode(F.array_distinct(keys)).alias("k")).select("url", "path", "k.n", "k.head")
    met = p.join(r, ["n", "head"]).filter(F.expr("rlike(path, pattern)"))
    owned = met.groupBy("url").agg(F.min(F.struct("route_id", "route")).alias("r")).select("r.route_id", "r.route", "url")
    w = Window.partitionBy("route_id").orderBy("url")
    return owned.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each)


def code_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """CALLS edges from calls (src, file_path, callee) to symbols (stable_id, name, file_path): targets of the same file win."""
    s = symbols.select(F.col("stable_id").alias("dst"), F.col("name").alias("callee"), F.col("file_path").alias("target_file"))
    met = calls.join(s, "callee").withColumn("near", F.col("file_path") == F.col("target_file"))
    near = met.groupBy("src", "callee").agg(F.max("near").alias("has_near"))
    kept = met.join(near, ["src", "callee"]).filter(F.col("near") == F.col("has_near"))
    return kept.select(F.lit("CALLS").alias("type"), "src", "dst").distinct()


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS edges from imports (file_path, target) to the first of the files that a relative module can mean."""
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    base = F.when(F.col("target").startswith("."), F.concat(folder, F.col("target"))).otherwise(F.col("target"))
    endings = ["", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js"]
    tried = F.posexplode(F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(posix_normal(base), e))).alias("priority", "path")
    rows = imports.select("file_path", "target", tried).join(files.select("path").distinct(), "path")
    return rows.groupBy("file_path", "target").agg(F.min_by("path", "priority").alias("resolved"))


def posix_normal(path: Column) -> Column:
    """A path without . and .. parts."""
    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).when(part == "..", done).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def stable_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def replace_partition(rows: DataFrame, path: str, *keys: str) -> None:
    """Delete-then-write of a graph's part: partitions that are written again are replaced."""
    rows.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def union_edges(*tables: DataFrame) -> DataFrame:
    return distinct_edges(reduce(DataFrame.unionByName, tables))
