"""What changed between two versions of a text, block by block: a patience alignment in rounds of groupings.

Blocks are matched where both sides agree at the beginning or the end of a stretch, and where a text stands once on each
side of it and these matches do not cross (of crossing ones the longest run in order stays). Matches cut the stretches
into smaller ones, in which texts that were repeated may stand once; rounds go on until none is found. All pairs of
versions are aligned at once: blocks are dealt out by pair and grouped by (pair, stretch, hash); only the search for the
run in order reads the matches of one stretch together, as numbers.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialized

_AT = ["pair", "stretch"]


def longest_run(places: list[int]) -> list[int]:
    """The indexes of a longest increasing subsequence of different numbers; of several the one that ends lowest, everywhere."""
    ends, at, before = [], [], []
    for k, p in enumerate(places):
        n = bisect_left(ends, p)
        before.append(at[n - 1] if n else -1)
        ends[n : n + 1], at[n : n + 1] = [p], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _in_order(found: pd.DataFrame) -> pd.DataFrame:
    found = found.sort_values("one")
    return found.iloc[longest_run(found["two"].tolist())][["pair", "one", "two"]]


def _stretched(blocks: DataFrame, matches: DataFrame) -> DataFrame:
    """The blocks that are not matched, with their stretch (how many matches of their pair come before) and places in it from both ends."""
    sides = matches.select("pair", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("place")), F.struct(F.lit(1).alias("side"), F.col("two").alias("place"))))).withColumn("hit", F.lit(1))
    # dealt out by pair once: all windows and groupings of a round are finer and move nothing
    told = blocks.withColumn("hit", F.lit(0)).unionByName(sides, allowMissingColumns=True).repartition("pair")
    passed = Window.partitionBy("pair", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("matched", F.max("hit").over(Window.partitionBy("pair", "side", "place"))).withColumn("stretch", F.sum("hit").over(passed)).filter("matched = 0").drop("hit", "matched")
    own = Window.partitionBy(*_AT, "side")
    return told.withColumn("first", F.row_number().over(own.orderBy("place"))).withColumn("last", F.row_number().over(own.orderBy(F.desc("place"))))


def _ends(rest: DataFrame, number: str) -> DataFrame:
    """Matches from one end of each stretch (numbered from it) up to the first difference."""
    own = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))  # noqa: E731  a stretch has one block of a number on each side
    met = rest.groupBy(*_AT, number).agg(own(0, "place").alias("one"), own(0, "hash").alias("h1"), own(1, "place").alias("two"), own(1, "hash").alias("h2")).filter("one is not null and two is not null")
    both = met.withColumn("differs", F.sum((F.col("h1") != F.col("h2")).cast("int")).over(Window.partitionBy(*_AT).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)))
    return both.filter("differs = 0").select("pair", "one", "two")


def _unique(rest: DataFrame) -> DataFrame:
    """Matches of texts that stand once on each side of their stretch, the longest run in order."""
    once = rest.groupBy(*_AT, "hash").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"), F.max(F.when(F.col("side") == 0, F.col("place"))).alias("one"), F.max(F.when(F.col("side") == 1, F.col("place"))).alias("two"))
    both = once.filter("n = 1 and m = 1").select(*_AT, "one", "two")
    return both.groupBy(*_AT).applyInPandas(_in_order, both.select("pair", "one", "two").schema)


def aligned(blocks: DataFrame) -> DataFrame:
    """pair, one, two: the places of blocks (pair, side 0 or 1, place, hash) that are matched. Rows with nulls are not."""
    blocks = materialized(blocks.select("pair", F.col("side").cast("int").alias("side"), F.col("place").cast("long").alias("place"), "hash").dropna(), "blocks")
    matches = blocks.filter(F.lit(False)).select("pair", F.col("place").alias("one"), F.col("place").alias("two"))
    while True:
        found = 0
        for step in (lambda rest: _ends(rest, "first"), lambda rest: _ends(rest, "last"), _unique):
            fresh = materialized(step(_stretched(blocks, matches)), "matches")
            found += fresh.count()
            matches = matches.union(fresh)
        if not found:
            return matches
        matches = materialized(matches, "matches")


def units(blocks: DataFrame) -> DataFrame:
    """What was added, removed or changed: a row for each stretch that is not matched, of blocks (pair, side, place, text, first, last, label).

    pair, kind, label (the first of the new side's, else of the old one's), first and last line of the new side, before
    and after (texts of the blocks, joined by a line end). A null text is an empty one.
    """
    rows = blocks.withColumn("text", F.coalesce("text", F.lit("")))
    hashed = rows.withColumn("hash", F.unhex(F.sha2("text", 256)))
    rest = _stretched(rows.select("pair", "side", "place", "text", F.col("first").alias("line"), F.col("last").alias("to"), "label"), aligned(hashed))
    own = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("place", "text", "line", "to", "label"))))  # noqa: E731  blocks of one text
    found = rest.groupBy(*_AT).agg(own(0).alias("old"), own(1).alias("new"))
    said = lambda side: F.array_join(F.transform(side, lambda b: b["text"]), "\n")
    label = lambda side: F.get(F.filter(F.transform(side, lambda b: b["label"]), lambda x: x.isNotNull()), F.lit(0))
    kind = F.when(F.size("old") == 0, "added").when(F.size("new") == 0, "removed").otherwise("changed")
    return found.select("pair", kind.alias("kind"), F.coalesce(label(F.col("new")), label(F.col("old"))).alias("label"), F.get("new", F.lit(0))["line"].alias("first"), F.get("new", F.size("new") - 1)["to"].alias("last"), said(F.col("old")).alias("before"), said(F.col("new")).alias("after"))
