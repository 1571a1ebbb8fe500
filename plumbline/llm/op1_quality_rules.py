"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base counts of every whole text give the base verdict. On top of it, RULES reject documents by ratios of these counts.
How far the rules may go is learnt: in each stratum (language), the labelled good documents that pass the base rules are
the holdout. All rules are tightened together along one fixed sequence of steps, from the most lenient to the strictest:
each step tightens one rule by one cutoff. A step passes if, were the true rate of good documents that the rules reject
up to here above ALPHA, so few of them would be seen with a probability of at most DELTA divided by the number of strata
(an exact binomial tail). The last step before the first failure is selected. Testing in a fixed order up to the first
failure needs no further correction within a stratum, and DELTA is divided among the strata; so with a confidence of
1 - DELTA no stratum loses more than ALPHA of its good documents to all rules together. A stratum without good
rejections needs ln(DELTA / strata) / ln(1 - ALPHA) good documents for its first step (183 with four strata).

All labelled rows count, at every size. Good documents are counted by stratum and step before they are shuffled. Only
the selected steps (one for each stratum) are broadcast, if there are at most BROADCAST_STRATA strata.

Cases: a null or blank text has no words and fails the base rules; a null language is a stratum of its own; strata
without enough labels get no cutoff; repeated doc_ids are judged one by one, each with all its labels (a document is
good if any label says so); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_GAP, materialize, table, words_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Risk: the largest share of good documents that may be rejected in a stratum, and the probability of failing that.
ALPHA, DELTA = 0.02, 0.1
BROADCAST_STRATA = 100_000
#: Repeated windows that are looked up one by one.
LOOKED_UP = 32
#: Rules: a ratio and its cutoffs, from lenient to strict; a document with a ratio above the cutoff is rejected.
RULES = {
    "symbols": ("n_symbols / word_chars", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02, 0.01]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeats": ("n_repeat_words / n_words", [0.45, 0.4, 0.35, 0.3, 0.25]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 17.5, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0]),
    "bangs": ("n_bangs / n_words", [1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05]),
}


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series for n + 8 less the logarithms of the eight factors in between."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    steps = F.lit(1.0)
    for i in range(1, 9):
        steps = steps * (n.cast("double") + i)
    return series - F.ln(steps)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X binomial(n, p), exact up to rounding.

    Terms are summed downwards from k. At k <= n p they fall at least geometrically; those 40 deviations below the
    mean are under 1e-300 and end the sum. For k > n p the result is over 0.5 or close to it and 1 is returned, which
    fails any test at a level below one half.
    """
    n, k = n.cast("double"), k.cast("double")
    odds = (1 - p) / p
    first = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.ln(p) + (n - k) * F.ln(1 - p))
    span = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p)) + 60)).cast("int")
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(span >= 1, F.sequence(F.lit(1), F.greatest(span, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.aggregate(steps, start, add, lambda acc: acc["sum"]), F.lit(1.0)))


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in a window of three that occurs twice or more in the text, the first one included.

    Each step is a column of its own that the next one reads more than once, so that none is computed anew for every
    element. A text whose windows all differ is done after the first step.
    """
    n = F.size("_words")
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1)))
    none = F.array().cast("array<long>")
    rows = rows.withColumn("_windows", F.when(n >= 4, hashed).otherwise(none))
    rows = rows.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array("_windows")).otherwise(none))
    k = F.size("_ordered")
    same = F.zip_with(F.slice("_ordered", 1, F.greatest(k - 1, F.lit(0))), F.slice("_ordered", 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.when(a == b, a))
    rows = rows.withColumn("_twice", F.when(k > 0, F.array_distinct(F.array_compact(same))).otherwise(none))
    # the places of these windows: with few of them by looking each one up, with many by a sort of (window, place)
    few = F.array_compact(F.transform("_windows", lambda h, i: F.when(F.array_contains("_twice", h), i)))
    rows = rows.withColumn("_pairs", F.when(F.size("_twice") > LOOKED_UP, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("_pairs")
    met = F.zip_with(F.slice("_pairs", 1, m - 1), F.slice("_pairs", 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    many = F.array_sort(F.array_distinct(F.flatten(F.array_compact(met))))
    rows = rows.withColumn("_places", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= LOOKED_UP, few).otherwise(many))
    # each place adds the words beyond the end of the window before it
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("_places", start, lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + (i + 3) - F.greatest(acc["end"], i)).alias("n")), lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", F.when(F.size("_places") > 0, covered).otherwise(F.lit(0)).cast("long")).drop("_windows", "_ordered", "_twice", "_pairs", "_places")


def counts(docs: DataFrame) -> DataFrame:
    """Base counts of each whole text; keeps the other columns but text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = _repeats(docs.withColumn("_words", words_of(text)))
    rows = rows.withColumn("_lines", lines)
    return rows.select(
        *[c for c in docs.columns if c != "text"],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))


#: The fixed sequence: each step is a rule and its next cutoff, one rule after the other, from lenient to strict.
SEQUENCE = [(rule, cuts[level]) for level in range(max(len(cuts) for _, cuts in RULES.values())) for rule, (_, cuts) in RULES.items() if level < len(cuts)]


def first_step(rule: str) -> Column:
    """The first step at which a rule rejects a document; null if none does."""
    return F.coalesce(*[F.when(_ratio(rule) > cut, F.lit(i)) for i, (r, cut) in enumerate(SEQUENCE) if r == rule])


def selected_steps(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "stratum") -> DataFrame:
    """(stratum, step): the last step whose false rejections are bounded; counted has doc_id, stratum and the counts."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality > 0").select("doc_id")
    held = counted.filter(~base_failed()).join(good, "doc_id", "left_semi")
    met = held.select(stratum, F.least(*[first_step(r) for r in RULES]).alias("step")).groupBy(stratum, "step").agg(F.count("*").alias("k"))
    strata = met.groupBy(stratum).agg(F.sum("k").alias("n"))
    steps = strata.select(stratum, "n", F.explode(F.sequence(F.lit(0), F.lit(len(SEQUENCE) - 1))).alias("step"))
    upto = Window.partitionBy(stratum).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as steps
    rows = steps.join(met, [stratum, "step"], "left").withColumn("k", F.sum(F.coalesce("k", F.lit(0))).over(upto))
    many = strata.agg(F.count("*").alias("strata"))
    tested = rows.crossJoin(F.broadcast(many)).withColumn("passed", binomial_tail(F.col("k"), F.col("n"), F.lit(alpha)) <= delta / F.col("strata"))  # `many` is one row
    return tested.withColumn("sound", F.min("passed").over(upto)).filter("sound").groupBy(stratum).agg(F.max("step").alias("step"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts, base_failed, kept and the rules that reject, for every row of docs (doc_id, text, lang)."""
    counted = materialize(counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), "text")), "counts")
    chosen = materialize(selected_steps(counted, labels.select("doc_id", "quality")), "steps")
    few = chosen.count() <= BROADCAST_STRATA
    rows = counted.join(F.broadcast(chosen) if few else chosen, "stratum", "left")
    rejecting = F.array_compact(F.array(*[F.when(first_step(r) <= F.col("step"), F.lit(r)) for r in RULES]))
    return rows.withColumn("base_failed", base_failed()).withColumn("rejected_by", rejecting).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def _oracle() -> str:
    ratio = {rule: f"coalesce({expr.split(' / ')[0]}::DOUBLE / nullif({expr.split(' / ')[1]}, 0)::DOUBLE, 0.0)" for rule, (expr, _) in RULES.items()}
    steps = ", ".join(f"('{rule}', {i}, {cut!r}::DOUBLE)" for i, (rule, cut) in enumerate(SEQUENCE))
    case = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in ratio.items()) + " END"
    return f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'g': array_to_string(ws[i:i + 2], ' ')}})) AS x FROM w WHERE len(ws) >= 3),
r AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS k FROM g),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE k > 1) GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs
  FROM w LEFT JOIN c USING (doc_id)),
b AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality > 0),
seq AS (SELECT * FROM (VALUES {steps}) x(rule, step, cutoff)),
met AS MATERIALIZED (SELECT b.doc_id, stratum, rule, min(step) AS step FROM b, seq WHERE {case} > cutoff GROUP BY ALL),
held AS MATERIALIZED (SELECT doc_id, stratum FROM b SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
n AS MATERIALIZED (SELECT stratum, count(*) AS n FROM held GROUP BY stratum),
firsts AS (SELECT h.doc_id, h.stratum, min(step) AS first FROM held h JOIN met USING (doc_id) GROUP BY ALL),
k AS (SELECT n.stratum, n.n, s.step, (SELECT count(*) FROM firsts f WHERE f.stratum = n.stratum AND f.first <= s.step) AS k FROM n, seq s),
tail AS (
  SELECT stratum, step, k > n * {ALPHA!r} OR list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA!r}::DOUBLE) + (n - i) * ln(1 - {ALPHA!r}::DOUBLE)))) > {DELTA!r} / (SELECT count(*) FROM n) AS failed FROM k),
chosen AS (SELECT stratum, max(step) AS last FROM (SELECT *, bool_or(failed) OVER (PARTITION BY stratum ORDER BY step) AS bad FROM tail) WHERE NOT bad GROUP BY stratum),
hits AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position({list(RULES)!r}, rule)) AS rejected_by FROM met JOIN chosen USING (stratum) WHERE step <= last GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN hits USING (doc_id)
"""


ORACLE_SQL = _oracle()
