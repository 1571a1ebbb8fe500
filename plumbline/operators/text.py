"""Text kernels: term counts, keyword candidates, line windows, islands, sections and content-change checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Fixed values of keyword and content rules.
KEYWORD_STOP_WORDS = (
    "a an the and or but nor for of in on at by to as is are was be it its we our us you i not no all any about also been being best both call come contact could does done each every from get have has had here home into just know like made make more most much need only over page read same shall should since site some such take than that their them then there these they this those through time under very want well were what when where which while will with your yours menu skip search click learn clicking please using used use one two new".split()
)
CONTENT_STOP_WORDS = "a an the of to in on for and or is are was were be been being this that with as by at from it its your our their his her they we you i".split()
KEYWORDS, WINDOW_LINES = 6, 80
STATISTIC = r"(?i)\b[0-9]{1,3}(?:\.[0-9]+)?\s?%|\b[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:million|billion|thousand|x\b)"
ATTRIBUTION = r"(?i)\b(?:according to|studies show|research shows|experts (?:say|agree)|proven to|guaranteed to)\b"
STUFFED, STUFFING = 6, 3.0


def keyword_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z][a-zA-Z'-]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(KEYWORD_STOP_WORDS))


def counted(terms: Column, sorted_terms: str = "_sorted") -> Column:
    """Distinct terms of the sorted array column `sorted_terms` with their counts: array of (term, n), in the order of terms."""
    own, n = F.col(sorted_terms), F.size(sorted_terms)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (F.get(own, i) != F.get(own, i - 1))))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    return F.when(n > 0, F.zip_with(starts, ends, lambda i, j: F.struct(F.get(own, i).alias("term"), (j - i).cast("long").alias("n")))).otherwise(F.array().cast("array<struct<term:string,n:long>>"))


def with_terms(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds _terms: the unigrams and bigrams of a text's tokens with their counts. All of it is inside the row, nothing is shuffled."""
    n = F.greatest(F.size("_tokens") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_tokens", F.lit(1), n), F.slice("_tokens", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.withColumn("_tokens", keyword_tokens(F.coalesce(F.col(text), F.lit("")))).withColumn("_sorted", F.sort_array(F.concat("_tokens", pairs)))
    return rows.withColumn("_terms", counted(F.col("_sorted"))).drop("_tokens", "_sorted")


def term_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, n: unigrams and bigrams of the tokens that are not stop words, for each row."""
    # outer, as else the size of the array would be a filter that computes it once more
    return with_terms(docs.select(key, text), text).select(key, F.inline_outer("_terms")).filter("term is not null")


def chosen_terms(terms: Column, limit: int = KEYWORDS) -> Column:
    """Terms by count, then name, without those that are part of one already chosen."""
    ordered = F.array_sort(F.transform(terms, lambda t: F.struct((-t["n"]).alias("n"), t["term"].alias("term"))))

    def choose(chosen: Column, item: Column) -> Column:
        hidden = F.exists(chosen, lambda c: c.contains(item["term"]))
        return F.when((F.size(chosen) >= limit) | hidden, chosen).otherwise(F.array_append(chosen, item["term"]))

    return F.aggregate(ordered, F.array().cast("array<string>"), choose)


def keyword_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = KEYWORDS) -> DataFrame:
    """key, keywords of each row whose text has a term."""
    one = F.when(F.size("_terms") > 0, F.array(F.struct(chosen_terms(F.col("_terms"), limit).alias("keywords"))))
    return with_terms(docs.select(key, text), text).select(key, F.inline_outer(one)).filter("keywords is not null")


def contains_term(haystack: Column, term: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(haystack, F.lit(""))), r"\s+", " ").contains(F.lower(term))


def with_missing_keywords(pages: DataFrame) -> DataFrame:
    """Adds keywords and missing: dominant terms of pages of 250 words or more, and those in neither title nor description."""
    rows = with_terms(pages.withColumn("_long", F.when(F.col("word_count") >= 250, F.col("content"))), "_long")
    rows = rows.withColumn("keywords", chosen_terms(F.col("_terms")))
    missing = F.filter("keywords", lambda t: ~contains_term(F.col("title"), t) & ~contains_term(F.col("meta_description"), t))
    return rows.withColumn("missing", missing).drop("_terms", "_long")


def keyword_focus(pages: DataFrame) -> DataFrame:
    """Pages of 250 words or more with dominant terms in neither title nor description: url, keywords, missing."""
    one = F.when(F.size("missing") > 0, F.array(F.struct("keywords", "missing")))
    return with_missing_keywords(pages).select("url", one.alias("_one")).select("url", F.inline_outer("_one")).filter("missing is not null")


def runs_in(flags: Column) -> Column:
    """Runs of true in an array of booleans: array of (first, last), from 1 on."""
    n = F.size(flags)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    at = lambda i: F.coalesce(F.get(flags, i - 1), F.lit(False))
    firsts = F.filter(places, lambda i: at(i) & ((i == 1) | ~at(i - 1)))
    lasts = F.filter(places, lambda i: at(i) & ((i == n) | ~at(i + 1)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def text_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first, last: runs of lines that are not blank, found inside each row."""
    rows = docs.select(key, F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("_said"))
    return rows.withColumn("_runs", runs_in(F.col("_said"))).select(key, F.inline_outer("_runs")).filter("first is not null")


def text_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW_LINES) -> DataFrame:
    """key, first, last: those runs in tumbling windows of so many lines."""
    return line_windows(text_paragraphs(docs, key, text), key, size)


def text_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = r"^#{1,6} ") -> DataFrame:
    """key, section, first, last, title: from one heading line to the next, found inside each row; what comes before the first is section 0."""
    rows = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines"))
    heads = F.array_compact(F.transform("_lines", lambda x, i: F.when(x.rlike(heading), i + 1)))
    rows = rows.withColumn("_heads", heads)
    starts = F.when(F.coalesce(F.get("_heads", F.lit(0)), F.lit(0)) == 1, F.col("_heads")).otherwise(F.concat(F.array(F.lit(1)), "_heads"))
    rows = rows.withColumn("_starts", starts).withColumn("_before", F.when(F.size("_heads") == F.size("_starts"), 1).otherwise(0))
    ends = F.concat(F.transform(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))), lambda x: x - 1), F.array(F.size("_lines")))
    found = F.transform(F.arrays_zip(F.col("_starts").alias("a"), ends.alias("b")), lambda x, i: F.struct((i + F.col("_before")).cast("long").alias("section"), x["a"].alias("first"), x["b"].alias("last"), F.when(i + F.col("_before") > 0, F.get("_lines", x["a"] - 1)).alias("title")))
    return rows.withColumn("_sections", found).select(key, F.inline_outer("_sections")).filter("first is not null")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), value."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "value")).select(key, (F.col("i") + 1).alias("line"), "value")


def islands(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, last: runs of consecutive lines; rows has key and line."""
    w = Window.partitionBy(key).orderBy("line")
    runs = rows.withColumn("island", F.col("line") - F.row_number().over(w))
    return runs.groupBy(key, "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("island")


def line_windows(runs: DataFrame, key: str = "doc_id", size: int = WINDOW_LINES) -> DataFrame:
    """Runs cut into tumbling windows of so many lines: key, first, last."""
    starts = runs.select(key, "first", "last", F.explode(F.sequence("first", "last", F.lit(size))).alias("start"))
    return starts.select(key, F.col("start").alias("first"), F.least(F.col("start") + size - 1, F.col("last")).alias("last"))


def uncovered(rows: DataFrame, covered: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines outside all covered ranges (key, first, last), as runs of at most a window's length."""
    taken = covered.select(key, F.explode(F.sequence("first", "last")).alias("line")).distinct()
    return line_windows(islands(rows.filter(F.trim("value") != "").select(key, "line").join(taken, [key, "line"], "left_anti"), key), key)


def sections(rows: DataFrame, key: str = "doc_id", heading: str = r"^#{1,6} ") -> DataFrame:
    """key, section, first, last, title: from one heading line to the next; what comes before the first is section 0."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("section", F.sum(F.when(F.col("value").rlike(heading), 1).otherwise(0)).over(w))
    title = F.min(F.when(F.col("value").rlike(heading), F.struct("line", "value")))["value"]
    return marked.groupBy(key, "section").agg(F.min("line").alias("first"), F.max("line").alias("last"), title.alias("title"))


def paragraphs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of lines that are not blank."""
    return islands(rows.filter(F.trim("value") != ""), key)


def content_text(html: Column) -> Column:
    """What content rules read: no scripts, tags, addresses or links."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\[([^\]]+)\]\([^)]+\)", "$1")
    text = F.regexp_replace(text, r"(?i)(?:https?://|www\.)[^\s\"'<>)\]]+", " ")
    return F.regexp_replace(text, r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}\b", " ")


def new_matches(before: Column, after: Column, pattern: str) -> Column:
    """What a pattern finds in the content text after a change and not before."""
    every = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda m: F.lower(m)))
    return F.array_sort(F.array_except(every(after), every(before)))


def content_changes(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a change of text adds without support: pairs (key, before, after) -> key, rule, detail."""
    gone = (F.trim(F.coalesce("before", F.lit(""))) != "") & (F.trim(F.coalesce("after", F.lit(""))) == "")
    # what is read several times is a column of its own, so that it is worked out once
    pairs = pairs.select(key, gone.alias("_gone"), *[content_text(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("before", "after")])
    gone, stats, said = F.col("_gone"), F.col("_stats"), F.col("_said")
    told = pairs.select(key, "_gone", new_matches(F.col("_before"), F.col("_after"), STATISTIC).alias("_stats"), new_matches(F.col("_before"), F.col("_after"), ATTRIBUTION).alias("_said"))
    found = told.select(
        key,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(gone, F.struct(F.lit("content_removed").alias("rule"), F.lit("").alias("detail"))),
                    F.when(~gone & (F.size(stats) > 0), F.struct(F.lit("unsupported_statistic").alias("rule"), F.array_join(stats, ",").alias("detail"))),
                    F.when(~gone & (F.size(said) > 0), F.struct(F.lit("unsupported_attribution").alias("rule"), F.array_join(said, ",").alias("detail"))),
                )
            )
        ).alias("v"),
    ).select(key, "v.*")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z'-]{2,}"), F.lit(0))
    sides = F.array(*[F.struct(F.lit(after).alias("a"), words(F.col(c)).alias("words")) for after, c in ((True, "_after"), (False, "_before"))])
    both = pairs.filter(~gone).select(key, F.inline(sides)).select(key, "a", F.explode("words").alias("word")).filter(~F.col("word").isin(CONTENT_STOP_WORDS))
    counts = both.groupBy(key, "word").agg(F.count_if("a").alias("a"), F.count_if(~F.col("a")).alias("b"))
    stuffed = counts.filter((F.col("a") >= STUFFED) & ((F.col("b") == 0) | (F.col("a") / F.col("b") >= STUFFING)))
    return found.union(stuffed.select(key, F.lit("keyword_stuffing"), F.concat_ws(" ", "word", F.col("a").cast("string"), F.col("b").cast("string"))))


def token_estimate(characters: Column, per_token: int = 4) -> Column:
    return F.floor(characters / per_token)


def packed(rows: DataFrame, key: str, order: str, cost: str, most: int = 5, budget: int = 2500) -> DataFrame:
    """Sequential greedy batches of at most `most` items and `budget` cost: adds `batch`, counted from 0 in each group.

    Rows are dealt out and sorted by (key, order) and read one after the other, so that a task holds one row of a group
    at a time, however long the group is.
    """
    import pyarrow as pa

    dealt = rows.repartition(key).sortWithinPartitions(key, order)
    at, by = rows.columns.index(cost), rows.columns.index(key)

    def put(batches):
        last, batch, n, total = object(), 0, 0, 0
        for found in batches:
            out = []
            for k, own in zip(found.column(by).to_pylist(), found.column(at).to_pylist(), strict=True):
                own = own or 0
                if k != last:
                    last, batch, n, total = k, 0, 0, 0
                elif n >= most or total + own > budget:
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + own
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(out, pa.int32())], [*found.schema.names, "batch"])

    return dealt.mapInArrow(put, T.StructType([*dealt.schema.fields, T.StructField("batch", T.IntegerType())]))
