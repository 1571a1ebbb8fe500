"""Incremental maintenance: diffs by content hash, versioned rows, overlays and last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hash(*parts: str) -> Column:
    return F.sha2(F.concat_ws(" ", *parts), 256)


def page_text(title: Column, content: Column, url: Column) -> Column:
    """Title and content as one text, the url where both are blank."""
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", title, content)), F.lit("")), url)


def diff(stored: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """key, action: embed (new or changed), patch (same content, other text position), reuse or delete; both have key, content_hash, meta_hash.

    Both sides are shuffled by key once. Only hashes travel, not contents.
    """
    a = stored.select(key, F.col("content_hash").alias("h1"), F.col("meta_hash").alias("m1"))
    b = current.select(key, F.col("content_hash").alias("h2"), F.col("meta_hash").alias("m2"))
    action = F.when(F.col("h2").isNull(), "delete").when(~F.col("h1").eqNullSafe(F.col("h2")), "embed").when(~F.col("m1").eqNullSafe(F.col("m2")), "patch").otherwise("reuse")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def diff_stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def applied(stored: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """The new index: current rows, with the stored created_at where the row was known; stale rows are gone."""
    before = stored.select(key, F.col("created_at").alias("_created"))
    return current.join(before, key, "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")


def versioned(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """stored plus a next version of each incoming row that is new or differs in one of the fields; old versions stay."""
    newest = stored.groupBy(key).agg(F.max_by(F.struct(*fields), "version").alias("_old"), F.max("version").alias("_version"))
    joined = incoming.join(newest, key, "left")
    changed = ~F.struct(*fields).eqNullSafe(F.col("_old"))
    fresh = joined.filter(F.col("_version").isNull() | changed).withColumn("version", F.coalesce(F.col("_version") + 1, F.lit(1)).cast("int"))
    return stored.select(key, "version", *fields).unionByName(fresh.select(key, "version", *fields))


def with_current(rows: DataFrame, key: str) -> DataFrame:
    """Marks the newest version of each key."""
    newest = Window.partitionBy(key).orderBy(F.desc("version"))
    return rows.withColumn("is_current", F.row_number().over(newest) == 1)


def outcome_counts(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """How many rows are created, versioned or unchanged."""
    newest = stored.groupBy(key).agg(F.max_by(F.struct(*fields), "version").alias("_old"))
    kind = F.when(F.col("_old").isNull(), "created").when(F.struct(*fields).eqNullSafe(F.col("_old")), "unchanged").otherwise("versioned")
    return incoming.join(newest, key, "left").groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def inserted_if_absent(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows are never overwritten; new keys are added once."""
    return stored.unionByName(incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*stored.columns))


def overlay(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows in place of the stored ones with the same key."""
    return fresh.unionByName(stored.join(fresh.select(key).distinct(), key, "left_anti").select(*fresh.columns))


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """Delete by filter; rows for which the condition is null stay."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def last_values(rows: DataFrame, key: str, order: str) -> DataFrame:
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select(key, "r.*")


def changes_only(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A progress log without consecutive repeats."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    marked = rows.withColumn("_new", first | ~F.col(value).eqNullSafe(before))
    return marked.filter("_new").drop("_new")


#: The namespace of urls for name-based ids (RFC 9562).
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def point_id(key: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5) of a key: a row that is stored again has the same id. Null for a null key."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")  # the two high bits are 10
    return F.when(key.isNotNull(), F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)))
