"""Kernels of change control: scope checks, rollback confidence, validation, experiments, schedules and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EXPERIMENT_TYPES = [("TITLE", "title"), ("METADESC", "meta_description"), ("FAQ", "faq"), ("ANSWER", "answer"), ("STRUCTUREDDATA", "structured_data"), ("ENTITY", "entity")]
TRANSITIONS = [("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "failed"), ("running", "cancelled")]
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "md": "markdown", "php": "php", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml"}
SKIPPED_DIRS = "node_modules .git dist build vendor __pycache__ .next coverage".split()
AUTHORITY = ["community", "practitioner", "research", "official_vendor_docs", "standard"]


def rollback_confidence(file_exists: Column, symbol_located: Column, hash_matches: Column, touched_by_others: Column) -> Column:
    """How sure a change can be taken back; hash_matches is null where it is unknown."""
    base = F.when(~file_exists, F.lit(0.05)).when(~symbol_located, F.lit(0.20)).when(hash_matches.isNull(), F.lit(0.50)).when(~hash_matches, F.lit(0.55)).otherwise(F.lit(0.98))
    return F.when(touched_by_others, F.least(base, F.lit(0.60))).otherwise(base)


def validation_status(checks: DataFrame, key: str) -> DataFrame:
    """key, status of runs with checks (key, status): failed over skipped (partial) over passed."""
    folded = F.when(F.max(F.col("status") == "failed"), "failed").when(F.max(F.col("status") == "skipped"), "partial").otherwise("passed")
    return checks.groupBy(key).agg(folded.alias("status"))


def experiment_type(rule: Column) -> Column:
    """The first kind whose name is in the rule id."""
    out = F.lit(None).cast("string")
    for needle, kind in reversed(EXPERIMENT_TYPES):
        out = F.when(F.upper(rule).contains(needle), F.lit(kind)).otherwise(out)
    return out


def is_path_safe(path: Column) -> Column:
    """Relative and, whatever its .. parts, never above the root."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")),
        lambda s, p: F.struct((s["d"] + _step(p)).alias("d"), F.least(s["least"], s["d"] + _step(p)).alias("least")),
        lambda s: s["least"],
    )
    return ~path.startswith("/") & ~path.contains("\\") & (path != "") & (depth >= 0)


def _step(part: Column) -> Column:
    return F.when(part.isin("", "."), 0).when(part == "..", -1).otherwise(1)


def _within(path: Column, folders: Column) -> Column:
    return F.exists(folders, lambda d: (path == d) | path.startswith(F.concat(d, F.lit("/"))))


def scope_violation(files: Column, allowed: Column, forbidden: Column, lines: Column, size: Column, max_files: int, max_lines: int, max_bytes: int) -> Column:
    """The first violation of a change's bounds, or null."""
    return (
        F.when(F.size(files) == 0, "no_files")
        .when(F.exists(files, lambda p: ~is_path_safe(p)), "path_traversal")
        .when(F.exists(files, lambda p: _within(p, forbidden)), "forbidden_directory")
        .when(F.exists(files, lambda p: ~_within(p, allowed)), "outside_planned_scope")
        .when(F.size(files) > max_files, "too_many_files")
        .when(lines > max_lines, "too_many_lines")
        .when(size > max_bytes, "diff_too_large")
    )


def cron_field(field: str, value: Column) -> Column:
    """Whether a number meets a field of a cron expression: *, lists, ranges and steps."""
    if field.strip() == "*":
        return F.lit(True)
    out = F.lit(False)
    for token in filter(None, map(str.strip, field.split(","))):
        base, _, step = token.partition("/")
        every = int(step) if step else 1
        if base in ("*", ""):
            hit = value % every == 0
        elif "-" in base:
            low, high = map(int, base.split("-", 1))
            hit = value.between(low, high) & ((value - low) % every == 0)
        elif every == 1:
            hit = value == int(base)
        else:
            hit = (value >= int(base)) & ((value - int(base)) % every == 0)
        out = out | hit
    return out


def cron_matches(expression: str, moment: Column) -> Column:
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"cron must have 5 fields, got {expression!r}")
    minute, hour, day, month, weekday = fields
    dow = F.dayofweek(moment) - 1  # Sunday is 0
    sunday = F.when(dow == 0, cron_field(weekday, F.lit(7))).otherwise(F.lit(False))
    return cron_field(minute, F.minute(moment)) & cron_field(hour, F.hour(moment)) & cron_field(day, F.dayofmonth(moment)) & cron_field(month, F.month(moment)) & (cron_field(weekday, dow) | sunday)


def next_fire(starts: DataFrame, expression: str, days: int = 14) -> DataFrame:
    """schedule_id, next_at: the first full minute after `now` that matches, within so many days."""
    first = F.date_trunc("minute", "now") + F.expr("interval 1 minute")
    minutes = starts.select("schedule_id", F.explode(F.sequence(first, F.col("now") + F.expr(f"interval {days} days"), F.expr("interval 1 minute"))).alias("at"))
    found = minutes.filter(cron_matches(expression, F.col("at"))).groupBy("schedule_id").agg(F.min("at").alias("next_at"))
    return starts.select("schedule_id").join(found, "schedule_id", "left")


def due(schedules: DataFrame, expression: str) -> DataFrame:
    """Schedules (schedule_id, now, last_slot) that match this minute and have not fired in it."""
    slot = F.date_format("now", "yyyy-MM-dd'T'HH:mm")
    return schedules.filter(cron_matches(expression, F.col("now")) & ~slot.eqNullSafe(F.col("last_slot"))).withColumn("slot", slot)


def illegal_transitions(moves: DataFrame) -> DataFrame:
    """Moves (source, target) that are not allowed."""
    legal = moves.sparkSession.createDataFrame(TRANSITIONS, "source string, target string")
    return moves.join(F.broadcast(legal), ["source", "target"], "left_anti")  # a fixed list


def within_budget(steps: DataFrame, key: str, order: str, caps: dict[str, int]) -> DataFrame:
    """Steps of runs with their running sums, and the first cap that each step exceeds."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = steps
    out = F.lit(None).cast("string")
    for name, cap in reversed(caps.items()):
        rows = rows.withColumn(f"total_{name}", F.sum(name).over(w))
        out = F.when(F.col(f"total_{name}") > cap, F.lit(name)).otherwise(out)
    return rows.withColumn("exceeded", out)


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix, name in LANGUAGES.items():
        out = F.when(F.lower(path).endswith(f".{suffix}"), F.lit(name)).otherwise(out)
    return out


def skip_reason(path: Column, size: Column, most_bytes: int = 1_000_000) -> Column:
    """Why a repository's file is not read, or null."""
    return (
        F.when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_DIRS))), "directory")
        .when(F.lower(path).rlike(r"\.(png|jpe?g|gif|webp|ico|woff2?|ttf|pdf|zip|gz|mp4|lock|map)$"), "suffix")
        .when(size > most_bytes, "size")
    )


def language_majority(files: DataFrame, key: str) -> DataFrame:
    counts = files.filter(language_of(F.col("path")).isNotNull()).groupBy(key, language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by("language", F.struct(-F.col("n"), "language")).alias("language"))


def authority_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, AUTHORITY)), level).cast("int")


def redacted(text: Column, clip: int = 500) -> Column:
    secret = r"(?i)(token|secret|password|api[_-]?key|authorization)"
    return F.when(text.rlike(secret), F.lit("[redacted]")).otherwise(F.substring(text, 1, clip))


def report_status(has_run: Column, gaps: Column) -> Column:
    return F.when(~has_run, "failed").when(F.size(gaps) > 0, "partial").otherwise("succeeded")
