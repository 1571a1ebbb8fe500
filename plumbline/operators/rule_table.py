"""Rules that stand in a table: field paths are resolved and operators chosen for each row at run time.

Records become VARIANT values; a rule names a dotted path into them, one of the operators and an expected value as JSON.
The rules (a bounded number, by their paths) meet every record's values, and one expression judges all of them, so the
plan is the same for one rule and for thousands, and a rule is edited as a row. A path is read once for all its rules. Judgements have three values, as in rules.py;
what cannot be judged is a second output. Records of any table can be judged, and of several tables one after another.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import OPERATORS, Rule

#: Rules that one pass takes along with each record.
MAX_RULES = 10_000
#: Different paths that stand in the plan, where they are read once; of more, each is read anew for every record.
LITERAL_PATHS = 100

RULE = "rule_id string, field string, operator string, value string, expected string"


def catalog_rows(spark, rules: list[Rule]) -> DataFrame:
    """The generic rules of a catalog as rows."""
    rows = [(r.rule_id, r.field, r.operator, json.dumps(r.value), r.expected) for r in rules if r.field and r.operator]
    return spark.createDataFrame(rows, RULE)


def problems(rules: DataFrame) -> DataFrame:
    """rule_id, problem: rows that cannot be used."""
    value = F.try_parse_json("value")
    listed = F.schema_of_variant(value).startswith("ARRAY")
    number = F.try_variant_get(value, "$", "double").isNotNull() & ~F.schema_of_variant(value).isin("STRING", "BOOLEAN")
    own = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("field", F.lit(""))) == "", F.lit("no field")),
            F.when(~F.coalesce(F.col("operator").isin(OPERATORS), F.lit(False)), F.lit("unknown operator")),
            F.when(F.col("value").isNotNull() & value.isNull(), F.lit("value is not JSON")),
            F.when(F.col("operator").isin("in", "not_in") & ~F.coalesce(listed, F.lit(False)), F.lit("value is not a list")),
            F.when(F.col("operator").isin("gt", "gte", "lt", "lte") | F.col("operator").rlike("^(length|count)_"), F.when(~F.coalesce(number, F.lit(False)), F.lit("value is not a number"))),
        )
    )
    return rules.select("rule_id", F.explode(own).alias("problem"))


def _path(field: Column) -> Column:
    """A dotted path as a path into a variant; numbers are places of a list."""
    parts = F.transform(F.split(field, r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("['"), F.regexp_replace(p, "'", ""), F.lit("']"))))
    return F.concat(F.lit("$"), F.array_join(parts, ""))


def _prepared(rules: DataFrame) -> DataFrame:
    """path, rules, numbers: the rules of each path, with what their operators need of the expected value, and whether any compares numbers."""
    value = F.try_parse_json("value")
    got = lambda kind: F.try_variant_get(value, "$", kind)
    own = F.struct(
        "rule_id",
        "expected",
        "operator",
        _path(F.col("field")).alias("path"),
        F.to_json(value).alias("same"),
        got("string").alias("text"),
        F.when(F.schema_of_variant(value) != "STRING", got("double")).alias("number"),
        F.transform(got("array<variant>"), lambda v: F.to_json(v)).alias("list"),
    )
    return rules.select(own.alias("r")).groupBy("r.path").agg(F.array_sort(F.collect_list("r")).alias("rules"), F.max(F.col("r.number").isNotNull()).alias("numbers"))


def _judged(rows: DataFrame) -> DataFrame:
    """affected_resource, rule_id, found, hit, observed_value, expected_condition of rows (affected_resource, actual, rules, numbers).

    What several operators read is a column of its own, so that it is worked out once for each value.
    """
    rule, actual, kind, json, text, blank, said, items, names, number = map(F.col, ("rule", "actual", "kind", "json", "text", "blank", "said", "items", "names", "number"))
    rows = rows.withColumns({"kind": F.schema_of_variant(actual), "json": F.to_json(actual)})
    rows = rows.withColumns({"blank": actual.isNull() | (kind == "VOID"), "text": F.when(kind == "STRING", F.try_variant_get(actual, "$", "string"))})
    rows = rows.withColumns(
        {
            "said": F.coalesce(text, F.when(~blank, json)),
            "items": F.when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(actual, "$", "array<variant>"), lambda v: F.to_json(v))),
            "names": F.when(kind.startswith("OBJECT"), F.map_keys(F.try_variant_get(actual, "$", "map<string,variant>"))),
        }
    )
    rows = rows.withColumn("number", F.when(F.col("numbers"), said.try_cast("double")))
    rows = rows.select("affected_resource", "actual", "kind", "json", "text", "blank", "said", "items", "names", "number", F.explode("rules").alias("rule"))
    size = F.coalesce(F.when(items.isNotNull(), F.size(items)), F.when(names.isNotNull(), F.size(names)), F.length(said))
    both = rule["number"].isNotNull() & (kind != "STRING") & number.isNotNull()
    same = F.when(blank, rule["same"].isNull() | (rule["same"] == "null")).when(both, number == rule["number"]).otherwise(F.coalesce(json == rule["same"], F.lit(False)))
    missing = F.when(kind == "STRING", F.trim(text) == "").otherwise(blank)
    held = F.when(items.isNotNull(), F.array_contains(items, rule["same"])).when(names.isNotNull(), F.array_contains(names, rule["text"])).when(~blank, F.contains(said, rule["text"]))
    member = F.coalesce(F.array_contains(rule["list"], json), F.lit(False))
    when = lambda *own: rule["operator"].isin(*own)
    hit = (
        F.when(when("is_null"), F.coalesce(missing, F.lit(True)))
        .when(when("not_null"), ~F.coalesce(missing, F.lit(True)))
        .when(when("equals"), same)
        .when(when("not_equals"), ~same)
        .when(when("gt"), number > rule["number"])
        .when(when("gte"), number >= rule["number"])
        .when(when("lt"), number < rule["number"])
        .when(when("lte"), number <= rule["number"])
        .when(when("length_gt", "count_gt"), size > rule["number"])
        .when(when("length_lt", "count_lt"), size < rule["number"])
        .when(when("count_eq"), size == rule["number"])
        .when(when("contains"), held)
        .when(when("not_contains"), ~held)
        .when(when("regex_match"), F.regexp(said, rule["text"]))
        .when(when("in"), member)
        .when(when("not_in"), ~member)
    )
    judgement = F.struct(rule["rule_id"].alias("rule_id"), actual.isNotNull().alias("found"), hit.alias("hit"), said.alias("observed_value"), rule["expected"].alias("expected_condition"))
    # made by a generator, through which no filter on hits is pushed that would work all of it out anew
    return rows.select("affected_resource", F.inline(F.array(judgement)))


def judged(records: DataFrame, rules: DataFrame, resource: str) -> DataFrame:
    """resource, rule_id, found, hit, observed_value, expected_condition for every record and rule (see RULE).

    found tells whether the record has the field; hit is null where the operator does not apply to its value. Rules
    that problems() names are left out. Columns of records are the fields; nested ones are reached by dots.
    """
    usable = rules.join(problems(rules).select("rule_id").distinct(), "rule_id", "left_anti")
    if usable.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: judge them in several passes")
    record = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    rows = records.select(F.col(f"`{resource}`").cast("string").alias("affected_resource"), record.alias("record"))
    prepared = F.broadcast(_prepared(usable))  # at most MAX_RULES
    paths = [r["path"] for r in prepared.select("path").limit(LITERAL_PATHS + 1).collect()]
    if 0 < len(paths) <= LITERAL_PATHS:
        read = F.array(*[F.struct(F.lit(p).alias("path"), F.variant_get("record", p, "variant").alias("actual")) for p in sorted(paths)])
        return _judged(rows.select("affected_resource", F.inline(read)).join(prepared, "path"))
    return _judged(rows.crossJoin(prepared).withColumn("actual", F.variant_get("record", F.col("path"), "variant")).drop("record"))


def hits(judgements: DataFrame) -> DataFrame:
    return judgements.filter("hit").select("rule_id", "affected_resource", "observed_value", "expected_condition")


def skips(judgements: DataFrame) -> DataFrame:
    """rule_id, reason, n: how many records a rule could not judge, and why."""
    reason = F.when(~F.col("found"), "unknown_field").otherwise("inapplicable")
    return judgements.filter("hit is null").groupBy("rule_id", reason.alias("reason")).agg(F.count("*").alias("n"))
