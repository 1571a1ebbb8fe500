import pytest
from pyspark.sql import functions as F

from plumbline.functions import agent_tools
from plumbline.operators import rule_table
from plumbline.operators.rules import OPERATORS


def judged(spark, rules):
    records = spark.sql("""SELECT 'r1' AS url, 'abc' AS s, 5 AS n, array('x', 'y') AS l, map('og:title', 't') AS m, named_struct('deep', named_struct('v', cast(null as string), 'w', true)) AS o
        UNION ALL SELECT 'r2', ' ', -1, array(), map(), named_struct('deep', named_struct('v', 'q', 'w', false))
        UNION ALL SELECT 'r3', null, null, null, null, null""")
    rows = spark.createDataFrame([(f"{k:02d}", *r, "") for k, r in enumerate(rules)], rule_table.RULE)
    return rule_table.judged(records, rows, "url")


CASES = [
    (("s", "is_null", None), [False, True, True]),
    (("o.deep.v", "not_null", None), [False, True, False]),
    (("n", "equals", "5.0"), [True, False, False]),
    (("s", "not_equals", '"abc"'), [False, True, True]),
    (("o.deep.w", "equals", "true"), [True, False, False]),
    (("n", "equals", '"5"'), [False, False, False]),
    (("n", "gt", "4"), [True, False, None]),
    (("s", "lt", "4"), [None, None, None]),
    (("l", "count_eq", "2"), [True, False, None]),
    (("m", "count_lt", "1"), [False, True, None]),
    (("s", "length_gt", "2"), [True, False, None]),
    (("l", "contains", '"y"'), [True, False, None]),
    (("m", "contains", '"og:title"'), [True, False, None]),
    (("s", "not_contains", '"b"'), [False, True, None]),
    (("s", "regex_match", '"^a.c$"'), [True, False, None]),
    (("n", "in", "[4, 5]"), [True, False, False]),
    (("s", "not_in", '["abc"]'), [False, True, True]),
    (("l.1", "equals", '"y"'), [True, False, False]),
]


def test_operators_on_nested_values(spark):
    found = {}
    for r in judged(spark, [rule for rule, _ in CASES]).collect():
        found.setdefault(int(r["rule_id"]), {})[r["affected_resource"]] = r["hit"]
    for k, (rule, want) in enumerate(CASES):
        assert [found[k][u] for u in ("r1", "r2", "r3")] == want, rule
    assert {rule[1] for rule, _ in CASES} | {"gte", "lte", "length_lt", "count_gt"} == set(OPERATORS)


def test_rules_that_cannot_be_used_and_skips(spark):
    rules = [("s", "like", '"a"'), ("", "is_null", None), ("n", "gt", '"4"'), ("n", "in", "4"), ("n", "equals", "{bad"), ("nope.x", "gt", "1"), ("s", "lt", "1")]
    rows = spark.createDataFrame([(f"{k:02d}", *r, "") for k, r in enumerate(rules)], rule_table.RULE)
    assert {int(r["rule_id"]) for r in rule_table.problems(rows).collect()} == {0, 1, 2, 3, 4}
    got = {(r["rule_id"], r["reason"]): r["n"] for r in rule_table.skips(judged(spark, rules)).collect()}
    assert got == {("05", "unknown_field"): 3, ("06", "inapplicable"): 3}


def test_plan_does_not_grow_with_rules(spark):
    size = lambda n: len(judged(spark, [("s", "equals", '"a"')] * n)._jdf.queryExecution().optimizedPlan().toString())
    one, many = size(1), size(400)
    assert many < 1.5 * one + 2000


def test_too_many_rules(spark, monkeypatch):
    monkeypatch.setattr(rule_table, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        judged(spark, [("s", "is_null", None)] * 3)


NESTED = """<script>// registerTool({name:"no"})
navigator.modelContext.registerTool({name:"buy", execute: async () => { return fn({a:1}, "})") /* }) */ }, description:"Buy \\"it\\"", inputSchema: {type:"object"}, annotations: {readOnlyHint: true}});
x.registerTool( /* c */ {name: `t2`, description: cond ? "a" : "b", annotations: {readOnlyHint: null}, outputSchema: null})
myregisterTool({name:"nope"}); registerTool({description: "x"}); registerTool({name:"m", execute(){}, description:"lost"}); registerTool({name: 'buy'})</script>
<template><script>registerTool({name:"tpl"})</script><form toolname="tpl"></form></template>
<form toolname="find" id=f tooldescription=" F "><input name=q></form><FORM TOOLNAME=" g "></FORM><input name=z form=h><form toolname="h" id="h"></form>"""
TOOLS = [
    ("buy", "imperative", 'Buy "it"', False, True, True, True),
    ("t2", "imperative", None, False, False, False, False),
    ("m", "imperative", None, True, False, False, False),
    ("find", "declarative", "F", False, True, False, False),
    ("g", "declarative", None, True, False, False, False),
    ("h", "declarative", None, True, True, False, False),
]


def test_tools_with_nested_bodies():
    assert agent_tools.scan(NESTED) == TOOLS
    assert agent_tools.scan(None) == agent_tools.scan("") == agent_tools.scan("<p>registerTool</p>") == []


def test_long_and_broken_scripts_are_read_in_proportion():
    import time

    began = time.time()
    for body in ("{" * 300_000, "registerTool({" * 60_000, "'" + "\\a" * 300_000, "/*" * 300_000, "`${" * 200_000):
        agent_tools.scan("<script>registerTool({name: 'a', x: " + body)
    assert time.time() - began < 20


def test_table_function_and_array(spark):
    pages = spark.createDataFrame([(1, NESTED), (2, None), (3, "<p>")], "page_id long, html string")
    rows = agent_tools.offered(pages).collect()
    assert [tuple(r)[1:] for r in rows] == TOOLS and {r["page_id"] for r in rows} == {1}
    arrays = {r["page_id"]: [tuple(t) for t in r["tools"]] for r in pages.select("page_id", agent_tools.detected(F.col("html")).alias("tools")).collect()}
    assert arrays == {1: TOOLS, 2: [], 3: []}


def test_paths_beyond_those_in_the_plan(spark, monkeypatch):
    rules = [rule for rule, _ in CASES] + [(f"o.deep.x{k}", "is_null", None) for k in range(3)]
    found = sorted(map(str, judged(spark, rules).collect()))
    monkeypatch.setattr(rule_table, "LITERAL_PATHS", 2)
    assert sorted(map(str, judged(spark, rules).collect())) == found


def test_a_path_is_read_once_for_all_its_rules(spark):
    plan = lambda rules: judged(spark, rules)._jdf.queryExecution().optimizedPlan().toString()
    read = lambda rules: sum(plan(rules).lower().count(x) for x in ("variant_get(record", "variant_get(lambda"))
    assert read([("s", "gt", "1"), ("s", "contains", '"a"'), ("s", "not_contains", '"b"')]) == 1
