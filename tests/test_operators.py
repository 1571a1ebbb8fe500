import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import changes, crawl, graph, index, retrieval, search, text


def test_period_windows_need_history(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(i), 101 + i, 2, 10.0) for i in range(14)]
    rows = search.period_comparisons(spark.createDataFrame(days, "day date, impressions long, clicks long, position double"))
    got = {r["period"]: r for r in rows.collect()}
    assert got["day"]["status"] == got["week"]["status"] == "observed" and got["day"]["delta_impressions"] == 1
    assert got["week"]["current_impressions"] == sum(range(108, 115))
    assert got["month"]["status"] == "unavailable" and got["month"]["detail"] == "need 60 daily rows, have 14"


def test_period_windows_of_an_empty_series(spark):
    rows = search.period_comparisons(spark.createDataFrame([], "day date, impressions long, clicks long, position double"))
    assert {r["status"] for r in rows.collect()} == {"unavailable"}


def test_keyword_opportunities(spark):
    rows = [(1, "keep position", 50, 5, 0.10, 8.0), (2, "keep ctr", 200, 2, 0.01, 3.0), (3, "drop both", 9999, 500, 0.05, 4.0), (5, "keep both", 80, 0, 0.005, 11.2), (6, " ", 9, 0, 0.0, 9.0), (7, None, 9, 0, 0.0, 9.0), (8, "at the bound", 9, 0, 0.02, 7.99)]
    found = search.keyword_opportunities(spark.createDataFrame(rows, "id long, query string, impressions long, clicks long, ctr double, position double"))
    got = {r["query"]: r for r in found.collect()}
    assert set(got) == {"keep position", "keep ctr", "keep both"} and got["keep both"]["filters"] == ["position", "ctr"]
    assert [r["query"] for r in search.top_rows(found, 9).collect()] == ["keep ctr", "keep both", "keep position"]
    assert got["keep both"]["reason"] == "80 impressions, position 11.2, CTR 0.5%"


def test_movement(spark):
    schema = "query string, impressions long, clicks long, ctr double, position double"
    now = spark.createDataFrame([("a", 10, 1, 0.1, 3.0), ("b", 5, 1, 0.2, 3.0), ("c", 7, 0, 0.0, 1.0), ("d", 1, 0, 0.0, 1.0)], schema)
    before = spark.createDataFrame([("a", 8, 1, 0.125, 4.0), ("b", 9, 1, 0.1, 2.0), ("c", 7, 0, 0.0, 1.0)], schema)
    got = {r["query"]: (r["movement"], r["delta_impressions"]) for r in search.movement(now, before, "query").collect()}
    assert got == {"a": ("up", 2), "b": ("down", -4), "c": ("flat", 0), "d": ("new", None)}
    assert {r["movement"] for r in search.movement(now, before.limit(0), "query").collect()} == {"unknown"}


def test_metric_snapshots(spark):
    one = search.snapshot(spark, spark.createDataFrame([("impressions", 1000.0)], "key string, value double"))
    two = search.snapshot(spark, spark.createDataFrame([("impressions", 1200.0), ("clicks", 3.0)], "key string, value double"))
    got = {r["key"]: (r["status"], r["delta"]) for r in search.compare_metrics(one, two).collect()}
    assert len(got) == 11 and got["impressions"] == ("observed", 200.0) and got["clicks"] == ("unavailable", None)


def test_replaced_runs(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame([(1, "page", 5), (2, "page", 6)], "analysis_run_id int, dimension string, impressions long")
    search.replace_runs(rows, path)
    search.replace_runs(spark.createDataFrame([(2, "page", 9)], rows.schema), path)
    assert sorted(r["impressions"] for r in spark.read.parquet(path).collect()) == [5, 9]


def test_fusion_and_metrics(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, doc_id long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 3.0, 1), (1, 12, 2.0, 2)], a.schema)
    got = retrieval.fused(retrieval.channel(a, "semantic"), retrieval.channel(b, "lexical")).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [11, 10, 12] and got[0]["channel"] == "lexical"
    assert got[0]["rrf"] == pytest.approx(1 / 61 + 1 / 62)
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "query_id long, doc_id long, rank int")
    m = retrieval.evaluated(ranked, spark.createDataFrame([(1, 8), (1, 9)], "query_id long, doc_id long")).first()
    assert (m["recall"], m["precision"], m["mrr"]) == (1.0, 2 / 8, 0.5) and 0 < m["ndcg"] < 1
    none = retrieval.evaluated(ranked.limit(0), spark.createDataFrame([(1, 8)], "query_id long, doc_id long")).first()
    assert (none["recall"], none["mrr"], none["ndcg"]) == (0.0, 0.0, 0.0)


def test_understanding_and_scope(spark):
    got = retrieval.understand(F.col("q"))
    row = spark.createDataFrame([("Where does  ProductPage use app/x/page.tsx SEO-TITLE-001?",)], "q string").select(*[c.alias(n) for n, c in got.items()]).first()
    assert row["rule_ids"] == ["SEO-TITLE-001"] and "ProductPage" in row["identifiers"] and "where" not in row["tokens"]
    rows = spark.createDataFrame([(1, "code"), (2, "page")], "doc_id long, kind string")
    assert retrieval.scoped(rows, kind=["code"], doc_id=None).count() == 1 and retrieval.scoped(rows, kind=[]).count() == 2


def test_semantic_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "doc_id long, vector array<double>")
    found = retrieval.semantic(df.filter("doc_id < 3").withColumnRenamed("doc_id", "query_id"), df, limit=5).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(3):
        assert {r["doc_id"] for r in found if r["query_id"] == q} == set(np.argsort(-(unit @ unit[q]))[:5].tolist())


def test_graph(spark):
    edges = spark.createDataFrame([("L", "a", "b"), ("L", "b", "c"), ("L", "c", "d"), ("L", "d", "e"), ("L", "a", "b")], "type string, src string, dst string")
    seeds = spark.createDataFrame([("c",)], "node string")
    assert sorted((r["node"], r["hops"]) for r in graph.reachable(edges, seeds, 2).collect()) == [("a", 2), ("b", 1), ("c", 0), ("d", 1), ("e", 2)]
    nodes = spark.createDataFrame([("a",), ("b",), ("z",)], "node string")
    assert [r["node"] for r in graph.orphan_nodes(nodes, edges).collect()] == ["a", "z"]
    assert {r["node"]: r["inbound"] for r in graph.inbound_counts(nodes, edges).collect()} == {"a": 0, "b": 1, "z": 0}


def test_code_graph(spark):
    symbols = spark.createDataFrame([("s1", "run", "a.py"), ("s2", "run", "b.py"), ("s3", "go", "b.py")], "stable_id string, name string, file_path string")
    calls = spark.createDataFrame([("x", "a.py", "run"), ("y", "c.py", "run"), ("z", "c.py", "none")], "src string, file_path string, callee string")
    assert sorted((r["src"], r["dst"]) for r in graph.code_edges(symbols, calls).collect()) == [("x", "s1"), ("y", "s1"), ("y", "s2")]
    files = spark.createDataFrame([("lib/db.ts",), ("lib/db/index.ts",)], "path string")
    imports = spark.createDataFrame([("app/p.ts", "../lib/db"), ("app/p.ts", "./none")], "file_path string, target string")
    assert [r["resolved"] for r in graph.resolved_imports(imports, files).collect()] == ["lib/db.ts"]


def test_incremental_index(spark):
    schema = "id long, content_hash string, meta_hash string"
    stored = spark.createDataFrame([(1, "a", "m"), (2, "b", "m"), (3, "c", "m"), (4, "d", "m")], schema)
    current = spark.createDataFrame([(1, "a", "m"), (2, "x", "m"), (3, "c", "n"), (5, "e", "m")], schema)
    got = {r["id"]: r["action"] for r in index.diff(stored, current).collect()}
    assert got == {1: "reuse", 2: "embed", 3: "patch", 4: "delete", 5: "embed"}


def test_versions(spark):
    rows = spark.createDataFrame([("r", 1, "x")], "rule string, version int, text string")
    same = index.versioned(rows, rows.select("rule", "text"), "rule", ["text"])
    assert same.count() == 1
    edited = index.versioned(rows, spark.createDataFrame([("r", "y"), ("s", None)], "rule string, text string"), "rule", ["text"])
    got = {(r["rule"], r["version"]): r["is_current"] for r in index.with_current(edited, "rule").collect()}
    assert got == {("r", 1): False, ("r", 2): True, ("s", 1): True}


def test_lines_and_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n\n# A\none\ntwo\n\n# B"), (2, None), (3, "")], "doc_id long, text string")
    rows = text.lines(docs)
    assert sorted((r["first"], r["last"]) for r in text.paragraphs(rows).filter("doc_id = 1").collect()) == [(1, 1), (3, 5), (7, 7)]
    assert sorted((r["first"], r["last"], r["title"]) for r in text.sections(rows).filter("doc_id = 1").collect()) == [(1, 2, None), (3, 6, "# A"), (7, 7, "# B")]
    covered = spark.createDataFrame([(1, 3, 4)], "doc_id long, first int, last int")
    assert sorted((r["first"], r["last"]) for r in text.uncovered(rows, covered).filter("doc_id = 1").collect()) == [(1, 1), (5, 5), (7, 7)]
    runs = spark.createDataFrame([(1, 1, 200)], "doc_id long, first int, last int")
    assert sorted((r["first"], r["last"]) for r in text.line_windows(runs).collect()) == [(1, 80), (81, 160), (161, 200)]


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "Criminal law. Criminal law. criminal law flaw"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["keywords"] for r in text.keyword_candidates(docs).collect()}
    assert got == {1: ["criminal", "criminal law", "law criminal", "flaw", "law flaw"]}


def test_content_changes(spark):
    pairs = [(1, "We sell 5% off.", "We sell 5% off. Studies show 90% agree."), (2, "text", " "), (3, "word", "word " * 6), (4, "same", "same"), (5, None, None)]
    got = {(r["doc_id"], r["rule"]) for r in text.content_changes(spark.createDataFrame(pairs, "doc_id long, before string, after string")).collect()}
    assert got == {(1, "unsupported_statistic"), (1, "unsupported_attribution"), (2, "content_removed"), (3, "keyword_stuffing")}


def test_content_text_is_worked_out_once_for_each_side(spark):
    pairs = spark.createDataFrame([(1, "a", "b")], "doc_id long, before string, after string")
    plan = text.content_changes(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)(?:https?://") == 4  # two branches of two texts


def test_packing(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([10, 20, 30, 5, 5])], "k long, turn int, tokens long")
    got = [r["batch"] for r in text.packed(rows, "k", "turn", "tokens", most=3, budget=40).orderBy("turn").collect()]
    assert got == [0, 0, 1, 1, 1]


@pytest.mark.parametrize(
    "files, violation",
    [([], "no_files"), (["../x"], "path_traversal"), (["src/../../x"], "path_traversal"), (["/etc/x"], "path_traversal"), (["src/secret/a"], "forbidden_directory"), (["docs/a"], "outside_planned_scope"), (["src/a", "src/b", "src/c"], "too_many_files"), (["src/../src/a"], None)],
)
def test_scope(spark, files, violation):
    df = spark.createDataFrame([(files,)], "files array<string>")
    got = changes.scope_violation(F.col("files"), F.array(F.lit("src")), F.array(F.lit("src/secret")), F.lit(1), F.lit(1), 2, 10, 10)
    assert df.select(got.alias("v")).first()["v"] == violation


def test_cron_and_next_fire(spark):
    moments = [("2024-01-07 00:00:00", "0 0 * * 7", True), ("2024-01-07 00:00:00", "0 0 * * 0", True), ("2024-01-08 09:30:00", "*/15 9-17 * * 1-5", True), ("2024-01-08 09:31:00", "*/15 9-17 * * 1-5", False)]
    for at, expression, expected in moments:
        df = spark.createDataFrame([(at,)], "t string").select(changes.cron_matches(expression, F.to_timestamp("t")).alias("x"))
        assert df.first()["x"] is expected
    with pytest.raises(ValueError):
        changes.cron_matches("* *", F.lit(None))
    now = spark.createDataFrame([(1, "2024-01-06 10:00:30")], "schedule_id int, t string").select("schedule_id", F.to_timestamp("t").alias("now"))
    assert str(changes.next_fire(now, "30 8 * * 1").first()["next_at"]) == "2024-01-08 08:30:00"


ROBOTS = """# comment
User-agent: *
Disallow: /private
Allow: /private/open
User-agent: GPTBot
User-agent: OurBot
Disallow: /
Sitemap: https://e.com/sitemap.xml"""


def test_robots(spark):
    lines = crawl.robots_lines(spark.createDataFrame([("https://e.com", ROBOTS), ("https://f.com", None)], "origin string, text string"))
    groups = crawl.robots_groups(lines)
    urls = spark.createDataFrame([("https://e.com/private/x",), ("https://e.com/private/open/y",), ("https://e.com/z",), ("https://f.com/private",)], "url string")
    got = {r["url"]: r["allowed"] for r in crawl.allowed(urls, crawl.rules_for(groups, "somebot/1.0")).collect()}
    assert got == {"https://e.com/private/x": False, "https://e.com/private/open/y": True, "https://e.com/z": True, "https://f.com/private": True}
    assert not any(r["allowed"] for r in crawl.allowed(urls.filter("url like '%e.com%'"), crawl.rules_for(groups, "OurBot")).collect())
    assert [r["bots"] for r in crawl.ai_bots_shut_out(groups).collect()] == [["gptbot"]]


def test_sitemaps(spark):
    good = "<urlset><url><loc>https://e.com/a/</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://www.e.com/a</loc><lastmod>soon</lastmod></url><url><loc>https://other.org/</loc></url></urlset>"
    rows = [("1", good), ("2", ""), ("3", "<html></html>"), ("4", "<urlset><url>"), ("5", "<sitemapindex><sitemap><loc>https://e.com/s1.xml</loc></sitemap></sitemapindex>"), ("6", None)]
    df = spark.createDataFrame([(u, "https://e.com", x) for u, x in rows], "url string, origin string, xml string")
    got = {r["url"]: r for r in crawl.sitemap_records(df).collect()}
    assert (got["1"]["parse_state"], got["1"]["page_urls"], got["1"]["duplicate_loc_count"], got["1"]["invalid_lastmod_count"]) == ("valid", ["https://e.com/a"], 1, 1)
    assert [got[k]["parse_state"] for k in "23456"] == ["unavailable", "not_xml", "invalid", "valid", "unavailable"] and got["5"]["child_sitemaps"] == ["https://e.com/s1.xml"]


def test_crawl_replay(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "x")], "source string, target string")
    found = crawl.bfs(links, spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("x",)], "url string"), max_depth=2)
    assert sorted((r["url"], r["depth"]) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_more_queries_than_are_sent_at_once(spark, monkeypatch):
    vectors = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.cos(F.col("id") / 13), F.sin(F.col("id") / 13)).alias("vector"))
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("word"), F.col("id") % 9), F.concat(F.lit("item"), "id")).alias("text"))
    rows = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    found = [retrieval.semantic(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 5), retrieval.lexical(texts.withColumnRenamed("doc_id", "query_id"), texts, 5)]
    at_once = [rows(f) for f in found]
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 7)
    in_blocks = [rows(retrieval.semantic(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 5)), rows(retrieval.lexical(texts.withColumnRenamed("doc_id", "query_id"), texts, 5))]
    assert in_blocks == at_once and all(len(r) == 200 for r in at_once)


def test_metrics_of_every_query(spark, monkeypatch, tmp_path):
    vectors = spark.range(900).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") / 300), F.sin(F.col("id") / 300)).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 4)
    from plumbline.plans import catalog

    assert {r["query_id"] for r in catalog.QUERIES["retr_metrics"](spark, str(tmp_path)).collect()} == set(range(0, 900, 100))


def test_term_queries_take_every_document(spark, tmp_path):
    docs = [(1, "Criminal law flaw", "en"), (2, "Recht und Gesetz", "de"), (3, "droit", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    from plumbline.plans import catalog

    assert {r["doc_id"] for r in catalog.QUERIES["keyword_candidates"](spark, str(tmp_path)).collect()} == {1, 2, 3}
    terms = sorted((r["doc_id"], r["term"], r["n"]) for r in catalog.QUERIES["term_frequency"](spark, str(tmp_path)).collect())
    assert terms == [(1, "criminal", 1), (1, "criminal law", 1), (1, "flaw", 1), (1, "law", 1), (1, "law flaw", 1), (2, "gesetz", 1), (2, "recht", 1), (2, "recht und", 1), (2, "und", 1), (2, "und gesetz", 1), (3, "droit", 1)]


def test_impressions_of_all_findings_and_callers_of_all_targets(spark):
    from plumbline.plans import catalog

    sf = "/root/testdata/sf0.001"
    ids = {r["finding_id"] for r in catalog.QUERIES["finding_ids"](spark, sf).select("finding_id").collect()}
    got = catalog.QUERIES["findings_with_impressions"](spark, sf).collect()
    assert {r["finding_id"] for r in got} == ids and any(r["impressions"] % 20 == 10 for r in got if r["impressions"] is not None)
    callers = {r["dst"]: r["n"] for r in catalog.QUERIES["graph_callers"](spark, sf).collect()}
    some = {r["dst"]: r["n"] for r in catalog.QUERIES["graph_callers"](spark, sf).collect()}
    assert some.items() <= callers.items() and any(not t.endswith("3") for t in callers)
