"""Queries of retrieval, graphs, incremental indexes, texts and change control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, graph, index, retrieval, text
from ..sources.tables import table
from . import sql

_ASKED = "vec_id % 100 = 0"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    asked = corpus.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    found = retrieval.semantic(asked, corpus.filter("doc_id is not null"), limit=retrieval.CHANNEL_LIMIT)
    return found.withColumn("score", F.round("score", 9))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical(asked, table(spark, sf_dir, "documents").select("doc_id", "text"))


def query_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieval.understand(F.concat_ws(" ", F.col("text"), F.lit("check SEO-TITLE-MISSING-001 in app/shop/page.tsx for ProductPage")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", *[c.alias(n) for n, c in got.items()])
    return rows.select("item_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("rule_ids", " ").alias("rule_ids"), F.array_join("identifiers", " ").alias("identifiers"))


def retr_lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def retr_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def retr_rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels in one ranking: the items' lexical hits and, for the vectors of the same number, the semantic ones."""
    asked = _vectors(spark, sf_dir).filter("doc_id % 100 = 0").select((F.col("doc_id") / 100).cast("long").alias("query_id"), "vector")
    meaning = retrieval.semantic(asked, _vectors(spark, sf_dir))
    merged = retrieval.fused(retrieval.channel(meaning, "semantic"), retrieval.channel(_lexical(spark, sf_dir), "lexical"))
    return merged.select("query_id", "doc_id", "rank", F.round("rrf", 9).alias("rrf"), "channel")


def retr_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the nearest vectors share the label of the query's vector."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label").filter("vec_id is not null")
    asked = labels.filter(_ASKED).select(F.col("vec_id").alias("query_id"), "label")
    # relevant vectors are counted by label; only ranked ones are joined to their queries
    total = asked.join(labels.groupBy("label").agg((F.count("*") - 1).alias("n")), "label").filter("n > 0").select("query_id", "n")
    ranked = _semantic(spark, sf_dir).filter("query_id <> doc_id").withColumn("rank", F.col("rank") - 1).filter(F.col("rank") <= retrieval.EVIDENCE)
    hits = ranked.join(asked, "query_id").join(labels.withColumnRenamed("vec_id", "doc_id"), ["doc_id", "label"], "left_semi")
    got = retrieval.measured(total, hits)
    return got.select("query_id", *[F.round(m, 9).alias(m) for m in ("recall", "precision", "mrr", "ndcg")])


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as a graph."""
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    n, c, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return graph.union_edges(
        n.select(F.lit("IN").alias("type"), node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")),
        c.select(F.lit("IN").alias("type"), node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst")),
        s.select(F.lit("IN").alias("type"), node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst")),
    )


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.neighbours(_hierarchy(spark, sf_dir), seeds)


def graph_reachability_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_hierarchy(spark, sf_dir), spark.sql("SELECT 'n0' AS node"))


def graph_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many call each target."""
    return graph.incoming(_hierarchy(spark, sf_dir), "IN", F.col("dst").isNotNull()).groupBy("dst").agg(F.count("*").alias("n"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as they were stored and as they are: some are new, gone, changed or moved."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    stored = docs.filter("id % 10 <> 0").select("id", F.sha2(F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("content_hash"), F.when(F.col("id") % 6 == 0, F.lit("old")).otherwise(F.col("source")).alias("meta_hash"))
    return stored, docs.filter("id % 11 <> 0").select("id", F.sha2("text", 256).alias("content_hash"), F.col("source").alias("meta_hash"))


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.diff(*_snapshots(spark, sf_dir))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.diff_stats(index.diff(*_snapshots(spark, sf_dir)))


def rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stored once, then offered again with a new price for some: versions with a mark on the newest."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    stored = part.filter("p_partkey % 5 <> 0").withColumn("version", F.lit(1))
    offered = part.withColumn("p_retailprice", F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return index.with_current(index.versioned(stored, offered, "p_partkey", ["p_brand", "p_retailprice"]), "p_partkey").withColumn("p_retailprice", F.round("p_retailprice", 4))


def page_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    fresh = orders.filter("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("new"))
    return index.overlay(orders, fresh, "o_orderkey")


def last_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return index.last_values(events, "user_id", "event_id").select("user_id", "event_id", "event_type")


def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return index.changes_only(rows, "user_id", "event_id", "event_type")


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every document."""
    return text.term_frequency(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.keyword_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_paragraphs(table(spark, sf_dir, "documents"))


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_windows(table(spark, sf_dir, "documents"), size=3)


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_sections(table(spark, sf_dir, "documents"), heading="^[A-Z].{0,60}$")


def content_change_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.when(F.col("doc_id") % 5 == 0, " According to experts, 50% of 3 million agree.").when(F.col("doc_id") % 5 == 1, " cheap cheap cheap cheap cheap cheap").otherwise("")
    after = F.when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(F.concat(F.col("text"), added))
    return text.content_changes(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), after.alias("after")))


def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_estimate(F.length("text"), 4).alias("tokens"))
    return text.packed(rows, "conv_id", "turn", "tokens", most=3, budget=300)


def rollback_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col("l_quantity") > 5, F.col("l_linenumber") < 6, F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_returnflag") == "N"), F.col("l_linestatus") == "F"]
    rows = table(spark, sf_dir, "lineitem").select(changes.rollback_confidence(*flags).alias("confidence"))
    return rows.groupBy("confidence").agg(F.count("*").alias("n"))


def validation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_discount") > 0.08, "skipped").otherwise("passed")
    return changes.validation_status(table(spark, sf_dir, "lineitem").select("l_orderkey", status.alias("status")), "l_orderkey")


def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes: each line item is a changed file in a folder named by its flags."""
    file = F.concat_ws("/", F.when(F.col("l_tax") > 0.07, "..").otherwise("src"), F.when(F.col("l_returnflag") == "R", "secret").otherwise("app"), F.col("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(file).alias("files"), F.sum("l_quantity").alias("lines"))
    bad = changes.scope_violation(F.col("files"), F.array(F.lit("src")), F.array(F.lit("src/secret")), F.col("lines"), F.col("lines") * 40, 5, 120, 10_000)
    return rows.select("l_orderkey", bad.alias("violation"))


def schedule_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(changes.cron_matches("*/15 9-17 * 1,2 1-5", F.col("ts"))).select("event_id")


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("source"), F.when(F.col("o_orderkey") % 3 == 0, "succeeded").otherwise("cancelled").alias("target"), "o_orderkey")
    return changes.illegal_transitions(moves).select("o_orderkey", "source", "target")


def budgeted_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("iterations"), F.length("text").alias("tokens"))
    return changes.within_budget(rows, "conv_id", "turn", {"iterations": 6, "tokens": 3000}).select("conv_id", "turn", "total_tokens", "exceeded")


QUERIES = {
    q.__name__: q
    for q in (query_understanding, retr_lexical_overlap, retr_semantic_topk, retr_rrf_fused, retr_metrics, graph_neighbours, graph_reachability_3hop, graph_callers, index_diff, index_stats, rule_versions, page_overlay, last_progress, progress_changes, term_frequency, keyword_candidates, doc_paragraphs, line_windows, doc_sections, content_change_claims, budget_packing, rollback_confidence, validation_fold, scope_check, schedule_due, job_transitions, budgeted_loop)
}

_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3))"
_LEXICAL = f"""q AS (SELECT item_id AS query_id, len({_TOKENS}) AS n, unnest({_TOKENS}) AS t FROM benchmark), d AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents),
lx AS (SELECT query_id, doc_id, count(*) / any_value(n) AS score FROM q JOIN d USING (t) GROUP BY ALL), lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lx QUALIFY rank <= 50)"""
_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[])"
_SEMANTIC = f"sem AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, d.vec_id) AS rank FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 QUALIFY rank <= 50)"
_EDGES = "e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_DIFF = """a AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END AS t1, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE source END AS m1, 1 AS x FROM documents WHERE doc_id % 10 <> 0), c AS (SELECT doc_id AS id, text AS t2, source AS m2, 1 AS y FROM documents WHERE doc_id % 11 <> 0),
x AS (SELECT id, CASE WHEN y IS NULL THEN 'delete' WHEN x IS NULL OR t1 IS DISTINCT FROM t2 THEN 'embed' WHEN m1 IS DISTINCT FROM m2 THEN 'patch' ELSE 'reuse' END AS action FROM a FULL JOIN c USING (id))"""
_LINES = "l AS (SELECT doc_id, unnest(ls) AS value, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"
_RUNS = f"{_LINES}, r AS (SELECT doc_id, min(line)::INT AS first, max(line)::INT AS last FROM (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM l WHERE trim(value, ' ') <> '') GROUP BY doc_id, g)"
_KEY_STOP = ", ".join(f"'{w}'" for w in text.KEYWORD_STOP_WORDS)

_CONTENT_STOP = ", ".join(f"'{w}'" for w in text.CONTENT_STOP_WORDS)


def _content(x: str) -> str:
    """What content rules read of a text, for the shapes that the test data have."""
    for pattern, by in ((r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " "), ("<[^>]+>", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?i)(?:https?://|www\.)[^\s\"''<>)\]]+", " "), (r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}\b", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _new(pattern: str) -> str:
    every = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '{pattern}'), lambda m: lower(m)))"
    return f"list_sort(list_filter({every('y')}, lambda m: NOT list_contains({every('x')}, m)))"


ORACLES = {
    "query_understanding": rf"""WITH t AS (SELECT item_id, trim(regexp_replace(text || ' check SEO-TITLE-MISSING-001 in app/shop/page.tsx for ProductPage', '[ \t\n\r\f]+', ' ', 'g')) AS q FROM benchmark)
SELECT item_id, array_to_string(list_filter(list_transform(list_filter(regexp_extract_all(q, '[a-zA-Z0-9_]+'), lambda w: length(w) >= 3), lambda w: lower(w)), lambda w: w NOT IN ({_STOP})), ' ') AS tokens, array_to_string(regexp_extract_all(q, '{retrieval.RULE_ID}'), ' ') AS rule_ids,
  array_to_string(list_concat(regexp_extract_all(q, '{retrieval.RULE_ID}'), regexp_extract_all(q, '{retrieval.PATHS}'), regexp_extract_all(q, '{retrieval.IDENTIFIERS}')), ' ') AS identifiers FROM t""",
    "retr_lexical_overlap": f"WITH {_LEXICAL} SELECT query_id, doc_id, round(score, 9) AS score, rank::INT AS rank FROM lex",
    "retr_semantic_topk": f"WITH {_SEMANTIC} SELECT query_id, doc_id, round(score, 6) AS score FROM sem",
    "retr_rrf_fused": f"""WITH {_LEXICAL}, {_SEMANTIC}, u AS (SELECT query_id, doc_id, score, rank, 'lexical' AS channel FROM lex UNION ALL SELECT query_id // 100, doc_id, score, rank, 'semantic' FROM sem),
g AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_max(channel, {{'s': score, 'c': channel}}) AS channel FROM u GROUP BY ALL)
SELECT query_id, doc_id, rank::INT AS rank, round(rrf, 9) AS rrf, channel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, doc_id) AS rank FROM g) WHERE rank <= 100""",
    "retr_metrics": f"""WITH {_SEMANTIC}, rel AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d USING (label) WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
h AS (SELECT query_id, rank - 1 AS rank FROM sem SEMI JOIN rel USING (query_id, doc_id) WHERE rank - 1 <= 8), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), g AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM h GROUP BY 1)
SELECT query_id, round(coalesce(hits / n, 0.0), 9) AS recall, round(coalesce(hits / 8, 0.0), 9) AS precision, round(coalesce(1 / first, 0.0), 9) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 8) + 1), lambda i: 1 / log2(i + 1))), 0.0), 9) AS ndcg FROM n LEFT JOIN g USING (query_id)""",
    "graph_neighbours": f"WITH {_EDGES} SELECT src AS seed, dst AS neighbour FROM b WHERE src IN (SELECT 'n' || n_nationkey FROM nation)",
    "graph_reachability_3hop": f"WITH RECURSIVE {_EDGES}, v(node, hops) AS (SELECT 'n0', 0 UNION SELECT dst, hops + 1 FROM v JOIN b ON src = node WHERE hops < 3) SELECT node, min(hops)::INT AS hops FROM v GROUP BY node",
    "graph_callers": f"WITH {_EDGES} SELECT dst, count(*) AS n FROM e GROUP BY dst",
    "index_diff": f"WITH {_DIFF} SELECT * FROM x",
    "index_stats": f"WITH {_DIFF} SELECT action, count(*) AS n FROM x GROUP BY action",
    "rule_versions": """WITH s AS (SELECT p_partkey, 1 AS version, p_brand, p_retailprice FROM part WHERE p_partkey % 5 <> 0), o AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part),
a AS (SELECT * FROM s UNION ALL SELECT o.p_partkey, coalesce(s.version + 1, 1), o.p_brand, o.p_retailprice FROM o LEFT JOIN s USING (p_partkey) WHERE s.version IS NULL OR s.p_brand <> o.p_brand OR s.p_retailprice <> o.p_retailprice)
SELECT p_partkey, version, p_brand, round(p_retailprice, 4) AS p_retailprice, version = max(version) OVER (PARTITION BY p_partkey) AS is_current FROM a""",
    "page_overlay": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "last_progress": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "progress_changes": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type",
    "term_frequency": f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z''-]{{2,}}'), lambda w: w NOT IN ({_KEY_STOP})) AS t FROM documents),
u AS (SELECT doc_id, unnest(t) AS term FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t) SELECT doc_id, term, count(*) AS n FROM u GROUP BY ALL""",
    "keyword_candidates": f"WITH {sql.keywords('documents', 'doc_id', 'text')} SELECT doc_id, array_to_string(keywords, ',') AS keywords FROM kw",
    "doc_paragraphs": f"WITH {_RUNS} SELECT * FROM r",
    "line_windows": f"WITH {_RUNS} SELECT doc_id, s::INT AS first, least(s + 2, last)::INT AS last FROM (SELECT doc_id, last, unnest(range(first, last + 1, 3)) AS s FROM r)",
    "doc_sections": f"WITH {_LINES}, m AS (SELECT *, regexp_matches(value, '^[A-Z].{{0,60}}$') AS h FROM l), n AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM m) SELECT doc_id, section::BIGINT AS section, min(line)::INT AS first, max(line)::INT AS last, arg_min(value, line) FILTER (WHERE h) AS title FROM n GROUP BY doc_id, section",
    "rollback_confidence": "SELECT CASE WHEN l_linestatus = 'F' THEN least(c, 0.60) ELSE c END::DOUBLE AS confidence, count(*) AS n FROM (SELECT l_linestatus, CASE WHEN NOT l_quantity > 5 THEN 0.05 WHEN NOT l_linenumber < 6 THEN 0.20 WHEN l_returnflag = 'R' THEN 0.50 WHEN l_returnflag <> 'N' THEN 0.55 ELSE 0.98 END AS c FROM lineitem) GROUP BY 1",
    "validation_fold": "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_or(l_discount > 0.08) THEN 'partial' ELSE 'passed' END AS status FROM lineitem GROUP BY 1",
    "scope_check": "SELECT l_orderkey, CASE WHEN bool_or(l_tax > 0.07) THEN 'path_traversal' WHEN bool_or(l_returnflag = 'R') THEN 'forbidden_directory' WHEN count(*) > 5 THEN 'too_many_files' WHEN sum(l_quantity) > 120 THEN 'too_many_lines' END AS violation FROM lineitem GROUP BY 1",
    "schedule_due": "SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 9 AND 17 AND month(ts) IN (1, 2) AND dayofweek(ts) BETWEEN 1 AND 5",
    "job_transitions": "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'running' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'succeeded' ELSE 'cancelled' END AS target FROM orders) WHERE source = 'queued' AND target = 'succeeded'",
    "content_change_claims": rf"""WITH b AS (SELECT doc_id, coalesce(text, '') AS before, CASE WHEN doc_id % 17 = 0 THEN '' ELSE coalesce(text || CASE doc_id % 5 WHEN 0 THEN ' According to experts, 50% of 3 million agree.' WHEN 1 THEN ' cheap cheap cheap cheap cheap cheap' ELSE '' END, '') END AS after FROM documents),
t AS MATERIALIZED (SELECT doc_id, {_content('before')} AS x, {_content('after')} AS y, trim(before, ' ') <> '' AND trim(after, ' ') = '' AS gone FROM b),
u AS (SELECT doc_id, gone, {_new(text.STATISTIC)} AS stats, {_new(text.ATTRIBUTION)} AS said FROM t),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(y), '[a-z][a-z''-]{{2,}}')) AS word, 1 AS a, 0 AS b FROM t WHERE NOT gone UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(x), '[a-z][a-z''-]{{2,}}')), 0, 1 FROM t WHERE NOT gone),
c AS (SELECT doc_id, word, sum(a) AS a, sum(b) AS b FROM w WHERE word NOT IN ({_CONTENT_STOP}) GROUP BY 1, 2)
SELECT doc_id, 'content_removed' AS rule, '' AS detail FROM u WHERE gone
UNION ALL SELECT doc_id, 'unsupported_statistic', array_to_string(stats, ',') FROM u WHERE NOT gone AND len(stats) > 0
UNION ALL SELECT doc_id, 'unsupported_attribution', array_to_string(said, ',') FROM u WHERE NOT gone AND len(said) > 0
UNION ALL SELECT doc_id, 'keyword_stuffing', word || ' ' || a || ' ' || b FROM c WHERE a >= {text.STUFFED} AND (b = 0 OR a / b >= {text.STUFFING})""",
    "budget_packing": """WITH RECURSIVE r AS MATERIALIZED (SELECT conv_id, turn, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
w(conv_id, turn, tokens, k, batch, n, total) AS (SELECT conv_id, turn, tokens, k, 0, 1, coalesce(tokens, 0) FROM r WHERE k = 1
UNION ALL SELECT r.conv_id, r.turn, r.tokens, r.k, CASE WHEN w.n >= 3 OR w.total + coalesce(r.tokens, 0) > 300 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.n >= 3 OR w.total + coalesce(r.tokens, 0) > 300 THEN 1 ELSE w.n + 1 END,
  CASE WHEN w.n >= 3 OR w.total + coalesce(r.tokens, 0) > 300 THEN coalesce(r.tokens, 0) ELSE w.total + coalesce(r.tokens, 0) END FROM w JOIN r ON r.conv_id = w.conv_id AND r.k = w.k + 1)
SELECT conv_id, turn, tokens::BIGINT AS tokens, batch::INT AS batch FROM w""",
    "budgeted_loop": "SELECT conv_id, turn, total_tokens::BIGINT AS total_tokens, CASE WHEN n > 6 THEN 'iterations' WHEN total_tokens > 3000 THEN 'tokens' END AS exceeded FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS total_tokens, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))",
}
