import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import retrieval, text_index
from plumbline.operators.text_index import TextIndex
from plumbline.operators.vector_index import VectorIndex, fitted, recall
from plumbline.session import scratch
from plumbline.streaming import changes, events

DAY = 86_400.0


def part_files(spark, tmp_path, rows, schema, parts, seed=1):
    """A folder of part files whose rows are in any order."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    path = f"{tmp_path}/events.parquet"
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return path


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def some_events(spark, n=120, users=5):
    rng = random.Random(2)
    rows, at = [], 1_700_000_000_000_000
    for k in range(n):
        at += rng.choice([0, 1, 400_000, 3_600_000_000, 200_000_000_000])
        rows.append((k, at, rng.randrange(users), rng.choice(["view", "view", "click", "end", None])))
    df = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string")
    return rows, [(r["event_id"], r["ts"], r["user_id"], r["event_type"], 1.0) for r in df.withColumn("ts", F.timestamp_micros("us")).collect()]


def told(rows, terminal, beat, until):
    """The change stream by a loop over each user's rows."""
    out, beat = [], int(beat * 1_000_000)
    for user in {r[2] for r in rows}:
        last = None
        for number, at, _, value in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            if last and last[1] == value:
                continue
            if last:
                out += [(user, t, None, last[1], "heartbeat") for t in range(last[0] + beat, at, beat)]
            out.append((user, at, number, value, "closed" if value in terminal else "change"))
            last = None if value in terminal else (at, value)
        if last:
            out += [(user, t, None, last[1], "heartbeat") for t in range(last[0] + beat, until, beat)]
    return sorted(out, key=str)


@pytest.mark.parametrize("files", [1, 1000])
def test_change_stream_over_files_in_any_order(spark, tmp_path, files):
    rows, typed = some_events(spark)
    path = part_files(spark, tmp_path, typed, EVENTS, 4)
    got = changes.replayed(spark, path, "user_id", "ts", "event_id", "event_type", ("end",), DAY, files)
    found = [(r["user_id"], r["us"], r["number"], r["value"], r["kind"]) for r in got.withColumn("us", F.unix_micros("at")).collect()]
    until = (max(r[1] for r in rows) // 1000 + 1) * 1000
    assert sorted(found, key=str) == told(rows, ("end",), DAY, until)


def test_closed_keys_leave_no_state(spark, tmp_path):
    rows = [(1, 1, "a"), (2, 1, "end"), (3, 2, "a")]
    typed = [(k, t, u, v, 1.0) for (k, u, v), t in zip(rows, [r[1] for r in some_events(spark, 3)[1]])]
    path = part_files(spark, tmp_path, typed, EVENTS, 1)
    changes.replayed(spark, path, "user_id", "ts", "event_id", "event_type", ("end",), DAY).collect()
    folders = sorted(Path(scratch(spark, "x").removeprefix("file:")).parent.glob("changes-state-*"), key=lambda p: p.stat().st_mtime)
    before = spark.conf.get(changes._STATE, None)
    spark.conf.set(changes._STATE, changes._ROCKSDB)
    try:
        kept = spark.read.format("statestore").option("stateVarName", "last").load(f"file:{folders[-1]}")
        assert [r[0] for r in kept.select("key.user_id").collect()] == [2]
    finally:
        spark.conf.set(changes._STATE, before) if before else spark.conf.unset(changes._STATE)


def test_rows_that_are_not_due_are_kept_in_one_call():
    calls = []

    class State:
        def get(self):
            calls.append("get")

        def appendList(self, rows):
            calls.append(("appendList", len(rows)))

        def update(self, row):
            calls.append("update")

        def registerTimer(self, at):
            calls.append(("registerTimer", at))

        def getCurrentWatermarkInMs(self):
            return 0

    told = changes._Told("user_id", (), DAY, True)
    told.handle = told.last = told.waiting = told.wake = State()
    rows = changes.pd.DataFrame({"micros": [5_000_000, 3_000_000, 4_000_000], "number": [1, None, 3], "value": ["a", None, "b"]})
    assert list(told.handleInputRows((7,), iter([rows]), State())) == []
    assert ("appendList", 3) in calls and ("registerTimer", 3001) in calls and len(calls) <= 5


def test_empty_streams(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    assert changes.replayed(spark, f"{tmp_path}/events.parquet", "user_id", "ts", "event_id", "event_type").collect() == []
    assert events.daily_counts(spark, str(tmp_path)).collect() == []


def test_daily_counts_over_files_in_any_order(spark, tmp_path):
    rows, typed = some_events(spark)
    part_files(spark, tmp_path, typed, EVENTS, 5)
    want = {}
    for r in typed:
        want[str(r[1].date()), r[3]] = want.get((str(r[1].date()), r[3]), 0) + 1
    got = events.daily_counts(spark, str(tmp_path), files=1).collect()
    assert {(r["day"], r["event_type"]): r["n"] for r in got} == want
    assert len(got) == len(want)


def vectors(spark, n, seed=1, groups=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 24)) + (rng.normal(size=(groups, 24))[rng.integers(0, groups, n)] * 4 if groups else 0)
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(None, [1.0] * 24), (n, None)], "doc_id long, vector array<double>")


@pytest.mark.parametrize("groups", [0, 12])
def test_vector_index(spark, groups):
    corpus = vectors(spark, 1500, groups=groups)
    asked = corpus.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    index = VectorIndex.build(corpus.filter("doc_id is null or doc_id % 4 <> 1"), scratch(spark, "vectors")).add(corpus.filter("doc_id % 4 = 1"))
    exact = retrieval.semantic(asked, corpus, 20)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert key(index.search(asked, 20, share=None)) == key(exact)
    assert index.sizes.sum() == 1500 and index.rows().filter("copy = 0").count() == 1500
    near = recall(index.search(asked, 20), exact).agg(F.avg("recall")).first()[0]
    assert near >= 0.9
    found = index.search(asked, 20)
    assert found.count() == found.select("query_id", "doc_id").distinct().count() == 15 * 20
    # one query reads under 40 % of the files
    one = asked.limit(1).collect()[0]
    nearest = np.argsort(-(index.centroids @ np.array(one["vector"])))[: int(0.3 * len(index.sizes))].tolist()
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(index.cells(nearest)) < 0.4 * files(index.rows())


def test_vector_index_of_nothing(spark):
    index = VectorIndex.build(vectors(spark, 0), scratch(spark, "vectors"))
    assert index.search(vectors(spark, 3).withColumnRenamed("doc_id", "query_id")).collect() == []


def test_centroids_are_as_many_as_vectors_differ():
    assert len(fitted(np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]]), 4)) == 2


def texts(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"word{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    rows = [(3000 * k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(n)]
    return spark.createDataFrame([*rows, (None, "word1 word2"), (7, None)], "doc_id long, text string")


def lexical_rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def test_text_index_segments(spark):
    corpus = texts(spark, 400)
    asked = texts(spark, 12, seed=5).withColumnRenamed("doc_id", "query_id")
    index = TextIndex(spark, scratch(spark, "texts"))
    assert index.search(asked).collect() == []
    index.add(corpus.filter("doc_id is null or doc_id % 9000 <> 0"))
    index.add(corpus.filter("doc_id % 18000 = 0").withColumn("text", F.lit("word1 word2 word3")))
    index.add(corpus.filter("doc_id % 9000 = 0"))
    for limit in (1, 10, 1000):
        assert lexical_rows(index.search(asked, limit)) == lexical_rows(retrieval.lexical(asked, corpus, limit))
    index.remove(corpus.filter("doc_id % 6000 = 0").select("doc_id"))
    rest = corpus.filter("doc_id % 6000 <> 0")
    assert lexical_rows(index.search(asked, 10)) == lexical_rows(retrieval.lexical(asked, rest, 10))
    index.merge()
    assert len(index.segments()) == 1
    assert lexical_rows(index.search(asked, 10)) == lexical_rows(retrieval.lexical(asked, rest, 10))


def test_texts_are_listed_block_by_block(spark, monkeypatch):
    """Terms of repeated ids add up, also when they are cut down on the way; a segment has one row for each term and block."""
    monkeypatch.setattr(text_index, "SPAN", 10)
    rows = [(k, f"Common x{k % 7}y ÉTÉ-abc\u00a0of 12 {'again ' * k}") for k in range(-15, 40)] + [(3, "third Time"), (3, "common third"), (4, None), (None, "common"), (5, "")]
    index = TextIndex(spark, scratch(spark, "texts"))
    name = index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not [n for n, f in vars(text_index).items() if n == "token_set"]  # terms are not exploded to rows
    kept = {(r["term"], r["block"]): r["docs"] for r in index._read(name, "postings", text_index._POSTINGS).collect()}
    expected = {}
    for k, text in rows:
        for term in retrieval.tokens_of(text) if k is not None else []:
            expected.setdefault((term, k // 10), set()).add(k)
    assert kept == {k: sorted(v) for k, v in expected.items()}
    part = lambda some: pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in some], "block": [k // 10 for k, _ in some], "text": [t.lower() for _, t in some]})
    monkeypatch.setattr(text_index, "LISTED_TERMS", 5)
    monkeypatch.setattr(text_index, "LISTED_ROWS", 2)
    known = sorted((k, t) for k, t in rows if k is not None and t is not None)
    told = [r for b in text_index._lists(iter([part(known[:20]), part([]), part(known[20:])])) for r in b.to_pylist()]
    assert len(told) == len(kept) and {(r["term"], r["block"]): r["docs"] for r in told} == kept


def test_frequent_terms_are_not_listed(spark, monkeypatch):
    """Once enough texts have the rare terms, the lists of frequent ones are opened only in the candidates' blocks."""
    rows = [(k, "every where " + ("rare odd seldom" if k % 50 == 0 else f"other{k}")) for k in range(2000)]
    index = TextIndex(spark, scratch(spark, "texts"))
    monkeypatch.setattr(text_index, "SPAN", 10)
    index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "rare odd seldom where every")], "query_id long, text string")
    listed, counted = [], TextIndex._counted
    monkeypatch.setattr(TextIndex, "_counted", lambda self, segments, wanted: listed.extend(wanted) or counted(self, segments, wanted))
    found = index.search(asked, 10)
    assert lexical_rows(found) == lexical_rows(retrieval.lexical(asked, spark.createDataFrame(rows, "doc_id long, text string"), 10))
    assert {t for _, t in listed} == {"odd", "rare", "seldom"}
