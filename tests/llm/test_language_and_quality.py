import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import op3_quality_classifier as op3
from plumbline.llm import op10_language_id as op10

SF = "/root/testdata/sf0.01"


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op10.op10_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_other_columns_and_covers_all_rows(spark, documents):
    net = op10.fit(spark.read.parquet(f"{SF}/documents.parquet"), per_language=150)
    rows = op10.identified(documents, net).collect()
    assert len(rows) == documents.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(by[k] == ("und", 0) for k in (1, 2, 7))
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id == 5} == {by[6]}


def test_language_without_labels(spark, documents):
    net = op10.fit(documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in op10.identified(documents, net).collect()} == {"und"}
    assert op10.fit(documents.limit(0)).languages == ()


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (70, op10.WINDOW)).astype(np.uint8)
    net = op10.train(rows, rng.integers(0, 2, 70), ("a", "b"), epochs=1)
    pooled = []
    for w, filters, bias in zip(op10.WIDTHS, net.filters, net.biases, strict=True):
        out = [net.embedding[rows[:, i : i + w]].reshape(len(rows), -1) @ filters + bias for i in range(op10.WINDOW - w + 1)]
        pooled.append(np.max(out, axis=0))
    plain = op10._softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.dense_bias)
    assert np.allclose(plain, op10.Predictor(net).probabilities(rows), atol=1e-4)


def test_every_byte_is_in_a_window():
    data = bytes(range(1, 256)) * 5
    cut = op10.windows(data)
    assert cut.shape == (5, 256) and cut.tobytes().rstrip(b"\0") == data


def test_quality_against_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    even = labels.filter("doc_id % 2 = 0")
    model = op3.fit(docs, even)
    rows = op3.scored(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.score >= 0.5 for r in rows if r.quality], [r.score >= 0.5 for r in rows if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_quality_edge_cases(spark, documents):
    labels = spark.createDataFrame([(0, 1), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    for own in (labels, labels.filter("quality = 1"), labels.limit(0)):
        rows = op3.scored(documents, op3.fit(documents, own)).collect()
        assert len(rows) == documents.count()
        assert all(r.score == 0 for r in rows if r.doc_id in (1, 2, 7))
        assert all(0 <= x <= 1 for r in rows for x in (r.p_text, r.p_meta, r.score))
    assert op3.scored(documents.limit(0), op3.fit(documents.limit(0), labels)).count() == 0


def test_sure_labels_teach_the_other_view():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    text = np.stack([y * 2 - 1 + rng.normal(0, 0.3, 600), np.ones(600)], axis=1).astype(np.float32)
    meta = np.stack([y * 2 - 1 + rng.normal(0, 1.0, 600), np.ones(600)], axis=1).astype(np.float32)
    folds = np.arange(600) % 3
    model = op3.co_train(text[:60], meta[:60], y[:60], folds[:60], text[60:], meta[60:])
    _, p_meta, both = model.views(text[60:] @ model.text, meta[60:] @ model.meta)
    assert np.mean((p_meta > 0.5) == y[60:]) > 0.75 and np.mean((both > 0.5) == y[60:]) > 0.97


@pytest.mark.parametrize("stage", [op3.stage, op10.stage])
def test_stages_keep_columns_with_clashing_names(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.withColumns({c: F.lit(7) for c in ("_p", "_found", "quality", "label", "score", "text_at", "lang_pred")})
    assert stage(spark, more, SF).select(*docs.columns).subtract(stage(spark, docs, SF)).count() == 0
    assert stage(spark, more, SF).columns == more.columns


@pytest.mark.parametrize("stage", [op3.stage, op10.stage])
def test_stages_keep_columns_and_good_rows(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert 0.6 * docs.count() < kept.count() < docs.count()
