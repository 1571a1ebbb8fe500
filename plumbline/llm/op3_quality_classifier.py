"""Quality classification by co-training.

Two views describe a document: its text (n-grams of word shapes, hashed words, and shares such as repeated words or
symbols) and its metadata (source, language, recorded length and their crosses). A logistic regression is fitted for
each view on labelled rows. Then, for ROUNDS rounds, each view labels the rows of an unlabelled pool that it is surest
of and the other view learns from them. A third of the labels takes no part in this: on it both views are calibrated
(Platt scaling) and their calibrated log odds are combined by one more logistic regression, which gives a view that
tells little a small weight.

All fitting uses a bounded, documented sample (LABELLED rows with labels, POOL rows without) whose features are
gathered on the executors; every document is then scored where it lies.

Cases: a null text is an empty one; null metadata are values of their own; a document with no word scores 0 and is
not kept; contradictory or repeated labels of a doc_id all count; with no usable labels (none, or one class only)
everything that has a word scores 1; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, arrow_map, claim, release, sliced, table

#: Bounds of the training sample (expected rows).
LABELLED = 4000
POOL = 3000
ROUNDS = 4
#: Pseudo-labels that each view hands over in a round, as a share of the pool, for each class.
HANDED = 0.05
KEEP_SCORE = 0.5
#: Words whose hashes a task keeps, and the length up to which it does; a full cache starts anew. Neither changes a result.
CACHE_WORDS, CACHE_LENGTH = 150_000, 64

SHAPES, PAIRS, WORDS = 256, 1024, 1024
SHARES = 8
TEXT_DIM = SHAPES + PAIRS + WORDS + SHARES
META_DIM = 1024
_SYMBOLS = "#*$%&|<>"


def _shape(word: str) -> str:
    """A word's outline: runs of upper case, lower case, digits, then its punctuation as it is."""
    out = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class _Codes(dict):
    """For a word its hashes and what the shares need; starts anew when full."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        shape = zlib.crc32(_shape(word).encode())
        code = (shape % SHAPES) << 20 | zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS << 10 | (shape >> 10) % 1024
        if len(word) <= CACHE_LENGTH:
            self[word] = code
        return code


_codes = _Codes()


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the text view; without words both are empty."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    codes = np.fromiter(map(_codes.__getitem__, words), dtype=np.int64, count=len(words))
    shapes, fine = codes >> 20, codes & 1023
    n = len(words)
    grams = [shapes, SHAPES + (fine[:-1] * 31 + fine[1:]) % PAIRS, SHAPES + PAIRS + (codes >> 10 & 1023)]
    where, counts = np.unique(np.concatenate(grams), return_counts=True)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(1, len(text))
    distinct = len(set(words)) / n
    blocks = [len(set(words[i : i + 100])) / 100 for i in range(0, n - n % 100, 100)]  # at one scale, over the whole text
    shares = [
        distinct,
        sum(blocks) / len(blocks) if blocks else distinct,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, 20 * sum(map(text.count, _SYMBOLS)) / chars),
        min(1.0, 20 * text.count("!") / chars),
        min(1.0, (chars - n) / n / 20),
        np.log1p(n) / 10,
        1.0,
    ]
    return np.concatenate([where, np.arange(TEXT_DIM - SHARES, TEXT_DIM)]), np.concatenate([np.sqrt(counts / n), shares]).astype(np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the metadata view."""
    missing = n_chars is None or n_chars != n_chars
    bucket = "none" if missing else str(int(np.log2(max(1.0, float(n_chars)))))
    terms = [f"s={source}", f"l={lang}", f"n={bucket}", f"sl={source}|{lang}", f"ln={lang}|{bucket}"]
    where = [zlib.crc32(t.encode("utf-8", "replace")) % (META_DIM - 1) for t in terms]
    return np.array([*where, META_DIM - 1]), np.ones(len(terms) + 1, np.float32)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.float32)
    for i, (where, values) in enumerate(rows):
        np.add.at(out[i], where, values)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray | list[np.ndarray], y: np.ndarray, weights: np.ndarray | None = None, l2: float = 1e-3, steps: int = 250) -> np.ndarray:
    """Weights of a regularised logistic regression, by Nesterov's accelerated gradient; x may be in several blocks of rows."""
    blocks = x if isinstance(x, list) else [x]
    w = np.zeros(blocks[0].shape[1], np.float32)
    ahead, last = w.copy(), w
    weights = np.ones(len(y), np.float32) if weights is None else weights.astype(np.float32)
    weights = weights / weights.sum()
    rate = 1 / (0.25 * float(weights @ np.concatenate([np.einsum("ij,ij->i", b, b) for b in blocks])) + l2)  # of the curvature's upper bound
    for i in range(steps):
        error = weights * (_sigmoid(np.concatenate([b @ ahead for b in blocks])) - y)
        grad, at = l2 * ahead, 0
        for b in blocks:
            grad = grad + b.T @ error[at : at + len(b)]
            at += len(b)
        w = ahead - rate * grad
        ahead, last = w + i / (i + 3) * (w - last), w
    return last


@dataclass(frozen=True)
class Model:
    text: np.ndarray | None
    meta: np.ndarray | None
    text_platt: tuple[float, float] = (1.0, 0.0)
    meta_platt: tuple[float, float] = (1.0, 0.0)
    mix: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def views(self, text_raw: np.ndarray, meta_raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text_platt[0] * text_raw + self.text_platt[1], self.meta_platt[0] * meta_raw + self.meta_platt[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x = np.stack([raw, np.ones_like(raw)], axis=1).astype(np.float32)
    scale = float(np.abs(raw).max()) or 1.0
    x[:, 0] /= scale
    a, b = logistic(x, y, l2=1e-4, steps=800)
    return max(0.0, float(a) / scale), float(b)


def co_train(text: np.ndarray, meta: np.ndarray, labels: np.ndarray, folds: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit both views; folds 0 and 1 teach, fold 2 calibrates."""
    if len(set(labels.tolist())) < 2:
        return Model(None, None)
    teach, hold = folds != 2, folds == 2
    if min(len(set(labels[teach].tolist())), len(set(labels[hold].tolist()))) < 2:
        teach = hold = np.ones(len(labels), bool)
    handed = max(1, int(HANDED * len(pool_text)))
    learnt: list[dict[int, float]] = [{}, {}]  # for each view the pool rows that the other one has labelled
    views, pools = (text[teach], meta[teach]), (pool_text, pool_meta)
    y = labels[teach].astype(np.float32)

    def fitted(view: int) -> np.ndarray:
        own = learnt[view]
        x = [views[view], pools[view][list(own)]] if own else [views[view]]
        target = np.concatenate([y, np.array(list(own.values()), np.float32)])
        trust = np.concatenate([np.ones(len(y)), np.full(len(own), 0.3)])
        share = np.clip(target @ trust / trust.sum(), 0.05, 0.95)
        return logistic(x, target, trust * np.where(target == 1, 0.5 / share, 0.5 / (1 - share)))

    weights = [fitted(0), fitted(1)]
    for _ in range(rounds if len(pool_text) else 0):
        for view in (0, 1):
            p = _sigmoid(pools[view] @ weights[view])
            order = np.argsort(p, kind="stable")
            # only what is sure: the surest of each class, and not beyond even odds of nine to one
            learnt[1 - view].update({int(i): 0.0 for i in order[:handed] if p[i] < 0.1})
            learnt[1 - view].update({int(i): 1.0 for i in order[::-1][:handed] if p[i] > 0.9})
        weights = [fitted(0), fitted(1)]
    raw, target = (text[hold] @ weights[0], meta[hold] @ weights[1]), labels[hold].astype(np.float32)
    platt = _platt(raw[0], target), _platt(raw[1], target)
    odds = np.stack([platt[0][0] * raw[0] + platt[0][1], platt[1][0] * raw[1] + platt[1][1], np.ones_like(raw[0])], axis=1).astype(np.float32)
    mix = logistic(odds / 4, target, l2=1e-4, steps=800) / 4
    mix[:2] = np.maximum(mix[:2], 0)
    return Model(weights[0], weights[1], *platt, tuple(float(x) for x in mix))


def _inputs(*more: Column) -> list[Column]:
    """What both views read, under names of their own, and further columns in front."""
    return [*more, F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars")]


def _featured(rows: DataFrame) -> DataFrame:
    """doc_id, label and the sparse features of both views, as bytes; rows has doc_id, label and the inputs."""

    def features(batches: Batches) -> Batches:
        claim("quality", _forget)
        for batch in sliced(batches):
            out = []
            for t, s, g, n in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                a, b = text_features(t)
                c, d = meta_features(s, g, n)
                out.append((a.astype(np.int32).tobytes(), b.tobytes(), c.astype(np.int32).tobytes(), d.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], ["doc_id", "label", "text_at", "text_value", "meta_at", "meta_value"])

    return arrow_map(rows, features, "doc_id long, label int, text_at binary, text_value binary, meta_at binary, meta_value binary")


def _drawn(df: DataFrame, rows: int, salt: int) -> DataFrame:
    """About so many rows, chosen by a hash of their id."""
    n = df.count()
    return df.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(1, n))))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = _drawn(named.filter(F.col("label").isNotNull()), labelled, 31)
    rows = docs.select(*_inputs(F.col("doc_id").cast("long").alias("doc_id")))
    # `known` is bounded by its sample size
    met = rows.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text", "source", "lang", "n_chars")
    taught = sorted(_featured(met).collect(), key=lambda r: (r["doc_id"], r["label"]))
    some = _drawn(rows, pool, 32).select("doc_id", F.lit(None).cast("int").alias("label"), "text", "source", "lang", "n_chars")
    free = sorted(_featured(some).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))

    def view(found: list, name: str, dim: int) -> np.ndarray:
        return _dense([(np.frombuffer(r[f"{name}_at"], np.int32), np.frombuffer(r[f"{name}_value"], np.float32)) for r in found], dim)

    folds = np.array([zlib.crc32(f"{r['doc_id']}/fold".encode()) % 3 for r in taught])
    model = co_train(view(taught, "text", TEXT_DIM), view(taught, "meta", META_DIM), np.array([int(r["label"] > 0) for r in taught]), folds, view(free, "text", TEXT_DIM), view(free, "meta", META_DIM))
    del taught, free
    release()  # the driver's memory is as scarce as a task's
    return model


@lru_cache(maxsize=2)
def _model(blob: bytes) -> Model:
    import pickle

    return pickle.loads(blob)


def _forget() -> None:
    _codes.clear()
    _model.cache_clear()


def _scores(blob: bytes, inputs: list[list]) -> np.ndarray:
    """p_text, p_meta and score of texts with their source, lang and n_chars."""
    claim("quality", _forget)
    own = _model(blob)
    n = len(inputs[0])
    raw, blank = np.zeros((2, n)), np.zeros(n, bool)
    seen: dict[tuple, float] = {}
    for i, (t, s, g, c) in enumerate(zip(*inputs, strict=True)):
        where, values = text_features(t)
        blank[i] = not len(where)
        if own.text is None:
            continue
        raw[0, i] = values @ own.text[where]
        key = (s, g, -1 if c is None or c != c else int(np.log2(max(1.0, c))))
        if key not in seen:
            at, value = meta_features(s, g, c)
            seen[key] = float(value @ own.meta[at])
        raw[1, i] = seen[key]
    p = np.ones((3, n)) if own.text is None else np.array(own.views(raw[0], raw[1]))
    p[:, blank] = 0.0
    return p


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_text, p_meta, score for every row of docs (doc_id, text, source, lang, n_chars)."""
    import pickle

    blob = pickle.dumps(model)

    def score(batches: Batches) -> Batches:
        for batch in sliced(batches):
            p = _scores(blob, [batch.column(i).to_pylist() for i in range(1, 5)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p)], ["doc_id", "p_text", "p_meta", "score"])

    return arrow_map(docs.select(*_inputs(F.col("doc_id").cast("long").alias("doc_id"))), score, "doc_id long, p_text double, p_meta double, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the calibrated probability of each view, their combination and the verdict, for every document."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumn("kept", F.col("score") >= KEEP_SCORE)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the combined views score as good."""
    import pickle

    blob = pickle.dumps(fit(docs, table(spark, sf_dir, "labels")))
    at = [(docs.columns.index(c), kind) for c, kind in (("text", pa.string()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.float64()))]

    def keep(batches: Batches) -> Batches:
        for batch in sliced(batches):
            p = _scores(blob, [batch.column(i).cast(kind).to_pylist() for i, kind in at])
            yield batch.filter(pc.greater_equal(pa.array(p[2]), KEEP_SCORE))

    return arrow_map(docs, keep, docs.schema)
