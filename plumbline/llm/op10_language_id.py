"""Language identification with a byte convolutional network.

Texts are lower-cased, encoded as UTF-8 and cut into windows of fixed length that cover every byte. A window's bytes
are embedded, filters of several widths slide over them, each filter keeps its maximum, and a softmax over the learned
languages follows. The network is trained here in numpy (Adam, cross entropy; gradients pass through the maxima) on a
bounded, documented sample: about SAMPLE_DOCS rows of each language, SAMPLE_WINDOWS windows of each row. A text's
language is the one with the largest mean probability over its windows, weighted by their bytes.

For prediction, the filters are tabulated over pairs of bytes, so that a position costs a few table reads instead of
a matrix product; results are the same up to rounding.

Cases: a null text or one without a letter gives `und` with score 0, as does everything when no labelled row exists;
rows with a null lang teach nothing; repeated rows get equal predictions; an empty table gives no rows; other columns
are never read by a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, arrow_map, claim, crc_mod, sliced, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: Bounds of the training sample: rows for each language (expected) and windows for each row.
SAMPLE_DOCS = 1000
SAMPLE_WINDOWS = 2
EPOCHS = 6
BATCH = 64
UNKNOWN = "und"
#: The pipeline keeps a document whose language has at least this mean probability.
KEEP_SCORE = 0.5


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    embedding: np.ndarray  # byte, dimension
    filters: tuple[np.ndarray, ...]  # for each width: width * dimension, filter
    biases: tuple[np.ndarray, ...]
    dense: np.ndarray  # filter, language
    dense_bias: np.ndarray


def windows(data: bytes) -> np.ndarray:
    """All bytes as rows of WINDOW, the last one padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(rows: np.ndarray, targets: np.ndarray, languages: tuple[str, ...], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit the network on windows (row, WINDOW) with the index of their language."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.5, (256, EMBEDDING))]
    params += [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    params = [p.astype(np.float32) for p in params]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    k, step = len(WIDTHS), 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            x, y = rows[order[at : at + BATCH]], targets[order[at : at + BATCH]]
            n, step = len(x), step + 1
            embedded = params[0][x].reshape(n, -1)
            pooled, where = [], []
            for i, w in enumerate(WIDTHS):
                patches = np.lib.stride_tricks.sliding_window_view(embedded, w * EMBEDDING, axis=1)[:, ::EMBEDDING]
                out = patches.reshape(-1, w * EMBEDDING) @ params[1 + i]
                out = out.reshape(n, WINDOW - w + 1, FILTERS)
                best = out.argmax(axis=1)
                where.append((patches, best))
                pooled.append(np.take_along_axis(out, best[:, None], axis=1)[:, 0] + params[1 + k + i])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            loss = _softmax(hidden @ params[-2] + params[-1])
            loss[np.arange(n), y] -= 1
            loss /= n
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = hidden.T @ loss, loss.sum(axis=0)
            back = (loss @ params[-2].T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                own, (patches, best) = back[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                seen = patches[np.arange(n)[:, None], best]  # row, filter, width * dimension
                grads[1 + i] = np.einsum("nf,nfk->kf", own, seen)
                grads[1 + k + i] = own.sum(axis=0)
                to_bytes = np.einsum("nf,kf->nfk", own, params[1 + i]).reshape(n, FILTERS, w, EMBEDDING)
                np.add.at(grads[0], x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)], to_bytes)
            rate = 0.01 * (1 - 0.9 * epoch / max(1, epochs))
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(languages, params[0], tuple(params[1 : 1 + k]), tuple(params[1 + k : 1 + 2 * k]), params[-2], params[-1])


class Predictor:
    """The network with its filters tabulated over pairs of bytes."""

    def __init__(self, net: Network):
        self.net, self.tables = net, []
        for w, filters, bias in zip(WIDTHS if net.languages else (), net.filters, net.biases, strict=True):
            taps = [(net.embedding @ filters[i * EMBEDDING : (i + 1) * EMBEDDING]).astype(np.float32) for i in range(w)]
            parts = []
            for i in range(0, w - 1, 2):
                parts.append((i, (taps[i][:, None] + taps[i + 1][None]).reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, taps[-1]))
            parts[0] = (0, parts[0][1] + bias)
            self.tables.append((w, parts))

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """For each window the probability of each language."""
        out = np.empty((len(rows), len(self.net.languages)), np.float32)
        for at in range(0, len(rows), 64):
            x = rows[at : at + 64].astype(np.intp)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            pooled = []
            for w, parts in self.tables:
                span, total = WINDOW - w + 1, None
                for i, values in parts:
                    keys = pairs if len(values) == 65536 else x
                    got = values.take(keys[:, i : i + span], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[at : at + 64] = _softmax(hidden @ self.net.dense + self.net.dense_bias)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.net.languages else []
        group: list[int] = []
        pieces: list[bytes] = []
        size = 0
        for n, i in enumerate(known):
            group.append(i)
            pieces.append(texts[i].lower().encode("utf-8", "replace"))
            size += len(pieces[-1])
            if size > 1 << 20 or n == len(known) - 1:  # about a megabyte at once
                cut = [windows(p) for p in pieces]
                probs, end = self.probabilities(np.concatenate(cut)), 0
                for j, piece, own in zip(group, pieces, cut, strict=True):
                    weights = np.full(len(own), WINDOW, np.float64)
                    weights[-1] = len(piece) - WINDOW * (len(own) - 1)
                    mean = weights @ probs[end : end + len(own)] / weights.sum()
                    end += len(own)
                    best = int(mean.argmax())
                    langs[j], scores[j] = self.net.languages[best], float(min(1.0, mean[best]))
                group, pieces, size = [], [], 0
        return langs, scores


@lru_cache(maxsize=2)
def _predictor(blob: bytes) -> Predictor:
    import pickle

    return Predictor(pickle.loads(blob))


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> list[tuple[str, list[str]]]:
    """Windows of labelled rows outside the held-out quarter: about per_language rows of each language."""
    rows = docs.filter(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    # a row is drawn if a hash of its id is below its language's share
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) / 1_000_000
    text = F.lower("text")
    room = F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1
    cuts = F.array(*[F.substring(text, (F.pmod(F.xxhash64("doc_id", F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)])
    drawn = rows.filter((draw < share[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
    return [(r["lang"], r["cuts"]) for r in drawn.select("lang", cuts.alias("cuts")).collect()]  # bounded by per_language


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Network:
    drawn = sorted(sample(docs, per_language))
    languages = tuple(sorted({lang for lang, _ in drawn}))
    rows, targets = [], []
    for lang, cuts in drawn:
        for text in cuts:
            rows.append(windows(text.encode("utf-8", "replace")[:WINDOW])[0])
            targets.append(languages.index(lang))
    if not rows:
        none = np.zeros((0, 0), np.float32)
        return Network((), none, (), (), none, none)
    return train(np.array(rows), np.array(targets), languages)


def _predicted(blob: bytes, texts: list[str | None]) -> tuple[list[str], list[float]]:
    claim("language", _predictor.cache_clear)
    return _predictor(blob).texts(texts)


def identified(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    import pickle

    blob = pickle.dumps(net)

    def predict(batches: Batches) -> Batches:
        for batch in sliced(batches):
            langs, scores = _predicted(blob, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), predict, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, fit(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known and sure."""
    import pickle

    blob, at = pickle.dumps(fit(docs)), docs.columns.index("text")

    def keep(batches: Batches) -> Batches:
        for batch in sliced(batches):
            langs, scores = _predicted(blob, batch.column(at).cast(pa.string()).to_pylist())
            yield batch.filter(pc.and_(pc.not_equal(pa.array(langs, pa.string()), UNKNOWN), pc.greater_equal(pa.array(scores, pa.float64()), KEEP_SCORE)))

    return arrow_map(docs, keep, docs.schema)
