"""Substring dedup: words are removed that lie in a window of WINDOW words which also starts in a document with a smaller id.

1. A window is known by its anchor, the least hash of ANCHOR words in it. Equal windows have equal anchors, and a run of
   windows with one anchor is a piece. Only pieces whose anchor stands in documents with different ids go on.
2. Equal pieces become one, with the least id (aggregated before it is shuffled): a piece with a million copies is
   searched once.
3. Pieces go to shards by their anchor. Each shard is a compressed FM-index (fm_index.py) of its pieces; backward search
   over its wavelet matrix streams the pieces through it and gives the matching statistics up to WINDOW words. Where they
   reach WINDOW, the index tells the least document of all places where these words stand.
4. Every document that holds a piece loses the windows whose least document is smaller than itself.

The work grows with the input, as each piece meets the pieces of one anchor and not all shards. An anchor with more than
PART different pieces (a very common passage amid different texts) is not brought together: of its pieces only the
windows go on whose hash stands in different documents, each as a piece of its own, dealt out by that hash. Hashes only
choose what is compared; what is removed rests on the words that the index compares. Texts are moved twice: to cut the
pieces out of documents that have common anchors, and to remove words. Joins on anchors, pieces and windows read tables
on both sides, so adaptive execution splits a hot key's partition; the other side has a row for each key.

Cases: null texts have no words and texts under WINDOW words lose none; rows with a null doc_id neither lose words nor
take them from others; rows that share an id do not take words from each other; windows that a document repeats itself
stay; windows are judged on the input, so copies of a removed passage go as well; an empty table gives no rows; further
columns are ignored. Texts that share a doc_id are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, arrow_map, claim, materialize, release, sliced, table
from .fm_index import FmIndex
from .op8_ngram_jaccard_join import mixed

WINDOW, ANCHOR = 50, 16
#: Windows of a piece; longer runs of one anchor (as in texts that repeat themselves) are cut.
PIECE = 256
#: Different pieces of an anchor that one shard may hold.
PART = 1000
#: Characters of a shard's pieces, on the average.
SHARD_CHARS = 2_500_000
#: Keys that are sent to every task; beyond it rows are shuffled.
BROADCAST_KEYS = 1_000_000
#: Pieces that a task remembers so as to send each text once.
REMEMBERED = 200_000
#: Bytes of texts that leave a task together.
_OUT_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many words."""
    n = len(hashes) - words + 1
    total = np.full(n, words, np.uint64)
    for i in range(words):
        total = total * _MULTIPLIER + hashes[i : n + i]
    return mixed(total)


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window."""
    least, span, wanted = rolled(hashes, ANCHOR), 1, WINDOW - ANCHOR + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = wanted - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def pieces(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of equal anchors, cut to PIECE windows: where each begins and how many windows it has."""
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    sizes = np.diff(starts, append=len(found))
    cuts = -(-sizes // PIECE)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first = np.repeat(starts, cuts) + nth * PIECE
    return first, np.minimum(PIECE, np.repeat(starts + sizes, cuts) - first)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


class _Remembered:
    """Texts that this task has sent already."""

    def __init__(self):
        self.known: set[bytes] = set()

    def once(self, digest: bytes, text: bytes) -> bytes | None:
        if digest in self.known:
            return None
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known.add(digest)
        return text


def _emit(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _anchors(docs: DataFrame) -> DataFrame:
    """doc_id, own, anchor: the different anchors of each document."""

    def run(batches: Batches) -> Batches:
        claim("anchors")
        for batch in sliced(batches):
            out, sizes = [], []
            for text in _texts(batch, 2):
                words = text.split()
                out.append(np.unique(anchors(word_hashes(words))) if len(words) >= WINDOW else np.zeros(0, np.uint64))
                sizes.append(len(out[-1]))
            rows = pa.array(np.repeat(np.arange(len(out)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "own", "anchor"])

    return arrow_map(docs.select("doc_id", "own", "text"), run, "doc_id long, own long, anchor long")


def _pieces(docs: DataFrame) -> DataFrame:
    """The pieces of docs (doc_id, own, text, wanted) with a wanted anchor; a task gives a piece's text once."""
    from xxhash import xxh3_128_digest

    names = ["doc_id", "own", "start", "piece", "key", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Batches) -> Batches:
        claim("anchors")
        sent, out, size = _Remembered(), [], 0
        for batch in sliced(batches, 128):
            for i, own, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), batch.column(3), strict=True):
                words = text.split()
                found = anchors(word_hashes(words))
                first, many = pieces(found)
                keys = found[first]
                common = np.isin(keys, wanted.values.to_numpy().view(np.uint64))
                for at, n, key in zip(first[common].tolist(), many[common].tolist(), keys[common].view(np.int64).tolist(), strict=True):
                    said = b" ".join(words[at : at + n + WINDOW - 1])
                    digest = xxh3_128_digest(said)
                    said = sent.once(digest, said)
                    out.append((i, own, at, digest, key, said))
                    size += 60 + len(said or b"")
                    if size > _OUT_BYTES:
                        yield _emit(out, names, kinds)
                        out, size = [], 0
        if out:
            yield _emit(out, names, kinds)

    return arrow_map(docs.select("doc_id", "own", "text", "wanted"), run, "doc_id long, own long, start long, piece binary, key long, text string")


def _windows(rows: DataFrame) -> DataFrame:
    """piece, at, window (a hash), lo, hi: the windows of pieces."""

    def run(batches: Batches) -> Batches:
        claim("anchors")
        for batch in sliced(batches):
            found = [rolled(word_hashes(t.split()), WINDOW) for t in _texts(batch, 3)]
            sizes = [len(f) for f in found]
            rows = pa.array(np.repeat(np.arange(len(found)), sizes))
            at = np.concatenate([np.arange(n) for n in sizes])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(at), pa.array(np.concatenate(found).view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows)], ["piece", "at", "window", "lo", "hi"])

    return arrow_map(rows.select("piece", "lo", "hi", "text"), run, "piece binary, at long, window long, lo long, hi long")


def _singles(rows: DataFrame) -> DataFrame:
    """The wanted windows (at, window) of pieces, each as a piece of its own: whole, at, piece, key, lo, hi, text."""
    from xxhash import xxh3_128_digest

    names = ["whole", "at", "piece", "key", "lo", "hi", "text"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Batches) -> Batches:
        claim("anchors")
        sent, out, size = _Remembered(), [], 0
        for batch in sliced(batches, 128):
            for whole, lo, hi, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), _texts(batch, 3), batch.column(4).to_pylist(), strict=True):
                words = text.split()
                for w in wanted:
                    said = b" ".join(words[w["at"] : w["at"] + WINDOW])
                    digest = xxh3_128_digest(said)
                    said = sent.once(digest, said)
                    out.append((whole, w["at"], digest, w["window"], lo, hi, said))
                    size += 80 + len(said or b"")
                    if size > _OUT_BYTES:
                        yield _emit(out, names, kinds)
                        out, size = [], 0
        if out:
            yield _emit(out, names, kinds)

    return arrow_map(rows.select("piece", "lo", "hi", "text", "wanted"), run, "whole binary, at long, piece binary, key long, lo long, hi long, text string")


_RUNS = "piece binary, at long, n long, lo long"


def searched(rows: pa.Table) -> pa.Table:
    """Of a shard's pieces (piece, lo, hi, text) the runs of windows that stand in a document below hi, with the least one."""
    claim("shard")
    words = pc.split_pattern(rows.column("text").combine_chunks(), " ")
    ends = words.offsets.to_numpy()[1:].astype(np.int64) - words.offsets[0].as_py()
    symbols = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    index = FmIndex(symbols, ends, rows.column("lo").to_numpy(), WINDOW)
    length, where = index.statistics(symbols, ends)
    place = np.flatnonzero(length == WINDOW)
    least, of = index.least(where[place]), np.searchsorted(ends, place, side="right")
    own = least < rows.column("hi").to_numpy()[of]
    place, least, of = place[own], least[own], of[own]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(least) != 0) | (np.diff(of) != 0)])) if len(place) else place
    first = np.concatenate([[0], ends[:-1]])[of[new]]
    found = [rows.column("piece").combine_chunks().take(pa.array(of[new])), pa.array(place[new] - first), pa.array(np.diff(new, append=len(place))), pa.array(least[new])]
    release()
    return pa.Table.from_arrays(found, ["piece", "at", "n", "lo"])


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _different(rows: DataFrame) -> DataFrame:
    """Each piece once, with the least and the greatest document that holds it."""
    return rows.groupBy("piece").agg(F.min("key").alias("key"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("text").alias("text"))


def _in_shards(rows: DataFrame) -> DataFrame:
    shards = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS))
    dealt = rows.select("piece", "lo", "hi", "text", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(lambda found: searched(found), _RUNS)


def repeats(docs: DataFrame) -> DataFrame | None:
    """For rows (doc_id, own, text) with windows to remove: doc_id, own, spans (the first word of a run of windows, and how many). None if no anchor is common."""
    met = materialize(_anchors(docs.filter("doc_id is not null")), "anchors")
    shared = materialize(met.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor"), "shared")
    if shared.isEmpty():
        return None
    wanted = met.join(shared, "anchor").groupBy("doc_id", "own").agg(F.collect_list("anchor").alias("wanted"))  # of one document
    places = materialize(_pieces(docs.join(wanted, ["doc_id", "own"])), "places")
    different = materialize(_different(places.withColumns({"lo": F.col("doc_id"), "hi": F.col("doc_id")})), "pieces")
    hot = materialize(different.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select("key"), "hot")
    if hot.isEmpty():
        runs = materialize(_in_shards(different), "runs")
    else:
        keys = _few(hot)
        warm = different.join(keys, "key", "left_semi")
        seen = materialize(_windows(warm), "windows")
        twice = materialize(seen.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("window"), "twice")
        picked = seen.join(twice, "window").groupBy("piece").agg(F.collect_list(F.struct("at", "window")).alias("wanted"))  # at most PIECE
        singles = materialize(_singles(warm.join(picked, "piece")), "singles")
        cold = different.join(keys, "key", "left_anti").select("piece", "key", "lo", "hi", "text")
        runs = materialize(_in_shards(cold.unionByName(_different(singles))), "runs")
        of_whole = singles.select("whole", F.col("at").alias("before"), "piece").join(runs, "piece").select(F.col("whole").alias("piece"), (F.col("before") + F.col("at")).alias("at"), "n", "lo")
        runs = materialize(runs.union(of_whole), "runs")
    # a piece's runs (at most one for each of its windows) are one row, so a place meets one row however many runs there are
    by_piece = runs.groupBy("piece").agg(F.collect_list(F.struct("at", "n", "lo")).alias("runs"))
    own = F.transform(F.filter("runs", lambda r: r["lo"] < F.col("doc_id")), lambda r: F.struct((F.col("start") + r["at"]).alias("start"), r["n"].alias("n")))
    gone = places.select("doc_id", "own", "start", "piece").join(by_piece, "piece").select("doc_id", "own", own.alias("spans")).filter(F.size("spans") > 0)
    return gone.groupBy("doc_id", "own").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of one document


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _removed(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the words that are kept, joined by spaces, of rows (doc_id, text, spans)."""

    def run(batches: Batches) -> Batches:
        claim("anchors")
        for batch in sliced(batches, 128):
            out: list[tuple] = []
            for i, text, spans in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if spans:
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, [s["start"] for s in spans], 1)
                    np.add.at(edges, [s["start"] + s["n"] + WINDOW - 1 for s in spans], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                out.append((i, n, n - len(words), b" ".join(words)))
            yield _emit(out, ["doc_id", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return arrow_map(rows.select("doc_id", "text", "spans"), run, _KEPT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("own"))
    spans = repeats(docs)
    if spans is None:
        return _removed(docs.withColumn("spans", F.lit(None).cast("array<struct<start: bigint, n: bigint>>")))
    return _removed(docs.join(spans, ["doc_id", "own"], "left"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM words WHERE len(w) >= {WINDOW})),
firsts AS MATERIALIZED (SELECT s, min(doc_id) AS lo FROM windows GROUP BY s),
repeated AS MATERIALIZED (SELECT doc_id, k FROM windows JOIN firsts USING (s) WHERE lo < doc_id),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words),
covered AS (
  SELECT p.doc_id, p.k, p.word, max(r.k) OVER (PARTITION BY p.doc_id ORDER BY p.k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM places p LEFT JOIN repeated r ON r.doc_id = p.doc_id AND r.k = p.k)
SELECT d.doc_id, count(c.k) AS n_words, count(c.k) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c USING (doc_id) GROUP BY d.doc_id
"""
