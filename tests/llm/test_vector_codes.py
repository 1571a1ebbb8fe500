import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__
from plumbline.llm import op11_vector_codes as op11

SCHEMA = "vec_id long, embedding array<double>, label string, code int, own_label string"


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) and the digest, with Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x * 256) for x in v)]
    if not kept:
        return [], None
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    part = width // parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    cut = [[tuple(v[p * part : (p + 1) * part]) for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(own, book):
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for own in cut:
                groups.setdefault(nearest(own[p], books[p])[1], []).append(own[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out, sums = [], {}
    for (i, _, label), own in zip(kept, cut):
        found = [nearest(own[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
        sums[label] = sums.get(label, 0) + error
    held = [(i, c, e if e < 1 << 63 else None, sums[label] if sums[label] < 1 << 63 else None) for i, c, e, label in out]
    return held, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def corpus(seed, n=150, width=32):
    rng = random.Random(seed)
    rows = [(rng.randrange(10 * n), [rng.uniform(-2, 2) for _ in range(width)], rng.choice(["a", "b", None])) for _ in range(n)]
    same = [rng.choice([0.5, -0.25]) for _ in range(width)]
    rows += [(20 * n + k, same, "a") for k in range(n // 3)]  # ties, a hot vector
    rows += [rows[0], rows[0], (None, rows[1][1], "b"), (7, [1.0] * (width - 3), "b"), (8, [], None)]
    rows += [(1, None, "a"), (2, [None] + [1.0] * (width - 1), "a"), (3, [math.nan] * width, "a"), (4, [math.inf] + [0.0] * (width - 1), "a"), (5, [-1e-9] * width, None)]
    rng.shuffle(rows)
    return rows


def result(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    found = op11.compressed(df).collect()
    return [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found], {r["codebooks_sha256"] for r in found}


def in_order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(op11, "BLOCK_ROWS", 17)
    rows = corpus(seed)
    want, digest = brute(rows)
    got, digests = result(spark, rows)
    assert in_order(got) == in_order(want)
    assert digests == {digest}


def test_fewer_vectors_than_entries_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(op11, "BROADCAST_LABELS", 1)
    rows = corpus(3, n=12)[:20]
    want, digest = brute(rows)
    got, digests = result(spark, rows)
    assert in_order(got) == in_order(want)
    assert digests == {digest}


def test_numbers_beyond_64_bits(spark):
    rows = [(k, [((k * k * 7 + d * k) % 101) * 1e15 if k % 2 else float(d) for d in range(16)], "a" if k % 2 else "b") for k in range(90)]
    want, digest = brute(rows)
    got, digests = result(spark, rows)
    assert in_order(got) == in_order(want)
    assert digests == {digest}
    assert any(r[3] is None for r in want) and any(r[3] is not None for r in want)


def test_empty_and_all_dropped(spark):
    assert result(spark, []) == ([], set())
    assert result(spark, [(1, None, "a"), (2, [None], "a")]) == ([], set())
    df = op11.compressed(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["vec_id", "code", "error", "label", "label_error", "codebooks_sha256"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], [float(x) for x in np.array(r["embedding"], np.float32)], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()][:]
    want, digest = brute(rows)
    found = __spark_entry__.queries()["op11_vector_codes"](spark, sf).collect()
    assert in_order([tuple(r)[:4] for r in found]) == in_order(want)
    assert {r["codebooks_sha256"] for r in found} == {digest}
