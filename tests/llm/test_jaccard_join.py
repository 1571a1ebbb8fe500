import random
import re
from itertools import combinations

import numpy as np
import pytest

from plumbline.llm import op8_ngram_jaccard_join as op8
from plumbline.llm.components import connected_components


def brute_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """The least doc_id reachable by links, by trying all pairs."""
    sets = [(i, brute_set(t)) for i, t in rows]
    comp = {i: i for i, _ in rows if i is not None}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for (i, a), (j, b) in combinations([x for x in sets if x[0] is not None], 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            comp[y] = x
    return sorted((i, len(s), None if i is None else root(i)) for i, s in sets if i is not None) + [(None, len(s), None) for i, s in sets if i is None]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", " \n\t", "one", "ONE", "one two three four", "One two  three four", "é É", "É é"]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([5, 6, 7, 8, 9, 12, 20, 40, 90]))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
            texts.append(" ".join(own))
    passage = " ".join(rng.choices(words, k=60))
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(25)]
    rng.shuffle(texts)
    return [*enumerate(texts), (None, "one two three four"), (3, texts[3]), (None, None)]


def result(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()]
    return sorted(r for r in rows if r[0] is not None) + [r for r in rows if r[0] is None]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    found = result(op8.similarity_classes(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")))
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)


def test_rounds_with_hubs_and_a_boundary_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op8, "EXACT_LEAST", 0)
    monkeypatch.setattr(op8, "EXACT_SHARE", 0.0)
    monkeypatch.setattr(op8, "SAMPLE_RATE", 1)
    monkeypatch.setattr(op8, "choose_boundary", lambda *a, **k: 12)
    monkeypatch.setattr(op8, "BROADCAST_IDS", -1)
    rows = corpus(3)
    found = result(op8.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)


def test_long_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op8, "LONG_LIST", 2)
    monkeypatch.setattr(op8, "HUB_ROUNDS", 1)
    shared = " ".join(f"p{i}" for i in range(50))
    rows = corpus(4) + [(10_000 + i, f"{' '.join(f'u{i}x{j}' for j in range(i % 30))} {shared}") for i in range(60)]
    found = result(op8.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u"), (4, "x y z")]
    found = result(op8.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4)]


def test_empty_table(spark, documents):
    assert op8.similarity_classes(documents.limit(0)).count() == 0
    assert op8.stage(spark, documents.limit(0), "").count() == 0


@pytest.mark.parametrize("boundary", [0, 3, 8, 20])
def test_linked_sets_share_a_key(boundary):
    rng = np.random.default_rng(boundary)
    order = op8.Frequencies(np.arange(50, dtype=np.uint64), rng.integers(2, 9, 50))
    tried = 0
    while tried < 400:
        n = int(rng.integers(2, 40))
        a = np.unique(rng.integers(0, 200, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 200, 2).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) == len(b) == both or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        tried += 1
        assert len(np.intersect1d(op8.keys(a, boundary, order)[0], op8.keys(b, boundary, order)[0]))


def test_boundary_follows_the_cost():
    assert op8.choose_boundary({4: 1000}, {4: 0.0}) == 0
    assert op8.choose_boundary({4: 1000, 30: 10}, {4: 500.0, 30: 0.0}) >= 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (200, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_stage_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words that are here only"), (4, None), (5, ""), (3, "other words that are here only")]
    kept = op8.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_stage_keeps_different_texts_of_one_id(spark):
    rows = [(1, "a b c d e f", "x"), (1, "p q r s t u", "x"), (1, "P q r s t u", "y"), (2, "a b c d e f", "x"), (None, "a b c d e f", "x")]
    kept = op8.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, _signature string"), "")
    assert kept.columns == ["doc_id", "text", "_signature"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)


@pytest.mark.parametrize("boundary", [0, 12])
def test_lists_in_parts_lose_no_link(spark, monkeypatch, boundary):
    for name, value in {"PART": 2, "SAMPLE_RATE": 1, "LONG_LIST": 3, "EXACT_LEAST": 0, "EXACT_SHARE": 0.0, "HUB_ROUNDS": 2, "LARGE_CLASS": 1, "LARGE_SHARE": 10**9}.items():
        monkeypatch.setattr(op8, name, value)
    monkeypatch.setattr(op8, "choose_boundary", lambda *a, **k: boundary)
    rows = corpus(5 + boundary)
    found = result(op8.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)


def test_whole_table_with_both_kinds_of_keys(spark, monkeypatch):
    monkeypatch.setattr(op8, "choose_boundary", lambda *a, **k: 28)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = result(op8.similarity_classes(docs))
    assert sorted(found, key=repr) == sorted(brute([tuple(r) for r in docs.collect()]), key=repr)


@pytest.mark.parametrize("part", [1024, 128])
def test_near_copies_of_a_text_meet_it_and_not_each_other(spark, monkeypatch, part):
    """Copies with two edits link with the text but with few of one another; comparisons grow with their number, not its square."""
    for name, value in {"PART": part, "SAMPLE_RATE": 1, "EXACT_LEAST": 0, "EXACT_SHARE": 0.0}.items():
        monkeypatch.setattr(op8, name, value)
    compared, verified = [], op8._verified
    monkeypatch.setattr(op8, "_verified", lambda pairs, docs: compared.append(pairs.count()) or verified(pairs, docs))
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = [(200, " ".join(base))]
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(10, 90, 8), 2):
            own[at] = f"u{i}x{at}"
        rows.append((i if i < 200 else i + 1, " ".join(own)))
    found = result(op8.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows)
    assert sum(compared) <= 20 * len(rows), compared
