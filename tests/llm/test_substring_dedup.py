import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__
from plumbline.llm import op13_substring_dedup as op13
from plumbline.llm.fm_index import FmIndex

SCHEMA = "doc_id long, text string, own long, anchor int, spans string"


def brute(rows, window=50):
    words = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passages = [new(n) for n in (50, 51, 60, 120, 400, 49)]
    texts = [None, "", " \n\t ", "é \x1c x", " ".join(["a"] * 700), " ".join(["a"] * 60), " ".join(["a", "b"] * 40), " ".join((["a", "b"] * 500))]
    for _ in range(30):
        own = new(rng.choice([0, 3, 20, 80]))
        for _ in range(rng.randint(0, 3)):
            own += rng.choice(passages) + new(rng.choice([0, 1, 2, 30]))
        texts.append(rng.choice([" ", "\n", " \t "]).join(own))
    base = new(300)
    for _ in range(12):  # near copies
        own = list(base)
        own[rng.randrange(300)] = "odd"
        texts.append(" ".join(own))
    texts += [texts[20]] * 4
    rng.shuffle(texts)
    return [*((k, t) for k, t in enumerate(texts)), (None, texts[30]), (None, None), (5, texts[31]), (5, texts[5]), (-3, texts[33])]


def result(spark, rows):
    df = op13.without_repeats(spark.createDataFrame([(*r, 1, 2, "s") for r in rows], SCHEMA).repartition(3))
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect()], key=str)


@pytest.mark.parametrize("part", [1000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed, part):
    """With the usual bound, and with every anchor over it."""
    for name, value in {"PART": part, "PIECE": 40, "SHARD_CHARS": 3000, "REMEMBERED": 5, "_OUT_BYTES": 500}.items():
        monkeypatch.setattr(op13, name, value)
    rows = corpus(seed)
    want = brute(rows)
    assert result(spark, rows) == want
    assert sum(r[2] for r in want) > 2000


def test_a_place_meets_one_row_of_its_piece(spark, monkeypatch):
    """The runs of a piece are brought together before its places, of which there may be very many, meet them."""
    met = []
    own = type(spark.range(1))
    join = own.join

    def counted(left, right, on=None, how=None):
        if on == "piece" and "start" in left.columns:
            met.append(right.groupBy("piece").count().filter("count > 1").count())
        return join(left, right, on, how)

    monkeypatch.setattr(own, "join", counted)
    rows = corpus(1)
    assert result(spark, rows) == brute(rows)
    assert met == [0]


def test_nothing_common_and_empty_table(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"x{rng.random()}" for _ in range(70))) for k in range(4)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, __spark_entry__.queries()["op13_substring_dedup"](spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics(seed):
    """Patterns that the index holds and others, against all substrings."""
    rng = random.Random(seed)
    depth, symbols = rng.choice([1, 2, 3, 5, 8]), rng.choice([1, 2, 3, 6])
    texts = [[rng.randint(1, symbols) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 8))]
    patterns = [[rng.randint(1, symbols + 1) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(0, 8))] + texts
    owner = np.array([rng.randint(0, 9) for _ in texts])
    index = FmIndex(np.array(sum(texts, []), np.int64), np.cumsum([len(t) for t in texts]), owner, depth)
    length, where = index.statistics(np.array(sum(patterns, []), np.int64), np.cumsum([len(p) for p in patterns]))
    least = {}
    for t, o in zip(texts, owner):
        for i in range(len(t)):
            for k in range(1, min(depth, len(t) - i) + 1):
                key = tuple(t[i : i + k])
                least[key] = min(least.get(key, o), o)
    at = 0
    for p in patterns:
        for i in range(len(p)):
            want = max([k for k in range(1, min(depth, len(p) - i) + 1) if tuple(p[i : i + k]) in least], default=0)
            assert length[at] == want
            if want == depth:
                assert index.least(where[at : at + 1])[0] == least[tuple(p[i : i + depth])]
            at += 1
