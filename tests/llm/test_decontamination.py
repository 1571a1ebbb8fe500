import random
import re

import pytest

from plumbline.llm import op7_benchmark_decontamination as op7


def grams(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {("short", *words)}


def brute(docs, items):
    out = {}
    for i, text in docs:
        own = grams(text)
        out[i] = sorted({k for k, t in items if k is not None and grams(t) and 100 * len(grams(t) & own) >= 75 * len(grams(t))})
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 5, 9, 14, 30, 70, 200])))) for i in range(40)]
    docs = []
    for i in range(120):
        body = rng.choices(words, k=rng.choice([0, 10, 100, 3000]))
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = own
        docs.append((i, " ".join(body).upper() if rng.random() < 0.2 else " \n".join(body)))
    half = items[-1][1].split()
    docs.append((500, " ".join([*half[: len(half) // 2], *rng.choices(words, k=2000), *half[len(half) // 2 :]])))
    docs += [(501, None), (502, ""), (503, items[0][1]), (503, items[0][1])]
    return docs, [*items, items[3], (77, items[4][1]), (None, "no id at all here"), (78, None), (79, "  ")]


@pytest.mark.parametrize("seed,block", [(1, 10**6), (2, 300)])
def test_equals_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(op7, "BLOCK_WORDS", block)
    docs, items = corpus(seed)
    found = op7.matches(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["doc_id", "found"]
    rows = found.collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: sorted({x.item_id for x in r.found}) for r in rows} == brute(docs, items)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op7.matches(documents, none).filter("size(found) > 0").count() == 0
    assert op7.matches(documents.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_whole_result_equals_the_sets(spark):
    sf = "/root/testdata/sf0.001"
    rows = op7.op7_benchmark_decontamination(spark, sf).collect()
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    expected = brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert {r.doc_id: r.item_ids for r in rows} == {k: ",".join(map(str, v)) for k, v in expected.items()}
    assert any(r.contaminated for r in rows)
    kept = op7.stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if not r.contaminated)
