import re

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import op1_quality_rules as op


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n\t ", "a b c", "a b c a b c", "a a a a", "x\nx\n\nx#$ y", "é\u00a0ü ß", " ".join(["w1 w2 w3 w4"] * 60)]
    texts += [" ".join(rng.choice(list("abcd"), rng.integers(1, 60))) for _ in range(40)] + [" ".join(f"w{i % 90}" for i in range(400)), "\n".join(rng.choice(["l1 x", "l2", "l3 é|"], 30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op.counts(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10, 0.1), (1, 10, 0.2), (3, 400, 0.02), (0, 400, 0.004), (2, 3000, 0.004), (300, 400, 0.02)]
    df = spark.createDataFrame(cases, "k long, n long, p double").select("k", "n", "p", op.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("tail"))
    for r in df.collect():
        exact = sum(comb(r["n"], i) * r["p"] ** i * (1 - r["p"]) ** (r["n"] - i) for i in range(r["k"] + 1))
        assert abs(r["tail"] - exact) < 1e-9 if r["k"] <= r["n"] * r["p"] else r["tail"] == 1.0


def test_few_good_documents_are_lost(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(2000)]
    junk = [(i, " ".join(f"w{i}x{j}###" for j in range(60)), "en") for i in range(2000, 2100)]
    docs = spark.createDataFrame([*clean, *junk, (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(2000)] + [(i, 0) for i in range(2000, 2100)] + [(5, 0), (None, 1)], "doc_id long, quality int")
    rows = op.judged(docs, labels).collect()
    assert len(rows) == 2101
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len(kept & set(range(2000))) >= 0.98 * 2000 and not kept & set(range(2000, 2100))


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a " * 60, "en"), (2, "b", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["doc_id"]: r["base_failed"] for r in op.judged(docs, none).collect()} == {1: True, 2: True}
    assert op.judged(docs.limit(0), none).count() == 0
