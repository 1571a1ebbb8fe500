import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import op5_token_files as op5
from plumbline.llm import op9_best_fit_packing as op9
from plumbline.llm import tokens


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text, end: [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_cached_encoding_is_the_tokenizers(spark, encode):
    found = tokens.encoder(tokens.default_path())
    texts = ["İstanbul'll it's 3.14 -- ...", "a​b   c", "x" * 500, "日本語 テスト", "ΣΑΣ σας", "<|startoftext|>a<|endoftext|>", "tab\there\x0b\x0cvt", "\x85next\x1fline", "ﬁ ligature Å", "don't DON'T 'tis rock'n'roll", "1234 ab12cd", "🙂🙂 ok👍"]
    for text in [*texts, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]:
        assert np.frombuffer(found.encode(text), dtype="<u4").tolist() == encode(text, 0)[:-1]


def test_control_characters_and_signs_keep_their_ids(encode):
    found = tokens.WordEncoder(tokens.default_path())
    texts = ["a \x01 b", "x\x7f\x00y", "tab\x08!", "rock'... rock'n'!! it's.'s", "été***, (a)&&& 81.117.189.12", "...", " \n", None, "a…!! b\xa0... c\u2003.", "soft\xad-"]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in found.encode_all(texts)] == [encode(t, 0)[:-1] for t in texts]


def test_words_of_many_texts_are_looked_up_once(encode, monkeypatch):
    found, asked, learn = tokens.WordEncoder(tokens.default_path()), [], tokens.WordEncoder._stems
    monkeypatch.setattr(tokens.WordEncoder, "_stems", lambda self, stems: asked.extend(stems) or learn(self, stems))
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    texts = ["Some words, some words!", "words some: Other" + " words" * 100, "x" * 70 + " some"]
    for _ in range(2):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in found.encode_all(texts)] == [encode(t, 0)[:-1] for t in texts]
    assert sorted(asked) == sorted(2 * ["", "!", ",", ":", "other", "some", "words", "x" * 70])


def test_token_files_round_trip(spark, documents, encode, tmp_path):
    path = op5.write_tokens(documents, f"file://{tmp_path}/ids")
    rows = op5.read_tokens(spark, path).collect()
    rows.sort(key=lambda r: r.start)
    known = {r.doc_id: r.text for r in documents.collect()}
    at = 0
    for r in rows:
        assert (r.start, r.ids) == (at, encode(known[r.doc_id], 2))
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in documents.collect()), key=lambda x: -1 if x is None else x)
    some = op5.read_tokens(spark, path, 3, 5).collect()
    assert sorted(r.doc_id for r in some) == [3, 4, 5, 5]
    assert {r.doc_id: r.ids_crc32 for r in op5.digest(op5.read_tokens(spark, path)).collect()} == {k: crc(encode(t, 2)) for k, t in known.items()}


def test_token_files_have_the_encodings(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    op5.write_tokens(documents, f"file://{tmp_path}/ids")
    metas = [pq.ParquetFile(f).metadata for f in (tmp_path / "ids").glob("*.parquet")]
    groups = [m.row_group(0) for m in metas if m.num_row_groups]
    assert groups
    for g in groups:
        columns = {g.column(i).path_in_schema: g.column(i) for i in range(g.num_columns)}
        assert any("DICTIONARY" in x for x in columns["ids.list.element"].encodings)
        assert columns["doc_id"].encodings != columns["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert columns["doc_id"].has_column_index


def test_empty_tables(spark, documents, tmp_path):
    none = documents.limit(0)
    path = op5.write_tokens(none, f"file://{tmp_path}/ids")
    assert op5.digest(op5.read_tokens(spark, path)).count() == 0
    assert op9.pack(none).count() == 0


def check_packing(rows, capacity):
    taken = defaultdict(list)
    for r in rows:
        taken[r.sequence_id].append((r.offset, r.length))
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(taken)


def test_packing(spark, documents, encode):
    rows = op9.pack(documents, capacity=64).collect()
    check_packing(rows, 64)
    expected = Counter()
    for r in documents.collect():
        ids = encode(r.text, 0)
        for piece, at in enumerate(range(0, len(ids), 64)):
            expected[r.doc_id, piece, at, len(ids[at : at + 64]), crc(ids[at : at + 64])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected


def test_packing_is_tight(spark):
    rows = op9.op9_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    used = check_packing(rows, 2048)
    assert used == -(-sum(r.length for r in rows) // 2048)  # the least possible


@pytest.mark.parametrize("seed", range(4))
def test_plan_fits(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal(6, 1.2, 20_000).astype(int) + 1)
    histogram = Counter(lengths.tolist())
    rows, n = op9.plan_packing(histogram)
    fill, placed = np.zeros(n, int), Counter()
    for length, _, count, sequence, offset in sorted(rows, key=lambda r: r[4]):
        assert (fill[sequence : sequence + count] == offset).all()
        fill[sequence : sequence + count] += length
        placed[length] += count
    assert placed == histogram and fill.max() <= 2048
    assert n <= op9._planned(histogram, 2048, 128, 1.0).sequences  # best-fit decreasing
