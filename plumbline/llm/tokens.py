"""Exact, cached encoding with a public tokenizer of the tokenizers library.

The tokenizer splits at white space and its pieces never cross a split, so a text's ids are its words' ids in a
row. Texts are encoded many at a time: each different word among them is looked up once, in the ids of the pieces that
the task has met, and only new pieces go to the library's BPE model.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, pairwise

import pyarrow as pa
import pyarrow.compute as pc

from .common import claim

#: Pieces kept by a task, and the length up to which they are; a full cache starts anew. Both bound memory and change no result.
CACHE_PIECES, CACHE_LENGTH = 500_000, 64
#: Signs that are cut off the end of a word at first: ASCII, without the apostrophe, which may begin a piece with letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Fixed value: the tokenizer's split pattern, to check that a file fits the cached path.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class WordEncoder:
    """Encodes texts to the bytes of their ids (little-endian unsigned 32-bit)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.split = regex.compile(SPLIT)
        # the byte alphabet: printable Latin-1 stands for itself, the rest follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        letters = [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]
        self.spelling = dict(enumerate(letters))
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = bool(steps) and steps[0].get("pattern", {}).get("Regex") == SPLIT and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Ask the library's model for the ids of pieces."""
        ids, ends = array("I"), [0]
        for piece in pieces:
            spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.spelling)
            ids.extend([x.id for x in self.model.tokenize(spelled)])
            ends.append(4 * len(ids))
        data = pack(ids)
        self.pieces.update(zip(pieces, [data[a:b] for a, b in pairwise(ends)], strict=True))

    def _stems(self, stems: list[str]) -> list[bytes]:
        """The ids of different strings without white space."""
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        pieces = self.pieces
        found = list(map(pieces.get, stems))
        missing = [i for i, ids in enumerate(found) if ids is None]
        mixed = {i: self.split.findall(stems[i]) for i in missing if not stems[i].isalpha()}
        whole = [i for i in missing if i not in mixed]
        new = dict.fromkeys(stems[i] for i in whole)
        new.update(dict.fromkeys(x for x in chain.from_iterable(mixed.values()) if x not in pieces))
        self._learn(new)
        for i in whole:
            found[i] = pieces[stems[i]]
        for i, parts in mixed.items():
            found[i] = b"".join([pieces[x] for x in parts])
        for x in new:
            if len(x) > CACHE_LENGTH:
                del pieces[x]
        return found

    def _words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of different words: those of what stands before the signs at the end and those of the signs."""
        import numpy as np

        stems = pc.ascii_rtrim(words, characters=SIGNS)
        # signs after another sign (an apostrophe) would be one piece with it
        apart = pc.or_(pc.utf8_is_alnum(pc.utf8_slice_codeunits(stems, -1, None)), pc.equal(pc.binary_length(stems), 0))
        at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
        cuts = np.empty(2 * len(words) + 1, dtype=np.int32)
        cuts[::2] = at
        cuts[1::2] = np.where(np.asarray(apart), at[:-1] + np.asarray(pc.binary_length(stems)), at[1:])
        coded = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(cuts), words.buffers()[2]).dictionary_encode()
        ids = pa.array(self._stems(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[: 2 * len(words) + 1 : 2].copy()
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), ids.buffers()[2]])

    def _plain(self, text: str) -> bool:
        # the library's lower case knows no final sigma; its normal form and special strings need the whole text
        return self.by_word and not ("Σ" in text or any(x in text for x in self.specials) or not unicodedata.is_normalized("NFC", text) or any(c in text for c in "\x1c\x1d\x1e\x1f"))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The bytes of all ids of each text; null counts as empty."""
        import numpy as np

        out, plain = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text and self._plain(text):
                plain.append(i)
            elif text:
                out[i] = pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if plain:
            # other white space stays inside words here and is dropped by the split pattern
            words = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.string()))
            coded = words.flatten().dictionary_encode()
            ids = self._words(coded.dictionary).take(coded.indices)
            _, ends, data = ids.buffers()
            at = np.frombuffer(ends, dtype=np.int64)[np.asarray(words.offsets)].tolist()
            data = memoryview(data)
            for i, a, b in zip(plain, at[:-1], at[1:], strict=True):
                out[i] = data[a:b].tobytes()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    claim("tokens", _encoder.cache_clear)
    return _encoder(path)
