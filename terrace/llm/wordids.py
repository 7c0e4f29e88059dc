"""Token ids by the tokenizers library, with the ids of repeated pieces of text remembered.

The tokenizer's vocabulary is word based: white space is dropped and no id spans it, so a text's ids
are its chunks' ids in a row.  Every chunk between white space is encoded by the library once per
worker (bounded caches); texts with white space that Python and the library see differently are
encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from terrace.llm.common import worker_cache

#: Chunks, and as many words, that a worker's young generation holds; the one before it is kept beside it.
#: A bound of memory, not of results.
CACHE_ENTRIES = 200_000
#: Bytes of text that are cut and looked up together.
SLICE = 5 << 20
#: A Latin-1 word with ASCII punctuation behind it: the library's pre-tokenizer cuts between them.
_WORD = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!#$%&*,.:;?|]*)")


def _byte_letters() -> dict[int, str]:
    """Latin-1 letter -> the characters by which a byte-level vocabulary writes its UTF-8 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}


_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """text -> its ids as unsigned 32-bit integers."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.words, self.old_words, self.old = tokenizer, {}, {}, {}
        self.model = tokenizer.model

    def encode(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        return ids.tobytes()

    def letters(self, text: str) -> bytes:
        """Of one new lower-case Latin-1 word: what the normaliser and pre-tokenizer leave alone goes to the model."""
        if (ids := self.old_words.get(text)) is None:
            pieces = self.model.tokenize(text if text.isascii() else text.translate(_LETTERS))
            ids = array("I", [x.id for x in pieces]).tobytes()
        if len(self.words) >= CACHE_ENTRIES:
            self.old_words, self.words = self.words, {}
        self.words[text] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.old.get(chunk)) is None:
            if not (m := _WORD.fullmatch(chunk)):
                ids = self.encode(chunk)
            elif (ids := self.words.get(word := m[1].lower())) is None:
                ids = self.letters(word)
                return ids + self[m[2]] if m[2] else ids  # a word's first time: not worth a place of its own
            elif m[2]:
                ids = ids + self[m[2]]
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = _Known(self.tokenizer)
        encode = self.known.encode
        between = [f"a{chr(c)}b" for c in range(0x3001)]
        cut = pc.list_value_length(pc.utf8_split_whitespace(pa.array(between))).to_pylist()
        odd = [x[1] for x, n in zip(between, cut, strict=True) if (n > 1 or x[1].isspace()) and encode(x) != encode("a") + encode("b")]
        self.odd = re.compile(f"[{re.escape(''.join(odd))}]") if odd else re.compile(r"(?!)")

    def __call__(self, text: str | None) -> bytes:
        """The ids of one text."""
        if not text:
            return b""
        if self.odd.search(text):
            return self.known.encode(text)
        return b"".join(map(self.known.__getitem__, text.split()))

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string array, in slices of about SLICE bytes.

        A slice's chunks are cut and numbered by Arrow, each distinct one is looked up once, and the
        ids are gathered by place.
        """
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE, "right")))
            yield from self._slice(texts.slice(first, last - first))
            first = last

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts, "")
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        of, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        known = self.known
        ids = [known[x] if x else b"" for x in distinct]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        n = lengths[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = flat[np.repeat(begin[of] - ends[:-1], n) + np.arange(ends[-1])]
        edges = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        for i, odd in enumerate(pc.match_substring_regex(texts, self.odd.pattern).to_pylist() if self.odd.pattern != "(?!)" else [False] * len(texts)):
            yield np.frombuffer(known.encode(texts[i].as_py()), "<u4") if odd else flat[edges[i] : edges[i + 1]]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for the vocabulary file at path."""
    return worker_cache("words", path, lambda: WordEncoder(path))
