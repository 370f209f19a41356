"""Byte-level BPE pieces: vectorised pre-token boundaries and encoding of distinct words.

Boundaries follow the split rule of byte-level BPE vocabularies (contractions; letters, digits or
other signs with one space before them; white space). They are found over the code points of many
texts at once. A word's ids depend on the word alone, so a word is encoded once wherever it recurs.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

LETTER, DIGIT, OTHER, SPACE, UNASSIGNED, UNKNOWN = 0, 1, 2, 3, 4, 255
# fixed values: the white space of the split rule, and the endings that a leading apostrophe splits off
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes = np.full(0x110000, UNKNOWN, np.uint8)


def _learn(points: np.ndarray) -> None:
    for p in points.tolist():
        kind = unicodedata.category(chr(p))
        _classes[p] = SPACE if p in WHITE else {"L": LETTER, "N": DIGIT}.get(kind[0], UNASSIGNED if kind == "Cn" else OTHER)


_learn(np.arange(0x250))


def known_ids(words: list[bytes], vocabulary: Vocabulary, cache: dict[bytes, list[int]], limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words in a row and each word's start in it; ``cache`` keeps what was encoded, emptied above ``limit`` words."""
    if limit is not None and len(cache) > limit:
        cache.clear()
    rows = []
    for word in words:
        ids = cache.get(word)
        if ids is None:
            ids = cache[word] = vocabulary.encode_word(word)
        rows.append(ids)
    begin = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)), out=begin[1:])
    return np.fromiter(chain.from_iterable(rows), np.int32, int(begin[-1])), begin


def _char_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data & 0xC0) != 0x80)


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pre-tokens of UTF-8 texts (they fill the bytes) and the index of each text's first one."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(at), np.int64)
    ascii_only = not (data & 0x80).any()
    if ascii_only:
        points, begin = data, at
        where = None
    else:
        where = _char_starts(data)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begin = np.searchsorted(where, at)
    kinds = _classes[points]
    if (kinds == UNKNOWN).any():
        _learn(np.unique(points[kinds == UNKNOWN]))
        kinds = _classes[points]
    n = len(points)
    head = np.zeros(n + 1, bool)  # a text begins here
    head[begin] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kinds[1:] != kinds[:-1]
    start |= head[:n]
    # the last white-space sign of a run goes to what follows if it is a blank, and stands alone otherwise
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~head[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # contractions: an apostrophe that begins a pre-token, then one of the endings
    quotes = np.flatnonzero((points == 0x27) & start)
    if len(quotes):
        text_end = begin[np.searchsorted(begin, quotes, "right")]
        for ending in sorted(ENDINGS, key=len, reverse=True):
            fits = quotes + len(ending) < text_end
            for i, letter in enumerate(ending, 1):
                fits &= points[np.minimum(quotes + i, n - 1)] == ord(letter)
            chosen = quotes[fits]
            start[chosen + 1] = False
            after = chosen + len(ending) + 1
            start[after[after < n]] = True
            quotes, text_end = quotes[~fits], text_end[~fits]
    spots = np.flatnonzero(start)
    first = np.searchsorted(spots, begin)
    offsets = np.r_[spots if where is None else where[spots], len(data)].astype(np.int64)
    return offsets, first


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Local number of each word and the distinct words, in order of first occurrence."""
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary


class Vocabulary:
    """One tokenizer file: word bytes to ids, ids to bytes. Made once per worker by ``load``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            content = file.read()
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(content)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(0x100, 0x200))
        self.byte_of = {chr(b): b for b in printable} | {chr(next(spare)): b for b in range(256) if b not in printable}
        vocab, merges = parts["model"]["vocab"], parts["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in parts.get("added_tokens", [])}
        self.pieces: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for piece, number in vocab.items():
            self.pieces[number] = bytes(self.byte_of[c] for c in piece)
        for piece, number in self.added.items():
            self.pieces[number] = piece.encode()
        ranks = {self.pieces[i]: i for i in vocab.values()}
        # merges in the order of their products' ids: the rank form of the same vocabulary is then exact
        products = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        self.core = None
        if all(a < b for a, b in zip(products, products[1:], strict=False)):
            import tiktoken

            self.core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode_word(self, word: bytes) -> list[int]:
        if word[:1] == WHOLE:
            return self.encode_text(word[1:].decode())
        if self.core is not None:
            return self.core.encode_single_piece(word)
        return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids

    def encode_text(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_loaded: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def whole_texts(data: np.ndarray, at: np.ndarray, added: dict[str, int]) -> np.ndarray:
    """Which texts the tokenizer itself must encode: those with the string of an added token, or with a
    code point that this Python's Unicode tables do not know while the tokenizer's may."""
    flags = np.zeros(len(at) - 1, bool)
    raw = data.tobytes()
    for content in added:
        needle, spot = content.encode(), -1
        while (spot := raw.find(needle, spot + 1)) >= 0:
            flags[np.searchsorted(at, spot, "right") - 1] = True
    if (data & 0x80).any():
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        odd = np.flatnonzero((points >= 0x250) & (_classes[points] == UNASSIGNED))
        if len(odd):
            flags[np.searchsorted(at, _char_starts(data)[odd], "right") - 1] = True
    return flags


WHOLE = b"\xff"  # never begins valid UTF-8: marks a "word" that is a whole text


def text_words(data: np.ndarray, at: np.ndarray, added: dict[str, int]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the words of each text, the distinct words, and the index of each text's first word.

    A text that must be encoded whole is one word that begins with ``WHOLE``.
    """
    offsets, first = split_words(data, at)
    index, words = distinct(data, offsets)
    flags = whole_texts(data, at, added)
    if not flags.any():
        return index, words, first
    raw, extra, parts, counts = data.tobytes(), [], [], []
    for i in range(len(at) - 1):
        if flags[i]:
            parts.append(np.array([len(words) + len(extra)], np.int32))
            extra.append(WHOLE + raw[at[i] : at[i + 1]])
        else:
            parts.append(index[first[i] : first[i + 1]])
        counts.append(len(parts[-1]))
    words = pa.concat_arrays([words, pa.array(extra, pa.large_binary())])
    return np.concatenate(parts), words, np.r_[0, np.cumsum(counts)]


def gather(table_offsets: np.ndarray, table: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the table's rows named by ``index``; also each row's start in the result."""
    counts = np.diff(table_offsets)[index]
    begin = np.zeros(len(index) + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    spots = np.arange(int(begin[-1])) + np.repeat(table_offsets[index] - begin[:-1], counts)
    return table[spots], begin
