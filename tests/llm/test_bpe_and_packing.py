"""BPE round trip and packing against the tokenizer itself."""

import hashlib
import zlib

import numpy as np
import pytest
from cellwise.llm import bpe, packing, tokens
from cellwise.llm.queries import vocabulary_path
from hypothesis import given, settings
from hypothesis import strategies as st


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sstdrevelm  \n\t1!?") + ["é", "　", "中", "½", "́", " "]), max_size=40))
def test_words_as_the_tokenizer_splits(text):
    tokenizer = tokens.load(vocabulary_path()).tokenizer
    raw = np.frombuffer(text.encode(), np.uint8)
    offsets, _ = tokens.split_words(raw, np.array([0, len(raw)]))
    got = [raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert got == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_round_trip(docs_of, awkward, tokenizer):
    path = vocabulary_path()
    docs = docs_of(awkward)
    want = sorted((i is None, i or 0, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in awkward)
    rows = bpe.encode(docs, path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in rows) == want
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        assert r.decoded == tokenizer.decode(list(r.ids), skip_special_tokens=False)
    digests = {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path).collect()}
    assert digests == {
        (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()) for _, _, x in want
    }


def test_empty_tables(docs_of):
    path = vocabulary_path()
    assert bpe.round_trip(docs_of([]), path).count() == 0
    assert packing.pack(packing.pieces(docs_of([]), path)).count() == 0


def test_packing(docs_of, awkward, tokenizer):
    rows = packing.pack(packing.pieces(docs_of(awkward), vocabulary_path(), 64), 64).collect()
    ids = {}
    for i, t in awkward:
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    for r in rows:
        got = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(got) == r.length and any(x[r.start : r.start + r.length] == got for x in ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    assert all(r.length == 64 for r in rows if r.piece > 0)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 2


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12), st.sampled_from(["dot", "norm"]), st.sampled_from([3, 64]), st.sampled_from([64 * 64, 4096 + 10]))
def test_patterns_respect_every_capacity(counts, score, most, cost):
    patterns = packing.fill(counts, (64, most, cost), (1.0, 0.2, 0.2), score)
    placed = {}
    for pattern, times in patterns:
        assert sum(n * k for n, k in pattern) <= 64
        assert sum(k for _, k in pattern) <= most
        assert sum(n * n * k for n, k in pattern) <= cost
        for n, k in pattern:
            placed[n] = placed.get(n, 0) + k * times
    assert placed == counts


def test_crc(docs_of, tokenizer):
    from pyspark.sql import functions as F

    row = packing.pieces(docs_of([(1, "some words")]), vocabulary_path()).select(F.crc32("ids").alias("c")).first()
    want = np.array(tokenizer.encode("some words", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert row.c == zlib.crc32(want)
