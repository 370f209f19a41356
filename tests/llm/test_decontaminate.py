"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cellwise.llm import decontaminate
from cellwise.llm.queries import op13_decontamination
from pyspark.sql import functions as F

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window):
    windows = {}
    for i, text in items:
        w = split(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, names = split(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(names)))
    return out


def longest(docs, items, window):
    """Length of the longest match of each item, if a whole window matches."""
    out = {}
    for i, text in items:
        w = split(text)
        need = min(window, len(w))
        for _, doc in docs if w else ():
            d = split(doc)
            for a in range(len(w)):
                for b in range(len(d)):
                    n = 0
                    while a + n < len(w) and b + n < len(d) and w[a + n] == d[b + n]:
                        n += 1
                    if n >= need and n > 0 and (need == window or a == 0):
                        out[str(i)] = max(out.get(str(i), 0), n)
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def run(spark, docs, items, window=10, shard=1 << 12, block=8 << 20):
    index = decontaminate.suffix_shards(docs, shard_bytes=shard)
    found = decontaminate.search(index, spark.createDataFrame(items, "item_id bigint, text string"), window, block_bytes=block)
    rows = found.select(F.col("doc.c0").alias("d"), "n_words", decontaminate.hit_words().alias("n"), "items").collect()
    return sorted(((r.d, r.n_words, r.n, r["items"]) for r in rows), key=key), found


@pytest.fixture(scope="module")
def planted(awkward):
    rng = random.Random(4)
    items = [(i, words(rng.randint(12, 40), 900 + i)) for i in range(12)]
    items += [(20, "short item"), (21, "One"), (22, None), (23, " .,- "), (20, "another text of the same id that is long enough to have two windows"), (None, words(15, 950)), (24, items[0][1])]
    docs = list(awkward)
    for i in range(40):
        w = items[i % 12][1].split()
        a = rng.randint(0, len(w) - 6)
        part = w[a : a + rng.randint(6, 30)]
        docs.append((100 + i, words(rng.randint(0, 30), i) + " " + ", ".join(part).upper() + "\n" + words(rng.randint(0, 30), 60 + i)))
    docs += [(200, "a SHORT, item here"), (201, "one" + " one" * 300), (202, items[3][1] + " " + items[3][1]), (203, words(15, 950)), (204, "x " + items[5][1]), (204, "x " + items[5][1])]
    return docs, items


def test_against_brute_force(spark, docs_of, planted):
    docs, items = planted
    want = sorted(brute(docs, items, 10), key=key)
    assert sum(1 for w in want if w[2]) > 20
    got, found = run(spark, docs_of(docs), items)
    assert got == want
    assert run(spark, docs_of(docs), items, block=200)[0] == want  # many blocks
    assert run(spark, docs_of(docs), items, shard=4 << 20)[0] == want
    best = {r["item"]: r["length"] for r in decontaminate.longest_matches(found).collect()}
    lengths = longest(docs, [x for x in items if x[0] is not None and x[0] != 20], 10)
    assert {k: v for k, v in best.items() if k not in ("", "20")} == lengths


def test_places_of_longest_matches(spark, docs_of, planted):
    docs, items = planted
    _, found = run(spark, docs_of([d for d in docs if d[0] != 204 and d[0] != 6]), items)
    texts = {i: split(t) for i, t in docs}
    named = {}
    for i, t in items:
        named.setdefault("" if i is None else str(i), []).append(split(t))
    for r in decontaminate.longest_matches(found).collect():
        there = texts[r.doc["c0"]][r.doc_start : r.doc_start + r["length"]]
        assert len(there) == r["length"]
        assert any(w[r.item_start : r.item_start + r["length"]] == there for w in named[r["item"]])


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for repeats in (1, 3):
        part = rng.integers(3, 9, 120)
        text = np.r_[part, 0, np.tile(part, repeats), 1, np.full(90, 5), 2].astype(np.int32)
        for width in (1, 4):
            order = decontaminate.suffix_array(text, width, 4)
            want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
            assert order.tolist() == want


def test_rank_of_words_is_exact():
    vocabulary, ranks, first = decontaminate.coded_words(pa.array(["b A", None, "", "é-a 7"]))
    assert [vocabulary[r].as_py().decode() for r in ranks.tolist()] == ["b", "a", "é", "a", "7"]
    assert first.tolist() == [0, 2, 2, 2, 5]


def test_edges(spark, docs_of):
    some = [(1, words(30, 1))]
    assert run(spark, docs_of([]), some)[0] == []
    assert run(spark, docs_of(some), [])[0] == [(1, 30, 0, [])]
    items = spark.createDataFrame([(1, words(12, 1)), (2, "q")], "item_id bigint, text string")
    docs = docs_of([*some, (2, "Q."), (3, None), (4, "q1 r"), (None, "clean")])
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 3, 4]


def test_query(spark):
    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = sorted(tuple(r)[:6] for r in op13_decontamination(spark, at).collect())
    digest = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    assert got == sorted((i, n, h, len(s), digest(s), h > 0) for i, n, h, s in brute(docs, items, 10))
    assert any(r[5] for r in got)


def test_a_task_holds_one_shard_of_its_file(spark, docs_of):
    """A file of many shards is written and read a shard at a time."""
    docs = [(i, words(60, 500 + i)) for i in range(30)]
    index = decontaminate.suffix_shards(docs_of(docs).coalesce(1), shard_bytes=1 << 10)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(files) == 1 and len(groups) > 10
    assert set(groups) == {1}
    chunks = [files[0].row_group(i).column(c) for i in range(len(groups)) for c in range(files[0].num_columns)]
    assert not any(c.is_stats_set and c.statistics.has_min_max for c in chunks)
    found = decontaminate.search(index, spark.createDataFrame([(1, docs[7][1])], "item_id bigint, text string"))
    assert [r.doc.c0 for r in found.where("size(items) > 0").collect()] == [7]
