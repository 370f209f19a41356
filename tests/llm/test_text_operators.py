"""Substrings, SimHash, quality rules, language model and toxicity against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cellwise.llm import lm, quality, simhash, substrings, toxicity
from cellwise.llm.bpe import _pack, _unpack
from pyspark.sql import functions as F

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# --- substrings


def brute_removed(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check_substrings(docs_of, rows, window=35, kmer=12):
    got = substrings.remove_repeats(docs_of(rows), window, kmer).collect()
    want = brute_removed([t for _, t in rows], window)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words_, r.n_removed_, r.kept_ or "") for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)


def test_substrings(docs_of, awkward):
    check_substrings(docs_of, awkward)


def test_substrings_refuse_pieces_longer_than_a_mask():
    with pytest.raises(ValueError, match="63"):
        substrings.remove_repeats(None, 100, 12)


def test_substrings_in_many_branches(docs_of):
    rng = random.Random(3)
    base = words(200, 9).split()
    rows = []
    for i in range(60):
        a = rng.randint(0, 150)
        part = base[a : a + rng.randint(20, 60)]
        if i % 3 == 0:
            part[len(part) // 2] = "changed"
        rows.append((i, " ".join(words(rng.randint(0, 10), 100 + i).split() + part + words(rng.randint(0, 10), 500 + i).split())))
    rows.append((99, "x y " * 60))
    check_substrings(docs_of, rows)
    check_substrings(docs_of, rows, window=12, kmer=4)


def test_substrings_in_long_paths(docs_of):
    """Long copies that enter and leave each other's paths, periodic texts and copies with changed words."""
    rng = random.Random(8)
    book = words(3000, 21).split()
    rows = [(1, " ".join(book)), (2, " ".join(book)), (3, " ".join(book[700:2200])), (4, " ".join(book[:1500] + book[400:900]))]
    for i in range(10, 16):
        copy = book[rng.randint(0, 500) : rng.randint(900, 3000)]
        for _ in range(6):
            copy[rng.randrange(len(copy))] = f"changed{i}"
        rows.append((i, " ".join(copy)))
    period = words(90, 22).split()
    rows += [(20, " ".join(period * 7)), (21, " ".join(period[30:] + period * 2))]
    check_substrings(docs_of, rows)
    check_substrings(docs_of, rows, window=20, kmer=5)


def test_paths_compact_where_degrees_are_one(spark):
    """A path of 300 pieces, a fork, a piece that ends a document, and a piece with a second predecessor."""
    rows = [(i, 3, 2, i + 1, i + 1, 3) for i in range(299)] + [(299, 3, 2, None, None, 0)]
    rows += [(400, 4, 5, 401, 402, 4), (401, 2, 1, 403, 403, 2), (402, 2, 1, 403, 403, 2), (403, 4, 7, None, None, 0)]
    rows += [(500, 3, 2, 501, 501, 2), (501, 2, 2, 502, 502, 2), (502, 2, 9, None, None, 0)]
    pieces = spark.createDataFrame(rows, "piece bigint, n bigint, windows tinyint, low bigint, high bigint, followed bigint")
    got = {r.piece: r.windows for r in substrings.compact(pieces).collect()}
    assert got == {0: 600, 400: 5, 401: 1, 402: 1, 403: 7, 500: 2, 501: 11}


def test_spans_are_confirmed_by_their_words(spark):
    """One path given for two equal spans and one of other words: only the blocks with equal words stay."""
    text = words(60, 31)
    half = " ".join(text.split()[:40]) + " " + words(20, 32)
    texts = spark.createDataFrame([(1, text), (2, "a b " + text.replace(" ", "\n ")), (3, half), (4, words(60, 33))], "row_ bigint, text string")
    spans = spark.createDataFrame([(row, 7, 2 if row == 2 else 0, 51) for row in (1, 2, 3, 4)], "row_ bigint, path bigint, start int, windows int")
    got = sorted(tuple(r) for r in substrings.confirmed(texts, spans, window=10, block=20).select("row_", "start", "windows").collect())
    assert got == [(1, 0, 20), (1, 20, 20), (1, 40, 11), (2, 2, 20), (2, 22, 20), (2, 42, 11), (3, 0, 20)]


def test_substrings_empty(docs_of):
    assert substrings.remove_repeats(docs_of([])).count() == 0
    kept = substrings.without_repeats(docs_of([(1, "two  words"), (2, None)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "two  words"), (2, None)]


def test_without_repeats_keeps_columns_of_any_name(docs_of):
    passage = words(40, 3)
    names = {"n_words_": F.lit(7), "n_removed_": F.lit("n"), "rest_": F.lit(0.5), "marks": F.array(F.lit(1))}
    docs = docs_of([(1, passage + " a b"), (2, "c " + passage), (3, "d")]).withColumns(names)
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "a b", 2: "c", 3: "d"}
    assert {(r.n_words_, r.n_removed_, r.rest_, tuple(r.marks), r.kept_) for r in kept.collect()} == {(7, "n", 0.5, (1,), 0.5)}


# --- SimHash


def brute_fingerprint(text, size):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4, size=4):
    prints = [brute_fingerprint(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, prints[k], low.get(find(k))) for k, (i, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(8)
    rows, n = [], 0
    for g in range(12):
        base = words(rng.randint(60, 300), 1000 + g).split()
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 99)}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


@pytest.mark.parametrize("distance", [4, 9])
def test_simhash(docs_of, awkward, distance):
    rows = awkward + [(100 + i, t) for i, t in near_rows()]
    got = simhash.near_duplicates(docs_of(rows), distance=distance).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(brute_components(rows, distance), key=key)


def test_simhash_large_runs_are_dealt_as_tiles(docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "RUN_LIMIT", 6)
    rows = near_rows()
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for i, _, c in brute_components(rows))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_keep_one(docs_of):
    base = words(300, 77)
    rows = [(5, base), (3, base), (9, base.replace(base.split()[150], "other")), (4, words(300, 78))]
    assert sorted(r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()) == [3, 4]
    assert simhash.keep_one(docs_of([])).count() == 0


def brute_groups(texts):
    fps = [brute_fingerprint(t, 4) for t in texts]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
    return root


@pytest.mark.parametrize("limit", [8192, 5])
def test_keep_representatives_against_brute_force(docs_of, awkward, monkeypatch, limit):
    monkeypatch.setattr(simhash, "RUN_LIMIT", limit)
    rng, rows = random.Random(21), list(awkward)
    for k in range(12):
        base = words(150, 900 + k).split()
        for i in range(6):
            mine = list(base)
            for spot in rng.sample(range(150), rng.randint(0, 2)):
                mine[spot] = f"x{i}"
            rows.append((rng.choice([None, 1000 + 10 * k + i, 5]), " ".join(mine)))
    rng.shuffle(rows)
    groups = collections.defaultdict(list)
    for row, root in zip(rows, brute_groups([t for _, t in rows]), strict=True):
        groups[root].append(row)
    docs = docs_of(rows).withColumns({"mark": F.lit(1), "stay_": F.lit(2), "row": F.lit(3), "low": F.lit(4), "more_": F.lit(5)})
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    small = lambda r: (r[0] is None, r[0] or 0)
    # the id is settled; of several texts with that id in one group any may stay, and the same one each time
    assert len(got) == len(groups)
    assert sorted(i for i, _ in got) == sorted(min(g, key=small)[0] or 0 for g in groups.values())
    assert {t for _, t in got} <= {t or "" for g in groups.values() for t in [x[1] for x in g if x[0] == min(g, key=small)[0]]}
    assert got == sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_representatives(docs.repartition(7)).collect())


@pytest.mark.parametrize("keep", [simhash.keep_one, simhash.keep_representatives])
def test_null_and_repeated_ids_are_decided_by_row(docs_of, keep):
    """Null-id copies go with their group; equal rows and copies under one id leave one row."""
    five, six, three = (words(120, s) for s in (61, 62, 63))
    rows = [(5, five), (5, five), (None, five), (6, six), (None, six), (None, words(120, 64)), (3, three), (5, three), (7, three)]
    got = sorted((r.doc_id or 0, r.text) for r in keep(docs_of(rows)).collect())
    assert got == sorted([(5, five), (6, six), (0, words(120, 64)), (3, three)])


def pairs_near(similarity: float, many: int, seed: int) -> tuple[list, list]:
    """Rows of pairs with about this Jaccard of five-word shingles, and the exact similarity of each pair."""
    rng = random.Random(seed)
    rows, exact = [], []
    for k in range(many):
        n = 400
        one = [f"w{seed}x{k}x{i}" for i in range(n)]
        two = list(one)
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        spots = rng.sample(range(2, n, 5), n // 5)
        jaccard = 1.0
        for spot in spots:
            if jaccard - 0.0125 < similarity:
                break
            two[spot] = "other" + two[spot]
            a, b = shingles(one), shingles(two)
            jaccard = len(a & b) / len(a | b)
        exact.append(jaccard)
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    return rows, exact


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.75, 0.8, 0.81, 0.85, 0.9])
def test_keep_one_links_by_similarity(docs_of, similarity):
    rows, exact = pairs_near(similarity, 300, int(100 * similarity))
    kept = {r.doc_id for r in simhash.keep_one(docs_of(rows)).select("doc_id").collect()}
    gone = [2 * k + 1 not in kept for k in range(len(exact))]
    assert all(2 * k in kept for k in range(len(exact)))
    above = [g for g, j in zip(gone, exact, strict=True) if j >= 0.8]
    below = [g for g, j in zip(gone, exact, strict=True) if j < 0.8]
    print(f"similarity {similarity} (mean {sum(exact) / len(exact):.3f}): linked {sum(above)} of {len(above)} at 0.8 or more, {sum(below)} of {len(below)} below")
    assert not any(below) and sum(above) >= 0.99 * len(above)
    assert bool(above) == (similarity >= 0.8)


def test_keep_one_in_large_runs(docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "RUN_LIMIT", 6)
    monkeypatch.setattr(simhash, "SET_LIMIT", 6)
    rng, base, rows = random.Random(8), words(120, 5).split(), []
    for i in range(60):
        mine = list(base)
        for spot in rng.sample(range(120), rng.randint(0, 6)):
            mine[spot] = f"x{i}y{spot}"
        rows.append((i, " ".join(mine)))
    sets = [{tuple(w[i : i + 5]) for i in range(116)} for w in (t.split() for _, t in rows)]
    root = list(range(60))
    for _ in range(60):
        root = [min(root[j] for j in range(60) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in range(60)]
    assert sorted(r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()) == sorted(set(root))


@pytest.mark.parametrize("distance", [1, 4, 10])
@pytest.mark.parametrize("distinct", [10, 10**6, 10**9])
def test_block_plan_meets_every_close_pair(distance, distinct):
    blocks, keep = simhash.block_plan(distinct, distance)
    assert blocks - keep >= distance and keep >= 1 and blocks <= 64


# --- quality


def brute_features(text):
    text = text or ""
    w = WORD.findall(text)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(triples)
    repeated = {j for i, t in enumerate(triples) if often[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_features(docs_of, awkward):
    rows = [*awkward, (20, "a b c\na b c\n\n d a b c\n#x* $\n"), (21, "x " * 70), (22, "a\x0bb\x0cc \x1f d   e"), (23, "the same line here\n" * 4)]
    got = quality.judge(docs_of(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(i, *brute_features(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_separates_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(docs).where("not base_failed").join(labels.withColumnRenamed("quality", "label"), "doc_id").select("label", "kept").collect()
    good = [r.kept for r in rows if r.label == 1]
    bad = [r.kept for r in rows if r.label == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_uses_no_python(docs_of, awkward):
    plan = quality.judge(docs_of(awkward))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality.keep_good(docs_of([])).count() == 0
    assert quality.keep_good(docs_of(awkward)).columns == docs_of(awkward).columns


def test_fit_finds_the_accuracy_of_rules():
    rng = random.Random(4)
    counts = collections.Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        counts[tuple(-1 if rng.random() < 0.1 else int((rng.random() < a) == good) for a in (0.95, 0.9, 0.85, 0.8))] += 1
    share, table = quality.fit(dict(counts), rounds=200)
    assert abs(share - 0.8) < 0.05
    for (bad, good), a in zip(table, (0.95, 0.9, 0.85, 0.8), strict=True):
        assert abs(good[1] / (good[0] + good[1]) - a) < 0.05 and abs(bad[0] / (bad[0] + bad[1]) - a) < 0.12


# --- language model


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs_of, order):
    rows = [(i, words(40, i % 5) + " " + words(10, i)) for i in range(40)] + [(50, None), (51, ""), (52, "Zq unseen"), (52, "Zq unseen")]
    priors = (0.5, 4.0)
    got = lm.score(docs_of(rows), lm.held_out(), order, priors).collect()
    learnt = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    texts = [(i, [*WORD.findall(lower(t)), "\0"]) for i, t in rows]
    grams, states = collections.Counter(), collections.Counter()
    for i, w in texts:
        if learnt(i):
            for n in range(1, order + 1):
                line = ["\1"] * (n - 1) + w
                for k in range(len(w)):
                    gram = tuple(line[k : k + n])
                    grams[n, gram] += 1
                    states[n - 1, gram[:-1]] += 1
    total, kinds = sum(c for (n, _), c in grams.items() if n == 1), sum(n == 1 for n, _ in grams)
    want = []
    mu = got[0].prior
    for i, w in texts:
        base = full = 0.0
        for k in range(len(w)):
            p = (grams[1, (w[k],)] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                gram = tuple((["\1"] * (n - 1) + w)[k : k + n])
                p = (grams[n, gram] + mu * p) / (states[n - 1, gram[:-1]] + mu)
            full += math.log10(p)
        want.append((i, not learnt(i), len(w), sum(grams[1, (x,)] > 0 for x in w), total, base, full))
    have = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_walk_over_parts_of_long_texts(monkeypatch, order):
    """A text in parts gets the score of the text as a whole, and the sum of its words' interpolated probabilities."""
    rng = random.Random(order)
    texts = [[rng.randrange(6) for _ in range(n)] + [6] for n in (0, 1, 5, 40, 41, 300)]
    counts = np.array([len(t) for t in texts])
    names = np.sort(np.array([rng.getrandbits(64) for _ in range(6)] + [2**63], np.uint64))
    numbers = np.array([w for t in texts for w in t], np.int32)
    held = np.array([0, 0, 1, 0, 1, 0])
    chunk = (counts, numbers, held, names)
    answers = {o: c.astype(float) for o, _, c in lm._requests(chunk, order)}
    size = answers[1].sum() + 0.5 * ((answers[1] > 0).sum() + 1)
    automaton, _, _ = lm._automaton(chunk, answers, order, size, (0.5, 8.0))
    whole = lm._walk(automaton, numbers, counts, order)
    monkeypatch.setattr(lm, "LANE_WORDS", 7)
    assert np.allclose(lm._walk(automaton, numbers, counts, order), whole, rtol=1e-12)
    seen = collections.Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            line = [-1] * (order - 1) + t
            for k in range(order - 1, len(line)):
                for n in range(order + 1):
                    seen[tuple(line[k + 1 - n : k + 1])] += 1
                    seen["h", tuple(line[k - n : k])] += n < order
    for i, t in enumerate(texts):
        line, want = [-1] * (order - 1) + t, np.zeros(2)
        for k in range(order - 1, len(line)):
            p = np.full(2, (seen[(line[k],)] + 0.5) / size)
            for n in range(2, order + 1):
                mu = np.array([0.5, 8.0])
                p = (seen[tuple(line[k + 1 - n : k + 1])] + mu * p) / (seen["h", tuple(line[k + 1 - n : k])] + mu)
            want += np.log10(p)
        assert np.allclose(whole[i], want, rtol=1e-9)


def test_counts_beyond_four_bytes():
    """Two chunks that hold a token three thousand million times each."""
    keys = np.array([5, 9], "<u8")
    blocks = [_pack(keys, np.array([3_000_000_000, n], "<u4")) for n in (0, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array([1, 1], pa.int32()), pa.array([0, 0], pa.int32()), pa.array(blocks, pa.binary())], names=["chunk", "order", "bucket", "block"])
    out = pa.Table.from_batches(lm._add_up(iter([batch])))
    for reply in out.column("reply").to_pylist():
        assert _unpack(reply, "<u8")[0].tolist() == [6_000_000_000, 7]
    assert sum(out.column("total").to_pylist()) == 6_000_000_007 and sum(out.column("kinds").to_pylist()) == 2


def test_language_model_edges(docs_of, awkward):
    assert lm.score(docs_of([]), lm.held_out()).count() == 0
    rows = lm.score(docs_of(awkward), lm.held_out()).collect()
    assert len(rows) == len(awkward) and all(math.isfinite(r.score) for r in rows)
    nothing = lm.score(docs_of([(1, "a b")]), F.lit(True)).collect()
    assert nothing[0].train_tokens == 0 and nothing[0].n_known == 0 and math.isfinite(nothing[0].score)


# --- toxicity


def test_marginals_equal_those_over_all_taggings():
    emit = np.array([[0.4, -0.4], [-0.3, 0.3], [-1.0, 1.0], [0.0, 0.0], [0.0, 0.0], [-2.0, 2.0]])
    move = np.array([[0.7, -0.6], [-0.5, 0.3]])
    chain = toxicity.Chain(np.zeros(0, np.uint64), np.zeros(0, np.int8), emit, move)
    for kinds in ([5, 0, 0, 1], [0, 0, 2, 0, 0, 0, 1, 0], [1], [0, 5], [1, 2, 5], [0, 0, 0, 0, 1]):
        weights = collections.defaultdict(float)
        for code in range(2 ** len(kinds)):
            tags = [code >> i & 1 for i in range(len(kinds))]
            w = math.exp(sum(emit[k][t] for k, t in zip(kinds, tags, strict=True)) + sum(move[a][b] for a, b in zip(tags, tags[1:], strict=False)))
            for i, t in enumerate(tags):
                weights[i, t] += w
        places = [i for i, k in enumerate(kinds) if k]
        got = chain.marginals(places, [kinds[i] for i in places], len(kinds))
        assert np.allclose(got, [weights[i, 1] / (weights[i, 0] + weights[i, 1]) for i in places], rtol=1e-9)


def test_toxicity_learns_and_points_at_words(spark, docs_of):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(240):
        text = words(rng.randint(20, 60), i).split()
        bad = i % 3 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["Idiotic,", "idiot", "scummy"]))
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks + [(9999, 1, 1), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(rows + [(1000, None), (1001, ""), (1000, None)])
    chain = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, chain).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id < 1000:
            assert (r.score >= toxicity.THRESHOLD) == (r.doc_id % 3 == 0)
            if r.doc_id % 3 == 0:
                raw = rows[r.doc_id][1].encode()
                assert any(raw[s.start : s.start + s.length].lower()[:5] in (b"idiot", b"scumm") for s in r.spans)
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == 163


def test_equal_texts_with_different_labels_count_once_as_toxic(spark, docs_of):
    rows = [(i, f"{words(20, i // 2)} {'scum' if i % 4 < 2 else 'fine'}") for i in range(80)]
    marks = [(i, 1, int(i % 4 == 0)) for i, _ in rows]  # the copy of each toxic text is labelled clean
    scores = []
    for order in (rows, rows[::-1]):
        chain = toxicity.fit(docs_of(order), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
        scores.append({r.doc_id: r.score for r in toxicity.score(docs_of(rows), chain).collect()})
    assert scores[0] == scores[1]
    assert all((scores[0][i] >= toxicity.THRESHOLD) == (i % 4 < 2) for i in range(80))


def test_toxicity_without_labels(spark, docs_of, awkward):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs_of(awkward), toxicity.fit(docs_of(awkward), none)).collect()} == {0.0}
    assert toxicity.score(docs_of([]), toxicity.fit(docs_of([]), none)).count() == 0


def test_toxicity_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs, chain).join(labels.where(toxicity.held_out()), "doc_id").select("score", "toxic").collect()
    toxic = [r.score >= 0.3 for r in rows if r.toxic]
    clean = [r.score >= 0.3 for r in rows if not r.toxic]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)
