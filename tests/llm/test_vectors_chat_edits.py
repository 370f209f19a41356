"""Neighbours, chat formatting and edit-aware counts."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from cellwise.llm import ann, chat, common, counting, tokens
from cellwise.llm.queries import vocabulary_path
from pyspark.sql import functions as F


def neighbours(rows, k, queries):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = list({i: v for i, v in ok}.items())
    out = {}
    for i, v in ok:
        if i % queries == 0:
            ranked = sorted(((-float(v @ w), j) for j, w in ok if j != i))[:k]
            out[i] = [(j, -s) for s, j in ranked]
    return out


def test_neighbours_with_the_whole_index_opened(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0, 2.0, 0.5, -1.0]) for i in range(120)]  # one large group of copies
    rows += [(600, None), (601, [0.0] * 4), (602, [1.0, None, 1.0, 1.0]), (603, [float("nan"), 1.0, 1.0, 1.0]), (604, [float("inf"), 1.0, 1.0, 1.0]), (605, [1.0, 2.0]), (None, [1.0] * 4), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id bigint, embedding array<double>, rank int, cell string")
    got = {}
    for r in ann.search(table, F.col("id") % 20 == 0, k=5, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = neighbours(rows, 5, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_neighbours_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], schema)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(few, F.col("id") % 20 == 0).collect()) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(3)
    index = ann.MultiIndex(rng.normal(size=(9, 3)), rng.normal(size=(7, 3)))
    index.sizes[:] = rng.integers(0, 5, 63)
    index.listed = index.sizes.tolist()
    q = rng.normal(size=6)
    cost = (-(index.left @ q[:3])[:, None] - (index.right @ q[3:])[None, :]).ravel()
    order = np.argsort(cost)
    for enough in (1, 10, 40, 1000):
        cells = order[: int(np.searchsorted(np.cumsum(index.sizes[order]), enough)) + 1]
        ranks = np.argsort(np.argsort(-(index.right @ q[3:])))
        opened = index.walk(q, enough)
        assert sorted(cells.tolist()) == sorted(i * 7 + j for i, d in opened.items() for j in range(7) if ranks[j] < d)


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in ann.search(table, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = all_ = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit += len(got[ids[i]] & set(best.tolist()))
        all_ += 20
    assert hit / all_ >= 0.9


# --- chat


def turns_of(spark, talks):
    rows = [(c, t, role, text, 1, "y") for c, talk in talks for t, (role, text) in enumerate(talk)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place int, range string")


def test_chat(spark, monkeypatch):
    rng = random.Random(6)
    long = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(40)]
    talks = [(1, long[:3]), (2, long[:5]), (3, long), (4, long), (5, long[1:]), (6, [("user", "turn 0")]), (7, [("user", None)]), (8, [("user", "")]), (9, [("user", "<|im_end|> x")])]
    talks += [(20 + i, [("user", rng.choice("ab")), ("assistant", rng.choice("ab")), ("user", rng.choice("ab"))][: rng.randint(1, 3)]) for i in range(40)]
    frame = turns_of(spark, talks)
    con = duckdb.connect()
    con.register("conversations", frame.toPandas())
    want = sorted((r[0], r[2], r[3], r[4]) for r in con.execute(chat.CHECK_SQL).fetchall())
    for size in (512, 4):  # 4: conversations span several ranges
        monkeypatch.setattr(chat, "RANGE", size)
        got = chat.chat_format(frame)
        assert sorted((r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in got.collect()) == want
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    monkeypatch.setattr(chat, "PART", 16)
    parts = [r for r in chat.chat_format(frame).orderBy("part").collect() if r.conv_id == 3]
    assert len(parts) == 3 and "".join(r.rendered for r in parts) == next(w[3] for w in want if w[0] == 3)


def test_chat_edges(spark):
    frame = turns_of(spark, [])
    assert chat.chat_format(frame).count() == 0
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, None, "user", "b"), (1, 0, None, None), (1, 0, None, None)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.chat_format(rows).collect()}
    assert got == {None: (2, "<|im_start|>user\nb<|im_end|>\n<|im_start|>user\na<|im_end|>\n"), 1: (2, "<|im_start|>\n<|im_end|>\n" * 2)}


# --- edits


def test_counts_follow_edits():
    vocabulary = tokens.load(vocabulary_path())
    vocabulary.tokenizer.encode_special_tokens = True
    count = lambda w: len(vocabulary.encode_word(w.encode()))
    rng = random.Random(5)
    pool = ["a", "b", "the", " ", " ", "'s", "'", "\n", "  ", "1", "!", "é", "中", "n't", " the", "\t"]
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 20, 300, 1500])))
        data, at = common.utf8(pa.array([text]))
        offsets, _ = tokens.split_words(data, at)
        heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        tree = counting.Tree(np.diff(heads[offsets]), np.array([count(data.tobytes()[a:b].decode()) for a, b in zip(offsets, offsets[1:], strict=False)], int))
        for _ in range(4):
            insert = "".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 4, 30, 700])))
            text, _ = counting.apply_edit(text, tree, rng.randint(-1, len(text) + 2), rng.choice([0, 1, 5, 40]), insert, count)
            assert (tree.tokens[1], tree.chars[1]) == (len(vocabulary.encode_text(text)), len(text))
    vocabulary.tokenizer.encode_special_tokens = False


def test_count_edits(docs_of, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    docs = docs_of(awkward)
    edits = counting.revision()
    known = {(r.doc_id, r.text): r.e for r in docs.select("doc_id", "text", edits.alias("e")).collect()}
    want = []
    for i, t in awkward:
        text = t or ""
        before = len(tokenizer.encode(text, add_special_tokens=False).ids)
        for at, remove, insert in known[i, t]:
            at = max(0, min(at, len(text)))
            text = text[:at] + insert + text[at + remove :]
        want.append((i or -1, before, len(tokenizer.encode(text, add_special_tokens=False).ids), 3, len(text)))
    rows = counting.count_edits(docs, edits, vocabulary_path()).collect()
    assert sorted((r.doc_id or -1, r.n_before, r.n_after, r.n_edits, r.n_chars) for r in rows) == sorted(want)
    assert all(r.n_encoded < 1000 for r in rows if r.doc_id == 7)
    none = counting.count_edits(docs, F.lit(None), vocabulary_path()).collect()
    assert all(r.n_edits == 0 and r.n_before == r.n_after for r in none)
    assert counting.count_edits(docs_of([]), edits, vocabulary_path()).count() == 0
