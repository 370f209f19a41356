"""N-gram language model as a weighted backoff automaton, and document scores by one traversal.

States are histories; the empty history is the state all failures end in. A seen n-gram is an arc with
its smoothed probability; any other word first takes the failure arc, weighted ``mu / (c + mu)`` for a
history seen ``c`` times, to the shorter history. Probabilities interpolate with the shorter history by
a Dirichlet prior: ``(c(h, w) + mu * p(w | shorter h)) / (c(h) + mu)``; the base is add-one-half over
the known words and one unknown. They sum to one in every state. Of the given prior weights that one is
used whose leave-one-out likelihood of the training texts is largest.

1. Tasks gather chunks of documents: distinct words once (as hashes), documents as word numbers. They
   are written as a table bucketed by chunk; texts are not read again.
2. Each order asks, per chunk and bucket of hashes, for the counts of the chunk's distinct n-grams and
   brings its own training counts along. Buckets add them up over the whole corpus and reply.
3. Replies join their chunk. Its seen histories become states with failure arcs, its seen n-grams arcs:
   the part of the automaton that its documents can reach. Each document is read from left to right; it
   carries its state, follows failure arcs where the state has no arc for the word, and adds up log weights.

N-grams are told apart by 64-bit hashes. A frequent n-gram is one entry per chunk.

Edge cases: a null text counts as empty (one end token); every input row gives one row, repeated or
null ids included (a null id counts as training); an empty training set leaves the uniform base over
one unknown word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.bpe import _pack, _unpack
from cellwise.llm.common import bucket_bits, bucketed, lowered, mix, slices, small_batches, utf8, word_hashes, word_spans
from cellwise.session import materialize

ORDER = 2
CHUNK_WORDS = 1 << 20
LANE_WORDS = 1024  # words of a text that are read one after another
PRIORS = (0.5, 2.0, 8.0, 32.0, 128.0, 1024.0, 1e9)  # the last one is the base alone
END = np.uint64(0x5851F42D4C957F2D)  # an end token, unlike any word
START = np.uint64(0x14057B7EF767814F)  # the history at the start of a text


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learnt from: crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    held: list[tuple] = []
    size = 0

    def closed() -> pa.RecordBatch:
        nonlocal held, size, number
        names, numbers = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        ids = pa.concat_arrays([h[0] for h in held])
        docs = _pack(
            ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
            ids.is_null().to_numpy(zero_copy_only=False).astype("u1"),
            np.concatenate([h[1] for h in held]).astype("u1"),
            np.concatenate([h[3] for h in held]).astype("<i4"),
            numbers.astype("<i4"),
        )
        out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([docs], pa.binary()), pa.array([names.tobytes()], pa.binary())], names=["chunk", "docs", "names"])
        held, size, number = [], 0, number + 1
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            data, at = utf8(part.column("text"))
            data = lowered(data)
            starts, ends, first = word_spans(data, at)
            hashes = word_hashes(data, starts, ends)
            tokens = np.insert(hashes, first[1:], END)  # one end per text
            held.append((part.column("doc_id"), part.column("held_out").to_numpy(zero_copy_only=False), tokens, np.diff(first) + 1))
            size += len(tokens)
            if size >= CHUNK_WORDS:
                yield closed()
    if held:
        yield closed()


def _grams(names: np.ndarray, counts: np.ndarray, numbers: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` tokens that end at each token; a text's first tokens follow starts."""
    hashes = names[numbers]
    first = np.cumsum(counts) - counts
    grams = hashes.copy()
    for back in range(1, order):
        earlier = np.full(len(hashes), START, np.uint64)
        earlier[back:] = hashes[:-back] if back < len(hashes) else earlier[back:]
        depth = np.arange(len(hashes)) - np.repeat(first, counts)
        earlier[depth < back] = START
        grams = mix(grams * np.uint64(0x9FB21C651E98DF25) + mix(earlier + np.uint64(back)))
    return grams


def _histories(grams: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Hash of the history before each token, given the hashes of n-grams of that length; ``order`` - 1 starts have their own."""
    before = np.empty_like(grams)
    before[1:] = grams[:-1]
    before[np.cumsum(counts) - counts] = mix(np.array([START + np.uint64(order)], np.uint64))[0]
    return before


def _requests(chunk: tuple, orders: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: the chunk's distinct n-grams and their counts in training texts; histories come as order -n."""
    counts, numbers, held, names = chunk
    learnt = np.repeat(held == 0, counts)
    for order in range(1, orders + 1):
        grams = _grams(names, counts, numbers, order)
        keys, where = np.unique(grams, return_inverse=True)
        yield order, keys, np.bincount(where[learnt], minlength=len(keys)).astype(np.int64)
        if order < orders:
            keys, where = np.unique(_histories(grams, counts, order), return_inverse=True)
            yield -order, keys, np.bincount(where[learnt], minlength=len(keys)).astype(np.int64)


def _open(docs: bytes, names: bytes) -> tuple[np.ndarray, np.ndarray, tuple]:
    ids, absent, held, counts, numbers = _unpack(docs, "<i8", "u1", "u1", "<i4", "<i4")
    return ids, absent, (counts.astype(np.int64), numbers, held, np.frombuffer(names, np.uint64))


def _ask(batches: Iterator[pa.RecordBatch], orders: int, bits: int) -> Iterator[pa.RecordBatch]:
    buckets = 1 << bits
    for batch in batches:
        for chunk, docs, names in zip(batch.column("chunk").to_pylist(), batch.column("docs"), batch.column("names"), strict=True):
            _, _, opened = _open(docs.as_py(), names.as_py())
            for order, keys, counts in _requests(opened, orders):
                # keys are sorted: a bucket is a range of their high bits
                edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(buckets + 1))
                blocks = [_pack(keys[a:b], counts[a:b].astype("<u4")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * buckets, pa.int64()), pa.array([order] * buckets, pa.int32()), pa.array(range(buckets), pa.int32()), pa.array(blocks, pa.binary())],
                    names=["chunk", "order", "bucket", "block"],
                )


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals over all chunks of one (order, bucket) after another; rows arrive sorted by these."""
    now, rows = None, []

    def reply() -> pa.RecordBatch:
        keys = [_unpack(b, "<u8", "<u4") for _, b in rows]
        every, where = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        totals = np.bincount(where, np.concatenate([c for _, c in keys]), len(every)).astype("<u8")  # a corpus may hold a token more than 2**32 times
        out, low = [], 0
        for k, _ in keys:
            out.append(_pack(totals[where[low : low + len(k)]]))
            low += len(k)
        n = len(rows)
        seen = np.r_[np.int64(totals.sum()), np.int64((totals > 0).sum())]
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in rows], pa.int64()), pa.array([now[0]] * n, pa.int32()), pa.array([now[1]] * n, pa.int32()), pa.array(out, pa.binary())]
            + [pa.array([int(x)] + [0] * (n - 1), pa.int64()) for x in seen],
            names=["chunk", "order", "bucket", "reply", "total", "kinds"],
        )

    for batch in batches:
        for chunk, order, bucket, block in zip(*(batch.column(c).to_pylist() for c in ("chunk", "order", "bucket", "block")), strict=True):
            if now != (order, bucket) and rows:
                yield reply()
                rows = []
            now = (order, bucket)
            rows.append((chunk, block))
    if rows:
        yield reply()


class Automaton(NamedTuple):
    """States are numbered from the empty history (0); arcs are sorted by ``state * words + word``, those of state 0 first."""

    words: int
    start: int  # the state before a text's first token
    failure: np.ndarray  # per state, the longest shorter history
    back: np.ndarray  # log weight of the failure arc, per state and prior
    arcs: np.ndarray
    weight: np.ndarray  # log probability, per arc and prior
    target: np.ndarray  # per arc, the state it leads to


def _automaton(chunk: tuple, answers: dict[int, np.ndarray], orders: int, size: float, priors: tuple[float, ...]) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The automaton of a chunk's seen n-grams; per token the training count of its word, per text and prior the leave-one-out likelihood."""
    counts, numbers, held, names = chunk
    mu, width = np.array(priors), len(names)
    own = np.repeat(held == 0, counts).astype(np.float64)  # a training token counts itself
    first = np.cumsum(counts) - counts
    seen = answers[1]  # per word: keys of the first order are the words in their order
    token_counts = seen[numbers]
    state = np.zeros(len(numbers), np.int64)  # before each token, the longest history that is a state
    failure, back = [np.zeros(1, np.int64)], [np.zeros((1, len(mu)))]
    arcs, prob = [np.arange(width)], [np.repeat((seen[:, None] + 0.5) / size, len(mu), 1)]
    target: list[np.ndarray] = []
    grams, keys, lower = names[numbers], names, numbers  # n-grams at tokens, distinct ones, and their place among these
    kept = np.arange(width)  # n-grams of the order below that are arcs, by their place among the keys
    likely = np.repeat((np.maximum(token_counts - own + 0.5, 0.5) / size)[None, :], len(mu), 0)
    states = 1
    for order in range(2, orders + 1):
        histories, spot, where = np.unique(_histories(grams, counts, order - 1), return_index=True, return_inverse=True)
        times = answers[1 - order]
        known = times > 0
        number = np.where(known, states + np.cumsum(known) - 1, 0)
        states += int(known.sum())
        failure.append(state[spot[known]])
        back.append(np.log10(mu / (times[known, None] + mu)))
        # an arc of the order below leads to the history that ends with its word
        at = np.minimum(np.searchsorted(histories, keys[kept]), len(histories) - 1)
        target.append(np.where(histories[at] == keys[kept], number[at], 0))
        state = np.where(known[where], number[where], state)
        grams = _grams(names, counts, numbers, order)
        keys, spot, here = np.unique(grams, return_index=True, return_inverse=True)
        seen = answers[order]
        place = np.zeros(max(int(lower.max()) + 1, 1), np.int64)
        place[kept] = np.arange(len(kept))
        kept = np.flatnonzero(seen > 0)
        spot = spot[kept]
        below = place[lower[spot]]
        arcs.append(state[spot] * width + numbers[spot])
        prob.append((seen[kept, None] + mu * prob[-1][below]) / (times[where[spot], None] + mu))
        rest, history = np.maximum(seen[here] - own, 0), np.maximum(times[where] - own, 0)
        for k, m in enumerate(priors):
            likely[k] = (rest + m * likely[k]) / (history + m)
        lower = here
        if order == orders:
            target.append(target[-1][below])
    if orders == 1:
        target.append(np.zeros(width, np.int64))
    alone = np.stack([np.add.reduceat(np.log10(row) * own, first) for row in likely], 1)
    every = np.concatenate(arcs)
    sort = np.argsort(every)
    weight = np.concatenate(prob)[sort]
    np.log10(weight, out=weight)
    automaton = Automaton(width, int(state[0]), np.concatenate(failure), np.concatenate(back), every[sort], weight, np.concatenate(target)[sort])
    return automaton, token_counts, alone


def _walk(automaton: Automaton, numbers: np.ndarray, counts: np.ndarray, orders: int) -> np.ndarray:
    """Log probability of each text, per prior: read from left to right, many texts abreast, each with its state.

    A state depends on the last ``orders`` - 1 words alone, so the parts of a long text go abreast too: each first
    reads so many words before it, from the empty history.
    """
    first = np.cumsum(counts) - counts
    parts = -(-counts // LANE_WORDS)
    text = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    lead = np.where(nth > 0, orders - 1, 0)
    begin = first[text] + nth * LANE_WORDS - lead
    length = np.minimum(counts[text] - nth * LANE_WORDS, LANE_WORDS) + lead
    order = np.argsort(-length, kind="stable")
    begin, length, lead = begin[order], length[order], lead[order]
    state = np.where(nth[order] > 0, 0, automaton.start)
    score = np.zeros((len(order), automaton.weight.shape[1]))
    for step in range(int(length[0])):
        n = int(np.searchsorted(-length, -step, "left"))  # parts with a word at this step
        word, now = numbers[begin[:n] + step], state[:n]
        arc = word.astype(np.int64)
        gain = np.zeros((n, score.shape[1]))
        open_ = np.flatnonzero(now)
        while len(open_):
            wanted = now[open_] * automaton.words + word[open_]
            at = np.minimum(np.searchsorted(automaton.arcs, wanted), len(automaton.arcs) - 1)
            found = automaton.arcs[at] == wanted
            arc[open_[found]] = at[found]
            open_ = open_[~found]
            gain[open_] += automaton.back[now[open_]]  # the failure arc
            now[open_] = automaton.failure[now[open_]]
            open_ = open_[now[open_] > 0]
        gain += automaton.weight[arc]
        state[:n] = automaton.target[arc]
        if step < orders - 1:
            gain[lead[:n] > step] = 0
        score[:n] += gain
    back = np.empty_like(score)
    back[order] = score
    return np.add.reduceat(back, np.cumsum(parts) - parts, axis=0)


def _traverse(batches: Iterator[pa.RecordBatch], orders: int, total: int, kinds: int, priors: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    size = total + 0.5 * (kinds + 1)
    several = pa.list_(pa.float64())
    for batch in batches:
        for docs, names, replies in zip(batch.column("docs"), batch.column("names"), batch.column("replies"), strict=True):
            ids, absent, opened = _open(docs.as_py(), names.as_py())
            counts, numbers, held, _ = opened
            blocks: dict[int, list] = {}
            for r in sorted(replies.as_py(), key=lambda r: (r["order"], r["bucket"])):
                blocks.setdefault(r["order"], []).append(_unpack(r["reply"], "<u8")[0])
            answers = {order: np.concatenate(parts).astype(np.float64) for order, parts in blocks.items()}
            automaton, seen, alone = _automaton(opened, answers, orders, size, priors)
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=absent.astype(bool)),
                    pa.array(held.astype(bool)),
                    pa.array(counts),
                    pa.array(np.add.reduceat((seen > 0).astype(np.int64), first)),
                    pa.array(np.add.reduceat(np.log10((seen + 0.5) / size), first)),
                    pa.array(_walk(automaton, numbers, counts, orders).tolist(), several),
                    pa.array(alone.tolist(), several),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "scores", "alone"],
            )


def score(docs: DataFrame, held: Column, order: int = ORDER, priors: tuple[float, ...] = PRIORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10), ``prior``."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    chunks = bucketed(picked.mapInArrow(_chunks, "chunk bigint, docs binary, names binary"), "chunk", spread=False)
    bits = bucket_bits(chunks.count())  # more chunks, more buckets: what one bucket adds up stays about as large
    asked = chunks.mapInArrow(lambda it: _ask(it, order, bits), "chunk bigint, order int, bucket int, block binary")
    spread = asked.repartition("order", "bucket").sortWithinPartitions("order", "bucket", "chunk")
    replies = materialize(spread.mapInArrow(_add_up, "chunk bigint, order int, bucket int, reply binary, total bigint, kinds bigint"))
    sums = replies.where(F.col("order") == 1).agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = sums[0] or 0, sums[1] or 0
    gathered = replies.groupBy("chunk").agg(F.collect_list(F.struct("order", "bucket", "reply")).alias("replies"))  # orders x buckets rows a chunk
    ready = chunks.join(gathered, "chunk").select("docs", "names", "replies")
    scored = ready.mapInArrow(
        lambda it: _traverse(it, order, total, kinds, priors),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, scores array<double>, alone array<double>",
    )
    scored = materialize(scored)
    likely = scored.agg(*[F.sum(F.col("alone")[i]) for i in range(len(priors))]).first()
    best = max(range(len(priors)), key=lambda i: (likely[i] if likely[i] is not None else -np.inf, -i))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"), F.lit(priors[best]).alias("prior")
    )
