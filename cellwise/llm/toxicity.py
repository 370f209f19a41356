"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

1. Over a bounded sample of labelled documents, Spark counts in how many toxic and clean texts each
   word form occurs: the lower-cased word, and its first four to eight bytes. Forms that lean to toxic
   texts, at most ``LEXICON`` of them, become the lexicon; a token's observation is the strength class
   of its strongest form, or none.
2. Tokens of toxic texts with such a form are labelled toxic, all others clean. A two-state chain with
   one weight per class and state and per transition is fitted to windows of these labelled tokens by
   gradient ascent on the conditional likelihood.
3. Every whole text is tagged with forward-backward marginals. Runs of tokens without a form multiply
   the same matrix, so a run costs one matrix power however long it is. A document's score is its
   largest marginal, which does not drift upwards with the length of a text.

Edge cases: a null text counts as empty and scores the chain's rate for plain text; labels that are
null, or given for unknown documents, are not used; if a document has several labels the largest counts;
without any toxic or clean label every score is the share of toxic labels (0 without labels); repeated
rows score alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import lowered, signed, slices, small_batches, utf8, word_hashes, word_spans
from cellwise.session import materialize

SAMPLE = 24_000  # labelled documents the model is fitted on, at most
LEXICON = 4_096  # word forms, at most
WINDOWS = 6_000  # token windows for the chain, at most
WINDOW = 48
CLASSES = 6  # 0: no form
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}"]] = True


def _forms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word's forms (words x forms), the words' spans and first words of texts; bytes are lower-cased."""
    data = lowered(data)
    starts, ends, first = word_spans(data, at)
    low, high = starts.copy(), ends.copy()
    for _ in range(3):  # signs around a word
        low += (high - low > 1) & _EDGE[data[np.minimum(low, len(data) - 1)]] if len(low) else 0
        high -= (high - low > 1) & _EDGE[data[high - 1]] if len(low) else 0
    columns = [word_hashes(data, low, high)]
    for k in PREFIXES:
        longer = high - low > k
        part = word_hashes(data, low, np.minimum(low + k, high)) ^ np.uint64(k)
        columns.append(np.where(longer, part, columns[0]))
    return np.stack(columns, 1) if len(low) else np.zeros((0, 1 + len(PREFIXES)), np.uint64), starts, ends, first, data


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            forms, _, _, first, _ = _forms(*utf8(part.column("text")))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(toxic)), np.diff(first) * forms.shape[1])
            pairs = np.unique(np.rec.fromarrays([forms.ravel(), owner], names="form,doc"))
            names, where = np.unique(pairs["form"], return_inverse=True)
            label = toxic[pairs["doc"].astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [signed(names), pa.array(np.bincount(where, label, len(names)).astype(np.int64)), pa.array(np.bincount(where, 1 - label, len(names)).astype(np.int64))],
                names=["form", "n_toxic", "n_clean"],
            )


def _classes(forms: np.ndarray, names: np.ndarray, strengths: np.ndarray) -> np.ndarray:
    """Strength class of each token."""
    if not len(names) or not len(forms):
        return np.zeros(len(forms), np.int8)
    spot = np.minimum(np.searchsorted(names, forms), len(names) - 1)
    return np.where(names[spot] == forms, strengths[spot], 0).max(axis=1).astype(np.int8)


def _windows(batches: Iterator[pa.RecordBatch], names: np.ndarray, strengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One window of token classes per document, around its first form if it has one."""
    for batch in batches:
        for part in slices(batch, "text"):
            forms, _, _, first, _ = _forms(*utf8(part.column("text")))
            kinds = _classes(forms, names, strengths)
            rows = []
            for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                hit = np.flatnonzero(kinds[low:high])
                begin = max(0, min((int(hit[0]) if len(hit) else 0) - WINDOW // 4, high - low - WINDOW))
                rows.append(kinds[low + begin : min(high, low + begin + WINDOW)].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("order"), pa.array(rows, pa.binary())], names=["toxic", "order", "kinds"])


def fit_chain(kinds: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 150, rate: float = 1.0, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of (class, state) and (state, next state) that maximise the conditional likelihood of the labels."""
    n, width = kinds.shape
    emit, move = np.zeros((CLASSES, 2)), np.zeros((2, 2))
    inside = np.arange(width)[None, :] < lengths[:, None]
    observed_e, observed_m = np.zeros_like(emit), np.zeros_like(move)
    np.add.at(observed_e, (kinds[inside], labels[inside]), 1)
    both = inside[:, 1:]
    np.add.at(observed_m, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    total = inside.sum()
    speed_e, speed_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(rounds):
        e, t = np.exp(emit)[kinds], np.exp(move)
        e[~inside] = 1.0
        ahead, back = np.empty((n, width, 2)), np.ones((n, width, 2))
        ahead[:, 0] = e[:, 0]
        for i in range(1, width):
            ahead[:, i] = np.where(inside[:, i, None], (ahead[:, i - 1] @ t) * e[:, i], ahead[:, i - 1])
            ahead[:, i] /= ahead[:, i].sum(1, keepdims=True)
        for i in range(width - 2, -1, -1):
            back[:, i] = np.where(inside[:, i + 1, None], (e[:, i + 1] * back[:, i + 1]) @ t.T, back[:, i + 1])
            back[:, i] /= back[:, i].sum(1, keepdims=True)
        p = ahead * back
        p /= p.sum(2, keepdims=True)
        expected_e, expected_m = np.zeros_like(emit), np.zeros_like(move)
        for state in (0, 1):
            expected_e[:, state] = np.bincount(kinds[inside], p[..., state][inside], CLASSES)
        pair = ahead[:, :-1, :, None] * t * (e[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        expected_m = pair[both].sum(0)
        step_e = (observed_e - expected_e) / total - ridge * emit / CLASSES
        step_m = (observed_m - expected_m) / total - ridge * move / CLASSES
        speed_e += step_e**2
        speed_m += step_m**2
        emit += rate * step_e / np.sqrt(speed_e)
        move += rate * step_m / np.sqrt(speed_m)
    return emit, move


class Chain:
    """A fitted model: lexicon (sorted form hashes with classes), weights, and the rate of a document without forms."""

    def __init__(self, names: np.ndarray, strengths: np.ndarray, emit: np.ndarray, move: np.ndarray, constant: float | None = None):
        self.names, self.strengths, self.constant = names, strengths, constant
        self.weight, self.step = np.exp(emit), np.exp(move)
        plain = self.step * self.weight[0][None, :]  # one plain token: leave a state, enter one, emit
        values, vectors = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        self.ratio = float((values[order[1]] / values[order[0]]).real)
        inverse = np.linalg.inv(vectors)
        self.main = np.real(np.outer(vectors[:, order[0]], inverse[order[0]]))
        self.other = np.real(np.outer(vectors[:, order[1]], inverse[order[1]]))
        rest = self.main / self.main.sum()
        self.plain_rate = float(rest[1, 1] / np.trace(rest))

    def _run(self, n: int) -> list[list[float]]:
        """A run of ``n`` plain tokens, up to a factor."""
        return (self.main + self.ratio**n * self.other).tolist() if n else [[1.0, 0.0], [0.0, 1.0]]

    def marginals(self, places: list[int], kinds: list[int], n: int) -> list[float]:
        """Probability of the toxic state at each token that has a form."""
        gaps = [b - a - 1 for a, b in zip([-1, *places], [*places, n], strict=True)]
        runs = [self._run(g) for g in gaps]
        step, weight = self.step.tolist(), self.weight.tolist()
        before = []
        f = None
        for i, kind in enumerate(kinds):
            w, r = weight[kind], runs[i]
            if f is None and not gaps[0]:
                f = [w[0], w[1]]
            else:
                if f is None:  # the first token is plain: a run of one less, after its own weight
                    r = self._run(gaps[0] - 1)
                    f = [weight[0][0], weight[0][1]]
                g = [f[0] * r[0][0] + f[1] * r[1][0], f[0] * r[0][1] + f[1] * r[1][1]]
                f = [(g[0] * step[0][0] + g[1] * step[1][0]) * w[0], (g[0] * step[0][1] + g[1] * step[1][1]) * w[1]]
            s = f[0] + f[1]
            f = [f[0] / s, f[1] / s]
            before.append(f)
        out = [0.0] * len(kinds)
        b = [runs[-1][0][0] + runs[-1][0][1], runs[-1][1][0] + runs[-1][1][1]]
        for i in range(len(kinds) - 1, -1, -1):
            f = before[i]
            clean, toxic = f[0] * b[0], f[1] * b[1]
            out[i] = toxic / (clean + toxic)
            w, r = weight[kinds[i]], runs[i]
            g = [step[0][0] * w[0] * b[0] + step[0][1] * w[1] * b[1], step[1][0] * w[0] * b[0] + step[1][1] * w[1] * b[1]]
            b = [r[0][0] * g[0] + r[0][1] * g[1], r[1][0] * g[0] + r[1][1] * g[1]]
            s = b[0] + b[1]
            b = [b[0] / s, b[1] / s]
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain fitted on at most ``sample`` labelled documents, chosen by a hash of their ids.

    Equal texts count once, as toxic if any of them is labelled so.
    """
    small_batches(docs.sparkSession)
    known = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").alias("label_id_")).agg(F.max("toxic").alias("label_"))
    picked = known.orderBy(F.xxhash64("label_id_"), "label_id_").limit(sample)
    # at most `sample` ids, so the broadcast is bounded
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id_") == F.col("label_id_"))
    rows = rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("label_").cast("bigint").alias("toxic"))
    rows = materialize(rows.withColumn("order", F.xxhash64("text")))
    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_clean = totals[0] or 0, totals[1] - (totals[0] or 0)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int8)
    if not n_toxic or not n_clean:
        return Chain(*nothing, np.array([[0.0, -5.0]] * CLASSES), np.zeros((2, 2)), n_toxic / max(1, totals[1]))
    counts = rows.mapInArrow(_count_forms, "form bigint, n_toxic bigint, n_clean bigint").groupBy("form").agg(F.sum("n_toxic").alias("a"), F.sum("n_clean").alias("c"))
    lean = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1)) - 2 / F.sqrt("a")
    best = counts.where("a >= 5").withColumn("lean", lean).where("lean >= 2").orderBy(F.desc("lean"), "form").limit(LEXICON).collect()
    best.sort(key=lambda r: np.int64(r["form"]).view(np.uint64))
    names = np.array([r["form"] for r in best], np.int64).view(np.uint64)
    strengths = np.array([min(CLASSES - 1, int(r["lean"]) - 1) for r in best], np.int8)
    # texts shrink to their windows before they are put in order
    cut = materialize(rows.mapInArrow(lambda it: _windows(it, names, strengths), "toxic bigint, order bigint, kinds binary"))
    most = cut.orderBy(F.desc("toxic"), "order").limit(WINDOWS // 3)
    taken = most.union(cut.where("toxic = 0").orderBy("order").limit(WINDOWS - WINDOWS // 3)).collect()
    taken = [r for r in taken if r["kinds"]]
    kinds, marks = np.zeros((len(taken), WINDOW), np.int64), np.zeros((len(taken), WINDOW), np.int64)
    lengths = np.array([len(r["kinds"]) for r in taken])
    for i, r in enumerate(taken):
        kinds[i, : lengths[i]] = np.frombuffer(r["kinds"], np.int8)
        marks[i] = (kinds[i] > 0) * r["toxic"]
    emit, move = fit_chain(kinds, marks, lengths)
    return Chain(names, strengths, emit, move)


def _tag(part: pa.RecordBatch, chain: Chain, text: int) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and offending words of each text in column ``text`` of a slice."""
    data, at = utf8(part.column(text))
    base = chain.plain_rate if chain.constant is None else chain.constant
    scores, spans = np.full(len(at) - 1, base), [[] for _ in range(len(at) - 1)]
    if chain.constant is not None:
        return np.clip(scores, 0.0, 1.0), spans
    forms, starts, ends, first, _ = _forms(data, at)
    kinds = _classes(forms, chain.names, chain.strengths)
    hits = np.flatnonzero(kinds)
    owner = np.searchsorted(first, hits, "right") - 1
    for i in np.unique(owner).tolist():
        mine = hits[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
        p = chain.marginals((mine - first[i]).tolist(), kinds[mine].tolist(), int(first[i + 1] - first[i]))
        scores[i] = max(base, *p)
        spans[i] = [{"start": int(starts[m] - at[i]), "length": int(ends[m] - starts[m])} for m, x in zip(mine.tolist(), p, strict=True) if x > 0.5]
    return np.clip(scores, 0.0, 1.0), spans


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``spans``: words (array of start and length in bytes) whose marginal is over one half."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                scores, spans = _tag(part, chain, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, score double, spans array<struct<start: bigint, length: bigint>>")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def clean(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged; they pass through without a join."""
    small_batches(docs.sparkSession)
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(_tag(part, chain, text)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
