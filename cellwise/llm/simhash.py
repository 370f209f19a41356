"""SimHash near-duplicates: pigeonhole blocks over fingerprints, then connected components.

A fingerprint is the bitwise majority of the XXH64 values of a document's word shingles. Equal
fingerprints collapse first. If two fingerprints differ in at most ``d`` of 64 bits that are cut into
``m > d`` blocks, at least ``m - d`` blocks agree; so every choice of ``m - d`` blocks is a key, and
close pairs meet under one key at least. The number of blocks follows the number of distinct
fingerprints (longer keys for more of them) and never changes the result. Inside a key's run the
tasks compare members with numpy and emit a spanning forest of the links, never all pairs; runs above
``RUN_LIMIT`` are dealt out as pairs of tiles. Components come from hooking and contraction over joins.

``keep_representatives`` keeps one row of each component. ``keep_one`` does so for another notion of likeness, the similarity
of shingle sets; it takes Hamming distances over 128 bits for candidates only. They meet under keys of shingle minima,
because 34 of 128 bits leave no block choice that is selective. The components of the candidates bound where links
can be; inside them the five-word shingle sets are compared, and only pairs of Jaccard 0.8 or more are linked.

Edge cases: a null text counts as empty; a text without words has fingerprint zero and is linked like
any other; rows are never dropped; repeated rows and equal ids share a fingerprint and a component;
a component without any non-null id has a null ``component_id``; an empty table gives no rows; other
columns are ignored by the operator, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import binaries, lowered, mix, packed_words, signed, slices, small_batches, utf8, word_spans
from cellwise.session import materialize

SEED = 42
RUN_LIMIT = 8192
SET_LIMIT = 2048  # documents whose shingle sets meet in one task
BITS = 64
BANDS, MINIMA = 30, 6  # a pair of Jaccard 0.8 shares one of the keys with probability 0.9999
SIMILARITY = (4, 5)
_FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, (2, BANDS * MINIMA), dtype=np.uint64) | np.uint64(1)


def _shingle_hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice and, per document, the index of its first shingle."""
    data = lowered(data)
    starts, ends, first = word_spans(data, at)
    lengths = ends - starts
    words = packed_words(data, starts, ends)
    _, offsets, flat = words.buffers()
    raw = np.frombuffer(flat, np.uint8) if flat is not None and flat.size else np.zeros(0, np.uint8)
    # one space after each word: a shingle is then one byte range
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=begin[1:])
    joined = np.full(int(begin[-1]), 0x20, np.uint8)
    joined[np.arange(len(raw)) + np.repeat(np.arange(len(starts)), lengths)] = raw
    text = joined.tobytes()
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    index = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(shingles, out=index[1:])
    low = np.repeat(first[:-1] - index[:-1], shingles) + np.arange(int(index[-1]))
    high = np.minimum(low + size, np.repeat(first[1:], shingles))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(text[a:b], SEED) for a, b in zip(begin[low].tolist(), (begin[high] - 1).tolist(), strict=True)]
    return np.array(hashes, np.uint64), index


def _majority(hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Per document, the bits set in over half of its hashes."""
    out = np.zeros(len(index) - 1, np.uint64)
    counts = np.diff(index)
    if not len(hashes):
        return out
    some = np.flatnonzero(counts)
    step = 1 << 16
    totals = np.zeros((len(counts), BITS), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for low in range(0, len(hashes), step):
        part = hashes[low : low + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[low : low + step]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        totals[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    bits = (2 * totals[some] > counts[some, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _bands(hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Per document with shingles, ``BANDS`` keys of ``MINIMA`` minima each."""
    heads = index[:-1][np.diff(index) > 0]
    out = np.zeros((len(heads), BANDS), np.uint64)
    if len(heads):
        for i in range(BANDS * MINIMA):
            least = np.minimum.reduceat(hashes * _FACTORS[0, i] + _FACTORS[1, i], heads)
            out[:, i // MINIMA] = mix(out[:, i // MINIMA] ^ least ^ np.uint64(i + 1))
    return out


def _shingle_sets(hashes: np.ndarray, index: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per document, its different hashes in order and a hash of all of them."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(index[:-1].tolist(), index[1:].tolist(), strict=True)]
    return sets, np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)


def _fingerprinted(picked: DataFrame, size: int) -> DataFrame:
    """The columns of ``picked`` with ``fp`` (64 bits as BIGINT) in place of ``text``."""
    small_batches(picked.sparkSession)
    others = [c for c in picked.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes, index = _shingle_hashes(*utf8(part.column("text")), size)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], signed(_majority(hashes, index))], names=[*others, "fp"])

    return picked.mapInArrow(run, T.StructType([picked.schema[c] for c in others]).add("fp", "long"))


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits as BIGINT), one row per input row."""
    return _fingerprinted(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), size)


def _marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``mark`` (a digest of the text, null for a null) and ``text``."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.md5(docs[text_col]).alias("mark"), docs[text_col].alias("text"))


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id``, ``mark`` of the text, ``digest`` of the shingle set, 128 fingerprint bits (``fp``, ``more``) and ``bands``, one row per input row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes, index = _shingle_hashes(*utf8(part.column("text")), size)
                keys = np.r_[0, np.cumsum((np.diff(index) > 0) * BANDS)].astype(np.int32)
                columns = [
                    part.column("doc_id"),
                    part.column("mark"),
                    signed(_shingle_sets(hashes, index)[1]),
                    signed(_majority(hashes, index)),
                    signed(_majority(mix(hashes + np.uint64(SEED)), index)),
                    pa.ListArray.from_arrays(pa.array(keys), signed(_bands(hashes, index).ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "digest", "fp", "more", "bands"])

    schema = "doc_id bigint, mark string, digest bigint, fp bigint, more bigint, bands array<bigint>"
    return _marked(docs).mapInArrow(run, schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``digest`` and ``shingles`` (sorted hashes of the set), one row per different set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets, digests = _shingle_sets(*_shingle_hashes(*utf8(part.column("text")), size))
                yield pa.RecordBatch.from_arrays([signed(digests), binaries([x.tobytes() for x in sets])], names=["digest", "shingles"])

    return docs.select("text").mapInArrow(run, "digest bigint, shingles binary").dropDuplicates(["digest"])


def block_plan(distinct: int, distance: int) -> tuple[int, int]:
    """Blocks and blocks per key: the fewest keys whose buckets stay near 256 members for evenly spread fingerprints."""
    for keep in range(1, BITS - distance):
        bits = keep * BITS / (distance + keep)
        if distinct / 2**bits <= 256 or comb(distance + keep + 1, keep + 1) > 400:
            return distance + keep, keep
    return BITS, BITS - distance


def _key_expressions(blocks: int, keep: int) -> list:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), keep)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint"))))
    return keys


def _forest(fp: np.ndarray, more: np.ndarray | None, distance: int, sets: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the links of one run: ``distance`` bits or fewer and, with ``sets``, a Jaccard of ``SIMILARITY`` or more."""
    n = len(fp)
    sizes = np.array([len(x) for x in sets]) if sets is not None else None

    def alike(a, b):
        """Which of the members ``b`` share enough shingles with ``a``."""
        part, whole = SIMILARITY
        near = whole * np.minimum(sizes[b], sizes[a]) >= part * np.maximum(sizes[b], sizes[a])
        if not sizes[a]:
            return near
        spots = np.flatnonzero(near)
        for low in range(0, len(spots), 256):
            some = b[spots[low : low + 256]]
            flat = np.concatenate([sets[x] for x in some])
            found = sets[a][np.minimum(np.searchsorted(sets[a], flat), sizes[a] - 1)] == flat
            common = np.add.reduceat(found, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
            near[spots[low : low + 256]] = whole * common >= part * (sizes[some] + sizes[a] - common)
        return near

    def close(a, b):
        d = np.bitwise_count(fp[a] ^ fp[b])
        if more is not None:
            d = d + np.bitwise_count(more[a] ^ more[b])
        ok = d <= distance
        if sets is not None and ok.any():
            ok[ok] = alike(a, b[ok])
        return ok

    if n <= 512 and sets is None:
        d = np.bitwise_count(fp[:, None] ^ fp[None, :])
        if more is not None:
            d = d + np.bitwise_count(more[:, None] ^ more[None, :])
        left, right = np.nonzero(np.triu(d <= distance, 1))
        if len(left) <= n:
            return left, right
    waiting, left, right = np.arange(n), [], []
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            node = queue.pop(0)
            hit = close(node, waiting)
            if hit.any():
                found = waiting[hit]
                waiting = waiting[~hit]
                left.append(np.full(len(found), node))
                right.append(found)
                queue.extend(found.tolist())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, distance: int, count: int | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints that span all links of ``distance`` bits or fewer."""
    blocks, keep = block_plan(distinct.count() if count is None else count, distance)
    members = distinct.select("fp", F.explode(F.array(*_key_expressions(blocks, keep))).alias("key"))
    return _linked(members, members, "fp", distance, RUN_LIMIT)


def _linked(members: DataFrame, keyed: DataFrame, node: str, distance: int, limit: int) -> DataFrame:
    """Pairs of nodes that span the links inside each key's run of ``members``; ``keyed`` has the same keys."""
    wide, full = "more" in members.columns, "shingles" in members.columns
    sizes = keyed.groupBy("key").count().where(f"count > {limit}").selectExpr("key", f"cast(ceil(2 * count / {limit}) as int) tiles")
    sizes = materialize(sizes)
    if sizes.isEmpty():
        placed = members.withColumn("pair", F.lit(0))
    else:
        # a large run is dealt out over pairs of tiles, each of bounded size
        known = members.join(sizes, "key", "left")
        tile = F.pmod(F.xxhash64(node), F.col("tiles"))
        spots = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(tile, t) * F.col("tiles") + F.greatest(tile, t))
        placed = known.select(*members.columns, F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(spots, lambda x: x.cast("bigint")))).alias("pair"))
    placed = placed.repartition("key", "pair").sortWithinPartitions("key", "pair", node)  # the same hubs under every key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solve(table: pa.Table) -> pa.RecordBatch:
            names = table.column(node).to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            more = table.column("more").to_numpy().view(np.uint64) if wide else None
            key, pair = table.column("key").to_numpy(), table.column("pair").to_numpy()
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            stops = np.r_[heads[1:], len(key)]
            out_a, out_b = [], []
            for low, high in zip(heads[stops - heads > 1].tolist(), stops[stops - heads > 1].tolist(), strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").slice(low, high - low).to_pylist()] if full else None
                a, b = _forest(fp[low:high], more[low:high] if wide else None, distance, sets)
                if len(a):
                    out_a.append(names[low:high][a])
                    out_b.append(names[low:high][b])
            a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
            b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            key, pair = table.column("key").to_numpy(), table.column("pair").to_numpy()
            same = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
            cut = int(same[-1]) + 1 if len(same) else 0
            if cut:
                yield solve(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield solve(rest)

    found = placed.mapInArrow(run, "a bigint, b bigint").where("a != b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node``, ``root``: the smallest node reachable over ``edges`` (``a``, ``b``); nodes without edges are absent.

    Each round hooks every node to its smallest neighbour if that is smaller, follows these hooks to their
    ends, and contracts the links to these ends, so dense groups shrink to nothing in a round or two. Hooks
    and links are written before they are joined, so a node that many share can be split.
    """
    links_ = materialize(edges.select("a", "b").where("a != b").distinct())
    labels = materialize(links_.select(F.col("a").alias("node")).union(links_.select("b")).distinct().withColumn("root", F.col("node")))
    for _ in range(rounds):
        if links_.isEmpty():
            return labels
        both = links_.union(links_.select("b", "a"))
        hooks = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to")))
        while True:
            ahead = hooks.select(F.col("node").alias("at"), F.col("to").alias("next"))
            jumped = materialize(hooks.join(ahead, F.col("to") == F.col("at")).select("node", F.col("to").alias("before"), F.col("next").alias("to")))
            hooks = jumped.select("node", "to")
            if jumped.where("before != to").isEmpty():
                break
        ends = hooks.select(F.col("node").alias("at"), F.col("to").alias("end"))
        labels = materialize(labels.join(ends, F.col("root") == F.col("at"), "left").select("node", F.coalesce("end", "root").alias("root")))
        one = links_.join(ends, F.col("a") == F.col("at")).select(F.col("end").alias("x"), "b")
        two = one.join(ends, F.col("b") == F.col("at")).select("x", F.col("end").alias("y")).where("x != y")
        links_ = materialize(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    raise RuntimeError("components did not settle; raise rounds")


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` and ``component_id``, the smallest id linked to it directly or over others."""
    rows = materialize(fingerprints(docs, size, id_col, text_col))
    by_fp = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(by_fp, distance))
    known = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(lowest, "root").select("fp", "component_id")
    return rows.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, distinct: DataFrame, size: int, distance: int) -> DataFrame:
    """Pairs ``a``, ``b`` of digests that span all links of ``SIMILARITY`` or more among the candidates of ``distinct``."""
    members = distinct.select("digest", "fp", "more", F.explode("bands").alias("key"))
    groups = components(_linked(members, members, "digest", distance, RUN_LIMIT))
    inside = materialize(distinct.join(groups, F.col("digest") == F.col("node")).select("digest", "fp", "more", "low", F.col("root").alias("key")))
    wanted = inside.select(F.col("low.doc_id").alias("low_"), F.col("low.mark").alias("mark_")).distinct()
    texts = _marked(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("low_")) & F.col("mark").eqNullSafe(F.col("mark_")), "left_semi")
    members = inside.select("digest", "fp", "more", "key").join(_sets(texts, size), "digest")
    return _linked(members, inside, "digest", distance, SET_LIMIT)


def _lowest() -> Column:
    """The row that stands for a group: the smallest id, null ids last, then the smallest ``mark``."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))


def _staying(docs: DataFrame, rows: DataFrame, lowest: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each ``low`` of ``lowest``, unchanged; of rows that repeat its id and text, one."""
    chosen = lowest.select(F.col("low.doc_id").alias("stay_"), F.col("low.mark").alias("mark_"))
    times = rows.groupBy("doc_id", "mark").count()
    chosen = chosen.join(times, F.col("stay_").eqNullSafe(F.col("doc_id")) & F.col("mark_").eqNullSafe(F.col("mark"))).select("stay_", "mark_", (F.col("count") > 1).alias("more_"))
    chosen = materialize(chosen)
    mark = F.md5(docs[text_col])

    def matching(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted, docs[id_col].cast("bigint").eqNullSafe(wanted["stay_"]) & mark.eqNullSafe(wanted["mark_"]), "left_semi")

    once, more = matching(chosen.where("not more_")), chosen.where("more_")
    if more.isEmpty():
        return once
    # repeated rows meet map-side first, however many there are; the written table tells Spark how few keys they have
    some = matching(materialize(more)).groupBy(docs[id_col], mark).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return once.union(some.select("row.*"))


def keep_representatives(docs: DataFrame, size: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_duplicates``, unchanged: the one with the smallest id.

    The choice is made among rows, not ids: null ids come last (a group without any other id keeps one of its rows), rows
    with the same id and different texts are told apart, and of rows equal in id and text one stays.
    """
    rows = materialize(_fingerprinted(_marked(docs, id_col, text_col), size))
    by_fp = materialize(rows.groupBy("fp").agg(_lowest().alias("low")))
    known = by_fp.join(components(links(by_fp, distance)).withColumnRenamed("node", "fp"), "fp", "left")
    return _staying(docs, rows, known.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low")), id_col, text_col)


def keep_one(docs: DataFrame, size: int = 5, distance: int = 34) -> DataFrame:
    """One row of each group of similar texts, chosen as ``keep_representatives`` does.

    Documents are linked when the Jaccard similarity of their five-word shingle sets is 0.8 or more. That is a cosine
    of 0.89: 19.4 of 128 fingerprint bits are expected to differ, with a standard deviation of 4.1, so a bound of 34
    leaves out about one pair in 10,000 at 0.8.
    """
    rows = materialize(signatures(docs, size))
    distinct = materialize(rows.groupBy("digest").agg(_lowest().alias("low"), *[F.first(c).alias(c) for c in ("fp", "more", "bands")]))
    roots = components(similar(docs, distinct, size, distance))
    known = distinct.select("digest", "low").join(roots, F.col("digest") == F.col("node"), "left")
    return _staying(docs, rows, known.groupBy(F.coalesce("root", "digest").alias("root")).agg(F.min("low").alias("low")), "doc_id", "text")
