"""Benchmark decontamination with suffix arrays of the training documents.

``suffix_shards`` cuts the documents into shards of at most ``SHARD_BYTES`` of text and writes one row
per shard: its vocabulary, its words as ranks in that vocabulary (a separator of its own after every
document, so that no match runs on into the next one) and the sorted order of all its suffixes. The
index knows nothing of a benchmark and may be searched for several.

``search`` takes the benchmark in blocks of at most ``BLOCK_BYTES`` of text (an item beyond that is a
block of its own). Every suffix of a block's items is found by binary search in every shard: first by
its leading words as one sorted key, then by narrowing the interval of suffixes a word at a time until
a whole window (``window`` words, or a shorter item as a whole) matches. Words are compared as
themselves through the vocabulary. The interval gives every place where the window occurs. From there
a binary search on the length of the common prefix gives the longest match of the suffix.

A window that many items share is located once, a passage that many documents share is one interval
of their shard, and no document meets another one.

Edge cases: a null or empty text has no words, its document stays with zeros, and as an item it matches
nothing; repeated document rows are rows of their own; items that repeat an id count as one item, items
with a null id as one with an empty id; a document longer than a shard is a shard of its own; an empty
table of documents gives no rows, an empty benchmark leaves every document clean. Other columns pass
through ``decontaminate`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import Rolling, lowered, mix, packed_words, slices, small_batches, stored, utf8, word_spans

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True  # the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased UTF-8
_PREFIXES = Rolling(0x9FB21C651E98DF25)
FOUND = "n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>, best array<struct<item:string,item_start:int,length:int,doc_start:int>>"


def coded_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in byte order, the rank of every word, and per text the index of its first word."""
    data, at = utf8(column)
    data = lowered(data)
    starts, ends, first = word_spans(data, at, _IS_WORD)
    coded = packed_words(data, starts, ends, _IS_WORD).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()], first


def leading_keys(text: np.ndarray, width: int, bits: int) -> np.ndarray:
    """``width`` consecutive symbols from each place as one number."""
    padded = np.r_[text, np.zeros(width - 1, text.dtype)].astype(np.int64)
    keys = np.zeros(len(text), np.int64)
    for i in range(width):
        keys = (keys << bits) | padded[i : i + len(text)]
    return keys


def suffix_array(text: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes; only suffixes that are still tied are sorted again, by twice the length."""
    keys = leading_keys(text, width, bits)
    order = np.argsort(keys)
    heads = np.r_[True, np.diff(keys[order]) != 0]
    rank = np.empty(len(text), np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(len(text)), 0))
    tied = np.flatnonzero(~(heads & np.r_[heads[1:], True]))
    length = width
    while len(tied):  # slots of ``order`` whose suffixes agree so far; a separator ends every tie
        place = order[tied]
        keys = (rank[place] << 32) | rank[place + length]
        turn = np.argsort(keys)
        order[tied] = place[turn]
        keys = keys[turn]
        heads = np.r_[True, np.diff(keys) != 0]
        rank[order[tied]] = np.maximum.accumulate(np.where(heads, tied, 0))
        tied = tied[~(heads & np.r_[heads[1:], True])]
        length *= 2
    return order


def _key_shape(symbols: int, longest: int = 4) -> tuple[int, int]:
    bits = max(1, symbols.bit_length())
    return min(longest, 63 // bits), bits


def _shard(parts: list[pa.RecordBatch], carry: Sequence[str]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    vocabulary, ranks, first = coded_words(rows.column("text"))
    docs = len(first) - 1
    owner = np.repeat(np.arange(docs), np.diff(first))
    text = np.empty(len(ranks) + docs, np.int32)
    text[np.arange(len(ranks)) + owner] = ranks + docs
    text[first[1:] + np.arange(docs)] = np.arange(docs)
    order = suffix_array(text, *_key_shape(docs + len(vocabulary))).astype(np.int32)
    held = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in carry], names=[f"c{i}" for i in range(len(carry))]) if rows.num_rows else None
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), held),
            pa.array([(first + np.arange(docs + 1)).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([b" ".join(vocabulary.to_pylist())], pa.binary()),
            pa.array([text.tobytes()], pa.binary()),
            pa.array([order.tobytes()], pa.binary()),
        ],
        names=["docs", "first", "vocabulary", "symbols", "suffixes"],
    )


def suffix_shards(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index: ``shard`` and the suffix array of its documents, which keep the columns ``carry``.

    Each shard is a row group of its own: a task holds one at a time, however many its part of the documents makes."""
    small_batches(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = [f"c{i}" for i in range(len(carry))]
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                more = len(utf8(part.column("text"))[0])
                if held and size + more > shard_bytes:
                    yield _shard(held, names)
                    held, size = [], 0
                held.append(part)
                size += more
        if size or held:
            yield _shard(held, names)

    kept = [docs[c].alias(f"c{i}") for i, c in enumerate(carry)]
    columns = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)])
    schema = T.StructType([T.StructField("docs", T.ArrayType(columns)), *T.StructType.fromDDL("first array<int>, vocabulary binary, symbols binary, suffixes binary")])
    shards = docs.select(*kept, docs[text_col].alias("text")).mapInArrow(emit, schema)
    return stored(shards.withColumn("shard", F.monotonically_increasing_id()), rows=1)


class Items:
    """A block of benchmark items: their words as ranks, the windows asked for and the items that hold each."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids = ids
        vocabulary, self.words, first = coded_words(pa.array(texts, pa.large_string()))
        self.vocabulary = vocabulary
        size = np.diff(first)
        self.owner = np.repeat(np.arange(len(ids)), size)
        self.first, self.stop = first[:-1][self.owner], first[1:][self.owner]
        place = np.arange(len(self.words))
        need = np.minimum(window, size)[self.owner]
        asked = place + need <= self.stop
        asked &= (need == window) | (place == self.first)
        self.at, self.need = place[asked], need[asked]  # suffixes with a whole window
        known: dict[bytes, int] = {}
        wide = self.words.astype(np.int64)
        self.window = np.array([known.setdefault(wide[a : a + n].tobytes(), len(known)) for a, n in zip(self.at.tolist(), self.need.tolist(), strict=True)], np.int64)
        pairs = np.unique(np.stack([self.window, self.owner[self.at]]), axis=1) if len(self.at) else np.zeros((2, 0), np.int64)
        self.holders = pairs[1]
        self.held_from = np.searchsorted(pairs[0], np.arange(len(known) + 1))

    def __bool__(self) -> bool:
        return len(self.at) > 0


def _bisect(text: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray, symbol: np.ndarray, after: bool) -> np.ndarray:
    """First slot in [low, high) whose suffix has a symbol not below (``after``: above) ``symbol`` at ``depth``."""
    low, high = low.copy(), high.copy()
    while (going := low < high).any():
        middle = (low + high) >> 1
        there = text[order[np.where(going, middle, 0)] + np.where(going, depth, 0)]
        up = going & ((there <= symbol) if after else (there < symbol))
        low = np.where(up, middle + 1, low)
        high = np.where(going & ~up, middle, high)
    return low


class Shard:
    """One row of the index, ready for searches."""

    def __init__(self, row: dict):
        self.first = row["first"].values.to_numpy()
        self.text = np.frombuffer(row["symbols"].as_buffer(), np.int32)
        self.order = np.frombuffer(row["suffixes"].as_buffer(), np.int32)
        data = np.frombuffer(row["vocabulary"].as_buffer(), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), _IS_WORD)
        self.vocabulary = packed_words(data, starts, ends, _IS_WORD)
        self.docs = len(self.first) - 1
        self.width, self.bits = _key_shape(self.docs + len(self.vocabulary))

    def symbols(self, items: Items) -> np.ndarray:
        """The items' words as symbols of this shard, -1 for a word it lacks."""
        there = pc.index_in(items.vocabulary, self.vocabulary)
        there = there.fill_null(-1).to_numpy().astype(np.int64)
        return np.where(there < 0, -1, there + self.docs)[items.words]

    def windows(self, items: Items, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes (numbers in ``items.at``) whose whole window occurs, and their intervals of ``order``."""
        unknown = np.flatnonzero(asked < 0)
        ahead = np.r_[unknown, len(asked)][np.searchsorted(unknown, items.at)]
        pick = np.flatnonzero(ahead >= items.at + items.need)
        at, need = items.at[pick], items.need[pick]
        keys = leading_keys(self.text, self.width, self.bits)[self.order]
        wanted = leading_keys(np.maximum(asked, 0), self.width, self.bits)[at]
        keyed = need >= self.width
        low = np.where(keyed, np.searchsorted(keys, wanted, "left"), 0)
        high = np.where(keyed, np.searchsorted(keys, wanted, "right"), len(keys))
        depth = np.where(keyed, self.width, 0)
        while True:
            live = low < high
            pick, at, need, low, high, depth = (x[live] for x in (pick, at, need, low, high, depth))
            todo = np.flatnonzero(depth < need)
            if not len(todo):
                return pick, low, high
            symbol = asked[at[todo] + depth[todo]]
            a = _bisect(self.text, self.order, low[todo], high[todo], depth[todo], symbol, False)
            high[todo] = _bisect(self.text, self.order, a, high[todo], depth[todo], symbol, True)
            low[todo] = a
            depth[todo] += 1

    def longest(self, items: Items, asked: np.ndarray, pick: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match of each suffix and the first place of the shard that has it among its neighbours."""
        ours, theirs = (_PREFIXES.prefix(mix(x.astype(np.uint64))) for x in (self.text, asked))
        at, need = items.at[pick], items.need[pick]
        stop = items.stop[at]

        def common(slot: np.ndarray) -> np.ndarray:
            place = self.order[slot].astype(np.int64)
            least, most = need.copy(), np.minimum(stop - at, len(self.text) - place)
            while (going := least < most).any():
                middle = (least + most + 1) >> 1
                same = _PREFIXES.ranges(ours, place, place + middle) == _PREFIXES.ranges(theirs, at, at + middle)
                least = np.where(going & same, middle, least)
                most = np.where(going & ~same, middle - 1, most)
            return least

        begin, end = low.copy(), high.copy()
        last = high - 1
        while (going := begin < end).any():  # the slot where the suffix itself would stand
            middle = np.minimum((begin + end) >> 1, last)
            shared = common(middle)
            place = self.order[middle].astype(np.int64)
            below = (at + shared < stop) & (self.text[np.minimum(place + shared, len(self.text) - 1)] < asked[np.minimum(at + shared, len(asked) - 1)])
            begin = np.where(going & below, middle + 1, begin)
            end = np.where(going & ~below, middle, end)
        best, where = np.zeros(len(pick), np.int64), np.zeros(len(pick), np.int64)
        for slot in (np.maximum(begin - 1, low), np.minimum(begin, last)):
            shared = common(slot)
            place = self.order[slot].astype(np.int64)
            better = (shared > best) | ((shared == best) & (place < where))
            best, where = np.where(better, shared, best), np.where(better, place, where)
        return best, where


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all ranges in one row, and the range of each."""
    sizes = high - low
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


def search_shard(shard: Shard, items: Items) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Per document: words, spans of hit words, ids of the items with occurring windows, and longest matches that lie in it."""
    words = np.diff(shard.first) - 1
    asked = shard.symbols(items)
    pick, low, high = shard.windows(items, asked)
    _, one = np.unique(items.window[pick], return_index=True)  # a window that several suffixes share is located once
    slots, which = _spread(low[one], high[one])
    place = shard.order[slots].astype(np.int64)
    doc = np.searchsorted(shard.first, place, "right") - 1
    change = np.zeros(len(shard.text) + 2, np.int64)
    np.add.at(change, place + 1, 1)
    np.add.at(change, place + 1 + items.need[pick[one]][which], -1)
    edge = np.diff((np.cumsum(change) > 0).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # separators are never hit, so no span leaves its document
    of = np.searchsorted(shard.first, start, "right") - 1
    span = pa.StructArray.from_arrays([pa.array((x - shard.first[of]).astype(np.int32)) for x in (start, stop)], names=["start", "stop"])
    spans = _lists(np.bincount(of, minlength=shard.docs), span)

    found = np.unique(np.stack([doc, items.window[pick[one]][which]]), axis=1)
    cuts = np.searchsorted(found[0], np.arange(shard.docs + 1))
    named, sizes = [], np.zeros(shard.docs, np.int64)
    for d in np.flatnonzero(np.diff(cuts)).tolist():
        windows = found[1, cuts[d] : cuts[d + 1]]
        mine = np.unique(items.holders[_spread(items.held_from[windows], items.held_from[windows + 1])[0]])
        sizes[d] = len(mine)
        named.append(mine)
    names = pa.array([items.ids[i] for mine in named for i in mine.tolist()], pa.string())

    length, where = shard.longest(items, asked, pick, low, high)
    owner = items.owner[items.at[pick]]
    order = np.lexsort((where, items.at[pick], -length, owner))
    best = order[np.r_[True, np.diff(owner[order]) != 0]] if len(order) else order
    in_doc = np.searchsorted(shard.first, where[best], "right") - 1
    best, in_doc = best[o := np.argsort(in_doc, kind="stable")], in_doc[o]
    at = items.at[pick[best]]
    match = pa.StructArray.from_arrays(
        [
            pa.array([items.ids[i] for i in owner[best].tolist()], pa.string()),
            pa.array((at - items.first[at]).astype(np.int32)),
            pa.array(length[best].astype(np.int32)),
            pa.array((where[best] - shard.first[in_doc]).astype(np.int32)),
        ],
        names=["item", "item_start", "length", "doc_start"],
    )
    return words, spans, _lists(sizes, names), _lists(np.bincount(in_doc, minlength=shard.docs), match)


def blocks(items: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").toLocalIterator():
        if ids and size + len(row["t"]) > block_bytes:
            yield Items(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"])
    yield Items(ids, texts, window)


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of the index: ``doc`` (the carried columns), ``n_words``, ``spans`` of hit words, ``items`` (ids as
    strings, sorted) and ``best`` (the longest match of an item in this shard, if it lies in this document)."""
    held = index.schema["docs"].dataType.elementType
    schema = T.StructType([*T.StructType.fromDDL("shard bigint, nth int"), T.StructField("doc", held), *T.StructType.fromDDL(FOUND)])

    def passed(block: Items) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    shard = Shard(row)
                    if not shard.docs:
                        continue
                    words, spans, named, best = search_shard(shard, block)
                    n = pa.array(np.arange(shard.docs, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.repeat(row["shard"], shard.docs), n, row["docs"].values, pa.array(words.astype(np.int64)), spans, named, best], names=schema.names)

        return index.mapInArrow(emit, schema)

    found = [passed(block) for block in blocks(items, window, id_col, text_col, block_bytes)]
    result = found[0]
    if len(found) > 1:
        for more in found[1:]:
            result = result.unionByName(more)
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "best")]
        result = result.groupBy("shard", "nth").agg(F.first("doc").alias("doc"), F.max("n_words").alias("n_words"), *joined)
    return result.select("shard", "nth", "doc", "n_words", F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"), "best")


def hit_words(spans: str = "spans") -> F.Column:
    """Words under sorted spans, which may overlap."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["stop"]).alias("reach"))
    return F.aggregate(spans, start, step, lambda a: a["n"]).cast("bigint")


def longest_matches(found: DataFrame) -> DataFrame:
    """Per item with a match: its longest verbatim match over all shards, as ``item``, ``item_start``, ``length``, ``doc`` and ``doc_start``."""
    each = found.select("doc", "shard", "nth", F.explode("best").alias("b"))
    order = F.struct(F.col("b.length"), -F.col("b.item_start"), -F.col("shard"), -F.col("nth"))
    best = each.groupBy("b.item").agg(F.max_by(F.struct("b", "doc"), order).alias("m"))
    return best.select("item", "m.b.item_start", "m.b.length", "m.doc", "m.b.doc_start")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that hold a window of an item."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = stored(docs.select(F.struct(*[docs[c].alias(n) for c, n in names.items()]).alias("row"), F.monotonically_increasing_id().alias("number")))
    texts = rows.select("number", F.col("row")[names[text_col]].alias("text"))
    found = search(suffix_shards(texts, ["number"]), items, window)
    clean = found.where(F.size("spans") == 0).select(F.col("doc.c0").alias("number"))
    return rows.join(clean, "number", "left_semi").select(*[F.col("row")[n].alias(c) for c, n in names.items()])
