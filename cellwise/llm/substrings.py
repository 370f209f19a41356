"""Exact removal of long repeated word passages by compaction of a de Bruijn graph.

The edges of the graph are the windows of ``window`` consecutive words. Consecutive edges of a document
that share their minimizer (the smallest k-word hash among the window's k-mers) form one piece of a path;
a piece is cut by its words alone, so equal passages give equal pieces, except at their ends.

1. Tasks emit one row per piece: minimizer hash, piece hash, the next piece's hash, document row, first
   window, windows. Pieces whose minimizer occurs once hold no repeated window and go.
2. An aggregate per piece gives how often it occurs, its successors and how often it has one. Piece A and
   its successor B belong to one path if A has no other successor, never ends a document, and B occurs as
   often as A: each B then follows an A (in-degree one).
3. Repeated pieces compact into paths by joins: every piece points at its predecessor, and the pointers
   double (a piece takes over the pointer of the piece that it points at) until all point at the head
   of their path, at the distance of their offset. Rounds grow with the logarithm of the longest path;
   pieces that have arrived leave the exchange. No path closes into a ring, since documents end.
4. Source coordinates: the occurrences of a path's head place whole spans in documents. Their words, in blocks of
   ``BLOCK`` windows, are compared across the occurrences of the path; a block that no other occurrence
   shares word by word is not removed.
5. Pieces seen once whose minimizer has other pieces are unfolded, with one member of each of these, into
   window hashes at their coordinates; a window found again repeats.
6. Spans and windows meet their document, which drops the words under them.

Pieces are told apart by 64 bits and checked by their words; the windows of step 5 by 128 bits (64 of the
minimizer, 64 of the window).

Edge cases: a null text has no words (its row stays, with a null text); texts shorter than the window
keep all words; repeated rows count as separate documents, so their passages repeat; ids may be null;
an empty table gives no rows; input columns with any other name than those it adds pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import Rolling, bucketed, mix, signed, slices, small_batches, utf8, word_hashes, word_spans
from cellwise.session import materialize

WINDOW = 35
KMER = 12
BLOCK = 256
_KMERS = Rolling(0xD1342543DE82EF95)
_WINDOWS = Rolling(0xAF251AF3B0F025B5)


def _windowed_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    step, best = 1, values
    while step * 2 <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    rest = width - step
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def path_pieces(hashes: np.ndarray, first: np.ndarray, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Pieces of the documents' word hashes: document, first window's word, windows, minimizer hash, piece hash."""
    width = window - kmer + 1
    counts = np.diff(first)
    valid = np.maximum(counts - window + 1, 0)
    total = int(valid.sum())
    if not total:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = _KMERS.prefix(hashes)
    spots = np.arange(len(hashes) - kmer + 1)
    kmers = mix(_KMERS.ranges(sums, spots, spots + kmer))
    low = np.uint64((1 << 26) - 1)
    order = (kmers & ~low) | spots.astype(np.uint64)  # ties go to the leftmost
    place = (_windowed_min(order, width) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), valid)
    start = np.arange(total) - np.repeat(np.cumsum(valid) - valid, valid) + first[owner]
    chosen = place[start]
    heads = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
    length = np.diff(np.r_[heads, total])
    begin = start[heads]
    sums = _WINDOWS.prefix(hashes)
    piece = mix(_WINDOWS.ranges(sums, begin, begin + length + window - 1) + length.astype(np.uint64))
    return owner[heads], begin, length, kmers[chosen[heads]], piece


def _emit_pieces(batches: Iterator[pa.RecordBatch], window: int, kmer: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = utf8(part.column("text"))
            starts, ends, first = word_spans(data, at)
            owner, begin, length, minimizer, piece = path_pieces(word_hashes(data, starts, ends), first, window, kmer)
            last = np.ones(len(owner), bool)
            last[:-1] = owner[1:] != owner[:-1]
            follower = pa.array(np.roll(piece, -1).view(np.int64), mask=last)
            yield pa.RecordBatch.from_arrays(
                [signed(minimizer), signed(piece), follower, part.column("row_").take(pa.array(owner)), pa.array((begin - first[owner]).astype(np.int32)), pa.array(length.astype(np.int8))],
                names=["minimizer", "piece", "follower", "row_", "start", "windows"],
            )


def _emit_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Window hashes of the asked pieces of each document."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = utf8(part.column("text"))
            starts, ends, first = word_spans(data, at)
            sums = _WINDOWS.prefix(word_hashes(data, starts, ends))
            items, owner = _items(part.column("asked"))
            windows, start = _longs(items, "windows"), _longs(items, "start")
            which = np.repeat(np.arange(len(windows)), windows)
            nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            low = (start + first[owner])[which] + nth
            pick = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [items.field("minimizer").take(pick), signed(_WINDOWS.ranges(sums, low, low + window)), items.field("times").take(pick), part.column("row_").take(pa.array(owner[which])), items.field("start").take(pick), pa.array(nth.astype(np.int8))],
                names=["minimizer", "hash", "times", "row_", "start", "nth"],
            )


def _items(lists: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The entries of a list column and the row of each."""
    spots = lists.offsets.to_numpy()
    return lists.flatten(), np.repeat(np.arange(len(spots) - 1), np.diff(spots))


def _longs(items: pa.StructArray, name: str) -> np.ndarray:
    return items.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _emit_words(batches: Iterator[pa.RecordBatch], window: int, block: int) -> Iterator[pa.RecordBatch]:
    """The words of the asked spans of each document, in blocks of ``block`` windows."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = utf8(part.column("text"))
            starts, ends, first = word_spans(data, at)
            sizes = ends - starts
            begins = np.r_[0, np.cumsum(sizes + 1)]
            spaced = np.full(int(begins[-1]), 0x20, np.uint8)  # every word and one space after it
            shift = np.repeat(begins[:-1] - starts, sizes)
            inside = np.arange(len(shift)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
            spaced[inside + shift] = data[inside]
            raw = spaced.tobytes()
            items, owner = _items(part.column("spans"))
            windows, start = _longs(items, "windows"), _longs(items, "start")
            blocks = -(-windows // block)
            which = np.repeat(np.arange(len(windows)), blocks)
            nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            offset = nth * block
            held = np.minimum(block, windows[which] - offset)
            low = first[owner[which]] + start[which] + offset
            words = [raw[a:b] for a, b in zip(begins[low].tolist(), begins[low + held + window - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [items.field("path").take(pa.array(which)), pa.array(nth.astype(np.int32)), pa.array(words, pa.binary()), part.column("row_").take(pa.array(owner[which])), pa.array((start[which] + offset).astype(np.int32))],
                names=["path", "block", "words", "row_", "start"],
            )


def _cut(batches: Iterator[pa.RecordBatch], window: int, verbatim: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = utf8(part.column("text"))
            starts, ends, first = word_spans(data, at)
            items, owner = _items(part.column("marks"))
            begin = _longs(items, "start") + first[owner]
            windows, mask = _longs(items, "windows"), _longs(items, "mask")
            change = np.zeros(len(starts) + 1, np.int64)
            whole = windows > 0
            np.add.at(change, begin[whole], 1)
            np.add.at(change, begin[whole] + windows[whole] + window - 1, -1)
            for bit in range(int(mask.max(initial=0)).bit_length()):
                hit = begin[(mask >> bit) & 1 == 1] + bit
                np.add.at(change, hit, 1)
                np.add.at(change, hit + window, -1)
            stay = np.cumsum(change[:-1]) == 0
            raw = data.tobytes()
            removed = np.r_[0, np.cumsum(~stay)]
            texts = []
            for i, known in enumerate(part.column("text").is_valid().to_pylist()):
                low, high = first[i], first[i + 1]
                if verbatim and known and removed[high] == removed[low]:
                    texts.append(raw[at[i] : at[i + 1]].decode())
                    continue
                keep = np.flatnonzero(stay[low:high]) + low
                texts.append(b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode() if known else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("rest_"), pa.array(texts, pa.string()), pa.array(np.diff(first)), pa.array(removed[first[1:]] - removed[first[:-1]])],
                names=["rest_", "kept_", "n_words_", "n_removed_"],
            )


def compact(pieces: DataFrame) -> DataFrame:
    """Paths of repeated pieces: ``piece`` (the head of each path) and the ``windows`` of the whole path.

    ``pieces``: ``piece``, ``n`` (times seen), ``windows``, the smallest and largest follower ``low`` and ``high``, and ``followed`` (times it has one).
    """
    out_one = pieces.where("low = high and followed = n").select(F.col("low").alias("piece"), "n", F.col("piece").alias("up"), F.col("windows").cast("long").alias("offset"))
    links = materialize(out_one.join(pieces.select("piece", "n", "windows"), ["piece", "n"]).select("piece", "up", "offset", "windows"))
    moving, arrived, rounds = links, [], links
    while True:
        target = rounds.select(F.col("piece").alias("up"), F.col("up").alias("further"), F.col("offset").alias("more"))
        step = moving.join(target, "up", "left")
        step = materialize(step.select("piece", F.coalesce("further", "up").alias("up"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), "windows", F.col("further").isNotNull().alias("moved")))
        arrived.append(step.where("not moved").drop("moved"))
        moving = step.where("moved").drop("moved")
        if moving.isEmpty():
            break
        rounds = moving
        for done in arrived:
            rounds = rounds.union(done)
    ends = arrived[0]
    for done in arrived[1:]:
        ends = ends.union(done)
    whole = ends.groupBy(F.col("up").alias("piece")).agg(F.max(F.col("offset") + F.col("windows")).alias("total"))
    heads = pieces.select("piece", "windows").join(links.select("piece"), "piece", "left_anti").join(whole, "piece", "left")
    return heads.select("piece", F.coalesce("total", "windows").cast("int").alias("windows"))


def confirmed(texts: DataFrame, spans: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The spans (``row_``, ``path``, ``start``, ``windows``), in blocks, whose words occur at another span of the same path."""
    listed = spans.groupBy("row_").agg(F.collect_list(F.struct("path", "start", "windows")).alias("spans"))  # within one document
    words = texts.join(listed, "row_").select("row_", "text", "spans")
    words = words.mapInArrow(lambda it: _emit_words(it, window, block), "path bigint, block int, words binary, row_ bigint, start int")
    alone = words.groupBy("path", "block", "words").agg(F.count("*").alias("n"), F.min("row_").alias("row_"), F.min("start").alias("start"))
    alone = materialize(alone.where("n = 1").select("row_", "start"))
    steps = spans.select("row_", "start", "windows", F.explode(F.sequence(F.lit(0), F.col("windows") - 1, F.lit(block))).alias("offset"))
    blocks = steps.select("row_", (F.col("start") + F.col("offset")).alias("start"), F.least(F.lit(block), F.col("windows") - F.col("offset")).alias("windows"))
    return blocks.join(alone, ["row_", "start"], "left_anti")


def _without(docs: DataFrame, window: int, kmer: int, text_col: str, verbatim: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with ``kept_``, ``n_words_`` and ``n_removed_``, and the other columns of ``docs`` by name, taken from a struct beside these."""
    if window - kmer + 1 > 63:
        raise ValueError("a piece has more windows than a mask has bits; window - kmer + 1 may be 63 at most")
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(F.lit(True).alias("_"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)])
    source = docs.select(F.monotonically_increasing_id().alias("row_"), rest.alias("rest_"), docs[text_col].alias("text"))
    stored = bucketed(source, "row_")
    texts = stored.select("row_", "text")
    found = materialize(texts.mapInArrow(lambda it: _emit_pieces(it, window, kmer), "minimizer bigint, piece bigint, follower bigint, row_ bigint, start int, windows tinyint"))
    seen = found.groupBy("minimizer").agg(F.count("*").alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high"))
    # written before the join, so that both of its sides are plain exchanges and a hot minimizer can be split
    shared = materialize(seen.where("n > 1").select("minimizer", (F.col("low") != F.col("high")).alias("branching")))
    again = materialize(found.join(shared, "minimizer"))
    nodes = again.groupBy("minimizer", "piece", "branching", "windows").agg(
        F.count("*").alias("n"), F.min("follower").alias("low"), F.max("follower").alias("high"), F.count("follower").alias("followed"), F.min(F.struct("row_", "start")).alias("at")
    )
    nodes = materialize(nodes)

    heads = materialize(compact(nodes.where("n > 1").select("piece", "n", "windows", "low", "high", "followed")))
    spans = materialize(again.select("piece", "row_", "start").join(heads, "piece").select(F.col("piece").alias("path"), "row_", "start", "windows"))
    passages = confirmed(texts, spans, window)

    members = nodes.where("branching").select("minimizer", F.least("n", F.lit(2)).cast("tinyint").alias("times"), "at.row_", "at.start", "windows")
    asked = members.groupBy("row_").agg(F.collect_list(F.struct("minimizer", "times", "start", "windows")).alias("asked"))  # within one document
    unfolded = texts.join(asked, "row_").select("row_", "text", "asked").mapInArrow(lambda it: _emit_windows(it, window), "minimizer bigint, hash bigint, times tinyint, row_ bigint, start int, nth tinyint")
    unfolded = materialize(unfolded)
    twice = materialize(unfolded.groupBy("minimizer", "hash").agg(F.sum("times").alias("n")).where("n > 1").select("minimizer", "hash"))
    single = unfolded.where("times = 1").join(twice, ["minimizer", "hash"]).groupBy("row_", "start").agg(F.bit_or(F.expr("shiftleft(1L, cast(nth as int))")).alias("mask"))

    marks = passages.select("row_", "start", "windows", F.lit(0).cast("long").alias("mask")).union(single.select("row_", "start", F.lit(0), "mask"))
    marks = marks.groupBy("row_").agg(F.collect_list(F.struct("start", "windows", "mask")).alias("marks"))
    none = F.array().cast("array<struct<start:int,windows:int,mask:bigint>>")
    ready = stored.join(marks, "row_", "left").select("rest_", "text", F.coalesce("marks", none).alias("marks"))
    schema = T.StructType([T.StructField("rest_", stored.schema["rest_"].dataType)]).add("kept_", "string").add("n_words_", "long").add("n_removed_", "long")
    cut = ready.mapInArrow(lambda it: _cut(it, window, verbatim), schema)
    return cut, {c: F.col("rest_").getField(f"c{i}").alias(c) for i, c in enumerate(others)}


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, text_col: str = "text", verbatim: bool = False) -> DataFrame:
    """The other columns of ``docs`` with ``kept_`` (the words left, joined by one space), ``n_words_`` and ``n_removed_``.

    A word goes if a window over it also starts anywhere else, in the same document or another one.
    With ``verbatim``, a text that loses no word stays as it is. Columns of ``docs`` with the names of the three
    results are left out; ``without_repeats`` keeps them.
    """
    cut, others = _without(docs, window, kmer, text_col, verbatim)
    results = ("kept_", "n_words_", "n_removed_")
    return cut.select(*[column for name, column in others.items() if name not in results], *results)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever their names; ``text`` loses the words under repeated windows and stays as it is if there are none."""
    cut, others = _without(docs, WINDOW, KMER, "text", True)
    return cut.select(*[F.col("kept_").alias("text") if name == "text" else others[name] for name in docs.columns])
