"""BPE encoding by a table of distinct words, and decoding by a join of ids with their pieces.

1. Tasks split whole texts into words and gather chunks of documents of bounded size. A chunk holds
   its distinct words once, in order of their hashes, and each document as word numbers. Chunks are
   written as a table bucketed by chunk, so texts and word numbers are not shuffled again.
2. The chunks' words meet by bucket: each distinct word is encoded once, and a reply with its ids goes
   back to the chunks that hold it. A frequent word is one entry per chunk, however often it occurs.
3. Replies join their chunk, and word numbers become ids by position.

Edge cases: a null text counts as empty and gives no ids (decoded: the empty text); every input row
gives one output row, repeated or null ids included; an empty table gives no rows; other columns of
the input are ignored; texts of any length are processed whole; strings of added tokens in a text
become their id, as the tokenizer does by default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm import tokens
from cellwise.llm.common import bucket_bits, bucketed, slices, small_batches, utf8, word_hashes

CHUNK_BYTES = 8 << 20


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed block; bytes of equal rank lie together."""
    heads = np.array([x for a in arrays for x in (len(a), a.itemsize)], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(heads + planes)


def _unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    heads = np.frombuffer(raw[: 16 * len(kinds)], "<i8").reshape(-1, 2)
    out, at = [], 16 * len(kinds)
    for (n, width), kind in zip(heads.tolist(), kinds, strict=True):
        planes = np.frombuffer(raw[at : at + n * width], np.uint8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def _chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    added = tokens.load(path).added
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    held: list[tuple] = []
    size = 0

    def closed() -> pa.RecordBatch:
        nonlocal held, size, number
        coded = pa.concat_arrays([w for _, _, w, _ in held]).dictionary_encode()
        renumber = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary
        data, at = utf8(words)
        order = np.argsort(word_hashes(data, at[:-1], at[1:]), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        base, index, counts, ids = 0, [], [], []
        for doc_ids, numbers, local, first in held:
            index.append(place[renumber[base : base + len(local)]][numbers])
            base += len(local)
            counts.append(np.diff(first))
            ids.append(doc_ids)
        doc_ids = pa.concat_arrays(ids)
        docs = _pack(
            doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
            np.asarray(doc_ids.is_null().to_numpy(zero_copy_only=False), np.uint8),
            np.concatenate(counts).astype("<i4"),
            np.concatenate(index).astype("<i4"),
        )
        raw, spots = utf8(words.take(pa.array(order)))
        packed = _pack(np.diff(spots).astype("<i4"), raw)
        out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([docs], pa.binary()), pa.array([packed], pa.binary())], names=["chunk", "docs", "words"])
        held, size, number = [], 0, number + 1
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            data, at = utf8(part.column("text"))
            index, words, first = tokens.text_words(data, at, added)
            held.append((part.column("doc_id"), index, words, first))
            size += len(data) + 64 * part.num_rows
            if size >= CHUNK_BYTES:
                yield closed()
    if held:
        yield closed()


def _deal_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's words, which are in order of their hashes, as one block per bucket (the hashes' high bits)."""
    buckets = 1 << bits
    for batch in batches:
        for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), strict=True):
            lengths, raw = _unpack(packed, "<i4", "u1")
            spots = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
            hashes = word_hashes(raw, spots[:-1], spots[1:])
            edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(buckets + 1)).tolist()
            blocks = [_pack(lengths[a:b], raw[spots[a] : spots[b]]) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * buckets, pa.int64()), pa.array(range(buckets), pa.int32()), pa.array(blocks, pa.binary())], names=["chunk", "bucket", "block"])


def _encode_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = tokens.load(path)
    cache: dict[bytes, list[int]] = {}  # this task's share of the distinct words
    for batch in batches:
        replies = []
        for block in batch.column("block").to_pylist():
            lengths, raw = _unpack(block, "<i4", "u1")
            text, spots = raw.tobytes(), np.r_[0, np.cumsum(lengths)].tolist()
            ids, begin = tokens.known_ids([text[a:b] for a, b in zip(spots, spots[1:], strict=False)], vocabulary, cache)
            replies.append(_pack(np.diff(begin).astype("<i4"), ids.astype("<i4")))
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(replies, pa.binary())], names=["chunk", "bucket", "reply"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, replies in zip(batch.column("docs"), batch.column("replies"), strict=True):
            ordered = sorted(replies.as_py(), key=lambda r: r["bucket"])
            parts = [_unpack(r["reply"], "<i4", "<i4") for r in ordered]
            begin = np.r_[0, np.cumsum(np.concatenate([p[0] for p in parts]), dtype=np.int64)]
            table = np.concatenate([p[1] for p in parts])
            doc_ids, absent, counts, index = _unpack(docs.as_py(), "<i8", "u1", "<i4", "<i4")
            first = np.r_[0, np.cumsum(counts, dtype=np.int64)]
            low = 0
            while low < len(counts):  # a few documents at a time
                high = max(low + 1, int(np.searchsorted(first, first[low] + (1 << 19), "right")) - 1)
                ids, starts = tokens.gather(begin, table, index[first[low] : first[high]])
                spots = starts[first[low : high + 1] - first[low]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[low:high], mask=absent[low:high].astype(bool)), pa.ListArray.from_arrays(pa.array(spots.astype(np.int32)), pa.array(ids, pa.int32()))],
                    names=["doc_id", "ids"],
                )
                low = high


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = tokens.load(path).pieces
    begin = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=begin[1:])
    table = np.frombuffer(b"".join(pieces), np.uint8)
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy().astype(np.int64)
        raw, starts = tokens.gather(begin, table, ids.values.to_numpy()[at[0] : at[-1]])
        spots = starts[at - at[0]].tolist()
        text = raw.tobytes()
        decoded = [text[a:b].decode("utf-8", "replace") for a, b in zip(spots, spots[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        named = ids.values.slice(at[0], at[-1] - at[0]).cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at - at[0]), named), ",").to_pylist()
        columns = [
            batch.column("doc_id"),
            pc.list_value_length(ids).cast(pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in batch.column("decoded").to_pylist()], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _resolved(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: its documents as word numbers, and the replies with the ids of its words."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = bucketed(picked.mapInArrow(lambda it: _chunks(it, path), "chunk bigint, docs binary, words binary"), "chunk", spread=False)
    bits = bucket_bits(chunks.count(), 4)
    asked = chunks.select("chunk", "words").mapInArrow(lambda it: _deal_words(it, bits), "chunk bigint, bucket int, block binary")
    replies = asked.repartition("bucket").mapInArrow(lambda it: _encode_words(it, path), "chunk bigint, bucket int, reply binary")
    gathered = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))  # as many rows a chunk as there are buckets
    return chunks.select("chunk", "docs").join(gathered, "chunk").select("docs", "replies")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row's whole text, as the tokenizer file at ``path`` gives them."""
    return _resolved(docs, path, id_col, text_col).mapInArrow(_resolve, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: each id joined with its piece (a table as large as the vocabulary, held by each task), as text.

    Null ids count as none.
    """
    known = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return known.mapInArrow(lambda it: _decode(it, path), "doc_id bigint, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode``, then ``decode``, of every row within one Python task: ``n_tokens`` and SHA-256 of the decimal ids and of the decoded text."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _resolved(docs, path, id_col, text_col).mapInArrow(lambda it: _digest(_decode(_resolve(it), path)), schema)
