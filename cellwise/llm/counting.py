"""Token counts that follow edits, without encoding whole texts again.

Each document keeps a segment tree over blocks of pre-tokens: the leaves hold the characters and tokens
of a block, inner nodes the sums below them. An edit descends by character sums to the blocks it
touches. The text is split anew from a few pre-tokens before the edit until a new boundary meets an old
one behind it: from there on equal text gives equal pre-tokens. Only pre-tokens between these points
are encoded; they replace the old ones in the touched leaves, and the sums above are updated.

Counts are those of the tokenizer file with added tokens' strings as ordinary text. Edits apply in
order, each to the text the earlier ones left; positions are characters and are clipped to the text.

Edge cases: a null text counts as empty; null or empty edits change nothing, null fields count as 0 or
as an empty string; every input row gives one row; an empty table gives no rows; other columns are
ignored; texts with code points that this Python's Unicode tables do not know are counted whole by the
tokenizer after each edit, and say so in ``n_encoded``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm import tokens
from cellwise.llm.common import slices, small_batches, utf8

BLOCK = 64  # pre-tokens per leaf
CONTEXT = 4  # pre-tokens before an edit that are split again
AHEAD = 12  # pre-tokens behind an edit that are looked at first
CACHE_WORDS = 200_000


class Tree:
    """Sums of characters and tokens over blocks of pre-tokens (lists of lengths and counts)."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self._build(lengths.tolist(), counts.tolist())

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(a), sum(b)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one behind the end) and the characters before it."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before

    def previous(self, leaf: int) -> int | None:
        """The nearest leaf before ``leaf`` that is not empty."""
        while leaf > 0:
            leaf -= 1
            if self.leaves[leaf][0]:
                return leaf
        return None

    def replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Leaves ``first`` to ``last`` hold the given pre-tokens from now on."""
        room = last - first + 1
        if len(lengths) > 4 * BLOCK * room:  # far too many for these leaves
            head, tail = self.leaves[:first], self.leaves[last + 1 :]
            self._build([x for a, _ in head for x in a] + lengths + [x for a, _ in tail for x in a], [x for _, b in head for x in b] + counts + [x for _, b in tail for x in b])
            return
        share = -(-len(lengths) // room)
        for k in range(room):
            a, b = lengths[k * share : (k + 1) * share], counts[k * share : (k + 1) * share]
            leaf = first + k
            self.leaves[leaf] = (a, b)
            node = self.size + leaf
            self.chars[node], self.tokens[node] = sum(a), sum(b)
            while node > 1:
                node //= 2
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


def _boundaries(text: str) -> list[int]:
    """Character offsets at which the pre-tokens of ``text`` begin, and its length."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    offsets, _ = tokens.split_words(raw, np.array([0, len(raw)]))
    if len(raw) == len(text):
        return offsets.tolist()
    heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return heads[offsets].tolist()


def apply_edit(text: str, tree: Tree, at: int, remove: int, insert: str, count) -> tuple[str, int]:
    """The edited text and how many of its characters were encoded again; ``tree`` follows. ``count`` counts a word."""
    at = max(0, min(at, len(text)))
    stop = min(len(text), at + max(0, remove))
    new = text[:at] + insert + text[stop:]
    shift = len(insert) - (stop - at)
    first, before = tree.find(at)
    # leaves far enough back to hold CONTEXT pre-tokens before the edit
    def inside(leaf: int, begin: int) -> int:
        return sum(1 for end in np.cumsum(tree.leaves[leaf][0]).tolist() if begin + end < at)

    context = inside(first, before)
    while context < CONTEXT and (earlier := tree.previous(first)) is not None:
        first = earlier
        before -= tree.chars[tree.size + first]
        context += len(tree.leaves[first][0])
    last, end = first, before
    lengths: list[int] = []
    counts: list[int] = []

    def take(leaf: int) -> None:
        nonlocal end
        lengths.extend(tree.leaves[leaf][0])
        counts.extend(tree.leaves[leaf][1])
        end += tree.chars[tree.size + leaf]

    take(last)
    ahead = AHEAD
    while True:
        old = np.r_[0, np.cumsum(lengths, dtype=np.int64)].astype(np.int64) + before
        while last + 1 < len(tree.leaves) and (end < stop or len(old) - np.searchsorted(old, stop, "right") < ahead):
            last += 1
            take(last)
            old = np.r_[0, np.cumsum(lengths, dtype=np.int64)].astype(np.int64) + before
        keep = max(0, int(np.searchsorted(old, at, "left")) - CONTEXT)
        begin = int(old[keep])
        whole = last + 1 >= len(tree.leaves)
        finish = int(old[-1]) + shift
        fresh = [begin + x for x in _boundaries(new[begin:finish])]
        # near the cut the new boundaries may not stand, unless the text ends there
        trusted = fresh if whole else fresh[:-3]
        known = {int(x) + shift: i for i, x in enumerate(old.tolist()) if x >= stop}
        meet = next(((p, known[p]) for p in trusted if p >= at + len(insert) and p in known), None)
        if meet is not None or whole:
            break
        ahead *= 2
    point, index = meet if meet is not None else (finish, len(old) - 1)
    spots = [x for x in fresh if x < point] + [point]
    mid_lengths = [b - a for a, b in zip(spots, spots[1:], strict=False)]
    mid_counts = [count(new[a:b]) for a, b in zip(spots, spots[1:], strict=False)]
    tree.replace(first, last, lengths[:keep] + mid_lengths + lengths[index:], counts[:keep] + mid_counts + counts[index:])
    return new, point - begin


def count_edits(docs: DataFrame, edits: Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_before``, ``n_after`` (tokens), ``n_edits``, ``n_chars`` (after) and ``n_encoded`` (characters encoded again).

    ``edits``: array of structs (at, remove, insert).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens.load(path)
        cache: dict[bytes, list[int]] = {}

        def count(word: str) -> int:
            raw = word.encode("utf-8")
            ids = cache.get(raw)
            if ids is None:
                ids = cache[raw] = vocabulary.encode_word(raw)
            return len(ids)

        def count_whole(text: str) -> int:
            vocabulary.tokenizer.encode_special_tokens = True
            n = len(vocabulary.encode_text(text))
            vocabulary.tokenizer.encode_special_tokens = False
            return n

        for batch in batches:
            for part in slices(batch, "text"):
                data, at = utf8(part.column("text"))
                offsets, first = tokens.split_words(data, at)
                index, words = tokens.distinct(data, offsets)
                _, begin = tokens.known_ids(words.to_pylist(), vocabulary, cache, CACHE_WORDS)
                counts = np.diff(begin)[index]
                heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                lengths = np.diff(heads[offsets])
                odd = tokens.whole_texts(data, at, {})
                raw = data.tobytes()
                rows = []
                for i, changes in enumerate(part.column("edits").to_pylist()):
                    text = raw[at[i] : at[i + 1]].decode()
                    low, high = first[i], first[i + 1]
                    done = encoded = 0
                    tree = Tree(lengths[low:high], counts[low:high])
                    before = count_whole(text) if odd[i] else tree.tokens[1]
                    for change in changes or []:
                        if change is None:
                            continue
                        insert = change["insert"] or ""
                        if not odd[i] and tokens.whole_texts(*utf8(pa.array([insert])), {})[0]:
                            odd[i] = True
                        if odd[i]:
                            spot = max(0, min(change["at"] or 0, len(text)))
                            text = text[:spot] + insert + text[spot + max(0, change["remove"] or 0) :]
                            encoded += len(text)
                        else:
                            text, n = apply_edit(text, tree, change["at"] or 0, change["remove"] or 0, insert, count)
                            encoded += n
                        done += 1
                    after = count_whole(text) if odd[i] else tree.tokens[1]
                    rows.append((before, after, done, len(text), encoded))
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_before", "n_after", "n_edits", "n_chars", "n_encoded"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), edits.cast("array<struct<at:int,remove:int,insert:string>>").alias("edits"))
    return picked.mapInArrow(run, "doc_id bigint, n_before bigint, n_after bigint, n_edits bigint, n_chars bigint, n_encoded bigint")


def revision(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits of a text that follow from it and its id: an insertion of one of its passages, a removal, a replacement."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))

    def spot(salt: int, below: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.greatest(below, F.lit(1)).cast("bigint")).cast("int")

    def passage(salt: int, length: int) -> Column:
        return F.coalesce(F.substr(F.col(text_col), spot(salt, size) + 1, F.lit(length)), F.lit(""))

    def edit(at: Column, remove: Column, insert: Column) -> Column:
        return F.struct(at.alias("at"), remove.cast("int").alias("remove"), insert.alias("insert"))

    return F.array(
        edit(spot(1, size + 1), F.lit(0), passage(2, 40)),
        edit(spot(3, size + 1), spot(4, F.lit(60)), F.lit("")),
        edit(spot(5, size + 1), spot(6, F.lit(20)), passage(7, 25)),
    )
