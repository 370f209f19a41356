"""Repair of conversation structure by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: nothing, or turns of user and
assistant in pairs after one system turn at most. Its rows may be kept (0), given the role user or
assistant (2) or deleted (3), empty turns may be inserted (2), and a truncated row that stays costs 1
more; blank rows and duplicates must go.

The repair grammar is in Chomsky normal form. A nonterminal (p, q) stands for the edits that lead from
state p of the structure to state q; its binary rules are (p, q) -> (p, r) (r, q), its terminal rules
edit one row, and the insertion closure (edits of no row) is put around every row. A cell holds the
cheapest (cost, audit) of each nonterminal over a span of rows, the audit being the initials of the
edits (Delete, Insert, Keep, Rerole), smallest first among equally cheap ones. Spans are combined
bottom-up by length, 1, 2, 4 and so on: since (p, r) (r, q) may be bracketed anywhere, one split of a
span finds the same minimum as all of them, so a conversation of n rows takes n cells, not n squared.
Two equally cheap audits of one span are never prefixes of each other (the longer one would hold more
insertions and cost more), so the smallest parts make the smallest whole.

On Spark, damaged rows are sorted by conversation and turn into ranges (equal rows may be split) and
numbered; ``PIECE`` neighbouring rows of a conversation at most form a piece. Tasks parse pieces; the cells
of a conversation's pieces are combined by the same rule in rounds of ``FAN`` neighbours, and the way
back down hands every piece its entry state and its part of the audit. First rows of equal role and text are
found by an aggregate, so neither a long conversation nor a common text lands in one task. Repaired
turns come out by piece; only ``digests`` streams a conversation through one task, in bounded memory, since
a SHA-256 cannot be put together from parts.

Edge cases: a null role or text counts as one space; rows of a null ``conv_id`` are one conversation;
null turns come first, rows of equal turn are ordered by role and text; an initial is the first
character of the role, none for an empty role; a repeated row is a row of its own; conversations that
lose all rows stay, with zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellwise.llm.common import small_batches, stored
from cellwise.session import materialize

PIECE = 256  # rows parsed together
FAN = 64  # neighbouring cells combined in one round
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = 4, (0, 3)
WORST = (1 << 62, "")
Cell = tuple  # cheapest (cost, audit) of the nonterminals (0, 0), (0, 1), ... (3, 3), or None
PIECE_BITS, FAN_BITS = PIECE.bit_length() - 1, FAN.bit_length() - 1
CELL = "array<struct<cost:bigint,audit:string>>"
MESSAGES = "array<struct<role:string,text:string,edit:string>>"


def damage(turns: DataFrame) -> DataFrame:
    """The table after the planted faults: dropped rows, emptied texts, lost ends of sentences, repeated rows, wrong roles."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(fault == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), fault.alias("fault"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("fault != 0").select("conv_id", "turn", "role", "text", copies.alias("copy"))


def trimmed(text: str | Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def in_order(rows: DataFrame) -> DataFrame:
    """Written rows with ``place`` from 0, rising by conversation, turn, role and text over the whole table."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id())  # so that many equal rows may lie in several ranges
    ranged = dealt.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt")
    written = stored(ranged.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("number")))
    part = F.shiftright("number", 33)
    sizes = written.groupBy(part.alias("part")).agg((F.max("number") + 1 - F.shiftleft(F.first(part), 33)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = written.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.select("conv_id", "turn", "role", "text", (F.col("start") + F.col("number") - F.shiftleft("part", 33)).alias("place"))


def symbol(role: Column, text: Column, fresh: Column) -> Column:
    """What the grammar sees of a row: ``b`` blank or ``d`` duplicate, which must go; else its initial (``o``: another one), a capital if truncated."""
    last = F.right(trimmed(text), F.lit(1))
    initial = F.when(F.left(role, F.lit(1)).isin("s", "u", "a"), F.left(role, F.lit(1))).otherwise("o")
    return F.when(last == "", "b").when(~fresh, "d").when(~last.isin(".", "!", "?"), F.upper(initial)).otherwise(initial)


def pieces(rows: DataFrame) -> DataFrame:
    """Written pieces of placed rows: ``conv_id``, ``block``, ``piece`` (its first place), ``rows`` and ``signs``."""
    block = lambda c: F.shiftright(c, PIECE_BITS).alias("block")
    texts = [F.xxhash64(F.lit(salt), "text").alias(f"t{salt}") for salt in (1, 2)]  # 128 bits tell texts apart
    filled = rows.where(trimmed("text") != "").select("conv_id", "role", *texts, "place")
    firsts = filled.groupBy("conv_id", "role", "t1", "t2").agg(F.min("place").alias("first"))
    none = rows.select("conv_id", block("place"), F.struct("place", "role", "text").alias("row"), F.lit(None).cast("bigint").alias("first"))
    both = none.unionByName(firsts.select("conv_id", block("first"), F.lit(None).cast(none.schema["row"].dataType).alias("row"), "first"))
    grouped = both.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.collect_list("first").alias("fresh"))
    signs = F.transform("rows", lambda r: symbol(r["role"], r["text"], F.array_contains("fresh", r["place"])))
    return stored(grouped.select("conv_id", "block", F.col("rows")[0]["place"].alias("piece"), "rows", F.array_join(signs, "").alias("signs")))


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: every rule (p, q) -> (p, r) (r, q)."""
    out: list = [None] * 16
    for p in range(0, 16, STATES):
        for r in range(STATES):
            if one := left[p + r]:
                for q in range(STATES):
                    if two := right[STATES * r + q]:
                        way = (one[0] + two[0], one[1] + two[1])
                        if out[p + q] is None or way < out[p + q]:
                            out[p + q] = way
    return tuple(out)


def _single(ways: list[tuple[int, int, int, str]]) -> Cell:
    out: list = [None] * 16
    for p, q, cost, audit in ways:
        out[STATES * p + q] = min(out[STATES * p + q] or WORST, (cost, audit))
    return tuple(out)


@functools.cache
def closure() -> Cell:
    """Cheapest insertions from state to state; more than two in a row never pay."""
    cell = _single([(p, p, 0, "") for p in range(STATES)] + [(p, q, INSERT, "I") for (p, initial), q in STEPS.items() if initial != "s"])
    return joined(cell, cell)


@functools.cache
def row_cell(sign: str) -> Cell:
    """Edits of one row, with insertions on both sides."""
    ways = [(p, p, DELETE, "D") for p in range(STATES)]
    if sign not in "bd":
        extra = TRUNCATED if sign.isupper() else 0
        ways += [(p, q, KEEP + extra, "K") for (p, initial), q in STEPS.items() if initial == sign.lower()]
        ways += [(p, q, REROLE + extra, "R") for (p, initial), q in STEPS.items() if initial != "s"]
    return joined(joined(closure(), _single(ways)), closure())


@functools.lru_cache(maxsize=1 << 14)
def _short_cell(signs: str) -> Cell:
    if len(signs) == 1:
        return row_cell(signs)
    half = 1 << ((len(signs) - 1).bit_length() - 1)
    return joined(_short_cell(signs[:half]), _short_cell(signs[half:]))


def folded(cells: list[Cell]) -> Cell:
    """One cell of neighbouring spans, combined in pairs."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def span_cell(signs: str) -> Cell:
    """The cell of a span of rows, bottom-up by span length; short spans are remembered."""
    return folded([_short_cell(signs[i : i + 8]) for i in range(0, len(signs), 8)]) if signs else closure()


def best(cell: Cell) -> tuple[int, str, int]:
    """Cheapest (cost, audit) of a whole conversation, and the state it ends in."""
    return min((*cell[q], q) for q in FINAL if cell[q])


def states_between(cells: list[Cell], p: int, q: int) -> list[int]:
    """States before, between and after neighbouring spans on the cheapest way from p to q."""
    ways: dict[int, tuple] = {p: (0, "", (p,))}
    for cell in cells:
        onward: dict[int, tuple] = {}
        for r, (cost, audit, states) in ways.items():
            for t in range(STATES):
                if step := cell[STATES * r + t]:
                    onward[t] = min(onward.get(t, (*WORST, ())), (cost + step[0], audit + step[1], (*states, t)))
        ways = onward
    return list(ways[q][2])


def edited(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The turns that ``audit`` leaves of ``rows``, from ``state`` on."""
    out, left = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        initial = row["role"][:1] if edit == "K" else "a" if state == 2 else "u"
        state = STEPS[state, initial]
        role = row["role"] if edit == "K" else {"u": "user", "a": "assistant"}[initial]
        out.append({"role": role, "text": row["text"] if row else "", "edit": edit})
    return out


def _listed(cell: Cell) -> list:
    return [c and {"cost": c[0], "audit": c[1]} for c in cell]


def _cell(listed: list) -> Cell:
    return tuple(c and (c["cost"], c["audit"]) for c in listed)


def _mapped(df: DataFrame, each: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``each`` makes of one row, by Arrow batches."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in each(row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], names=arrow.names)

    return df.mapInArrow(emit, schema)


def _parse_long(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of several pieces: (``conv``, ``cost``, ``audit``) and (``conv``, ``node``, ``state``, ``part``) from their ``signs``."""
    cells = materialize(_mapped(nodes.select("conv", "node", "signs"), lambda r: [(r["conv"], r["node"], _listed(span_cell(r["signs"])))], f"conv bigint, node bigint, cell {CELL}"))
    levels = []
    while cells.agg(F.max("node")).first()[0]:
        up = F.shiftright("node", FAN_BITS).alias("up")
        group = cells.groupBy("conv", up).agg(F.array_sort(F.collect_list(F.struct("node", "cell"))).alias("kids"))
        levels.append(materialize(group))
        fold = lambda r: [(r["conv"], r["up"], _listed(folded([_cell(k["cell"]) for k in r["kids"]])))]
        cells = materialize(_mapped(levels[-1], fold, f"conv bigint, node bigint, cell {CELL}"))

    def top(r: dict) -> list[tuple]:
        cost, audit, q = best(_cell(r["cell"]))
        return [(r["conv"], r["node"], 0, q, cost, audit)]

    found = materialize(_mapped(cells, top, "conv bigint, node bigint, p int, q int, cost bigint, audit string"))

    def split(r: dict) -> list[tuple]:
        kids = [_cell(k["cell"]) for k in r["kids"]]
        states = states_between(kids, r["p"], r["q"])
        return [(r["conv"], k["node"], p, q, c[STATES * p + q][1]) for k, c, p, q in zip(r["kids"], kids, states, states[1:], strict=False)]

    ways = found.select("conv", F.col("node").alias("up"), "p", "q")
    for group in reversed(levels):
        ways = materialize(_mapped(group.join(ways, ["conv", "up"]), split, "conv bigint, node bigint, p int, q int, part string"))
        last, ways = ways, ways.select("conv", F.col("node").alias("up"), "p", "q")
    return found.select("conv", "cost", "audit"), last.select("conv", "node", F.col("p").alias("state"), "part")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and repaired pieces of a table of turns (see ``damage`` for its columns).

    Summaries: ``conv_id``, ``conv`` (its first place), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost`` and ``audit``. Pieces: ``conv``, ``node`` (from 0) and ``messages`` (role, text, edit), in order."""
    small_batches(turns.sparkSession, rows=256)
    rows = materialize(in_order(turns))
    cut = pieces(rows)
    count = lambda pattern: F.regexp_count("signs", F.lit(pattern)).cast("bigint")
    initials = F.transform("rows", lambda r: F.left(r["role"], F.lit(1)))
    pairs = F.zip_with(F.slice(initials, 1, F.size("rows") - 1), F.slice(initials, 2, F.size("rows")), lambda a, b: F.concat(a, b))  # noqa: PLW0108
    illegal = F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au"))).cast("bigint")
    facts = [count("b").alias("blank"), count("d").alias("duplicate"), count("[SUAO]").alias("truncated"), illegal.alias("inside")]
    small = cut.select("conv_id", "block", "piece", "signs", *facts, F.element_at(initials, 1).alias("head"), F.element_at(initials, -1).alias("tail"))
    small = materialize(small)
    convs = small.groupBy("conv_id").agg(F.min("piece").alias("conv"), F.min("block").alias("first"), F.count("*").alias("n")).withColumnRenamed("conv_id", "c")
    placed = materialize(small.join(convs, small["conv_id"].eqNullSafe(convs["c"])).withColumn("node", F.col("block") - F.col("first")).drop("c", "block", "first"))

    alone = placed.where("n = 1")
    parsed = materialize(_mapped(alone.select("conv", "signs"), lambda r: [(r["conv"], *best(span_cell(r["signs"]))[:2])], "conv bigint, cost bigint, audit string"))
    ways = parsed.select("conv", F.lit(0).cast("bigint").alias("node"), F.lit(0).alias("state"), F.col("audit").alias("part"))
    seams = None
    if long := placed.where("n > 1").limit(1).count():
        parsed_long, ways_long = _parse_long(placed.where("n > 1"))
        parsed, ways = parsed.unionByName(parsed_long), ways.unionByName(ways_long)
        after = placed.where("n > 1").select("conv", (F.col("node") - 1).alias("node"), F.col("head").alias("next"))
        met = placed.where("n > 1").join(after, ["conv", "node"]).where(~F.concat("tail", "next").isin("su", "ua", "au"))
        seams = met.groupBy("conv").agg(F.count("*").alias("between"))

    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "inside")]
    totals = placed.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), *sums)
    totals = totals.join(seams, "conv", "left") if long else totals.withColumn("between", F.lit(0))
    spans = rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("kinds"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("kinds"), F.lit(0)).alias("gaps")
    summary = totals.join(parsed, "conv").join(spans, F.col("conv_id").eqNullSafe(F.col("c")))
    summary = summary.select("conv_id", "conv", gaps, "blank", "duplicate", "truncated", (F.col("inside") + F.coalesce("between", F.lit(0))).alias("illegal"), "cost", "audit")

    named = placed.select("piece", "conv", "node").join(ways, ["conv", "node"])
    work = cut.select("piece", "rows").join(named, "piece").select("conv", "node", "rows", "part", "state")
    messages = _mapped(work, lambda r: [(r["conv"], r["node"], edited(r["rows"], r["part"], r["state"]))], f"conv bigint, node bigint, messages {MESSAGES}")
    return summary, messages


def digests(messages: DataFrame) -> DataFrame:
    """``conv`` and the SHA-256 of its repaired ``role:text`` turns, newline-joined.

    Rows of a conversation stream through one task in order; no conversation is held in memory."""
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    lines = messages.where(F.size("messages") > 0).select("conv", "node", F.array_join(line, "\n").alias("lines"))
    sorted_ = lines.repartition("conv").sortWithinPartitions("conv", "node")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, done = None, None, []
        for batch in batches:
            for c, text in zip(batch.column("conv").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if c == conv:
                    digest.update(b"\n" + text.encode())
                    continue
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["conv", "digest"])
                done = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv", "digest"])

    return sorted_.mapInArrow(emit, "conv bigint, digest string")


def report(turns: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``turns``: the summary of the repair of its ``damaged`` rows and ``repaired_sha256``."""
    summary, messages = repair(damaged)
    found = summary.join(digests(messages), "conv", "left").withColumnRenamed("conv_id", "c")
    ids = turns.select("conv_id").distinct()
    whole = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", empty).alias("repaired_sha256"))
