"""Repair of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from cellwise.llm import repair
from cellwise.llm.queries import op12_repair

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, node int, conv string, cost double, rows int"


def spoil(rows):
    """Rows after the planted faults, in the order of the conversations."""
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def kinds(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "sound")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Forward search over (rows done, state): cheapest cost, smallest audit and its turns."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, turns) in list(ways.items()):
                for i in "ua":
                    if (state, i) in step:
                        way = (cost + 2, audit + "I", (*turns, (names[i], "")))
                        ways[step[state, i]] = min(ways.get(step[state, i], way), way)
        return ways

    ways = inserted({"": (0, "", ())})
    for (_, _, role, text), kind in zip(rows, kinds(rows), strict=True):
        extra = int(kind == "truncated")
        after = {s: (c + 3, a + "D", t) for s, (c, a, t) in ways.items()}
        if kind not in ("blank", "duplicate"):
            for state, (cost, audit, turns) in ways.items():
                for i in "sua":
                    if (state, i) in step:
                        options = [(cost + extra, audit + "K", (*turns, (role, text)))] if role[:1] == i else []
                        options += [(cost + 2 + extra, audit + "R", (*turns, (names[i], text)))] if i != "s" else []
                        for way in options:
                            after[step[state, i]] = min(after.get(step[state, i], way), way)
        ways = inserted(after)
    return min(ways[s] for s in ("", "a") if s in ways)


def brute(rows):
    out = []
    damaged = spoil(rows)
    for c in {r[0] for r in rows}:
        mine = [r for r in damaged if r[0] == c]
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found = kinds(mine)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, kept = cheapest(mine)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((c, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def made(seed, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "so it", "", " \t", None, "a\nb?", "Well. \n", f"number {rng.randint(0, 9)}."])
            rows.append((c, rng.choice([t, t, t + 3, None]) if c % 3 else t, role, text))
    return rows


def compare(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in repair.report(table, repair.damage(table)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute(rows)


def test_against_brute_force(spark):
    rows = made(1)
    rows += [(None, t, "user" if t % 2 else "assistant", f"text {t % 5}.") for t in range(30)] + [(None, None, None, None)] * 3
    rows += [(900, t, "user", "again.") for t in (1, 1, 1, 2)] + [(901, None, "assistant", "x")]
    dropped = next(i for i in range(2000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")]
    compare(spark, rows)


def test_long_conversations(spark, monkeypatch):
    """Pieces of four rows and rounds of two neighbours, so that small tables take every way."""
    for name, value in (("PIECE_BITS", 2), ("FAN_BITS", 1)):
        monkeypatch.setattr(repair, name, value)
    rng = random.Random(2)
    rows = made(3, 20)
    rows += [(500, t, rng.choice(["user", "assistant", "tool"]), f"{rng.randint(0, 40)}{rng.choice(['.', ''])}") for t in range(150)]
    rows += [(501, 1, "user", "the same.")] * 40 + [(None, None, "assistant", f"{i}.") for i in range(23)]
    compare(spark, rows)


@pytest.mark.parametrize("seed", range(4))
def test_cells_do_not_depend_on_the_bracketing(seed):
    rng = random.Random(seed)
    signs = "".join(rng.choice("bdsuaoSUAO") for _ in range(12))
    whole = repair.span_cell(signs)
    cells = [repair.row_cell(s) for s in signs]
    left = cells[0]
    for c in cells[1:]:
        left = repair.joined(left, c)
    right = cells[-1]
    for c in cells[-2::-1]:
        right = repair.joined(c, right)
    assert whole == left == right
    table = {(i, i + 1): c for i, c in enumerate(cells)}  # all splits of all spans
    for n in range(2, len(cells) + 1):
        for i in range(len(cells) - n + 1):
            ways = [repair.joined(table[i, k], table[k, i + n]) for k in range(i + 1, i + n)]
            table[i, i + n] = tuple(min((w[j] for w in ways if w[j]), default=None) for j in range(16))
    assert table[0, len(cells)] == whole


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert repair.report(table, repair.damage(table)).count() == 0


def test_query(spark):
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in op12_repair(spark, at).collect()) == brute(rows)
