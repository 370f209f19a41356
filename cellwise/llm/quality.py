"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes 1 (good), 0 (bad) or abstains (-1) on a document. Expectation-maximisation of a
two-class model with independent votes estimates how often each rule gives each vote on good and on
bad documents; the posterior probability of "good" then replaces a demand that all rules pass. The
model sees documents only through their vote patterns, so each step sums over the table of distinct
patterns (3 to the number of rules at most), whatever the corpus.

Edge cases: a null text counts as empty, has no words and fails the base rule; ids may be null or
repeat (a row is judged by its text alone); an empty table gives an empty result; columns of the
input named like a feature are left alone by ``judge``, which returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.session import materialize

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
ROUNDS = 30
PRIOR = 0.85


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array."""

    def covered(windows: Column) -> Column:
        spots = _let(
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.transform(
                F.filter(s, lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, i + 1)["h"] == x["h"]), F.lit(False))),
                lambda x: x["i"],
            ),
        )
        return _let(spots, lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))


def _symbol_words(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.translate(w, SYMBOLS, "") != w)).cast("bigint")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts in ``FEATURES`` for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaces = " " * len(SEPARATORS)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    words = F.array_remove(F.split(F.translate("text", SEPARATORS, spaces), " "), "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(F.translate(line, SEPARATORS, spaces)) != "")
    measured = base.select(
        "doc_id",
        _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).cast("bigint").alias("r"), _symbol_words(w).alias("s"))).alias("w"),
        F.length(F.translate("text", SEPARATORS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("bigint").alias("n_marks"),
    )
    return measured.select("doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"), "n_upper", "n_marks", F.col("w.s").alias("n_symbol_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, -1 abstains. A rule abstains between its two bounds or where it has too little to go by."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    enough = F.col("n_words") >= 20
    return {
        "length": _vote(F.col("n_words") >= 50, F.col("n_words") < 5),
        "symbols": _vote(F.col("n_symbols") * 50 < words, F.col("n_symbols") * 5 > words),
        "symbol_chars": _vote(F.col("n_symbols") * 200 < chars, F.col("n_symbols") * 30 > chars),
        "symbol_words": _vote(F.col("n_symbol_words") * 30 < words, F.col("n_symbol_words") * 5 > words),
        "repeated_words": _vote(enough & (F.col("n_repeat_words") * 10 < words), F.col("n_repeat_words") * 10 > 3 * words),
        "repeated_lines": _vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") >= 3),
        "capitals": _vote(F.col("n_upper") * 8 < chars, F.col("n_upper") * 4 > chars),
        "exclamations": _vote(F.col("n_marks") * 50 < words, F.col("n_marks") * 5 > words),
        "word_length": _vote(enough & F.col("word_chars").between(3 * words, 10 * words), (F.col("word_chars") > 20 * words) | (F.col("word_chars") < 2 * words)),
    }


def fit(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[float, list[list[list[float]]]]:
    """Share of good documents and, per rule, vote probabilities ([0, 1, -1] if bad, [0, 1, -1] if good).

    ``patterns`` counts the distinct vote patterns. The start says what the rules are meant to be: a good
    document fails a rule one time in fifty, a bad one three times in ten. Add-one smoothing keeps
    probabilities inside (0, 1).
    """
    share, total = prior, sum(patterns.values())
    table = [[[0.3, 0.6, 0.1], [0.02, 0.88, 0.1]] for _ in next(iter(patterns), ())]
    for _ in range(rounds if total else 0):
        weights = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in table]
        good = 0.0
        for votes, n in patterns.items():
            odds = log(share / (1 - share)) + sum(log(t[1][v] / t[0][v]) for t, v in zip(table, votes, strict=True))
            p = 1 / (1 + exp(-odds))
            good += n * p
            for w, v in zip(weights, votes, strict=True):
                w[0][v] += n * (1 - p)
                w[1][v] += n * p
        before, share = share, (good + 1) / (total + 2)
        table = [[[x / sum(side) for x in side] for side in w] for w in weights]
        if abs(before - share) < 1e-9:
            break
    return share, table


def posterior(share: float, table: dict[str, list[list[float]]]) -> Column:
    """Probability of "good" given the vote columns named in ``table``."""
    odds = F.lit(log(share / (1 - share)))
    for name, (bad, good) in table.items():
        gain = [log(g / b) for g, b in zip(good, bad, strict=True)]
        odds = odds + F.when(F.col(name) == 0, gain[0]).when(F.col(name) == 1, gain[1]).otherwise(gain[2])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per row: ``doc_id``, the counts, the votes, ``base_failed``, the posterior ``quality`` and ``kept``."""
    votes = rules()
    measured = materialize(features(docs, id_col, text_col).select("*", *(v.alias(f"vote_{k}") for k, v in votes.items())))
    names = [f"vote_{k}" for k in votes]
    counts = measured.groupBy(*names).count().collect()  # at most 3 ** len(names) rows
    share, fitted = fit({tuple(row[:-1]): row[-1] for row in counts})
    table = dict(zip(names, fitted, strict=False))
    failed = F.coalesce(base_failed(), F.lit(True))
    return measured.withColumn("base_failed", failed).withColumn("quality", posterior(share, table)).withColumn("kept", ~failed & (F.col("quality") >= least))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, unchanged.

    A verdict follows from the text alone, so rows meet their verdict by 128 bits of hashes of it:
    no copy of the texts is written, and equal texts share one verdict row.
    """
    def marks(column: Column) -> list[Column]:
        return [F.xxhash64(column), F.xxhash64(F.lit(1), column, F.lit(2))]

    verdicts = judge(docs.select(F.struct(*[m.alias(f"m{i}") for i, m in enumerate(marks(docs[text_col]))]).alias("doc_id"), docs[text_col].alias("text")))
    # written, so that both sides of the join are plain exchanges and a frequent text can be split
    kept = materialize(verdicts.where("kept").select("doc_id.*").distinct().withColumnsRenamed({"m0": "m0_", "m1": "m1_"}))
    one, two = marks(docs[text_col])
    return docs.join(kept, (one == kept["m0_"]) & (two == kept["m1_"]), "left_semi")
