"""Data set catalogue: where records live and what they are evaluated on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators.splitting import resplit_half, split_random
from cellwise.session import materialize
from cellwise.sources import fixtures
from cellwise.sources.records import read_lines


@dataclass(frozen=True)
class DataSet:
    name: str
    target: str | None
    task: str  # binclass, multiclass, regression or none
    tabular: bool
    split_ratio: float = 0.9
    canonical_split: bool = False
    path: str | None = None


class Catalog:
    """Named data sets; a new one is added with ``register``."""

    def __init__(self) -> None:
        self._sets: dict[str, DataSet] = {}

    def register(self, entry: DataSet) -> None:
        self._sets[entry.name] = entry

    def names(self) -> list[str]:
        return list(self._sets)

    def get(self, name: str) -> DataSet:
        if name not in self._sets:
            raise ValueError(f"Unknown dataset: {name}. Available: {', '.join(self._sets)}")
        return self._sets[name]


CATALOG = Catalog()
for _entry in (
    DataSet("events", "type", "multiclass", tabular=False),
    DataSet("orders", "status", "multiclass", tabular=False),
    DataSet("conversations", None, "none", tabular=False),
):
    CATALOG.register(_entry)

VIEWS = {"events": fixtures.event_docs, "orders": fixtures.order_docs, "conversations": fixtures.conv_docs}


def load_documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    CATALOG.get(name)
    return VIEWS[name](spark, sf_dir)


def load_set(spark: SparkSession, entry: DataSet | str, seed: int = 42, dcr: bool = False) -> DataFrame:
    """Records (``rid``, ``split``, ``v``) of a data set from the JSON lines under its own path.

    With a canonical split, ``train.jsonl`` and ``test.jsonl`` are kept apart; else all ``*.jsonl`` are split by the set's ratio.
    ``dcr`` merges all rows and cuts them into halves. A corrupt line is an error."""
    entry = CATALOG.get(entry) if isinstance(entry, str) else entry
    if not entry.path:
        raise ValueError(f"Dataset {entry.name} has no path")
    parts = ("train", "test") if entry.canonical_split else ("*",)
    rows = None
    for part in parts:
        parsed = read_lines(spark, f"{entry.path}/{part}.jsonl")
        sound = F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("corrupt line in "), F.col("file")))).otherwise(F.col("v"))
        tagged = parsed.select(F.lit(part).alias("split"), sound.alias("v"))
        rows = tagged if rows is None else rows.unionByName(tagged)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "split", "v"))
    if dcr:
        halves = resplit_half(rows.filter(F.col("split") == parts[0]), rows.filter(F.col("split") != parts[0]), seed)
        return halves.select("rid", F.col("part").alias("split"), "v")
    if entry.canonical_split:
        return rows
    return split_random(rows, entry.split_ratio, seed).select("rid", F.col("part").alias("split"), "v")
