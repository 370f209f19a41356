"""Prepared splits with a manifest, and catalogue sets loaded by their own path."""

import json

import pytest
from pyspark.sql import functions as F

from cellwise.sources import catalog as K
from cellwise.sources import records as IO


def rows_of(df):
    return sorted((r["split"], r["t"]) for r in df.select("split", F.to_json("v").alias("t")).collect())


def test_a_failed_write_is_not_read(to_records, tmp_path):
    path = str(tmp_path / "sets")
    records = to_records(train=[{"a": 1}, {"a": 2}], test=[{"a": 3}]).select("rid", "split", "v")
    broken = records.withColumn("v", F.when(F.col("rid") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        IO.prepare_splits(broken, path)
    assert IO.read_manifest(records.sparkSession, path) is None
    first = IO.prepare_splits(records, path)
    assert rows_of(first) == [("test", '{"a":3}'), ("train", '{"a":1}'), ("train", '{"a":2}')]
    assert all(r["ok"] for r in IO.verify_splits(first, path).collect())
    other = to_records(train=[{"a": 9}]).select("rid", "split", "v")
    assert rows_of(IO.prepare_splits(other, path)) == rows_of(first)  # kept, not overwritten
    assert {r["split"]: r["ok"] for r in IO.verify_splits(first.filter("rid <> 1"), path).collect()} == {"train": False, "test": True}


def test_half_a_manifest_does_not_count(to_records, tmp_path):
    path = str(tmp_path / "sets")
    records = to_records(train=[{"a": 1}], test=[{"a": 3}]).select("rid", "split", "v")
    records.sparkSession.createDataFrame([("r0", "train", 5, 5, 2)], IO.MANIFEST).write.json(f"{path}/_manifest")
    assert len(rows_of(IO.prepare_splits(records, path))) == 2


def test_other_errors_are_passed_on(to_records, tmp_path):
    records = to_records(train=[{"a": 1}]).select("rid", "split", "v")
    with pytest.raises(Exception, match="nowhere"):
        IO.prepare_splits(records, "nowhere://x/y")
    with pytest.raises(ValueError, match="no complete preparation"):
        IO.verify_splits(records, str(tmp_path / "none"))


def test_catalogue_sets(spark, tmp_path):
    for name, ids in (("train", range(30)), ("test", range(30, 40))):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"i": i}) for i in ids))
    sizes = lambda df: {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    make = lambda **k: K.DataSet("own", None, "none", tabular=False, path=str(tmp_path), **k)
    canonical = K.load_set(spark, make(canonical_split=True))
    assert sizes(canonical) == {"train": 30, "test": 10}
    assert {r["t"] for r in canonical.filter("split = 'test'").select(F.to_json("v").alias("t")).collect()} == {f'{{"i":{i}}}' for i in range(30, 40)}
    assert sizes(K.load_set(spark, make(canonical_split=True), dcr=True)) == {"train": 20, "test": 20}
    assert sizes(K.load_set(spark, make(split_ratio=0.8))) == {"train": 32, "test": 8}
    K.CATALOG.register(make())
    assert K.load_set(spark, "own").count() == 40
    with pytest.raises(ValueError, match="no path"):
        K.load_set(spark, "events")
    (tmp_path / "train.jsonl").write_text('{"i": 1}\n{broken')
    with pytest.raises(Exception, match="corrupt line"):
        K.load_set(spark, make(canonical_split=True)).count()
