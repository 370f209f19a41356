"""What grows with the table stays out of the driver, and tasks grow in number instead of size."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cellwise import session as S
from cellwise.operators import cells as C
from cellwise.operators import detection as D
from cellwise.operators import features as E
from cellwise.operators import privacy as V
from cellwise.operators import rebuild as R
from cellwise.operators import utility as L

RECORDS = {"train": [{"a": "x", "b": i} for i in range(6)], "test": [{"a": "y"}], "synth": [{"b": 2}, {"a": True}]}


def joins(df):
    """Broadcast joins of the plan as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_onehot_does_not_broadcast_records(spark, to_records):
    base = S.materialize(to_records(**RECORDS))
    typed = S.materialize(C.typed_view(C.flatten(base, max_depth=1)))
    columns = S.materialize(E.informative_columns(typed, base.agg(F.count(F.lit(1)))))
    out = E.encode_onehot(typed, columns, base)
    assert joins(out) == 0
    assert {r["name"] for r in out.filter("rid = 7").collect()} == {"a.cat_NaN", "a.dtype_missing", "b.dtype_num"}


def test_targets_do_not_broadcast_records(spark, to_records):
    base = S.materialize(to_records(**RECORDS))
    found = L.target_values(C.flatten(base, max_depth=1), base, "b", "regression")
    assert joins(found) == 0
    assert {r["rid"]: r["target"] for r in found.collect()} == {**{i: float(i) for i in range(6)}, 6: None, 7: 2.0, 8: None}


def test_a_scan_has_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 10, raising=False)
    rows = S.materialize(spark.range(1000).withColumnRenamed("id", "rid"))
    assert S.spread(rows, "rid").rdd.getNumPartitions() == 100
    assert S.spread(rows, "rid").agg(F.sum("rid")).first()[0] == 499500


def test_records_of_one_shape_are_folded_once(monkeypatch):
    calls = []
    fold = R.folded_record
    monkeypatch.setattr(R, "folded_record", lambda *a: calls.append(a) or fold(*a))
    folded = R.Folder({"": ["items"]})
    paths = ["b.x", "a", "c\0.0"]
    for i in range(50):
        got = folded(paths, [str(i), f'"t{i}"', "null"], [None] * 3, [None] * 3)
        assert json.loads(got) == {"a": f"t{i}", "b": {"x": i}, "c\0": [None], "items": []}
    assert len(calls) == 1


def test_folded_shapes_agree_with_single_folds():
    empty = {"": ["l"], "o": ["m"]}
    records = [
        [("o", '{"z":1}', "object", None), ("o.k", "1", "num", None), ("l", "[]", "array", 0)],
        [("o", None, "object", None), ("o.k", "1", "num", None), ("l", None, "array", 2), ("l.1", "5", "num", None)],
        [("o", "3", "num", None), ("o.k", "1", "num", None)],
        [("a", '"x"', None, None), ("a", '"b"', None, None)],
        [("a", '"x"', None, None), ("a", None, None, None)],
        [("o.k", "1", None, None)],
        [("o.k", None, None, None)],
    ]
    folded = R.Folder(empty)
    for _ in range(2):
        for cells in records:
            assert folded(*map(list, zip(*cells))) == R.folded_record(cells, empty)


def test_cells_are_typed_by_their_text(spark):
    values = ["1", "-1.5", "true", "false", "null", '"x"', '"2020-01-02"', '"{"', "[]", "{}", "[1]"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "rid int, doc string").select("rid", F.parse_json("doc").alias("v"))
    dates = spark.sql("SELECT 20 AS rid, cast(date'2020-01-02' AS variant) AS v UNION ALL SELECT 21, cast(double('-Infinity') AS variant) UNION ALL SELECT 22, cast(double('NaN') AS variant) UNION ALL SELECT 23, cast(X'00' AS variant)")
    got = C.type_cells(rows.unionByName(dates).selectExpr("rid", "'p' AS path", "1 AS depth", "v"), ["rid"])
    from cellwise.functions.expr import cell_dtype

    want = {r["rid"]: r["d"] for r in rows.unionByName(dates).select("rid", cell_dtype(F.col("v")).alias("d")).collect()}
    assert {r["rid"]: r["dtype"] for r in got.collect()} == want


def test_folds_are_dealt_without_entries(spark, to_records, monkeypatch):
    """The entries of the records meet the folds once, and are not moved to deal them."""
    base = S.materialize(to_records(train=[{"a": i % 3, "b": i} for i in range(30)], synth=[{"a": i % 2, "b": -i} for i in range(30)]))
    seen, deal = [], D.with_folds
    monkeypatch.setattr(D, "with_folds", lambda rows, *a: seen.append(rows.columns) or deal(rows, *a))
    fitted = D.boosted_folds(C.flatten(base, max_depth=1), base, 3, 42, "train", "synth")
    assert seen == [["rid", "split"]]
    assert fitted.predictions.count() == 60


def test_entries_are_gathered_once_for_all_models(spark, monkeypatch):
    entries = spark.createDataFrame([(i, "x.num", float(i)) for i in range(8)] + [(0, "y.cat_a", 1.0)], "rid bigint, name string, value double")
    folds = spark.createDataFrame([(i, m) for i in range(8) for m in (0, 1) if i % 2 != m], "rid bigint, model int")
    each = spark.createDataFrame([(i, m) for i in range(9) for m in (0, 1)], "rid bigint, model int")
    facts = S.materialize(D.scaling_facts(entries, folds))
    plans, keep = [], D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, *a, **k))
    rows = D.sparse_rows(entries, D.feature_numbers(entries), facts, each, 2)
    gathered = [line for line in plans[-1].splitlines() if "collect_list" in line]
    assert gathered and all("Aggregate [rid" in line for line in gathered)
    known = {(r["model"], r["name"]): r for r in facts.collect()}
    for r in rows.collect():
        fact = known[r["model"], "x.num"]
        value = (r["rid"] - fact["centre"]) / fact["width"]
        want = {0: value} if value and r["rid"] < 8 else {}
        if r["rid"] == 0 and (r["model"], "y.cat_a") in known:
            want[1] = 1.0 / known[r["model"], "y.cat_a"]["width"]
        assert dict(zip(r["features"].indices.tolist(), r["features"].values.tolist())) == want


def test_open_leaves_are_kept_without_vectors(spark, monkeypatch):
    rng = random.Random(4)
    points = [(i, "synth" if i % 3 == 0 else ("train", "test")[i % 2], [0, 1, 2, 3], [rng.random() for _ in range(4)]) for i in range(1500)]
    vectors = S.materialize(spark.createDataFrame(points, "rid bigint, split string, idx array<bigint>, val array<double>").withColumn("vec", F.md5(F.col("rid").cast("string").cast("binary"))))
    ranked, keep = [], V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, *a: ranked.append(df.columns) or keep(df, *a))
    got = {r["rid"]: (r["d_train"], r["d_test"]) for r in V.dcr_distances(vectors, fan=4, leaf_rows=16).collect()}
    assert [c for c in ranked if "r" in c] and not [c for c in ranked if "r" in c and "idx" in c]
    near = lambda p, side: min(math.dist(p, x) for _, s, _, x in points if s == side)
    for rid, split, _, p in points:
        if split == "synth":
            assert got[rid] == pytest.approx((near(p, "train"), near(p, "test")), abs=1e-9)
