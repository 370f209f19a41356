"""Flattening, typing, merging and rebuilding on small literal records."""

import json

import pytest
from pyspark.sql import functions as F

from cellwise.operators import cells as C
from cellwise.operators import rebuild as R


def cell_map(cells, value="json"):
    return {r["path"]: r[value] for r in cells.collect()}


@pytest.mark.parametrize(
    "record, leaves, everything",
    [
        ({"items": [{"x": 1}, {"x": 2}]}, {"items.0.x": "1", "items.1.x": "2"},
         {"items": '[{"x":1},{"x":2}]', "items.0": '{"x":1}', "items.1": '{"x":2}', "items.0.x": "1", "items.1.x": "2"}),
        ({"users": [{"name": "Al"}]}, {"users.0.name": '"Al"'},
         {"users": '[{"name":"Al"}]', "users.0": '{"name":"Al"}', "users.0.name": '"Al"'}),
        ({"a": [], "b": {}, "c": None}, {"c": "null"}, {"a": "[]", "b": "{}", "c": "null"}),
        ({"m": [[1, 2], [3]]}, {"m.0.0": "1", "m.0.1": "2", "m.1.0": "3"},
         {"m": "[[1,2],[3]]", "m.0": "[1,2]", "m.1": "[3]", "m.0.0": "1", "m.0.1": "2", "m.1.0": "3"}),
    ],
)
def test_flatten(to_records, record, leaves, everything):
    records = to_records(train=[record])
    assert cell_map(C.flatten(records, leaf_only=True, with_json=True)) == leaves
    assert cell_map(C.flatten(records, with_json=True)) == everything


def test_depth_limit_raises_instead_of_cutting(to_records):
    with pytest.raises(Exception, match="max_depth"):
        C.flatten(to_records(train=[{"a": {"b": {"c": 1}}}]), max_depth=1).collect()


def test_cell_dtypes(to_records):
    record = {"n": None, "b": True, "i": 42, "f": 3.14, "s": "hello", "d": "2024-01-02", "t": "2024-01-02T03:04:05Z",
              "odd": "2024-01-02abc", "l": [1], "o": {"k": 1}}
    cells = C.flatten(to_records(train=[record]))
    dtypes = cell_map(cells, "dtype")
    assert {k: dtypes[k] for k in record} == {
        "n": "null", "b": "bool", "i": "num", "f": "num", "s": "cat", "d": "date", "t": "date", "odd": "date",
        "l": "array", "o": "object",
    }
    # an unparseable date keeps its dtype row and has no value row
    cols = {r["col"] for r in C.separate_types(cells).collect()}
    assert "odd.dtype" in cols and "odd.date" not in cols and "t.date" in cols


def test_separation_and_homogeneity(to_records):
    records = to_records(train=[{"v": 42, "w": 1, "z": 1}, {"v": "text", "w": None, "z": 2}, {"v": 7, "w": 3}])
    rows = {r["path"]: r for r in C.homogeneous_paths(C.flatten(records), 3).collect()}
    assert not rows["v"]["passthrough"]  # two value types
    assert rows["w"]["passthrough"]  # one value type and explicit nulls
    assert not rows["z"]["passthrough"]  # absent somewhere
    kept = C.numeric_null_as_missing(C.flatten(records)).filter("path = 'w'")
    assert kept.count() == 2


@pytest.mark.parametrize(
    "records",
    [
        [{"a": 1}, {"a": 2.5}],
        [{"a": "x"}, {"a": "y"}],
        [{"a": None}, {"a": 1}, {"a": "x"}],
        [{"a": 42}, {"a": "text"}, {"a": True}],
        [{"a": True}, {"a": None}],
        [{"a": None}, {"a": None}],
        [{"a": [1, 2], "b": {"c": []}}, {"a": [], "b": {"c": [{"d": 'q"uote'}]}}, {"b": {}}],
    ],
)
def test_typed_round_trip(to_records, records):
    base = to_records(train=records)
    typed = C.typed_view(C.flatten(base))
    back = R.merge_records(typed, 4).orderBy("rid").collect()
    got = {r["rid"]: json.loads(r["json"]) for r in back}
    assert got == {i: rec for i, rec in enumerate(records) if rec}


def test_leaf_round_trip_restores_empty_arrays(spark, to_records):
    records = [
        {"issue": {"title": "t", "assignees": [{"login": "x"}]}},
        {"issue": {"title": "u", "assignees": []}},
        {"other": 1},
    ]
    leaves = C.flatten(to_records(train=records), leaf_only=True, with_json=True)
    got = {r["rid"]: json.loads(r["json"]) for r in R.unflatten_leaves(leaves, 4).collect()}
    assert got == dict(enumerate(records))


def test_gaps_are_packed_and_digit_keys_become_lists(spark):
    cells = spark.createDataFrame([(1, "arr.0", '"a"'), (1, "arr.2", '"c"'), (1, "arr.10", '"z"'), (1, "o.k", "1")], "rid bigint, path string, json string")
    out = R.fold(cells, 2, ["rid"]).first()["json"]
    assert json.loads(out) == {"arr": ["a", "c", "z"], "o": {"k": 1}}


def test_container_value_wins(spark):
    cells = spark.createDataFrame(
        [(1, "scores", "array", "[1,2]"), (1, "scores.0", "num", "1"), (1, "scores.1", "num", "9"), (1, "n", "num", "5")],
        "rid bigint, path string, dtype string, json string",
    )
    assert json.loads(R.unflatten_all(cells, ["rid"]).first()["json"]) == {"scores": [1, 2], "n": 5}


def test_merge_needs_agreement_and_restores_bools(spark):
    rows = [
        (1, "a", "dtype", None, "num"), (1, "a", "cat", None, "x"),  # dtype without its value: absent
        (1, "b", "dtype", None, "bool"), (1, "b", "bool", 0.0, None),
        (2, "b", "dtype", None, "bool"), (2, "b", "bool", None, "True"),
        (2, "c", "dtype", None, "null"),
    ]
    typed = spark.createDataFrame(rows, "rid bigint, path string, typ string, x double, s string")
    got = {(r["rid"], r["path"]): r["json"] for r in R.merge_types(typed, ["rid"]).collect()}
    assert got == {(1, "b"): "false", (2, "b"): "true", (2, "c"): "null"}


def test_nested_predicates(to_records):
    flat = C.nested_predicates(C.flatten(to_records(train=[{"a": 1}]))).first()
    assert not flat["is_nested"] and not flat["has_flattened_columns"]
    deep = C.nested_predicates(C.flatten(to_records(train=[{"a": {"b": 1}}]))).first()
    assert deep["is_nested"] and deep["has_flattened_columns"]


def test_each_record_is_rebuilt_in_its_own_mode(spark):
    rows = [
        (1, "a", "array", "[]"), (1, "b.x", "num", "1"), (1, "b", "object", '{"x":1,"y":2}'),
        (2, "a.0", "num", "7"), (2, "a.1", "num", "8"), (2, "b.x", "num", "1"),
        (3, "b.x", "num", "2"),
    ]
    cells = spark.createDataFrame(rows, "rid bigint, path string, dtype string, json string")
    got = {r["rid"]: json.loads(r["json"]) for r in R.unflatten(cells, ["rid"]).collect()}
    assert got == {1: {"a": [], "b": {"x": 1, "y": 2}}, 2: {"a": [7, 8], "b": {"x": 1}}, 3: {"a": [], "b": {"x": 2}}}


def test_equal_paths_give_one_member(spark):
    cells = spark.createDataFrame([(1, "a.b", "1"), (1, "a.b", "2"), (1, "a.c", "3")], "rid bigint, path string, json string")
    assert R.fold(cells, keys=["rid"]).first()["json"] == '{"a":{"b":1,"c":3}}'


def test_flatten_reads_records_once_at_any_depth(to_records):
    deep = {"x": 1}
    for i in range(12):
        deep = {f"k{i}": deep, "s": 'a"[{\\'} if i % 2 else {"l": [deep, {}, "]"]}
    base = to_records(train=[deep, {"z": []}])
    plan = C.flatten(base)._jdf.queryExecution().toString()
    assert plan.count("Generate explode") >= 1
    physical = plan[plan.index("== Physical Plan"):]
    assert physical.count("Scan") == 1 and physical.count("Generate") == 1
    leaves = {r["path"] for r in C.flatten(base).filter("dtype = 'num'").collect()}
    assert any(p.count(".") > 12 for p in leaves)
    back = {r["rid"]: json.loads(r["json"]) for r in R.unflatten_all(C.flatten(base, with_json=True)).collect()}
    assert back == {0: deep, 1: {"z": []}}
    with pytest.raises(Exception, match="nested deeper"):
        C.flatten(base, max_depth=5).collect()


def test_names_are_quoted_as_spark_does(spark):
    names = ["plain", 'q"uote', "tab\tline\n", "\x01\x1f", "é€", "a/b", " "]
    rows = [(1, n, "1") for n in names]
    out = R.fold(spark.createDataFrame(rows, "rid bigint, path string, json string"), keys=["rid"])
    quoted = spark.createDataFrame([(n,) for n in names], "n string").select(F.to_json(F.array("n")).alias("j")).collect()
    text = out.first()["json"]
    assert all(r["j"][1:-1] + ":1" in text for r in quoted)


def test_columns_are_kept_or_separated(to_records):
    base = to_records(train=[{"a": 1, "b": "x", "c": [1]}, {"a": 2.5, "b": 3, "c": []}, {"a": 3, "b": None, "c": [2]}])
    cells = C.flatten(base, with_json=True, max_depth=2).filter("depth = 1")
    cols = lambda **k: {r["col"] for r in C.separate_columns(cells, 3, **k).collect()}
    assert cols() == {"a", "b.dtype", "b.num", "b.cat", "c"}
    assert cols(force=True) == {"a.dtype", "a.num", "b.dtype", "b.num", "b.cat", "c.dtype", "c.alen"}
    assert cols(columns=["a"]) == {"a", "b", "c"} and cols(columns=["a"], force=True) == {"a.dtype", "a.num", "b", "c"}
    kept = {(r["col"], r["typ"], r["x"], r["s"]) for r in C.separate_columns(cells, 3, columns=[]).collect()}
    assert {("b", "cat", None, "x"), ("b", "num", 3.0, None), ("b", "null", None, None), ("c", "array", None, "[]")} <= kept


def test_absent_arrays_are_joined_when_fields_are_too_many(spark, monkeypatch):
    rows = [(1, "a", "array", "[]"), (2, "a.0", "num", "7"), (2, "b.x", "num", "1"), (3, "b.x", "num", "2"), (3, "b.l.0", "num", "1"), (4, "b.x", "num", "5")]
    cells = spark.createDataFrame(rows, "rid bigint, path string, dtype string, json string")
    read = lambda: {r["rid"]: json.loads(r["json"]) for r in R.unflatten(cells, ["rid"]).collect()}
    want = {1: {"a": []}, 2: {"a": [7], "b": {"x": 1, "l": []}}, 3: {"a": [], "b": {"x": 2, "l": [1]}}, 4: {"a": [], "b": {"x": 5, "l": []}}}
    assert read() == want
    monkeypatch.setattr(R, "SMALL_TABLE_BYTES", -1)
    assert read() == want
