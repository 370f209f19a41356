"""Facts and checks that a specification lists."""

from cellwise.operators import specification as SP
from cellwise.operators.cells import flatten

FACTS = [
    ("gone", "missing", "a", None, None, None),
    ("gone_red", "missing", "a", "c", None, "red"),
    ("mean", "mean", "a", None, None, None),
    ("share", "share", "c", None, "red", None),
    ("levels", "distinct", "a", None, None, None),
    ("odd", "odd", "a", None, "num", None),
]


def values(spark, records):
    return {r["name"]: r["value"] for r in SP.facts(flatten(records, max_depth=1), records, SP.fact_table(spark, FACTS)).collect()}


def test_facts_and_checks(spark, to_records):
    records = to_records(train=[{"a": 1, "c": "red"}, {"a": None, "c": "red"}, {"c": "blue"}, {"a": "x"}, {"a": 3, "c": "red"}])
    got = values(spark, records)
    assert got == {"gone": 0.4, "gone_red": 1 / 3, "mean": 2.0, "share": 0.6, "levels": 3.0, "odd": 1.0}
    empty = values(spark, records.limit(0))
    assert empty["levels"] == 0.0 and empty["gone"] is None and empty["mean"] is None
    as_table = lambda d: spark.createDataFrame(list(d.items()), "name string, value double")
    checks = [
        ("few_gone", "at_most", "gone", None, 0.5, None, False),
        ("more_gone", "above", "gone", "gone_red", None, 0.5, True),
        ("mean_kept", "same", "mean", None, None, 0.5, False),
        ("undefined", "near", "none", None, 1.0, 0.5, False),
    ]
    rows = SP.audit(as_table(got), as_table({**got, "mean": 9.0}), SP.check_table(spark, checks)).collect()
    assert {r["name"]: r["status"] for r in rows} == {"few_gone": "PASS", "more_gone": "WARN", "mean_kept": "FAIL", "undefined": "FAIL"}
