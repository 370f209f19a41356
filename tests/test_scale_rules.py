"""Plans and edge cases that matter at scale: no broadcast of rows, modes kept apart, exact ids."""

import pytest
from pyspark.sql import functions as F

from cellwise.operators import reporting, splitting
from cellwise.operators.cleaning import literal_to_json
from cellwise.sources import records


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.range(20000).select(F.col("id").alias("rid"), (F.col("id") % 7).alias("kind"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "cut",
    [
        lambda r: splitting.split_random(r, 0.5),
        lambda r: splitting.subsample_equal(r),
        lambda r: splitting.subsample_cap(r, 100),
        lambda r: splitting.resplit_half(r.filter("split = 'train'"), r.filter("split = 'test'")),
        lambda r: splitting.subsample_stratified(r, 0.1, "kind"),
    ],
)
def test_rows_are_not_broadcast(rows, cut):
    out = cut(rows)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stratified_by_shuffle_equals_broadcast(rows, monkeypatch):
    first = {r.rid for r in splitting.subsample_stratified(rows, 0.1, "kind").collect()}
    monkeypatch.setattr(splitting, "BROADCAST_GROUPS", 0)
    assert {r.rid for r in splitting.subsample_stratified(rows, 0.1, "kind").collect()} == first


def test_modes_and_unranked_metrics(spark):
    values = [("d", m, mode, 1, k, v) for m, mode, k, v in [("a", "base", "utility", 0.1), ("a", "dcr", "utility", 0.9), ("b", "base", "utility", 0.5), ("a", "base", "privacy_exact_matches_train_only", 5.0)]]
    long = spark.createDataFrame(values, "dataset string, model string, mode string, replicate int, metric string, value double")
    agg = reporting.aggregate_replicates(long)
    wide = {(r["mode"], r["metric"]): (r["a"], r["b"]) for r in reporting.leaderboard_wide(agg, ["a", "b"]).collect()}
    assert wide[("base", "utility")] == ("0.100", "0.500") and wide[("dcr", "utility")] == ("0.900", "-")
    best = {(r["mode"], r["metric"], r["model"]): r["is_best"] for r in reporting.leaderboard(agg).collect()}
    assert best[("base", "utility", "b")] and not best[("base", "utility", "a")]
    assert not best[("base", "privacy_exact_matches_train_only", "a")]


def test_a_half_written_folder_is_replaced(spark, tmp_path):
    path = str(tmp_path / "prepared")
    data = spark.range(10).select("id", F.lit("train").alias("split"))
    data.limit(3).write.partitionBy("split").parquet(path)
    (tmp_path / "prepared" / "_SUCCESS").unlink()
    assert records.prepare_splits(data, path).count() == 10
    assert records.prepare_splits(data.limit(1), path).count() == 10


def test_literals_stay_json(spark):
    got = spark.createDataFrame([("1e999",), ("True",), ("[1, -1e999]",)], "t string").select(literal_to_json("t").alias("j")).collect()
    assert [r.j for r in got] == ['"1e999"', "true", '"[1, -1e999]"']


def test_long_integers_survive_type_separation(spark):
    from cellwise.operators.cells import flatten, typed_view
    from cellwise.operators.rebuild import merge_records, tabularize, untabularize

    texts = ['{"a":9007199254740993,"b":[1,-12345678901234567890]}', '{"a":"x","b":[2.5]}']
    docs = spark.createDataFrame(list(enumerate(texts)), "rid bigint, t string")
    records_ = docs.select("rid", F.lit("train").alias("split"), F.lit(1).alias("replicate"), F.parse_json("t").alias("v"))
    merged = merge_records(typed_view(flatten(records_)), 3)
    assert sorted(r["json"] for r in merged.collect()) == sorted(texts)
    flat = tabularize(flatten(records_, leaf_only=True), 2)
    assert sorted(r["json"] for r in untabularize(flat, 3).collect()) == sorted(texts)


def test_literals_by_built_ins_equal_the_parser(spark):
    from cellwise.operators.cleaning import _literal_text

    texts = ["1", "-0", "0", "007", "-12", "1.50", "True", "None", "none", "True-True", "a b", "x-y", "not x", "'a'", "'a\\n'", "'é'", "['a', 'b c']", "[1, 'x']", "[1,2]", "[]", "[01]",
             "{'k': 1}", "(1, 2)", "it's", "5\n", "abc\n", " 5", "", "inf", "nan", "b", "u'x'", "'a' 'b'", "['a'", "\"q\"", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["j"] for r in rows.select("i", literal_to_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == [_literal_text(t) for t in texts]
