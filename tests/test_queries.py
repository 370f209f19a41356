"""Registered queries against their check SQL on the smallest tables.

A selection runs by default; CELLWISE_ALL_QUERIES=1 runs every registered query.
"""

import os

import pytest

from tools.check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SELECTED = (
    "scan_jsonl replicate_scan sink_flat_csv flatten_leaf cell_dtypes separate_types column_map unflatten_table merge_arrays "
    "untabularize literal_to_json restore_bools split_random subsample_stratified stratified_kfold encode_onehot "
    "scale_by_train_range exact_matches dcr_distance field_fidelity field_fidelity_nested column_pair_trends worst_pairs "
    "leaderboard run_metrics dataset_stats wasserstein kde_grid roc_auc_ovr classification_metrics impute_targets "
    "benchmark_generate benchmark_audit path_marginals"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "path"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("CELLWISE_ALL_QUERIES") else SELECTED)
def test_query(spark, con, name):
    status, note, _ = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status in ("ok", "NEAR"), note
