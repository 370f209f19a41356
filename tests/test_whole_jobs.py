"""Registered queries run the whole job of their operators."""

import pytest
from cellwise.plans import report_queries as Q


def test_evaluate_all_scores_every_replicate_with_full_trees(monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "records", lambda *a: None)
    monkeypatch.setattr(Q.EV, "evaluate", lambda *a, **b: seen.append((a, b)))
    Q.evaluate_all(None, None)
    (args, options), = seen
    assert args[2] == (1, 2, 3)
    assert not options.get("utility_options")


@pytest.mark.parametrize("name", ["utility_classification", "utility_regression"])
def test_utility_queries_fit_the_full_model(monkeypatch, name):
    seen = []
    monkeypatch.setattr(Q, "both", lambda *a: (None, None))
    monkeypatch.setattr(Q.L, "utility_metrics", lambda *a, **b: seen.append(b))
    monkeypatch.setattr(Q.L, "score_from_metrics", lambda *a: None)
    getattr(Q, name)(None, None)
    assert not {"trees", "depth", "rate"} & set(seen[0])
