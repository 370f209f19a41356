"""Registered queries: reporting, profiling, given-score metrics, models and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellwise.operators import benchmark as B
from cellwise.operators import detection as D
from cellwise.operators import profiling as N
from cellwise.operators import reporting as O
from cellwise.operators import shapes as S
from cellwise.operators import specification as SP
from cellwise.operators import stats as T
from cellwise.operators import utility as L
from cellwise.operators.cells import flatten
from cellwise.operators.generation import generate_replicates, pending_replicates
from cellwise.plans import evaluate as EV
from cellwise.plans.boosting_sql import FOLDS, boosted, by_class, class_predictions, fold_areas, fold_gains
from cellwise.plans.common import both, cells, r6, records
from cellwise.plans.oracle_parts import DOCS, PAIRS, TYPED, cells_of, fields_of, with_parts
from cellwise.plans.registry import query
from cellwise.plans.sampling_queries import FAIR
from cellwise.session import materialize, scratch_dir, spread, table
from cellwise.sources import results as RS

# -- replicates and leaderboards ----------------------------------------------------------

MODELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SCORES = {
    "fidelity": "avg(o_totalprice) / 500000.0",
    "detection_roc_auc": "min(o_totalprice) / 1000.0",
    "privacy_dcr_score": "max(o_totalprice) / 10000.0",
    "utility": "avg(CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE))",
    "privacy_exact_matches_train": "sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)",
    "privacy_exact_matches_train_only": "sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)",
    "num_train": "count(*)",
}
MODE = "CASE WHEN o_orderkey % 7 < 3 THEN 'dcr' ELSE 'base' END"
METRICS_SQL = (
    "metrics AS ("
    + " UNION ALL ".join(
        f"""SELECT 'set' || (o_custkey % 4) AS dataset, o_orderpriority AS model, {MODE} AS mode, CAST(o_orderkey % 3 + 1 AS INTEGER) AS replicate,
  '{name}' AS metric, CAST({expr} AS DOUBLE) AS value FROM orders GROUP BY o_custkey % 4, o_orderpriority, {MODE}, o_orderkey % 3"""
        for name, expr in SCORES.items()
    )
    + ")"
)
AGG_SQL = """agg AS (SELECT dataset, model, mode, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std,
  list(value ORDER BY replicate) AS vals FROM metrics GROUP BY dataset, model, mode, metric)"""


def metrics_table(spark, sf):
    """Long metrics rows derived from the orders (one group per data set, model and replicate)."""
    wide = (
        table(spark, sf, "orders")
        .selectExpr(
            "concat('set', o_custkey % 4) AS dataset",
            "o_orderpriority AS model",
            f"{MODE} AS mode",
            "cast(o_orderkey % 3 + 1 AS int) AS replicate",
            "o_totalprice",
            "o_orderstatus",
        )
        .groupBy("dataset", "model", "mode", "replicate")
        .agg(*[F.expr(e).cast("double").alias(n) for n, e in SCORES.items()])
    )
    return wide.unpivot(["dataset", "model", "mode", "replicate"], list(SCORES), "metric", "value")


@query(
    "aggregate_replicates",
    with_parts(METRICS_SQL, AGG_SQL)
    + """SELECT dataset, mode, model, metric, round(mean, 6) AS mean, round(std, 6) AS std, len(vals) AS n_values,
  list_aggregate(list_transform(vals, lambda v: CAST(round(v, 3) AS DECIMAL(30, 3))::VARCHAR), 'string_agg', ',') AS all_values FROM agg""",
)
def aggregate_replicates(spark, sf):
    return O.aggregate_replicates(metrics_table(spark, sf)).select(
        "dataset", "mode", "model", "metric", r6("mean"), r6("std"), F.size("values").cast("bigint").alias("n_values"),
        F.array_join(F.transform("values", lambda v: F.round(v, 3).cast("decimal(30,3)").cast("string")), ",").alias("all_values"),
    )


@query(
    "replicate_counts",
    with_parts(METRICS_SQL)
    + "SELECT dataset, mode, "
    + ", ".join(f"count(DISTINCT replicate) FILTER (model = '{m}') AS \"{m}\"" for m in MODELS)
    + " FROM metrics GROUP BY dataset, mode",
)
def replicate_counts(spark, sf):
    return O.replicate_counts(metrics_table(spark, sf), MODELS)


@query(
    "leaderboard",
    with_parts(METRICS_SQL, AGG_SQL)
    + """SELECT dataset, mode, model, metric, round(mean, 6) AS mean,
  metric NOT IN ('privacy_dcr_score', 'privacy_exact_matches_train_only', 'num_train') AND rank() OVER (PARTITION BY dataset, mode, metric
    ORDER BY mean * CASE WHEN metric IN ('detection_roc_auc', 'privacy_exact_matches_train') THEN -1 ELSE 1 END DESC) = 1 AS is_best FROM agg""",
)
def leaderboard(spark, sf):
    return O.leaderboard(O.aggregate_replicates(metrics_table(spark, sf))).select("dataset", "mode", "model", "metric", r6("mean"), "is_best")


FAILED = "dataset = 'set0' AND model = '5-LOW'"


@query(
    "leaderboard_wide",
    with_parts(METRICS_SQL, AGG_SQL)
    + "SELECT dataset, mode, metric, "
    + ", ".join(
        f"coalesce(max(CASE WHEN {FAILED} THEN 'OOM' ELSE printf('%.3f', mean) END) FILTER (model = '{m}'), '-') AS \"{m}\"" for m in MODELS
    )
    + " FROM agg GROUP BY dataset, mode, metric",
)
def leaderboard_wide(spark, sf):
    base = metrics_table(spark, sf)
    failures = base.filter(FAILED).select("dataset", "model").distinct()
    return O.leaderboard_wide(O.aggregate_replicates(base.filter(f"NOT ({FAILED})")), MODELS, failures)


def _written(spark, sf):
    path = f"{scratch_dir(spark)}/metrics-{uuid.uuid4().hex}"
    RS.write_metrics(metrics_table(spark, sf), path)
    return RS.read_metrics(spark, path)


@query("metrics_sink", with_parts(METRICS_SQL) + "SELECT dataset, model, mode, replicate, metric, round(value, 6) AS value FROM metrics")
def metrics_sink(spark, sf):
    return _written(spark, sf).select("dataset", "model", "mode", "replicate", "metric", r6("value"))


@query(
    "result_scan",
    with_parts(METRICS_SQL)
    + "SELECT dataset, mode, model, metric, round(avg(value), 6) AS mean FROM metrics WHERE dataset = 'set1' GROUP BY dataset, mode, model, metric",
)
def result_scan(spark, sf):
    """One data set's folders are read, the others are pruned by their names."""
    kept = _written(spark, sf).filter("dataset = 'set1'")
    return O.aggregate_replicates(kept).select("dataset", "mode", "model", "metric", r6("mean"))


RUNS = """SELECT o_orderkey AS id, lower(replace(o_orderpriority, ' ', '')) || '-' || CASE WHEN o_orderkey % 2 = 0 THEN 'forest' ELSE 'x' END
  || CASE WHEN o_orderkey % 5 = 0 THEN '-dcr' ELSE '' END AS name,
  CASE WHEN o_orderkey % 11 = 0 THEN '-' WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS utility FROM orders"""


@query(
    "run_metrics",
    f"""WITH runs AS (SELECT DISTINCT id, name, utility FROM ({RUNS}))
SELECT id, CASE WHEN name LIKE '1-urgent%' THEN 'urgent' WHEN name LIKE '5-low%' THEN 'low' END AS dataset,
  CASE WHEN contains(name, 'forest') THEN 'forest' ELSE 'plain' END AS model, CASE WHEN contains(name, 'dcr') THEN 'dcr' ELSE 'base' END AS mode,
  'utility' AS metric, CAST(utility AS DOUBLE) AS value
FROM runs WHERE (name LIKE '1-urgent%' OR name LIKE '5-low%') AND utility NOT IN ('-', '')""",
)
def run_metrics(spark, sf):
    """Run names told apart; every run id occurs once or twice with the same row."""
    base = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        """concat(lower(replace(o_orderpriority, ' ', '')), '-', CASE WHEN o_orderkey % 2 = 0 THEN 'forest' ELSE 'x' END,
           CASE WHEN o_orderkey % 5 = 0 THEN '-dcr' ELSE '' END) AS name""",
        "CASE WHEN o_orderkey % 11 = 0 THEN '-' WHEN o_orderkey % 13 = 0 THEN '' ELSE cast(o_custkey AS string) END AS utility",
    )
    runs = base.unionByName(base.filter("id % 3 = 0"))
    return RS.run_metrics(runs, ["utility"], {"1-urgent": "urgent", "5-low": "low"}, {"forest": "forest"}, "plain")


# -- profiling ----------------------------------------------------------------------------

CARD = """card AS (SELECT path, typ, count(DISTINCT coalesce(s, CAST(x AS VARCHAR))) AS cardinality FROM typed
  WHERE typ IN ('cat', 'num', 'bool') GROUP BY path, typ)"""


@query(
    "dataset_stats",
    with_parts(*cells_of("order"), TYPED, CARD)
    + """SELECT (SELECT count(*) FROM docs WHERE split = 'train') AS n_train, (SELECT count(*) FROM docs WHERE split = 'test') AS n_test,
  (SELECT count(*) FROM docs) AS n_total, n_flat_cols, (SELECT count(*) FROM card WHERE typ = 'cat') AS n_cat,
  (SELECT count(*) FROM card WHERE typ = 'num') AS n_num, (SELECT count(*) FROM card WHERE typ = 'bool') AS n_bool,
  (SELECT CAST(coalesce(sum(cardinality), 0) AS BIGINT) FROM card WHERE typ <> 'num') AS total_discrete,
  round(1 - filled / ((SELECT count(*) FROM docs) * n_flat_cols)::DOUBLE, 6) AS sparsity
FROM (SELECT count(DISTINCT path) AS n_flat_cols, count(*) FILTER (dtype <> 'null') AS filled FROM cells WHERE dtype NOT IN ('array', 'object'))""",
)
def dataset_stats(spark, sf):
    stats = N.dataset_stats(*both(spark, sf, "order", leaf_only=True))
    return stats.select(
        "n_train", "n_test", "n_total", "n_flat_cols", "n_cat", "n_num", "n_bool", "total_discrete", r6("sparsity")
    )


@query("cardinalities", with_parts(*cells_of("event"), TYPED, CARD) + "SELECT path || '.' || typ AS col, cardinality FROM card")
def cardinalities(spark, sf):
    return N.cardinalities(cells(spark, sf, "event")).select("col", "cardinality").orderBy(F.desc("cardinality"), "col")


@query(
    "column_sparsity",
    with_parts(*cells_of("event"))
    + """SELECT path, round(1 - count(*) FILTER (dtype <> 'null') / (SELECT count(*) FROM docs)::DOUBLE, 6) AS sparsity
FROM cells WHERE dtype NOT IN ('array', 'object') GROUP BY path""",
)
def column_sparsity(spark, sf):
    n = records(spark, sf, "event").agg(F.count(F.lit(1)))
    return N.column_sparsity(cells(spark, sf, "event", leaf_only=True), n).select("path", r6("sparsity"))


@query(
    "wasserstein",
    with_parts(*fields_of("order"))
    + """, own AS (SELECT path, typ, x, nr, ns FROM freq WHERE typ IN ('num', 'alen')),
steps AS (SELECT path, typ, x, lead(x) OVER w - x AS gap,
    sum(nr) OVER (w ROWS UNBOUNDED PRECEDING) / nullif(sum(nr) OVER (PARTITION BY path, typ), 0)::DOUBLE
  - sum(ns) OVER (w ROWS UNBOUNDED PRECEDING) / nullif(sum(ns) OVER (PARTITION BY path, typ), 0)::DOUBLE AS d
  FROM own WINDOW w AS (PARTITION BY path, typ ORDER BY x)),
area AS (SELECT path, typ, coalesce(sum(abs(d) * gap), 0) AS w1 FROM steps GROUP BY path, typ)
SELECT path, typ, round(sum(x * nr) / sum(nr), 4) AS mean_real, round(sqrt(greatest(sum(x * x * nr) / sum(nr) - (sum(x * nr) / sum(nr)) * (sum(x * nr) / sum(nr)), 0)), 4) AS sd_real,
  round(sum(x * ns) / sum(ns), 4) AS mean_synth, round(sqrt(greatest(sum(x * x * ns) / sum(ns) - (sum(x * ns) / sum(ns)) * (sum(x * ns) / sum(ns)), 0)), 4) AS sd_synth,
  round(any_value(w1), 4) AS wasserstein
FROM own JOIN area USING (path, typ) GROUP BY path, typ HAVING sum(nr) > 0 AND sum(ns) > 0""",
)
def wasserstein(spark, sf):
    counts = S.value_counts(cells(spark, sf, "order")).filter("typ IN ('num', 'alen')")
    out = T.wasserstein(counts, ["path", "typ"]).filter("mean_real IS NOT NULL AND mean_synth IS NOT NULL")
    return out.select("path", "typ", *[F.round(c, 4).alias(c) for c in ("mean_real", "sd_real", "mean_synth", "sd_synth", "wasserstein")])


@query(
    "length_pmf",
    with_parts(*fields_of("order"))
    + """, own AS (SELECT x, nr, ns FROM freq WHERE path = 'items' AND typ = 'alen' AND x <= 15)
SELECT g AS length, round(coalesce((SELECT nr FROM own WHERE x = g), 0) / (SELECT sum(nr) FROM own)::DOUBLE, 6) AS real,
  round(coalesce((SELECT ns FROM own WHERE x = g), 0) / (SELECT sum(ns) FROM own)::DOUBLE, 6) AS synth FROM range(16) t(g)""",
)
def length_pmf(spark, sf):
    return N.length_pmf(S.value_counts(cells(spark, sf, "order")), "items").select("length", r6("real"), r6("synth"))


@query(
    "kde_grid",
    with_parts(DOCS["event"])
    + """, v AS (SELECT CASE WHEN event_id % 5 IN (0, 1) THEN 'real' ELSE 'synth' END AS side, value AS x FROM events WHERE event_id % 5 <> 2),
b AS (SELECT side, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v GROUP BY side),
f AS (SELECT side, x, count(*) AS m FROM v GROUP BY side, x)
SELECT side, i, round(sum(m * exp(-0.5 * ((i * 5.0 - x) / h) * ((i * 5.0 - x) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM f JOIN b USING (side), range(41) t(i) GROUP BY side, i""",
)
def kde_grid(spark, sf):
    """Density of the event values on 41 points from 0 to 200."""
    split = F.expr("CASE WHEN event_id % 5 IN (0, 1) THEN 'train' WHEN event_id % 5 = 2 THEN 'test' ELSE 'synth' END")
    counts = T.paired_counts(table(spark, sf, "events").select(split.alias("split"), F.col("value").alias("x")), ["x"])
    return N.kde_grid(counts, 0.0, 200.0, 41).select("side", F.col("i").cast("bigint").alias("i"), r6("density"))


@query(
    "column_histogram",
    with_parts(*fields_of("event"))
    + """, own AS (SELECT x, nr, ns FROM freq WHERE path = 'value' AND typ = 'num'), lim AS (SELECT min(x) AS lo, max(x) AS hi FROM own)
SELECT CAST(CAST(least(floor((x - lo) / (hi - lo) * 20), 19) AS BIGINT) AS VARCHAR) AS bucket, CAST(sum(nr) AS BIGINT) AS n_real, CAST(sum(ns) AS BIGINT) AS n_synth
FROM own, lim GROUP BY 1""",
)
def column_histogram(spark, sf):
    return N.column_histogram(S.value_counts(cells(spark, sf, "event")), "value", "num", 20)


# -- metrics on given scores ----------------------------------------------------------------


@query(
    "roc_auc",
    """SELECT fold, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y))::DOUBLE, 6) AS roc_auc
FROM (SELECT event_id % 3 AS fold, event_type = 'purchase' AS y,
        rank() OVER w + (count(*) OVER (PARTITION BY event_id % 3, value) - 1) / 2.0 AS r
      FROM events WINDOW w AS (PARTITION BY event_id % 3 ORDER BY value)) GROUP BY fold""",
)
def roc_auc(spark, sf):
    scored = table(spark, sf, "events").selectExpr("event_id % 3 AS fold", "event_type", "value")
    return T.roc_auc(scored, ["fold"], "value", F.col("event_type") == "purchase").select("fold", r6("roc_auc"))


AUC_SQL = """auc AS (SELECT f, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y))::DOUBLE AS a
  FROM (SELECT event_id % 3 AS f, event_type = 'purchase' AS y,
          rank() OVER w + (count(*) OVER (PARTITION BY event_id % 3, value) - 1) / 2.0 AS r
        FROM events WINDOW w AS (PARTITION BY event_id % 3 ORDER BY value)) GROUP BY f)"""


@query(
    "detection_score",
    f"WITH {AUC_SQL} SELECT round(1 - avg(2 * greatest(0.5, a) - 1), 6) AS detection, round(avg(a), 6) AS roc_auc FROM auc",
)
def detection_score(spark, sf):
    scored = table(spark, sf, "events").selectExpr("event_id % 3 AS fold", "event_type", "value")
    aucs = T.roc_auc(scored, ["fold"], "value", F.col("event_type") == "purchase")
    return D.detection_score(aucs).select(r6("detection"), r6("roc_auc"))


@query(
    "top_features",
    """WITH g AS (SELECT p_type || '/' || p_brand AS feature, avg(p_retailprice) AS gain FROM part GROUP BY 1),
r AS (SELECT feature, gain, row_number() OVER (ORDER BY gain DESC, feature) AS r FROM g)
SELECT least(r, 11) AS position, CASE WHEN max(r) > 10 THEN '(rest)' ELSE max(feature) END AS feature, round(sum(gain), 4) AS gain,
  count(*) AS features, round(sum(gain) / (SELECT sum(gain) FROM g) * 100, 6) AS percent FROM r GROUP BY least(r, 11)""",
)
def top_features(spark, sf):
    gains = table(spark, sf, "part").groupBy(F.concat_ws("/", "p_type", "p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("gain"))
    return D.top_features(gains, 10).select(
        F.col("position").cast("bigint").alias("position"), "feature", F.round("gain", 4).alias("gain"), "features", r6("percent")
    )


GUESS = "CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'view' ELSE 'other' END"


@query(
    "classification_metrics",
    f"""WITH p AS (SELECT event_type AS y, {GUESS} AS g FROM events),
k AS (SELECT c, (SELECT count(*) FROM p WHERE y = c AND g = c) AS hit, (SELECT count(*) FROM p WHERE y = c) AS t, (SELECT count(*) FROM p WHERE g = c) AS m
      FROM (SELECT y AS c FROM p UNION SELECT g FROM p))
SELECT round(sum(hit) / sum(t)::DOUBLE, 6) AS accuracy, round(sum(2.0 * hit / (t + m) * t) / sum(t), 6) AS f1_weighted, round(avg(2.0 * hit / (t + m)), 6) AS f1_macro FROM k""",
)
def classification_metrics(spark, sf):
    predicted = table(spark, sf, "events").selectExpr("event_type AS label", f"{GUESS} AS prediction")
    return T.classification_metrics(predicted, "label", "prediction").select(r6("accuracy"), r6("f1_weighted"), r6("f1_macro"))


KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    "roc_auc_ovr",
    "WITH p AS (SELECT event_id, event_type AS y, "
    + ", ".join(f"((event_id * {17 + 2 * i}) % 101)::DOUBLE AS p{i}" for i in range(5))
    + " FROM events), n AS (SELECT event_id, y, unnest(['click','error','purchase','signup','view']) AS c, "
    + "unnest([p0, p1, p2, p3, p4]) / CASE WHEN p0 + p1 + p2 + p3 + p4 = 0 THEN 1 ELSE p0 + p1 + p2 + p3 + p4 END AS s FROM p), "
    + "r AS (SELECT c, y = c AS hit, rank() OVER w + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS r FROM n WINDOW w AS (PARTITION BY c ORDER BY s)), "
    + """a AS (SELECT c, count(*) FILTER (hit) AS k, (sum(r) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0)
      / (count(*) FILTER (hit) * count(*) FILTER (NOT hit))::DOUBLE AS auc FROM r GROUP BY c) SELECT round(sum(auc * k) / sum(k), 6) AS roc_auc FROM a""",
)
def roc_auc_ovr(spark, sf):
    cols = [f"cast((event_id * {17 + 2 * i}) % 101 AS double) AS p{i}" for i in range(5)]
    given = table(spark, sf, "events").selectExpr("event_type", *cols)
    return T.roc_auc_one_vs_rest(given, "event_type", KINDS, [f"p{i}" for i in range(5)]).select(r6("roc_auc"))


@query(
    "regression_metrics",
    """WITH p AS (SELECT value AS y, value * 0.9 + event_id % 7 AS g FROM events)
SELECT round(1 - avg((y - g) * (y - g)) / var_pop(y), 6) AS r2, round(avg((y - g) * (y - g)), 6) AS mse, round(sqrt(avg((y - g) * (y - g))), 6) AS rmse FROM p""",
)
def regression_metrics(spark, sf):
    predicted = table(spark, sf, "events").selectExpr("value AS y", "value * 0.9D + event_id % 7 AS g")
    return T.regression_metrics(predicted, "y", "g").select(r6("r2"), r6("mse"), r6("rmse"))


@query(
    "utility_score",
    """WITH m AS (SELECT o_custkey % 50 AS k, avg(o_totalprice) / 300000 AS a, avg(o_totalprice - 100000) / 300000 - 0.45 AS b FROM orders GROUP BY 1)
SELECT k, round(least(b / greatest(a, 1e-10), 1), 6) AS f1_ratio,
  round(CASE WHEN b > 0 THEN least(greatest(a, 0) / greatest(b, 1e-10), 1) ELSE 0 END, 6) AS r2_ratio FROM m""",
)
def utility_score(spark, sf):
    given = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("k")).agg(
        F.expr("avg(o_totalprice) / 300000D").alias("a"), F.expr("avg(o_totalprice - 100000D) / 300000D - 0.45D").alias("b")
    )
    return given.select(
        "k",
        F.round(L.utility_score(F.col("b"), F.col("a")), 6).alias("f1_ratio"),
        F.round(L.utility_score(F.col("a"), F.col("b"), "regression"), 6).alias("r2_ratio"),
    )


# -- targets --------------------------------------------------------------------------------


@query(
    "target_extract",
    with_parts(*cells_of("event"))
    + "SELECT d.rid, d.split, coalesce(c.cat, '__missing__') AS target FROM docs d LEFT JOIN cells c ON c.rid = d.rid AND c.path = 'value'",
)
def target_extract(spark, sf):
    """Text values of a field of mixed type; numbers and nulls fall into the missing class."""
    return L.target_values(*both(spark, sf, "event"), "value")


@query(
    "label_encode",
    with_parts(*cells_of("order"))
    + """SELECT d.rid, CAST((SELECT count(DISTINCT x.cat) FROM cells x WHERE x.path = 'status' AND x.cat < c.cat) AS DOUBLE) AS label
FROM docs d JOIN cells c ON c.rid = d.rid AND c.path = 'status'""",
)
def label_encode(spark, sf):
    targets = L.target_values(*both(spark, sf, "order"), "status")
    return L.label_encode(targets).select("rid", "label")


@query(
    "utility_constant",
    """WITH codes AS (SELECT event_type AS t, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events WHERE event_id % 5 = 2
    UNION SELECT min(event_type) FROM events UNION SELECT max(event_type) FROM events))
SELECT trained_on, event_id AS rid, (SELECT code::DOUBLE FROM codes WHERE t = event_type) AS label, (SELECT code::DOUBLE FROM codes WHERE t = own) AS prediction, [1.0::DOUBLE] AS p
FROM events, (SELECT 'real' AS trained_on, min(event_type) AS own FROM events UNION ALL SELECT 'synth', max(event_type) FROM events) WHERE event_id % 5 = 2""",
)
def utility_constant(spark, sf):
    """Whole predictions for all test events of models that were trained on one class each."""
    types = table(spark, sf, "events").agg(F.min("event_type").alias("low"), F.max("event_type").alias("high")).first()
    own = F.try_variant_get("v", "$.type", "string")
    one_class = ((F.col("split") == "train") & (own == types["low"])) | ((F.col("split") == "synth") & (own == types["high"]))
    base = materialize(records(spark, sf, "event").filter((F.col("split") == "test") | one_class))
    return L.utility_predictions(flatten(base, max_depth=2), base, "type").select("trained_on", "rid", "label", "prediction", "p")


@query(
    "target_exclusion",
    with_parts(*cells_of("event"))
    + """, fields AS (SELECT DISTINCT path FROM cells)
SELECT path, count(*) AS n, (SELECT 'Target field ' || chr(39) || 'nothing' || chr(39) || ' not found. Available fields: [' || string_agg(chr(39) || path || chr(39), ', ' ORDER BY path) || ']' FROM fields) AS refused
FROM cells WHERE path <> 'props' AND NOT starts_with(path, 'props.') GROUP BY path""",
)
def target_exclusion(spark, sf):
    """Feature cells of a nested target, and the error for a target that does not exist."""
    own = materialize(cells(spark, sf, "event"))
    refused = ""
    try:
        L.check_target(own, "nothing")
    except ValueError as error:
        refused = str(error)
    return L.feature_cells(own, "props").groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


def U(name: str, seed: int = 42, rid: str = "rid") -> str:
    return f"(CAST('0x' || substr(md5('{seed}.{name}:' || {rid}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def G(name: str, seed: int = 42) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {U(name + '.r', seed)})) * cos(2.0 * pi() * {U(name + '.t', seed)}))"


@query(
    "impute_targets",
    f"""WITH t AS (SELECT event_id AS rid, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS target FROM events),
k AS (SELECT target AS drawn, row_number() OVER (ORDER BY md5('42:' || rid)) AS pick FROM t WHERE target IS NOT NULL)
SELECT rid, round(coalesce(target, drawn), 6) AS target FROM (
  SELECT rid, target, CASE WHEN target IS NULL THEN floor({U('impute')} * (SELECT count(target) FROM t)) + 1 END AS pick FROM t) LEFT JOIN k USING (pick)""",
)
def impute_targets(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id AS rid", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS target")
    return L.impute_targets(rows).select("rid", r6("target"))


# -- models -----------------------------------------------------------------------------------

BOOSTED = with_parts(*cells_of("event"), TYPED, boosted(FOLDS, D.TREES, D.DEPTH))


@query(
    "detection_gbt",
    BOOSTED + f""", {fold_areas(D.TREES)}
SELECT round(1.0 - avg(greatest(0.5, auc) * 2.0 - 1.0), 6) AS detection, round(avg(auc), 6) AS roc_auc FROM areas""",
)
def detection_gbt(spark, sf):
    return D.detection_metrics(*both(spark, sf, "event")).select(r6("detection"), r6("roc_auc"))


@query("detection_logistic")
def detection_logistic(spark, sf):
    return D.detection_metrics(*both(spark, sf, "event"), method="logistic_regression")


@query(
    "feature_importances",
    BOOSTED + f""", {fold_gains(D.TREES, D.DEPTH)}
SELECT col AS feature, round(avg(coalesce(gain, 0.0)), 6) AS gain FROM named CROSS JOIN (VALUES (0), (1), (2)) t(m) LEFT JOIN used_gain USING (m, f) GROUP BY col""",
)
def feature_importances(spark, sf):
    _, gains = D.detection_folds(*both(spark, sf, "event"))
    return D.feature_importances(gains).select("feature", r6("gain"))


@query(
    "utility_predictions",
    with_parts(*cells_of("event"), TYPED, boosted(by_class("type", 5), 5, 3, 5), class_predictions(5, 5))
    + "SELECT trained_on, rid, prediction, round(p, 5) AS p FROM predicted",
)
def utility_predictions(spark, sf):
    """Class and probability of every test event by five rounds of five-class trees, trained on real and on synthetic events."""
    found = L.utility_predictions(*both(spark, sf, "event"), "type", trees=5, depth=3)
    return found.select("trained_on", "rid", "prediction", F.round(F.array_max("p"), 5).alias("p"))


@query("utility_classification")
def utility_classification(spark, sf):
    metrics = L.utility_metrics(*both(spark, sf, "event"), "type")
    return L.score_from_metrics(metrics)


@query("utility_regression")
def utility_regression(spark, sf):
    metrics = L.utility_metrics(*both(spark, sf, "event"), "props.k", task="regression")
    return L.score_from_metrics(metrics, "regression")


@query("evaluate_all")
def evaluate_all(spark, sf):
    """All four metric families of every replicate in one long metrics table."""
    return EV.evaluate(
        records(spark, sf, "customer"),
        lambda r: flatten(r, max_depth=1),
        (1, 2, 3),
        target="segment",
    )


def _one_replicate(r: int) -> tuple[str, ...]:
    """The customers without the synthetic rows of other replicates, their cells and typed cells."""
    own = f"docs AS (SELECT * FROM every_doc WHERE split <> 'synth' OR replicate = {r})"
    return DOCS["customer"].replace("docs AS (", "every_doc AS (", 1), own, *cells_of("customer")[1:], TYPED


def _detection_sql(r: int) -> str:
    return f"""SELECT {r} AS replicate, unnest(['detection', 'detection_roc_auc']) AS metric, unnest([1.0 - avg(greatest(0.5, auc) * 2.0 - 1.0), avg(auc)]) AS value FROM (
{with_parts(*_one_replicate(r), boosted(FOLDS, D.TREES, D.DEPTH), fold_areas(D.TREES))} SELECT auc FROM areas)"""


def _utility_sql(r: int) -> str:
    return f"""SELECT {r}, unnest(['utility', 'utility_trtr_f1_weighted', 'utility_tstr_f1_weighted']), unnest([least(max(f1) FILTER (trained_on = 'synth') / greatest(max(f1) FILTER (trained_on = 'real'), 1e-10), 1.0),
  max(f1) FILTER (trained_on = 'real'), max(f1) FILTER (trained_on = 'synth')]) FROM (
{with_parts(*_one_replicate(r), boosted(by_class('segment', 5), 5, 3, 5), class_predictions(5, 5))}, judged AS (SELECT trained_on, class, prediction FROM predicted JOIN used USING (rid)),
per_class AS (SELECT trained_on, c, count(*) FILTER (class = c) AS t, count(*) FILTER (prediction = c) AS g, count(*) FILTER (class = c AND prediction = c) AS hit FROM judged, range(5) k(c) GROUP BY trained_on, c)
SELECT trained_on, sum(t * 2.0 * hit / nullif(t + g, 0)) / sum(t) AS f1 FROM per_class GROUP BY trained_on)"""


STANDARD = f"""SELECT replicate, unnest(['num_train', 'num_eval', 'num_synth']) AS metric, unnest([a, b, c]::DOUBLE[]) AS value FROM (
  WITH {DOCS['customer']} SELECT r AS replicate, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b, count(*) FILTER (split = 'synth' AND replicate = r) AS c
  FROM docs, (VALUES (1), (2), (3)) t(r) GROUP BY r)
UNION ALL SELECT rep, unnest(['fidelity', 'fidelity_shapes', 'fidelity_trends']), unnest([(shapes + trends) / 2, shapes, trends]) FROM (
{with_parts(*fields_of('customer', replicated=True), PAIRS)} SELECT rep, shapes, trends FROM (SELECT rep, sum(presence * score) / sum(presence) AS shapes FROM fields GROUP BY rep)
  JOIN (SELECT rep, sum(presence * score) / sum(presence) AS trends FROM pairs GROUP BY rep) USING (rep))
UNION ALL {' UNION ALL '.join(part(r) for r in (1, 2, 3) for part in (_detection_sql, _utility_sql))}"""


@query("evaluate_standard", f"SELECT CAST(replicate AS INTEGER) AS replicate, metric, round(value, 6) AS value FROM ({STANDARD})")
def evaluate_standard(spark, sf):
    """Every metric of the standard mode for all replicates; utility by five rounds of trees, so that SQL can grow them too."""
    run = lambda r: flatten(r, max_depth=1)
    metrics = EV.evaluate_mode(records(spark, sf, "customer"), run, (1, 2, 3), mode="standard", target="segment", utility_options={"trees": 5, "depth": 3})
    return metrics.select("replicate", "metric", r6("value"))


@query(
    "evaluate_dcr",
    with_parts(DOCS["customer"], FAIR)
    + """, sides AS (SELECT r, d.rid, d.split, d.doc, d.doc IN (SELECT doc FROM docs WHERE split = 'train') AS a, d.doc IN (SELECT doc FROM docs WHERE split = 'test') AS b
  FROM docs d, (VALUES (1), (2), (3)) t(r) WHERE d.split <> 'synth' OR d.replicate = r),
facts AS (SELECT r, count(*) FILTER (s.split = 'train')::DOUBLE AS num_train, count(*) FILTER (s.split = 'test')::DOUBLE AS num_eval, count(*) FILTER (s.split = 'synth')::DOUBLE AS num_synth,
    count(*) FILTER (s.split = 'synth' AND a)::DOUBLE AS privacy_exact_matches_train, count(*) FILTER (s.split = 'synth' AND b)::DOUBLE AS privacy_exact_matches_test,
    count(*) FILTER (s.split = 'synth' AND a AND NOT b)::DOUBLE AS privacy_exact_matches_train_only,
    avg(CASE WHEN d_train < d_test THEN 100.0 ELSE 0.0 END) FILTER (s.split = 'synth')::DOUBLE AS privacy_dcr_score
  FROM sides s LEFT JOIN dcr USING (rid) GROUP BY r),
scored AS (SELECT *, 1 - 2 * greatest(privacy_dcr_score / 100 - 0.5, 0) AS privacy FROM facts)
SELECT CAST(r AS INTEGER) AS replicate, metric, round(value, 6) AS value FROM scored UNPIVOT (value FOR metric IN (num_train, num_eval, num_synth,
  privacy_exact_matches_train, privacy_exact_matches_test, privacy_exact_matches_train_only, privacy_dcr_score, privacy))""",
)
def evaluate_dcr(spark, sf):
    """Privacy mode per replicate: the whole long metrics table."""
    metrics = EV.evaluate_mode(records(spark, sf, "customer"), lambda r: flatten(r, max_depth=1), (1, 2, 3), mode="dcr")
    return metrics.select("replicate", "metric", r6("value"))


# -- a specification over the given tables ------------------------------------------------------

EVENT_FACTS = [
    ("miss_ts", "missing", "ts", None, None, None),
    ("miss_value", "missing", "value", None, None, None),
    ("miss_type", "missing", "type", None, None, None),
    ("miss_ts_vip", "missing", "ts", "vip", None, "True"),
    ("miss_ts_plain", "missing", "ts", "vip", None, "False"),
    ("corr_value_k", "correlation", "value", "props.k", None, None),
    ("mean_value", "mean", "value", None, None, None),
    ("mean_value_click", "mean", "value", "type", None, "click"),
    ("mean_k_vip", "mean", "props.k", "vip", None, "True"),
    ("share_vip", "share", "vip", None, "True", None),
    ("share_click", "share", "type", None, "click", None),
    ("share_click_vip", "share", "type", "vip", "click", "True"),
    ("types", "distinct", "type", None, None, None),
    ("ks", "distinct", "props.k", None, None, None),
    ("flags", "distinct", "vip", None, None, None),
    ("odd_value", "odd", "value", None, "num", None),
    ("odd_type", "odd", "type", None, "cat", None),
    ("nothing", "mean", "no_such_field", None, None, None),
]
EVENT_CHECKS = [
    ("type_is_there", "at_most", "miss_type", None, 0.02, None, False),
    ("ts_is_missing", "near", "miss_ts", None, 0.14, 0.05, True),
    ("value_is_dense", "at_most", "miss_value", None, 0.001, None, True),
    ("ts_missing_alike", "same", "miss_ts", None, None, 0.05, False),
    ("ts_missing_for_vip", "above", "miss_ts_vip", "miss_ts_plain", None, 0.2, False),
    ("correlation_kept", "same", "corr_value_k", None, None, 0.15, False),
    ("mean_kept", "same", "mean_value", None, None, 5.0, False),
    ("vip_balance", "same", "share_vip", None, None, 0.15, False),
    ("click_balance", "same", "share_click_vip", None, None, 0.15, True),
    ("all_types", "near", "types", None, 5.0, 0.5, False),
    ("value_types", "at_most", "odd_value", None, 0.0, None, True),
    ("type_types", "at_most", "odd_type", None, 0.0, None, False),
    ("no_field", "same", "nothing", None, None, 1.0, True),
]
AMONG = {"vip": "vip = {}", "type": "type = '{}'"}


def _fact_sql(name, measure, field, other, value, among):
    column, kind = {"props.k": "k"}.get(field, field), f"t_{field.replace('.', '_')}"
    where = f" FILTER (WHERE {AMONG[other].format(among)})" if among else ""
    if field == "no_such_field":
        x = "NULL::DOUBLE"
    elif measure == "missing":
        x = f"avg((coalesce({kind}, 'null') = 'null')::INT){where}"
    elif measure == "share":
        x = f"avg(coalesce(CAST({column} AS VARCHAR) = '{value.lower() if field == 'vip' else value}', false)::INT){where}"
    elif measure == "mean":
        x = f"avg({column}){where}"
    elif measure == "correlation":
        x = f"corr({column}, k)"
    elif measure == "odd":
        x = f"count(*) FILTER (WHERE {kind} NOT IN ('null', '{value}'))"
    else:
        x = f"count(DISTINCT {column})"
    return f"SELECT split, '{name}' AS name, CAST({x} AS DOUBLE) AS value FROM wide GROUP BY split"


EVENT_WIDE = """wide AS (SELECT d.rid, d.split, max(c.num) FILTER (path = 'value') AS value, max(c.num) FILTER (path = 'props.k') AS k, max(c.cat) FILTER (path = 'type') AS type,
    bool_or(c.bool) FILTER (path = 'vip') AS vip, max(c.dtype) FILTER (path = 'ts') AS t_ts, max(c.dtype) FILTER (path = 'value') AS t_value,
    max(c.dtype) FILTER (path = 'type') AS t_type FROM docs d LEFT JOIN cells c USING (rid) GROUP BY d.rid, d.split)"""
EVENT_FACTS_SQL = f"{EVENT_WIDE}, facts AS ({' UNION ALL '.join(_fact_sql(*f) for f in EVENT_FACTS)})"


def _event_facts(spark, sf, *splits):
    base = materialize(records(spark, sf, "event"))
    own = materialize(flatten(base, max_depth=2))
    wanted = SP.fact_table(spark, EVENT_FACTS)
    return [SP.facts(own.filter(F.col("split") == s), base.filter(F.col("split") == s), wanted) for s in splits]


@query("specified_facts", with_parts(*cells_of("event"), EVENT_FACTS_SQL) + "SELECT split, name, round(value, 6) AS value FROM facts WHERE split <> 'test'")
def specified_facts(spark, sf):
    """Every fact of a specification about the events, for the real and the synthetic side."""
    train, synth = _event_facts(spark, sf, "train", "synth")
    both = train.withColumn("split", F.lit("train")).unionByName(synth.withColumn("split", F.lit("synth")))
    return both.select("split", "name", r6("value"))


def _sql(x):
    return "NULL" if x is None else repr(x) if isinstance(x, str) else str(x)


@query(
    "specified_audit",
    with_parts(*cells_of("event"), EVENT_FACTS_SQL)
    + f"""SELECT name, CASE WHEN ok THEN 'PASS' WHEN soft THEN 'WARN' ELSE 'FAIL' END AS status, round(actual, 6) AS actual, round(expected, 6) AS expected FROM (
  SELECT *, coalesce(CASE rule WHEN 'at_most' THEN actual <= expected WHEN 'above' THEN actual > expected + tolerance ELSE abs(actual - expected) < tolerance END, false) AS ok FROM (
    SELECT c.name, c.rule, c.soft, c.tolerance::DOUBLE AS tolerance, s.value AS actual, CASE c.rule WHEN 'same' THEN r.value WHEN 'above' THEN o.value ELSE c.number::DOUBLE END AS expected
    FROM (VALUES {', '.join('(' + ', '.join(_sql(x) for x in c) + ')' for c in EVENT_CHECKS)}) c(name, rule, fact, against, number, tolerance, soft)
    LEFT JOIN facts s ON s.split = 'synth' AND s.name = c.fact LEFT JOIN facts r ON r.split = 'train' AND r.name = c.fact LEFT JOIN facts o ON o.split = 'synth' AND o.name = c.against))""",
)
def specified_audit(spark, sf):
    """Every check of a specification about the events, the synthetic side against the real one."""
    train, synth = _event_facts(spark, sf, "train", "synth")
    checks = SP.audit(synth, train, SP.check_table(spark, EVENT_CHECKS))
    return checks.select("name", "status", r6("actual"), r6("expected"))


@query(
    "true_marginals",
    with_parts(*cells_of("event"))
    + """, truth AS (SELECT 'vip' AS path, avg((user_id % 3 = 0)::INT) AS true_p FROM events)
SELECT replicate, path, count(*) AS n, round(avg(bool::INT), 6) AS p, round(abs(avg(bool::INT) - any_value(true_p)), 6) AS error FROM cells JOIN truth USING (path) WHERE dtype = 'bool' GROUP BY replicate, path""",
)
def true_marginals(spark, sf):
    """Shares of true values per replicate of the events, against the share in the given table."""
    truth = table(spark, sf, "events").agg(F.avg((F.col("user_id") % 3 == 0).cast("double")).alias("true_p")).withColumn("path", F.lit("vip"))
    return N.path_marginals(cells(spark, sf, "event"), truth).select("replicate", "path", "n", r6("p"), r6("error"))


# -- benchmark and generation -----------------------------------------------------------------

SHARES = B.region_shares(42)
LISTS = {g: "[" + ", ".join(repr(x) for x in xs) + "]" for g, xs in SHARES.items()}
GENERATED = f"""latent AS (SELECT rid, {G('z1')} AS z1, {G('z2')} AS z2, {U('z3')} < 0.3 AS active,
    CASE WHEN {U('z4')} < 0.5 THEN 'alpha' WHEN {U('z4')} < 0.8 THEN 'beta' ELSE 'gamma' END AS cat_group
  FROM (SELECT event_id AS rid FROM events)),
base AS (SELECT *, cont_a + cont_b AS ab FROM (SELECT *, z1 + 0.1 * {G('a')} AS cont_a,
    0.8 * z1 + 0.3 * z2 + CASE cat_group WHEN 'alpha' THEN 0.0 WHEN 'beta' THEN -0.5 ELSE 1.5 END + 0.1 * {G('b')} AS cont_b FROM latent)),
facts AS (SELECT min(z1) AS lo, max(z1) AS hi, quantile_cont(ab, 0.65) AS cut FROM base),
generated AS (SELECT rid, cont_a, cont_b, CASE WHEN {U('miss.cont_c')} >= 0.20 THEN sin(2.0 * z1) + 0.5 * z2 + 0.15 * {G('c')} END AS cont_c,
  CAST(greatest(0, least(20, floor(exp(0.5 * z1 + 0.3) + 2.0 * active::INT))) AS INTEGER) AS int_count,
  CASE WHEN {U('miss.int_rating')} >= 0.15 THEN CAST(greatest(1, least(5, round_even(3.0 + z2 + 0.5 * {G('rating')}, 0))) AS INTEGER) END AS int_rating,
  cat_group, 'L' || lpad(CAST(CAST(least(greatest(floor((z1 - lo) / (hi - lo + 1e-9) * 10), 0), 9) + 1 AS INTEGER) AS VARCHAR), 2, '0') AS cat_level,
  CASE WHEN {U('miss.cat_region')} >= 0.25 THEN 'R' || lpad(CAST(least(49, len(list_filter(
    CASE cat_group WHEN 'alpha' THEN {LISTS['alpha']} WHEN 'beta' THEN {LISTS['beta']} ELSE {LISTS['gamma']} END, lambda c: c <= {U('region')}))) AS VARCHAR), 2, '0') END AS cat_region,
  ab > cut AS bool_flag, active AS bool_active, CASE WHEN {U('miss.bool_nullable')} >= 0.25 THEN z2 > 0 END AS bool_nullable,
  CASE WHEN cat_group <> 'alpha' THEN 2.0 * z2 + 0.2 * {G('cond')} END AS cont_conditional,
  CASE WHEN active THEN (['yes', 'no', 'maybe'])[CAST(least(floor({U('nullable')} * 3) + 1, 3) AS INTEGER)] END AS cat_nullable,
  CASE WHEN {U('miss.int_sparse')} >= 0.30 THEN CAST(round_even(abs(z1) * 10, 0) AS INTEGER) END AS int_sparse,
  z1 * z2 + 0.1 * {G('inter')} AS cont_interaction,
  CASE WHEN z2 > -0.25 THEN round(z1 * 10 + 50, 1) END AS mixed_num,
  CASE WHEN NOT z2 > -0.25 THEN (['low', 'medium', 'high'])[CAST(least(floor({U('mixed')} * 3) + 1, 3) AS INTEGER)] END AS mixed_cat,
  CASE WHEN {U('target')} < 1.0 / (1.0 + exp(-(0.8 * z1 - 0.6 * z2 + 1.2 * (cat_group = 'gamma')::INT + 0.5 * active::INT + 0.3 * z1 * z2 - 0.3)))
       THEN 'positive' ELSE 'negative' END AS target
  FROM base, facts)"""
NUMBERS = ("cont_a", "cont_b", "cont_c", "cont_conditional", "cont_interaction")
OTHERS = ("int_count", "int_rating", "cat_group", "cat_level", "cat_region", "bool_flag", "bool_active", "bool_nullable",
          "cat_nullable", "int_sparse", "mixed_num", "mixed_cat", "target")


def _ids(spark, sf):
    return spread(table(spark, sf, "events").select(F.col("event_id").alias("rid")), "rid")


@query(
    "benchmark_generate",
    f"WITH {GENERATED} SELECT rid, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)}, {', '.join(OTHERS)} FROM generated",
)
def benchmark_generate(spark, sf):
    """One benchmark record per event id."""
    return B.generate(_ids(spark, sf)).select("rid", *[r6(c) for c in NUMBERS], *OTHERS)


def _benchmark(spark, sf):
    recs = B.to_records(B.generate(_ids(spark, sf)))
    tagged = recs.withColumn("split", F.expr("CASE WHEN rid % 2 = 0 THEN 'train' ELSE 'synth' END")).withColumn("replicate", F.lit(1))
    # the copy under audit loses the link of absence to group and hides some fields
    spoiled = F.when(
        (F.col("split") == "synth") & (F.col("rid") % 4 == 1),
        F.to_variant_object(F.map_filter(F.expr("cast(v AS map<string,variant>)"), lambda k, _: ~k.isin("cont_a", "cat_level"))),
    ).otherwise(F.col("v"))
    return tagged.withColumn("v", spoiled)


@query(
    "benchmark_verify",
    f"""WITH {GENERATED} SELECT name, round(value, 6) AS value FROM (
  SELECT avg((cont_c IS NULL)::INT) AS miss_cont_c, avg((int_rating IS NULL)::INT) AS miss_int_rating, avg((cat_region IS NULL)::INT) AS miss_cat_region,
    avg((cat_nullable IS NULL)::INT) AS miss_cat_nullable, avg((cont_conditional IS NULL)::INT) FILTER (cat_group = 'alpha') AS cond_alpha,
    corr(cont_a, cont_b) AS corr_ab, corr(cont_a, cont_c) FILTER (cont_c IS NOT NULL) AS corr_ac,
    avg(cont_b) FILTER (cat_group = 'gamma') AS mean_gamma, avg((target = 'positive')::INT) AS positive,
    count(DISTINCT cat_region)::DOUBLE AS distinct_cat_region, count(DISTINCT bool_flag)::DOUBLE AS distinct_bool_flag FROM generated)
UNPIVOT (value FOR name IN (miss_cont_c, miss_int_rating, miss_cat_region, miss_cat_nullable, cond_alpha, corr_ab, corr_ac, mean_gamma, positive, distinct_cat_region, distinct_bool_flag))""",
)
def benchmark_verify(spark, sf):
    recs = materialize(B.to_records(B.generate(_ids(spark, sf))))
    summary = B.verify(flatten(recs, ("rid",), max_depth=1), recs)
    names = ("miss_cont_c", "miss_int_rating", "miss_cat_region", "miss_cat_nullable", "cond_alpha", "corr_ab", "corr_ac",
             "mean_gamma", "positive", "distinct_cat_region", "distinct_bool_flag")
    return summary.filter(F.col("name").isin(*names)).select("name", r6("value"))


AUDITED = """sides AS (SELECT rid % 2 = 1 AS syn, rid % 4 = 1 AS hidden, * FROM generated),
s AS (SELECT *, CASE WHEN NOT hidden THEN cont_a END AS a2, CASE WHEN NOT hidden THEN cat_level END AS lev2 FROM sides WHERE syn),
r AS (SELECT * FROM sides WHERE NOT syn)"""


@query(
    "benchmark_audit",
    f"""WITH {GENERATED}, {AUDITED}
SELECT name, CASE WHEN ok THEN 'PASS' WHEN soft THEN 'WARN' ELSE 'FAIL' END AS status FROM (
  SELECT 'missing_cont_a' AS name, (SELECT avg((a2 IS NULL)::INT) FROM s) < 0.02 AS ok, false AS soft
  UNION ALL SELECT 'missing_cat_level', (SELECT avg((lev2 IS NULL)::INT) FROM s) < 0.02, false
  UNION ALL SELECT 'missing_cont_b', (SELECT avg((cont_b IS NULL)::INT) FROM s) < 0.02, false
  UNION ALL SELECT 'missing_cont_c', abs((SELECT avg((cont_c IS NULL)::INT) FROM s) - 0.2) < 0.1, true
  UNION ALL SELECT 'missing_cat_nullable', abs((SELECT avg((cat_nullable IS NULL)::INT) FROM s) - 0.7) < 0.1, true
  UNION ALL SELECT 'cond_miss_cont_conditional', (SELECT avg((cont_conditional IS NULL)::INT) FILTER (cat_group = 'alpha')
      > avg((cont_conditional IS NULL)::INT) FILTER (cat_group <> 'alpha') + 0.2 FROM s), false
  UNION ALL SELECT 'cond_miss_cat_nullable', (SELECT avg((cat_nullable IS NULL)::INT) FILTER (NOT bool_active)
      > avg((cat_nullable IS NULL)::INT) FILTER (bool_active) + 0.2 FROM s), false
  UNION ALL SELECT 'corr_cont_a_cont_b', abs((SELECT corr(a2, cont_b) FROM s) - (SELECT corr(cont_a, cont_b) FROM r)) < 0.15, false
  UNION ALL SELECT 'cat_num_shift_order', (SELECT string_agg(g, ',' ORDER BY m) FROM (SELECT cat_group AS g, avg(cont_b) AS m FROM s GROUP BY 1))
      = (SELECT string_agg(g, ',' ORDER BY m) FROM (SELECT cat_group AS g, avg(cont_b) AS m FROM r GROUP BY 1)), false
  UNION ALL SELECT 'target_balance', abs((SELECT avg((target = 'positive')::INT) FROM s) - (SELECT avg((target = 'positive')::INT) FROM r)) < 0.15, false
  UNION ALL SELECT 'target_classes', (SELECT count(DISTINCT target) FROM s) = 2, false
  UNION ALL SELECT 'mixed_has_both_types', (SELECT count(mixed_num) > 0 AND count(mixed_cat) > 0 FROM s), false
  UNION ALL SELECT 'all_columns_present', true, false
  UNION ALL SELECT 'type_int_count', (SELECT bool_and(int_count % 1 = 0) FROM s), true)""",
)
def benchmark_audit(spark, sf):
    """Audit of a spoiled copy: hidden dense fields fail, kept relations pass."""
    base = materialize(_benchmark(spark, sf))
    synth, real = base.filter("split = 'synth'"), base.filter("split = 'train'")
    checks = B.audit(flatten(synth, ("rid",), max_depth=1), synth, flatten(real, ("rid",), max_depth=1), real)
    names = (
        "missing_cont_a", "missing_cat_level", "missing_cont_b", "missing_cont_c", "missing_cat_nullable", "cond_miss_cont_conditional",
        "cond_miss_cat_nullable", "corr_cont_a_cont_b", "cat_num_shift_order", "target_balance", "target_classes",
        "mixed_has_both_types", "all_columns_present", "type_int_count",
    )
    return checks.filter(F.col("name").isin(*names)).select("name", "status")


NESTED = "nested AS (SELECT event_id AS rid, CAST(event_id % 3 + 1 AS INTEGER) AS replicate FROM events)"
TRUTH = " UNION ALL ".join(f"SELECT '{p}' AS path, {x} AS true_p, {U(p)} < {x} AS b, replicate FROM nested" for p, x in B.LEAF_SHARES.items())


@query(
    "nested_generate",
    f"WITH {NESTED} SELECT path, count(*) AS n, count(*) FILTER (b) AS n_true FROM ({TRUTH}) GROUP BY path",
)
def nested_generate(spark, sf):
    recs = B.generate_nested(_ids(spark, sf))
    return flatten(recs, ("rid",), max_depth=3).filter("dtype = 'bool'").groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("bool")).alias("n_true")
    )


def _marginals(spark, sf):
    recs = B.generate_nested(_ids(spark, sf)).withColumn("replicate", (F.col("rid") % 3 + 1).cast("int"))
    return N.path_marginals(flatten(recs, ("rid", "replicate"), max_depth=3), B.leaf_truth(spark))


@query(
    "path_marginals",
    f"""WITH {NESTED} SELECT replicate, path, count(*) AS n, round(avg(b::INT), 6) AS p, round(abs(avg(b::INT) - any_value(true_p)), 6) AS error
FROM ({TRUTH}) GROUP BY replicate, path""",
)
def path_marginals(spark, sf):
    return _marginals(spark, sf).select("replicate", "path", "n", r6("p"), r6("error"))


@query(
    "marginal_errors",
    f"""WITH {NESTED}, e AS (SELECT replicate, abs(avg(b::INT) - any_value(true_p)) AS error FROM ({TRUTH}) GROUP BY replicate, path),
m AS (SELECT replicate, avg(error) AS mae FROM e GROUP BY replicate)
SELECT round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_sd FROM m""",
)
def marginal_errors(spark, sf):
    return N.marginal_errors(_marginals(spark, sf)).select(r6("mae_mean"), r6("mae_sd"))


@query(
    "generate_replicates",
    """SELECT r AS replicate, (SELECT count(*) FROM events) AS n, (SELECT count(*) FROM events) AS n_ids FROM (VALUES (2), (3)) t(r)""",
)
def generate_replicates_query(spark, sf):
    """As many records per replicate as there are events; the finished first replicate is skipped."""
    n = table(spark, sf, "events").count()
    finished = table(spark, sf, "events").select(F.lit(1).alias("replicate"))
    todo = pending_replicates(finished, 3, n)

    def make(rng, i):
        return f'{{"id": {i}, "score": {rng.normal():.6f}}}'

    made = generate_replicates(spark, n, todo, make)
    return made.groupBy("replicate").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.try_variant_get("v", "$.id", "bigint")).alias("n_ids")
    )
