"""Detection: can a classifier tell synthetic records from real ones?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cellwise.functions.expr import many
from cellwise.operators.boosting import Fitted, Model, feature_rows, fit
from cellwise.operators.cells import typed_view
from cellwise.operators.features import NUMERIC, encode_features
from cellwise.operators.splitting import stratified_kfold
from cellwise.operators.stats import roc_auc, running_totals
from cellwise.session import materialize

METHODS = ("trees", "logistic_regression")
TREES, DEPTH = 10, 3


def with_folds(rows: DataFrame, real: str, synth: str, n_splits: int, seed: int) -> tuple[DataFrame, int]:
    """Rows of both sides with ``label`` (1 for a real one) and ``fold``; the number of folds, 0 if there is no split."""
    labelled = rows.filter(F.col("split").isin(real, synth)).withColumn(
        "label", (F.col("split") == real).cast("double")
    )
    sizes = labelled.groupBy("label").count().collect()
    folds = min(n_splits, *[r["count"] for r in sizes]) if len(sizes) == 2 else 0
    return materialize(stratified_kfold(labelled, "label", n_splits, seed)), folds


def boosted_folds(cells: DataFrame, records: DataFrame, n_splits: int, seed: int, real: str, synth: str) -> Fitted | None:
    """The models of all folds, fitted together; model f scores fold f."""
    # folds are dealt to ids, and the entries, which weigh far more, meet them once
    folded, folds = with_folds(records.select("rid", "split"), real, synth, n_splits, seed)
    rows, features = feature_rows(cells, records, onto=folded)
    if folds < 2:
        return None
    own = F.expr("shiftleft(1, cast(fold AS int))")
    tagged = rows.select("rid", "label", (F.lit((1 << folds) - 1) - own).alias("member"), own.alias("scored"), "entries")
    return fit(tagged, features, [Model(f, "logistic", [0.0, 1.0]) for f in range(folds)], TREES, DEPTH)


def gain_per_use(ledger: DataFrame, features: Sequence[str], folds: int) -> DataFrame:
    """(fold, feature, gain): mean gain of the cuts by a feature in each fold's model, 0 for one that is not used."""
    spark = ledger.sparkSession
    every = spark.range(folds).select(F.col("id").cast("int").alias("fold"), F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    used = ledger.groupBy(F.col("model").alias("fold"), "feature").agg(F.avg("gain").alias("gain"))
    return every.join(used, ["fold", "feature"], "left").select("fold", "feature", F.coalesce("gain", F.lit(0.0)).alias("gain"))


# --- logistic regression on sparse rows


def feature_numbers(entries: DataFrame) -> DataFrame:
    """(name, index): features numbered by ranges of their names, as a written table."""
    names = entries.select("name").distinct().withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    return materialize(running_totals(names, ["all"], "name", ["one"]).select("name", (F.col("cum_one") - 1).cast("int").alias("index")))


def _between(low, high, place):
    """Linear interpolation between the values at the floor and the ceiling of a place."""
    return low + (high - low) * (place - F.floor(place))


def scaling_facts(entries: DataFrame, folds: DataFrame) -> DataFrame:
    """(model, name, centre, width) of every feature in the training rows of each fold's model.

    Absent numbers take the training mean; the width is the distance of the quartiles (with linear interpolation) of the
    column filled that way, 1 if they agree. An indicator's quartiles follow from its count."""
    sizes = folds.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    counts = entries.join(folds, "rid").groupBy("model", "name", "value").agg(F.count(F.lit(1)).alias("m"))
    counts = materialize(counts)
    number = F.col("name").rlike("[.](" + "|".join((*NUMERIC, "bool")) + ")$")
    numbers = counts.where(number)
    means = numbers.groupBy("model", "name").agg((F.sum(F.col("value") * F.col("m")) / F.sum("m")).alias("centre"), F.sum("m").alias("present"))
    means = materialize(means.join(sizes, "model"))
    filled = numbers.select("model", "name", "value", "m").unionByName(
        means.where("present < n").select("model", "name", F.col("centre").alias("value"), (F.col("n") - F.col("present")).alias("m"))
    )
    filled = filled.groupBy("model", "name", "value").agg(F.sum("m").alias("m"))
    running = running_totals(filled, ["model", "name"], "value", ["m"]).join(means, ["model", "name"])
    at = lambda place: F.min(F.when(F.col("cum_m") > place, F.col("value")))
    quartile = {q: (F.col("n") - 1) * q for q in (0.25, 0.75)}
    value = lambda q: _between(at(F.floor(quartile[q])), at(F.ceil(quartile[q])), F.max(quartile[q]))
    wide = running.groupBy("model", "name").agg(F.max("centre").alias("centre"), (value(0.75) - value(0.25)).alias("width"))
    ones = counts.where(~number).join(sizes, "model")
    bit = lambda place: (place >= F.col("n") - F.col("m")).cast("double")
    flag = lambda q: _between(bit(F.floor(quartile[q])), bit(F.ceil(quartile[q])), quartile[q])
    flags = ones.select("model", "name", F.lit(0.0).alias("centre"), (flag(0.75) - flag(0.25)).alias("width"))
    return wide.unionByName(flags).select("model", "name", "centre", F.when(F.col("width") == 0, 1.0).otherwise(F.col("width")).alias("width"))


def sparse_rows(entries: DataFrame, numbers: DataFrame, facts: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (model, rid and more) with ``features``: a sparse vector of (index, scaled value), built without Python.

    Values are taken from the centre. The shift of a column by a constant only moves the intercept, which is not
    penalised, so indicators stay zero where they are absent, and a number filled with the mean is zero.
    The entries of a record are gathered once, each with its values in all models."""
    models = sorted(r["model"] for r in facts.select("model").distinct().collect())  # as many as folds
    fact = lambda f, c: F.max(F.when(F.col("model") == f, F.col(c)))
    wide = facts.groupBy("name").agg(*[fact(f, c).alias(f"{c}_{f}") for f in models for c in ("centre", "width")])
    known = materialize(numbers.join(wide, "name"))
    values = [((F.col("value") - F.col(f"centre_{f}")) / F.col(f"width_{f}")).alias(f"v_{f}") for f in models]
    item = F.struct("index", *[f"v_{f}" for f in models])
    held = entries.join(known, "name").select("rid", "index", *values).groupBy("rid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    own = [F.when(F.col("model") == f, F.arrays_zip(F.col("all.index").alias("index"), F.col(f"all.v_{f}").alias("value"))) for f in models]
    none = F.array().cast("array<struct<index:int,value:double>>")
    joined = rows.join(many(held), "rid", "left").withColumn("e", F.coalesce(F.filter(F.coalesce(*own, none), lambda e: e["value"] != 0), none))
    parts = [F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("e.index").alias("indices"), F.col("e.value").alias("values")]
    laid = joined.select(*rows.columns, F.struct(*parts).alias("features"))  # the columns of a sparse vector
    schema = StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in laid.schema])
    return materialize(laid, schema=schema)


def logistic_folds(cells: DataFrame, records: DataFrame, n_splits: int, seed: int, real: str, synth: str) -> DataFrame | None:
    """(fold, label, p) of the held-out rows of every fold; ridge penalty 1 over the training rows, as for C = 1."""
    keys = ("rid", "split")
    entries = materialize(encode_features(typed_view(cells, keys), records, keys=keys).select("rid", "name", "value"))
    folded, folds = with_folds(records.select(*keys), real, synth, n_splits, seed)
    if folds < 2:
        return None
    models = F.explode(F.array(*[F.lit(f) for f in range(folds)]))
    each = folded.select("rid", "label", "fold", models.alias("model"))
    training = materialize(each.where("model != fold").select("model", "rid"))
    numbers = feature_numbers(entries)
    ready = sparse_rows(entries, numbers, materialize(scaling_facts(entries, training)), each, numbers.count())
    predictions = None
    for fold in range(folds):
        own = ready.where(F.col("model") == fold)
        train = own.where(F.col("fold") != fold)
        model = LogisticRegression(maxIter=100, regParam=1.0 / train.count(), standardization=False).fit(train)
        scored = model.transform(own.where(F.col("fold") == fold)).select("fold", "label", vector_to_array("probability")[1].alias("p"))
        predictions = scored if predictions is None else predictions.unionByName(scored)
    return predictions


def detection_predictions(
    cells: DataFrame,
    records: DataFrame,
    method: str = "trees",
    n_splits: int = 3,
    seed: int = 42,
    real: str = "train",
    synth: str = "synth",
) -> tuple[DataFrame | None, Fitted | None]:
    """(fold, label, p) of every held-out row, written, and the fitted trees if there are any."""
    if method not in METHODS:
        raise ValueError(f"Unsupported method: {method}")
    used = records.filter(F.col("split").isin(real, synth))
    own = cells.filter(F.col("split").isin(real, synth))
    if method == "logistic_regression":
        found = logistic_folds(own, used, n_splits, seed, real, synth)
        return (None if found is None else materialize(found)), None
    fitted = boosted_folds(own, used, n_splits, seed, real, synth)
    if fitted is None:
        return None, None
    return materialize(fitted.predictions.select(F.col("model").alias("fold"), "label", F.col("p")[1].alias("p"))), fitted


def detection_folds(cells: DataFrame, records: DataFrame, **options) -> tuple[DataFrame | None, DataFrame | None]:
    """(AUC per fold, importance per fold and feature); (None, None) when there are too few rows."""
    predictions, fitted = detection_predictions(cells, records, **options)
    if predictions is None:
        return None, None
    gains = gain_per_use(fitted.ledger, fitted.features.names, len(fitted.models)) if fitted else None
    return roc_auc(predictions, ["fold"], "p", F.col("label") == 1.0), gains


def detection_score(aucs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1 minus the mean of 2 max(0.5, AUC) - 1 over folds, and the mean AUC."""
    return aucs.groupBy(*keys).agg(
        (F.lit(1.0) - F.avg(F.greatest(F.lit(0.5), F.col("roc_auc")) * 2.0 - 1.0)).alias("detection"),
        F.avg("roc_auc").alias("roc_auc"),
    )


def detection_metrics(cells: DataFrame, records: DataFrame, **options) -> DataFrame:
    aucs, _ = detection_folds(cells, records, **options)
    if aucs is None:
        return cells.sparkSession.createDataFrame([(1.0, 0.5)], "detection double, roc_auc double")
    return detection_score(aucs)


def feature_importances(gains: DataFrame) -> DataFrame:
    """Mean gain per feature over folds, highest first; unused features stay at zero."""
    return gains.groupBy("feature").agg(F.avg("gain").alias("gain")).orderBy(F.desc("gain"), "feature")


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most telling features with their share of the total, and the rest as one row."""
    order = Window.orderBy(F.desc("gain"), "feature")
    # the frame has one row per feature, so one window task is bounded by the schema
    ranked = importances.select("feature", "gain", F.row_number().over(order).alias("r"))
    total = importances.agg(F.sum("gain")).scalar()
    return (
        ranked.groupBy(F.when(F.col("r") <= n, F.col("r")).otherwise(n + 1).alias("position"))
        .agg(
            F.when(F.max("r") > n, F.lit("(rest)")).otherwise(F.max("feature")).alias("feature"),
            F.sum("gain").alias("gain"),
            F.count(F.lit(1)).alias("features"),
        )
        .withColumn("percent", F.when(total > 0, F.col("gain") / total * 100.0).otherwise(F.lit(0.0)))
    )
