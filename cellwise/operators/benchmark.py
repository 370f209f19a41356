"""Benchmark records with known relationships, their verification and the audit of a copy.

Every random number is a hash of (seed, field, id), so records do not depend on how the
ids are partitioned and grow with the ids given.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.expr import many, unit_normal, unit_uniform
from cellwise.operators.stats import exact_quantile
from cellwise.session import materialize

# Fixed values of the benchmark: group names, probabilities and shifts.
GROUPS = (("alpha", 0.5, 0.0), ("beta", 0.3, -0.5), ("gamma", 0.2, 1.5))
ACTIVE_SHARE = 0.3
FLAG_QUANTILE = 0.65
MIXED_CUT = -0.25
REGIONS = 50
NULLABLE_LEVELS = ("yes", "no", "maybe")
MIXED_LEVELS = ("low", "medium", "high")
# Share of absent cells per field; the last two are conditional.
MISSING_RATES = {
    "cont_a": 0.0,
    "cont_b": 0.0,
    "int_count": 0.0,
    "cat_group": 0.0,
    "cat_level": 0.0,
    "bool_flag": 0.0,
    "bool_active": 0.0,
    "cont_interaction": 0.0,
    "target": 0.0,
    "mixed_value": 0.0,
    "cont_c": 0.20,
    "int_rating": 0.15,
    "cat_region": 0.25,
    "int_sparse": 0.30,
    "bool_nullable": 0.25,
    "cont_conditional": 0.50,
    "cat_nullable": 0.70,
}
FIELDS = tuple(MISSING_RATES)


def region_shares(seed: int) -> dict[str, list[float]]:
    """Cumulative region probabilities per group, drawn from a symmetric Dirichlet(0.5)."""
    rng = np.random.default_rng(seed + 1)
    return {name: np.cumsum(rng.dirichlet(np.full(REGIONS, 0.5))).tolist() for name, _, _ in GROUPS}


def _pick(u: Column, levels: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(x) for x in levels])
    return F.element_at(names, F.least(F.floor(u * len(levels)) + 1, F.lit(len(levels))).cast("int"))


def generate(ids: DataFrame, seed: int = 42) -> DataFrame:
    """One benchmark record per ``rid`` as typed columns; NULL stands for an absent field.

    ``mixed_value`` comes in two columns, ``mixed_num`` and ``mixed_cat``."""
    u = lambda name: unit_uniform(f"{seed}.{name}", "rid")
    e = lambda name: unit_normal(f"{seed}.{name}", "rid")
    group_u = F.col("group_u")
    alpha_end, beta_end = GROUPS[0][1], GROUPS[0][1] + GROUPS[1][1]
    group = F.when(group_u < alpha_end, "alpha").when(group_u < beta_end, "beta").otherwise("gamma")
    latent = ids.select(
        "rid", e("z1").alias("z1"), e("z2").alias("z2"), (u("z3") < ACTIVE_SHARE).alias("active"), u("z4").alias("group_u")
    ).withColumn("cat_group", group)
    z1, z2, z3 = F.col("z1"), F.col("z2"), F.col("active").cast("double")
    shift = F.lit(0.0)
    for name, _, by in GROUPS:
        shift = F.when(F.col("cat_group") == name, F.lit(by)).otherwise(shift)
    base = materialize(
        latent.withColumn("cont_a", z1 + F.lit(0.1) * e("a")).withColumn(
            "cont_b", F.lit(0.8) * z1 + F.lit(0.3) * z2 + shift + F.lit(0.1) * e("b")
        ).withColumn("ab", F.col("cont_a") + F.col("cont_b"))
    )
    low, high = base.agg(F.min("z1")).scalar(), base.agg(F.max("z1")).scalar()
    level = F.least(F.greatest(F.floor((z1 - low) / (high - low + F.lit(1e-9)) * 10), F.lit(0)), F.lit(9))
    shares = region_shares(seed)
    cumulative = F.array(*[F.lit(x) for x in shares["gamma"]])
    for name in ("alpha", "beta"):
        cumulative = F.when(F.col("cat_group") == name, F.array(*[F.lit(x) for x in shares[name]])).otherwise(cumulative)
    region_u = u("region")
    region = F.least(F.size(F.filter(cumulative, lambda c: c <= region_u)), F.lit(REGIONS - 1))
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    logit = (
        F.lit(0.8) * z1
        - F.lit(0.6) * z2
        + F.lit(1.2) * (F.col("cat_group") == "gamma").cast("double")
        + F.lit(0.5) * z3
        + F.lit(0.3) * z1 * z2
        - F.lit(0.3)
    )
    present = lambda name: u(f"miss.{name}") >= MISSING_RATES[name]
    numeric = z2 > MIXED_CUT
    return base.select(
        "rid",
        "cont_a",
        "cont_b",
        F.when(present("cont_c"), F.sin(F.lit(2.0) * z1) + F.lit(0.5) * z2 + F.lit(0.15) * e("c")).alias("cont_c"),
        clip(F.floor(F.exp(F.lit(0.5) * z1 + F.lit(0.3)) + F.lit(2.0) * z3).cast("double"), 0, 20).cast("int").alias("int_count"),
        F.when(present("int_rating"), clip(F.rint(F.lit(3.0) + z2 + F.lit(0.5) * e("rating")), 1, 5).cast("int")).alias("int_rating"),
        "cat_group",
        F.concat(F.lit("L"), F.lpad((level + 1).cast("string"), 2, "0")).alias("cat_level"),
        F.when(present("cat_region"), F.concat(F.lit("R"), F.lpad(region.cast("string"), 2, "0"))).alias("cat_region"),
        (F.col("ab") > exact_quantile(base, "ab", FLAG_QUANTILE).scalar()).alias("bool_flag"),
        F.col("active").alias("bool_active"),
        F.when(present("bool_nullable"), z2 > 0).alias("bool_nullable"),
        F.when(F.col("cat_group") != "alpha", F.lit(2.0) * z2 + F.lit(0.2) * e("cond")).alias("cont_conditional"),
        F.when(F.col("active"), _pick(u("nullable"), NULLABLE_LEVELS)).alias("cat_nullable"),
        F.when(present("int_sparse"), F.rint(F.abs(z1) * 10).cast("int")).alias("int_sparse"),
        (z1 * z2 + F.lit(0.1) * e("inter")).alias("cont_interaction"),
        F.when(numeric, F.round(z1 * 10 + 50, 1)).alias("mixed_num"),
        F.when(~numeric, _pick(u("mixed"), MIXED_LEVELS)).alias("mixed_cat"),
        F.when(u("target") < F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), "positive").otherwise("negative").alias("target"),
    )


def to_records(rows: DataFrame) -> DataFrame:
    """Generated rows as VARIANT records; absent fields have no member."""
    members = [
        m
        for f in FIELDS
        for m in (
            F.lit(f),
            F.coalesce(F.col("mixed_num").cast("variant"), F.col("mixed_cat").cast("variant"))
            if f == "mixed_value"
            else F.col(f).cast("variant"),
        )
    ]
    return rows.select("rid", F.to_variant_object(F.map_filter(F.create_map(*members), lambda _, v: v.isNotNull())).alias("v"))


# Probability of true at every leaf of the nested boolean records.
LEAF_SHARES = {
    "a.left.val": 0.95,
    "a.right.val": 0.30,
    "b.left.val": 0.05,
    "b.right.val": 0.70,
    "c.left.val": 0.85,
    "c.right.val": 0.15,
    "d.left.val": 0.60,
    "d.right.val": 0.40,
}


def generate_nested(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Nested boolean records: branch, side, value, each leaf with its own share of true."""
    leaf = lambda path: F.struct((unit_uniform(f"{seed}.{path}", "rid") < LEAF_SHARES[path]).alias("val"))
    branches = [
        F.struct(*[leaf(f"{b}.{side}.val").alias(side) for side in ("left", "right")]).alias(b) for b in "abcd"
    ]
    return ids.select("rid", F.to_variant_object(F.struct(*branches)).alias("v"))


def leaf_truth(spark) -> DataFrame:
    return spark.createDataFrame(list(LEAF_SHARES.items()), "path string, true_p double")


# -- verification and audit ---------------------------------------------------------------

NEEDED = {
    "cont_a": ("num",),
    "cont_b": ("num",),
    "cont_c": ("num",),
    "int_count": ("num",),
    "cat_group": ("cat",),
    "target": ("cat",),
    "bool_active": ("bool",),
}


def _wide(cells: DataFrame, records: DataFrame) -> DataFrame:
    """One row per record: dtype of every benchmark field and the values the checks read."""
    at = lambda f, c: F.max(F.when(F.col("path") == f, F.col(c)))
    own = cells.filter(F.col("path").isin(*FIELDS)).groupBy("rid").agg(
        *[at(f, "dtype").alias(f"t_{f}") for f in FIELDS],
        *[at(f, kind).alias(f) for f, kinds in NEEDED.items() for kind in kinds],
    )
    return records.select("rid").join(many(own), "rid", "left")


def _absent(field: str) -> Column:
    return F.coalesce(F.col(f"t_{field}") == "null", F.lit(True))


def _share(condition: Column, among: Column | None = None) -> Column:
    flag = condition.cast("double")
    return F.avg(flag if among is None else F.when(among, flag))


def _pearson(a: str, b: str) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _facts(wide: DataFrame) -> DataFrame:
    """Everything the checks need about one side, in one aggregation."""
    group, target = F.col("cat_group"), F.col("target")
    kinds = {"cont_a": ("num",), "cont_b": ("num",), "int_count": ("num",), "cat_group": ("cat", "date"),
             "bool_flag": ("bool",), "bool_active": ("bool",), "target": ("cat", "date")}
    bad = {
        f: F.count_if(~_absent(f) & ~F.col(f"t_{f}").isin(*allowed))
        + (F.count_if(F.col("int_count") % 1 != 0) if f == "int_count" else F.lit(0))
        for f, allowed in kinds.items()
    }
    mixed = F.col("t_mixed_value")
    return wide.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.bool_or(F.col(f"t_{f}").isNotNull()), F.lit(False)).alias(f"has_{f}") for f in FIELDS],
        *[F.coalesce(_share(_absent(f)), F.lit(1.0)).alias(f"miss_{f}") for f in FIELDS],
        *[expr.alias(f"bad_{f}") for f, expr in bad.items()],
        _share(_absent("cont_conditional"), group == "alpha").alias("cond_alpha"),
        _share(_absent("cont_conditional"), F.coalesce(group != "alpha", F.lit(True))).alias("cond_other"),
        _share(_absent("cat_nullable"), ~F.col("bool_active")).alias("cond_inactive"),
        _share(_absent("cat_nullable"), F.col("bool_active")).alias("cond_active"),
        _pearson("cont_a", "cont_b").alias("corr_ab"),
        _pearson("cont_a", "cont_c").alias("corr_ac"),
        *[F.avg(F.when(group == g, F.col("cont_b"))).alias(f"mean_{g}") for g, _, _ in GROUPS],
        F.count_if(group.isNotNull() & ~group.isin(*[g for g, _, _ in GROUPS])).alias("other_groups"),
        _share(F.coalesce(target == "positive", F.lit(False))).alias("positive"),
        F.countDistinct("target").alias("n_classes"),
        *[F.coalesce(F.bool_or(group == g), F.lit(False)).alias(f"seen_{g}") for g, _, _ in GROUPS],
        *[F.coalesce(F.bool_or(target == c), F.lit(False)).alias(f"seen_{c}") for c in ("positive", "negative")],
        F.count_if(mixed.isin("num", "bool")).alias("mixed_n_num"),
        F.count_if(mixed.isin("cat", "date")).alias("mixed_n_str"),
        F.count_if(mixed.isNotNull() & (mixed != "null")).alias("mixed_n"),
    )


def verify(cells: DataFrame, records: DataFrame) -> DataFrame:
    """Ground-truth summary of a table: (name, value) rows of rates, correlations and means."""
    facts = _facts(_wide(cells, records))
    names = [f"miss_{f}" for f in FIELDS] + [
        "cond_alpha", "cond_other", "cond_inactive", "cond_active", "corr_ab", "corr_ac",
        *[f"mean_{g}" for g, _, _ in GROUPS], "positive",
    ]
    summary = facts.unpivot([], names, "name", "value")
    distinct = cells.filter(F.col("path").isin(*FIELDS)).groupBy("path").agg(
        F.countDistinct("num", "dtype").alias("numbers"), F.countDistinct("cat").alias("texts"), F.countDistinct("bool").alias("flags")
    )
    return summary.unionByName(
        distinct.select(
            F.concat(F.lit("distinct_"), "path").alias("name"), (F.col("numbers") + F.col("texts") + F.col("flags")).cast("double").alias("value")
        )
    )


def _order(side: str) -> Column:
    """Group names by their mean; groups without a mean are left out."""
    entries = F.array(*[F.struct(F.col(f"{side}.mean_{g}").alias("m"), F.lit(g).alias("g")) for g, _, _ in GROUPS])
    return F.transform(F.sort_array(F.filter(entries, lambda x: x["m"].isNotNull())), lambda x: x["g"])


def audit(
    synth_cells: DataFrame, synth: DataFrame, real_cells: DataFrame, real: DataFrame, tolerance: float = 0.10
) -> DataFrame:
    """PASS, WARN or FAIL of every structural check: (name, status, actual, expected)."""
    s_facts, r_facts = _facts(_wide(synth_cells, synth)), _facts(_wide(real_cells, real))
    both = s_facts.select(F.struct(*s_facts.columns).alias("s"), F.lit(1).alias("one")).join(
        r_facts.select(F.struct(*r_facts.columns).alias("r"), F.lit(1).alias("one")), "one"
    )
    s, r = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"r.{c}"))
    has = lambda *fs: _all([s(f"has_{f}") for f in fs])
    checks: list[tuple[str, Column, bool, Column | None, Column | None]] = []

    def check(name, passed, warn=False, actual=None, expected=None):
        checks.append((name, passed, warn, actual, expected))

    absent = sum((F.when(s(f"has_{f}"), 0).otherwise(1) for f in FIELDS[1:]), F.when(s(f"has_{FIELDS[0]}"), 0).otherwise(1))
    check("all_columns_present", absent == 0, False, absent, F.lit(0))
    for f in ("cont_a", "cont_b", "int_count", "cat_group", "bool_flag", "bool_active", "target"):
        # an absent column is a failure, a wrong type only a warning
        check(f"type_{f}", has(f) & (s(f"bad_{f}") == 0), None, s(f"bad_{f}"), F.lit(0))
    for f, rate in MISSING_RATES.items():
        actual = s(f"miss_{f}")
        close = actual < 0.02 if rate == 0.0 else F.abs(actual - rate) < tolerance
        check(f"missing_{f}", close, rate > 0, actual, F.lit(rate))
    check("cond_miss_cont_conditional", has("cat_group", "cont_conditional") & (s("cond_alpha") > s("cond_other") + 0.2),
          False, s("cond_alpha"), s("cond_other"))
    check("cond_miss_cat_nullable", has("bool_active", "cat_nullable") & (s("cond_inactive") > s("cond_active") + 0.2),
          False, s("cond_inactive"), s("cond_active"))
    check("corr_cont_a_cont_b", has("cont_a", "cont_b") & (F.abs(s("corr_ab") - r("corr_ab")) < 0.15), False, s("corr_ab"), r("corr_ab"))
    check("cat_num_shift_order", has("cont_b", "cat_group") & (_order("s") == _order("r")) & (s("other_groups") == r("other_groups")))
    check("target_balance", has("target") & (F.abs(s("positive") - r("positive")) < 0.15), False, s("positive"), r("positive"))
    check("target_classes", has("target") & (s("n_classes") == 2), False, s("n_classes"), F.lit(2))
    check("categories_cat_group", _all([s(f"seen_{g}") for g, _, _ in GROUPS]), True)
    check("categories_target", s("seen_positive") & s("seen_negative"), True)
    check("mixed_has_both_types", (s("mixed_n_num") > 0) & (s("mixed_n_str") > 0), False, s("mixed_n_num"), s("mixed_n_str"))
    mixed = lambda side: F.coalesce(F.try_divide(side("mixed_n_num"), side("mixed_n")), F.lit(0.0))
    check("mixed_type_proportion", F.abs(mixed(s) - mixed(r)) < 0.15, True, mixed(s), mixed(r))
    none = F.lit(None).cast("double")
    rows = []
    for name, passed, warn, actual, expected in checks:
        soft = F.when(has(name[5:]), "WARN").otherwise("FAIL") if warn is None else F.lit("WARN" if warn else "FAIL")
        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise(soft).alias("status"),
                (actual.cast("double") if actual is not None else none).alias("actual"),
                (expected.cast("double") if expected is not None else none).alias("expected"),
            )
        )
    return both.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
