"""Registered queries: column shapes and column-pair trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwise.operators import pairs as P
from cellwise.operators import shapes as S
from cellwise.operators.stats import ks_complement, tv_complement
from cellwise.plans.common import both, cells, r6
from cellwise.plans.oracle_parts import fields_of, pairs_of, with_parts
from cellwise.plans.registry import query
from cellwise.session import materialize

ALL_REPLICATES = (1, 2, 3)


def _fields(spark, sf, kind, replicates=None):
    own, base = both(spark, sf, kind)
    counts = S.value_counts(own, replicates=replicates)
    sizes = S.split_sizes(base, replicates=replicates)
    return S.field_fidelity(counts, sizes), counts, sizes


def _pairs(spark, sf, kind, replicates=None):
    own, base = both(spark, sf, kind)
    counts = S.value_counts(own, replicates=replicates)
    sizes = materialize(S.split_sizes(base, replicates=replicates))
    return P.pair_fidelity(own, counts, sizes, replicates=replicates), counts, sizes


@query(
    "presence_fidelity",
    with_parts(*fields_of("order")) + "SELECT path, round(presence_fidelity, 6) AS presence_fidelity FROM fields",
)
def presence(spark, sf):
    own, base = both(spark, sf, "order")
    return S.presence_fidelity(S.type_counts(S.value_counts(own)), S.split_sizes(base)).select("path", r6("presence_fidelity"))


@query(
    "type_fidelity",
    with_parts(*fields_of("event")) + "SELECT path, round(type_fidelity, 6) AS type_fidelity FROM fields",
)
def type_fidelity(spark, sf):
    return _fields(spark, sf, "event")[0].select("path", r6("type_fidelity"))


@query(
    "tv_complement",
    with_parts(*fields_of("event"))
    + "SELECT path, typ, round(score, 6) AS score FROM value_scores WHERE typ IN ('cat', 'bool', 'dtype')",
)
def tv(spark, sf):
    counts = S.value_counts(cells(spark, sf, "event")).filter(F.col("typ").isin("cat", "bool", "dtype"))
    return tv_complement(counts, [*S.FIELD, "typ"]).select("path", "typ", r6("score"))


@query(
    "ks_complement",
    with_parts(*fields_of("order"))
    + "SELECT path, typ, round(score, 6) AS score FROM value_scores WHERE typ IN ('num', 'date', 'alen')",
)
def ks(spark, sf):
    counts = S.value_counts(cells(spark, sf, "order")).filter(F.col("typ").isin("num", "date", "alen"))
    return ks_complement(counts, [*S.FIELD, "typ"]).select("path", "typ", r6("score"))


@query(
    "value_fidelity",
    with_parts(*fields_of("event"))
    + "SELECT path, round(value_fidelity, 6) AS value_fidelity FROM fields WHERE value_fidelity IS NOT NULL",
)
def value_fidelity(spark, sf):
    return _fields(spark, sf, "event")[0].filter("value_fidelity IS NOT NULL").select("path", r6("value_fidelity"))


@query(
    "length_fidelity",
    with_parts(*fields_of("order"))
    + "SELECT path, round(length_fidelity, 6) AS length_fidelity FROM fields WHERE length_fidelity IS NOT NULL",
)
def length_fidelity(spark, sf):
    return _fields(spark, sf, "order")[0].filter("length_fidelity IS NOT NULL").select("path", r6("length_fidelity"))


FIELD_SQL = """SELECT path, round(presence_fidelity, 6) AS presence_fidelity, round(type_fidelity, 6) AS type_fidelity,
  round(value_fidelity, 6) AS value_fidelity, round(length_fidelity, 6) AS length_fidelity, round(score, 6) AS score FROM fields"""


@query("field_fidelity", with_parts(*fields_of("event")) + FIELD_SQL)
def field_fidelity(spark, sf):
    """Flagship: every field of the event documents, scored on all parts."""
    parts = ("presence_fidelity", "type_fidelity", "value_fidelity", "length_fidelity", "score")
    return _fields(spark, sf, "event")[0].select("path", *[r6(p) for p in parts])


@query("field_fidelity_nested", with_parts(*fields_of("order")) + FIELD_SQL)
def field_fidelity_nested(spark, sf):
    parts = ("presence_fidelity", "type_fidelity", "value_fidelity", "length_fidelity", "score")
    return _fields(spark, sf, "order")[0].select("path", *[r6(p) for p in parts])


@query(
    "column_shapes",
    with_parts(*fields_of("event", replicated=True))
    + """SELECT rep AS replicate, round(sum(presence * score) / sum(presence), 6) AS shapes, count(*) AS num_fields
FROM fields GROUP BY rep""",
)
def column_shapes(spark, sf):
    fields, _, sizes = _fields(spark, sf, "event", ALL_REPLICATES)
    return S.column_shapes(fields, sizes).select("replicate", r6("shapes"), "num_fields")


@query(
    "pair_columns",
    with_parts(*pairs_of("order")) + "SELECT col, cont AS continuous FROM cols",
)
def pair_columns(spark, sf):
    own, base = both(spark, sf, "order")
    return P.pair_columns(S.value_counts(own), S.split_sizes(base)).select("col", "continuous")


@query("pair_catalog", with_parts(*pairs_of("event")) + "SELECT pair FROM catalog")
def pair_catalog(spark, sf):
    own, base = both(spark, sf, "event")
    return P.pair_catalog(P.pair_columns(S.value_counts(own), S.split_sizes(base))).select("pair")


@query(
    "pair_copresence",
    with_parts(*pairs_of("event"))
    + """SELECT pair, n_real, n_synth, round(co_rate_real, 6) AS co_rate_real, round(co_rate_synth, 6) AS co_rate_synth,
  round(presence, 6) AS weight FROM pairs""",
)
def pair_copresence(spark, sf):
    return _pairs(spark, sf, "event")[0].select(
        "pair", "n_real", "n_synth", r6("co_rate_real"), r6("co_rate_synth"), r6("presence", "weight")
    )


def _pair_kind(name, condition, sql_condition):
    @query(
        name,
        with_parts(*pairs_of("event")) + f"SELECT pair, metric, round(score, 6) AS score FROM pairs WHERE {sql_condition}",
    )
    def run(spark, sf):
        pairs = _pairs(spark, sf, "event")[0]
        suffix = "[.](num|date|alen)"
        first = F.col("pair").rlike(suffix + "[|]")
        second = F.col("pair").rlike(suffix + "$")
        return pairs.filter(condition(first, second)).select("pair", "metric", r6("score"))

    return run


_pair_kind("pair_contingency", lambda a, b: ~a & ~b, "NOT ca AND NOT cb")
_pair_kind("pair_correlation", lambda a, b: a & b, "ca AND cb")
_pair_kind("pair_mixed", lambda a, b: a != b, "ca <> cb")


@query(
    "pair_fidelity_nested",
    with_parts(*pairs_of("conv")) + "SELECT pair, metric, round(score, 6) AS score, round(presence, 6) AS weight FROM pairs",
)
def pair_fidelity_nested(spark, sf):
    return _pairs(spark, sf, "conv")[0].select("pair", "metric", r6("score"), r6("presence", "weight"))


@query(
    "column_pair_trends",
    with_parts(*pairs_of("event", replicated=True))
    + """SELECT rep AS replicate, round(sum(presence * score) / sum(presence), 6) AS trends, count(*) AS num_pairs
FROM pairs GROUP BY rep""",
)
def column_pair_trends(spark, sf):
    pairs, _, sizes = _pairs(spark, sf, "event", ALL_REPLICATES)
    return P.column_pair_trends(pairs, sizes).select("replicate", r6("trends"), "num_pairs")


@query(
    "fidelity_overall",
    with_parts(*fields_of("event"), pairs_of("event")[-1])
    + """SELECT round((shapes + trends) / 2, 6) AS fidelity, round(shapes, 6) AS shapes, round(trends, 6) AS trends, num_fields, num_pairs
FROM (SELECT sum(presence * score) / sum(presence) AS shapes, count(*) AS num_fields FROM fields),
     (SELECT sum(presence * score) / sum(presence) AS trends, count(*) AS num_pairs FROM pairs)""",
)
def fidelity_overall(spark, sf):
    pairs, counts, sizes = _pairs(spark, sf, "event")
    shapes = S.column_shapes(S.field_fidelity(counts, sizes), sizes)
    return P.fidelity_overall(shapes, P.column_pair_trends(pairs, sizes)).select(
        r6("fidelity"), r6("shapes"), r6("trends"), "num_fields", "num_pairs"
    )


@query(
    "worst_fields",
    with_parts(*fields_of("order"))
    + """SELECT path, round(score, 6) AS score, round(weight, 6) AS weight, round(cost, 6) AS cost FROM (
  SELECT path, score, weight, (1 - score) * weight AS cost FROM (
    SELECT path, score, presence / sum(presence) OVER () AS weight FROM fields))
ORDER BY round(cost, 9) DESC, path LIMIT 10""",
)
def worst_fields(spark, sf):
    fields = S.with_weights(_fields(spark, sf, "order")[0])
    return S.worst(fields, "path").select("path", r6("score"), r6("weight"), r6("cost"))


@query(
    "worst_pairs",
    with_parts(*pairs_of("event"))
    + """SELECT pair, metric, round(score, 6) AS score, round(weight, 6) AS weight, round(cost, 6) AS cost FROM (
  SELECT pair, metric, score, weight, (1 - score) * weight AS cost FROM (
    SELECT pair, metric, score, presence / sum(presence) OVER () AS weight FROM pairs))
ORDER BY round(cost, 9) DESC, pair LIMIT 10""",
)
def worst_pairs(spark, sf):
    pairs = P.pair_weights(_pairs(spark, sf, "event")[0])
    return S.worst(pairs, "pair").select("pair", "metric", r6("score"), r6("weight"), r6("cost"))


@query(
    "informative_column",
    with_parts(*fields_of("event"))
    + """SELECT path, path || '.' || CASE WHEN is_array THEN 'alen' WHEN c_all = 0 THEN 'dtype'
  WHEN c_num >= greatest(c_cat, c_bool, c_date) THEN 'num' WHEN c_cat >= greatest(c_bool, c_date) THEN 'cat'
  WHEN c_bool >= c_date THEN 'bool' ELSE 'date' END AS plot_column FROM fields""",
)
def informative_column(spark, sf):
    return S.informative_column(_fields(spark, sf, "event")[0]).select("path", "plot_column")
