"""Registered queries: splits, samples, feature encoding and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwise.operators import features as E
from cellwise.operators import privacy as V
from cellwise.operators import splitting as X
from cellwise.operators.cells import flatten, typed_view
from cellwise.plans.common import both, r6, records
from cellwise.plans.oracle_parts import DOCS, TYPED, cells_of, with_parts
from cellwise.plans.registry import query
from cellwise.session import materialize, table

SEED = 42


def _orders(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS rid", "o_orderstatus AS status", "o_orderpriority AS priority")


RANKED = "row_number() OVER ({part} ORDER BY md5('42:' || o_orderkey))"


@query(
    "split_random",
    f"""SELECT rid, CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT o_orderkey AS rid, {RANKED.format(part='')} AS r, count(*) OVER () AS n FROM orders)""",
)
def split_random(spark, sf):
    return X.split_random(_orders(spark, sf), 0.9, SEED).select("rid", "part")


@query(
    "split_dcr",
    f"""SELECT rid, CASE WHEN r <= floor(n * 0.5) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT o_orderkey AS rid, {RANKED.format(part='')} AS r, count(*) OVER () AS n FROM orders)""",
)
def split_dcr(spark, sf):
    parts = X.split_random(_orders(spark, sf), 0.9, 7)
    train, test = (parts.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    return X.resplit_half(train, test, SEED).select("rid", "part")


@query(
    "subsample_stratified",
    f"""SELECT rid, status FROM (SELECT o_orderkey AS rid, o_orderstatus AS status,
    {RANKED.format(part='PARTITION BY o_orderstatus')} AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
WHERE r <= greatest(1, round_even(n * 0.13, 0))""",
)
def subsample_stratified(spark, sf):
    return X.subsample_stratified(_orders(spark, sf), 0.13, "status", SEED).select("rid", "status")


@query(
    "subsample_equal",
    with_parts(DOCS["event"])
    + """SELECT rid, split FROM (SELECT rid, split, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || rid)) AS r FROM docs)
WHERE split <> 'train' OR r <= (SELECT count(*) FROM docs WHERE split = 'test')""",
)
def subsample_equal(spark, sf):
    return X.subsample_equal(records(spark, sf, "event").select("rid", "split"), seed=SEED)


@query(
    "subsample_cap",
    f"SELECT rid FROM (SELECT o_orderkey AS rid, {RANKED.format(part='')} AS r FROM orders) WHERE r <= 1000",
)
def subsample_cap(spark, sf):
    return X.subsample_cap(_orders(spark, sf), 1000, SEED).select("rid")


@query(
    "stratified_kfold",
    f"SELECT o_orderkey AS rid, ({RANKED.format(part='PARTITION BY o_orderstatus')} - 1) % 3 AS fold FROM orders",
)
def stratified_kfold(spark, sf):
    return X.stratified_kfold(_orders(spark, sf), "status", 3, SEED).select("rid", "fold")


# -- features -----------------------------------------------------------------------------

COLS = """cols AS (SELECT path, typ, path || '.' || typ AS col FROM (
    SELECT path, typ, count(DISTINCT coalesce(s, CAST(x AS VARCHAR))) AS levels, count(*) AS present FROM typed GROUP BY path, typ)
  WHERE levels + CASE WHEN typ = 'dtype' AND present < (SELECT count(*) FROM docs) THEN 1 ELSE 0 END > 1)"""
ONEHOT = """onehot AS (
  SELECT rid, split, col || '_' || s AS name, 1.0::DOUBLE AS value FROM typed JOIN cols USING (path, typ) WHERE typ IN ('cat', 'dtype')
  UNION ALL
  SELECT d.rid, d.split, col || CASE WHEN typ = 'dtype' THEN '_missing' ELSE '_NaN' END, 1.0::DOUBLE
  FROM docs d, cols c WHERE typ IN ('cat', 'dtype')
    AND NOT EXISTS (SELECT 1 FROM typed t WHERE t.rid = d.rid AND t.path = c.path AND t.typ = c.typ))"""
NUMERIC = """numbers AS (
  SELECT rid, split, col AS name, CASE WHEN typ = 'date' THEN x * 1000 ELSE x END AS value FROM typed JOIN cols USING (path, typ)
  WHERE typ IN ('num', 'alen', 'date'))"""
BOOLS = """flags AS (SELECT rid, split, col AS name, CASE WHEN s = 'True' THEN 1.0 ELSE 0.0 END::DOUBLE AS value
  FROM typed JOIN cols USING (path, typ) WHERE typ = 'bool')"""


def _typed(spark, sf, kind="event"):
    own, base = both(spark, sf, kind)
    return typed_view(own), base


def _columns(typed, recs):
    return materialize(E.informative_columns(typed, recs.agg(F.count(F.lit(1)))))


@query("informative_columns", with_parts(*cells_of("event"), TYPED, COLS) + "SELECT col FROM cols")
def informative_columns(spark, sf):
    return _columns(*_typed(spark, sf)).select("col")


@query(
    "encode_numeric",
    with_parts(*cells_of("event"), TYPED, COLS, NUMERIC)
    + "SELECT rid, name, CASE WHEN name = 'ts.date' THEN value / 1e9 ELSE round(value, 6) END AS value FROM numbers",
)
def encode_numeric(spark, sf):
    typed, recs = _typed(spark, sf)
    kept = typed.join(_columns(typed, recs).select("path", "typ"), ["path", "typ"], "left_semi")
    value = F.when(F.col("name") == "ts.date", F.col("value") / 1e9).otherwise(F.round("value", 6))
    return E.encode_numeric(kept).select("rid", "name", value.alias("value"))


@query(
    "encode_onehot",
    with_parts(*cells_of("event"), TYPED, COLS, ONEHOT) + "SELECT rid, name, value FROM onehot",
)
def encode_onehot(spark, sf):
    typed, recs = _typed(spark, sf)
    columns = _columns(typed, recs)
    kept = typed.join(columns.select("path", "typ"), ["path", "typ"], "left_semi")
    return E.encode_onehot(kept, columns, recs).select("rid", "name", "value")


@query(
    "encode_ordinal",
    with_parts(*cells_of("order"), TYPED, COLS)
    + """, levels AS (SELECT DISTINCT col, s FROM (SELECT col, s FROM typed JOIN cols USING (path, typ) WHERE typ IN ('cat', 'dtype')
    UNION ALL SELECT c.col, CASE WHEN c.typ = 'dtype' THEN 'missing' ELSE 'NaN' END FROM cols c
      WHERE c.typ IN ('cat', 'dtype') AND (SELECT count(*) FROM typed t WHERE t.path = c.path AND t.typ = c.typ) < (SELECT count(*) FROM docs)))
SELECT col, s, row_number() OVER (PARTITION BY col ORDER BY s) - 1 AS code FROM levels""",
)
def encode_ordinal(spark, sf):
    typed, recs = _typed(spark, sf, "order")
    return E.ordinal_codes(typed, recs, _columns(typed, recs))


@query(
    "encode_bool",
    with_parts(*cells_of("event"), TYPED, COLS, BOOLS) + "SELECT rid, name, value FROM flags",
)
def encode_bool(spark, sf):
    typed, recs = _typed(spark, sf)
    kept = typed.join(_columns(typed, recs).select("path", "typ"), ["path", "typ"], "left_semi")
    return E.encode_bool(kept).select("rid", "name", "value")


@query(
    "encode_inf",
    """SELECT event_id AS rid, round(value, 6) AS value FROM events WHERE event_id % 9 > 1""",
)
def encode_inf(spark, sf):
    """Infinite and NaN numbers leave no feature."""
    x = F.expr("CASE WHEN event_id % 9 = 0 THEN double('infinity') WHEN event_id % 9 = 1 THEN double('NaN') ELSE value END")
    typed = table(spark, sf, "events").select(
        F.col("event_id").alias("rid"), F.lit("value").alias("path"), F.lit("num").alias("typ"), x.alias("x")
    )
    return E.encode_numeric(typed, ("rid",)).select("rid", r6("value"))


FEATURES = "features AS (SELECT * FROM numbers UNION ALL SELECT * FROM flags UNION ALL SELECT * FROM onehot)"


@query(
    "scale_by_train_range",
    with_parts(*cells_of("event"), TYPED, COLS, NUMERIC, BOOLS, ONEHOT, FEATURES)
    + """SELECT rid, name, round(value / coalesce(nullif(w, 0), 1), 6) AS value FROM features LEFT JOIN (
  SELECT name, max(value) - min(value) AS w FROM numbers WHERE split = 'train' GROUP BY name) USING (name)""",
)
def scale_by_train_range(spark, sf):
    typed, recs = _typed(spark, sf)
    return E.scale_by_train_range(E.encode_features(typed, recs)).select("rid", "name", r6("value"))


# -- privacy ------------------------------------------------------------------------------


@query("record_hash", with_parts(DOCS["order"]) + "SELECT rid, sha256(doc) AS hash FROM docs")
def record_hash(spark, sf):
    return V.record_hash(records(spark, sf, "order")).select("rid", "hash")


COPIES = """SELECT count(*) FILTER (a) AS exact_matches_train, count(*) FILTER (b) AS exact_matches_test,
  count(*) FILTER (a AND NOT b) AS exact_matches_train_only
FROM (SELECT doc IN (SELECT doc FROM docs WHERE split = 'train') AS a, doc IN (SELECT doc FROM docs WHERE split = 'test') AS b
      FROM docs WHERE split = 'synth')"""


@query("exact_matches", with_parts(DOCS["customer"]) + COPIES)
def exact_matches(spark, sf):
    return V.exact_matches(records(spark, sf, "customer"))


FAIR = """fair AS (SELECT rid, split, acctbal, nation, segment FROM (
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || rid)) AS r FROM docs)
  WHERE split <> 'train' OR r <= (SELECT count(*) FROM docs WHERE split = 'test')),
widths AS (SELECT max(acctbal) - min(acctbal) AS wa, (max(nation) - min(nation))::DOUBLE AS wn FROM fair WHERE split = 'train'),
points AS (SELECT rid, split, coalesce(acctbal / wa, 0) AS a, nation / wn AS n, segment AS s, acctbal IS NULL AS m FROM fair, widths),
distances AS (SELECT q.rid, r.split, min(sqrt((q.a - r.a) * (q.a - r.a) + (q.n - r.n) * (q.n - r.n)
    + CASE WHEN q.s <> r.s THEN 2 ELSE 0 END + CASE WHEN q.m <> r.m THEN 2 ELSE 0 END)) AS d
  FROM points q JOIN points r ON q.split = 'synth' AND r.split IN ('train', 'test') GROUP BY q.rid, r.split),
dcr AS (SELECT rid, max(d) FILTER (split = 'train') AS d_train, max(d) FILTER (split = 'test') AS d_test FROM distances GROUP BY rid)"""


def _fair_vectors(spark, sf):
    fair = materialize(X.subsample_equal(records(spark, sf, "customer"), seed=SEED))
    return materialize(V.privacy_vectors(flatten(fair, max_depth=1), fair))


@query(
    "dcr_distance",
    with_parts(DOCS["customer"], FAIR) + "SELECT rid, round(d_train, 6) AS d_train, round(d_test, 6) AS d_test FROM dcr",
)
def dcr_distance(spark, sf):
    """Exact nearest training and test record of every synthetic customer."""
    return V.dcr_distances(_fair_vectors(spark, sf)).select("rid", r6("d_train"), r6("d_test"))


@query(
    "dcr_score",
    with_parts(DOCS["customer"], FAIR) + "SELECT round(avg(CASE WHEN d_train < d_test THEN 1.0 ELSE 0.0 END) * 100, 6) AS dcr_score FROM dcr",
)
def dcr_score(spark, sf):
    return V.dcr_score(V.dcr_distances(_fair_vectors(spark, sf))).select(r6("dcr_score"))


@query(
    "privacy_overall",
    with_parts(DOCS["customer"], FAIR)
    + f"""SELECT *, round(1 - 2 * greatest(dcr_score / 100 - 0.5, 0), 6) AS privacy_score FROM ({COPIES}),
  (SELECT round(avg(CASE WHEN d_train < d_test THEN 1.0 ELSE 0.0 END) * 100, 6) AS dcr_score FROM dcr),
  (SELECT count(*) AS ref_size FROM docs WHERE split = 'test')""",
)
def privacy_overall(spark, sf):
    out = V.privacy_metrics(records(spark, sf, "customer"), lambda r: flatten(r, max_depth=1), seed=SEED)
    return out.select(
        "exact_matches_train", "exact_matches_test", "exact_matches_train_only", r6("dcr_score"), "ref_size", r6("privacy_score")
    )


PROJECTED = """named AS (SELECT DISTINCT name FROM features),
size AS (SELECT 1.0 / sqrt(count(*)) AS density, sqrt(sqrt(count(*))) / sqrt(8.0) AS scale FROM named),
ids AS (SELECT name, CAST('0x' || substr(md5(name), 1, 15) AS BIGINT) AS id FROM named),
draws AS (SELECT name, k, md5('42.' || id || ':' || k) AS h FROM ids, range(8) t(k)),
places AS (SELECT name, CASE WHEN CAST('0x' || substr(h, 14, 1) AS INTEGER) >= 8 THEN 1.0 ELSE -1.0 END AS sign,
    sum(floor(ln(1.0 - CAST('0x' || substr(h, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE) / ln(1.0 - density)) + 1) OVER (PARTITION BY name ORDER BY k) - 1 AS component
  FROM draws, size),
matrix AS (SELECT name, CAST(component AS INTEGER) AS component, sign * scale AS weight FROM places, size WHERE component < 8),
widths AS (SELECT name, max(value) - min(value) AS w FROM numbers WHERE split = 'train' GROUP BY name),
scaled AS (SELECT rid, split, name, value / coalesce(nullif(w, 0), 1) AS value FROM features LEFT JOIN widths USING (name))"""


@query(
    "random_projection",
    with_parts(*cells_of("event"), TYPED, COLS, NUMERIC, BOOLS, ONEHOT, FEATURES, PROJECTED)
    + """SELECT rid, CAST(component AS BIGINT) AS component, round(sum(value * weight), 6) + 0.0 AS value FROM scaled JOIN matrix USING (name) GROUP BY ALL
HAVING abs(sum(value * weight)) > 1e-9""",
)
def random_projection(spark, sf):
    """All entries of the feature vectors projected to eight dimensions."""
    base = materialize(records(spark, sf, "event"))
    vectors = V.privacy_vectors(flatten(base, max_depth=2), base, n_components=8)
    entries = vectors.select("rid", F.explode(F.arrays_zip(F.col("idx").alias("component"), F.col("val").alias("value"))).alias("e"))
    return entries.select("rid", "e.component", "e.value").where("abs(value) > 1e-9").select("rid", "component", r6("value"))
