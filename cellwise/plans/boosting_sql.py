"""Check SQL of the boosted learner: the trees of all models as a chain of common table expressions.

``m`` numbers the trees of a round: a fold's, or a class's of one training set. ``trains`` marks the rows they grow on."""

from __future__ import annotations

UNIT = 16777216  # gradients are counted in multiples of 2**-24

# Features of the documents in ``used``: numbers by bin (absent: -1), texts and dtypes by level.
FEATURES = """fields AS (SELECT path, typ, path || '.' || typ AS col, typ IN ('cat', 'dtype') AS text FROM (
    SELECT path, typ, count(*) AS levels, sum(m) AS present FROM (SELECT path, typ, x, s, count(*) AS m FROM shown GROUP BY ALL) GROUP BY path, typ)
  WHERE levels + CASE WHEN typ = 'dtype' AND present < (SELECT count(*) FROM used) THEN 1 ELSE 0 END > 1),
named AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY col) - 1 AS f FROM fields),
numbers AS MATERIALIZED (SELECT rid, f, CASE WHEN typ = 'date' THEN x * 1000.0 WHEN typ = 'bool' THEN (s = 'True')::INT::DOUBLE ELSE x END AS v
  FROM shown JOIN named USING (path, typ) WHERE NOT text),
counted AS (SELECT f, v, count(*) AS m FROM numbers GROUP BY f, v),
parts AS (SELECT f, v, CASE WHEN count(*) OVER (PARTITION BY f) <= 256 THEN row_number() OVER (PARTITION BY f ORDER BY v)
    ELSE ((sum(m) OVER (PARTITION BY f ORDER BY v) - m) * 256) // sum(m) OVER (PARTITION BY f) END AS part FROM counted),
cuts AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS b FROM (SELECT f, part, min(v) AS v FROM parts GROUP BY f, part)),
binned AS (SELECT n.rid, n.f, c.b FROM numbers n ASOF JOIN cuts c ON n.f = c.f AND n.v >= c.v),
labels AS (SELECT u.rid, k.f, coalesce(t.s, CASE WHEN k.typ = 'dtype' THEN 'missing' ELSE 'NaN' END) AS s
  FROM used u CROSS JOIN (SELECT * FROM named WHERE text) k LEFT JOIN shown t ON t.rid = u.rid AND t.path = k.path AND t.typ = k.typ),
entries AS MATERIALIZED (
  SELECT rid, f, true AS text, dense_rank() OVER (PARTITION BY f ORDER BY s) - 1 AS b FROM labels
  UNION ALL SELECT u.rid, k.f, false, coalesce(b.b, -1) FROM used u CROSS JOIN (SELECT * FROM named WHERE NOT text) k LEFT JOIN binned b ON b.rid = u.rid AND b.f = k.f),
"""
# Three folds over the training and synthetic documents.
FOLDS = f"""used AS MATERIALIZED (SELECT rid, split, split = 'train' AS y FROM docs WHERE split IN ('train', 'synth')),
shown AS MATERIALIZED (SELECT rid, path, typ, x, s FROM typed WHERE split IN ('train', 'synth')),
{FEATURES}
folded AS MATERIALIZED (SELECT rid, y, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || rid)) - 1) % 3 AS fold FROM used),
margin0 AS MATERIALIZED (SELECT m, rid, y, fold <> m AS trains, 0.0::DOUBLE AS margin FROM folded, (VALUES (0), (1), (2)) t(m))"""


def by_class(target: str, classes: int) -> str:
    """Training on real and on synthetic documents, one tree per class of the text field ``target``; test documents are scored."""
    return f"""used AS MATERIALIZED (SELECT rid, split, dense_rank() OVER (ORDER BY s) - 1 AS class FROM docs JOIN (SELECT rid, s FROM typed WHERE path = '{target}' AND typ = 'cat') USING (rid)),
shown AS MATERIALIZED (SELECT rid, path, typ, x, s FROM typed WHERE path <> '{target}' AND NOT starts_with(path, '{target}.')),
{FEATURES}
margin0 AS MATERIALIZED (SELECT k * {classes} + o AS m, rid, class = o AS y, split = own AS trains, 0.0::DOUBLE AS margin
  FROM used, (VALUES (0, 'train'), (1, 'synth')) t(k, own), range({classes}) c(o) WHERE split IN (own, 'test'))"""


def level(t: int, d: int) -> list[str]:
    """Sums, cuts, best cuts and new nodes of one level of round ``t``."""
    k = f"{t}_{d}"
    before = f"grad{t}" if d == 0 else f"node{t}_{d - 1}"
    return [
        f"""sums{k} AS MATERIALIZED (SELECT m, node, f, text, b, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h
  FROM {before} JOIN entries USING (rid) WHERE trains AND open GROUP BY ALL)""",
        f"""placed{k} AS MATERIALIZED (
  SELECT m, node, f, text, b, g, h, row_number() OVER w AS i, count(*) OVER a AS n, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(g) OVER a AS ag, sum(h) OVER a AS ah, 0 AS mg, 0 AS mh
  FROM sums{k} WHERE text WINDOW a AS (PARTITION BY m, node, f), w AS (PARTITION BY m, node, f ORDER BY (g * (1.0::DOUBLE / {UNIT})) / (h / {UNIT}.0::DOUBLE + 1.0), b ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT m, node, f, text, b, g, h, b, max(b) OVER a, sum(g) FILTER (b >= 0) OVER w, sum(h) FILTER (b >= 0) OVER w, sum(g) OVER a, sum(h) OVER a,
    coalesce(sum(g) FILTER (b < 0) OVER a, 0), coalesce(sum(h) FILTER (b < 0) OVER a, 0)
  FROM sums{k} WHERE NOT text WINDOW a AS (PARTITION BY m, node, f), w AS (PARTITION BY m, node, f ORDER BY b ROWS UNBOUNDED PRECEDING))""",
        f"""tried{k} AS (SELECT m, node, f, text, i, n, side, ah, (lg + side * mg) * (1.0::DOUBLE / {UNIT}) AS gl, (lh + side * mh) / {UNIT}.0::DOUBLE AS hl,
    (ag - lg - side * mg) * (1.0::DOUBLE / {UNIT}) AS gr, (ah - lh - side * mh) / {UNIT}.0::DOUBLE AS hr, ag * (1.0::DOUBLE / {UNIT}) AS g0, ah / {UNIT}.0::DOUBLE AS h0
  FROM placed{k}, (VALUES (0), (1)) s(side) WHERE CASE WHEN text THEN side = 0 AND i < n AND least(i, n - i) <= 64 ELSE b >= 0 END)""",
        f"""best{k} AS MATERIALIZED (SELECT * FROM (SELECT *, gl * gl / (hl + 1.0) + gr * gr / (hr + 1.0) - g0 * g0 / (h0 + 1.0) AS gain FROM tried{k} WHERE hl >= 1.0 AND hr >= 1.0)
  WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY m, node ORDER BY gain DESC, f, i, side) = 1)""",
        f"""node{k} AS MATERIALIZED (SELECT r.m, r.rid, r.y, r.trains, r.margin, r.g, r.h, c.node IS NOT NULL AS open,
    CASE WHEN c.node IS NULL THEN r.node
         WHEN CASE WHEN c.text THEN CASE WHEN p.b IS NULL THEN c.i > c.n - c.i ELSE p.i <= c.i END WHEN e.b < 0 THEN c.side = 1 ELSE c.i = c.n OR e.b <= c.i END THEN 2 * r.node
         ELSE 2 * r.node + 1 END AS node
  FROM {before} r LEFT JOIN best{k} c ON c.m = r.m AND c.node = r.node AND r.open LEFT JOIN entries e ON e.rid = r.rid AND e.f = c.f
  LEFT JOIN placed{k} p ON c.text AND p.text AND p.m = c.m AND p.node = c.node AND p.f = c.f AND p.b = e.b)""",
    ]


def boosted(start: str, trees: int, depth: int, classes: int = 0) -> str:
    """All rounds from ``start``; ``margin<trees>`` holds the margins, ``best<round>_<level>`` the cuts. With ``classes``, the trees
    of a training set share their gradients."""
    if classes:
        p = f"""SELECT *, e / sum(e) OVER (PARTITION BY m // {classes}, rid) AS p FROM (
    SELECT *, exp(margin - max(margin) OVER (PARTITION BY m // {classes}, rid)) AS e FROM margin{{t}})"""
    else:
        p = "SELECT *, 1.0::DOUBLE / (1.0 + exp(-margin)) AS p FROM margin{t}"
    out = [start]
    for t in range(trees):
        out.append(
            f"""grad{t} AS MATERIALIZED (SELECT m, rid, y, trains, margin, 1 AS node, true AS open, floor((p - y::INT) * {UNIT}.0 + 0.5)::BIGINT AS g,
    greatest(floor(p * (1.0 - p) * {2 if classes else 1}.0 * {UNIT}.0 + 0.5), 1)::BIGINT AS h FROM ({p.format(t=t)}))"""
        )
        for d in range(depth):
            out += level(t, d)
        last = f"node{t}_{depth - 1}"
        out.append(
            f"""margin{t + 1} AS MATERIALIZED (SELECT r.m, r.rid, r.y, r.trains, r.margin + w.value AS margin FROM {last} r JOIN (
    SELECT m, node, -(sum(g) * (1.0::DOUBLE / {UNIT})) / (sum(h) / {UNIT}.0::DOUBLE + 1.0) * 0.3 AS value FROM {last} WHERE trains GROUP BY m, node) w USING (m, node))"""
        )
    return ",\n".join(out)


def class_predictions(trees: int, classes: int) -> str:
    """Most probable class of every test document by either training, and its probability."""
    return f"""odds AS (SELECT m // {classes} AS k, m % {classes} AS o, rid, exp(margin - max(margin) OVER w) / sum(exp(margin)) OVER w * exp(max(margin) OVER w) AS p
  FROM margin{trees} WHERE NOT trains WINDOW w AS (PARTITION BY m // {classes}, rid)),
predicted AS (SELECT CASE k WHEN 0 THEN 'real' ELSE 'synth' END AS trained_on, rid, o::DOUBLE AS prediction, p FROM odds QUALIFY row_number() OVER (PARTITION BY k, rid ORDER BY p DESC, o) = 1)"""


def fold_areas(trees: int) -> str:
    """ROC AUC of every fold's held-out rows."""
    return f"""held AS (SELECT m, y, 1.0::DOUBLE / (1.0 + exp(-margin)) AS p FROM margin{trees} WHERE NOT trains),
ranked AS (SELECT m, y, rank() OVER (PARTITION BY m ORDER BY p) + (count(*) OVER (PARTITION BY m, p) - 1) / 2.0 AS r FROM held),
areas AS (SELECT m, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * (count(*) FILTER (NOT y))::DOUBLE) AS auc FROM ranked GROUP BY m)"""


def fold_gains(trees: int, depth: int) -> str:
    """Mean gain per use of every feature in every fold's model."""
    cuts = " UNION ALL ".join(f"SELECT m, f, gain FROM best{t}_{d}" for t in range(trees) for d in range(depth))
    return f"ledger AS ({cuts}), used_gain AS (SELECT m, f, avg(gain) AS gain FROM ledger GROUP BY m, f)"
