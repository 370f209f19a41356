"""Building blocks of the check SQL (ANSI SQL with JSON functions) over the given tables."""

from __future__ import annotations

SPLIT = "CASE WHEN {id} % 5 IN (0, 1) THEN 'train' WHEN {id} % 5 = 2 THEN 'test' ELSE 'synth' END"


def number_text(expr: str) -> str:
    return f"regexp_replace(CAST(CAST({expr} AS DECIMAL(18,2)) AS VARCHAR), '[.]?0+$', '')"


EVENT_DOCS = f"""docs AS (
  SELECT event_id AS rid, {SPLIT.format(id='event_id')} AS split, CAST(event_id % 3 + 1 AS INTEGER) AS replicate,
    '{{"props":' || replace(props, ' ', '')
    || CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"' END
    || ',"type":"' || event_type || '"'
    || ',"value":' || CASE WHEN event_id % 13 = 0 THEN '"n/a"' WHEN event_id % 17 = 0 THEN 'null'
                           ELSE {number_text('value')} END
    || ',"vip":' || CASE WHEN user_id % 3 = 0 THEN 'true' ELSE 'false' END || '}}' AS doc
  FROM events)"""

ORDER_DOCS = f"""order_items AS (
  SELECT l_orderkey, string_agg('{{"flag":"' || l_returnflag || '","ln":' || l_linenumber || ',"part":' || l_partkey || '}}', ','
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS items
  FROM lineitem GROUP BY l_orderkey),
docs AS (
  SELECT o_orderkey AS rid, {SPLIT.format(id='o_orderkey')} AS split, CAST(o_orderkey % 3 + 1 AS INTEGER) AS replicate,
    '{{"customer":{{"key":' || o_custkey || '}},"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","items":['
    || coalesce(items, '') || '],"status":"' || o_orderstatus || '","total":' || {number_text('o_totalprice')} || '}}' AS doc
  FROM orders LEFT JOIN order_items ON o_orderkey = l_orderkey)"""

CONV_DOCS = f"""docs AS (
  SELECT conv_id AS rid, {SPLIT.format(id='conv_id')} AS split, CAST(conv_id % 3 + 1 AS INTEGER) AS replicate,
    '{{"conv_id":' || conv_id || ',"turns":[' || string_agg('{{"n":' || length(text) || ',"role":"' || role || '","turn":' || turn || '}}',
       ',' ORDER BY turn, role, length(text)) || ']}}' AS doc
  FROM conversations GROUP BY conv_id)"""

CUSTOMER_DOCS = f"""docs AS (
  SELECT k.c_custkey AS rid, {SPLIT.format(id='k.c_custkey')} AS split, CAST(k.c_custkey % 3 + 1 AS INTEGER) AS replicate,
    CASE WHEN s.c_custkey % 7 = 0 THEN NULL ELSE s.c_acctbal END AS acctbal, s.c_nationkey AS nation, s.c_mktsegment AS segment,
    '{{' || CASE WHEN s.c_custkey % 7 = 0 THEN '' ELSE '"acctbal":' || {number_text('s.c_acctbal')} || ',' END
    || '"nation":' || s.c_nationkey || ',"segment":"' || s.c_mktsegment || '"}}' AS doc
  FROM customer k JOIN customer s ON s.c_custkey = CASE WHEN k.c_custkey % 10 = 3 THEN k.c_custkey - 3 ELSE k.c_custkey END)"""

DOCS = {"event": EVENT_DOCS, "order": ORDER_DOCS, "conv": CONV_DOCS, "customer": CUSTOMER_DOCS}

CELLS = """cells AS (
  SELECT rid, split, replicate, path, len(path) - len(replace(path, '.', '')) + 1 AS depth,
    dtype, json,
    CASE WHEN dtype = 'num' THEN CAST(json AS DOUBLE) END AS num,
    CASE WHEN dtype = 'cat' THEN txt END AS cat,
    CASE WHEN dtype = 'date' THEN epoch_us(TRY_CAST(txt AS TIMESTAMP)) END AS date_us,
    CASE WHEN dtype = 'bool' THEN json = 'true' END AS bool,
    CASE WHEN dtype = 'array' THEN json_array_length(json) END AS alen
  FROM (
    SELECT d.rid, d.split, d.replicate, CAST(t.value AS VARCHAR) AS json, t.value ->> '$' AS txt,
      regexp_replace(substr(t.fullkey, 3), '\\[(\\d+)\\]', '.\\1', 'g') AS path,
      CASE WHEN t.type = 'NULL' THEN 'null' WHEN t.type = 'BOOLEAN' THEN 'bool'
           WHEN t.type = 'VARCHAR' THEN CASE WHEN regexp_matches(t.value ->> '$', '^\\d{4}-\\d{2}-\\d{2}(T\\d{2}:\\d{2}:\\d{2})?')
                                             THEN 'date' ELSE 'cat' END
           WHEN t.type = 'ARRAY' THEN 'array' WHEN t.type = 'OBJECT' THEN 'object' ELSE 'num' END AS dtype
    FROM docs d, json_tree(d.doc) t WHERE t.fullkey <> '$') q)"""

TYPED = """typed AS (
  SELECT rid, split, replicate, path, 'dtype' AS typ, CAST(NULL AS DOUBLE) AS x, dtype AS s FROM cells
  UNION ALL SELECT rid, split, replicate, path, 'num', num, NULL FROM cells WHERE num IS NOT NULL
  UNION ALL SELECT rid, split, replicate, path, 'cat', NULL, cat FROM cells WHERE cat IS NOT NULL
  UNION ALL SELECT rid, split, replicate, path, 'date', CAST(date_us AS DOUBLE), NULL FROM cells WHERE date_us IS NOT NULL
  UNION ALL SELECT rid, split, replicate, path, 'bool', NULL, CASE WHEN bool THEN 'True' ELSE 'False' END FROM cells WHERE bool IS NOT NULL
  UNION ALL SELECT rid, split, replicate, path, 'alen', CAST(alen AS DOUBLE), NULL FROM cells WHERE alen IS NOT NULL)"""

# One real side (train) against one synthetic side per evaluation.
SIZES = """sizes AS (
  SELECT rep, count(*) FILTER (split = 'train') AS rows_real, count(*) FILTER (split = 'synth') AS rows_synth
  FROM (SELECT 0 AS rep, split FROM docs) GROUP BY rep)"""
SIDED = "sided AS (SELECT 0 AS rep, split, rid, path, typ, x, s FROM typed WHERE split IN ('train', 'synth'))"

SIZES_REPLICATED = """reps AS (SELECT DISTINCT replicate AS rep FROM docs),
sizes AS (
  SELECT rep, count(*) FILTER (split = 'train') AS rows_real, count(*) FILTER (split = 'synth' AND replicate = rep) AS rows_synth
  FROM docs, reps GROUP BY rep)"""
SIDED_REPLICATED = """sided AS (SELECT rep, split, rid, path, typ, x, s FROM typed, reps
  WHERE split = 'train' OR (split = 'synth' AND replicate = rep))"""

FREQ = """freq AS (
  SELECT rep, path, typ, x, s, count(*) FILTER (split = 'train') AS nr, count(*) FILTER (split = 'synth') AS ns
  FROM sided GROUP BY rep, path, typ, x, s)"""

VALUE_SCORES = """tot AS (SELECT rep, path, typ, sum(nr) AS tr, sum(ns) AS ts FROM freq GROUP BY rep, path, typ),
tv AS (SELECT rep, path, typ, coalesce(1 - 0.5 * sum(abs(nr / nullif(tr, 0)::DOUBLE - ns / nullif(ts, 0)::DOUBLE)), 0) AS score
       FROM freq JOIN tot USING (rep, path, typ) WHERE typ IN ('dtype', 'cat', 'bool') GROUP BY rep, path, typ),
cdf AS (SELECT rep, path, typ, x, sum(nr) OVER w AS cr, sum(ns) OVER w AS cs FROM freq WHERE typ IN ('num', 'date', 'alen')
        WINDOW w AS (PARTITION BY rep, path, typ ORDER BY x)),
ks AS (SELECT rep, path, typ, coalesce(1 - max(abs(cr / nullif(tr, 0)::DOUBLE - cs / nullif(ts, 0)::DOUBLE)), 0) AS score
       FROM cdf JOIN tot USING (rep, path, typ) GROUP BY rep, path, typ),
value_scores AS (SELECT * FROM tv UNION ALL SELECT * FROM ks)"""

FIELDS = """types AS (
  SELECT rep, path, sum(nr) AS pr, sum(ns) AS ps,
    sum(CASE WHEN s = 'num' THEN nr + ns ELSE 0 END) AS c_num, sum(CASE WHEN s = 'cat' THEN nr + ns ELSE 0 END) AS c_cat,
    sum(CASE WHEN s = 'bool' THEN nr + ns ELSE 0 END) AS c_bool, sum(CASE WHEN s = 'date' THEN nr + ns ELSE 0 END) AS c_date,
    bool_or(s = 'array') AS is_array, bool_or(s = 'object') AS is_object
  FROM freq WHERE typ = 'dtype' GROUP BY rep, path),
sc AS (SELECT rep, path, max(score) FILTER (typ = 'dtype') AS s_dtype, coalesce(max(score) FILTER (typ = 'num'), 0) AS s_num,
    coalesce(max(score) FILTER (typ = 'cat'), 0) AS s_cat, coalesce(max(score) FILTER (typ = 'bool'), 0) AS s_bool,
    coalesce(max(score) FILTER (typ = 'date'), 0) AS s_date, coalesce(max(score) FILTER (typ = 'alen'), 0) AS s_alen
  FROM value_scores GROUP BY rep, path),
parts AS (
  SELECT t.rep, t.path, is_array, is_object, c_num, c_cat, c_bool, c_date, c_num + c_cat + c_bool + c_date AS c_all,
    pr / rows_real::DOUBLE AS rate_r, ps / rows_synth::DOUBLE AS rate_s,
    1 - abs(pr / rows_real::DOUBLE - ps / rows_synth::DOUBLE) AS presence_fidelity,
    CASE WHEN pr = 0 OR ps = 0 THEN 0 ELSE s_dtype END AS type_fidelity,
    CASE WHEN NOT is_array AND c_num + c_cat + c_bool + c_date > 0
         THEN (c_num * s_num + c_cat * s_cat + c_bool * s_bool + c_date * s_date) / (c_num + c_cat + c_bool + c_date)::DOUBLE END AS value_fidelity,
    CASE WHEN is_array THEN s_alen END AS length_fidelity
  FROM types t JOIN sc USING (rep, path) JOIN sizes USING (rep)),
fields AS (
  SELECT rep, path, presence_fidelity, type_fidelity, value_fidelity, length_fidelity, greatest(rate_r, rate_s) AS presence,
    c_num, c_cat, c_bool, c_date, c_all, is_array,
    CASE WHEN is_array THEN presence_fidelity * type_fidelity * length_fidelity
         WHEN is_object THEN presence_fidelity * type_fidelity
         ELSE presence_fidelity * type_fidelity * coalesce(value_fidelity, 1) END AS score
  FROM parts)"""

BIN = " + ".join(
    f"CASE WHEN {i} < bins AND coalesce(xa, xb) > lo + {i}.0::DOUBLE * ((hi - lo) / bins) THEN 1 ELSE 0 END" for i in range(1, 10)
)

PAIRS = f"""cols AS (
  SELECT rep, path, typ, path || '.' || typ AS col, typ IN ('num', 'date', 'alen') AS cont,
    row_number() OVER (PARTITION BY rep ORDER BY path, list_position(['dtype','num','cat','date','bool','alen'], typ)) AS o
  FROM (SELECT rep, path, typ, count(*) AS vals, sum(nr + ns) AS present FROM freq GROUP BY rep, path, typ) JOIN sizes USING (rep)
  WHERE vals + CASE WHEN typ = 'dtype' AND present < rows_real + rows_synth THEN 1 ELSE 0 END > 1),
catalog AS (SELECT a.rep, a.o AS oa, b.o AS ob, a.col || '|' || b.col AS pair, a.cont AS ca, b.cont AS cb
            FROM cols a JOIN cols b ON a.rep = b.rep AND a.o < b.o),
vals AS (SELECT t.rep, t.split, t.rid, c.o, c.cont, t.x, t.s FROM sided t JOIN cols c USING (rep, path, typ)),
copresent AS (SELECT a.rep, a.split, a.o AS oa, b.o AS ob, a.cont AS ca, b.cont AS cb, a.x AS xa, b.x AS xb, a.s AS sa, b.s AS sb
              FROM vals a JOIN vals b ON a.rep = b.rep AND a.split = b.split AND a.rid = b.rid AND a.o < b.o),
edges AS (SELECT rep, oa, ob, min(coalesce(xa, xb)) AS lo, max(coalesce(xa, xb)) AS hi,
            least(10, count(DISTINCT coalesce(xa, xb))) AS bins FROM copresent WHERE ca <> cb GROUP BY rep, oa, ob),
labelled AS (
  SELECT rep, split, oa, ob, sa AS ka, sb AS kb FROM copresent WHERE NOT ca AND NOT cb
  UNION ALL
  SELECT rep, split, oa, ob, coalesce(sa, sb),
    CAST({BIN} AS VARCHAR)
  FROM copresent JOIN edges USING (rep, oa, ob) WHERE ca <> cb),
joint AS (SELECT rep, oa, ob, ka, kb, count(*) FILTER (split = 'train') AS nr, count(*) FILTER (split = 'synth') AS ns
          FROM labelled GROUP BY rep, oa, ob, ka, kb),
copres AS (SELECT rep, oa, ob, count(*) FILTER (split = 'train') AS n_real, count(*) FILTER (split = 'synth') AS n_synth
           FROM copresent GROUP BY rep, oa, ob),
conting AS (SELECT rep, oa, ob, coalesce(1 - 0.5 * sum(abs(nr / nullif(n_real, 0)::DOUBLE - ns / nullif(n_synth, 0)::DOUBLE)), 0) AS score
            FROM joint JOIN copres USING (rep, oa, ob) GROUP BY rep, oa, ob),
side_corr AS (SELECT rep, split, oa, ob, CASE WHEN count(*) >= 2 AND min(xa) < max(xa) AND min(xb) < max(xb) THEN corr(xa, xb) END AS r
              FROM copresent WHERE ca AND cb GROUP BY rep, split, oa, ob),
corrs AS (SELECT rep, oa, ob, coalesce(1 - abs(max(r) FILTER (split = 'train') - max(r) FILTER (split = 'synth')) / 2, 0) AS score
          FROM side_corr GROUP BY rep, oa, ob),
pairs AS (
  SELECT k.rep, k.pair, coalesce(n_real, 0) AS n_real, coalesce(n_synth, 0) AS n_synth,
    coalesce(n_real, 0) / rows_real::DOUBLE AS co_rate_real, coalesce(n_synth, 0) / rows_synth::DOUBLE AS co_rate_synth,
    greatest(coalesce(n_real, 0) / rows_real::DOUBLE, coalesce(n_synth, 0) / rows_synth::DOUBLE) AS presence,
    CASE WHEN coalesce(n_real, 0) = 0 OR coalesce(n_synth, 0) = 0 THEN 'N/A'
         WHEN ca AND cb THEN 'CorrelationSimilarity' ELSE 'ContingencySimilarity' END AS metric,
    CASE WHEN coalesce(n_real, 0) = 0 OR coalesce(n_synth, 0) = 0 THEN 0.0 ELSE coalesce(c.score, r.score, 0.0) END AS score, ca, cb
  FROM catalog k JOIN sizes USING (rep) LEFT JOIN copres USING (rep, oa, ob) LEFT JOIN conting c USING (rep, oa, ob)
  LEFT JOIN corrs r USING (rep, oa, ob))"""


def with_parts(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def cells_of(kind: str) -> tuple[str, ...]:
    return DOCS[kind], CELLS


def fields_of(kind: str, replicated: bool = False) -> tuple[str, ...]:
    sided = (SIZES_REPLICATED, SIDED_REPLICATED) if replicated else (SIZES, SIDED)
    return (*cells_of(kind), TYPED, *sided, FREQ, VALUE_SCORES, FIELDS)


def pairs_of(kind: str, replicated: bool = False) -> tuple[str, ...]:
    sided = (SIZES_REPLICATED, SIDED_REPLICATED) if replicated else (SIZES, SIDED)
    return (*cells_of(kind), TYPED, *sided, FREQ, PAIRS)
