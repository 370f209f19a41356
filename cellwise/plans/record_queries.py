"""Registered queries: sources, flattening, typing, rebuilding and cleaning of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwise.operators import cells as C
from cellwise.operators import cleaning as K
from cellwise.operators import rebuild as R
from cellwise.plans.common import DEPTH, both, cells, cells_of as own_cells, docs, prepared, records
from cellwise.plans.oracle_parts import DOCS, TYPED, cells_of, with_parts
from cellwise.plans.registry import query
from cellwise.session import scratch_dir, table
from cellwise.sources import catalog as CATALOG
from cellwise.sources import records as IO

LEAVES = "dtype NOT IN ('array', 'object')"


def _fresh(spark) -> str:
    import uuid

    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


# -- sources and sinks ------------------------------------------------------------------

BAD_LINES = """lines AS (SELECT rid, split, CASE WHEN rid % 101 = 0 THEN '{"broken": ' WHEN rid % 103 = 0 THEN ' ' || chr(9) || ' ' ELSE doc END AS line FROM docs)"""


@query(
    "scan_jsonl",
    with_parts(DOCS["event"], BAD_LINES)
    + """SELECT CASE WHEN json_valid(line) THEN 'record' ELSE 'corrupt' END AS outcome, count(*) AS n,
  CAST(sum(length(line)) AS BIGINT) AS chars FROM lines WHERE regexp_matches(line, '\\S') GROUP BY 1""",
)
def scan_jsonl(spark, sf):
    """JSON lines written and scanned back, with broken and blank lines among them."""
    path = _fresh(spark)
    docs(spark, sf, "event").selectExpr(
        """CASE WHEN rid % 101 = 0 THEN '{"broken": ' WHEN rid % 103 = 0 THEN ' \t ' ELSE doc END AS value"""
    ).write.text(path)
    parsed = IO.read_lines(spark, path)
    return parsed.groupBy(F.when(F.col("v").isNotNull(), "record").otherwise("corrupt").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars")
    )


@query("sink_jsonl", with_parts(DOCS["conv"]) + "SELECT doc FROM docs")
def sink_jsonl(spark, sf):
    path = _fresh(spark)
    IO.write_jsonl(records(spark, sf, "conv"), path)
    return IO.read_jsonl(spark, path)[0].select(F.to_json("v").alias("doc"))


@query("catalog_set", with_parts(DOCS["event"]) + "SELECT split, doc FROM docs WHERE split <> 'synth'")
def catalog_set(spark, sf):
    """A registered set is loaded by its own path, with its canonical split."""
    path = _fresh(spark)
    base = records(spark, sf, "event")
    for split in ("train", "test"):
        IO.write_jsonl(base.filter(F.col("split") == split), f"{path}/{split}.jsonl")
    entry = CATALOG.DataSet("event_files", "type", "multiclass", tabular=False, canonical_split=True, path=path)
    return CATALOG.load_set(spark, entry).select("split", F.to_json("v").alias("doc"))


@query(
    "prepared_manifest",
    with_parts(DOCS["event"]) + "SELECT split, count(*) AS n, true AS ok FROM docs GROUP BY split",
)
def prepared_manifest(spark, sf):
    """Rows and digests of prepared splits against the manifest that was written last."""
    path = _fresh(spark)
    prepared = IO.prepare_splits(records(spark, sf, "event").select("rid", "split", "v"), path)
    return IO.verify_splits(prepared, path)


@query(
    "sink_prepared",
    with_parts(DOCS["event"]) + "SELECT split, count(*) AS n, min(doc) AS first_doc FROM docs GROUP BY split",
)
def sink_prepared(spark, sf):
    """Prepared splits; the second call finds them and writes nothing."""
    path = _fresh(spark)
    IO.prepare_splits(records(spark, sf, "event").select("rid", "split", "v"), path)
    again = IO.prepare_splits(records(spark, sf, "event").limit(0).select("rid", "split", "v"), path)
    return again.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_json("v")).alias("first_doc"))


@query(
    "sink_flat_csv",
    with_parts(*cells_of("event"))
    + """SELECT split, count(*) AS n, count(*) FILTER (ts IS NOT NULL) AS n_ts, count(*) FILTER (value IS NOT NULL) AS n_value,
  round(sum(k::DOUBLE), 6) AS sum_k, min(type) AS first_type, count(*) FILTER (vip = 'true') AS n_vip
FROM (SELECT rid, split, max(txt) FILTER (path = 'ts') AS ts, max(txt) FILTER (path = 'value') AS value,
        max(txt) FILTER (path = 'props.k') AS k, max(txt) FILTER (path = 'type') AS type, max(txt) FILTER (path = 'vip') AS vip
      FROM (SELECT rid, split, path, CASE WHEN dtype = 'null' THEN NULL ELSE trim(json, '"') END AS txt FROM cells) GROUP BY rid, split)
GROUP BY split""",
)
def sink_flat_csv(spark, sf):
    base = cells(spark, sf, "event", with_json=True)
    path = _fresh(spark)
    IO.write_flat_csv(IO.flat_table(base, IO.flat_columns(base)), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ts").alias("n_ts"),
        F.count("value").alias("n_value"),
        F.round(F.sum(F.col("`props.k`").cast("double")), 6).alias("sum_k"),
        F.min("type").alias("first_type"),
        F.count_if(F.col("vip") == "true").alias("n_vip"),
    )


@query(
    "replicate_scan",
    with_parts(DOCS["event"])
    + "SELECT replicate, count(*) AS n, CAST(sum(length(doc)) AS BIGINT) AS chars FROM docs WHERE split = 'synth' GROUP BY replicate",
)
def replicate_scan(spark, sf):
    path = _fresh(spark)
    IO.write_replicates(records(spark, sf, "event").filter("split = 'synth'"), path, (1, 2, 3))
    return IO.read_replicates(spark, path).groupBy("replicate").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars")
    )


def _customer_table(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS rid",
        "CASE WHEN c_custkey % 5 IN (0, 1) THEN 'train' WHEN c_custkey % 5 = 2 THEN 'test' ELSE 'synth' END AS split",
        "c_acctbal AS balance",
        "c_nationkey AS nation",
        "c_name AS name",
        "c_mktsegment AS segment",
    )


@query(
    "matrix_export",
    """SELECT c_custkey AS rid, round(c_acctbal::FLOAT::DOUBLE, 4) AS balance, c_nationkey::DOUBLE AS nation, c_name AS name, c_mktsegment AS y
FROM customer WHERE c_custkey % 5 IN (0, 1, 2)""",
)
def matrix_export(spark, sf):
    base = _customer_table(spark, sf).filter("split <> 'synth'")
    path = _fresh(spark)
    for part, frame in zip(("x_num", "x_cat", "y"), IO.matrix_export(base, ["balance", "nation"], ["name"], "segment")):
        frame.write.partitionBy("split").parquet(f"{path}/{part}")
    x_num, x_cat, y = (spark.read.parquet(f"{path}/{p}").drop("split") for p in ("x_num", "x_cat", "y"))
    return x_num.join(x_cat, "rid").join(y, "rid").select(
        "rid", F.round(F.col("balance").cast("double"), 4).alias("balance"), F.col("nation").cast("double").alias("nation"), "name", "y"
    )


@query(
    "matrix_info",
    """SELECT count(*) FILTER (c_custkey % 5 IN (0, 1)) AS train_num, count(*) FILTER (c_custkey % 5 = 2) AS test_num,
  'balance,nation' AS num_columns, 'name' AS cat_columns,
  CASE WHEN bool_and(c_acctbal % 1 = 0) THEN 'balance,' ELSE '' END || CASE WHEN bool_and(c_nationkey % 1 = 0) THEN 'nation' ELSE '' END AS int_columns,
  CASE WHEN count(DISTINCT c_mktsegment) = 2 THEN 'binclass' ELSE 'multiclass' END AS task_type
FROM customer WHERE c_custkey % 5 IN (0, 1, 2)""",
)
def matrix_info(spark, sf):
    base = _customer_table(spark, sf).filter("split <> 'synth'")
    return IO.matrix_info(base, ["balance", "nation"], ["name"], "segment")


# -- flattening and typing ----------------------------------------------------------------


@query(
    "flatten_leaf",
    with_parts(*cells_of("conv")) + f"SELECT rid, path, dtype, json AS value FROM cells WHERE {LEAVES}",
)
def flatten_leaf(spark, sf):
    return cells(spark, sf, "conv", leaf_only=True, with_json=True).select("rid", "path", "dtype", F.col("json").alias("value"))


@query(
    "flatten_all",
    with_parts(*cells_of("order"))
    + """SELECT split, path, dtype, count(*) AS n, CAST(sum(length(json)) AS BIGINT) AS chars, round(sum(num), 4) AS total
FROM cells GROUP BY split, path, dtype""",
)
def flatten_all(spark, sf):
    return cells(spark, sf, "order", with_json=True).groupBy("split", "path", "dtype").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("json")).alias("chars"), F.round(F.sum("num"), 4).alias("total")
    )


@query(
    "flatten_wide",
    with_parts(*cells_of("event"))
    + f"""SELECT rid, max(json) FILTER (path = 'props.k') AS props_k, max(json) FILTER (path = 'ts') AS ts,
  max(json) FILTER (path = 'type') AS type, max(json) FILTER (path = 'value') AS value, max(json) FILTER (path = 'vip') AS vip
FROM cells WHERE {LEAVES} GROUP BY rid""",
)
def flatten_wide(spark, sf):
    base = cells(spark, sf, "event", leaf_only=True, with_json=True)
    wide = C.flatten_wide(base, IO.flat_columns(base), ("rid",))
    return wide.withColumnRenamed("props.k", "props_k")


@query(
    "cell_dtypes",
    with_parts(*cells_of("event")) + "SELECT split, path, dtype, count(*) AS n FROM cells GROUP BY split, path, dtype",
)
def cell_dtypes(spark, sf):
    return cells(spark, sf, "event").groupBy("split", "path", "dtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "separate_types",
    with_parts(*cells_of("event"), TYPED)
    + "SELECT rid, path || '.' || typ AS col, CASE WHEN typ = 'date' THEN x / 1000000 ELSE round(x, 6) END AS x, s FROM typed",
)
def separate_types(spark, sf):
    return C.separate_types(cells(spark, sf, "event")).select(
        "rid", "col", F.when(F.col("typ") == "date", F.col("x") / 1000000).otherwise(F.round("x", 6)).alias("x"), "s"
    )


@query(
    "homogeneous_paths",
    with_parts(*cells_of("event"))
    + """SELECT path, count(*) AS present, count(DISTINCT dtype) FILTER (dtype <> 'null') AS value_types,
  count(DISTINCT dtype) FILTER (dtype <> 'null') <= 1 AND count(*) = (SELECT count(*) FROM docs) AS passthrough
FROM cells GROUP BY path""",
)
def homogeneous_paths(spark, sf):
    own, base = both(spark, sf, "event")
    return C.homogeneous_paths(own, base.count())


@query(
    "null_coercion",
    with_parts(*cells_of("event"))
    + """, numeric AS (SELECT path FROM cells GROUP BY path HAVING bool_and(dtype IN ('num', 'null')) AND bool_or(dtype = 'num'))
SELECT path, dtype, count(*) AS n FROM cells WHERE NOT (dtype = 'null' AND path IN (SELECT path FROM numeric))
GROUP BY path, dtype""",
)
def null_coercion(spark, sf):
    """Nulls of numeric fields counted as absent."""
    kept = C.numeric_null_as_missing(cells(spark, sf, "event"))
    return kept.groupBy("path", "dtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "array_lengths",
    with_parts(*cells_of("order")) + "SELECT rid, path, CAST(alen AS BIGINT) AS alen FROM cells WHERE dtype = 'array'",
)
def array_lengths(spark, sf):
    return cells(spark, sf, "order").filter("dtype = 'array'").select("rid", "path", F.col("alen").cast("bigint").alias("alen"))


@query(
    "column_map",
    with_parts(*cells_of("event"), TYPED)
    + """SELECT field, string_agg(typ, ',' ORDER BY list_position(['dtype','num','cat','date','bool','alen'], typ)) AS types
FROM (SELECT DISTINCT path AS field, typ FROM typed) GROUP BY field""",
)
def column_map(spark, sf):
    mapped = C.column_map(C.column_catalog(cells(spark, sf, "event")).select("col"))
    return mapped.select(
        "field",
        F.array_join(F.transform("typed_columns", lambda c: F.regexp_extract(c, "([^.]*)$", 1)), ",").alias("types"),
    )


@query(
    "profile",
    with_parts(*cells_of("order"))
    + """SELECT path, count(*) AS present, count(*) FILTER (dtype = 'num') AS n_num, count(*) FILTER (dtype = 'cat') AS n_cat,
  count(*) FILTER (dtype = 'object') AS n_object FROM cells GROUP BY path""",
)
def profile(spark, sf):
    return C.profile(cells(spark, sf, "order")).select("path", "present", "n_num", "n_cat", "n_object")


@query(
    "union_cells",
    with_parts(*cells_of("event"))
    + """SELECT CASE WHEN split = 'train' THEN 'real' ELSE split END AS split, path, dtype, count(*) AS n
FROM cells WHERE split IN ('train', 'synth') GROUP BY 1, 2, 3""",
)
def union_cells(spark, sf):
    base = records(spark, sf, "event")
    union = C.union_records({"real": base.filter("split = 'train'"), "synth": base.filter("split = 'synth'")})
    return C.flatten(union, ("rid", "split"), max_depth=2).groupBy("split", "path", "dtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nested_predicates",
    with_parts(*cells_of("event"))
    + """SELECT bool_or(dtype IN ('array', 'object') AND depth = 1) AS is_nested, bool_or(dtype IN ('array', 'object')) AS has_nested_cells,
  bool_or(contains(path, '.')) AS has_flattened_columns FROM cells""",
)
def nested_predicates(spark, sf):
    return C.nested_predicates(cells(spark, sf, "event"))


# -- rebuilding ---------------------------------------------------------------------------


@query("unflatten_leaf", with_parts(DOCS["order"]) + "SELECT rid, doc FROM docs")
def unflatten_leaf(spark, sf):
    """Leaf cells back to documents; empty item lists are restored from the table's fields."""
    leaves = cells(spark, sf, "order", leaf_only=True, with_json=True)
    return R.unflatten_leaves(leaves, 3).select("rid", F.col("json").alias("doc"))


@query("unflatten_all", with_parts(DOCS["order"]) + "SELECT rid, doc FROM docs")
def unflatten_all(spark, sf):
    return R.unflatten_all(cells(spark, sf, "order", with_json=True)).select("rid", F.col("json").alias("doc"))


@query(
    "separate_columns",
    with_parts(*cells_of("event"), TYPED)
    + """, fields AS (SELECT path, path = 'ts' OR (count(DISTINCT dtype) FILTER (dtype <> 'null') <= 1 AND count(*) = (SELECT count(*) FROM docs)) AS kept FROM cells GROUP BY path)
SELECT rid, path || '.' || typ AS col, typ, x, s, false AS kept FROM typed JOIN fields USING (path) WHERE NOT kept
UNION ALL SELECT rid, path, dtype, CASE dtype WHEN 'num' THEN num WHEN 'date' THEN date_us::DOUBLE END,
  CASE dtype WHEN 'cat' THEN cat WHEN 'bool' THEN CASE WHEN bool THEN 'True' ELSE 'False' END WHEN 'object' THEN json END, true FROM cells JOIN fields USING (path) WHERE kept""",
)
def separate_columns(spark, sf):
    """Typed and kept columns in one call: uniform fields keep their name, and so does the one left out."""
    base = prepared(spark, sf, "event")
    own = own_cells(base, "event", with_json=True)
    out = C.separate_columns(own, base.count(), columns=["props", "props.k", "type", "value", "vip"])
    return out.select("rid", "col", "typ", "x", "s", "kept")


@query("unflatten_mixed", with_parts(DOCS["order"]) + "SELECT rid, doc FROM docs")
def unflatten_mixed(spark, sf):
    """A table that mixes records of leaf cells with records that also hold their containers."""
    mixed = cells(spark, sf, "order", with_json=True).filter((F.col("rid") % 2 == 0) | ~F.col("dtype").isin(*C.CONTAINERS))
    return R.unflatten(mixed).select("rid", F.col("json").alias("doc"))


@query("unflatten_table", with_parts(DOCS["event"]) + "SELECT rid, doc FROM docs")
def unflatten_table(spark, sf):
    base = cells(spark, sf, "event", leaf_only=True, with_json=True)
    columns = IO.flat_columns(base)
    return R.unflatten_table(C.flatten_wide(base, columns, ("rid",)), "rid", columns, 2).select(
        "rid", F.col("json").alias("doc")
    )


@query(
    "merge_types",
    with_parts(*cells_of("event"))
    + """SELECT rid, path, CASE WHEN path = 'type' AND rid % 4 = 0 THEN NULL ELSE json END AS value FROM cells
WHERE dtype <> 'object' AND NOT (path = 'type' AND rid % 4 = 0)""",
)
def merge_types(spark, sf):
    """Typed rows merged; cells whose dtype has no value of that type count as absent."""
    typed = C.typed_view(cells(spark, sf, "event")).filter("NOT (path = 'type' AND typ = 'cat' AND rid % 4 = 0)")
    return R.merge_types(typed).filter("dtype <> 'object'").select("rid", "path", F.col("json").alias("value"))


GAPPED = """gapped AS (SELECT rid, len_items, string_agg(CASE WHEN (rid + pos) % 11 = 0 THEN 'null' ELSE item END, ',' ORDER BY pos) AS items
  FROM (SELECT l_orderkey AS rid, count(*) OVER (PARTITION BY l_orderkey) AS len_items,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 AS pos,
          '{"flag":"' || l_returnflag || '","ln":' || l_linenumber || ',"part":' || l_partkey || '}' AS item FROM lineitem)
  GROUP BY rid, len_items)"""


@query(
    "merge_arrays",
    with_parts(DOCS["order"], GAPPED)
    + "SELECT docs.rid, '[' || coalesce(items, '') || ']' AS items FROM docs LEFT JOIN gapped USING (rid)",
)
def merge_arrays(spark, sf):
    """Arrays rebuilt by length: elements without cells become null."""
    typed = C.typed_view(cells(spark, sf, "order"))
    index = F.regexp_extract("path", "^items[.]([0-9]+)", 1)
    gap = (index != "") & ((F.col("rid") + F.nullif(index, F.lit("")).cast("bigint")) % 11 == 0)
    return R.merge_records(typed.filter(~F.coalesce(gap, F.lit(False))), 3).select(
        "rid", F.get_json_object("json", "$.items").alias("items")
    )


@query(
    "merge_objects",
    with_parts(*cells_of("event"))
    + """SELECT rid, CASE WHEN rid % 6 = 0 THEN '{}' ELSE json END AS props FROM cells WHERE path = 'props'""",
)
def merge_objects(spark, sf):
    """Objects rebuilt from their members; an object without members stays ``{}``."""
    typed = C.typed_view(cells(spark, sf, "event")).filter("NOT (path = 'props.k' AND rid % 6 = 0)")
    return R.merge_records(typed, 2).select("rid", F.get_json_object("json", "$.props").alias("props"))


def _tabular(spark, sf):
    own, base = both(spark, sf, "event", leaf_only=True)
    return R.tabularize(own, base.count(), ["type"])


@query(
    "tabularize",
    with_parts(*cells_of("event"), TYPED)
    + """, leaf AS (SELECT * FROM cells WHERE dtype <> 'object' AND path <> 'type'),
same AS (SELECT path FROM leaf GROUP BY path HAVING count(DISTINCT dtype) FILTER (dtype <> 'null') <= 1 AND count(*) = (SELECT count(*) FROM docs))
SELECT col, count(*) AS n FROM (
  SELECT rid, path AS col FROM leaf WHERE path IN (SELECT path FROM same) OR path = 'type'
  UNION ALL SELECT rid, path AS col FROM cells WHERE path = 'type'
  UNION ALL SELECT t.rid, t.path || '.' || t.typ FROM typed t JOIN (SELECT DISTINCT path FROM leaf) USING (path) WHERE path NOT IN (SELECT path FROM same))
GROUP BY col""",
)
def tabularize(spark, sf):
    """Columns a flat model sees: uniform fields and the target as they are, others type-separated."""
    flat = _tabular(spark, sf)
    return flat.groupBy("col").agg(F.count(F.lit(1)).alias("n"))


@query("untabularize", with_parts(DOCS["event"]) + "SELECT rid, doc FROM docs")
def untabularize(spark, sf):
    """Flat typed columns back to the original documents."""
    flat = _tabular(spark, sf)
    return R.untabularize(flat, DEPTH["event"]).select("rid", F.col("json").alias("doc"))


# -- cleaning -----------------------------------------------------------------------------


@query(
    "drop_fields",
    with_parts(DOCS["event"])
    + """SELECT rid, '{' || substr(regexp_replace(doc, '^\\{"props":\\{[^}]*\\}(,"ts":"[^"]*")?', ''), 2) AS doc FROM docs""",
)
def drop_fields(spark, sf):
    return K.drop_fields(records(spark, sf, "event"), ["props", "ts"]).select("rid", F.to_json("v").alias("doc"))


@query(
    "split_to_array",
    """SELECT p_partkey, 3 AS n, p_brand AS first, p_name AS second, p_type AS third FROM part""",
)
def split_to_array(spark, sf):
    text = F.concat("p_brand", F.lit(" , "), "p_name", F.lit(",  "), "p_type", F.lit(" "))
    parts = table(spark, sf, "part").select("p_partkey", K.split_to_array(text).alias("a"))
    return parts.select(
        "p_partkey", F.size("a").alias("n"), F.col("a")[0].alias("first"), F.col("a")[1].alias("second"), F.col("a")[2].alias("third")
    )


@query(
    "literal_to_json",
    """SELECT event_id, CASE WHEN event_id % 35 = 0 THEN '"1e999"' WHEN event_id % 5 = 0 THEN 'true' WHEN event_id % 5 = 1 THEN '"' || event_type || '"'
  WHEN event_id % 5 = 2 THEN '{"k": ' || user_id || ', "on": false}' WHEN event_id % 5 = 3 THEN '"plain ' || event_type || '"' ELSE '' || user_id END AS json FROM events""",
)
def literal_to_json(spark, sf):
    """Attribute texts in Python notation, derived from the events."""
    text = F.expr(
        """CASE WHEN event_id % 35 = 0 THEN '1e999' WHEN event_id % 5 = 0 THEN 'True' WHEN event_id % 5 = 1 THEN concat("u'", event_type, "'")
           WHEN event_id % 5 = 2 THEN concat("{'k': ", user_id, ", 'on': False}") WHEN event_id % 5 = 3 THEN concat('plain ', event_type)
           ELSE cast(user_id AS string) END"""
    )
    return table(spark, sf, "events").select("event_id", K.literal_to_json(text).alias("json"))


LABELLED = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'NA' ELSE event_type END"


@query(
    "clean_categoricals",
    f"SELECT event_id, CASE WHEN l IS NULL OR l IN ('', 'NA') THEN 'nan' ELSE l END AS label, event_type AS target FROM (SELECT *, {LABELLED} AS l FROM events)",
)
def clean_categoricals(spark, sf):
    base = table(spark, sf, "events").selectExpr("event_id", f"{LABELLED} AS label", "event_type AS target")
    return K.clean_categoricals(base, ["label"], "target")


@query("restore_nulls", f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE event_type END AS label FROM events")
def restore_nulls(spark, sf):
    base = table(spark, sf, "events").selectExpr("event_id", f"{LABELLED} AS label")
    return K.restore_nulls(K.clean_categoricals(base, ["label"]), ["label"])


@query(
    "restore_bools",
    "SELECT event_id, user_id % 3 = 0 AS flag, CAST(user_id % 2 AS INTEGER) = 1 AS number, event_type AS kind FROM events",
)
def restore_bools(spark, sf):
    """A text column of True/False is recognised, a 0/1 column is known by its record, text stays."""
    base = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN user_id % 3 = 0 THEN 'True' ELSE 'False' END AS flag",
        "cast(user_id % 2 AS double) AS number",
        "event_type AS kind",
    )
    return K.restore_bools(base, ["flag", "number", "kind"], {"number": "bool"})


@query(
    "classify_columns",
    with_parts(*cells_of("event"))
    + f"""SELECT path, CASE WHEN path = 'type' THEN 'target' WHEN bool_and(dtype IN ('num', 'null')) AND bool_or(dtype = 'num') THEN 'numeric'
  ELSE 'categorical' END AS role FROM cells WHERE {LEAVES} GROUP BY path""",
)
def classify_columns(spark, sf):
    return K.classify_columns(cells(spark, sf, "event", leaf_only=True), "type")


@query(
    "semantic_types",
    with_parts(*cells_of("event"))
    + f"""SELECT path, CASE WHEN bool_and(dtype = 'bool') THEN 'boolean'
  WHEN bool_and(dtype IN ('num', 'null')) AND bool_or(dtype = 'num') THEN 'numerical' ELSE 'categorical' END AS semantic_type
FROM cells WHERE {LEAVES} GROUP BY path""",
)
def semantic_types(spark, sf):
    return K.semantic_types_of_cells(cells(spark, sf, "event", leaf_only=True))


@query(
    "integer_columns",
    with_parts(*cells_of("order"))
    + "SELECT path, bool_and(num % 1 = 0) AS integer_valued FROM cells WHERE num IS NOT NULL AND split <> 'synth' GROUP BY path",
)
def integer_columns(spark, sf):
    return K.integer_columns(cells(spark, sf, "order").filter("split <> 'synth'"))


@query(
    "task_type",
    "SELECT count(DISTINCT o_orderstatus) AS n_classes, CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binclass' ELSE 'multiclass' END AS task FROM orders",
)
def task_type(spark, sf):
    return K.task_type(table(spark, sf, "orders"), "o_orderstatus")


@query(
    "compact_records",
    """SELECT event_id, '{"event_id":' || event_id || CASE WHEN event_id % 5 < 3 THEN '' ELSE ',"label":"' || event_type || '"' END
  || ',"user_id":' || user_id || '}' AS record FROM events""",
)
def compact_records(spark, sf):
    base = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 5 < 3 THEN NULL ELSE event_type END AS label", "user_id"
    )
    return base.select("event_id", K.compact_records(base).alias("record"))
