"""Queries over sources, typing, feature rules, manifests and input quality."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.catalog.oracle import CTES
from foldwise.catalog.registry import register
from foldwise.functions import scalars
from foldwise.operators import ingest, rules
from foldwise.sources import bindings as b
from foldwise.sources import files

FEATURES = b.FEATURES

# Oracle bindings --------------------------------------------------------------------------------


def token_sql(f: str) -> str:
    return f"""CASE WHEN {f} IS NULL OR substr(md5('miss{f}' || id), 1, 1) = '0'
      THEN CASE WHEN substr(md5('tok{f}' || id), 1, 1) <= '3' THEN 'NA' WHEN substr(md5('tok{f}' || id), 1, 1) <= '7' THEN ' n/a '
                WHEN substr(md5('tok{f}' || id), 1, 1) <= 'b' THEN '' END
      WHEN substr(md5('bad{f}' || id), 1, 2) = '00' THEN 'abc' WHEN substr(md5('bad{f}' || id), 1, 2) = '01' THEN 'Infinity'
      ELSE CAST(CAST({f} AS DECIMAL(18,2)) AS VARCHAR) END AS {f}"""


CTES["b_stage"] = f"""
SELECT cohort, id AS true_id, CASE substr(md5('id' || id), 1, 1) WHEN '0' THEN id || '.0' WHEN '1' THEN ' ' || id || ' ' ELSE id END AS raw_id,
  CASE WHEN substr(md5('unclear' || id), 1, 2) = '00' THEN 'unclear'
       WHEN y = 1 THEN CASE WHEN substr(md5('label' || id), 1, 1) <= '3' THEN 'Responder' WHEN substr(md5('label' || id), 1, 1) <= '7' THEN '1'
                            WHEN substr(md5('label' || id), 1, 1) <= 'b' THEN ' R ' ELSE 'positive' END
       ELSE CASE WHEN substr(md5('label' || id), 1, 1) <= '3' THEN 'Non_Responder' WHEN substr(md5('label' || id), 1, 1) <= '7' THEN '0'
                 WHEN substr(md5('label' || id), 1, 1) <= 'b' THEN 'NR' ELSE 'false' END END AS raw_label,
  {", ".join(token_sql(f) for f in FEATURES)}
FROM b_cust"""
CTES["b_stage_long"] = f"SELECT * FROM (FROM b_stage UNPIVOT INCLUDE NULLS (token FOR feature IN ({', '.join(FEATURES)})))"
CTES["b_label"] = """SELECT DISTINCT raw_label, CASE WHEN lower(trim(raw_label)) IN ('responder', '1', 'r', 'positive') THEN 1
  WHEN lower(trim(raw_label)) IN ('non_responder', '0', 'nr', 'false') THEN 0 END AS y FROM b_stage"""
NUMBER = """CASE WHEN lower(trim(token)) IN ('', 'na', 'n/a') OR NOT isfinite(TRY_CAST(trim(token) AS DOUBLE)) THEN NULL
  ELSE TRY_CAST(trim(token) AS DOUBLE) END"""
CTES["b_feature"] = "SELECT DISTINCT cohort, feature FROM b_cell"


def rules_sql(scale_aware: bool) -> str:
    log10 = "cohort = 'FURNITURE'" if scale_aware else "FALSE"
    pick = lambda own1, own2, named, log, default: (
        f"CASE WHEN cohort = 'BUILDING' AND feature = 'f_pending' THEN {own1} "
        f"WHEN cohort = 'MACHINERY' AND feature = 'f_orders' THEN {own2} "
        f"WHEN feature = 'f_bal' THEN {named} WHEN {log10} THEN {log} ELSE {default} END"
    )
    return f"""
SELECT cohort, feature, {pick("'log1p'", "'identity'", "'identity'", "'identity'", "'log1p'")} AS transform,
  {pick("FALSE", "FALSE", "FALSE", "FALSE", "TRUE")} AS zero_is_missing, {pick("TRUE", "FALSE", "FALSE", "FALSE", "TRUE")} AS negative_is_missing,
  {pick("FALSE", "FALSE", "FALSE", "TRUE", "TRUE")} AS half_minimum_allowed,
  {pick("'linear'", "'linear'", "'derived_log10_ratio'", "'log10'", "'linear'")} AS input_scale
FROM b_feature"""


CTES["b_rule"] = rules_sql(False)
CTES["b_rule_scaled"] = rules_sql(True)
MASK = "CASE WHEN (negative_is_missing AND value < 0) OR (zero_is_missing AND value = 0) THEN NULL ELSE value END"
CTES["b_masked"] = f"SELECT cohort, id, feature, transform, half_minimum_allowed, input_scale, value AS raw_value, {MASK} AS value FROM b_cell JOIN b_rule USING (cohort, feature)"
CTES["b_masked_scaled"] = f"SELECT cohort, id, feature, transform, half_minimum_allowed, input_scale, {MASK} AS value FROM b_cell JOIN b_rule_scaled USING (cohort, feature)"
CTES["b_manifest"] = """
SELECT cohort, feature, count(*) AS n_samples, count(*) FILTER (raw_value IS NULL) AS n_original_missing, count(*) FILTER (raw_value = 0) AS n_zero,
  count(*) FILTER (raw_value < 0) AS n_negative, count(*) FILTER (value IS NULL) AS n_missing_after_rules, count(DISTINCT value) AS n_unique_valid,
  count(*) FILTER (value IS NULL) / CAST(count(*) AS DOUBLE) AS missing_rate_after_rules, count(value) > 0 AS included_in_analysis,
  CASE WHEN count(value) > 0 THEN '' ELSE 'all_missing_after_feature_rules' END AS global_exclusion_reason
FROM b_masked GROUP BY ALL"""


def masked(spark, folder, scale_aware=False):
    return rules.apply_rules(b.cells(spark, folder), b.rules(spark, folder, scale_aware))


def manifest(spark, folder):
    joined = b.cells(spark, folder).join(b.rules(spark, folder), ["cohort", "feature"])
    return ingest.feature_manifest(joined, rules.masked_value())


# Sources ------------------------------------------------------------------------------------------

KEYS = {
    "AUTOMOBILE": "dataset1_pre",
    "BUILDING": "dataset2_pre",
    "FURNITURE": "dataset3_post1",
    "HOUSEHOLD": "dataset4_post2",
    "MACHINERY": "dataset5_pre",
}
KEY_SQL = "CASE cohort " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in KEYS.items()) + " ELSE 'dataset99_pre' END"
TEXT = [f for f in FEATURES]


def cohort_key():
    out = None
    for cohort, key in KEYS.items():
        out = F.when(F.col("cohort") == cohort, key) if out is None else out.when(F.col("cohort") == cohort, key)
    return out.otherwise("dataset99_pre")


def exported(spark, folder):
    """Write the staged matrices as text, one folder per cohort key, and return the folder."""
    target = files.scratch_folder(spark, "matrices")
    staged = b.staging(spark, folder).withColumn("cohort_key", cohort_key()).drop("cohort")
    names = {"raw_id": "id", "raw_label": "category", **dict(zip(b.PADDED, FEATURES))}
    files.write_matrices(staged.withColumnsRenamed(names).repartition("cohort_key", "id"), target, "cohort_key")
    return target


@register(
    "matrix_file_keys",
    "S1 F12",
    f"""
SELECT cohort_key, CAST(regexp_extract(cohort_key, '^dataset([0-9]+)_', 1) AS INTEGER) AS number, regexp_extract(cohort_key, '_(pre|post1|post2)$', 1) AS timepoint
FROM (SELECT DISTINCT {KEY_SQL} AS cohort_key FROM b_sample)""",
)
def matrix_file_keys(spark, folder):
    """Cohort keys found by file name after an export of the matrices."""
    found = files.key_inventory(spark, exported(spark, folder), "*.csv").where(F.col("cohort_key").isNotNull())
    number, timepoint = files.key_parts(F.col("cohort_key"))
    return found.select("cohort_key").distinct().select(
        "cohort_key", number.alias("number"), timepoint.alias("timepoint")
    )


FEATURE_NUMBERS = ", ".join(NUMBER.replace("token", f) + f" AS {f}" for f in FEATURES)


@register(
    "ingest_text_matrices",
    "S2 S4 S5 S6 F2 F3",
    f"SELECT {KEY_SQL} AS cohort_key, true_id AS id, y, {FEATURE_NUMBERS} FROM b_stage JOIN b_label USING (raw_label)",
)
def ingest_text_matrices(spark, folder):
    """Text export, scan by name with declared text columns, typing: the full round trip."""
    raw = files.scan_matrices(spark, exported(spark, folder), FEATURES)
    return ingest.ingest(raw, ["cohort_key"], "id", "category", FEATURES)


@register(
    "ingest_wide_matrix",
    "S2",
    f"SELECT cohort, true_id AS id, y, {FEATURE_NUMBERS} FROM b_stage JOIN b_label USING (raw_label)",
)
def ingest_wide_matrix(spark, folder):
    return ingest.ingest(b.staging(spark, folder), ["cohort"], "raw_id", "raw_label", b.PADDED)


# The gate: a matrix is taken whole or not at all -------------------------------------------------------

CTES["b_arrival"] = f"""
SELECT cohort, batch, true_id, CASE WHEN sound AND raw_label = 'unclear' THEN '0' ELSE raw_label END AS raw_label,
  {", ".join(f"CASE WHEN sound AND {f} IN ('abc', 'Infinity') THEN 'NA' ELSE {f} END AS {f}" for f in FEATURES)},
  unnest(CASE WHEN substr(md5('twin' || cohort || batch), 1, 1) = '0' AND substr(md5('again' || true_id), 1, 1) < '4' THEN [1, 2] ELSE [1] END) AS copy_number
FROM (SELECT *, substr(md5('fault' || cohort || batch), 1, 1) > '7' AS sound FROM (SELECT *, substr(md5('batch' || true_id), 1, 1) AS batch FROM b_stage))"""
CTES["b_admission"] = f"""
SELECT *, concat_ws(',', CASE WHEN non_numeric > 0 THEN 'non_numeric' END, CASE WHEN non_finite > 0 THEN 'non_finite' END,
    CASE WHEN unknown_label > 0 THEN 'unknown_label' END, CASE WHEN duplicate_id > 0 THEN 'duplicate_id' END) AS problems
FROM (SELECT cohort, batch, count(*) AS n_rows,
    CAST(sum({" + ".join(f"CAST(coalesce({f}, '') = 'abc' AS INTEGER)" for f in FEATURES)}) AS BIGINT) AS non_numeric,
    CAST(sum({" + ".join(f"CAST(coalesce({f}, '') = 'Infinity' AS INTEGER)" for f in FEATURES)}) AS BIGINT) AS non_finite,
    count(*) FILTER (raw_label = 'unclear') AS unknown_label, CAST(0 AS BIGINT) AS blank_id, count(*) - count(DISTINCT true_id) AS duplicate_id
  FROM b_arrival GROUP BY ALL)"""
BATCH = ["cohort", "batch"]


def admission(spark, folder):
    return ingest.admission(b.arrivals(spark, folder), BATCH, "raw_id", "raw_label", b.PADDED)


@register("ingest_admission", "S4 P20 P10", "SELECT *, CASE WHEN problems = '' THEN 'accepted' ELSE 'rejected' END AS status FROM b_admission")
def ingest_admission(spark, folder):
    """Which matrices are accepted, and why the others are not."""
    return admission(spark, folder)


@register(
    "admitted_matrices",
    "S2 S4",
    f"""
SELECT cohort, batch, true_id AS id, CASE WHEN lower(trim(raw_label)) IN ('responder', '1', 'r', 'positive') THEN 1 ELSE 0 END AS y, {FEATURE_NUMBERS}
FROM b_arrival JOIN b_admission USING (cohort, batch) WHERE problems = ''""",
)
def admitted_matrices(spark, folder):
    """Typed rows of the accepted matrices only."""
    typed = ingest.ingest(b.arrivals(spark, folder), BATCH, "raw_id", "raw_label", b.PADDED)
    return ingest.admit(typed, admission(spark, folder), BATCH)


@register(
    "matrix_file_problems",
    "S1",
    """
WITH named AS (
  SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS k, c_nationkey % 9 AS number, CASE c_nationkey % 4 WHEN 0 THEN 'pre' WHEN 1 THEN 'post1' WHEN 2 THEN 'post2' ELSE 'mid' END AS stage FROM customer),
files AS (
  SELECT DISTINCT 'in/' || seg || '/' || CASE WHEN k % 5 = 0 THEN 'Dataset0' ELSE 'dataset' END || number || '_' || stage || '.csv' AS path, number,
    CASE WHEN stage <> 'mid' THEN 'dataset' || number || '_' || stage END AS cohort_key FROM named),
judged AS (
  SELECT path, cohort_key, CASE WHEN cohort_key IS NULL THEN 'unknown_name' WHEN number NOT BETWEEN 1 AND 7 THEN 'number_out_of_range'
    WHEN count(*) OVER (PARTITION BY cohort_key) > 1 THEN 'several_files_per_key' END AS problem FROM files)
SELECT path, cohort_key, problem FROM judged WHERE problem IS NOT NULL""",
)
def matrix_file_problems(spark, folder):
    """Files that an input folder rejects by their names."""
    return files.key_problems(b.arrival_paths(spark, folder))


@register("wide_to_long", "S3", "SELECT cohort, id, feature, value FROM b_cell")
def wide_to_long(spark, folder):
    return b.cells(spark, folder)


@register(
    "vector_to_long",
    "S3",
    """
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label < 5 AS INTEGER) AS y, 'v' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature,
  CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, unnest(range(0, len(embedding))) t(i)""",
)
def vector_to_long(spark, folder):
    """Array features exploded to named cells."""
    return b.table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        (F.col("label") < 5).cast("int").alias("y"),
        F.posexplode("embedding").alias("i", "x"),
    ).select("id", "y", F.concat(F.lit("v"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"), F.col("x").cast("double").alias("value"))


@register(
    "json_settings",
    "S7",
    """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, CAST(min(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_min
FROM events GROUP BY ALL""",
)
def json_settings(spark, folder):
    """JSON columns read with a declared schema."""
    settings = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return (
        b.table(spark, folder, "events")
        .select("event_type", settings.alias("s"))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("s.k").alias("k_sum"), F.min("s.k").alias("k_min"))
    )


@register(
    "result_bundle_summary",
    "S8 S9 S10",
    """
SELECT 'samples' AS table_name, cohort, count(*) AS n_rows FROM b_sample GROUP BY ALL
UNION ALL SELECT 'folds', cohort, count(*) FROM b_fold GROUP BY ALL
UNION ALL SELECT 'predictions', cohort, count(*) FROM b_pred GROUP BY ALL""",
)
def result_bundle_summary(spark, folder):
    """Named tables written by unit (refusing to overwrite), read back and counted."""
    target = files.scratch_folder(spark, "bundle")
    tables = {
        "samples": b.samples(spark, folder),
        "folds": b.folds(spark, folder),
        "predictions": b.predictions(spark, folder),
    }
    files.write_bundle(tables, target, ["cohort"])
    return files.bundle_summary(files.read_bundle(spark, target, list(tables)), ["cohort"])


@register(
    "cell_problems",
    "P20 S4",
    """
SELECT cohort, raw_id, feature, token, CASE WHEN TRY_CAST(trim(token) AS DOUBLE) IS NULL THEN 'non_numeric' ELSE 'non_finite' END AS problem
FROM b_stage_long WHERE token IS NOT NULL AND lower(trim(token)) NOT IN ('', 'na', 'n/a')
  AND (TRY_CAST(trim(token) AS DOUBLE) IS NULL OR NOT isfinite(TRY_CAST(trim(token) AS DOUBLE)))""",
)
def cell_problems(spark, folder):
    wide = b.staging(spark, folder).withColumnsRenamed(dict(zip(b.PADDED, FEATURES)))
    return ingest.cell_problems(wide.unpivot(["cohort", "raw_id"], FEATURES, "feature", "token"))


@register(
    "label_parse",
    "F3 P20",
    "SELECT cohort, raw_label, y, count(*) AS n FROM b_stage JOIN b_label USING (raw_label) GROUP BY ALL",
)
def label_parse(spark, folder):
    return (
        b.staging(spark, folder)
        .groupBy("cohort", "raw_label", scalars.parse_label("raw_label").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "id_quality",
    "P10 F2",
    """
SELECT id, count(*) AS n, CASE WHEN id = '' THEN 'blank_id' ELSE 'duplicate_id' END AS problem
FROM (SELECT CASE substr(md5('o' || o_orderkey), 1, 1) WHEN '0' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS id FROM orders)
GROUP BY id HAVING id = '' OR count(*) > 1""",
)
def id_quality(spark, folder):
    """Blank and duplicate identifiers of a text column that should be unique."""
    raw = b.table(spark, folder, "orders").select(
        F.when(F.substring(F.md5(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))), 1, 1) == "0", "  ")
        .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .alias("raw")
    )
    return ingest.id_problems(raw, [], "raw")


@register(
    "id_offender_report",
    "O7 P10",
    "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, id LIMIT 10",
)
def id_offender_report(spark, folder):
    counted = b.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ingest.first_offenders(counted.where("n > 1"), [F.desc("n"), F.asc("id")])


@register(
    "header_collisions",
    "P12 F1",
    """
SELECT c_type AS cohort, normalized, count(*) AS n FROM (
  SELECT p_type AS c_type, lower(trim(regexp_replace(replace(upper(p_name), ' ', '   '), '\\s+', ' ', 'g'))) AS normalized FROM part)
GROUP BY ALL HAVING count(*) > 1 OR normalized = ''""",
)
def header_collisions(spark, folder):
    names = b.table(spark, folder, "part").select(
        F.col("p_type").alias("cohort"),
        F.concat(F.lit(" "), F.replace(F.upper("p_name"), F.lit(" "), F.lit(" \t "))).alias("header"),
    )
    return ingest.header_problems(names, ["cohort"], "header")


@register(
    "reserved_feature_names",
    "P11",
    """
SELECT p_type AS cohort, p_name AS feature, count(*) AS n FROM part WHERE lower(p_name) IN ('small ring', 'red widget') GROUP BY ALL""",
)
def reserved_feature_names(spark, folder):
    """Names that must not appear in the feature block, matched after normalisation."""
    reserved = ["small ring", "red widget"]
    return (
        b.table(spark, folder, "part")
        .where(scalars.clean_name("p_name").isin(reserved))
        .groupBy(F.col("p_type").alias("cohort"), F.col("p_name").alias("feature"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "canonical_keys",
    "P2",
    "SELECT lower(o_orderpriority) AS cohort_key, count(*) AS n FROM orders GROUP BY 1",
)
def canonical_keys(spark, folder):
    padded = F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))
    return b.table(spark, folder, "orders").groupBy(scalars.clean_key(padded).alias("cohort_key")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "exact_integers",
    "F8",
    """
SELECT raw_text, count(*) AS n, CASE WHEN v = floor(v) THEN CAST(v AS BIGINT) END AS parsed
FROM (SELECT CAST(l_quantity AS VARCHAR) AS raw_text, l_quantity AS v FROM lineitem
      UNION ALL SELECT CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR), l_discount FROM lineitem UNION ALL SELECT l_returnflag, NULL FROM lineitem) GROUP BY ALL""",
)
def exact_integers(spark, folder):
    """Integers parsed from text only when nothing would be truncated."""
    items = b.table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_returnflag")
    texts = F.array(
        F.col("l_quantity").cast("string"), F.col("l_discount").cast("decimal(4,2)").cast("string"), F.col("l_returnflag")
    )
    return (
        items.select(F.explode(texts).alias("raw_text"))
        .groupBy("raw_text")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("parsed", scalars.exact_integer("raw_text"))
    )


@register(
    "boolean_text",
    "F9",
    """
SELECT token, count(*) AS n, CASE lower(trim(token)) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS parsed
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN ' True' WHEN 'O' THEN 'FALSE' ELSE 'yes' END AS token FROM orders) GROUP BY ALL""",
)
def boolean_text(spark, folder):
    token = F.when(F.col("o_orderstatus") == "F", " True").when(F.col("o_orderstatus") == "O", "FALSE").otherwise("yes")
    return (
        b.table(spark, folder, "orders")
        .groupBy(token.alias("token"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("parsed", scalars.parse_bool("token"))
    )


@register(
    "numeric_range_violations",
    "F13",
    """
SELECT l_orderkey, l_linenumber, field, value, problem FROM (
  SELECT l_orderkey, l_linenumber, 'l_quantity' AS field, l_quantity AS value,
    CASE WHEN l_quantity NOT BETWEEN 1 AND 45 THEN 'out_of_range' WHEN l_quantity <> floor(l_quantity) THEN 'not_integer' END AS problem FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount, CASE WHEN l_discount NOT BETWEEN 0 AND 0.09 THEN 'out_of_range' END FROM lineitem)
WHERE problem IS NOT NULL""",
)
def numeric_range_violations(spark, folder):
    from foldwise.operators.checks import range_violations

    items = b.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return range_violations(
        items, ["l_orderkey", "l_linenumber"], {"l_quantity": (1, 45, True), "l_discount": (0, 0.09, False)}
    )


@register(
    "table_fingerprints",
    "F11",
    """
SELECT cohort, count(*) AS n_rows, sha256(count(*) || '|' || sum(p0)::VARCHAR || '|' || sum(p1)::VARCHAR || '|' || sum(p2)::VARCHAR || '|' || sum(p3)::VARCHAR) AS fingerprint
FROM (SELECT cohort, ('0x' || substr(h, 1, 8))::HUGEINT AS p0, ('0x' || substr(h, 9, 8))::HUGEINT AS p1, ('0x' || substr(h, 17, 8))::HUGEINT AS p2, ('0x' || substr(h, 25, 8))::HUGEINT AS p3
  FROM (SELECT cohort, sha256(id || '|' || feature || '|' || coalesce(CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR), 'missing')) AS h FROM b_cell))
GROUP BY cohort""",
)
def table_fingerprints(spark, folder):
    return ingest.fingerprint(
        b.cells(spark, folder), ["cohort"], [F.col("id"), F.col("feature"), F.col("value").cast("decimal(18,4)").cast("string")]
    )


# Rules --------------------------------------------------------------------------------------------


@register("feature_rules", "P4", "SELECT * FROM b_rule")
def feature_rules(spark, folder):
    return b.rules(spark, folder)


@register("scale_aware_rules", "P5", "SELECT * FROM b_rule_scaled")
def scale_aware_rules(spark, folder):
    return b.rules(spark, folder, scale_aware=True)


@register(
    "rule_violations",
    "P6",
    """
SELECT cohort, feature, input_scale, 'log_scale_needs_identity_and_valid_values' AS problem FROM (
  SELECT cohort, feature, CASE WHEN cohort = 'HOUSEHOLD' THEN 'log10' ELSE input_scale END AS input_scale, transform, zero_is_missing, negative_is_missing FROM b_rule)
WHERE input_scale IN ('log10', 'derived_log10_ratio') AND (transform <> 'identity' OR zero_is_missing OR negative_is_missing)
UNION ALL SELECT cohort, feature, 'derived_log10_ratio', 'ratio_forbids_half_minimum' FROM b_feature WHERE cohort = 'BUILDING' AND feature = 'f_bal'""",
)
def rule_violations(spark, folder):
    """Rules with planted faults: a cohort declared log10 without adapting its rules, a ratio with half-minimum."""
    planted = (
        b.rules(spark, folder)
        .withColumn(
            "input_scale",
            F.when((F.col("cohort") == "HOUSEHOLD"), "log10").otherwise(F.col("input_scale")),
        )
        .withColumn(
            "half_minimum_allowed",
            F.col("half_minimum_allowed") | ((F.col("cohort") == "BUILDING") & (F.col("feature") == "f_bal")),
        )
    )
    return planted.select("cohort", "feature", "input_scale", rules.rule_violation().alias("problem")).where(
        "problem IS NOT NULL"
    )


@register("masked_cells", "P3", "SELECT cohort, id, feature, raw_value, value FROM b_masked")
def masked_cells(spark, folder):
    joined = b.cells(spark, folder).join(b.rules(spark, folder), ["cohort", "feature"])
    return joined.select("cohort", "id", "feature", F.col("value").alias("raw_value"), rules.masked_value().alias("value"))


@register(
    "transformed_cells",
    "F4",
    """
SELECT cohort, id, feature, round(CASE WHEN transform = 'log1p' THEN ln(1 + value) ELSE value END, 8) AS value
FROM b_masked WHERE value IS NOT NULL""",
)
def transformed_cells(spark, folder):
    return (
        masked(spark, folder)
        .where(F.col("value").isNotNull())
        .select("cohort", "id", "feature", F.round(scalars.transform_value("value", "transform"), 8).alias("value"))
    )


@register(
    "required_forbidden_features",
    "P7",
    """
SELECT 'AUTOMOBILE' AS cohort, 'f_absent' AS feature, 'required_missing' AS problem
UNION ALL SELECT cohort, feature, 'forbidden_name' FROM b_feature WHERE cohort = 'HOUSEHOLD' AND feature = 'f_void'
UNION ALL SELECT cohort, feature, 'forbidden_pattern' FROM b_feature WHERE cohort = 'FURNITURE' AND regexp_matches(feature, '^f_(vo|ma)')""",
)
def required_forbidden_features(spark, folder):
    schema = "cohort string, feature string"
    return rules.required_and_forbidden(
        b.feature_names(spark, folder),
        spark.createDataFrame([("AUTOMOBILE", "F_Bal"), ("AUTOMOBILE", "f_absent")], schema),
        spark.createDataFrame([("HOUSEHOLD", "F_VOID ")], schema),
        spark.createDataFrame([("FURNITURE", "(?i)^F_(vo|ma)")], "cohort string, pattern string"),
    )


@register("all_missing_features", "P8", "SELECT cohort, feature FROM b_masked GROUP BY ALL HAVING count(value) = 0")
def all_missing_features(spark, folder):
    return rules.all_missing_features(masked(spark, folder))


@register(
    "retained_cells",
    "P8",
    "SELECT cohort, id, feature, value FROM b_masked WHERE (cohort, feature) IN (SELECT (cohort, feature) FROM b_masked GROUP BY cohort, feature HAVING count(value) > 0)",
)
def retained_cells(spark, folder):
    return rules.retained_cells(masked(spark, folder)).select("cohort", "id", "feature", "value")


@register(
    "empty_samples",
    "P9",
    """
SELECT cohort, id FROM (SELECT cohort, id, CASE WHEN feature IN ('f_spend', 'f_pending', 'f_void') THEN value END AS value FROM b_masked)
GROUP BY ALL HAVING count(value) = 0""",
)
def empty_samples(spark, folder):
    """Samples left without information when only two sparse features are retained."""
    sparse = masked(spark, folder).withColumn(
        "value", F.when(F.col("feature").isin("f_spend", "f_pending", "f_void"), F.col("value"))
    )
    return rules.empty_samples(sparse)


@register("feature_manifest", "A4", "SELECT * REPLACE (round(missing_rate_after_rules, 8) AS missing_rate_after_rules) FROM b_manifest")
def feature_manifest(spark, folder):
    return manifest(spark, folder).withColumn("missing_rate_after_rules", F.round("missing_rate_after_rules", 8))


@register(
    "missingness_summary",
    "A5",
    """
SELECT cohort, max(n_samples) AS n_samples, count(*) AS input_features, count(*) FILTER (NOT included_in_analysis) AS all_missing_excluded,
  count(*) FILTER (included_in_analysis) AS remaining_features, CAST(sum(n_missing_after_rules) AS BIGINT) AS missing_cells_input,
  CAST(sum(n_missing_after_rules) FILTER (included_in_analysis) AS BIGINT) AS missing_cells_remaining,
  round(sum(n_missing_after_rules) / CAST(max(n_samples) * count(*) AS DOUBLE), 8) AS missing_rate_input,
  round(sum(n_missing_after_rules) FILTER (included_in_analysis) / CAST(max(n_samples) * count(*) FILTER (included_in_analysis) AS DOUBLE), 8) AS missing_rate_remaining,
  count(*) FILTER (included_in_analysis AND n_missing_after_rules > 0) AS remaining_features_with_missing
FROM b_manifest GROUP BY cohort""",
)
def missingness_summary(spark, folder):
    out = ingest.missingness(manifest(spark, folder))
    return out.withColumns({c: F.round(c, 8) for c in ("missing_rate_input", "missing_rate_remaining")})


EXPECTED = [("AUTOMOBILE", 298, 157), ("BUILDING", 300, 147), ("ABSENT", 10, 5)]


@register(
    "input_expectations",
    "A24 J7",
    """
SELECT e.cohort, e.n AS expected_n, e.positive AS expected_positive, s.n AS observed_n, s.positive AS observed_positive,
  CASE WHEN s.cohort IS NULL THEN 'not_provided' WHEN s.n = e.n AND s.positive = e.positive THEN 'as_expected' ELSE 'count_mismatch' END AS status
FROM (VALUES ('AUTOMOBILE', 298::BIGINT, 157::BIGINT), ('BUILDING', 300, 147), ('ABSENT', 10, 5)) e(cohort, n, positive)
LEFT JOIN (SELECT cohort, count(*) AS n, CAST(sum(y) AS BIGINT) AS positive FROM b_sample GROUP BY 1) s USING (cohort)""",
)
def input_expectations(spark, folder):
    from foldwise.operators.resample import class_counts

    expected = spark.createDataFrame(EXPECTED, "cohort string, expected_n long, expected_positive long")
    observed = class_counts(b.samples(spark, folder), ["cohort"])
    joined = expected.join(observed, "cohort", "left")
    same = (F.col("n") == F.col("expected_n")) & (F.col("positive") == F.col("expected_positive"))
    return joined.select(
        "cohort",
        "expected_n",
        "expected_positive",
        F.col("n").alias("observed_n"),
        F.col("positive").alias("observed_positive"),
        F.when(F.col("n").isNull(), "not_provided").when(same, "as_expected").otherwise("count_mismatch").alias("status"),
    )


CTES["b_mask"] = "SELECT cohort, id, feature FROM b_cell WHERE feature = 'f_pending' AND value = 0 AND substr(md5('mask' || id), 1, 1) < '8'"
CTES["b_restored"] = """
SELECT c.cohort, c.id, c.feature, CASE WHEN m.id IS NULL THEN c.value END AS value
FROM b_cell c LEFT JOIN b_mask m USING (cohort, id, feature)"""


def mask(spark, folder):
    return (
        b.cells(spark, folder)
        .where((F.col("feature") == "f_pending") & (F.col("value") == 0))
        .where(F.substring(F.md5(F.concat(F.lit("mask"), "id")), 1, 1) < "8")
        .select("cohort", "id", "feature")
    )


@register("restored_cells", "J9", "SELECT * FROM b_restored")
def restored_cells(spark, folder):
    return ingest.restore_mask(b.cells(spark, folder), mask(spark, folder))


@register(
    "restoration_check",
    "V12",
    """
SELECT b.cohort, count(*) FILTER (m.id IS NOT NULL AND b.value = 0 AND a.value IS NULL) AS restored,
  count(*) FILTER (m.id IS NOT NULL AND b.value IS DISTINCT FROM 0) AS listed_not_zero,
  count(*) FILTER (m.id IS NULL AND a.value IS DISTINCT FROM b.value) AS changed_unlisted,
  count(*) FILTER (m.id IS NULL AND a.value = 0) AS genuine_zeros, count(*) FILTER (a.present IS NULL) AS layout_changes
FROM b_cell b LEFT JOIN (SELECT cohort, id, feature, CASE WHEN damage = '01' THEN value + 1 ELSE value END AS value, TRUE AS present
  FROM (SELECT *, substr(md5('damage' || feature || id), 1, 2) AS damage FROM b_restored) WHERE damage <> '00') a USING (cohort, id, feature) LEFT JOIN b_mask m USING (cohort, id, feature) GROUP BY b.cohort""",
)
def restoration_check(spark, folder):
    """A repaired matrix, of which some cells are lost and some changed by hash, against its source."""
    cells, marked = b.cells(spark, folder), mask(spark, folder)
    damage = F.substring(F.md5(F.concat(F.lit("damage"), "feature", "id")), 1, 2)
    repaired = ingest.restore_mask(cells, marked).where(damage != "00")
    repaired = repaired.withColumn("value", F.when(damage == "01", F.col("value") + 1).otherwise(F.col("value")))
    return ingest.restoration_check(cells, repaired, marked)
