"""Verification queries: saved tables against their recomputation, with planted faults to find."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.catalog import compare as cc
from foldwise.catalog import metrics as cm
from foldwise.catalog.oracle import CTES
from foldwise.catalog.registry import register
from foldwise.functions import scalars
from foldwise.operators import calibration, checks, ingest, metrics, resample
from foldwise.plans.design import EN_C_GRID, L2_C_GRID, MAX_K
from foldwise.sources import bindings as b
from foldwise.sources import tuning

rounded = cm.rounded
FIT, FIT_SQL = cc.FIT, cc.FIT_SQL


def fault(purpose, *parts, n=2):
    """Leading hex digits of a hash: the faults below are planted where it equals a fixed value."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(purpose), *parts)), 1, n)


def fault_sql(purpose, *parts, n=2):
    return f"substr(md5('{purpose}' || '|' || {' || '.join(f'{p}' if i == 0 else chr(39) + '|' + chr(39) + ' || ' + p for i, p in enumerate(parts))}), 1, {n})"


# Saved predictions with moved folds, flipped labels and dropped rows ------------------------------

BAD = fault_sql("bad", "method", "repeat", "id")
CTES["b_saved"] = f"""
SELECT cohort, method, id, repeat, CAST(CASE WHEN {BAD} = '00' THEN outer_fold % 5 + 1 ELSE outer_fold END AS INTEGER) AS outer_fold,
  CASE WHEN {BAD} = '01' THEN 1 - y_true ELSE y_true END AS y_true, p FROM b_pred WHERE scenario = 'primary' AND {BAD} <> '02'"""


def primary(spark, folder):
    return b.predictions(spark, folder).where(F.col("scenario") == "primary").drop("scenario")


def saved(spark, folder):
    bad = fault("bad", "method", "repeat", "id")
    return (
        primary(spark, folder)
        .withColumn("outer_fold", F.when(bad == "00", F.col("outer_fold") % 5 + 1).otherwise(F.col("outer_fold")))
        .withColumn("y_true", F.when(bad == "01", 1 - F.col("y_true")).otherwise(F.col("y_true")))
        .where(bad != "02")
    )


@register(
    "saved_predictions_vs_plan",
    "V1",
    """
SELECT cohort, method, id, repeat, CASE WHEN s.y_true IS NULL THEN 'missing_prediction' WHEN s.outer_fold <> f.outer_fold THEN 'fold_differs' ELSE 'label_differs' END AS problem
FROM (SELECT cohort, id, repeat, outer_fold, y, method FROM b_fold, (VALUES ('nested'), ('non_nested')) m(method)) f LEFT JOIN b_saved s USING (cohort, method, id, repeat)
WHERE s.y_true IS NULL OR s.outer_fold <> f.outer_fold OR s.y_true <> f.y""",
)
def saved_predictions_vs_plan(spark, folder):
    """Saved fold identity and labels against the rebuilt plan, every id of every repeat."""
    keys = ["cohort", "method", "id", "repeat"]
    plan = b.folds(spark, folder).withColumn("method", F.explode(F.array(F.lit("nested"), F.lit("non_nested"))))
    kept = saved(spark, folder).select(*keys, F.col("outer_fold").alias("s_fold"), F.col("y_true").alias("s_y"))
    joined = plan.join(kept, keys, "left")
    problem = (
        F.when(F.col("s_y").isNull(), "missing_prediction")
        .when(F.col("s_fold") != F.col("outer_fold"), "fold_differs")
        .when(F.col("s_y") != F.col("y"), "label_differs")
    )
    return joined.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


@register(
    "pair_identity",
    "J5 U3",
    """
SELECT cohort, id, repeat, outer_fold, y_true, count(*) FILTER (method = 'nested') AS left_n, count(*) FILTER (method = 'non_nested') AS right_n,
  CASE WHEN count(*) FILTER (method = 'non_nested') = 0 THEN 'extra' WHEN count(*) FILTER (method = 'nested') = 0 THEN 'missing' ELSE 'count_differs' END AS problem
FROM b_saved GROUP BY cohort, id, repeat, outer_fold, y_true HAVING count(*) FILTER (method = 'nested') <> count(*) FILTER (method = 'non_nested')""",
)
def pair_identity(spark, folder):
    """Two methods must hold the same (repeat, id, fold, label) rows; both directions in one shuffle."""
    rows = saved(spark, folder)
    columns = ["cohort", "id", "repeat", "outer_fold", "y_true"]
    return checks.set_difference(
        rows.where(F.col("method") == "nested"), rows.where(F.col("method") == "non_nested"), columns
    )


@register(
    "oof_completeness",
    "A6 U3",
    """
SELECT cohort, method, id, n, n_labels, CASE WHEN n <> 5 THEN 'incomplete_repeats' ELSE 'label_conflict' END AS problem
FROM (SELECT cohort, method, id, count(*) AS n, count(DISTINCT y_true) AS n_labels FROM b_saved GROUP BY ALL) WHERE n <> 5 OR n_labels > 1""",
)
def oof_completeness(spark, folder):
    """Every id once per repeat with one label."""
    counted = saved(spark, folder).groupBy("cohort", "method", "id").agg(
        F.count(F.lit(1)).alias("n"), (F.max("y_true") - F.min("y_true") + 1).cast("long").alias("n_labels")
    )
    problem = F.when(F.col("n") != resample.OUTER_REPEATS, "incomplete_repeats").when(F.col("n_labels") > 1, "label_conflict")
    return counted.withColumn("problem", problem).where("problem IS NOT NULL")


# Parameter rows -------------------------------------------------------------------------------------

PB = fault_sql("param", "cohort", "repeat", "outer_fold", n=1)
CTES["b_saved_param"] = f"""
SELECT * REPLACE (CASE WHEN {PB} = '0' THEN train_positive + 1 ELSE train_positive END AS train_positive, CASE WHEN {PB} = '1' THEN 0.02e0 ELSE "en_C" END AS "en_C",
  CASE WHEN {PB} = '2' THEN 11 ELSE k_selected END AS k_selected, CASE WHEN {PB} = '3' THEN weight_positive + 0.01e0 ELSE weight_positive END AS weight_positive,
  CASE WHEN {PB} = '4' THEN 7.0e0 ELSE "l2_C" END AS "l2_C") FROM b_param"""


def saved_parameters(spark, folder):
    bad = fault("param", "cohort", "repeat", "outer_fold", n=1)
    swap = lambda digit, name, value: F.when(bad == digit, value).otherwise(F.col(name))
    return cc.parameters(spark, folder).withColumns(
        {
            "train_positive": swap("0", "train_positive", F.col("train_positive") + 1),
            "en_C": swap("1", "en_C", F.lit(0.02)),
            "k_selected": swap("2", "k_selected", F.lit(11)),
            "weight_positive": swap("3", "weight_positive", F.col("weight_positive") + 0.01),
            "l2_C": swap("4", "l2_C", F.lit(7.0)),
        }
    )


def in_list(values):
    return ", ".join(f"{float(v)!r}::DOUBLE" for v in values)


@register(
    "parameter_row_problems",
    "V2 V6",
    f"""
SELECT {FIT_SQL}, problem FROM (
  SELECT p.cohort, p.repeat, p.outer_fold, unnest([CASE WHEN p.train_positive <> c.train_positive OR p.train_negative <> c.train_negative OR p.train_n <> c.train_n THEN 'train_counts' END,
    CASE WHEN "en_C" NOT IN ({in_list(EN_C_GRID)}) THEN 'en_C_off_grid' END, CASE WHEN "l2_C" NOT IN ({in_list(L2_C_GRID)}) THEN 'l2_C_off_grid' END,
    CASE WHEN k_selected NOT BETWEEN 1 AND {MAX_K} THEN 'k_out_of_range' END, CASE WHEN abs(weight_positive - p.train_n / (2.0e0 * p.train_positive)) > 1e-12 + 1e-10 * abs(p.train_n / (2.0e0 * p.train_positive)) THEN 'weights' END]) AS problem
  FROM b_saved_param p JOIN b_counts c USING ({FIT_SQL})) WHERE problem IS NOT NULL""",
)
def parameter_row_problems(spark, folder):
    """Counts against the rebuilt plan, grid membership, k range and balanced weights."""
    counts = resample.fold_counts(b.folds(spark, folder), ["cohort", "repeat"], "outer_fold").select(
        *FIT, *[F.col(c).alias(f"true_{c}") for c in ("train_n", "train_positive", "train_negative")]
    )
    joined = saved_parameters(spark, folder).join(counts, FIT, "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"true_{c}"))
    one, _ = resample.balanced_weights("train_n", "train_positive", "train_negative")
    return checks.violations(
        joined,
        FIT,
        {
            "train_counts": differs("train_n") | differs("train_positive") | differs("train_negative"),
            "en_C_off_grid": ~F.col("en_C").isin([float(v) for v in EN_C_GRID]),
            "l2_C_off_grid": ~F.col("l2_C").isin([float(v) for v in L2_C_GRID]),
            "k_out_of_range": ~F.col("k_selected").between(1, MAX_K),
            "weights": ~scalars.close(F.col("weight_positive"), one),
        },
    )


FB = fault_sql("flag", "cohort", "repeat", "outer_fold", "feature")


@register(
    "feature_flag_problems",
    "V3",
    f"""
SELECT {FIT_SQL}, feature, problem FROM (
  SELECT {FIT_SQL}, feature, unnest([CASE WHEN s IS DISTINCT FROM coalesce(rank <= k_selected, FALSE) THEN 'selected_flag' END, CASE WHEN used AND NOT s THEN 'used_not_selected' END,
    CASE WHEN used <> (coef IS NOT NULL) THEN 'used_without_coefficient' END]) AS problem
  FROM (SELECT f.*, k_selected, CASE WHEN {FB} = '00' THEN NOT selected ELSE selected END AS s FROM b_ffit f JOIN b_choice USING ({FIT_SQL}))) WHERE problem IS NOT NULL""",
)
def feature_flag_problems(spark, folder):
    """Selected exactly when rank <= k; used only when selected; a coefficient exactly when used."""
    bad = fault("flag", "cohort", "repeat", "outer_fold", "feature")
    rows = cc.feature_table(spark, folder).join(cc.choice(spark, folder).select(*FIT, "k_selected"), FIT)
    flipped = rows.withColumn("selected", F.when(bad == "00", ~F.col("selected")).otherwise(F.col("selected")))
    expected = F.coalesce(F.col("rank") <= F.col("k_selected"), F.lit(False))
    return checks.violations(
        flipped,
        [*FIT, "feature"],
        {
            "selected_flag": F.col("selected") != expected,
            "used_not_selected": F.col("used") & ~F.col("selected"),
            "used_without_coefficient": F.col("used") != F.col("coef").isNotNull(),
        },
    )


@register(
    "feature_universe_gaps",
    "V3 J10",
    f"""
SELECT {FIT_SQL}, feature, CASE WHEN r.feature IS NULL THEN 'missing' ELSE 'extra' END AS problem
FROM (SELECT {FIT_SQL}, feature FROM b_universe JOIN b_choice USING (cohort)) u FULL JOIN (SELECT {FIT_SQL}, feature FROM b_rerank) r USING ({FIT_SQL}, feature) WHERE r.feature IS NULL OR u.feature IS NULL""",
)
def feature_universe_gaps(spark, folder):
    """Features of a cohort that a saved per-fit table does not list."""
    universe = tuning.features(spark, folder).join(cc.choice(spark, folder).select(*FIT), "cohort")
    return checks.set_difference(cc.reranked(spark, folder), universe, [*FIT, "feature"]).select(*FIT, "feature", "problem")


# Saved results against recomputation -------------------------------------------------------------------

OB = fault_sql("oof", "cohort", "method", "id")


@register(
    "saved_oof_disagreement",
    "V4 V5 F10",
    f"""
SELECT cohort, method, id, field, round(saved, 8) AS saved, round(recomputed, 8) AS recomputed FROM (
  SELECT cohort, method, id, unnest(['p_oof', 'p_oof_sd', 'oof_count']) AS field,
    unnest([CASE WHEN {OB} = '00' THEN p_oof + 0.001e0 ELSE p_oof END, p_oof_sd, CASE WHEN {OB} = '01' THEN oof_count - 1 ELSE oof_count END]) AS saved, unnest([p_oof, p_oof_sd, oof_count]) AS recomputed
  FROM b_oof WHERE scenario = 'primary') WHERE abs(saved - recomputed) > 1e-12 + 1e-10 * abs(recomputed)""",
)
def saved_oof_disagreement(spark, folder):
    keys = ["cohort", "method", "id"]
    fresh = metrics.averaged_oof(primary(spark, folder), ["cohort", "method"])
    bad = fault("oof", *keys)
    kept = fresh.withColumns(
        {
            "p_oof": F.when(bad == "00", F.col("p_oof") + 0.001).otherwise(F.col("p_oof")),
            "oof_count": F.when(bad == "01", F.col("oof_count") - 1).otherwise(F.col("oof_count")),
        }
    )
    return rounded(checks.disagreement(kept, fresh, keys, ["p_oof", "p_oof_sd", "oof_count"]), "saved", "recomputed")


MB = fault_sql("metric", "cohort", "method", "repeat", n=1)


@register(
    "saved_metric_disagreement",
    "V4 V5 F10",
    f"""
SELECT cohort, method, repeat, field, round(saved, 8) AS saved, round(recomputed, 8) AS recomputed FROM (
  SELECT cohort, method, repeat, unnest(['roc_auc', 'brier']) AS field, unnest([CASE WHEN {MB} = '0' THEN roc_auc + 1e-6 ELSE roc_auc END, CASE WHEN {MB} = '1' THEN brier * 1.01e0 ELSE brier END]) AS saved, unnest([roc_auc, brier]) AS recomputed
  FROM b_repeat_metrics WHERE scenario = 'primary') WHERE abs(saved - recomputed) > 1e-12 + 1e-10 * abs(recomputed)""",
)
def saved_metric_disagreement(spark, folder):
    keys = ["cohort", "method", "repeat"]
    fresh = metrics.discrimination(primary(spark, folder), keys)
    bad = fault("metric", *keys, n=1)
    kept = fresh.withColumns(
        {
            "roc_auc": F.when(bad == "0", F.col("roc_auc") + 1e-6).otherwise(F.col("roc_auc")),
            "brier": F.when(bad == "1", F.col("brier") * 1.01).otherwise(F.col("brier")),
        }
    )
    return rounded(checks.disagreement(kept, fresh, keys, ["roc_auc", "brier"]), "saved", "recomputed")


BB = fault_sql("bin", "cohort", "method", "probability_variant", "bin", n=1)


@register(
    "calibration_bin_problems",
    "V7",
    f"""
SELECT cohort, method, probability_variant, CAST(bin AS INTEGER) AS bin, problem FROM (
  SELECT *, unnest([CASE WHEN pos > n THEN 'positive_exceeds_n' END, CASE WHEN abs(observed_rate - pos / CAST(n AS DOUBLE)) > 1e-12 + 1e-10 * (pos / CAST(n AS DOUBLE)) THEN 'rate' END,
    CASE WHEN lo > observed_rate + 1e-12 OR observed_rate > observed_rate_wilson95_high + 1e-12 THEN 'interval_order' END, CASE WHEN bin <> pos_in_order THEN 'bin_sequence' END, CASE WHEN total <> first_total THEN 'method_totals' END]) AS problem
  FROM (SELECT *, row_number() OVER (PARTITION BY cohort, method, probability_variant ORDER BY bin) AS pos_in_order, sum(n) OVER (PARTITION BY cohort, method, probability_variant) AS total,
          min(total_all) OVER (PARTITION BY cohort, probability_variant) AS first_total
    FROM (SELECT *, sum(n) OVER (PARTITION BY cohort, method, probability_variant) AS total_all, CASE WHEN {BB} = '0' THEN n + 1 ELSE n_positive END AS pos,
          CASE WHEN {BB} = '1' THEN observed_rate + 0.01e0 ELSE observed_rate_wilson95_low END AS lo FROM b_bins WHERE method <> 'holdout' AND {BB} <> '2'))) WHERE problem IS NOT NULL""",
)
def calibration_bin_problems(spark, folder):
    """Counts, rates, interval order, contiguous bins and equal totals across methods."""
    keys = ["cohort", "method", "probability_variant"]
    units = cm.primary_units(spark, folder).where(F.col("method") != "holdout")
    bins = calibration.calibration_bins(units, keys)
    return checks.bin_problems(_planted_bins(bins, keys), keys, ["cohort", "probability_variant"])


def _planted_bins(bins, keys):
    bad = fault("bin", *keys, "bin", n=1)
    return bins.where(bad != "2").withColumns(
        {
            "n_positive": F.when(bad == "0", F.col("n") + 1).otherwise(F.col("n_positive")),
            "observed_rate_wilson95_low": F.when(bad == "1", F.col("observed_rate") + 0.01).otherwise(
                F.col("observed_rate_wilson95_low")
            ),
        }
    )


SB = fault_sql("scale", "panel", "cohort", "method", n=1)


@register(
    "scale_table_problems",
    "V8",
    f"""
SELECT panel, cohort, method, problem FROM (
  SELECT *, unnest([CASE WHEN NOT (panel = 'D' OR (original BETWEEN 0 AND 1 AND s BETWEEN 0 AND 1)) THEN 'out_of_range' END, CASE WHEN abs(difference - (s - original)) > 1e-12 + 1e-10 * abs(s - original) THEN 'difference' END,
    CASE WHEN n <> 1 THEN 'duplicate_key' END, CASE WHEN rows_in_panel <> CASE panel WHEN 'B' THEN 2 ELSE 1 END * 5 THEN 'panel_size' END]) AS problem
  FROM (SELECT panel, cohort, method, original, CASE WHEN {SB} = '0' THEN scale_aware + 1 ELSE scale_aware END AS s, difference, count(*) OVER (PARTITION BY panel, cohort, method) AS n, count(*) OVER (PARTITION BY panel) AS rows_in_panel
        FROM b_scale_wide WHERE {SB} <> '1')) WHERE problem IS NOT NULL""",
)
def scale_table_problems(spark, folder):
    """Contract of the comparison table: panel sizes, unique keys, ranges, differences."""
    bad = fault("scale", "panel", "cohort", "method", n=1)
    keys = ["panel", "cohort", "method"]
    table = cc.scale_table(spark, folder).where(bad != "1").withColumn(
        "scale_aware", F.when(bad == "0", F.col("scale_aware") + 1).otherwise(F.col("scale_aware"))
    )
    counted = table.withColumns(
        {
            "n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            "panel_n": F.count(F.lit(1)).over(Window.partitionBy("panel")),
        }
    )
    unit = F.col("original").between(0, 1) & F.col("scale_aware").between(0, 1)
    size = F.when(F.col("panel") == "B", 10).otherwise(5)
    return checks.violations(
        counted,
        keys,
        {
            "out_of_range": (F.col("panel") != "D") & ~unit,
            "difference": ~scalars.close("difference", F.col("scale_aware") - F.col("original")),
            "duplicate_key": F.col("n") != 1,
            "panel_size": F.col("panel_n") != size,
        },
    )


# Sources, manifests, settings ----------------------------------------------------------------------------


@register(
    "changed_sources",
    "V9 F11 U4",
    """
SELECT c_mktsegment AS cohort, 'scenario' || c_nationkey AS scenario FROM customer GROUP BY ALL
HAVING bool_or(substr(md5('edit' || c_custkey), 1, 3) = '000')""",
)
def changed_sources(spark, folder):
    """Units whose rows differ between two reads, found by comparing order-independent fingerprints."""
    rows = b.table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("cohort"),
        F.concat(F.lit("scenario"), F.col("c_nationkey").cast("string")).alias("scenario"),
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("v"),
    )
    edited = F.substring(F.md5(F.concat(F.lit("edit"), "id")), 1, 3) == "000"
    later = rows.withColumn("v", F.when(edited, F.col("v") + 1).otherwise(F.col("v")))
    parts = [F.col("id"), F.col("v").cast("string")]
    before, after = ingest.fingerprint(rows, cc.UNITS, parts), ingest.fingerprint(later, cc.UNITS, parts)
    changed = before.join(after, [*cc.UNITS, "fingerprint"], "left_anti")
    return changed.select(*cc.UNITS)


@register(
    "conflicting_inventory",
    "U4",
    "SELECT scenario, count(DISTINCT fingerprint) AS n_fingerprints FROM b_attempt GROUP BY scenario HAVING count(DISTINCT fingerprint) > 1",
)
def conflicting_inventory(spark, folder):
    """One path recorded with several hashes: distinct pairs first, conflicts counted over them."""
    pairs = cc.attempts(spark, folder).select("scenario", "fingerprint").dropDuplicates()
    return pairs.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_fingerprints")).where("n_fingerprints > 1")


@register(
    "manifest_resolution",
    "V10",
    """
SELECT cohort, scenario, n_completed, CASE WHEN n_completed = 0 THEN 'no_completed_row' ELSE 'ambiguous' END AS problem
FROM (SELECT cohort, scenario, count(*) FILTER (status = 'completed') AS n_completed FROM b_attempt GROUP BY ALL) WHERE n_completed <> 1""",
)
def manifest_resolution(spark, folder):
    """Exactly one completed row per (cohort, scenario)."""
    done = cc.attempts(spark, folder).groupBy(*cc.UNITS).agg(F.count_if(F.col("status") == "completed").alias("n_completed"))
    problem = F.when(F.col("n_completed") == 0, "no_completed_row").otherwise("ambiguous")
    return done.where("n_completed <> 1").withColumn("problem", problem)


@register(
    "producer_versions",
    "V11",
    "SELECT cohort, scenario, count(DISTINCT producer_version) AS n_versions FROM b_attempt GROUP BY ALL HAVING count(DISTINCT producer_version) > 1",
)
def producer_versions(spark, folder):
    versions = cc.attempts(spark, folder).select(*cc.UNITS, "producer_version").distinct()
    return versions.groupBy(*cc.UNITS).agg(F.count(F.lit(1)).alias("n_versions")).where("n_versions > 1")


@register(
    "population_differences",
    "V13",
    """
SELECT cohort, id, coalesce(p.y, -1) AS primary_y, coalesce(s.y, -1) AS scenario_y
FROM (SELECT * FROM b_variant WHERE variant = 'primary') p FULL JOIN (SELECT * FROM b_variant WHERE variant = 'stable_as_negative') s USING (cohort, id)
WHERE p.y IS DISTINCT FROM s.y""",
)
def population_differences(spark, folder):
    """Samples whose presence or label differs between a scenario and the primary population."""
    labels = b.label_variants(spark, folder).where(F.col("variant").isin("primary", "stable_as_negative"))
    side = lambda v: F.max(F.when(F.col("variant") == v, F.col("y")))
    wide = labels.groupBy("cohort", "id").agg(side("primary").alias("p"), side("stable_as_negative").alias("s"))
    return wide.where(~F.col("p").eqNullSafe(F.col("s"))).select(
        "cohort", "id", F.coalesce("p", F.lit(-1)).alias("primary_y"), F.coalesce("s", F.lit(-1)).alias("scenario_y")
    )


@register(
    "unfinished_units",
    "V14 V16",
    f"""
SELECT cohort, scenario FROM {cc.PLAN_SQL} p WHERE NOT EXISTS (SELECT 1 FROM b_attempt a WHERE a.cohort = p.cohort AND a.scenario = p.scenario AND status = 'completed' AND producer_version = 'v1'
  AND fingerprint = md5('source' || replace(a.scenario, 'scenario', '')))""",
)
def unfinished_units(spark, folder):
    """Planned units without a completed row whose source fingerprint is the current one."""
    current = F.md5(F.concat(F.lit("source"), F.replace("scenario", F.lit("scenario"), F.lit(""))))
    valid = cc.attempts(spark, folder).where(
        (F.col("status") == "completed") & (F.col("producer_version") == "v1") & F.col("fingerprint").eqNullSafe(current)
    )
    return cc.planned(spark, folder).join(valid, cc.UNITS, "left_anti")


@register(
    "stale_source_links",
    "V16",
    """
SELECT cohort, scenario, attempt FROM b_attempt WHERE status = 'completed' AND fingerprint IS DISTINCT FROM md5('source' || replace(scenario, 'scenario', ''))""",
)
def stale_source_links(spark, folder):
    """Receipts whose recorded source fingerprint is not that of the source they point to."""
    sources = cc.planned(spark, folder).select("scenario").distinct().withColumn(
        "current", F.md5(F.concat(F.lit("source"), F.replace("scenario", F.lit("scenario"), F.lit(""))))
    )
    done = cc.attempts(spark, folder).where(F.col("status") == "completed").join(sources, "scenario", "left")
    return done.where(~F.col("fingerprint").eqNullSafe(F.col("current"))).select(*cc.UNITS, "attempt")


SETTINGS = [("outer_splits", "5"), ("outer_repeats", "5"), ("test_share", "0.3"), ("seed", "42")]


@register(
    "setting_differences",
    "V15 S7",
    """
SELECT cohort, coalesce(e.setting, r.setting) AS setting, expected, recorded, CASE WHEN expected IS NULL THEN 'unexpected' WHEN recorded IS NULL THEN 'not_recorded' ELSE 'differs' END AS problem
FROM b_setting_expected e FULL JOIN b_setting_recorded r USING (cohort, setting) WHERE expected IS DISTINCT FROM recorded""",
    {
        "b_setting_expected": "SELECT cohort, setting, expected FROM (SELECT DISTINCT cohort FROM b_sample), (VALUES ('outer_splits', '5'), ('outer_repeats', '5'), ('test_share', '0.3'), ('seed', '42')) v(setting, expected)",
        "b_setting_recorded": """
SELECT cohort, 'outer_splits' AS setting, CAST(max(outer_fold) AS VARCHAR) AS recorded FROM b_fold GROUP BY cohort
UNION ALL SELECT cohort, 'outer_repeats', CAST(max(repeat) AS VARCHAR) FROM b_fold GROUP BY cohort
UNION ALL SELECT cohort, 'test_share', CAST(CAST(round(count(*) FILTER (subset = 'test') / CAST(count(*) AS DOUBLE), 3) AS DECIMAL(5,3)) AS VARCHAR) FROM b_hold WHERE split = 1 GROUP BY cohort""",
    },
)
def setting_differences(spark, folder):
    """Settings recovered from the saved tables against the expected ones, as key/value rows."""
    plan = b.folds(spark, folder).groupBy("cohort").agg(
        F.max("outer_fold").cast("string").alias("outer_splits"), F.max("repeat").cast("string").alias("outer_repeats")
    )
    share = b.holdout(spark, folder).where(F.col("split") == 1).groupBy("cohort").agg(
        F.round(F.count_if(F.col("subset") == "test") / F.count(F.lit(1)), 3).cast("decimal(5,3)").cast("string").alias("test_share")
    )
    recorded = plan.join(share, "cohort").unpivot("cohort", ["outer_splits", "outer_repeats", "test_share"], "setting", "recorded")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(v).alias("expected")) for k, v in SETTINGS])).alias("s")
    expected = b.samples(spark, folder).select("cohort").distinct().select("cohort", pairs).select("cohort", "s.*")
    joined = expected.join(recorded, ["cohort", "setting"], "full_outer")
    problem = F.when(F.col("expected").isNull(), "unexpected").when(F.col("recorded").isNull(), "not_recorded").otherwise("differs")
    return joined.where(~F.col("expected").eqNullSafe(F.col("recorded"))).withColumn("problem", problem)


@register(
    "duplicate_line_keys",
    "U5",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_line_keys(spark, folder):
    return checks.duplicate_keys(b.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "ranking_lookup_problems",
    "P22 U5",
    f"SELECT {FIT_SQL}, feature, count(*) AS n FROM b_rerank JOIN b_rank USING ({FIT_SQL}, feature) GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT {FIT_SQL}, feature, CAST(0 AS BIGINT) FROM b_rank WHERE rank > 24",
)
def ranking_lookup_problems(spark, folder):
    """A saved ranking must hold each feature once, with a rank inside 1..24."""
    ranks = cc.ranking(spark, folder)
    twice = checks.duplicate_keys(ranks, [*FIT, "feature"])
    return twice.unionByName(ranks.where("rank IS NULL OR rank > 24").select(*FIT, "feature", F.lit(0).cast("long").alias("n")))


@register(
    "column_contract",
    "P15",
    "SELECT method, count(*) AS n FROM b_pred WHERE scenario = 'primary' GROUP BY ALL",
)
def column_contract(spark, folder):
    """Required columns are checked on the schema, before any job runs."""
    rows = checks.require_columns(primary(spark, folder), ["id", "repeat", "outer_fold", "y_true", "p"])
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
