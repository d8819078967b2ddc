"""Queries over long prediction tables: OOF, discrimination, coordinates, calibration, bootstrap."""

from pyspark.sql import functions as F

from foldwise.catalog.oracle import CTES
from foldwise.catalog.registry import register
from foldwise.catalog.resampling import COUNTS
from foldwise.functions import scalars
from foldwise.operators import bootstrap, calibration, metrics, resample
from foldwise.session import settle
from foldwise.sources import bindings as b

GROUP = ["cohort", "scenario", "method"]


def rounded(df, *columns, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def metrics_sql(source: str, groups: str, score: str = "p") -> str:
    """Rank formulation of AUROC and per-positive formulation of average precision."""
    return f"""
SELECT {groups}, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positive, CAST(count(*) - sum(y_true) AS BIGINT) AS negative,
  (sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2.0e0) / nullif(CAST(sum(y_true) AS DOUBLE) * (count(*) - sum(y_true)), 0) AS roc_auc,
  CASE WHEN count(*) > sum(y_true) THEN sum(tp / cn) FILTER (y_true = 1) / nullif(sum(y_true), 0) END AS average_precision,
  avg(({score} - y_true) * ({score} - y_true)) AS brier
FROM (SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY {score}) + (count(*) OVER (PARTITION BY {groups}, {score}) - 1) / 2.0e0 AS r,
             CAST(sum(y_true) OVER (PARTITION BY {groups} ORDER BY {score} DESC) AS DOUBLE) AS tp,
             count(*) OVER (PARTITION BY {groups} ORDER BY {score} DESC) AS cn FROM {source})
GROUP BY {groups}"""


CTES["b_oof"] = """
SELECT cohort, scenario, method, id, min(y_true) AS y_true, round(avg(p), 12) AS p_oof,
       stddev_samp(p) AS p_oof_sd, count(*) AS oof_count FROM b_pred GROUP BY ALL"""
CTES["b_oof_metrics"] = metrics_sql("b_oof", "cohort, scenario, method", "p_oof")
CTES["b_repeat_metrics"] = metrics_sql("b_pred", "cohort, scenario, method, repeat")


def oof(spark, folder):
    return metrics.averaged_oof(b.predictions(spark, folder), GROUP)


@register(
    "averaged_oof",
    "A6",
    "SELECT cohort, scenario, method, id, y_true, p_oof, round(p_oof_sd, 8) AS p_oof_sd, oof_count FROM b_oof",
)
def averaged_oof(spark, folder):
    return rounded(oof(spark, folder), "p_oof_sd")


ROUND3 = "round(roc_auc, 8) AS roc_auc, round(average_precision, 8) AS average_precision, round(brier, 8) AS brier"
M3 = ["roc_auc", "average_precision", "brier"]


@register(
    "oof_discrimination",
    "A7 A8 A9",
    f"SELECT cohort, scenario, method, n, positive, negative, {ROUND3} FROM b_oof_metrics",
)
def oof_discrimination(spark, folder):
    return rounded(metrics.discrimination(oof(spark, folder), GROUP, "p_oof"), *M3)


@register(
    "repeat_metrics",
    "A10",
    f"SELECT cohort, scenario, method, repeat, n, positive, negative, {ROUND3} FROM b_repeat_metrics",
)
def repeat_metrics(spark, folder):
    return rounded(metrics.discrimination(b.predictions(spark, folder), [*GROUP, "repeat"]), *M3)


CTES["b_split_metrics"] = metrics_sql("(SELECT * FROM b_hold WHERE subset = 'test')", "cohort, split")


def split_table(spark, folder):
    test = b.holdout(spark, folder).where(F.col("subset") == "test")
    return metrics.discrimination(test, ["cohort", "split"])


@register("split_metrics", "A10", f"SELECT cohort, split, n, positive, negative, {ROUND3} FROM b_split_metrics")
def split_metrics(spark, folder):
    return rounded(split_table(spark, folder), *M3)


@register(
    "repeat_mean_sd",
    "A11",
    """
SELECT cohort, scenario, method, round(avg(roc_auc), 8) AS roc_auc_mean, round(stddev_samp(roc_auc), 8) AS roc_auc_sd,
  round(avg(average_precision), 8) AS average_precision_mean, round(stddev_samp(average_precision), 8) AS average_precision_sd,
  round(avg(brier), 8) AS brier_mean, round(stddev_samp(brier), 8) AS brier_sd
FROM b_repeat_metrics GROUP BY ALL""",
)
def repeat_mean_sd(spark, folder):
    table = metrics.discrimination(b.predictions(spark, folder), [*GROUP, "repeat"])
    return table.groupBy(*GROUP).agg(
        *[F.round(F.avg(m), 8).alias(f"{m}_mean") for m in M3],
        *[F.round(F.stddev_samp(m), 8).alias(f"{m}_sd") for m in M3],
    )


SPREAD = ["median", "q1", "q3", "iqr", "mean", "sd", "min", "max"]


def spread_sql(value: str) -> str:
    return f"""count({value}) AS n_values, round(quantile_cont({value}, 0.5), 8) AS median,
  round(quantile_cont({value}, 0.25), 8) AS q1, round(quantile_cont({value}, 0.75), 8) AS q3,
  round(quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25), 8) AS iqr, round(avg({value}), 8) AS mean,
  round(stddev_samp({value}), 8) AS sd, round(min({value}), 8) AS min, round(max({value}), 8) AS max"""


@register(
    "holdout_metric_dispersion",
    "A17",
    f"""
SELECT cohort, metric, {spread_sql("value")}
FROM (UNPIVOT b_split_metrics ON roc_auc, average_precision, brier INTO NAME metric VALUE value) GROUP BY ALL""",
)
def holdout_metric_dispersion(spark, folder):
    return rounded(metrics.metric_dispersion(split_table(spark, folder), ["cohort"], M3), *SPREAD)


@register(
    "average_ranks",
    "W1",
    """
SELECT cohort, scenario, method, repeat, p, count(*) AS ties, min(r) + (count(*) - 1) / 2.0e0 AS avg_rank
FROM (SELECT *, rank() OVER (PARTITION BY cohort, scenario, method, repeat ORDER BY p) AS r FROM b_pred) GROUP BY ALL""",
)
def average_ranks(spark, folder):
    return metrics.average_ranks(b.predictions(spark, folder), [*GROUP, "repeat"], "p")


ROC = {
    "b_steps": """
SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY cohort, scenario, method) AS last,
  sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY cohort, scenario, method) AS all_pos,
  sum(neg) OVER (PARTITION BY cohort, scenario, method) AS all_neg,
  lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
FROM (SELECT cohort, scenario, method, p_oof AS threshold, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM b_oof GROUP BY ALL)
WINDOW w AS (PARTITION BY cohort, scenario, method ORDER BY threshold DESC)"""
}


@register(
    "roc_coordinates",
    "W5",
    """
SELECT cohort, scenario, method, threshold, round(fp / CAST(all_neg AS DOUBLE), 8) AS fpr, round(tp / CAST(all_pos AS DOUBLE), 8) AS tpr
FROM b_steps WHERE i = 1 OR i = last OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT DISTINCT cohort, scenario, method, CAST(NULL AS DOUBLE), 0.0e0, 0.0e0 FROM b_oof""",
    ROC,
)
def roc_coordinates(spark, folder):
    return rounded(metrics.roc_points(oof(spark, folder), GROUP, "p_oof"), "fpr", "tpr").withColumnRenamed(
        "p_oof", "threshold"
    )


@register(
    "pr_coordinates",
    "W6",
    """
SELECT cohort, scenario, method, threshold, round(tp / CAST(tp + fp AS DOUBLE), 8) AS precision, round(tp / CAST(all_pos AS DOUBLE), 8) AS recall
FROM b_steps
UNION ALL SELECT DISTINCT cohort, scenario, method, CAST(NULL AS DOUBLE), 1.0e0, 0.0e0 FROM b_oof""",
    ROC,
)
def pr_coordinates(spark, folder):
    return rounded(metrics.pr_points(oof(spark, folder), GROUP, "p_oof"), "precision", "recall")


# Prior-adjusted scores and evaluation units -------------------------------------------------

CTES["b_counts"] = COUNTS["b_counts"]
CTES["b_hold_counts"] = """
SELECT cohort, split, count(*) FILTER (subset = 'train') AS train_n,
  CAST(sum(y_true) FILTER (subset = 'train') AS BIGINT) AS train_positive,
  CAST(sum(1 - y_true) FILTER (subset = 'train') AS BIGINT) AS train_negative,
  count(*) FILTER (subset = 'test') AS test_n,
  CAST(sum(y_true) FILTER (subset = 'test') AS BIGINT) AS test_positive,
  CAST(sum(1 - y_true) FILTER (subset = 'test') AS BIGINT) AS test_negative
FROM b_hold GROUP BY ALL"""
ADJ = "1 / (1 + exp(-(ln(p / (1 - p)) + ln(train_positive / CAST(train_negative AS DOUBLE)))))"
CTES["b_cv_adj"] = f"SELECT b_pred.*, train_n, train_positive, train_negative, {ADJ} AS p_prior_adjusted FROM b_pred JOIN b_counts USING (cohort, repeat, outer_fold)"
CTES["b_hold_adj"] = f"SELECT b_hold.*, train_n, train_positive, train_negative, {ADJ} AS p_prior_adjusted FROM b_hold JOIN b_hold_counts USING (cohort, split) WHERE subset = 'test'"
CTES["b_unit"] = """
SELECT cohort, method, unit_type, unit_id, id, y_true, probability_variant, p FROM (
  UNPIVOT (
    SELECT cohort, method, 'repeat' AS unit_type, CAST(repeat AS INTEGER) AS unit_id, id, y_true, p AS raw, p_prior_adjusted AS prior_adjusted
    FROM b_cv_adj WHERE scenario = 'primary'
    UNION ALL SELECT cohort, method, 'averaged_oof', 0, id, min(y_true), round(avg(p), 12), round(avg(p_prior_adjusted), 12)
    FROM b_cv_adj WHERE scenario = 'primary' GROUP BY cohort, method, id
    UNION ALL SELECT cohort, 'holdout', 'holdout_split', split, id, y_true, p, p_prior_adjusted FROM b_hold_adj)
  ON raw, prior_adjusted INTO NAME probability_variant VALUE p)"""
PRIMARY_SQL = "CASE WHEN method = 'holdout' THEN unit_type = 'holdout_split' AND unit_id = 1 ELSE unit_type = 'averaged_oof' END"
CTES["b_primary"] = f"SELECT * FROM b_unit WHERE {PRIMARY_SQL}"
UNIT = ["cohort", "method", "unit_type", "unit_id", "probability_variant"]


def cv_adjusted(spark, folder):
    counts = resample.fold_counts(b.folds(spark, folder), ["cohort", "repeat"], "outer_fold")
    return calibration.with_prior_adjustment(
        b.predictions(spark, folder), counts, ["cohort", "repeat", "outer_fold"]
    )


def split_counts(spark, folder):
    plan = b.holdout(spark, folder)
    per = resample.class_counts(plan, ["cohort", "split", "subset"], "y_true")
    side = lambda s, c: F.max(F.when(F.col("subset") == s, F.col(c))).alias(f"{s}_{c}")
    return per.groupBy("cohort", "split").agg(
        *[side(s, c) for s in ("train", "test") for c in ("n", "positive", "negative")]
    )


def holdout_adjusted(spark, folder):
    test = b.holdout(spark, folder).where(F.col("subset") == "test")
    return calibration.with_prior_adjustment(test, split_counts(spark, folder), ["cohort", "split"])


def all_units(spark, folder):
    cv = cv_adjusted(spark, folder).where(F.col("scenario") == "primary")
    hold = holdout_adjusted(spark, folder).withColumn("method", F.lit("holdout"))
    return calibration.evaluation_units(cv, hold, ["cohort"])


def units(spark, folder):
    return settle(all_units(spark, folder))


def primary_units(spark, folder):
    """Chosen before they are settled: the other units are several times their rows."""
    return settle(all_units(spark, folder).where(calibration.is_primary_unit()))


@register(
    "prior_adjusted_predictions",
    "J1 F5 F6",
    """
SELECT cohort, scenario, method, id, repeat, outer_fold, y_true, p, train_n, train_positive, train_negative,
  round(ln(p / (1 - p)), 8) AS logit_p, round(p_prior_adjusted, 8) AS p_prior_adjusted FROM b_cv_adj""",
)
def prior_adjusted_predictions(spark, folder):
    return cv_adjusted(spark, folder).select(
        *GROUP, "id", "repeat", "outer_fold", "y_true", "p", "train_n", "train_positive", "train_negative",
        F.round(scalars.logit("p"), 8).alias("logit_p"),
        F.round("p_prior_adjusted", 8).alias("p_prior_adjusted"),
    )


@register(
    "prior_join_problems",
    "J1",
    """
SELECT cohort, scenario, method, count(*) AS rows_n,
  count(*) FILTER (train_n IS NULL) AS unmatched, count(*) FILTER (train_n <> train_positive + train_negative) AS bad_counts,
  count(*) - count(DISTINCT (id, repeat)) AS duplicate_rows
FROM b_cv_adj GROUP BY ALL""",
)
def prior_join_problems(spark, folder):
    """Many-to-one join guard: unmatched rows, inconsistent counts, duplicated predictions."""
    per_key = cv_adjusted(spark, folder).groupBy(*GROUP, "id", "repeat").agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col("train_n").isNull()).alias("u"),
        F.count_if(F.col("train_n") != F.col("train_positive") + F.col("train_negative")).alias("bad"),
    )
    return per_key.groupBy(*GROUP).agg(
        F.sum("c").alias("rows_n"),
        F.sum("u").alias("unmatched"),
        F.sum("bad").alias("bad_counts"),
        (F.sum("c") - F.count(F.lit(1))).alias("duplicate_rows"),
    )


@register(
    "holdout_prior_join",
    "J2",
    """
SELECT cohort, id, split, y_true, p, train_positive + CAST(conflict AS BIGINT) AS train_positive, train_negative, round(p_prior_adjusted, 8) AS p_prior_adjusted,
  conflict AS count_conflict FROM (SELECT *, substr(md5('counts' || split || id), 1, 2) = '00' AS conflict FROM b_hold_adj)""",
)
def holdout_prior_join(spark, folder):
    """Predictions that carry their own training counts, some wrong by hash, meet the parameter table's counts."""
    counts = settle(split_counts(spark, folder))
    saved = (
        b.holdout(spark, folder)
        .where(F.col("subset") == "test")
        .join(F.broadcast(counts.select("cohort", "split", "train_positive", "train_negative")), ["cohort", "split"])
    )
    wrong = F.substring(F.md5(F.concat(F.lit("counts"), F.col("split").cast("string"), "id")), 1, 2) == "00"
    saved = saved.withColumn("train_positive", F.col("train_positive") + wrong.cast("bigint"))
    params = counts.select(
        "cohort", "split", "train_n", *[F.col(c).alias(f"{c}_parameter") for c in ("train_positive", "train_negative")]
    )
    joined = saved.join(F.broadcast(params), ["cohort", "split"], "left")
    same = F.col("train_positive").eqNullSafe(F.col("train_positive_parameter")) & F.col(
        "train_negative"
    ).eqNullSafe(F.col("train_negative_parameter"))
    adjusted = scalars.prior_adjusted("p", "train_positive_parameter", "train_negative_parameter")
    return joined.select(
        "cohort", "id", "split", "y_true", "p", "train_positive", "train_negative",
        F.round(adjusted, 8).alias("p_prior_adjusted"), (~same).alias("count_conflict"),
    )


@register(
    "fold_count_reconciliation",
    "J3",
    """
SELECT c.cohort, method, c.repeat, c.outer_fold, observed_n, test_n, observed_positive, test_positive,
  observed_n = test_n AND observed_positive = test_positive AND observed_n - observed_positive = test_negative
    AND train_n + test_n = cohort_n AS consistent
FROM (SELECT cohort, method, repeat, outer_fold, count(*) AS observed_n, CAST(sum(y_true) AS BIGINT) AS observed_positive
      FROM b_pred WHERE scenario = 'primary' AND substr(md5('lost' || method || repeat || id), 1, 2) <> '00' GROUP BY ALL) o
JOIN b_counts c USING (cohort, repeat, outer_fold)
JOIN (SELECT cohort, count(*) AS cohort_n FROM b_sample GROUP BY 1) USING (cohort)""",
)
def fold_count_reconciliation(spark, folder):
    """Saved predictions, some lost by hash, counted against the fold plan."""
    lost = F.substring(F.md5(F.concat(F.lit("lost"), "method", F.col("repeat").cast("string"), "id")), 1, 2) == "00"
    counts = resample.fold_counts(b.folds(spark, folder), ["cohort", "repeat"], "outer_fold")
    sizes = b.samples(spark, folder).groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_n"))
    observed = (
        b.predictions(spark, folder)
        .where((F.col("scenario") == "primary") & ~lost)
        .groupBy("cohort", "method", "repeat", "outer_fold")
        .agg(F.count(F.lit(1)).alias("observed_n"), F.sum("y_true").cast("long").alias("observed_positive"))
    )
    consistent = (
        (F.col("observed_n") == F.col("test_n"))
        & (F.col("observed_positive") == F.col("test_positive"))
        & (F.col("observed_n") - F.col("observed_positive") == F.col("test_negative"))
        & (F.col("train_n") + F.col("test_n") == F.col("cohort_n"))
    )
    return observed.join(counts, ["cohort", "repeat", "outer_fold"]).join(sizes, "cohort").select(
        "cohort", "method", "repeat", "outer_fold", "observed_n", "test_n", "observed_positive", "test_positive",
        consistent.alias("consistent"),
    )


@register(
    "evaluation_units",
    "M22 P17",
    f"SELECT cohort, method, unit_type, unit_id, probability_variant, id, y_true, round(p, 8) AS p, {PRIMARY_SQL} AS is_primary_unit FROM b_unit",
)
def evaluation_units(spark, folder):
    return rounded(units(spark, folder).withColumn("is_primary_unit", calibration.is_primary_unit()), "p")


@register(
    "prediction_qc",
    "A22 P14",
    """
SELECT cohort, method, unit_type, unit_id, probability_variant, count(*) AS n, count(DISTINCT id) AS unique_ids,
  count(*) - count(DISTINCT id) AS duplicate_id_count, round(min(p), 8) AS probability_min, round(max(p), 8) AS probability_max,
  bool_and(isfinite(p)) AS finite_probability, count(*) FILTER (NOT (p > 0 AND p < 1)) AS outside_open_interval,
  min(y_true) = 0 AND max(y_true) = 1 AS both_classes
FROM b_unit GROUP BY ALL""",
)
def prediction_qc(spark, folder):
    """Counted per id first, so that the distinct count needs no set per unit."""
    per_id = units(spark, folder).groupBy(*UNIT, "id").agg(
        F.count(F.lit(1)).alias("c"),
        F.min("p").alias("lo"),
        F.max("p").alias("hi"),
        F.bool_and(scalars.finite("p")).alias("fin"),
        F.count_if(~scalars.is_strict_probability("p")).alias("out"),
        F.min("y_true").alias("y0"),
        F.max("y_true").alias("y1"),
    )
    return per_id.groupBy(*UNIT).agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("unique_ids"),
        (F.sum("c") - F.count(F.lit(1))).alias("duplicate_id_count"),
        F.round(F.min("lo"), 8).alias("probability_min"),
        F.round(F.max("hi"), 8).alias("probability_max"),
        F.bool_and("fin").alias("finite_probability"),
        F.sum("out").alias("outside_open_interval"),
        ((F.min("y0") == 0) & (F.max("y1") == 1)).alias("both_classes"),
    )


CTES["b_bins"] = f"""
SELECT cohort, method, probability_variant, CAST(row_number() OVER (PARTITION BY cohort, method, probability_variant ORDER BY raw_bin) AS INTEGER) AS bin,
  n, n_positive, predicted_mean, n_positive / CAST(n AS DOUBLE) AS observed_rate, predicted_min, predicted_max,
  greatest(0, (r + z * z / (2 * n) - z * sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n)) AS observed_rate_wilson95_low,
  least(1, (r + z * z / (2 * n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n)) AS observed_rate_wilson95_high
  FROM (SELECT cohort, method, probability_variant, raw_bin, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS n_positive, avg(p) AS predicted_mean,
      min(p) AS predicted_min, max(p) AS predicted_max, {scalars.Z95}e0 AS z, CAST(sum(y_true) AS DOUBLE) / count(*) AS r
    FROM (SELECT u.*, greatest(1, len(list_filter(edges, lambda e: e < p))) AS raw_bin FROM b_primary u JOIN (
        SELECT cohort, method, probability_variant, list_distinct(list_transform(range(0, q + 1), lambda j:
            ps[1 + ((n - 1) * j) // q] + (ps[least(n, 2 + ((n - 1) * j) // q)] - ps[1 + ((n - 1) * j) // q]) * (((n - 1) * j) % q / CAST(q AS DOUBLE)))) AS edges
        FROM (SELECT cohort, method, probability_variant, list(p ORDER BY p) AS ps, count(*) AS n, least(10, count(*), count(DISTINCT p)) AS q
              FROM b_primary GROUP BY ALL)) USING (cohort, method, probability_variant))
    GROUP BY ALL)"""


@register(
    "calibration_bins",
    "W7 F7",
    """
SELECT cohort, method, probability_variant, bin, n, n_positive, round(predicted_mean, 8) AS predicted_mean, round(observed_rate, 8) AS observed_rate,
  round(predicted_min, 8) AS predicted_min, round(predicted_max, 8) AS predicted_max,
  round(observed_rate_wilson95_low, 8) AS observed_rate_wilson95_low, round(observed_rate_wilson95_high, 8) AS observed_rate_wilson95_high
FROM b_bins""",
)
def calibration_bins(spark, folder):
    bins = calibration.calibration_bins(primary_units(spark, folder), ["cohort", "method", "probability_variant"])
    return rounded(
        bins, "predicted_mean", "observed_rate", "predicted_min", "predicted_max",
        "observed_rate_wilson95_low", "observed_rate_wilson95_high",
    )


# Recalibration fits ---------------------------------------------------------------------------

NEWTON_ROUNDS = 14


def newton_ctes(prefix: str, source: str, keys: str, weight: str = "1") -> dict[str, str]:
    """The Newton iterations unrolled as CTEs over class counts per distinct score."""
    on = f"USING ({keys})"
    ctes = {
        f"{prefix}_z": f"SELECT {keys}, ln(p / (1 - p)) AS z, CAST(sum({weight} * y_true) AS DOUBLE) AS pos, CAST(sum({weight} * (1 - y_true)) AS DOUBLE) AS neg FROM {source} GROUP BY {keys}, z",
        f"{prefix}_0": f"""
SELECT {keys}, 0.0e0 AS a0, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN ln(sum(pos) / sum(neg)) ELSE 0 END AS a, 0.0e0 AS b,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN 'ok' ELSE 'both_classes_required' END AS s1,
  CASE WHEN NOT (sum(pos) > 0 AND sum(neg) > 0) THEN 'both_classes_required'
       WHEN max(z) - min(z) <= 1e-12 THEN 'nonidentifiable_constant_logit'
       WHEN max(z) FILTER (neg > 0) <= min(z) FILTER (pos > 0) OR max(z) FILTER (pos > 0) <= min(z) FILTER (neg > 0)
       THEN 'nonidentifiable_complete_or_quasi_separation' ELSE 'ok' END AS s2
FROM {prefix}_z GROUP BY {keys}""",
    }
    for i in range(1, NEWTON_ROUNDS + 1):
        ctes[f"{prefix}_{i}"] = f"""
SELECT {keys}, a0 - CASE WHEN s1 = 'ok' THEN s / h ELSE 0 END AS a0,
  a - CASE WHEN s2 = 'ok' AND abs(a) <= 50 AND abs(b) <= 50 THEN (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) ELSE 0 END AS a,
  b - CASE WHEN s2 = 'ok' AND abs(a) <= 50 AND abs(b) <= 50 THEN (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) ELSE 0 END AS b, s1, s2
FROM (SELECT {keys}, any_value(a0) AS a0, any_value(a) AS a, any_value(b) AS b, any_value(s1) AS s1, any_value(s2) AS s2,
    sum(m * q0 - pos) AS s, sum(m * q0 * (1 - q0)) AS h, sum(m * q - pos) AS g0, sum((m * q - pos) * z) AS g1,
    sum(m * q * (1 - q)) AS h00, sum(m * q * (1 - q) * z) AS h01, sum(m * q * (1 - q) * z * z) AS h11
  FROM (SELECT *, pos + neg AS m, 1 / (1 + exp(-(a0 + z))) AS q0, 1 / (1 + exp(-(a + b * z))) AS q
        FROM {prefix}_z JOIN {prefix}_{i - 1} {on})
  GROUP BY {keys})"""
    bound = "abs(a) >= 25 - 1e-5 OR abs(b) >= 25 - 1e-5"
    ctes[f"{prefix}_fit"] = f"""
SELECT {keys}, a0, a, b, s1, CASE WHEN s2 = 'ok' AND ({bound}) THEN 'fit_failed:parameter_bound_reached' ELSE s2 END AS s2
FROM {prefix}_{NEWTON_ROUNDS}"""
    return ctes


UNIT_SQL = "cohort, method, unit_type, unit_id, probability_variant"
CTES.update(newton_ctes("b_recal", "b_unit", UNIT_SQL))
CTES["b_unit_metrics"] = metrics_sql("b_unit", UNIT_SQL)
CTES["b_calibration"] = f"""
SELECT m.*, event_rate, mean_predicted_probability, CASE WHEN s1 = 'ok' THEN a0 END AS calibration_intercept,
  CASE WHEN s2 = 'ok' THEN b END AS calibration_slope, CASE WHEN s2 = 'ok' THEN a END AS recalibration_intercept_free,
  s1 AS calibration_intercept_status, s2 AS calibration_slope_status, s1 = 'ok' AND s2 = 'ok' AS calibration_fit_ok
FROM b_unit_metrics m JOIN (SELECT {UNIT_SQL}, avg(y_true) AS event_rate, avg(p) AS mean_predicted_probability FROM b_unit GROUP BY ALL) USING ({UNIT_SQL})
JOIN b_recal_fit USING ({UNIT_SQL})"""
FITTED = ["calibration_intercept", "calibration_slope", "recalibration_intercept_free"]
MEANS = ["event_rate", "mean_predicted_probability"]


@register(
    "recalibration_fits",
    "M7",
    f"""
SELECT {UNIT_SQL}, {", ".join(f"round({c}, 6) AS {c}" for c in FITTED)}, calibration_intercept_status, calibration_slope_status
FROM b_calibration""",
)
def recalibration_fits(spark, folder):
    return rounded(calibration.recalibration(units(spark, folder), UNIT), *FITTED, digits=6)


@register(
    "calibration_metrics",
    "M8",
    f"""
SELECT {UNIT_SQL}, n, positive, negative, {ROUND3}, {", ".join(f"round({c}, 8) AS {c}" for c in MEANS)},
  {", ".join(f"round({c}, 6) AS {c}" for c in FITTED)}, calibration_intercept_status, calibration_slope_status, calibration_fit_ok
FROM b_calibration WHERE {PRIMARY_SQL}""",
)
def calibration_metrics(spark, folder):
    table = calibration.calibration_metrics(primary_units(spark, folder), UNIT)
    return rounded(rounded(table, *M3, *MEANS), *FITTED, digits=6)


GROUP_METRICS = ["roc_auc", "average_precision", "brier", "calibration_intercept", "calibration_slope", *MEANS]


@register(
    "calibration_group_summary",
    "A18 P16",
    f"""
SELECT source_group, method, probability_variant, metric, count(*) AS n_datasets, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM (SELECT *, CASE WHEN cohort IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'primary_cohorts' ELSE 'descriptive' END AS source_group
      FROM (UNPIVOT b_calibration ON {", ".join(GROUP_METRICS)} INTO NAME metric VALUE value) WHERE {PRIMARY_SQL})
GROUP BY ALL""",
)
def calibration_group_summary(spark, folder):
    table = calibration.calibration_metrics(primary_units(spark, folder), UNIT)
    group = F.when(F.col("cohort").isin("AUTOMOBILE", "BUILDING", "FURNITURE"), "primary_cohorts").otherwise(
        "descriptive"
    )
    keys = ["source_group", "method", "probability_variant"]
    long = table.withColumn("source_group", group).unpivot(keys, GROUP_METRICS, "metric", "value")
    summary = metrics.dispersion(long.where(scalars.finite("value")), [*keys, "metric"], "value")
    return rounded(
        summary.withColumnRenamed("n_values", "n_datasets").drop("mean", "sd"),
        "median", "q1", "q3", "iqr", "min", "max", digits=6,
    )


# Bootstrap ------------------------------------------------------------------------------------


def draw_sql(source: str, strata: str, key: str, draws: int, keep: str) -> str:
    """Resampled rows, one per draw position: the plain formulation without weights."""
    part = f"{strata}, " if strata else ""
    label = f"{strata} || '|' || " if strata else ""
    return f"""
SELECT pick.cohort, draw, {keep}
FROM (SELECT cohort, {part}c * 2 + i + 1 AS draw, ('0x' || substr(h, 1 + 16 * i, 15))::BIGINT % n + 1 AS rn
      FROM (SELECT *, md5('{key}|' || {label}c || '|' || rn) AS h FROM b_{key}_base CROSS JOIN (SELECT unnest(range(0, {(draws + 1) // 2})) AS c))
      CROSS JOIN (SELECT unnest(range(0, 2)) AS i)) pick
JOIN b_{key}_base base ON pick.cohort = base.cohort AND pick.rn = base.rn {f"AND pick.{strata} = base.{strata}" if strata else ""}
WHERE draw <= {draws}"""


B = resample.BOOTSTRAP_DRAWS
CTES["b_pair"] = """
SELECT cohort, id, n.y_true, n.p_oof AS nested, m.p_oof AS non_nested
FROM (SELECT * FROM b_oof WHERE scenario = 'primary' AND method = 'nested') n
JOIN (SELECT cohort, id, p_oof FROM b_oof WHERE scenario = 'primary' AND method = 'non_nested') m USING (cohort, id)"""
CTES["b_boot_base"] = """
SELECT *, row_number() OVER (PARTITION BY cohort, y_true ORDER BY md5('boot|' || id), id) AS rn,
       count(*) OVER (PARTITION BY cohort, y_true) AS n FROM b_pair"""
CTES["b_boot"] = draw_sql("b_pair", "y_true", "boot", B, "base.y_true, nested, non_nested")


def auc_sql(source: str, groups: str, score: str) -> str:
    return f"""
SELECT {groups}, (sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2.0e0) / (CAST(sum(y_true) AS DOUBLE) * (count(*) - sum(y_true))) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY {score}) + (count(*) OVER (PARTITION BY {groups}, {score}) - 1) / 2.0e0 AS r FROM {source})
GROUP BY {groups}"""


CTES["b_boot_a"] = auc_sql("b_boot", "cohort, draw", "nested")
CTES["b_boot_b"] = auc_sql("b_boot", "cohort, draw", "non_nested")


def paired(spark, folder):
    return (
        oof(spark, folder)
        .where(F.col("scenario") == "primary")
        .groupBy("cohort", "id")
        .agg(
            F.min("y_true").alias("y_true"),
            *[F.max(F.when(F.col("method") == m, F.col("p_oof"))).alias(m) for m in ("nested", "non_nested")],
        )
    )


@register(
    "auc_bootstrap",
    "R5",
    """
SELECT cohort, count(*) AS draws, round(quantile_cont(auc, 0.025), 8) AS auc_ci95_lo, round(quantile_cont(auc, 0.975), 8) AS auc_ci95_hi
FROM b_boot_a GROUP BY cohort""",
)
def auc_bootstrap(spark, folder):
    nested = paired(spark, folder)
    return rounded(bootstrap.auc_interval(nested, ["cohort"], "nested"), "auc_ci95_lo", "auc_ci95_hi")


CTES["b_boot_ci"] = """
SELECT cohort, round(quantile_cont(a.auc, 0.025), 8) AS auc_a_ci95_lo, round(quantile_cont(a.auc, 0.975), 8) AS auc_a_ci95_hi,
  round(quantile_cont(b.auc, 0.025), 8) AS auc_b_ci95_lo, round(quantile_cont(b.auc, 0.975), 8) AS auc_b_ci95_hi,
  round(quantile_cont(b.auc - a.auc, 0.025), 8) AS delta_ci95_lo, round(quantile_cont(b.auc - a.auc, 0.975), 8) AS delta_ci95_hi
FROM b_boot_a a JOIN b_boot_b b USING (cohort, draw) GROUP BY cohort"""


@register("paired_auc_bootstrap", "R6", "SELECT * FROM b_boot_ci")
def paired_auc_bootstrap(spark, folder):
    table = bootstrap.paired_auc_interval(paired(spark, folder), ["cohort"], "nested", "non_nested")
    return rounded(table, *[c for c in table.columns if c != "cohort"])


CTES["b_ordinary_base"] = """
SELECT cohort, id, y_true, nested AS p, row_number() OVER (PARTITION BY cohort ORDER BY md5('ordinary|' || id), id) AS rn,
       count(*) OVER (PARTITION BY cohort) AS n FROM b_pair"""
CTES["b_ordinary"] = draw_sql("b_pair", "", "ordinary", B, "base.y_true, p")
CTES["b_draw_metrics"] = metrics_sql("b_ordinary", "cohort, draw")
CTES.update(newton_ctes("b_draw", "b_ordinary", "cohort, draw"))
CTES["b_draw_all"] = f"""
SELECT cohort, draw, positive, negative, roc_auc, average_precision, brier, event_rate, mean_predicted_probability,
  CASE WHEN s1 = 'ok' THEN a0 END AS calibration_intercept, CASE WHEN s2 = 'ok' THEN b END AS calibration_slope
FROM b_draw_metrics JOIN (SELECT cohort, draw, avg(y_true) AS event_rate, avg(p) AS mean_predicted_probability FROM b_ordinary GROUP BY ALL) USING (cohort, draw)
JOIN b_draw_fit USING (cohort, draw)"""
CTES["b_draw_ci"] = f"""
SELECT cohort, metric, count(*) AS bootstrap_target, CAST(sum(CASE WHEN positive > 0 AND negative > 0 THEN 1 ELSE 0 END) AS BIGINT) AS draws_with_both_classes,
  count(value) AS bootstrap_success, round(quantile_cont(value, 0.025), 6) AS ci95_lo, round(quantile_cont(value, 0.975), 6) AS ci95_hi
FROM (FROM b_draw_all UNPIVOT INCLUDE NULLS (value FOR metric IN ( {", ".join(bootstrap.SUMMARY_METRICS)}))) GROUP BY cohort, metric"""


@register("metric_bootstrap", "R7", "SELECT * FROM b_draw_ci")
def metric_bootstrap(spark, folder):
    draws = bootstrap.metric_draws(paired(spark, folder).withColumnRenamed("nested", "p"), ["cohort"], "p")
    return rounded(bootstrap.metric_intervals(draws, ["cohort"]), "ci95_lo", "ci95_hi", digits=6)


@register(
    "bootstrap_success_warnings",
    "R7",
    """
SELECT cohort, 'low_' || metric || '_bootstrap_success' AS issue, bootstrap_success AS successful FROM b_draw_ci WHERE bootstrap_success < 2000
UNION ALL SELECT cohort, 'low_roc_auc_bootstrap_success', bootstrap_success FROM b_draw_ci WHERE metric = 'roc_auc' AND bootstrap_success >= 2000""",
)
def bootstrap_success_warnings(spark, folder):
    """Warning rows at a requirement no unit can meet for AUROC, at the full target elsewhere."""
    draws = bootstrap.metric_draws(paired(spark, folder).withColumnRenamed("nested", "p"), ["cohort"], "p")
    intervals = bootstrap.metric_intervals(draws, ["cohort"])
    strict = bootstrap.low_success(intervals.where("metric = 'roc_auc'"), ["cohort"], B + 1)
    return strict.unionByName(bootstrap.low_success(intervals.where("metric <> 'roc_auc'"), ["cohort"], B))


# The fixed holdout split of small cohorts with a rare label: some test sets have hardly a positive row.
CTES["b_source_sample"] = "SELECT source AS cohort, CAST(doc_id AS VARCHAR) AS id, toxic AS y FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND toxic IS NOT NULL"
CTES["b_source_hold"] = CTES["b_hold"].replace("b_sample", "b_source_sample")
CTES["b_fixed_base"] = """
SELECT cohort, id, y_true, p, row_number() OVER (PARTITION BY cohort, y_true ORDER BY md5('boot|' || id), id) AS rn,
       count(*) OVER (PARTITION BY cohort, y_true) AS n FROM b_source_hold WHERE split_role = 'fixed' AND subset = 'test'"""
CTES["b_fixed_draw"] = draw_sql("", "y_true", "boot", B, "base.y_true, p").replace("b_boot_base", "b_fixed_base")
CTES["b_fixed_auc"] = auc_sql("b_fixed_draw", "cohort, draw", "p")


@register(
    "fixed_holdout_intervals",
    "R8 R5",
    """
SELECT cohort, n, positive, negative, CASE WHEN least(positive, negative) < 2 THEN 'withheld' ELSE 'reported' END AS interval_status,
  CASE WHEN least(positive, negative) < 2 THEN 0 ELSE draws END AS draws,
  CASE WHEN least(positive, negative) >= 2 THEN lo END AS auc_ci95_lo, CASE WHEN least(positive, negative) >= 2 THEN hi END AS auc_ci95_hi,
  CASE WHEN least(positive, negative) < 2 THEN 'minority_below_2' END AS warning
FROM (SELECT cohort, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positive, CAST(count(*) - sum(y_true) AS BIGINT) AS negative FROM b_fixed_base GROUP BY cohort)
LEFT JOIN (SELECT cohort, count(*) AS draws, round(quantile_cont(auc, 0.025), 8) AS lo, round(quantile_cont(auc, 0.975), 8) AS hi FROM b_fixed_auc GROUP BY cohort) USING (cohort)""",
)
def fixed_holdout_intervals(spark, folder):
    """AUROC interval of the fixed split's test set per source; withheld where a class has fewer than two rows."""
    rows = b.holdout_of(b.source_samples(spark, folder))
    fixed = rows.where((F.col("split_role") == "fixed") & (F.col("subset") == "test"))
    return rounded(bootstrap.guarded_auc_interval(fixed, ["cohort"], "p"), "auc_ci95_lo", "auc_ci95_hi")
