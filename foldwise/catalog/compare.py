"""Queries over choices, rankings, stability, method and scenario comparisons, exact tests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.catalog import metrics as cm
from foldwise.catalog.oracle import CTES, uniform
from foldwise.catalog.registry import register
from foldwise.catalog.resampling import INNER
from foldwise.functions import scalars
from foldwise.operators import compare, inference, metrics, ordered, resample, selection, stability
from foldwise.plans.design import EN_C_GRID, EN_L1_GRID, L2_C_GRID, MAX_K
from foldwise.sources import bindings as b
from foldwise.session import settle
from foldwise.sources import tuning

rounded = cm.rounded
FIT, RESAMPLE = tuning.FIT, tuning.RESAMPLE
KEY = "cohort || '|' || repeat || '|' || outer_fold || '|' || inner_repeat || '|' || inner_fold"
RES_SQL = "cohort, repeat, outer_fold, inner_repeat, inner_fold"
FIT_SQL = "cohort, repeat, outer_fold"


def grid_sql(values):
    return "(VALUES " + ", ".join(f"({i + 1}, {float(v)!r}::DOUBLE)" for i, v in enumerate(values)) + ")"


CTES.update(INNER)
CTES["b_resample"] = f"""SELECT {RES_SQL}, round(avg({uniform("'base|' || id")}), 6) AS base FROM b_inner GROUP BY ALL"""
CTES["b_auc"] = f"""
SELECT {RES_SQL}, c.v AS "C", l.v AS l1_ratio, round(0.5e0 + 0.2e0 * base + 0.2e0 * {uniform(f"'auc|' || {KEY} || '|' || c.i || '|' || l.i")}, 3) AS auc
FROM b_resample, {grid_sql(EN_C_GRID)} c(i, v), {grid_sql(EN_L1_GRID)} l(i, v)"""
CTES["b_kauc"] = f"""
SELECT {RES_SQL}, CAST(k AS INTEGER) AS k, c.v AS "C", round(0.5e0 + 0.2e0 * base + 0.2e0 * {uniform(f"'kauc|' || {KEY} || '|' || k || '|' || c.i")}, 3) AS auc
FROM b_resample, (SELECT unnest(range(1, {MAX_K + 1})) AS k), {grid_sql(L2_C_GRID)} c(i, v)"""
CTES["b_universe"] = "SELECT cohort, feature FROM (SELECT DISTINCT cohort FROM b_sample), (SELECT 'v' || unnest(range(1, 26)) AS feature)"
CTES["b_coef"] = f"""
SELECT {RES_SQL}, feature, CASE WHEN u < 0.1e0 THEN NULL WHEN u < 0.2e0 + 0.6e0 * {uniform("'strength|' || feature")} THEN 0 ELSE round(u - 0.5e0 + base * 0.1e0, 4) END AS coef
FROM (SELECT *, {uniform(f"'coef|' || {KEY} || '|' || feature")} AS u FROM b_resample JOIN b_universe USING (cohort))"""


def scores_sql(source, grid):
    return f"""
SELECT {FIT_SQL}, {grid}, round(avg(m), 12) AS mean_auc, round(stddev_samp(m), 12) AS sd_repeat_mean_auc, count(*) AS n_inner_repeats, CAST(sum(folds) AS BIGINT) AS n_inner_evaluations
FROM (SELECT {FIT_SQL}, {grid}, inner_repeat, avg(auc) AS m, count(*) AS folds FROM {source} GROUP BY ALL) GROUP BY {FIT_SQL}, {grid}"""


CTES["b_grid"] = scores_sql("b_auc", '"C", l1_ratio')
CTES["b_best"] = f"""SELECT {FIT_SQL}, "C", l1_ratio, mean_auc FROM b_grid QUALIFY row_number() OVER (PARTITION BY {FIT_SQL} ORDER BY mean_auc DESC, "C", l1_ratio) = 1"""
CTES["b_kgrid"] = scores_sql("b_kauc", 'k, "C"')
CTES["b_curve"] = f"""
SELECT {FIT_SQL}, k, "C" AS "best_C", mean_auc, CASE WHEN n_inner_repeats > 1 THEN sd_repeat_mean_auc ELSE 0 END AS sd_repeat_mean_auc,
  round(CASE WHEN n_inner_repeats > 1 THEN sd_repeat_mean_auc ELSE 0 END / sqrt(n_inner_repeats), 12) AS se_auc
FROM b_kgrid QUALIFY row_number() OVER (PARTITION BY {FIT_SQL}, k ORDER BY mean_auc DESC, "C") = 1"""
CTES["b_choice"] = f"""
SELECT {FIT_SQL}, k AS k_selected, "best_C" AS "l2_C", mean_auc, threshold FROM (
  SELECT *, round(first_value(mean_auc) OVER w - first_value(se_auc) OVER w, 12) AS threshold FROM b_curve
  WINDOW w AS (PARTITION BY {FIT_SQL} ORDER BY mean_auc DESC, k))
WHERE mean_auc >= threshold QUALIFY row_number() OVER (PARTITION BY {FIT_SQL} ORDER BY k) = 1"""
CTES["b_stability"] = f"""
SELECT {FIT_SQL}, feature, count(coef) / 15.0e0 AS eligible_freq, count(*) FILTER (coef <> 0) / 15.0e0 AS nonzero_freq,
  round(coalesce(sum(abs(coef)), 0) / 15.0e0, 12) AS mean_abs_coef, round(coalesce(sum(coef), 0) / 15.0e0, 12) AS mean_signed_coef
FROM b_coef GROUP BY ALL HAVING count(coef) > 0"""
CTES["b_rank"] = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY {FIT_SQL} ORDER BY nonzero_freq DESC, mean_abs_coef DESC, feature) AS INTEGER) AS rank FROM b_stability"""
CTES["b_final"] = f"""
SELECT {FIT_SQL}, feature, round(u - 0.6e0, 4) AS coef FROM (
  SELECT {FIT_SQL}, feature, {uniform("'final|' || cohort || '|' || repeat || '|' || outer_fold || '|' || feature")} AS u
  FROM b_rank JOIN b_choice USING ({FIT_SQL}) WHERE rank <= k_selected) WHERE u >= 0.1e0"""
CTES["b_ffit"] = f"""
SELECT {FIT_SQL}, feature, rank, coalesce(eligible_freq, 0) AS eligible_freq, coalesce(nonzero_freq, 0) AS nonzero_freq,
  coalesce(rank <= k_selected, FALSE) AS selected, coef IS NOT NULL AS used, coef
FROM b_universe JOIN b_choice USING (cohort) LEFT JOIN b_rank USING ({FIT_SQL}, feature) LEFT JOIN b_final USING ({FIT_SQL}, feature)"""


# Several of these in one query share its inner resamples, ``base``.


def grid_table(spark, folder, base=None):
    return selection.grid_scores(tuning.grid_aucs(spark, folder, base), FIT, ["C", "l1_ratio"])


def curve(spark, folder, base=None):
    return selection.best_c_per_k(selection.grid_scores(tuning.k_aucs(spark, folder, base), FIT, ["k", "C"]), FIT)


def choice(spark, folder, base=None):
    return selection.one_standard_error(curve(spark, folder, base), FIT)


def ranking(spark, folder, base=None):
    stable = selection.stability_table(
        tuning.coefficients(spark, folder, base), FIT, resample.INNER_SPLITS * resample.INNER_REPEATS
    )
    return selection.rank_features(stable, FIT)


def selected(spark, folder, base=None):
    base = tuning.resamples(spark, folder) if base is None else base
    return selection.top_k(ranking(spark, folder, base), choice(spark, folder, base), FIT)


def feature_table(spark, folder):
    # Settled: the top features, their coefficients and the full table all read both.
    base = tuning.resamples(spark, folder)
    ranks, chosen = settle(ranking(spark, folder, base)), settle(choice(spark, folder, base))
    final = tuning.final_coefficients(spark, folder, selection.top_k(ranks, chosen, FIT))
    return selection.feature_by_fit(tuning.features(spark, folder), chosen, ranks, final, FIT)


ROUND_FIELDS = "round(eligible_freq, 8) AS eligible_freq, round(nonzero_freq, 8) AS nonzero_freq"


@register("grid_scores", "A26 O3", f'SELECT {FIT_SQL}, "C", l1_ratio, round(mean_auc, 8) AS mean_auc, round(sd_repeat_mean_auc, 8) AS sd_repeat_mean_auc, n_inner_repeats, n_inner_evaluations FROM b_grid ORDER BY ALL')
def grid_scores(spark, folder):
    table = rounded(grid_table(spark, folder), "mean_auc", "sd_repeat_mean_auc")
    return table.orderBy(*FIT, F.desc("mean_auc"), "C", "l1_ratio")


@register("best_grid_point", "W3", f'SELECT {FIT_SQL}, "C", l1_ratio, round(mean_auc, 8) AS mean_auc FROM b_best')
def best_grid_point(spark, folder):
    return rounded(selection.best_point(grid_table(spark, folder), FIT, ["C", "l1_ratio"]), "mean_auc")


@register("k_curve", "W4", f'SELECT {FIT_SQL}, k, "best_C", round(mean_auc, 8) AS mean_auc, round(sd_repeat_mean_auc, 8) AS sd_repeat_mean_auc, round(se_auc, 8) AS se_auc FROM b_curve')
def k_curve(spark, folder):
    return rounded(curve(spark, folder), "mean_auc", "sd_repeat_mean_auc", "se_auc")


@register("one_se_choice", "W4 O1", f'SELECT {FIT_SQL}, k_selected, "l2_C", round(mean_auc, 8) AS mean_auc, round(threshold, 8) AS threshold FROM b_choice')
def one_se_choice(spark, folder):
    return rounded(choice(spark, folder), "mean_auc", "threshold")


@register(
    "k_curve_summary",
    "A12",
    "SELECT cohort, k, round(avg(mean_auc), 8) AS mean, round(stddev_samp(mean_auc), 8) AS sd, count(*) AS n_fits, round(stddev_samp(mean_auc) / sqrt(count(*)), 8) AS se FROM b_curve GROUP BY ALL",
)
def k_curve_summary(spark, folder):
    return rounded(selection.k_curve_summary(curve(spark, folder), ["cohort"]), "mean", "sd", "se")


STAB = ["eligible_freq", "nonzero_freq", "mean_abs_coef", "mean_signed_coef"]


@register("stability_ranking", "A25 W2", f"SELECT {FIT_SQL}, feature, rank, {', '.join(f'round({c}, 8) AS {c}' for c in STAB)} FROM b_rank")
def stability_ranking(spark, folder):
    return rounded(ranking(spark, folder), *STAB)


@register("selected_features", "O1 P22", f"SELECT {FIT_SQL}, feature, rank FROM b_rank JOIN b_choice USING ({FIT_SQL}) WHERE rank <= k_selected")
def selected_features(spark, folder):
    return selected(spark, folder).select(*FIT, "feature", "rank")


ELIGIBLE_SQL = f"substr(md5('train|' || {FIT_SQL.replace(', ', " || '|' || ")} || '|' || feature), 1, 1) >= '4'"
CTES["b_rerank"] = f"""
SELECT {FIT_SQL}, feature, rank, CAST(row_number() OVER (PARTITION BY {FIT_SQL} ORDER BY rank) AS INTEGER) AS training_rank FROM b_rank WHERE {ELIGIBLE_SQL}"""


def eligible(spark, folder, base=None):
    key = F.md5(F.concat_ws("|", F.lit("train"), *FIT, "feature"))
    fits = choice(spark, folder, base).select(*FIT)
    return tuning.features(spark, folder).join(fits, "cohort").where(F.substring(key, 1, 1) >= "4")


def reranked(spark, folder, base=None):
    base = tuning.resamples(spark, folder) if base is None else base
    return selection.dense_rerank(ranking(spark, folder, base), FIT, eligible(spark, folder, base))


@register("training_eligible_ranking", "P13", "SELECT * FROM b_rerank")
def training_eligible_ranking(spark, folder):
    return reranked(spark, folder).select(*FIT, "feature", "rank", "training_rank")


@register(
    "effective_k",
    "O2",
    f"SELECT {FIT_SQL}, k_selected, ranked, least(k_selected, ranked) AS effective_k FROM b_choice JOIN (SELECT {FIT_SQL}, CAST(count(*) AS INTEGER) AS ranked FROM b_rerank GROUP BY ALL) USING ({FIT_SQL})",
)
def effective_k(spark, folder):
    base = tuning.resamples(spark, folder)
    full = reranked(spark, folder, base).withColumn("rank", F.col("training_rank"))
    return selection.effective_k(full, choice(spark, folder, base), FIT).select(*FIT, "k_selected", "ranked", "effective_k")


@register("rank_gaps", "W8 P22", f"SELECT {FIT_SQL}, feature, rank, training_rank AS expected_rank FROM b_rerank WHERE rank <> training_rank")
def rank_gaps(spark, folder):
    base = tuning.resamples(spark, folder)
    filtered = ranking(spark, folder, base).join(eligible(spark, folder, base), [*FIT, "feature"], "left_semi")
    return selection.rank_gaps(filtered, FIT).select(*FIT, "feature", "rank", "expected_rank")


@register("feature_by_fit", "J10", f"SELECT {FIT_SQL}, feature, rank, {ROUND_FIELDS}, selected, used, coef FROM b_ffit")
def feature_by_fit(spark, folder):
    return rounded(feature_table(spark, folder), "eligible_freq", "nonzero_freq")


@register(
    "selection_frequency",
    "A13 O5",
    """
SELECT cohort, feature, count(*) AS n_fits, count(*) FILTER (eligible_freq > 0) AS eligible_count, count(*) FILTER (selected) AS selected_count,
  round(count(*) FILTER (selected) / CAST(count(*) AS DOUBLE), 8) AS selected_rate, count(*) FILTER (used) AS used_count, round(count(*) FILTER (used) / CAST(count(*) AS DOUBLE), 8) AS used_rate,
  round(avg(coef), 8) AS coef_mean, round(quantile_cont(coef, 0.5), 8) AS coef_median, round(count(*) FILTER (coef > 0) / CAST(nullif(count(coef), 0) AS DOUBLE), 8) AS positive_rate
FROM b_ffit GROUP BY ALL ORDER BY cohort, used_rate DESC, feature""",
)
def selection_frequency(spark, folder):
    table = selection.selection_frequency(feature_table(spark, folder), ["cohort"])
    out = rounded(table, "selected_rate", "used_rate", "coef_mean", "coef_median", "positive_rate")
    return out.orderBy("cohort", F.desc("used_rate"), "feature")




def fit_sets(spark, folder):
    return feature_table(spark, folder).withColumn("fit_id", F.concat_ws("-", "repeat", "outer_fold"))


CTES["b_set"] = "SELECT cohort, repeat || '-' || outer_fold AS fit_id, feature, used FROM b_ffit"


@register(
    "nogueira_stability",
    "A14",
    """
SELECT s.cohort, n_outer_fits, mean_model_feature_n, median_model_feature_n, min_model_feature_n, max_model_feature_n, round(1 - var / nullif((mean_model_feature_n / feature_universe_n) * (1 - mean_model_feature_n / feature_universe_n), 0), 8) AS nogueira_stability,
  CASE WHEN mean_model_feature_n IN (0, feature_universe_n) THEN 'degenerate_all_none_or_all' ELSE 'ok' END AS stability_status, feature_universe_n
FROM (SELECT cohort, count(*) AS n_outer_fits, avg(k) AS mean_model_feature_n, quantile_cont(k, 0.5) AS median_model_feature_n, min(k) AS min_model_feature_n, max(k) AS max_model_feature_n
      FROM (SELECT cohort, fit_id, count(*) FILTER (used) AS k FROM b_set GROUP BY ALL) GROUP BY cohort) s
JOIN (SELECT cohort, count(*) AS feature_universe_n, avg(n / (n - 1.0e0) * f * (1 - f)) AS var
      FROM (SELECT cohort, feature, count(*) AS n, avg(CAST(used AS INTEGER)) AS f FROM b_set GROUP BY ALL) GROUP BY cohort) v USING (cohort)""",
)
def nogueira_stability(spark, folder):
    return rounded(stability.nogueira(fit_sets(spark, folder), ["cohort"]), "nogueira_stability")


CTES["b_jaccard"] = """
SELECT a.cohort, a.fit_id AS fit_a, c.fit_id AS fit_b, split_part(a.fit_id, '-', 1) = split_part(c.fit_id, '-', 1) AS same_repeat,
  CASE WHEN len(list_distinct(list_concat(a.s, c.s))) = 0 THEN 1.0e0 ELSE len(list_intersect(a.s, c.s)) / CAST(len(list_distinct(list_concat(a.s, c.s))) AS DOUBLE) END AS jaccard
FROM (SELECT cohort, fit_id, coalesce(list(feature) FILTER (used), []) AS s FROM b_set GROUP BY ALL) a
JOIN (SELECT cohort, fit_id, coalesce(list(feature) FILTER (used), []) AS s FROM b_set GROUP BY ALL) c ON a.cohort = c.cohort AND a.fit_id < c.fit_id"""


def jaccard(spark, folder):
    return stability.pairwise_jaccard(fit_sets(spark, folder), ["cohort"])


@register("pairwise_jaccard", "A15 J11", "SELECT cohort, fit_a, fit_b, same_repeat, round(jaccard, 8) AS jaccard FROM b_jaccard")
def pairwise_jaccard(spark, folder):
    return rounded(jaccard(spark, folder), "jaccard")


@register(
    "jaccard_summary",
    "A16",
    f"""SELECT cohort, {cm.spread_sql("jaccard").replace("AS n_values", "AS n_pairs").replace("round(quantile_cont(jaccard, 0.75) - quantile_cont(jaccard, 0.25), 8) AS iqr, ", "")} FROM b_jaccard GROUP BY cohort""",
)
def jaccard_summary(spark, folder):
    return rounded(stability.jaccard_summary(jaccard(spark, folder), ["cohort"]), "median", "q1", "q3", "mean", "sd", "min", "max")


# Parameter rows -------------------------------------------------------------------------------------

CTES["b_param"] = f"""
SELECT {FIT_SQL}, train_n, train_positive, train_negative, test_n, test_positive, test_negative,
  train_n / (2.0e0 * train_positive) AS weight_positive, train_n / (2.0e0 * train_negative) AS weight_negative,
  "C" AS "en_C", l1_ratio AS en_l1_ratio, k_selected, "l2_C", 'outer_training' AS ranking_source, 'inner_resampling' AS "k_C_source"
FROM b_counts JOIN b_best USING ({FIT_SQL}) JOIN b_choice USING ({FIT_SQL})"""


def parameters(spark, folder):
    outer = tuning.outer_plan(spark, folder)
    counts = resample.fold_counts(outer, ["cohort", "repeat"], "outer_fold")
    one, zero = resample.balanced_weights("train_n", "train_positive", "train_negative")
    base = tuning.resamples(spark, folder, outer)
    best = selection.best_point(grid_table(spark, folder, base), FIT, ["C", "l1_ratio"]).select(
        *FIT, F.col("C").alias("en_C"), F.col("l1_ratio").alias("en_l1_ratio")
    )
    return (
        counts.withColumns({"weight_positive": one, "weight_negative": zero})
        .join(best, FIT)
        .join(choice(spark, folder, base).drop("mean_auc", "threshold"), FIT)
        .withColumns({"ranking_source": F.lit("outer_training"), "k_C_source": F.lit("inner_resampling")})
    )


@register("fit_parameters", "P21", "SELECT * REPLACE (round(weight_positive, 8) AS weight_positive, round(weight_negative, 8) AS weight_negative) FROM b_param")
def fit_parameters(spark, folder):
    return rounded(parameters(spark, folder), "weight_positive", "weight_negative")


GRIDS = {"en_C": EN_C_GRID, "en_l1_ratio": EN_L1_GRID, "l2_C": L2_C_GRID}
LONG_PARAM = "(FROM (SELECT cohort, \"en_C\", en_l1_ratio, \"l2_C\" FROM b_param) UNPIVOT (v FOR parameter IN (\"en_C\", en_l1_ratio, \"l2_C\")))"
LOW = "v = CASE parameter WHEN 'en_C' THEN 0.001e0 WHEN 'l2_C' THEN 0.0001e0 ELSE 0 END"
HIGH = "v = CASE parameter WHEN 'en_l1_ratio' THEN 0.95e0 ELSE 3 END"


@register("grid_boundary_counts", "A21", f"SELECT cohort, parameter, count(*) AS n_fits, count(*) FILTER ({LOW}) AS at_minimum, count(*) FILTER ({HIGH}) AS at_maximum FROM {LONG_PARAM} GROUP BY ALL")
def grid_boundary_counts(spark, folder):
    return selection.boundary_counts(parameters(spark, folder), ["cohort"], GRIDS)


@register(
    "grid_boundary_flags",
    "P18",
    f"""SELECT {FIT_SQL}, "en_C" <= 0.001e0 AS "en_C_at_min", "en_C" >= 3 AS "en_C_at_max", "l2_C" <= 0.0001e0 AS "l2_C_at_min", "l2_C" >= 3 AS "l2_C_at_max" FROM b_param""",
)
def grid_boundary_flags(spark, folder):
    flags = {}
    for name in ("en_C", "l2_C"):
        flags[f"{name}_at_min"], flags[f"{name}_at_max"] = selection.at_boundary(name, GRIDS[name])
    return parameters(spark, folder).select(*FIT, *[f.alias(n) for n, f in flags.items()])


@register("k_ceiling_cohorts", "P19", f"SELECT cohort, max(k_selected) AS max_k_selected, bool_or(k_selected >= {MAX_K}) AS ceiling_hit FROM b_choice GROUP BY cohort")
def k_ceiling_cohorts(spark, folder):
    return choice(spark, folder).groupBy("cohort").agg(
        F.max("k_selected").alias("max_k_selected"), F.bool_or(F.col("k_selected") >= MAX_K).alias("ceiling_hit")
    )


@register(
    "master_manifest",
    "A27",
    f"""
SELECT cohort, scenario, splits_used, max_k_selected, ceiling_hit, round(roc_auc, 8) AS roc_auc, round(average_precision, 8) AS average_precision, round(brier, 8) AS brier
FROM (SELECT cohort, max(outer_fold) AS splits_used, max(k_selected) AS max_k_selected, bool_or(k_selected >= {MAX_K}) AS ceiling_hit FROM b_choice GROUP BY cohort)
JOIN b_oof_metrics USING (cohort) WHERE method = 'nested'""",
)
def master_manifest(spark, folder):
    chosen = choice(spark, folder).groupBy("cohort").agg(
        F.max("outer_fold").alias("splits_used"),
        F.max("k_selected").alias("max_k_selected"),
        F.bool_or(F.col("k_selected") >= MAX_K).alias("ceiling_hit"),
    )
    nested = cm.oof(spark, folder).where(F.col("method") == "nested")
    scored = rounded(metrics.discrimination(nested, ["cohort", "scenario"], "p_oof"), *cm.M3)
    return chosen.join(scored.drop("n", "positive", "negative"), "cohort")


CTES["b_z"] = f"""
SELECT {FIT_SQL}, id, feature, {uniform("'z|' || id || '|' || feature")} AS z FROM b_fold JOIN b_final USING ({FIT_SQL})"""


def scored_rows(spark, folder, base=None, outer=None):
    """Held-out rows of each fit with one value per used feature."""
    final = settle(tuning.final_coefficients(spark, folder, selected(spark, folder, base)))
    outer = b.folds(spark, folder) if outer is None else outer
    held_out = outer.join(F.broadcast(final.select(*FIT, "feature")), FIT)
    return final, held_out.select(*FIT, "id", "feature", scalars.hash_uniform("z", F.col("id"), F.col("feature")).alias("z"))


@register(
    "linear_predictions",
    "M21",
    f"""
SELECT {FIT_SQL}, id, round(1 / (1 + exp(-(eta + 0.1e0 * outer_fold))), 8) AS p
FROM (SELECT {FIT_SQL}, id, sum(coef * z) AS eta FROM b_z JOIN b_final USING ({FIT_SQL}, feature) GROUP BY ALL)""",
)
def linear_predictions(spark, folder):
    outer = tuning.outer_plan(spark, folder)
    base = tuning.resamples(spark, folder, outer)
    final, z = scored_rows(spark, folder, base, outer)
    intercepts = choice(spark, folder, base).select(*FIT, (0.1 * F.col("outer_fold")).alias("intercept"))
    return rounded(selection.linear_scores(z, final, FIT, intercepts), "p")


@register(
    "ordered_coefficients",
    "O4",
    f"""
SELECT {FIT_SQL}, feature, coef, CAST(row_number() OVER (PARTITION BY {FIT_SQL} ORDER BY abs(coef) DESC, feature) AS INTEGER) AS position FROM b_final
UNION ALL SELECT {FIT_SQL}, '(intercept)', round(0.1e0 * outer_fold, 8), CAST(count(*) + 1 AS INTEGER) FROM b_final GROUP BY ALL ORDER BY 1, 2, 3, 6""",
)
def ordered_coefficients(spark, folder):
    base = tuning.resamples(spark, folder)
    final = tuning.final_coefficients(spark, folder, selected(spark, folder, base))
    intercepts = choice(spark, folder, base).select(*FIT, F.round(0.1 * F.col("outer_fold"), 8).alias("intercept"))
    return selection.ordered_coefficients(final, FIT, intercepts).orderBy(*FIT, "position")


# Methods and scenarios --------------------------------------------------------------------------------

D3 = ["delta_roc_auc", "delta_average_precision", "delta_brier"]
M6 = [f"{m}_{c}" for m in ("nested", "non_nested") for c in compare.METRICS]
CTES["b_delta"] = """
SELECT cohort, scenario, a.n AS n_samples, a.positive AS n_positive, a.negative AS n_negative,
  a.roc_auc AS nested_roc_auc, a.average_precision AS nested_average_precision, a.brier AS nested_brier,
  c.roc_auc AS non_nested_roc_auc, c.average_precision AS non_nested_average_precision, c.brier AS non_nested_brier,
  c.roc_auc - a.roc_auc AS delta_roc_auc, c.average_precision - a.average_precision AS delta_average_precision, c.brier - a.brier AS delta_brier
FROM b_oof_metrics a JOIN b_oof_metrics c USING (cohort, scenario) WHERE a.method = 'nested' AND c.method = 'non_nested'"""


def oof_metrics(spark, folder):
    return metrics.discrimination(cm.oof(spark, folder), cm.GROUP, "p_oof")


def deltas(spark, folder):
    return compare.method_deltas(oof_metrics(spark, folder), ["cohort", "scenario"], "nested", "non_nested")


@register(
    "method_comparison",
    "M19 J4",
    f"SELECT cohort, n_samples, n_positive, n_negative, {', '.join(f'round({c}, 8) AS {c}' for c in M6 + D3)} FROM b_delta WHERE scenario = 'primary'",
)
def method_comparison(spark, folder):
    """How far the non-nested AUROC exceeds the nested one, per cohort, on averaged OOF scores."""
    predictions = b.predictions(spark, folder).where(F.col("scenario") == "primary")
    table = metrics.discrimination(metrics.averaged_oof(predictions, ["cohort", "method"]), ["cohort", "method"], "p_oof")
    return rounded(compare.method_deltas(table, ["cohort"], "nested", "non_nested"), *M6, *D3)


@register(
    "method_comparison_intervals",
    "M19 R6",
    f"SELECT * FROM (SELECT cohort, {', '.join(f'round({c}, 8) AS {c}' for c in M6 + D3)} FROM b_delta WHERE scenario = 'primary') JOIN b_boot_ci USING (cohort)",
)
def method_comparison_intervals(spark, folder):
    table = method_comparison(spark, folder).drop("n_samples", "n_positive", "n_negative")
    return table.join(cm.paired_auc_bootstrap(spark, folder), "cohort")


@register(
    "paired_oof",
    "J4",
    """
SELECT cohort, scenario, id, a.p_oof AS p_a, c.p_oof AS p_b, a.y_true, a.y_true = c.y_true AS labels_agree, CAST(2 AS BIGINT) AS sides
FROM b_oof a JOIN b_oof c USING (cohort, scenario, id) WHERE a.method = 'nested' AND c.method = 'non_nested'""",
)
def paired_oof(spark, folder):
    return compare.paired_oof(cm.oof(spark, folder), ["cohort", "scenario"], ("nested", "non_nested"))


CTES["b_change"] = """
SELECT s.*, p.nested_roc_auc AS primary_nested_roc_auc, p.non_nested_roc_auc AS primary_non_nested_roc_auc, p.delta_roc_auc AS primary_delta_roc_auc,
  s.nested_roc_auc - p.nested_roc_auc AS change_nested_roc_auc, s.non_nested_roc_auc - p.non_nested_roc_auc AS change_non_nested_roc_auc, s.delta_roc_auc - p.delta_roc_auc AS change_delta_roc_auc
FROM b_delta s LEFT JOIN (SELECT * FROM b_delta WHERE scenario = 'primary') p USING (cohort) WHERE s.scenario <> 'primary'"""
CHANGES = ["nested_roc_auc", "non_nested_roc_auc", "delta_roc_auc"]
CHANGE_COLUMNS = [f"{p}{c}" for p in ("", "primary_", "change_") for c in CHANGES]


def changes(spark, folder):
    return compare.change_from_primary(deltas(spark, folder), CHANGES)


@register("scenario_change", "J6 M23", f"SELECT cohort, scenario, {', '.join(f'round({c}, 8) AS {c}' for c in CHANGE_COLUMNS)} FROM b_change")
def scenario_change(spark, folder):
    return rounded(changes(spark, folder).select("cohort", "scenario", *CHANGE_COLUMNS), *CHANGE_COLUMNS)


@register(
    "scenario_summary",
    "A19",
    """
SELECT scenario, count(delta_roc_auc) AS n_cohorts, round(quantile_cont(delta_roc_auc, 0.5), 8) AS median_delta, round(min(delta_roc_auc), 8) AS min_delta, round(max(delta_roc_auc), 8) AS max_delta,
  count(*) FILTER (delta_roc_auc > 0) AS n_positive_delta, count(*) FILTER (delta_roc_auc < 0) AS n_negative_delta, count(*) FILTER (delta_roc_auc = 0) AS n_zero_delta,
  round(quantile_cont(change_delta_roc_auc, 0.5), 8) AS median_change
FROM b_change GROUP BY scenario""",
)
def scenario_summary(spark, folder):
    table = compare.scenario_summary(changes(spark, folder), ["scenario"], "delta_roc_auc", "change_delta_roc_auc")
    return rounded(table, "median_delta", "min_delta", "max_delta", "median_change")


@register(
    "nesting_variants",
    "M18 U1 O6",
    """
SELECT cohort, scenario || ':' || method AS method, round(m.roc_auc, 8) AS roc_auc, round(m.average_precision, 8) AS average_precision, round(m.brier, 8) AS brier,
  round(m.roc_auc - r.roc_auc, 8) AS delta_roc_auc, round(m.average_precision - r.average_precision, 8) AS delta_average_precision, round(m.brier - r.brier, 8) AS delta_brier, scenario || ':' || method = 'primary:nested' AS valid_performance_estimator, scenario || ':' || method <> 'primary:nested' AS diagnostic_leakage
FROM b_oof_metrics m JOIN (SELECT cohort, roc_auc, average_precision, brier FROM b_oof_metrics WHERE scenario = 'primary' AND method = 'nested') r USING (cohort)
ORDER BY cohort, method""",
)
def nesting_variants(spark, folder):
    """Four prediction sources of a cohort against the fully nested one."""
    base = b.predictions(spark, folder)
    parts = [
        base.where((F.col("scenario") == s) & (F.col("method") == m)).withColumn("method", F.lit(f"{s}:{m}")).drop("scenario")
        for s, m, _ in b.SCORE_MODELS
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    table = metrics.discrimination(metrics.averaged_oof(union, ["cohort", "method"]), ["cohort", "method"], "p_oof")
    out = compare.with_reference_method(table, ["cohort"], "primary:nested").drop("n", "positive", "negative")
    return rounded(out, *cm.M3, *D3).orderBy("cohort", "method")


CTES["b_repeat_delta"] = """
SELECT a.cohort, a.repeat, a.roc_auc AS nested_auc, c.roc_auc AS non_nested_auc, c.roc_auc - a.roc_auc AS delta_auc, k.roc_auc AS knn_nested_auc, k.roc_auc - a.roc_auc AS knn_change,
  CASE WHEN c.roc_auc IS NULL THEN 'nested_only' WHEN k.roc_auc IS NULL THEN 'paired' ELSE 'paired_with_knn' END AS status
FROM (SELECT * FROM b_repeat_metrics WHERE scenario = 'primary' AND method = 'nested') a
LEFT JOIN (SELECT * FROM b_repeat_metrics WHERE scenario = 'primary' AND method = 'non_nested' AND cohort <> 'MACHINERY') c USING (cohort, repeat)
LEFT JOIN (SELECT * FROM b_repeat_metrics WHERE scenario = 'knn' AND method = 'nested' AND cohort < 'F') k USING (cohort, repeat)"""


@register(
    "paired_repeats",
    "J14",
    "SELECT cohort, repeat, round(nested_auc, 8) AS nested_auc, round(non_nested_auc, 8) AS non_nested_auc, round(delta_auc, 8) AS delta_auc, round(knn_nested_auc, 8) AS knn_nested_auc, round(knn_change, 8) AS knn_change, status FROM b_repeat_delta",
)
def paired_repeats(spark, folder):
    """Repeat-wise AUROC of nested, non-nested and KNN-imputed runs; not every cohort has all three."""
    table = metrics.discrimination(b.predictions(spark, folder), [*cm.GROUP, "repeat"]).select(*cm.GROUP, "repeat", "roc_auc")
    side = lambda s, m, name: table.where((F.col("scenario") == s) & (F.col("method") == m)).select(
        "cohort", "repeat", F.col("roc_auc").alias(name)
    )
    non_nested = side("primary", "non_nested", "non_nested_auc").where(F.col("cohort") != "MACHINERY")
    knn = side("knn", "nested", "knn_nested_auc").where(F.col("cohort") < "F")
    joined = side("primary", "nested", "nested_auc").join(non_nested, ["cohort", "repeat"], "left").join(knn, ["cohort", "repeat"], "left")
    out = joined.withColumns(
        {
            "delta_auc": F.col("non_nested_auc") - F.col("nested_auc"),
            "knn_change": F.col("knn_nested_auc") - F.col("nested_auc"),
            "status": F.when(F.col("non_nested_auc").isNull(), "nested_only")
            .when(F.col("knn_nested_auc").isNull(), "paired")
            .otherwise("paired_with_knn"),
        }
    )
    return rounded(out, "nested_auc", "non_nested_auc", "delta_auc", "knn_nested_auc", "knn_change")


@register(
    "omission_summaries",
    "A20 J12",
    """
SELECT s.scenario, summary, excluded AS excluded_cohort, n_source_cohorts, count(d.cohort) AS n_retained, CASE WHEN count(d.cohort) > 0 THEN 'available' ELSE 'no_retained_cohorts' END AS status,
  round(avg(delta_roc_auc), 8) AS mean_delta, round(quantile_cont(delta_roc_auc, 0.5), 8) AS median_delta, round(min(delta_roc_auc), 8) AS minimum_delta, round(max(delta_roc_auc), 8) AS maximum_delta
FROM (SELECT scenario, 'all_available' AS summary, '' AS excluded, count(*) AS n_source_cohorts FROM b_delta GROUP BY scenario
      UNION ALL SELECT scenario, 'omit_one', cohort, count(*) OVER (PARTITION BY scenario) FROM b_delta
      UNION ALL SELECT scenario, 'named_subset', 'MACHINERY', count(*) FROM b_delta GROUP BY scenario) s
LEFT JOIN b_delta d ON d.scenario = s.scenario AND d.cohort <> s.excluded
GROUP BY s.scenario, summary, excluded, n_source_cohorts""",
)
def omission_summaries(spark, folder):
    table = inference.omission_summaries(deltas(spark, folder), ["scenario"], "delta_roc_auc", "MACHINERY")
    return rounded(table, "mean_delta", "median_delta", "minimum_delta", "maximum_delta")


# A finer comparison unit (cohort x nation) gives the exact tests more than a handful of differences.
CTES["b_nation_delta"] = """
SELECT c_mktsegment AS cohort, c_nationkey, count(*) AS n, round(avg(c_acctbal) - 4500, 2) AS delta FROM customer GROUP BY ALL"""
CTES["b_unit_delta"] = "SELECT cohort, c_nationkey % 4 AS family, c_nationkey, CASE WHEN abs(delta) < 100 THEN 0 ELSE round(delta / 100, 0) END AS delta FROM b_nation_delta"


def unit_deltas(spark, folder):
    base = b.table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("cohort"), "c_nationkey").agg(
        F.round(F.avg("c_acctbal") - 4500, 2).alias("d")
    )
    return base.select(
        "cohort",
        (F.col("c_nationkey") % 4).alias("family"),
        "c_nationkey",
        F.when(F.abs("d") < 100, 0.0).otherwise(F.round(F.col("d") / 100, 0)).alias("delta"),
    )


CTES["b_signed"] = """
SELECT *, rank() OVER (PARTITION BY cohort, family ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY cohort, family, abs(delta)) - 1) / 2.0e0 AS r,
  row_number() OVER (PARTITION BY cohort, family ORDER BY c_nationkey) - 1 AS i FROM b_unit_delta WHERE delta <> 0"""


@register(
    "signed_rank_test",
    "T1",
    """
SELECT cohort, family, count(*) FILTER (abs(s - total / 2) + 2.220446049250313e-14 >= abs(plus - total / 2)) / CAST(count(*) AS DOUBLE) AS p_value,
  any_value(n_total) AS n_total, any_value(m) AS n_nonzero, any_value(n_total) - any_value(m) AS n_zero, any_value(plus) AS t_plus, any_value(total) AS rank_sum, count(*) AS enumerations
FROM (SELECT cohort, family, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN r ELSE 0 END) AS s, any_value(plus) AS plus, any_value(total) AS total, any_value(m) AS m
      FROM b_signed JOIN (SELECT cohort, family, sum(r) FILTER (delta > 0) AS plus_null, coalesce(sum(r) FILTER (delta > 0), 0) AS plus, sum(r) AS total, count(*) AS m, unnest(range(0, (1 << count(*))::BIGINT)) AS mask FROM b_signed GROUP BY cohort, family)
      USING (cohort, family) GROUP BY cohort, family, mask)
JOIN (SELECT cohort, family, count(*) AS n_total FROM b_unit_delta GROUP BY ALL) USING (cohort, family) GROUP BY cohort, family""",
)
def signed_rank_test(spark, folder):
    return inference.signed_rank(unit_deltas(spark, folder), ["cohort", "family"], "delta")


@register(
    "sign_test",
    "T2",
    """
SELECT cohort, n_total, n_positive, n_negative, n_zero, n AS n_nonzero,
  round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(n_positive, n_negative) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)) * pow(0.5e0, n)))) END, 8) AS p_value
FROM (SELECT cohort, count(*) AS n_total, count(*) FILTER (delta > 0) AS n_positive, count(*) FILTER (delta < 0) AS n_negative, count(*) FILTER (delta = 0) AS n_zero, count(*) FILTER (delta <> 0) AS n FROM b_unit_delta GROUP BY cohort)""",
)
def sign_test(spark, folder):
    return rounded(inference.sign_test(unit_deltas(spark, folder), ["cohort"], "delta"), "p_value")


REQUIRED = [
    ("primary", c) for c in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
] + [("knn", c) for c in ("AUTOMOBILE", "BUILDING", "SHIPPING")]
CTES["b_sign_stat"] = """
SELECT scenario, cohort, delta_roc_auc AS d, rank() OVER (PARTITION BY scenario ORDER BY abs(delta_roc_auc)) AS r FROM b_delta WHERE scenario = 'primary'"""


@register(
    "formal_inference",
    "T3 T1 T2",
    """
SELECT 'primary' AS scenario, '' AS missing_cohorts, CAST(5 AS BIGINT) AS n_cohorts, round(quantile_cont(d, 0.5), 8) AS median_delta, round(min(d), 8) AS min_delta, round(max(d), 8) AS max_delta,
  t.test, round(any_value(t.p_value), 8) AS p_value, count(*) AS n_nonzero, 'completed' AS status
FROM b_sign_stat, (
  SELECT 'signed_rank' AS test, avg(CASE WHEN abs(s - 7.5e0) + 1e-12 >= abs(plus - 7.5e0) THEN 1 ELSE 0 END) AS p_value
  FROM (SELECT mask, sum(CASE WHEN (mask >> (r - 1)) & 1 = 1 THEN r ELSE 0 END) AS s FROM b_sign_stat, (SELECT unnest(range(0, 32)) AS mask) GROUP BY mask), (SELECT coalesce(sum(r) FILTER (d > 0), 0) AS plus FROM b_sign_stat)
  UNION ALL SELECT 'sign', least(1, 2 * sum(CASE i WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 END) / 32.0e0) FROM (SELECT unnest(range(0, 3)) AS i) WHERE i <= (SELECT least(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) FROM b_sign_stat)) t
GROUP BY t.test
UNION ALL SELECT 'knn', 'SHIPPING', 3, NULL, NULL, NULL, 'not_run', NULL, NULL, 'missing_prespecified_cohorts'""",
)
def formal_inference(spark, folder):
    required = spark.createDataFrame(REQUIRED, "scenario string, cohort string")
    table = inference.formal_inference(deltas(spark, folder), ["scenario"], "delta_roc_auc", required)
    return rounded(table, "median_delta", "min_delta", "max_delta", "p_value")


# Selection of cohorts, schedules, coverage --------------------------------------------------------------

REQUESTS = [
    ("all", None, 1), ("listed", "building ", 1), ("listed", "MACHINERY", 2), ("repeated", "BUILDING", 1),
    ("repeated", "Building", 2), ("unknown", "SHIPPING", 1),
]
DEFAULTS = ["MACHINERY", "SHIPPING", "HOUSEHOLD", "BUILDING"]


@register(
    "cohort_selection",
    "P1",
    """
SELECT r.selector, d.cohort, d.ord, 'selected' AS status FROM (VALUES ('all')) r(selector), (VALUES ('MACHINERY', 1), ('SHIPPING', 2), ('HOUSEHOLD', 3), ('BUILDING', 4)) d(cohort, ord)
WHERE d.cohort IN (SELECT c_mktsegment FROM customer)
UNION ALL SELECT selector, upper(trim(cohort)), min(ord), CASE WHEN count(*) > 1 THEN 'duplicate' WHEN upper(trim(cohort)) NOT IN (SELECT c_mktsegment FROM customer) THEN 'missing' ELSE 'selected' END
FROM (VALUES ('listed', 'building ', 1), ('listed', 'MACHINERY', 2), ('repeated', 'BUILDING', 1), ('repeated', 'Building', 2), ('unknown', 'SHIPPING', 1)) v(selector, cohort, ord) GROUP BY selector, upper(trim(cohort))""",
)
def cohort_selection(spark, folder):
    return compare.select_cohorts(
        spark.createDataFrame(REQUESTS, "selector string, cohort string, ord int"),
        b.samples(spark, folder),
        DEFAULTS,
    )


@register(
    "cohort_roles",
    "P16",
    """
SELECT DISTINCT cohort, CASE WHEN cohort = 'MACHINERY' THEN 'external' ELSE 'main' END AS analysis_role,
  CASE WHEN cohort IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'primary_cohorts' ELSE 'descriptive' END AS source_group FROM b_sample""",
)
def cohort_roles(spark, folder):
    c = F.col("cohort")
    return b.samples(spark, folder).select("cohort").distinct().select(
        "cohort",
        F.when(c == "MACHINERY", "external").otherwise("main").alias("analysis_role"),
        F.when(c.isin("AUTOMOBILE", "BUILDING", "FURNITURE"), "primary_cohorts").otherwise("descriptive").alias("source_group"),
    )


# Every customer is one attempt at running the unit (segment, nation).
CTES["b_attempt"] = """
SELECT c_mktsegment AS cohort, 'scenario' || c_nationkey AS scenario, c_custkey AS attempt, CASE WHEN substr(md5('run' || c_custkey), 1, 1) < '4' THEN 'failed' ELSE 'completed' END AS status,
  'v' || (CASE WHEN substr(md5('version' || c_custkey), 1, 2) = '00' THEN 2 ELSE 1 END) AS producer_version, md5('source' || c_nationkey || CASE WHEN substr(md5('stale' || c_custkey), 1, 2) < '08' THEN 'x' ELSE '' END) AS fingerprint FROM customer"""


def attempts(spark, folder):
    digit = lambda p, n: F.substring(F.md5(F.concat(F.lit(p), F.col("c_custkey").cast("string"))), 1, n)
    stale = F.when(digit("stale", 2) < "08", "x").otherwise("")
    return b.table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("cohort"),
        F.concat(F.lit("scenario"), F.col("c_nationkey").cast("string")).alias("scenario"),
        F.col("c_custkey").alias("attempt"),
        F.when(digit("run", 1) < "4", "failed").otherwise("completed").alias("status"),
        F.when(digit("version", 2) == "00", "v2").otherwise("v1").alias("producer_version"),
        F.md5(F.concat(F.lit("source"), F.col("c_nationkey").cast("string"), stale)).alias("fingerprint"),
    )


UNITS = ["cohort", "scenario"]


@register("scenario_schedule", "U6", "SELECT cohort, scenario, max(attempt) AS attempt, arg_max(status, attempt) AS status, arg_max(fingerprint, attempt) AS fingerprint, count(*) AS n_entries FROM b_attempt GROUP BY ALL")
def scenario_schedule(spark, folder):
    return compare.last_wins(attempts(spark, folder), UNITS, "attempt", ["status", "fingerprint"])


@register(
    "run_outcomes",
    "A23",
    """SELECT cohort, scenario, count(*) AS units, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'completed' WHEN count(*) FILTER (status = 'completed') > 0 THEN 'completed_with_failures' ELSE 'failed' END AS run_status FROM b_attempt GROUP BY ALL""",
)
def run_outcomes(spark, folder):
    return compare.run_outcome(attempts(spark, folder), UNITS)


PLAN_SQL = "(SELECT cohort, scenario FROM (SELECT DISTINCT cohort FROM b_attempt UNION SELECT 'SHIPPING'), (SELECT 'scenario' || n_nationkey AS scenario FROM nation))"


def planned(spark, folder):
    """Every scenario of ``nation`` for every expected cohort: the listed scenarios are exploded per cohort."""
    cohorts = attempts(spark, folder).select("cohort").distinct().unionByName(spark.createDataFrame([("SHIPPING",)], "cohort string"))
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    listed = nation.agg(F.collect_set("n_nationkey").alias("keys")).withColumn("_all", F.lit(1))
    numbered = cohorts.withColumn("_all", F.lit(1)).join(listed, "_all").withColumn("i", F.explode("keys"))
    return numbered.select("cohort", F.concat(F.lit("scenario"), F.col("i").cast("string")).alias("scenario"))


@register(
    "coverage_grid",
    "J7 J8 J16",
    f"""
SELECT p.cohort, p.scenario, CASE WHEN a.cohort IS NULL THEN 'not_provided' ELSE 'available' END AS input_status, CASE WHEN s.cohort IS NULL THEN 'not_selected' ELSE 'selected' END AS selection_status
FROM {PLAN_SQL} p LEFT JOIN (SELECT DISTINCT cohort, scenario FROM b_attempt) a USING (cohort, scenario)
LEFT JOIN (SELECT DISTINCT cohort, scenario FROM b_attempt WHERE status = 'completed' AND cohort < 'G') s USING (cohort, scenario)""",
)
def coverage_grid(spark, folder):
    tried = attempts(spark, folder)
    done = tried.where((F.col("status") == "completed") & (F.col("cohort") < "G"))
    return compare.coverage(planned(spark, folder), tried, done, UNITS)


@register(
    "report_coverage",
    "J16",
    """
SELECT cohort, CASE WHEN nested > 0 THEN 'available' ELSE 'not_available' END AS nested_status,
  CASE WHEN compared > 0 THEN 'paired' WHEN nested > 0 THEN 'nested_only' ELSE 'not_available' END AS comparison_status,
  CASE WHEN cohort > 'G' THEN 'not_applicable' WHEN knn > 0 THEN 'available' ELSE 'not_requested' END AS knn_status
FROM (SELECT c.cohort, count(*) FILTER (scenario = 'primary' AND method = 'nested') AS nested, count(*) FILTER (scenario = 'primary' AND method = 'non_nested' AND c.cohort <> 'MACHINERY') AS compared,
        count(*) FILTER (scenario = 'knn' AND c.cohort < 'F') AS knn FROM (SELECT DISTINCT cohort FROM b_sample UNION SELECT 'SHIPPING') c LEFT JOIN b_pred p ON p.cohort = c.cohort GROUP BY c.cohort)""",
)
def report_coverage(spark, folder):
    """Which analyses exist per expected cohort, with the reason where one is absent."""
    pred = b.predictions(spark, folder)
    scenario, method, c = F.col("scenario"), F.col("method"), F.col("cohort")
    have = pred.groupBy("cohort").agg(
        F.count_if((scenario == "primary") & (method == "nested")).alias("nested"),
        F.count_if((scenario == "primary") & (method == "non_nested") & (c != "MACHINERY")).alias("compared"),
        F.count_if((scenario == "knn") & (c < "F")).alias("knn"),
    )
    expected = b.samples(spark, folder).select("cohort").distinct().unionByName(spark.createDataFrame([("SHIPPING",)], "cohort string"))
    joined = expected.join(have, "cohort", "left").fillna(0)
    return joined.select(
        "cohort",
        F.when(F.col("nested") > 0, "available").otherwise("not_available").alias("nested_status"),
        F.when(F.col("compared") > 0, "paired").when(F.col("nested") > 0, "nested_only").otherwise("not_available").alias("comparison_status"),
        F.when(c > "G", "not_applicable").when(F.col("knn") > 0, "available").otherwise("not_requested").alias("knn_status"),
    )


@register(
    "union_prediction_sources",
    "U1 U2",
    """
SELECT method, source, count(*) AS n_rows, count(repeat) AS with_repeat, count(split) AS with_split, round(avg(p), 8) AS mean_p FROM (
  SELECT 'primary:' || method AS method, 'cv' AS source, repeat, NULL AS split, p FROM b_pred WHERE scenario = 'primary'
  UNION ALL SELECT 'holdout', 'holdout', NULL, split, p FROM b_hold WHERE subset = 'test') GROUP BY ALL""",
)
def union_prediction_sources(spark, folder):
    """Three prediction sources with different keys in one table; absent keys are NULL."""
    cv = b.predictions(spark, folder).where(F.col("scenario") == "primary").select(
        F.concat(F.lit("primary:"), "method").alias("method"), F.lit("cv").alias("source"), "repeat", "p"
    )
    hold = b.holdout(spark, folder).where(F.col("subset") == "test").select(
        F.lit("holdout").alias("method"), F.lit("holdout").alias("source"), "split", "p"
    )
    return cv.unionByName(hold, allowMissingColumns=True).groupBy("method", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("repeat").alias("with_repeat"), F.count("split").alias("with_split"), F.round(F.avg("p"), 8).alias("mean_p")
    )


# Original against rescaled --------------------------------------------------------------------------------

CTES["b_scale"] = """
SELECT 'A' AS panel, cohort, method, scenario, roc_auc AS value FROM b_oof_metrics WHERE method = 'nested'
UNION ALL SELECT 'B', cohort, method, scenario, roc_auc FROM b_oof_metrics
UNION ALL SELECT 'D', cohort, 'difference', scenario, delta_roc_auc FROM b_delta"""
CTES["b_scale_wide"] = """
SELECT panel, cohort, method, o.value AS original, s.value AS scale_aware, s.value - o.value AS difference
FROM (SELECT * FROM b_scale WHERE scenario = 'primary') o FULL JOIN (SELECT * FROM b_scale WHERE scenario = 'knn') s USING (panel, cohort, method)"""


def scale_values(spark, folder, scenario):
    table = oof_metrics(spark, folder).where(F.col("scenario") == scenario)
    value = F.col("roc_auc").alias("value")
    nested = table.where(F.col("method") == "nested").select(F.lit("A").alias("panel"), "cohort", "method", value)
    both = table.select(F.lit("B").alias("panel"), "cohort", "method", value)
    delta = deltas(spark, folder).where(F.col("scenario") == scenario).select(
        F.lit("D").alias("panel"), "cohort", F.lit("difference").alias("method"), F.col("delta_roc_auc").alias("value")
    )
    return nested.unionByName(both).unionByName(delta)


def scale_table(spark, folder):
    return compare.scale_comparison(scale_values(spark, folder, "primary"), scale_values(spark, folder, "knn"))


@register("scale_comparison", "M24", "SELECT panel, cohort, method, round(original, 8) AS original, round(scale_aware, 8) AS scale_aware, round(difference, 8) AS difference FROM b_scale_wide")
def scale_comparison(spark, folder):
    return rounded(scale_table(spark, folder), "original", "scale_aware", "difference")


@register(
    "panel_reference_check",
    "J15",
    """
SELECT d.cohort, round(a.original, 8) AS panel_a, round(b.original + wrong, 8) AS panel_b, abs(a.original - b.original - wrong) <= 1e-12 AS agrees
FROM (SELECT *, CASE WHEN substr(md5('quote' || cohort), 1, 1) < '6' THEN 0.01e0 ELSE 0 END AS wrong FROM b_scale_wide) d JOIN b_scale_wide a ON a.cohort = d.cohort AND a.panel = 'A' JOIN b_scale_wide b ON b.cohort = d.cohort AND b.panel = 'B' AND b.method = 'nested' WHERE d.panel = 'D'""",
)
def panel_reference_check(spark, folder):
    """Whether the reference value quoted in one panel equals the one in another; some quotes are misprinted by hash."""
    wide = scale_table(spark, folder)
    pick = lambda panel: F.max(F.when((F.col("panel") == panel) & (F.col("method") == "nested"), F.col("original")))
    out = wide.groupBy("cohort").agg(pick("A").alias("panel_a"), pick("B").alias("panel_b"))
    misprint = F.when(F.substring(F.md5(F.concat(F.lit("quote"), "cohort")), 1, 1) < "6", 0.01).otherwise(0.0)
    out = out.withColumn("panel_b", F.col("panel_b") + misprint)
    return rounded(out.withColumn("agrees", scalars.close("panel_a", "panel_b")), "panel_a", "panel_b")


@register(
    "holdout_interval_suppression",
    "R8",
    """
SELECT lang AS cohort, split_n AS test_n, pos AS test_positive, CASE WHEN least(pos, split_n - pos) < 2 THEN 'suppressed_minority_below_2' ELSE 'reported' END AS interval_status
FROM (SELECT lang, count(*) AS split_n, CAST(sum(toxic) AS BIGINT) AS pos FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang)""",
)
def holdout_interval_suppression(spark, folder):
    """Intervals are withheld where a test set's minority class is below two."""
    rows = (
        b.table(spark, folder, "documents").select("doc_id", "lang")
        .join(b.table(spark, folder, "labels").where("quality = 1"), "doc_id")
        .select(F.col("lang").alias("cohort"), F.col("toxic").alias("y"))
    )
    counts = resample.class_counts(rows, ["cohort"])
    return counts.select(
        "cohort", F.col("n").alias("test_n"), F.col("positive").alias("test_positive"),
        F.when(F.least("positive", "negative") < 2, "suppressed_minority_below_2").otherwise("reported").alias("interval_status"),
    )


CTES["b_variant"] = """
SELECT c_mktsegment AS cohort, CAST(c_custkey AS VARCHAR) AS id, variant,
  CAST(CASE WHEN c_acctbal > 4500 THEN 1 WHEN c_acctbal > 3500 THEN CASE variant WHEN 'stable_as_positive' THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS y
FROM customer, (VALUES ('primary'), ('stable_as_negative'), ('stable_as_positive')) v(variant) WHERE variant <> 'primary' OR NOT (c_acctbal > 3500 AND c_acctbal <= 4500)"""


@register("label_variants", "P23", "SELECT cohort, variant, count(*) AS n, CAST(sum(y) AS BIGINT) AS positive, CAST(count(*) - sum(y) AS BIGINT) AS negative FROM b_variant GROUP BY ALL")
def label_variants(spark, folder):
    """The same cohort under three label populations; the middle band is absent from the primary one."""
    return resample.class_counts(b.label_variants(spark, folder), ["cohort", "variant"])


@register(
    "generated_warnings",
    "U7",
    """
SELECT cohort, scenario, origin, message, count(*) AS n FROM (
  SELECT cohort, scenario, 'source' AS origin, 'attempt failed' AS message FROM b_attempt WHERE status = 'failed'
  UNION ALL SELECT cohort, scenario, 'generated', 'stale producer ' || producer_version FROM b_attempt WHERE producer_version <> 'v1') GROUP BY ALL""",
)
def generated_warnings(spark, folder):
    """Warnings carried over from a source and warnings generated here, in one completed schema."""
    tried = attempts(spark, folder)
    carried = tried.where(F.col("status") == "failed").select(*UNITS, F.lit("source").alias("origin"), F.lit("attempt failed").alias("message"))
    new = tried.where(F.col("producer_version") != "v1").select(
        *UNITS, F.lit("generated").alias("origin"), F.concat(F.lit("stale producer "), "producer_version").alias("message"), "producer_version"
    )
    return carried.unionByName(new, allowMissingColumns=True).groupBy(*UNITS, "origin", "message").agg(F.count(F.lit(1)).alias("n"))
