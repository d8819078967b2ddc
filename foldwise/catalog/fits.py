"""Queries that fit models. Iterative, so mostly without SQL oracle; tests compare them with NumPy.

What the design fixes of a fitted bundle, its rows and their folds and labels, is held against SQL.
"""

from dataclasses import replace
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.catalog import ingest as ci
from foldwise.catalog.checks import fault, fault_sql
from foldwise.catalog.metrics import rounded
from foldwise.catalog.oracle import CTES, folds_sql
from foldwise.catalog.registry import register
from foldwise.operators import bootstrap, calibration, compare, metrics, rules
from foldwise.plans import fitting, ledger, schedule, validation
from foldwise.plans.design import PRIMARY, SCENARIOS
from foldwise.session import checkpoint_folder, settle
from foldwise.sources import bindings as b

OUTER = validation.OUTER
_MEMORY: dict = {}


def _once(spark, folder, name, build):
    """Analyses of one session and folder are settled tables; several queries read the same one."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _MEMORY:
        _MEMORY[key] = build()
    return _MEMORY[key]


def forget():
    """Drop the analyses kept so far, e.g. to time a query from the start."""
    _MEMORY.clear()


def all_cells(spark, folder, scale_aware=False):
    """Retained masked cells of every sample, settled: every stage of every analysis reads them."""
    return _once(
        spark, folder, f"cells-{scale_aware}",
        lambda: settle(rules.retained_cells(ci.masked(spark, folder, scale_aware)).drop("raw_value")),
    )


def population(spark, folder, variant="primary"):
    """(cells, samples) of a labelling; samples it excludes have no cells either.

    ``scale_aware`` is the primary labelling under the rules that know the scale a cohort arrived in.
    """
    scaled = variant == "scale_aware"

    def build():
        labelled = b.label_variants(spark, folder).where(F.col("variant") == ("primary" if scaled else variant)).drop("variant")
        samples = settle(b.noisy(labelled))
        return settle(all_cells(spark, folder, scaled).join(samples.select("cohort", "id"), ["cohort", "id"], "left_semi")), samples

    return _once(spark, folder, f"population-{variant}", build)


def inputs(spark, folder):
    return population(spark, folder)


def nested(spark, folder, scenario="primary"):
    return _once(
        spark, folder, f"nested-{scenario}", lambda: validation.nested(*inputs(spark, folder), SCENARIOS[scenario])
    )


def non_nested(spark, folder, scenario="primary"):
    return _once(
        spark, folder, f"non_nested-{scenario}", lambda: validation.non_nested(*inputs(spark, folder), SCENARIOS[scenario])
    )


@register("elastic_net_tuning", "M9 M6")
def elastic_net_tuning(spark, folder):
    """Every grid point of every outer fit with its inner score."""
    return rounded(nested(spark, folder).tuned.grid, "mean_auc", "sd_repeat_mean_auc", digits=6)


@register("inner_fit_convergence", "M6")
def inner_fit_convergence(spark, folder):
    """Solves, convergence and iterations per cohort and grid point."""
    return nested(spark, folder).tuned.folds.groupBy("cohort", "C", "l1_ratio").agg(
        F.count(F.lit(1)).alias("solves"),
        F.count_if("converged").alias("converged"),
        F.max("iterations").alias("max_iterations"),
    )


@register("convergence_warning_rows", "M6 U7")
def convergence_warning_rows(spark, folder):
    """Count of solves beyond the first iteration budget per cohort (zero rows would be ideal)."""
    found = fitting.convergence_warnings(nested(spark, folder).tuned.folds, OUTER)
    counted = found.groupBy("cohort").agg(F.count(F.lit(1)).alias("warnings"))
    return inputs(spark, folder)[1].select("cohort").distinct().join(counted, "cohort", "left").fillna(0)


@register("stability_selection", "M10")
def stability_selection(spark, folder):
    table = nested(spark, folder).tuned.ranking
    return rounded(table, "eligible_freq", "nonzero_freq", "mean_abs_coef", "mean_signed_coef", digits=5)


@register("size_selection", "M11")
def size_selection(spark, folder):
    return rounded(nested(spark, folder).tuned.choice, "mean_auc", "threshold", digits=6)


@register("nested_predictions", "M12")
def nested_predictions(spark, folder):
    return rounded(nested(spark, folder).predictions, "p", digits=5)


@register("nested_metrics", "M12")
def nested_metrics(spark, folder):
    return rounded(validation.oof_metrics(nested(spark, folder).predictions), *compare.METRICS, digits=5)


@register("full_data_signature", "M13")
def full_data_signature(spark, folder):
    done = _once(
        spark, folder, "signature", lambda: validation.full_data_signature(*inputs(spark, folder), PRIMARY)
    )
    from foldwise.operators.selection import ordered_coefficients

    coefficients = fitting.model_coefficients(done.models, done.order, ["cohort"])
    return rounded(ordered_coefficients(coefficients, ["cohort"], done.models.select("cohort", "intercept")), "coef", digits=5)


@register("non_nested_metrics", "M14")
def non_nested_metrics(spark, folder):
    return rounded(validation.oof_metrics(non_nested(spark, folder).predictions), *compare.METRICS, digits=5)


@register("fixed_specification_models", "M15")
def fixed_specification_models(spark, folder):
    """Coefficients of the global specification refitted in every outer fold."""
    done = non_nested(spark, folder)
    return rounded(fitting.model_coefficients(done.models, done.order, OUTER), "coef", digits=5)


@register("holdout_fit_metrics", "M16")
def holdout_fit_metrics(spark, folder):
    done = _once(spark, folder, "holdout", lambda: validation.holdout(*inputs(spark, folder), PRIMARY))
    return rounded(metrics.discrimination(done.predictions, validation.SPLIT), *compare.METRICS, digits=5)


@register("selective_nesting", "M17 M18")
def selective_nesting(spark, folder):
    """Fully nested, two partly nested and the non-nested analysis side by side."""
    cells, samples = inputs(spark, folder)
    full, none = nested(spark, folder), non_nested(spark, folder)
    sources = {
        "fully_nested": full.predictions,
        "fully_non_nested": none.predictions,
        "nested_ranking_global_size": _once(
            spark, folder, "hybrid-a",
            lambda: validation.nested_ranking_global_size(cells, samples, full.tuned.ranking, none.tuned, PRIMARY),
        ).predictions,
        "global_ranking_nested_size": _once(
            spark, folder, "hybrid-b", lambda: validation.global_ranking_nested_size(cells, samples, none.tuned, PRIMARY)
        ).predictions,
    }
    union = None
    for name, predictions in sources.items():
        part = predictions.withColumn("method", F.lit(name))
        union = part if union is None else union.unionByName(part)
    table = metrics.discrimination(metrics.averaged_oof(union, ["cohort", "method"]), ["cohort", "method"], "p_oof")
    out = compare.with_reference_method(table, ["cohort"], "fully_nested")
    return rounded(out, *compare.METRICS, *[f"delta_{c}" for c in compare.METRICS], digits=5)


@register("fitted_method_comparison", "M14 M19")
def fitted_method_comparison(spark, folder):
    """Nested against non-nested from fitted models: the headline result."""
    parts = [
        done.predictions.withColumn("method", F.lit(name))
        for name, done in (("nested", nested(spark, folder)), ("non_nested", non_nested(spark, folder)))
    ]
    union = parts[0].unionByName(parts[1])
    table = metrics.discrimination(metrics.averaged_oof(union, ["cohort", "method"]), ["cohort", "method"], "p_oof")
    wide = compare.method_deltas(table, ["cohort"], "nested", "non_nested")
    return rounded(wide, *[c for c in wide.columns if c.startswith(("nested_", "non_nested_", "delta_"))], digits=5)


@register("final_fit_status", "M12 U7")
def final_fit_status(spark, folder):
    """Cohorts whose final models all converged, and cohorts that failed."""
    return fitting.fit_status(nested(spark, folder).models, ["cohort"])


# Reports on fitted scores -------------------------------------------------------------------------------


def fitted_scores(spark, folder):
    """(cohort, method, id, y_true, p): averaged out-of-fold scores of the fitted analyses."""

    def build():
        full, none = nested(spark, folder).predictions, non_nested(spark, folder).predictions
        union = full.withColumn("method", F.lit("nested")).unionByName(none.withColumn("method", F.lit("non_nested")))
        return settle(metrics.averaged_oof(union, ["cohort", "method"]).withColumnRenamed("p_oof", "p"))

    return _once(spark, folder, "fitted-scores", build)


def short(df, digits=5):
    return rounded(df, *[f.name for f in df.schema if f.dataType.typeName() == "double"], digits=digits)


@register("fitted_roc_coordinates", "W5")
def fitted_roc_coordinates(spark, folder):
    return short(metrics.roc_points(fitted_scores(spark, folder), ["cohort", "method"]))


@register("fitted_pr_coordinates", "W6")
def fitted_pr_coordinates(spark, folder):
    return short(metrics.pr_points(fitted_scores(spark, folder), ["cohort", "method"]))


@register("fitted_calibration_bins", "W7")
def fitted_calibration_bins(spark, folder):
    return short(calibration.calibration_bins(fitted_scores(spark, folder), ["cohort", "method"]))


@register("fitted_calibration_metrics", "M8")
def fitted_calibration_metrics(spark, folder):
    return short(calibration.calibration_metrics(fitted_scores(spark, folder), ["cohort", "method"]))


@register("fitted_auc_intervals", "R6")
def fitted_auc_intervals(spark, folder):
    """Paired bootstrap of nested and non-nested AUROC of the fitted scores."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("p"))).alias(m)
    paired = fitted_scores(spark, folder).groupBy("cohort", "id").agg(F.min("y_true").alias("y_true"), pick("nested"), pick("non_nested"))
    return short(bootstrap.paired_auc_interval(paired, ["cohort"], "nested", "non_nested"))


# Sensitivity scenarios --------------------------------------------------------------------------------


def scenario_analyses(spark, folder, name):
    """(nested, non-nested, design) of a settings scenario or of an alternative labelling."""
    if name in SCENARIOS:
        return nested(spark, folder, name), non_nested(spark, folder, name)
    cells, samples = population(spark, folder, name)
    return (
        _once(spark, folder, f"nested-{name}", lambda: validation.nested(cells, samples, PRIMARY)),
        _once(spark, folder, f"non_nested-{name}", lambda: validation.non_nested(cells, samples, PRIMARY)),
    )


def scenario_deltas(spark, folder, name):
    full, none = scenario_analyses(spark, folder, name)
    return schedule.deltas(full.predictions, none.predictions, name)


def _scenario_query(name):
    def build(spark, folder):
        both = scenario_deltas(spark, folder, "primary").unionByName(scenario_deltas(spark, folder, name))
        fields = ["nested_roc_auc", "non_nested_roc_auc", "delta_roc_auc"]
        changed = compare.change_from_primary(both, fields)
        return rounded(
            changed.select("cohort", "scenario", "n_samples", "n_positive", *fields, *[f"change_{f}" for f in fields]),
            *fields, *[f"change_{f}" for f in fields], digits=5,
        )

    return build


for _name in ("knn", "kmax30", "outer3", "reggrid", "stable_as_negative", "stable_as_positive", "scale_aware"):
    _covers = "M20" if _name in SCENARIOS else "M20 M24" if _name == "scale_aware" else "M20 P23"
    register(f"scenario_comparison_{_name}", _covers)(_scenario_query(_name))


@register("scenario_boundary_counts", "M20 A21")
def scenario_boundary_counts(spark, folder):
    """Choices on the ends of the expanded grid, nested fits."""
    from foldwise.operators.selection import boundary_counts

    design, tuned = SCENARIOS["reggrid"], nested(spark, folder, "reggrid").tuned
    chosen = tuned.best.select(*OUTER, F.col("C").alias("en_C"), F.col("l1_ratio").alias("en_l1_ratio")).join(
        tuned.choice.select(*OUTER, "l2_C"), OUTER
    )
    return boundary_counts(chosen, ["cohort"], {"en_C": design.en_c, "en_l1_ratio": design.en_l1, "l2_C": design.l2_c})


def vector_matrix(spark, folder):
    """(cells, samples) of the embedding vectors: one wide cohort, signed features, identity rule."""

    def build():
        rows = b.table(spark, folder, "embeddings").select(
            F.lit("VECTORS").alias("cohort"),
            F.col("vec_id").cast("string").alias("id"),
            (F.col("label") < 5).cast("int").alias("y"),
            "embedding",
        )
        cells = rows.select("cohort", "id", F.posexplode("embedding").alias("i", "v")).select(
            "cohort",
            "id",
            F.concat(F.lit("v"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("feature"),
            F.col("v").cast("double").alias("value"),
            F.lit("identity").alias("transform"),
            F.lit(False).alias("half_minimum_allowed"),
            F.lit("linear").alias("input_scale"),
        )
        return settle(cells), settle(rows.select("cohort", "id", "y"))

    return _once(spark, folder, "vector-matrix", build)


def vectors(spark, folder, scenario="primary"):
    """Full-data signature of the vectors."""
    return _once(
        spark, folder, f"vectors-{scenario}",
        lambda: validation.full_data_signature(*vector_matrix(spark, folder), SCENARIOS[scenario]),
    )


@register("vector_matrix_signature", "M13 M9 S3")
def vector_matrix_signature(spark, folder):
    done = vectors(spark, folder)
    return rounded(fitting.model_coefficients(done.models, done.order, ["cohort"]), "coef", digits=5)


@register("vector_size_limits", "M11 M20 P19")
def vector_size_limits(spark, folder):
    """The size chosen under either limit, and whether it sits on the limit: more features than sizes."""
    parts = []
    for name in ("primary", "kmax30"):
        limit = F.lit(SCENARIOS[name].max_k)
        choice = vectors(spark, folder, name).tuned.choice
        parts.append(
            choice.select("cohort", F.lit(name).alias("scenario"), limit.alias("max_k"), "k_selected", (F.col("k_selected") == limit).alias("at_limit"))
        )
    return parts[0].unionByName(parts[1])


# Second stage: scenarios scheduled out of the primary results ---------------------------------------------

# The vectors have ten times the features of the other cohorts; their plans are repeated once.
WIDE = replace(PRIMARY, outer_repeats=1, inner_repeats=1)


def _matrices(spark, folder):
    """(cells, samples, design, nested, non-nested) of every matrix, primary scenario."""
    cells, samples = vector_matrix(spark, folder)
    return [
        (*inputs(spark, folder), PRIMARY, nested(spark, folder), non_nested(spark, folder)),
        (
            cells, samples, WIDE,
            _once(spark, folder, "vectors-nested", lambda: validation.nested(cells, samples, WIDE)),
            _once(spark, folder, "vectors-non_nested", lambda: validation.non_nested(cells, samples, WIDE)),
        ),
    ]


def _plan(spark, folder):
    def build():
        outcomes = [
            schedule.primary_outcomes(samples, full.tuned.choice, full.predictions, design.max_k)
            for _, samples, design, full, _ in _matrices(spark, folder)
        ]
        return settle(schedule.schedule(reduce(DataFrame.unionByName, outcomes)))

    return _once(spark, folder, "plan", build)


@register("sensitivity_schedule", "U6 P19")
def sensitivity_schedule(spark, folder):
    """Scenarios of every cohort, as its primary fits ask for them."""
    return _plan(spark, folder)


@register("scheduled_size_comparison", "M20 P19 U6")
def scheduled_size_comparison(spark, folder):
    """The larger size limit, fitted for the cohorts at the ceiling alone, against their primary fits."""
    name, plan = "kmax30", _plan(spark, folder)
    deltas, parts, choices = [], [], []
    for cells, samples, design, full, none in _matrices(spark, folder):
        deltas.append(schedule.deltas(full.predictions, none.predictions, "primary"))
        choices.append(full.tuned.choice.select("cohort", F.lit("primary").alias("scenario"), "k_selected"))
        if schedule.of_scenario(samples, plan, name).isEmpty():
            continue
        # One matrix may be scheduled while the other is not.
        wide_full, wide_none = _once(
            spark, folder, f"scheduled-{name}-{design.outer_repeats}",
            lambda c=cells, s=samples, d=design: schedule.run(c, s, plan, name, d),
        )
        parts.append(schedule.deltas(wide_full.predictions, wide_none.predictions, name))
        choices.append(wide_full.tuned.choice.select("cohort", F.lit(name).alias("scenario"), "k_selected"))
    table = schedule.against_primary(reduce(DataFrame.unionByName, deltas), parts, reduce(DataFrame.unionByName, choices))
    return rounded(table, *schedule.SIZES, *[f"change_{c}" for c in schedule.SIZES], digits=5)


# Fitted bundles -------------------------------------------------------------------------------------------

CTES["b_fit_sample"] = """
SELECT cohort, id, CASE WHEN substr(md5('noise' || id), 1, 1) < '3' THEN 1 - y ELSE y END AS y FROM b_variant WHERE variant = 'primary'"""
CTES["b_fit_fold"] = folds_sql("b_fit_sample", "cohort", "repeat", "outer_fold", PRIMARY.outer_splits, PRIMARY.outer_repeats, "'outer'")


def bundle(spark, folder):
    """The primary nested analysis of every cohort, committed to a bundle and read back from it."""

    def build():
        cells, samples = inputs(spark, folder)
        plan = samples.select("cohort", F.lit("primary").alias("scenario")).distinct()
        root = f"{checkpoint_folder(spark)}/bundle-{uuid4().hex}"
        finished = ledger.fit_unfinished(cells, samples, plan, root, "1", PRIMARY, lambda *_: nested(spark, folder))
        return ledger.bundle(spark, root, settle(finished))

    return _once(spark, folder, "bundle", build)


@register(
    "fitted_bundle_counts",
    "S8 S9 S10 A24",
    f"""
SELECT cohort, 'primary' AS scenario, t AS "table", CAST(e AS BIGINT) AS expected, CAST(e AS BIGINT) AS found FROM (
  SELECT cohort, unnest(['predictions', 'models', 'choice', 'best', 'repeat_metrics']) AS t,
    unnest([n * {PRIMARY.outer_repeats}, splits * {PRIMARY.outer_repeats}, splits * {PRIMARY.outer_repeats}, splits * {PRIMARY.outer_repeats}, {PRIMARY.outer_repeats}]) AS e
  FROM (SELECT cohort, count(*) AS n, least({PRIMARY.outer_splits}, sum(y), count(*) - sum(y)) AS splits FROM b_fit_sample GROUP BY cohort))""",
)
def fitted_bundle_counts(spark, folder):
    """Rows of every table of the bundle against those that the design asks for."""
    return ledger.count_report(bundle(spark, folder), inputs(spark, folder)[1], "primary", PRIMARY)


FB = fault_sql("fitted", "repeat", "id")


@register(
    "fitted_predictions_vs_plan",
    "V1 M12 S8",
    f"""
SELECT cohort, repeat, outer_fold, id, CASE {FB} WHEN '00' THEN 'fold_differs' WHEN '01' THEN 'label_differs' ELSE 'missing' END AS problem
FROM (SELECT cohort, id, outer_fold, CAST(repeat AS INTEGER) AS repeat FROM b_fit_fold) WHERE {FB} IN ('00', '01', '02')""",
)
def fitted_predictions_vs_plan(spark, folder):
    """The bundle with moved folds, flipped labels and dropped rows: exactly these differ from the rebuilt plan."""
    tables, bad = bundle(spark, folder), fault("fitted", F.col("repeat").cast("string"), "id")
    predictions = tables["predictions"].where(bad != "02").withColumns(
        {
            "outer_fold": F.when(bad == "00", F.col("outer_fold") % PRIMARY.outer_splits + 1).otherwise(F.col("outer_fold")),
            "y_true": F.when(bad == "01", 1 - F.col("y_true")).otherwise(F.col("y_true")),
        }
    )
    found = ledger.problems({**tables, "predictions": predictions}, inputs(spark, folder)[1], "primary", PRIMARY)
    return found.where("table = 'predictions'").select("cohort", "repeat", "outer_fold", F.col("subject").alias("id"), "problem")


# One hash digit per fit plants at most one fault there; ranks are moved rather than removed, so that nothing follows from it.
FIT_FAULT, REPEAT_FAULT = fault_sql("bundle", "cohort", "repeat", "outer_fold", n=1), fault_sql("bundle", "cohort", "repeat", n=1)


@register(
    "fitted_bundle_problems",
    "V2 V3 V4 V5 V6 M11 M12",
    f"""
SELECT cohort, t AS "table", problem, count(*) AS rows, min(subject) AS first_subject FROM (
  SELECT cohort, {FIT_FAULT} AS digit FROM (SELECT DISTINCT cohort, repeat, outer_fold FROM b_fit_fold)
  UNION ALL SELECT cohort, CASE WHEN {REPEAT_FAULT} < '4' THEN 'metric' END FROM (SELECT DISTINCT cohort, repeat FROM b_fit_fold)) f
JOIN (VALUES ('0', 'choice', 'C_not_on_grid', 'choice'), ('1', 'choice', 'size_out_of_range', 'choice'), ('1', 'choice', 'size_beyond_ranking', 'choice'),
  ('2', 'best', 'C_not_on_grid', 'point'), ('3', 'ranking', 'ranks_broken', 'rank'), ('metric', 'repeat_metrics', 'not_reproduced', 'brier')) k(digit, t, problem, subject) USING (digit)
GROUP BY ALL""",
)
def fitted_bundle_problems(spark, folder):
    """Choices, rankings, models and saved metrics of the bundle with planted faults: these are found, and no others."""
    tables = bundle(spark, folder)
    bad = fault("bundle", "cohort", F.col("repeat").cast("string"), F.col("outer_fold").cast("string"), n=1)
    moved = fault("bundle", "cohort", F.col("repeat").cast("string"), n=1)
    planted = {
        **tables,
        "choice": tables["choice"].withColumn("l2_C", F.when(bad == "0", 7.0).otherwise(F.col("l2_C"))).withColumn(
            "k_selected", F.when(bad == "1", PRIMARY.max_k + 1).otherwise(F.col("k_selected"))
        ),
        "best": tables["best"].withColumn("C", F.when(bad == "2", 0.02).otherwise(F.col("C"))),
        "ranking": tables["ranking"].withColumn("rank", F.when(bad == "3", F.col("rank") + 1).otherwise(F.col("rank"))),
        "repeat_metrics": tables["repeat_metrics"].withColumn("brier", F.when(moved < "4", F.col("brier") * 1.01).otherwise(F.col("brier"))),
    }
    found = ledger.problems(planted, inputs(spark, folder)[1], "primary", PRIMARY)
    return found.groupBy("cohort", "table", "problem").agg(F.count(F.lit(1)).alias("rows"), F.min("subject").alias("first_subject"))
