"""Calibration: prior adjustment, evaluation units, quantile bins, recalibration fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.scalars import expit, logit, prior_adjusted, wilson
from foldwise.operators.metrics import discrimination
from foldwise.operators.ordered import running
from foldwise.session import settle

# Number of bins, parameter bounds, constant-logit tolerance.
CALIBRATION_BINS = 10
INTERCEPT_BOUND, SLOPE_BOUND, BOUND_TOL = 50.0, 25.0, 1e-5
CONSTANT_LOGIT = 1e-12
MAX_NEWTON, NEWTON_TOL, LOSS_TOL = 100, 1e-9, 1e-12
# A fit whose last step is larger has not converged. Tables and resampling tasks share all of these limits.
STILL = 1e-6
STATE = ["_s1", "_s2", "a0", "a", "b", "a0_ok", "a_ok", "b_ok", "f0", "f"]
# Newton steps chained in one job before the parameters are settled and tested.
STEPS_PER_ROUND = 4
VARIANTS = ["raw", "prior_adjusted"]


def with_prior_adjustment(predictions: DataFrame, counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the training counts of each prediction's fold or split and its prior-adjusted score."""
    params = settle(counts.select(*on, "train_n", "train_positive", "train_negative"))
    return predictions.join(F.broadcast(params), list(on), "left").withColumn(
        "p_prior_adjusted", prior_adjusted("p", "train_positive", "train_negative")
    )


def evaluation_units(cv: DataFrame, holdout_test: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Every repeat, the averaged OOF and every holdout split, raw and prior-adjusted, in long form.

    Scores are adjusted per fold *before* they are averaged over repeats (the two do not commute).
    """
    keys = [*groups, "method"]

    def long(df: DataFrame, unit_type: str, unit_id: Column) -> DataFrame:
        return df.select(
            *keys,
            F.lit(unit_type).alias("unit_type"),
            unit_id.cast("int").alias("unit_id"),
            "id",
            "y_true",
            F.col("p").alias("raw"),
            F.col("p_prior_adjusted").alias("prior_adjusted"),
        )

    averaged = cv.groupBy(*keys, "id").agg(
        F.min("y_true").alias("y_true"),
        F.round(F.avg("p"), 12).alias("p"),
        F.round(F.avg("p_prior_adjusted"), 12).alias("p_prior_adjusted"),
    )
    units = (
        long(cv, "repeat", F.col("repeat"))
        .unionByName(long(averaged, "averaged_oof", F.lit(0)))
        .unionByName(long(holdout_test, "holdout_split", F.col("split")))
    )
    return units.unpivot(
        [*keys, "unit_type", "unit_id", "id", "y_true"], VARIANTS, "probability_variant", "p"
    )


def is_primary_unit(method: str = "method", unit_type: str = "unit_type", unit_id: str = "unit_id") -> Column:
    """Averaged OOF for cross-validated methods, split 1 for the holdout."""
    holdout = F.col(method) == "holdout"
    return F.when(holdout, (F.col(unit_type) == "holdout_split") & (F.col(unit_id) == 1)).otherwise(
        F.col(unit_type) == "averaged_oof"
    )


def calibration_bins(
    scores: DataFrame, groups: Sequence[str], score: str = "p", label: str = "y_true", bins: int = CALIBRATION_BINS
) -> DataFrame:
    """Quantile bins: interpolated edges, duplicate edges dropped, right-closed, renumbered from 1.

    The number of bins is min(bins, n, distinct scores). Edge j sits at sorted position
    (n - 1) * j / q, computed in integers; the bin of a score is the number of edges below it.
    """
    groups = list(groups)
    c = running(
        scores, groups, score, {"n": F.count(F.lit(1)), "pos": F.sum(F.col(label).cast("long"))}
    ).withColumn("_q", F.least(F.lit(bins).cast("long"), "n_total", "distinct_total"))
    span = F.col("n_total") - 1
    inside = lambda t: (t >= F.col("n_below")) & (t < F.col("n_below") + F.col("n"))
    edge_parts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_q")),
        lambda j: F.struct(
            j.alias("j"),
            F.floor(span * j / F.col("_q")).alias("low"),
            F.pmod(span * j, F.col("_q")).alias("rem"),
        ),
    )
    touched = F.filter(edge_parts, lambda e: inside(e["low"]) | ((e["rem"] > 0) & inside(e["low"] + 1)))
    parts = c.select(*groups, score, "n_below", "n", "_q", F.explode(touched).alias("e"))
    v = F.col(score)
    low = F.max(F.when(inside(F.col("e.low")), v))
    high = F.max(F.when(inside(F.col("e.low") + 1), v))
    share = F.first(F.col("e.rem")) / F.first("_q")
    edges = (
        parts.groupBy(*groups, "e.j")
        .agg(F.when(F.first("e.rem") == 0, low).otherwise(low + (high - low) * share).alias("edge"))
        .groupBy(*groups)
        .agg(F.collect_set("edge").alias("_edges"))
    )
    raw_bin = F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < v)))
    binned = (
        c.join(F.broadcast(settle(edges)), groups)
        .withColumn("_bin", raw_bin)
        .groupBy(*groups, "_bin")
        .agg(
            F.sum("n").alias("n"),
            F.sum("pos").alias("n_positive"),
            (F.sum(v * F.col("n")) / F.sum("n")).alias("predicted_mean"),
            F.min(v).alias("predicted_min"),
            F.max(v).alias("predicted_max"),
        )
    )
    lower, upper = wilson("n_positive", "n")
    return binned.select(
        *groups,
        F.row_number().over(Window.partitionBy(*groups).orderBy("_bin")).alias("bin"),
        "n",
        "n_positive",
        "predicted_mean",
        (F.col("n_positive") / F.col("n")).alias("observed_rate"),
        "predicted_min",
        "predicted_max",
        lower.alias("observed_rate_wilson95_low"),
        upper.alias("observed_rate_wilson95_high"),
    )


def recalibration(
    scores: DataFrame,
    groups: Sequence[str],
    score: str = "p",
    label: str = "y_true",
    weight: Column | None = None,
) -> DataFrame:
    """Calibration intercept (slope fixed at 1) and free intercept/slope of every group at once.

    The likelihood depends on the scores only through class counts per distinct score, so the rows
    are reduced to those once and settled. Each Newton iteration is one grouped aggregate over them;
    the parameters (three numbers per group) are settled between iterations.
    """
    groups = list(groups)
    w = F.lit(1) if weight is None else weight
    counts = settle(
        scores.groupBy(*groups, logit(score).alias("z")).agg(
            F.sum(w * F.col(label)).cast("double").alias("pos"),
            F.sum(w * (1 - F.col(label))).cast("double").alias("neg"),
        )
    )
    z = F.col("z")
    summary = counts.groupBy(*groups).agg(
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
        F.min(F.when(F.col("pos") > 0, z)).alias("pos_min"),
        F.max(F.when(F.col("pos") > 0, z)).alias("pos_max"),
        F.min(F.when(F.col("neg") > 0, z)).alias("neg_min"),
        F.max(F.when(F.col("neg") > 0, z)).alias("neg_max"),
    )
    both = (F.col("P") > 0) & (F.col("N") > 0)
    spread = F.greatest("pos_max", "neg_max") - F.least("pos_min", "neg_min")
    separated = (F.col("neg_max") <= F.col("pos_min")) | (F.col("pos_max") <= F.col("neg_min"))
    state = settle(
        summary.select(
            *groups,
            F.when(both, "ok").otherwise("both_classes_required").alias("_s1"),
            F.when(~both, "both_classes_required")
            .when(spread <= CONSTANT_LOGIT, "nonidentifiable_constant_logit")
            .when(separated, "nonidentifiable_complete_or_quasi_separation")
            .otherwise("ok")
            .alias("_s2"),
            # Starts: no shift, and the constant score at the event rate.
            F.lit(0.0).alias("a0"),
            F.when(both, F.log(F.col("P") / F.col("N"))).otherwise(0.0).alias("a"),
            F.lit(0.0).alias("b"),
            *[F.lit(0.0).alias(f"{x}_ok") for x in ("a0", "a", "b")],
            *[F.lit(float("inf")).alias(x) for x in ("f0", "f", "step")],
        )
    )
    for _ in range(MAX_NEWTON // STEPS_PER_ROUND):
        for _ in range(STEPS_PER_ROUND):
            state = _newton_step(counts, state, groups)
        state = settle(state)
        largest = state.agg(F.max("step")).first()[0]
        if largest is None or largest < NEWTON_TOL:
            break
    ok1 = (F.col("_s1") == "ok") & (F.abs("a0") < INTERCEPT_BOUND)
    bounded = (F.abs("a") < SLOPE_BOUND - BOUND_TOL) & (F.abs("b") < SLOPE_BOUND - BOUND_TOL)
    moving = F.col("step") > STILL
    s2 = (
        F.when(F.col("_s2") != "ok", F.col("_s2"))
        .when(~bounded, "fit_failed:parameter_bound_reached")
        .when(moving, "fit_failed:not_converged")
        .otherwise("ok")
    )
    return state.select(
        *groups,
        F.when(ok1, F.col("a0")).alias("calibration_intercept"),
        F.when(s2 == "ok", F.col("b")).alias("calibration_slope"),
        F.when(s2 == "ok", F.col("a")).alias("recalibration_intercept_free"),
        F.when((F.col("_s1") == "ok") & ~ok1, "fit_failed:parameter_bound_reached")
        .otherwise(F.col("_s1"))
        .alias("calibration_intercept_status"),
        s2.alias("calibration_slope_status"),
    )


def _newton_step(counts: DataFrame, state: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Judge the current candidates of both fits of every group and propose the next ones.

    A join and one grouped aggregate. A candidate that raised the loss is moved halfway back to the
    last accepted point; an accepted one is followed by a full Newton step.
    """
    z, m = F.col("z"), F.col("pos") + F.col("neg")
    eta0, eta = F.col("a0") + z, F.col("a") + F.col("b") * z
    q0, q = expit(eta0), expit(eta)
    loss = lambda x: m * (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))) - F.col("pos") * x
    sums = (
        counts.join(F.broadcast(state), groups)
        .groupBy(*groups)
        .agg(
            # The state rides through the aggregate, so chained steps read it once each.
            *[F.first(c).alias(c) for c in STATE],
            F.sum(loss(eta0)).alias("f0_now"),
            F.sum(m * q0 - F.col("pos")).alias("s"),
            F.sum(m * q0 * (1 - q0)).alias("h"),
            F.sum(loss(eta)).alias("f_now"),
            F.sum(m * q - F.col("pos")).alias("g0"),
            F.sum((m * q - F.col("pos")) * z).alias("g1"),
            F.sum(m * q * (1 - q)).alias("h00"),
            F.sum(m * q * (1 - q) * z).alias("h01"),
            F.sum(m * q * (1 - q) * z * z).alias("h11"),
        )
    )
    worse = lambda now, before: F.col(now) > F.col(before) + LOSS_TOL * (1 + F.abs(now))
    back0, back = worse("f0_now", "f0"), worse("f_now", "f")
    det = F.nullif(F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01"), F.lit(0.0))
    half = lambda x: (F.col(x) + F.col(f"{x}_ok")) / 2
    far = (F.abs("a") > 2 * SLOPE_BOUND) | (F.abs("b") > 2 * SLOPE_BOUND)
    # A group that cannot move: no solution is wanted, or the optimum lies beyond the bounds.
    still = (F.col("_s2") != "ok") | (far & ~back)
    step0 = F.col("s") / F.nullif(F.col("h"), F.lit(0.0))
    step_a = (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / det
    step_b = (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / det
    none = F.lit(0.0)
    next0 = F.when(back0, half("a0")).otherwise(F.col("a0") - F.coalesce(step0, none))
    next_a = F.when(still, F.col("a")).when(back, half("a")).otherwise(F.col("a") - F.coalesce(step_a, none))
    next_b = F.when(still, F.col("b")).when(back, half("b")).otherwise(F.col("b") - F.coalesce(step_b, none))
    moved = sums.withColumns({"n0": next0, "na": next_a, "nb": next_b})
    kept = lambda x, is_back: F.when(is_back, F.col(f"{x}_ok")).otherwise(F.col(x))
    active = F.col("_s1") == "ok"
    return moved.select(
        *groups,
        "_s1",
        "_s2",
        F.when(active, F.col("n0")).otherwise(F.col("a0")).alias("a0"),
        F.when(active, F.col("na")).otherwise(F.col("a")).alias("a"),
        F.when(active, F.col("nb")).otherwise(F.col("b")).alias("b"),
        kept("a0", back0).alias("a0_ok"),
        kept("a", back).alias("a_ok"),
        kept("b", back).alias("b_ok"),
        F.when(back0, F.col("f0")).otherwise(F.col("f0_now")).alias("f0"),
        F.when(back, F.col("f")).otherwise(F.col("f_now")).alias("f"),
        F.when(
            active, F.greatest(F.abs(F.col("n0") - F.col("a0")), F.abs(F.col("na") - F.col("a")), F.abs(F.col("nb") - F.col("b")))
        )
        .otherwise(0.0)
        .alias("step"),
    )


def calibration_metrics(scores: DataFrame, groups: Sequence[str], score: str = "p", label: str = "y_true") -> DataFrame:
    """Discrimination, event rate, mean score, recalibration fits and their statuses per group."""
    groups = list(groups)
    scores = settle(scores.select(*groups, label, score))
    means = scores.groupBy(*groups).agg(
        F.avg(F.col(label).cast("double")).alias("event_rate"), F.avg(score).alias("mean_predicted_probability")
    )
    fits = recalibration(scores, groups, score, label)
    ok = (F.col("calibration_intercept_status") == "ok") & (F.col("calibration_slope_status") == "ok")
    return (
        discrimination(scores, groups, score, label)
        .join(means, groups)
        .join(fits, groups)
        .withColumn("calibration_fit_ok", ok)
    )
