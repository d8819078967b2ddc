"""Exact paired tests over the differences of a group, and cohort omission summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def signed_rank_tail(doubled: np.ndarray, plus: int) -> float:
    """Share of all sign vectors whose rank sum lies as far from the middle as ``plus`` or farther.

    ``doubled`` holds twice the mid-ranks, so all sums are integers. The distribution of the sum is built
    one rank at a time: n steps over n(n+1) + 1 places, exact while 2^-n is a normal number.
    """
    total = int(doubled.sum())
    share = np.zeros(total + 1)
    share[0], top = 1.0, 0
    for r in doubled.tolist():
        moved = share[: top + 1].copy()
        share[: top + 1] *= 0.5
        share[r : r + top + 1] += 0.5 * moved
        top += r
    return float(min(1.0, share[np.abs(2 * np.arange(total + 1) - total) >= abs(2 * plus - total)].sum()))


def sign_tail(n: int, k: int) -> float:
    """P(at most k of n) for fair signs: exact up to n = 1000, beyond that as the largest term times its ratios."""
    if n <= 1000:
        return sum(math.comb(n, i) for i in range(k + 1)) / 2**n
    largest = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    ratio, term, i = 1.0, 1.0, k
    while i > 0 and term > 1e-18 * ratio:
        term *= i / (n - i + 1)
        ratio += term
        i -= 1
    return math.exp(largest) * ratio


@F.pandas_udf(T.DoubleType())
def _signed_rank_p(doubled: pd.Series, plus: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_tail(np.asarray(d, np.int64), int(p)) for d, p in zip(doubled, plus)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _sign_p(n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, 2 * sign_tail(int(a), int(b))) for a, b in zip(n, k)], dtype=float)


def signed_rank(deltas: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Exact two-sided signed-rank test: all sign vectors, zeros dropped, mid-ranks for ties.

    ``enumerations`` is the number of sign vectors; NULL where it is beyond a long (more than 62
    differences), the p-value is given at any size.
    """
    groups = list(groups)
    v = F.col(value)
    counts = deltas.groupBy(*groups).agg(
        F.count(v).alias("n_total"), F.count_if(v == 0).alias("n_zero"), F.count_if(v != 0).alias("n_nonzero")
    )
    # Equal differences share a rank, so only distinct ones are ordered.
    ties = deltas.where(v != 0).groupBy(*groups, F.abs(v).alias("_abs")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(v > 0).alias("_plus")
    )
    before = Window.partitionBy(*groups).orderBy("_abs").rowsBetween(Window.unboundedPreceding, -1)
    doubled = 2 * F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_n") + 1
    tested = (
        ties.withColumn("_doubled", doubled)
        .groupBy(*groups)
        .agg(
            F.sum(F.col("_doubled") * F.col("_plus")).alias("_t"),
            F.sum(F.col("_doubled") * F.col("_n")).alias("_sum"),
            F.flatten(F.collect_list(F.array_repeat("_doubled", F.col("_n").cast("int")))).alias("_ranks"),
        )
        .withColumn("_p", _signed_rank_p("_ranks", "_t"))
    )
    full = counts.join(tested, groups, "left")
    none = F.col("n_nonzero") == 0
    return full.select(
        *groups,
        F.when(none, 1.0).otherwise(F.col("_p")).alias("p_value"),
        "n_total",
        "n_nonzero",
        "n_zero",
        F.when(none, 0.0).otherwise(F.col("_t") / 2).alias("t_plus"),
        F.when(none, 0.0).otherwise(F.col("_sum") / 2).alias("rank_sum"),
        F.when(F.col("n_nonzero") <= 62, F.expr("shiftleft(1L, cast(n_nonzero AS int))")).alias("enumerations"),
    )


def sign_test(deltas: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Exact two-sided sign test: twice the smaller binomial(n, 1/2) tail, at most 1."""
    v = F.col(value)
    counts = deltas.groupBy(*groups).agg(
        F.count(v).alias("n_total"),
        F.count_if(v > 0).alias("n_positive"),
        F.count_if(v < 0).alias("n_negative"),
        F.count_if(v == 0).alias("n_zero"),
    )
    n = F.col("n_positive") + F.col("n_negative")
    return counts.withColumn("n_nonzero", n).withColumn("p_value", _sign_p("n_nonzero", F.least("n_positive", "n_negative")))


def formal_inference(deltas: DataFrame, groups: Sequence[str], value: str, required: DataFrame) -> DataFrame:
    """Both tests per group when every required cohort is present, else one not_run row.

    ``required`` is (groups, cohort): the prespecified cohorts of each comparison.
    """
    groups = list(groups)
    matched = required.join(deltas.select(*groups, "cohort", value), [*groups, "cohort"], "left")
    v = F.col(value)
    status = matched.groupBy(*groups).agg(
        F.count_if(v.isNull()).alias("_absent"),
        F.concat_ws("|", F.array_sort(F.collect_list(F.when(v.isNull(), F.col("cohort"))))).alias("missing_cohorts"),
        F.count(F.lit(1)).alias("n_cohorts"),
        F.percentile(v, F.lit(0.5)).alias("median_delta"),
        F.min(v).alias("min_delta"),
        F.max(v).alias("max_delta"),
    )
    ready = matched.join(status.where("_absent = 0").select(*groups), groups, "left_semi")
    tests = (
        signed_rank(ready, groups, value)
        .select(*groups, F.lit("signed_rank").alias("test"), "p_value", "n_nonzero")
        .unionByName(
            sign_test(ready, groups, value).select(*groups, F.lit("sign").alias("test"), "p_value", "n_nonzero")
        )
    )
    done = status.where("_absent = 0").join(tests, groups).withColumn("status", F.lit("completed"))
    not_run = status.where("_absent > 0").select(
        *groups,
        "_absent",
        "missing_cohorts",
        "n_cohorts",
        *[F.lit(None).cast("double").alias(c) for c in ("median_delta", "min_delta", "max_delta")],
        F.lit("not_run").alias("test"),
        F.lit(None).cast("double").alias("p_value"),
        F.lit(None).cast("long").alias("n_nonzero"),
        F.lit("missing_prespecified_cohorts").alias("status"),
    )
    return done.unionByName(not_run).drop("_absent")


def omission_summaries(deltas: DataFrame, groups: Sequence[str], value: str, subset_without: str) -> DataFrame:
    """Cohort summaries over all cohorts, with each one left out, and without a named cohort.

    There is one delta per cohort. They are sorted once per group; a summary that omits the cohort
    at position r reads the same sorted list with that position skipped, so no pairs are formed.
    An empty subset keeps its row with NULL statistics.
    """
    groups = list(groups)
    listed = deltas.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct(F.col(value).alias("d"), F.col("cohort")))).alias("_all"),
        F.count(F.lit(1)).alias("n_source_cohorts"),
    )
    scenario = lambda kind, cohort: F.struct(F.lit(kind).alias("summary"), cohort.alias("excluded"))
    present = F.exists("_all", lambda e: e["cohort"] == subset_without)
    scenarios = F.concat(
        F.array(scenario("all_available", F.lit(""))),
        F.transform("_all", lambda e: scenario("omit_one", e["cohort"])),
        F.array(scenario("named_subset", F.when(present, F.lit(subset_without)).otherwise(""))),
    )
    rows = listed.select(*groups, "_all", "n_source_cohorts", F.explode(scenarios).alias("s")).select(
        *groups,
        "n_source_cohorts",
        "s.*",
        F.filter("_all", lambda e: e["cohort"] != F.col("s.excluded")).alias("_kept"),
    )
    m = F.size("_kept")
    at = lambda i: F.when(m > 0, F.get("_kept", i.cast("int"))["d"])
    return rows.select(
        *groups,
        "summary",
        F.col("excluded").alias("excluded_cohort"),
        "n_source_cohorts",
        m.cast("long").alias("n_retained"),
        F.when(m > 0, "available").otherwise("no_retained_cohorts").alias("status"),
        (F.aggregate("_kept", F.lit(0.0), lambda a, e: a + e["d"]) / F.nullif(m, F.lit(0))).alias("mean_delta"),
        ((at(F.floor((m - 1) / 2)) + at(F.floor(m / 2))) / 2).alias("median_delta"),
        at(F.lit(0)).alias("minimum_delta"),
        at(m - 1).alias("maximum_delta"),
    )
