"""Inner-resampling scores and coefficients bound to the driver tables.

They have the shape a fit produces, one row per (outer fit, inner resample, grid point or feature),
but their values come from hashes and from aggregates over the validation rows, so that the choices
made from them can be checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalars import hash_uniform
from foldwise.operators.resample import INNER_REPEATS, INNER_SPLITS, inner_folds
from foldwise.plans.design import EN_C_GRID, EN_L1_GRID, L2_C_GRID, MAX_K
from foldwise.session import settle
from foldwise.sources.bindings import folds, table

FIT = ["cohort", "repeat", "outer_fold"]
RESAMPLE = [*FIT, "inner_repeat", "inner_fold"]


def outer_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The outer folds, settled, for queries that read them beside the inner resamples.

    In an explicit number of parts: each row fans out into training sets and inner repeats, or into features.
    """
    width = 3 * spark.sparkContext.defaultParallelism
    return settle(folds(spark, folder).repartition(width, "id"))


def resamples(spark: SparkSession, folder: str, outer: DataFrame | None = None) -> DataFrame:
    """One row per inner resample with the mean hash of its validation rows, settled.

    The tables below are drawn from these few rows; a query that needs several hands them the same ones.
    """
    # A sample's hash is taken before its rows multiply over the inner resamples.
    outer = (outer_plan(spark, folder) if outer is None else outer).withColumn("_u", hash_uniform("base", F.col("id")))
    means = inner_folds(outer, ["cohort"], INNER_SPLITS, INNER_REPEATS, "_u")
    return settle(means.select(*RESAMPLE, F.round("_u", 6).alias("base")))


def _grid(values):
    return F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(values)]))


def _auc(purpose, *points):
    key = hash_uniform(purpose, *[F.col(c) for c in RESAMPLE], *points)
    return F.round(0.5 + 0.2 * F.col("base") + 0.2 * key, 3)


def grid_aucs(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """RESAMPLE, C, l1_ratio, auc over the elastic-net grid."""
    return (
        (resamples(spark, folder) if base is None else base)
        .withColumn("c", _grid(EN_C_GRID))
        .withColumn("l", _grid(EN_L1_GRID))
        .select(*RESAMPLE, F.col("c.v").alias("C"), F.col("l.v").alias("l1_ratio"), _auc("auc", F.col("c.i"), F.col("l.i")).alias("auc"))
    )


def k_aucs(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """RESAMPLE, k, C, auc over k = 1..MAX_K and the L2 grid."""
    return (
        (resamples(spark, folder) if base is None else base)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(MAX_K))))
        .withColumn("c", _grid(L2_C_GRID))
        .select(*RESAMPLE, "k", F.col("c.v").alias("C"), _auc("kauc", F.col("k"), F.col("c.i")).alias("auc"))
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """(cohort, feature): the same 25 feature names in every cohort."""
    cohorts = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("cohort")).distinct()
    names = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(F.lit("v"), i.cast("string")))
    return cohorts.withColumn("feature", F.explode(names))


def coefficients(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """RESAMPLE, feature, coef: NULL when ineligible, exact zeros when shrunk away."""
    u = hash_uniform("coef", *[F.col(c) for c in RESAMPLE], F.col("feature"))
    strength = hash_uniform("strength", F.col("feature"))
    drawn = F.round(u - 0.5 + F.col("base") * 0.1, 4)
    coef = F.when(u < 0.1, None).when(u < 0.2 + 0.6 * strength, 0.0).otherwise(drawn)
    return (
        (resamples(spark, folder) if base is None else base)
        .join(features(spark, folder), "cohort")
        .select(*RESAMPLE, "feature", coef.alias("coef"))
    )


def final_coefficients(spark: SparkSession, folder: str, selected: DataFrame) -> DataFrame:
    """Coefficients of the selected features in the outer fit; some drop out there."""
    u = hash_uniform("final", *[F.col(c) for c in FIT], F.col("feature"))
    return selected.where(u >= 0.1).select(*FIT, "feature", F.round(u - 0.6, 4).alias("coef"))
