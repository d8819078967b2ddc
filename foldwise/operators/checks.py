"""Data-quality checks. Every check returns violation rows; no rows means the table passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.scalars import ABS_TOL, close, finite


def range_violations(df: DataFrame, keys: Sequence[str], limits: dict[str, tuple]) -> DataFrame:
    """Long violation rows for columns outside [low, high] or not integral where required."""
    fields = [
        F.struct(
            F.lit(name).alias("field"),
            F.col(name).cast("double").alias("value"),
            F.when(~finite(F.col(name).cast("double")), "not_finite")
            .when(~F.col(name).between(low, high), "out_of_range")
            .when(F.lit(integer) & (F.col(name) != F.floor(name)), "not_integer")
            .alias("problem"),
        )
        for name, (low, high, integer) in limits.items()
    ]
    return (
        df.select(*keys, F.explode(F.array(*fields)).alias("f"))
        .select(*keys, "f.*")
        .where(F.col("problem").isNotNull())
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def set_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows present a different number of times on the two sides: one shuffle, both directions."""
    side = lambda df, n: df.select(*columns, F.lit(n).alias("_side"))
    counted = (
        side(left, 1)
        .unionByName(side(right, -1))
        .groupBy(*columns)
        .agg(F.count_if(F.col("_side") == 1).alias("left_n"), F.count_if(F.col("_side") == -1).alias("right_n"))
    )
    return counted.where("left_n <> right_n").withColumn(
        "problem",
        F.when(F.col("right_n") == 0, "extra").when(F.col("left_n") == 0, "missing").otherwise("count_differs"),
    )


def disagreement(saved: DataFrame, fresh: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields of a saved table that differ from their recomputation beyond tolerance."""
    joined = saved.select(*keys, *[F.col(f).alias(f"s_{f}") for f in fields], F.lit(True).alias("_s")).join(
        fresh.select(*keys, *[F.col(f).alias(f"f_{f}") for f in fields], F.lit(True).alias("_f")),
        list(keys),
        "full_outer",
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"s_{f}").cast("double").alias("saved"),
                F.col(f"f_{f}").cast("double").alias("recomputed"),
                close(F.col(f"s_{f}").cast("double"), F.col(f"f_{f}").cast("double")).alias("same"),
            )
            for f in fields
        ]
    )
    return (
        joined.select(*keys, F.explode(pairs).alias("d"), (F.col("_s").isNull() | F.col("_f").isNull()).alias("_lone"))
        .where(~F.col("d.same") | F.col("_lone"))
        .select(*keys, "d.field", "d.saved", "d.recomputed")
    )


def violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: ``rules`` maps a problem name to a predicate that marks a violation."""
    marks = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()])
    return df.select(*keys, F.explode(F.array_compact(marks)).alias("problem"))


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself; raises at plan time when a column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def bin_problems(bins: DataFrame, keys: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Violations of a calibration bin table. A unit has a handful of bins, so windows are small.

    ``shared`` are the keys over which every method must cover the same number of rows.
    """
    unit = Window.partitionBy(*keys)
    marked = bins.withColumns(
        {"_place": F.row_number().over(unit.orderBy("bin")), "_total": F.sum("n").over(unit)}
    ).withColumn("_least", F.min("_total").over(Window.partitionBy(*shared)))
    rate = F.col("n_positive") / F.col("n")
    low, high = F.col("observed_rate_wilson95_low"), F.col("observed_rate_wilson95_high")
    return violations(
        marked,
        [*keys, "bin"],
        {
            "positive_exceeds_n": F.col("n_positive") > F.col("n"),
            "rate": ~close(F.col("observed_rate"), rate),
            "interval_order": (low > F.col("observed_rate") + ABS_TOL) | (F.col("observed_rate") > high + ABS_TOL),
            "bin_sequence": F.col("bin") != F.col("_place"),
            "method_totals": F.col("_total") != F.col("_least"),
        },
    )
