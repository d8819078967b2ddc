"""Exact ranks, running totals and order statistics without one task per group.

A plain ``row_number().over(partitionBy(cohort))`` sends a whole cohort to one task. Here a large group
is cut into *cells* whose order follows the sort key, so that

* rows are windowed per (group, cell), which is a small piece of the group;
* only one total per (group, cell) is windowed per group, and the number of cells is fixed.

The position of a row is then ``total of the earlier cells + position inside its own cell``: the
result is exactly that of the single window, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import settle

# A group of up to ONE_TASK_ROWS rows is windowed whole. A larger one is cut into cells of about
# CELL_ROWS rows, more than MOST_CELLS only by more rows in a cell.
ONE_TASK_ROWS = 500_000
CELL_ROWS = 100_000
MOST_CELLS = 4096
# Rank error of the quantile sketch, as a share of a cell.
EDGE_ERROR = 0.1
# Most leading hex digits of a hash used as its cell: 16**3 equally likely cells.
HASH_DIGITS = 3


def number_by_hash(
    df: DataFrame, groups: Sequence[str], digest: Column, tie: str, out: str, largest: int | None = None
) -> DataFrame:
    """Add ``out`` = 1-based row number inside ``groups`` in the order of (digest, tie), and ``group_n``.

    A hash spreads every group evenly over its leading digits, whatever the group's size is. Groups of up to
    ONE_TASK_ROWS rows are numbered whole, larger ones in cells of about CELL_ROWS rows, so the totals of the cells
    stay few beside the rows. ``largest`` is a bound on the rows of a group, for callers that know one.
    """
    groups = list(groups)
    if largest is None:
        largest = largest_group(df, groups)
    keyed = df.where(reduce(and_, [F.col(g).isNotNull() for g in groups])).withColumn("_digest", digest)
    # The bytes have the order of the hex digits at half their length, in shuffles and in comparisons.
    short = F.unhex("_digest")
    if largest <= ONE_TASK_ROWS:
        keyed, whole = keyed.withColumn("_digest", short), Window.partitionBy(*groups)
        return (
            keyed.withColumn(out, F.row_number().over(whole.orderBy("_digest", tie)).cast("long"))
            .withColumn("group_n", F.count(F.lit(1)).over(whole))
            .where(F.col("_digest").isNotNull())
            .drop("_digest")
        )
    keyed = keyed.withColumn("_cell", F.substring("_digest", 1, cell_digits(largest))).withColumn("_digest", short)
    earlier = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*groups, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *groups,
            "_cell",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(*groups)).alias("group_n"),
        )
    )
    inside = Window.partitionBy(*groups, "_cell").orderBy("_digest", tie)
    # The rows lie by (groups, cell) already, so the totals meet them there; they need not pass through the driver.
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets.hint("merge"), [*groups, "_cell"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_digest", "_cell", "_inside", "_before")
    )


def cell_digits(largest: int) -> int:
    """Leading hex digits of a hash that cut a group of ``largest`` rows into cells of about CELL_ROWS rows."""
    return next((d for d in range(1, HASH_DIGITS) if 16**d * CELL_ROWS >= largest), HASH_DIGITS)


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    """Row count of the largest group: one map-side combined aggregate, one number to the driver."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    return sizes.first()[0] or 0


def in_one_task(df: DataFrame, groups: Sequence[str]) -> bool:
    """Whether every group is windowed whole."""
    return largest_group(df, groups) <= ONE_TASK_ROWS


def cut(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Add ``_cell``, non-decreasing in ``value`` inside each group, if any group needs cutting.

    All edges are approximate quantiles, so cells hold similar row counts however the values cluster;
    only equal values are never parted. They are settled: every later use sees the same edges. A row
    finds its cell in two steps, first among every ``side``-th edge, then between two of those.
    """
    groups = list(groups)
    largest = largest_group(df, groups)
    if largest <= ONE_TASK_ROWS:
        return df
    side = max(2, math.isqrt(min(MOST_CELLS, -(-largest // CELL_ROWS)) - 1) + 1)
    n = side * side
    points = F.array(*[F.lit(i / n) for i in range(1, n)])
    edges = df.groupBy(*groups).agg(
        F.percentile_approx(value, points, max(10_000, int(n / EDGE_ERROR))).alias("_edges"), F.count(value).alias("_rows")
    )
    coarse = F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.get("_edges", i * side - 1))
    edges = settle(edges.withColumn("_coarse", coarse))
    v = F.col(value)
    part = F.size(F.filter("_coarse", lambda e: e < v))
    inside = F.size(F.filter(F.slice("_edges", F.col("_part") * side + 1, F.lit(side - 1)), lambda e: e < v))
    wanted = F.least(F.lit(n), F.ceil(F.col("_rows") / CELL_ROWS))
    return (
        df.join(edges, groups)
        .withColumn("_part", F.when(F.col("_rows") > CELL_ROWS, part).otherwise(0))
        .withColumn("_fine", F.col("_part") * side + F.when(F.col("_rows") > CELL_ROWS, inside).otherwise(0))
        .withColumn("_cell", F.floor(F.col("_fine") * wanted / n).cast("int"))
        .drop("_edges", "_coarse", "_part", "_fine", "_rows")
    )


def running(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    counts: dict[str, Column],
    is_cut: bool = False,
) -> DataFrame:
    """One row per (group, distinct value) with its counts, running counts and group totals.

    For every name in ``counts`` the result has ``name`` (at this value), ``name_below`` (all smaller
    values), ``name_total`` and ``name_prev`` (at the next smaller value, NULL for the smallest).
    Equal values are aggregated before they are shuffled by group, so a heavily tied score costs one
    row. ``is_cut`` says that ``df`` went through ``cut`` already, e.g. before it was resampled.
    """
    groups = list(groups)
    names = list(counts)
    if not is_cut:
        df = cut(df, groups, value)
    cells = ["_cell"] if "_cell" in df.columns else []
    distinct = df.groupBy(*groups, *cells, value).agg(*[c.alias(n) for n, c in counts.items()])
    inside = Window.partitionBy(*groups, *cells).orderBy(value)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*groups, *cells)
    if not cells:
        return distinct.select(
            *groups,
            value,
            *names,
            F.count(F.lit(1)).over(total).alias("distinct_total"),
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_below") for n in names],
            *[F.sum(n).over(total).alias(f"{n}_total") for n in names],
            *[F.lag(n).over(inside).alias(f"{n}_prev") for n in names],
        )
    # Two branches read the distinct values, so they are computed and settled once.
    distinct = settle(distinct)
    by_cell = Window.partitionBy(*groups).orderBy("_cell")
    whole = Window.partitionBy(*groups)
    offsets = (
        distinct.groupBy(*groups, "_cell")
        .agg(
            *[F.sum(n).alias(f"_sum_{n}") for n in names],
            *[F.max_by(n, value).alias(f"_last_{n}") for n in names],
            F.count(F.lit(1)).alias("_values"),
        )
        .select(
            *groups,
            "_cell",
            F.sum("_values").over(whole).alias("distinct_total"),
            *[
                F.coalesce(
                    F.sum(f"_sum_{n}").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ).alias(f"_off_{n}")
                for n in names
            ],
            *[F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in names],
            *[F.lag(f"_last_{n}").over(by_cell).alias(f"_lag_{n}") for n in names],
        )
    )
    rows = distinct.select(
        "*",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_in_{n}") for n in names],
        *[F.lag(n).over(inside).alias(f"_prev_{n}") for n in names],
    ).join(offsets, [*groups, "_cell"])
    return rows.select(
        *groups,
        value,
        *names,
        "distinct_total",
        *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(f"{n}_below") for n in names],
        *[f"{n}_total" for n in names],
        *[F.coalesce(f"_prev_{n}", f"_lag_{n}").alias(f"{n}_prev") for n in names],
    )


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, positions: Column) -> DataFrame:
    """Values at 0-based sorted positions; ``positions`` is an array expression over ``n_total`` etc.

    Returns (groups, position, stat, n_total, distinct_total).
    """
    ordered = running(df.where(F.col(value).isNotNull()), groups, value, {"n": F.count(F.lit(1))})
    hit = F.filter(
        F.array_distinct(positions),
        lambda t: (t >= F.col("n_below")) & (t < F.col("n_below") + F.col("n")),
    )
    return ordered.select(
        *groups, "n_total", "distinct_total", F.explode(hit).alias("position"), F.col(value).alias("stat")
    )


def exact_median(df: DataFrame, groups: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group: the mean of the one or two middle order statistics."""
    middle = F.array(F.floor((F.col("n_total") - 1) / 2), F.floor(F.col("n_total") / 2))
    return order_statistics(df, groups, value, middle).groupBy(*groups).agg(F.avg("stat").alias(out))
