"""Exact K-nearest-neighbour imputation of z-scored cells by bounds on blocks of rows.

Incomplete rows and training rows are cut into blocks: rows with the same cells missing stand together, in an order
that keeps close rows close, so a block has a narrow range in every feature. From the ranges alone follows the least
distance that any of its rows can have from a given row. Each incomplete row first opens the nearest blocks of
training rows that hold enough donors; the distances found there bound its k-th neighbour, and it opens no further block
but those whose least distance does not exceed that bound. No other pair of rows is ever compared, and none is emitted
but the k best donors per missing cell and opened block. Rows with a rare pattern of missing cells share mixed blocks,
which have no bound and are always opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.plans.design import NEIGHBORS
from foldwise.session import settle

#: Rows of a block, or the square root of a fit's rows if that is more; rarer patterns than this are mixed.
BLOCK_ROWS = 256
RARE_ROWS = 64
# Distances are compared after rounding so that summation order cannot reorder neighbours.
DISTANCE_DIGITS = 9
#: Rows stand in the order of this many bits, dealt over the features; a fit has at most 2 ** ORDER_BITS places.
ORDER_BITS, FEATURE_BITS = 12, 4
MIXED = "mixed"
#: Blocks of incomplete rows that a task holds while it chooses what they open.
TASK_BLOCKS = 64


def nan_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared NaN-aware Euclidean distances scaled by features / common features; inf if none."""
    total = np.zeros((len(a), len(b)))
    common = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        difference = a[:, j, None] - b[None, :, j]
        present = ~np.isnan(difference)
        total += np.where(present, difference * difference, 0.0)
        common += present
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, total * a.shape[1] / common, np.inf)


# Blocks ----------------------------------------------------------------------------------------------


def _summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    z = np.stack(rows["z"]).astype(float)
    with np.errstate(all="ignore"):
        low = np.where(np.isnan(z).all(0), np.nan, np.nanmin(np.where(np.isnan(z), np.inf, z), axis=0))
        high = np.where(np.isnan(z).all(0), np.nan, np.nanmax(np.where(np.isnan(z), -np.inf, z), axis=0))
    seen = (~np.isnan(z)).sum(0)
    return pd.DataFrame([(*key, len(z), seen, low, high, rows["id"].to_list(), z.astype("<f8").tobytes())])


def make_blocks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pattern, block, n, seen, low, high, ids, cells) from (keys, id, z): settled blocks of bounded size."""
    keys = list(keys)
    some = F.slice("z", F.lit(1), F.lit(ORDER_BITS))
    # Near even for z-scores: the logistic curve that follows the normal distribution.
    even = F.transform(some, lambda c: F.floor(F.lit(2.0**FEATURE_BITS) / (1 + F.exp(-1.702 * F.coalesce(c, F.lit(0.0))))))
    bits = F.transform(even, lambda q: F.lpad(F.bin(F.least(q, F.lit(2**FEATURE_BITS - 1)).cast("bigint")), FEATURE_BITS, "0"))
    woven = F.concat(*[F.array_join(F.expr(f"transform(_bits, x -> substring(x, {j + 1}, 1))"), "") for j in range(FEATURE_BITS)])
    missing = F.array_join(F.transform("z", lambda c: F.when(c.isNull(), "0").otherwise("1")), "")
    rows = rows.select(*keys, "id", "z", missing.alias("_missing"), bits.alias("_bits"))
    rows = settle(rows.withColumn("_code", F.substring(woven, 1, ORDER_BITS)).drop("_bits"))
    kinds = rows.groupBy(*keys, "_missing").agg(F.count(F.lit(1)).alias("_n")).withColumn("pattern", F.when(F.col("_n") >= RARE_ROWS, F.col("_missing")).otherwise(MIXED))
    sizes = kinds.groupBy(*keys).agg(F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.sqrt(F.sum("_n")))).alias("_size"))
    kinds = kinds.drop("_n").join(sizes, keys)
    rows = rows.join(kinds, [*keys, "_missing"])
    counts = rows.groupBy(*keys, "pattern", "_code").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys, "pattern").orderBy("_code").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    placed = rows.join(counts, [*keys, "pattern", "_code"])
    # Rows of one code may be many: they are dealt over the places that their number takes.
    block = F.floor((F.col("_before") + F.pmod(F.xxhash64("id"), F.col("_n"))) / F.col("_size")).cast("int")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", pattern string, block int, n int, seen array<int>, low array<double>, high array<double>, ids array<string>, cells binary"
    return settle(placed.select(*keys, "pattern", block.alias("block"), F.col("id").cast("string").alias("id"), "z").groupBy(*keys, "pattern", "block").applyInPandas(_summary, schema))


def least_distances(z: np.ndarray, donors: pd.DataFrame) -> np.ndarray:
    """For each row and each block of donors the least distance that any of the block's rows can have."""
    width = z.shape[1]
    low, high = np.stack(donors["low"]).astype(float), np.stack(donors["high"]).astype(float)
    mixed = (donors["pattern"] == MIXED).to_numpy()
    total, common = np.zeros((len(z), len(donors))), np.zeros((len(z), len(donors)))
    for j in range(width):
        gap = np.maximum(np.maximum(low[None, :, j] - z[:, j, None], z[:, j, None] - high[None, :, j]), 0.0)
        present = ~np.isnan(gap)  # all rows of a block that is not mixed have the feature, or none
        total += np.where(present, gap * gap, 0.0)
        common += present
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(common > 0, total * width / common, np.inf)
    return np.where(mixed[None], np.where(common > 0, 0.0, np.inf), bound)


def _choose(keys: list[str], k: int, first: bool):
    """Rows and blocks to open: the nearest with enough donors, or all others within the bounds found there."""
    names = [*keys, "pattern", "block", "d_pattern", "d_block", "rows"]

    def run(key: tuple, receivers: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        out = []
        # Both rounds see the blocks in the same order, so that the second knows what the first has opened.
        donors = donors.sort_values(["pattern", "block"])
        if len(receivers) and len(donors):
            seen, d_pattern, d_block = np.stack(donors["seen"]).astype(int), donors["pattern"].to_list(), donors["block"].to_list()
            for receiver in receivers.to_dict("records"):
                z = np.frombuffer(receiver["cells"], "<f8").reshape(receiver["n"], -1)
                least = least_distances(z, donors)
                order = np.argsort(least, axis=1, kind="stable")
                opened = np.zeros(least.shape, bool)
                for j in range(z.shape[1]):
                    own = np.flatnonzero(np.isnan(z[:, j]))
                    # Nearest first, until the blocks before hold k donors of the feature.
                    donors_at = seen[order[own], j]
                    needed = (np.cumsum(donors_at, axis=1) - donors_at < k) & (donors_at > 0)
                    opened[np.repeat(own, needed.sum(1)), order[own][needed]] = True
                opened &= np.isfinite(least)
                if not first:
                    bound = np.full(z.shape, np.inf)
                    place = {i: r for r, i in enumerate(receiver["ids"])}
                    for told in receiver["known"] if receiver["known"] is not None else ():
                        bound[place[told["id"]], told["j"]] = told["far"]
                    near = opened.copy()
                    for j in range(z.shape[1]):
                        own = np.isnan(z[:, j])
                        within = least <= bound[:, j, None] + 2 * 10.0**-DISTANCE_DIGITS
                        opened |= own[:, None] & (seen[None, :, j] > 0) & np.isfinite(least) & within
                    opened &= ~near
                for i in np.flatnonzero(opened.any(axis=0)):
                    out.append((*key[: len(keys)], receiver["pattern"], receiver["block"], d_pattern[i], d_block[i], np.flatnonzero(opened[:, i]).tolist()))
        return pd.DataFrame(out, columns=names)

    return run


def _compare(keys: list[str], k: int):
    names = [*keys, "pattern", "block", "id", "j", "donor", "distance", "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                some = np.asarray(row["rows"], int)
                a = np.frombuffer(row["cells"], "<f8").reshape(len(row["ids"]), -1)[some]
                b = np.frombuffer(row["d_cells"], "<f8").reshape(len(row["d_ids"]), -1)
                distance, head = np.round(nan_distances(a, b), DISTANCE_DIGITS), [row[c] for c in (*keys, "pattern", "block")]
                ids, donors = np.asarray(row["ids"], object)[some], np.asarray(row["d_ids"], object)
                for j in range(a.shape[1]):
                    holes, pool = np.flatnonzero(np.isnan(a[:, j])), np.flatnonzero(~np.isnan(b[:, j]))
                    if len(holes) and len(pool):
                        near = distance[np.ix_(holes, pool)]
                        best = np.argsort(near, axis=1, kind="stable")[:, :k]
                        found = np.take_along_axis(near, best, axis=1).ravel()
                        good = np.isfinite(found)
                        taken = pool[best].ravel()[good]
                        out = pd.DataFrame({"id": np.repeat(ids[holes], best.shape[1])[good], "j": j, "donor": donors[taken], "distance": found[good], "value": b[taken, j]})
                        yield out.assign(**dict(zip([*keys, "pattern", "block"], head)))[names]

    return run


def search(z: DataFrame, keys: Sequence[str], k: int = NEIGHBORS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled cells, opened blocks, all blocks); see ``knn_fill``.

    opened: (keys, pattern, block, d_pattern, d_block, rows), with the rows of the block that open the other;
    blocks: (keys, side, pattern, block, n).
    """
    keys = list(keys)
    # Settled: receivers, donors and the missing cells all read the packed rows.
    rows = settle(
        z.groupBy(*keys, "id", "is_train").agg(
            F.array_sort(F.collect_list(F.struct("feature", "z"))).alias("_cells"),
            F.count_if(F.col("z").isNull()).alias("_missing"),
        )
    )
    packed = rows.withColumn("z", F.transform("_cells", lambda c: c["z"]))
    receivers, donors = make_blocks(packed.where("_missing > 0"), keys), make_blocks(packed.where("is_train"), keys)
    types = dict(z.dtypes)
    keyed = ", ".join(f"{c} {types[c]}" for c in keys)
    plan = keyed + ", pattern string, block int, d_pattern string, d_block int, rows array<int>"
    result = keyed + ", pattern string, block int, id string, j int, donor string, distance double, value double"
    there = donors.select(*keys, *[F.col(c).alias(f"d_{c}") for c in ("pattern", "block", "ids", "cells")])

    parts = receivers.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / TASK_BLOCKS).cast("int").alias("_parts"))

    def chosen(told: DataFrame, first: bool) -> DataFrame:
        told = told.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64("pattern", "block"), F.col("_parts")).cast("int")).drop("_parts")
        short = donors.select(*[F.col(c).alias(c) for c in (*keys, "pattern", "block", "seen", "low", "high")]).join(parts, keys)
        short = short.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        own = [*keys, "_part"]
        return settle(told.groupBy(*own).cogroup(short.groupBy(*own)).applyInPandas(_choose(keys, k, first), plan))

    def compared(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(receivers.select(*keys, "pattern", "block", "ids", "cells"), [*keys, "pattern", "block"])
        return sides.join(there, [*keys, "d_pattern", "d_block"]).mapInPandas(_compare(keys, k), result)

    nearest = Window.partitionBy(*keys, "id", "j").orderBy("distance", "donor")
    near_pairs = chosen(receivers, True)
    near = compared(near_pairs).withColumn("_place", F.row_number().over(nearest)).where(F.col("_place") <= k).drop("_place")
    near = settle(near)
    # Without k donors so far nothing bounds a cell's k-th.
    cell = near.groupBy(*keys, "pattern", "block", "id", "j").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where(F.col("n") >= k)
    known = cell.groupBy(*keys, "pattern", "block").agg(F.collect_list(F.struct("id", "j", "far")).alias("known"))
    told = receivers.join(known, [*keys, "pattern", "block"], "left")
    more_pairs = chosen(told, False)
    candidates = near.unionByName(compared(more_pairs))
    means = (
        candidates.withColumn("_place", F.row_number().over(nearest))
        .where(F.col("_place") <= k)
        .groupBy(*keys, "id", "j")
        .agg(F.avg("value").alias("filled"))
    )
    missing = rows.where("_missing > 0").select(
        *keys, "id", "is_train", F.posexplode("_cells").alias("j", "c")
    ).where("c.z IS NULL")
    filled = missing.join(means, [*keys, "id", "j"], "left").select(
        *keys, "id", "is_train", F.col("c.feature").alias("feature"), F.coalesce("filled", F.lit(0.0)).alias("z")
    )
    sizes = [side.select(*keys, F.lit(name).alias("side"), "pattern", "block", "n") for name, side in (("receiver", receivers), ("donor", donors))]
    return filled, near_pairs.unionByName(more_pairs), sizes[0].unionByName(sizes[1])


def knn_fill(z: DataFrame, keys: Sequence[str], k: int = NEIGHBORS) -> DataFrame:
    """Fill NULL z-scores: (keys, id, feature, z, is_train) in, the missing cells with values out.

    The value is the mean over the k nearest training rows that observed the feature; a cell without
    any comparable donor takes the training mean, which is 0 on the z scale.
    """
    return search(z, keys, k)[0]
