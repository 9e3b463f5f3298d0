"""Deterministic fixed-size samples inside groups, ranked by a stable hash."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.functions.hashing import HASH_RANGE, stable_hash
from signalgrid.operators.percentiles import null_safe_join
from signalgrid.session import materialise
from signalgrid.skew import MAX_GROUP_ROWS, fits_one_task

SLICE_ROWS = 4096
MAX_SLICES = 65536


def take_smallest(df: DataFrame, keys: Sequence[str], size: Callable[[Column], Column], rank: Column,
                  tie: Sequence[str], rows_bound: int | None = None, max_group_rows: int = MAX_GROUP_ROWS,
                  mark: str | None = None, few_groups: bool = False) -> DataFrame:
    """Keep in each group the `size(n)` rows that come first by (rank, tie).

    `rank` must be an integer in [0, 2**32). With `mark`, all rows stay and a boolean
    column of that name tells the chosen ones.

    A small table is ranked by one window. Otherwise the rank range of every group is cut
    into slices of some thousand rows (65536 slices at most), which are counted with
    map-side combining; only the slice at the edge of the quota is sorted. It gives the
    group's last chosen (rank, tie), and every row is compared with that. Where groups are
    known to be few (scenarios, folds), `few_groups` sends these limits to the rows, so that
    rows are not shuffled and no group lands in one task.
    """
    keys, flag = list(keys), mark or "_chosen"
    ranked = df.withColumn("_rank", rank)
    if fits_one_task(rows_bound, max_group_rows):
        whole = Window.partitionBy(*keys)
        ordered = whole.orderBy("_rank", *tie)
        out = ranked.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
            flag, F.row_number().over(ordered) <= size(F.col("_n"))).drop("_n", "_rank")
        return out if mark else out.where(flag).drop(flag)

    def sent(groups: DataFrame) -> DataFrame:
        return F.broadcast(groups) if few_groups else groups

    per_slice = min(SLICE_ROWS, max_group_rows)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, size(F.col("_n")).alias("_k"), F.least(F.lit(MAX_SLICES), F.ceil(F.col("_n") / per_slice)).alias("_slices"))
    totals = materialise(totals, "quotas")
    sliced = null_safe_join(ranked.select(*dict.fromkeys([*keys, "_rank", *tie])), sent(totals), keys).withColumn(
        "_slice", F.floor(F.col("_rank") * F.col("_slices") / HASH_RANGE))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"), F.first("_k").alias("_k")).withColumn(
        "_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    edge = counted.where("_before < _k AND _before + _c >= _k").select(
        *keys, F.col("_slice").alias("_edge"), (F.col("_k") - F.col("_before")).alias("_left"))
    own = dict.fromkeys(["_rank", *[t for t in tie if t not in keys]])
    rim = null_safe_join(sliced, sent(edge), keys).where("_slice = _edge").withColumn(
        "_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*own)))
    # The rows alike in (rank, tie) among which the quota ends; `_equal` of them are chosen.
    last = rim.groupBy(*keys, *own).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_alike"), F.first("_left").alias("_left")).where(
        "_first <= _left AND _left < _first + _alike")
    limits = materialise(last.select(*keys, F.struct(*own).alias("_limit"), (F.col("_left") - F.col("_first") + 1).alias("_equal"), "_alike"), "limits")
    placed, here = null_safe_join(ranked, sent(limits), keys), F.struct(*own)
    before_limit = F.coalesce(here <= F.col("_limit"), F.lit(False))
    if limits.where("_equal < _alike").isEmpty():
        out = placed.withColumn(flag, before_limit)
    else:
        torn = F.coalesce((F.col("_equal") < F.col("_alike")) & (here == F.col("_limit")), F.lit(False))
        some = placed.where(torn).withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(*own)) <= F.col("_equal"))
        out = placed.where(~torn).withColumn(flag, before_limit).unionByName(some)
    out = out.drop("_rank", "_limit", "_equal", "_alike")
    return out if mark else out.where(flag).drop(flag)


def sparse_count(rate: float, min_points: int) -> Callable[[Column], Column]:
    """Anchor quota of a sample: ceil(n * rate), at least `min_points`, at most n."""
    def size(n: Column) -> Column:
        k = F.lit(int(min_points)) if rate <= 0 else n if rate >= 1 else F.ceil(n * F.lit(float(rate)))
        return F.least(n, F.greatest(F.lit(int(min_points)), k)).cast("bigint")
    return size


def frame_count(rate: float, min_points: int) -> Callable[[Column], Column]:
    """Quota used on plain frames: max(min_points, ceil(rate * n)), at most n."""
    def size(n: Column) -> Column:
        return F.least(n, F.greatest(F.lit(int(min_points)), F.ceil(n * F.lit(float(rate))))).cast("bigint")
    return size


def fewshot_count(mode: str, fraction: float, count: int) -> Callable[[Column], Column]:
    """Few-shot quota: half-even rounded share or fixed count, leaving one point to score."""
    def size(n: Column) -> Column:
        k = F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction)))) if mode == "fraction" else F.lit(int(count))
        return F.least(F.greatest(F.lit(1), k), F.greatest(F.lit(1), n - 1)).cast("bigint")
    return size


def capped_count(max_points: int) -> Callable[[Column], Column]:
    """Training-row quota: all rows when no cap is set."""
    def size(n: Column) -> Column:
        return n if max_points <= 0 else F.least(n, F.lit(int(max_points))).cast("bigint")
    return size


def sparse_anchors(valid_cells: DataFrame, rates: Sequence[float], seeds: Sequence[int], min_points: int = 1,
                   rows_bound: int | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Anchor cells of every (sample, rate, seed).

    The ranking depends on sample, seed and position only through the hash of
    (sample, rate, seed, y, x), so all methods share the same anchors.
    """
    parts = []
    for rate in rates:
        swept = valid_cells.select(
            "*", F.lit(float(rate)).alias("rate"), F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
        rank = stable_hash(F.lit("anchor"), "sample_id", F.lit(repr(float(rate))), "seed", "y", "x")
        parts.append(take_smallest(swept, ["sample_id", "rate", "seed"], sparse_count(rate, min_points), rank,
                                   ("y", "x"), rows_bound, max_group_rows))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def anchors_outside_valid(anchors: DataFrame, valid_cells: DataFrame) -> DataFrame:
    """Anchors that are not valid cells; must be empty."""
    return anchors.join(valid_cells.select("sample_id", "y", "x"), ["sample_id", "y", "x"], "left_anti")


def usable_anchors(anchors: DataFrame, target: str = "path_loss") -> DataFrame:
    """Anchors whose observed value is a finite number."""
    return anchors.where(F.abs(target) < float("inf"))


def training_rows(features: DataFrame, max_points: int, seed: int, keys: Sequence[str] = ("sample_id", "rate", "seed"),
                  rows_bound: int | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """At most `max_points` training rows of every sample, chosen by hash."""
    rank = stable_hash(F.lit("train"), F.lit(str(seed)), "sample_id", "y", "x")
    return take_smallest(features, keys, capped_count(max_points), rank, ("y", "x"), rows_bound, max_group_rows)


def dense_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows_bound: int | None = None,
                    max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Number the rows of every group 0..n-1, by the hash of `order` and then `order`.

    Small groups are numbered by one window. Larger ones are cut into hash slices: the
    sizes of earlier slices give the offset and only a slice is sorted. Slices follow the
    same hash, so both ways give every row the same number.
    """
    keys = list(keys)
    if fits_one_task(rows_bound, max_group_rows):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(stable_hash(*order), *order)) - 1)
    totals = df.groupBy(*keys).agg(F.least(F.lit(MAX_SLICES), F.ceil(F.count(F.lit(1)) / max_group_rows)).alias("_slices"))
    sliced = null_safe_join(df, totals, keys).withColumn("_slice", F.floor(stable_hash(*order) * F.col("_slices") / HASH_RANGE))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c")).select(
        *keys, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(stable_hash(*order), *order)
    return null_safe_join(sliced, offsets, [*keys, "_slice"]).withColumn(
        name, F.row_number().over(inside) - 1 + F.col("_offset")).drop("_slices", "_slice", "_offset")
