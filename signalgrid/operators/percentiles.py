"""Exact percentiles inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.session import materialise
from signalgrid.skew import MAX_GROUP_ROWS

BINS = 4096


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Linear-interpolated percentiles per group without holding a group in one task.

    Each needed order statistic keeps an interval known to contain it. While an interval
    still holds more than `max_group_rows` rows it is cut into 4096 bins, counted with
    map-side combining, and narrowed to the bin with the wanted rank. Intervals that
    shrink to one value are answered from the counts alone, so heavy ties cost nothing.
    Intervals (two per group and probability at most) are sent to the rows, which are
    never shuffled; ranks with the same interval share its counts. `df` is read once per
    round and should be a table, not a long plan.
    """
    # One struct key: null key values then compare equal, as they do in a grouping.
    names, keys = list(keys), ["_g"]
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*names).alias("_g"), F.col(value).cast("double").alias("_v"))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p")) for name, p in probs.items()]))
    spots = stats.withColumn("_q", wanted).withColumn("_pos", F.col("_q.p") * (F.col("_n") - 1))
    ranks = spots.select(*keys, F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_r"), "_n", "_lo", "_hi").distinct()
    state = materialise(ranks.select(*keys, "_r", "_lo", "_hi", F.lit(0).cast("bigint").alias("_before"),
                                     F.col("_n").alias("_inside")), "ranks")
    while True:
        open_ = state.where((F.col("_inside") > max_group_rows) & (F.col("_lo") < F.col("_hi")))
        if open_.isEmpty():
            break
        width = (F.col("_hi") - F.col("_lo")) / BINS
        cells = F.broadcast(open_.select(*keys, "_lo", "_hi").distinct())
        hit = rows.join(cells, keys).where("_v >= _lo AND _v <= _hi").withColumn(
            "_bin", F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BINS - 1)))
        counted = hit.groupBy(*keys, "_lo", "_hi", "_bin").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        earlier = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = counted.withColumn("_earlier", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        narrowed = bins.join(F.broadcast(open_.drop("_inside")), [*keys, "_lo", "_hi"]).withColumn(
            "_before", F.col("_before") + F.col("_earlier")).where("_before <= _r AND _r < _before + _c").select(
            *keys, "_r", F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), "_before", F.col("_c").alias("_inside"))
        closed = state.where((F.col("_inside") <= max_group_rows) | (F.col("_lo") >= F.col("_hi")))
        state = materialise(closed.unionByName(narrowed), "ranks")
    flat = state.where("_lo >= _hi").select(*keys, "_r", F.col("_lo").alias("_v"))
    order = Window.partitionBy(*keys, "_r").orderBy("_v")
    picked = rows.join(F.broadcast(state.where("_lo < _hi")), keys).where("_v >= _lo AND _v <= _hi").withColumn(
        "_i", F.row_number().over(order) - 1 + F.col("_before")).where("_i = _r").select(*keys, "_r", "_v")
    found = flat.unionByName(picked)
    below = found.select(*keys, F.col("_r").alias("_fl"), F.col("_v").alias("_a"))
    above = found.select(*keys, F.col("_r").alias("_ce"), F.col("_v").alias("_b"))
    both = spots.withColumn("_fl", F.floor("_pos")).withColumn("_ce", F.ceil("_pos")).join(
        below, [*keys, "_fl"]).join(above, [*keys, "_ce"])
    return both.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_q.q") == name, F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.col("_fl")))).alias(name)
        for name in probs]).select(*[F.col(f"_g.{n}").alias(n) for n in names], *probs)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where null matches null."""
    tagged = right.select(F.struct(*keys).alias("_g"), *[c for c in right.columns if c not in keys])
    return left.withColumn("_g", F.struct(*keys)).join(tagged, "_g", "left").drop("_g")
