"""Error metrics and their aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.operators.percentiles import exact_percentiles, null_safe_join
from signalgrid.skew import MAX_GROUP_ROWS, split_hot

CORE = ("rmse", "mae", "median_ae", "p90_ae", "p95_ae", "bias_db", "std_error_db", "count")


def finite(c: str | Column) -> Column:
    """True for real numbers. NaN sorts above infinity, so one comparison covers both."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def marked_error(df: DataFrame, pred: str, target: str, valid: str | None = None) -> DataFrame:
    """All rows, so that no key is lost; `_ok` tells valid rows with a finite target, and `_e` is null on
    the others and where the prediction is not finite."""
    ok = finite(target) if valid is None else F.coalesce(F.col(valid), F.lit(False)) & finite(target)
    return df.withColumn("_ok", ok).withColumn("_e", F.when(F.col("_ok") & finite(pred), F.col(pred) - F.col(target)))


def with_error(df: DataFrame, pred: str, target: str, valid: str | None = None) -> DataFrame:
    """Only valid rows with a finite target."""
    return marked_error(df, pred, target, valid).where("_ok").drop("_ok")


def _rmse(where: Column | None = None) -> Column:
    e2 = F.col("_e") * F.col("_e")
    return F.sqrt(F.avg(e2 if where is None else F.when(where, e2)))


def _region(where: Column, min_pixels: int) -> Column:
    return F.when(F.count(F.when(where & F.col("_ok"), 1)) >= min_pixels, _rmse(where))


def core_columns(std: str = "samp") -> list[Column]:
    spread = F.stddev_samp("_e") if std == "samp" else F.stddev_pop("_e")
    return [
        _rmse().alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("bias_db"),
        spread.alias("std_error_db"), F.count("_e").alias("count"),
    ]


def region_columns(los: str | None = None, wall_count: str | None = None, is_anchor: str | None = None,
                   wall: str | None = None, target: str | None = None, high_wall_threshold: int = 2,
                   clip_min_db: float | None = None, clip_max_db: float | None = None,
                   min_region_pixels: int = 5) -> list[Column]:
    """Region metrics over rows of `marked_error`; a region's size is counted before predictions are checked."""
    out = []
    if los:
        seen = F.col(los) > 0.5
        out += [_region(seen, min_region_pixels).alias("los_rmse"), _region(~seen, min_region_pixels).alias("nlos_rmse")]
    if wall_count:
        out.append(_rmse(F.col(wall_count) >= high_wall_threshold).alias("high_wall_rmse"))
    if clip_max_db is not None:
        unclipped = F.col(target) < clip_max_db - 1e-5
        out += [_rmse(unclipped).alias("unclipped_rmse"), F.count(F.when(unclipped & F.col("_ok"), 1)).alias("unclipped_count")]
    if clip_max_db is not None or clip_min_db is not None:
        clipped = F.lit(False)
        if clip_max_db is not None:
            clipped = clipped | (F.col(target) >= clip_max_db - 1e-5)
        if clip_min_db is not None:
            clipped = clipped | (F.col(target) <= clip_min_db + 1e-5)
        out.append((F.count(F.when(clipped & F.col("_ok"), 1)) / F.nullif(F.count(F.when(F.col("_ok"), 1)), F.lit(0))).alias("clipped_pixel_fraction"))
    if is_anchor:
        rest = ~F.col(is_anchor)
        out += [_rmse(rest).alias("non_anchor_rmse"), F.avg(F.when(rest, F.abs("_e"))).alias("non_anchor_mae"),
                F.count(F.when(rest, F.col("_e"))).alias("non_anchor_count")]
        if los:
            out += [_region(rest & seen, min_region_pixels).alias("non_anchor_los_rmse"),
                    _region(rest & ~seen, min_region_pixels).alias("non_anchor_nlos_rmse")]
    if wall:
        free = ~F.col(wall)
        out += [_rmse(free).alias("free_space_rmse"), F.avg(F.when(free, F.abs("_e"))).alias("free_space_mae"),
                F.count(F.when(free, F.col("_e"))).alias("free_space_count"),
                _rmse(F.col(wall)).alias("wall_region_rmse")]
    return out


def error_metrics(df: DataFrame, keys: Sequence[str], pred: str = "pred", target: str = "target",
                  valid: str | None = None, std: str = "samp", rows_bound: int | None = None,
                  max_group_rows: int = MAX_GROUP_ROWS, **regions) -> DataFrame:
    """All error metrics of every key in one grouped aggregation.

    Core metrics always; LOS, wall, clipping, non-anchor and free-space families when
    their columns are named. Percentiles join the same aggregation, except in groups too
    large for one task, where `exact_percentiles` finds them. A key without a valid row
    with a finite target has counts of 0 and null metrics.
    """
    rows = marked_error(df, pred, target, valid)
    columns = core_columns(std) + region_columns(target=target, **regions)
    extra = {}
    if regions.get("is_anchor"):
        extra["non_anchor_p90_ae"] = ~F.col(regions["is_anchor"])
    if regions.get("wall"):
        extra["free_space_p90_ae"] = ~F.col(regions["wall"])
    cold, hot = split_hot(rows, keys, rows_bound, max_group_rows)
    # All probabilities share one percentile buffer per group.
    probes = [F.percentile(F.abs("_e"), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("_p")]
    probes += [F.percentile(F.when(w, F.abs("_e")), 0.9).alias(n) for n, w in extra.items()]
    out = cold.groupBy(*keys).agg(*columns, *probes)
    for i, name in enumerate(("median_ae", "p90_ae", "p95_ae")):
        out = out.withColumn(name, F.get("_p", F.lit(i)))
    out = out.drop("_p")
    if hot is None:
        return out
    big = hot.groupBy(*keys).agg(*columns)
    for where, probs in [(F.lit(True), {"median_ae": 0.5, "p90_ae": 0.9, "p95_ae": 0.95}), *[(w, {n: 0.9}) for n, w in extra.items()]]:
        part = exact_percentiles(hot.where(where).withColumn("_ae", F.abs("_e")), keys, "_ae", probs, max_group_rows)
        big = null_safe_join(big, part, keys)
    return out.unionByName(big)


def paired_deltas(metrics: DataFrame, keys: Sequence[str], base: str = "multi_wall",
                  direct: Sequence[str] = ("direct_rf",)) -> DataFrame:
    """RMSE difference to the multi-wall row and to the first direct-forest row present, per map."""
    group = Window.partitionBy(*keys)
    def of(name):
        return F.max(F.when(F.col("method") == name, F.col("rmse"))).over(group)
    return metrics.withColumn("rmse_minus_multi_wall", F.col("rmse") - of(base)).withColumn(
        "rmse_minus_direct_rf", F.col("rmse") - F.coalesce(*[of(d) for d in direct]))


def mean_std(df: DataFrame, keys: Sequence[str], columns: Sequence[str], single: float | None = 0.0,
             ddof: int = 1, extremes: bool = False, counts: bool = False) -> DataFrame:
    """Mean and spread of numeric columns per key; null keys form groups of their own.

    `single` is the spread reported for a one-row group: 0.0, or None to leave it null.
    """
    aggs = []
    for c in columns:
        spread = F.stddev_samp(c) if ddof else F.stddev_pop(c)
        if single is not None and ddof:
            spread = F.when(F.count(F.lit(1)) == 1, F.lit(single)).otherwise(spread)
        aggs += [F.avg(c).alias(c), spread.alias(f"{c}_std")]
        if extremes:
            aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
        if counts:
            aggs.append(F.count(c).alias(f"{c}_n"))
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("num_rows"))


def across_seeds(metrics: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("sparse_rate", "method"),
                 seed: str = "sparse_seed") -> DataFrame:
    """Seed summary: mean, sample spread, finite count, and the sorted list of seeds."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_n")]
    return metrics.groupBy(*keys).agg(
        *aggs, F.count(F.lit(1)).alias("n_runs"),
        F.concat_ws(";", F.transform(F.sort_array(F.collect_set(seed)), lambda s: s.cast("string"))).alias("seeds"))


def two_level_mean_std(df: DataFrame, first: Sequence[str], then: Sequence[str], columns: Sequence[str],
                       single: float | None = None) -> DataFrame:
    """Average inside the finer keys, then mean and spread of those averages over the coarser keys."""
    inner = df.groupBy(*first).agg(*[F.avg(c).alias(c) for c in columns])
    aggs = []
    for c in columns:
        spread = F.stddev_samp(c)
        if single is not None:
            spread = F.when(F.count(c) == 1, F.lit(single)).otherwise(spread)
        aggs += [F.avg(c).alias(f"{c}_mean"), spread.alias(f"{c}_std")]
    return inner.groupBy(*then).agg(*aggs, F.count(F.lit(1)).alias("n"))


def partitioned_metrics(df: DataFrame, pred: str, target: str, method: str, partitions: dict[str, Column],
                        rows_bound: int | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Overall metrics and metrics by each named partition, as one long table (method, partition, group)."""
    labels = F.array(
        F.struct(F.lit("overall").alias("partition"), F.lit("all").alias("group")),
        *[F.struct(F.lit(n).alias("partition"), c.cast("string").alias("group")) for n, c in partitions.items()])
    long = df.withColumn("_g", F.explode(labels)).withColumn("partition", F.col("_g.partition")).withColumn(
        "group", F.col("_g.group")).where("group IS NOT NULL")
    full = error_metrics(long, [method, "partition", "group"], pred, target, rows_bound=rows_bound,
                         max_group_rows=max_group_rows)
    return full.select(method, "partition", "group", "rmse", "mae", "median_ae", "p90_ae", F.col("count").alias("n"))


def best_by(df: DataFrame, keys: Sequence[str], metric: str = "rmse", label: str = "method") -> DataFrame:
    """Label with the lowest metric per key; ties go to the first label."""
    grouped = df.where(F.col(metric).isNotNull()).groupBy(*keys) if keys else df.where(F.col(metric).isNotNull()).groupBy()
    best = F.min(F.struct(F.col(metric), F.col(label)))
    return grouped.agg(best.getField(label).alias("best_method"), best.getField(metric).alias(f"best_{metric}"))


def pooled_point_metrics(predictions: DataFrame, keys: Sequence[str], pred: str = "pred_pl_db", target: str = "target_pl_db",
                         rows_bound: int | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Regroup point predictions and recompute the metrics, with the number of distinct points.

    Distinct points are counted in two steps, (keys, point) then keys, which is how a hot
    key set stays spread over tasks.
    """
    scores = error_metrics(predictions, keys, pred, target, std="pop", rows_bound=rows_bound, max_group_rows=max_group_rows)
    # Null keys (an anchor share or count that does not apply) are groups too.
    unique = predictions.groupBy(*keys, "row_uid").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_test_points"))
    left, right = scores.alias("a"), unique.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return left.join(right, cond).select("a.*", "b.unique_test_points")


def curve_data(metrics: DataFrame, metric: str = "rmse") -> DataFrame:
    """Mean, spread and count behind a metric-versus-rate curve."""
    return metrics.groupBy("method", "sparse_rate").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))


def comparison_at_rate(metrics: DataFrame, metric: str = "rmse", rate: float | None = None) -> DataFrame:
    """Method means at one sparse rate (the median rate of the table by default), best first."""
    if rate is None:
        chosen = metrics.select("sparse_rate").distinct().agg(F.median("sparse_rate").alias("_rate"))
        picked = metrics.join(F.broadcast(chosen))  # one row
    else:
        picked = metrics.withColumn("_rate", F.lit(float(rate)))
    near = F.abs(F.col("sparse_rate") - F.col("_rate")) <= 1e-8 + 1e-5 * F.abs("_rate")
    return picked.where(near).groupBy("method").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n")).orderBy("mean", "method")


def region_means(metrics: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Mean of every region metric by method."""
    return metrics.groupBy("method").agg(*[F.avg(r).alias(r) for r in regions])


def top_features(importances: DataFrame, methods: Sequence[str], k: int = 20) -> DataFrame:
    """Features with the highest mean importance for the first listed method that is present."""
    rank = F.coalesce(*[F.when(F.col("method") == m, F.lit(i)) for i, m in enumerate(methods)])
    ranked = importances.withColumn("_m", rank).where("_m IS NOT NULL")
    first = ranked.agg(F.min("_m").alias("_m"))
    return ranked.join(F.broadcast(first), "_m").groupBy("method", "feature").agg(
        F.avg("importance").alias("importance_mean"), F.stddev_samp("importance").alias("importance_std"),
    ).orderBy(F.desc("importance_mean"), "feature").limit(k)


def primary_row(metrics: DataFrame, method: str, columns: Sequence[str]) -> DataFrame:
    """The best row of one method, with prefixed columns."""
    return metrics.where(F.col("method") == method).orderBy("rmse", *[c for c in columns if c != "rmse"]).limit(1).select(
        *[F.col(c).alias(f"primary_{c}") for c in columns])


def dataset_counts(df: DataFrame, side: str, sample: str = "sample_id", group: str = "scene_id") -> DataFrame:
    """Samples and distinct groups per split side."""
    return df.groupBy(side).agg(F.count(sample).alias("samples"), F.countDistinct(group).alias("groups"))
