"""Grouped propagation fits from centred moments.

Every fit is one partial aggregation of means and covariances per group; only the small
normal equations of each group (k at most about a dozen) are solved in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalgrid.operators.percentiles import null_safe_join


def moments(features: Sequence[str], target: str) -> list[Column]:
    """Count, means, centred covariances and raw second moments of the features."""
    pairs = list(combinations_with_replacement(features, 2))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(target).alias("y_mean"),
        F.array(*[F.avg(f) for f in features]).alias("x_mean"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov"),
        F.array(*[F.covar_pop(f, target) for f in features]).alias("cov_y"),
    ]


# Spelled out, because a type given as text needs a running session at import.
SOLUTION = T.StructType([
    T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()), T.StructField("design_rank", T.IntegerType())])


@F.pandas_udf(SOLUTION)
def _solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for n, y_mean, x_mean, cov, cov_y, alpha in batches:
        if len(n) == 0:
            yield pd.DataFrame({"coef": [], "intercept": [], "design_rank": []})
            continue
        mean = np.stack([np.asarray(v, dtype=float) for v in x_mean])
        size = mean.shape[1]
        upper = np.triu_indices(size)
        gram = np.zeros((len(n), size, size))
        gram[:, upper[0], upper[1]] = np.stack([np.asarray(v, dtype=float) for v in cov])
        gram[:, upper[1], upper[0]] = gram[:, upper[0], upper[1]]
        rows = n.to_numpy(dtype=float)
        rhs = rows[:, None] * np.stack([np.asarray(v, dtype=float) for v in cov_y])
        ridge = alpha.to_numpy(dtype=float)[:, None, None] * np.eye(size)
        system = rows[:, None, None] * gram + ridge
        coef = np.empty((len(n), size))
        for r in range(len(n)):
            try:
                coef[r] = np.linalg.solve(system[r], rhs[r])
            except np.linalg.LinAlgError:
                coef[r] = np.linalg.lstsq(system[r], rhs[r], rcond=None)[0]
        raw = rows[:, None, None] * (gram + mean[:, :, None] * mean[:, None, :])
        scale = np.sqrt(np.maximum(np.einsum("rii->ri", raw), 1e-300))
        rank = np.linalg.matrix_rank(raw / (scale[:, :, None] * scale[:, None, :]), tol=1e-9, hermitian=True)
        zero = (np.einsum("rii->ri", raw) <= 0).all(axis=1)
        yield pd.DataFrame({
            "coef": list(coef),
            "intercept": y_mean.to_numpy(dtype=float) - np.einsum("rk,rk->r", coef, mean),
            "design_rank": np.where(zero, 0, rank).astype("int32"),
        })


def ridge_fits(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alpha: float) -> DataFrame:
    """Ridge with a free intercept in each group; the penalty applies to slopes only.

    Returns keys, coef (in feature order), intercept, design_rank and n. `alpha=0` is
    ordinary least squares.
    """
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    stats = grouped.agg(*moments(features, target)).where("n > 0")
    solved = stats.withColumn("fit", _solve("n", "y_mean", "x_mean", "cov", "cov_y", F.lit(float(alpha))))
    return solved.select(*keys, F.col("fit.coef").alias("coef"), F.col("fit.intercept").alias("intercept"),
                         F.col("fit.design_rank").alias("design_rank"), "n")


def linear_prediction(features: Sequence[str], coef: str = "coef", intercept: str = "intercept") -> Column:
    out = F.col(intercept)
    for i, f in enumerate(features):
        out = out + F.get(F.col(coef), F.lit(i)) * F.col(f)
    return out


def _with_groups(stats: DataFrame, groups: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Every row of `groups` (one per group), with n = 0 where no anchor was counted."""
    if groups is None:
        return stats
    return null_safe_join(groups.select(*keys), stats, keys).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def log_distance_fits(anchors: DataFrame, keys: Sequence[str], alpha: float = 1e-6, x: str = "log_d",
                      y: str = "path_loss", groups: DataFrame | None = None) -> DataFrame:
    """Log-distance ridge per group, in closed form from one aggregate.

    One usable anchor gives a constant, of rank 0. Groups with none are known from
    `groups` (one row per group) and get the constant 0; without it they are absent.
    """
    sxx = F.col("n") * F.col("vxx") + F.lit(float(alpha))
    slope = F.when(F.col("n") >= 2, F.try_divide(F.col("n") * F.col("vxy"), sxx)).otherwise(0.0)
    slope = F.coalesce(slope, F.lit(0.0))
    stats = anchors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vxx"), F.covar_pop(x, y).alias("vxy"), F.max(F.abs(x)).alias("ax"))
    stats = _with_groups(stats, groups, keys)
    return stats.select(
        *keys,
        F.when(F.col("n") >= 2, "log_distance").otherwise("log_distance_fallback_anchor_mean").alias("status"),
        slope.alias("slope"), F.when(F.col("n") == 0, 0.0).otherwise(F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.when((F.col("n") >= 2) & (F.col("ax") > 0), 1).otherwise(0).alias("design_rank"), F.col("n").alias("anchor_count"))


def physics_fits(anchors: DataFrame, keys: Sequence[str], material_columns: Sequence[str], alpha: float = 1e-6,
                 x: str = "log_d", y: str = "path_loss", groups: DataFrame | None = None) -> DataFrame:
    """Log-distance and multi-wall ridge of every group from one aggregation; `groups` as in `log_distance_fits`.

    The log-distance line uses the first feature's moments. Multi-wall takes over that
    line, with zero wall losses, where anchors are fewer than max(2, 1 + materials).
    """
    need = max(2, 1 + len(material_columns))
    stats = anchors.groupBy(*keys).agg(*moments([x, *material_columns], y)).withColumn(
        "fit", _solve("n", "y_mean", "x_mean", "cov", "cov_y", F.lit(float(alpha))))
    stats = _with_groups(stats, groups, keys)
    first = F.try_divide(F.col("n") * F.get("cov_y", F.lit(0)), F.col("n") * F.get("cov", F.lit(0)) + F.lit(float(alpha)))
    slope = F.when(F.col("n") >= 2, F.coalesce(first, F.lit(0.0))).otherwise(0.0)
    full = F.col("n") >= need
    solved = stats.withColumn("ld_slope", slope).withColumn(
        "ld_intercept", F.when(F.col("n") == 0, 0.0).otherwise(F.col("y_mean") - F.col("ld_slope") * F.get("x_mean", F.lit(0))))
    line_has_rank = (F.get("cov", F.lit(0)) > 0) | (F.get("x_mean", F.lit(0)) != 0)
    line = F.array("ld_slope", *[F.lit(0.0) for _ in material_columns])
    return solved.select(
        *keys, "ld_slope", "ld_intercept", F.when(F.col("n") >= 2, "log_distance").otherwise("log_distance_fallback_anchor_mean").alias("ld_status"),
        F.when(full, F.col("fit.coef")).otherwise(line).alias("mw_coef"),
        F.when(full, F.col("fit.intercept")).otherwise(F.col("ld_intercept")).alias("mw_intercept"),
        F.when(full, "multi_wall").otherwise("multi_wall_fallback_log_distance").alias("mw_status"),
        # The fallback is the log-distance line, and so is its rank.
        F.when(full, F.col("fit.design_rank")).when((F.col("n") >= 2) & line_has_rank, 1).otherwise(0).alias("mw_rank"), F.col("n").alias("anchor_count"))


def multi_wall_fits(anchors: DataFrame, keys: Sequence[str], material_columns: Sequence[str], alpha: float = 1e-6,
                    x: str = "log_d", y: str = "path_loss", groups: DataFrame | None = None) -> DataFrame:
    """Multi-wall ridge per group, falling back to log-distance when anchors are too few."""
    return physics_fits(anchors, keys, material_columns, alpha, x, y, groups).select(
        *keys, F.col("mw_status").alias("status"), F.col("mw_coef").alias("coef"), F.col("mw_intercept").alias("intercept"),
        F.col("mw_rank").alias("design_rank"), "anchor_count")


def free_log_distance_fit(points: DataFrame, distance: str, target: str, d0: float = 1.0, alpha: float = 0.0,
                          keys: Sequence[str] = ()) -> DataFrame:
    """Reference loss and slope per decade over all finite rows (one fit per key set)."""
    x = F.log10(F.greatest(F.col(distance), F.lit(1e-6)) / F.lit(float(d0)))
    finite = points.where(F.col(distance).isNotNull() & F.col(target).isNotNull()).withColumn("_x", x).withColumn(
        "_k", F.lit(0))
    fit = log_distance_fits(finite, [*keys, "_k"], alpha, "_x", target)
    return fit.select(*keys, F.col("slope").alias("slope_db_per_decade"), F.col("intercept").alias("reference_db"),
                      F.col("anchor_count").alias("n"))


def bias_calibrated(predictions: DataFrame, anchors: DataFrame, keys: Sequence[str], pred: str, target: str) -> DataFrame:
    """Shift predictions of each group by the mean anchor error, or by nothing without anchors.

    Groups are the few scenarios and sweeps of a study: their biases are sent to the rows."""
    bias = anchors.groupBy(*keys).agg(F.avg(F.col(target) - F.col(pred)).alias("bias"))
    return predictions.join(F.broadcast(bias), list(keys), "left").withColumn(
        "calibrated", F.col(pred) + F.coalesce("bias", F.lit(0.0)))
