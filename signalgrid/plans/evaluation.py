"""Dense-map evaluation: geometry, anchors, fits, baselines and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.functions import pathloss as pl
from signalgrid.operators import fits, sampling

MATERIALS = ("mat_1_count", "mat_2_count", "mat_3_count")
SWEEP = ("sample_id", "rate", "seed")


def with_log_distance(base_maps: DataFrame, min_distance_m: float = 0.25) -> DataFrame:
    return base_maps.withColumn("log_d", pl.log_distance("distance_m", 1.0, min_distance_m))


def anchor_rows(base_maps: DataFrame, rates: Sequence[float], seeds: Sequence[int], min_points: int = 4,
                rows_bound: int | None = None) -> DataFrame:
    """Anchor cells with their geometry columns, one set per (sample, rate, seed)."""
    return sampling.sparse_anchors(with_log_distance(base_maps), rates, seeds, min_points, rows_bound)


def physics_fits(anchors: DataFrame, alpha: float = 1e-6, materials: Sequence[str] = MATERIALS) -> DataFrame:
    """Log-distance and multi-wall fits side by side, one row per (sample, rate, seed)."""
    return fits.physics_fits(sampling.usable_anchors(anchors), SWEEP, materials, alpha)


def sweep_cells(base_maps: DataFrame, rates: Sequence[float], seeds: Sequence[int]) -> DataFrame:
    """Every cell once per (rate, seed) of the sweep."""
    grid = F.explode(F.array(*[
        F.struct(F.lit(float(r)).alias("rate"), F.lit(int(s)).alias("seed")) for r in rates for s in seeds]))
    return base_maps.withColumn("_s", grid).withColumn("rate", F.col("_s.rate")).withColumn("seed", F.col("_s.seed")).drop("_s")


def physics_predictions(base_maps: DataFrame, fitted: DataFrame, rates: Sequence[float], seeds: Sequence[int],
                        materials: Sequence[str] = MATERIALS) -> DataFrame:
    """FSPL, log-distance and multi-wall predictions on all cells; samples without anchors read 0."""
    cells = sweep_cells(with_log_distance(base_maps), rates, seeds).join(fitted, list(SWEEP), "left")
    ld = F.coalesce(F.col("ld_intercept") + F.col("ld_slope") * F.col("log_d"), F.lit(0.0))
    mw = F.coalesce(fits.linear_prediction(["log_d", *materials], "mw_coef", "mw_intercept"), F.lit(0.0))
    return cells.withColumn("fspl_pred_db", F.col("fspl_db")).withColumn("log_distance_pred_db", ld).withColumn(
        "multi_wall_pred_db", mw)
