"""Feature table of dense maps and of point measurements."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.functions import pathloss as pl
from signalgrid.operators import interpolation as interp
from signalgrid.session import materialise

COORDINATE = ("x_norm", "y_norm")
GEOMETRY = ("distance_m", "log10_distance_m", "fspl_db", "los", "wall_count", "wall_fraction")
LAYERS = ("transmittance_sum", "reflectance_sum")
BASELINES = ("fspl_pred_db", "log_distance_pred_db", "multi_wall_pred_db", "multi_wall_residual_idw_pred_db")

# What each feature is: (names, ablation group, what it has seen of measured path loss). Names and groups
# are fixed values of the feature contract. A name that is not here is in no group and on no list.
NONE, FITTED, INTERPOLATED, LABELS = "none", "fitted", "interpolated", "labels"
MOST_MATERIALS, MOST_NEIGHBOURS = 256, 64
CONTRACT: tuple[tuple[tuple[str, ...], str, str], ...] = (
    (COORDINATE, "coordinates", NONE),
    (("distance_m", "log10_distance_m", "fspl_db"), "distance", NONE),
    (("los",), "los", NONE),
    (("wall_count", "wall_fraction"), "wall_count", NONE),
    (LAYERS, "material", NONE),
    (tuple(f"mat_{m}_count" for m in range(MOST_MATERIALS)), "material", NONE),
    (BASELINES[:3], "baseline_prediction", FITTED),
    (BASELINES[3:], "baseline_prediction", INTERPOLATED),
    (("anchor_residual_idw", *(f"anchor_residual_nn_{i + 1}" for i in range(MOST_NEIGHBOURS))), "sparse_residual", LABELS),
    (("anchor_density", *(f"anchor_dist_px_nn_{i + 1}" for i in range(MOST_NEIGHBOURS))), "sparse_anchor", NONE),
)
GROUPS = ("distance", "coordinates", "los", "wall_count", "material", "sparse_anchor", "sparse_residual", "baseline_prediction")
GROUP = {name: group for names, group, _ in CONTRACT for name in names}
SEEN = {name: seen for names, _, seen in CONTRACT for name in names}


def feature_names(material_ids: Sequence[int] = (1, 2, 3), k: int = 4) -> list[str]:
    """All feature columns in contract order."""
    return [
        *COORDINATE, *GEOMETRY, *[f"mat_{m}_count" for m in material_ids], *LAYERS, *BASELINES,
        "anchor_residual_idw", *[f"anchor_residual_nn_{i + 1}" for i in range(k)],
        *[f"anchor_dist_px_nn_{i + 1}" for i in range(k)], "anchor_density"]


def group_of(name: str) -> str:
    """Ablation group of a feature; names outside the contract are 'other'."""
    return GROUP.get(name, "other")


def in_groups(names: Iterable[str], groups: Iterable[str]) -> list[str]:
    wanted = set(groups)
    return [n for n in names if group_of(n) in wanted]


def _seen_at_most(names: Iterable[str], *levels: str) -> list[str]:
    return [n for n in names if SEEN.get(n) in levels]


def geometry_only(names: Iterable[str]) -> list[str]:
    """Columns free of any path-loss information."""
    return _seen_at_most(names, NONE)


def sparse_anchor_allowed(names: Iterable[str]) -> list[str]:
    """Columns for direct learners that may see fitted baselines but nothing interpolated."""
    return _seen_at_most(names, NONE, FITTED)


def calibration_allowed(names: Iterable[str]) -> list[str]:
    """Columns for the calibrated correction: all of the contract but residual labels."""
    return _seen_at_most(names, NONE, FITTED, INTERPOLATED)


def dense_features(predictions: DataFrame, anchors: DataFrame, density: DataFrame, max_rate: float, k: int = 4,
                   material_ids: Sequence[int] = (1, 2, 3), power: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """The feature table on all cells of `predictions` (physics predictions per sweep).

    `anchors` carry `path_loss` and `multi_wall_pred_db`; they are the only place where a
    target enters a feature. Columns y_true, baseline_value and the three learner targets
    are added for training.
    """
    sweep = ["sample_id", "rate", "seed"]
    known = anchors.where(F.col("path_loss").isNotNull()).withColumn("residual", F.col("path_loss") - F.col("multi_wall_pred_db"))
    mean_residual = known.groupBy(*sweep).agg(F.avg("residual").alias("_mean_residual"))
    shaped = interp.raster_idw(predictions, known, ["residual"], sweep, max_rate, power, eps, k, None)
    if k:
        # Only groups with fewer than k anchors are padded, so only they are searched a second time.
        short = materialise(known.groupBy(*sweep).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") < k).select(*sweep), "short-groups")
        few = predictions.select(*sweep, "y", "x").join(short, sweep, "left_semi")
        near = interp.raster_idw(few, known.join(short, sweep, "left_semi"), ["residual"], sweep, max_rate, power, eps, k)
        farthest = short.withColumn("_far", F.lit(None).cast("double")) if short.isEmpty() else interp.farthest_neighbour(near, sweep, k)
        shaped = interp.pad_neighbours(shaped, sweep, k, farthest)
    joined = shaped.join(mean_residual, sweep, "left").join(density, sweep, "left")
    idw = F.coalesce("idw_residual", "_mean_residual", F.lit(0.0))
    out = joined.select(
        *sweep, "scene_id", "y", "x",
        pl.normalised("x", "width").alias("x_norm"), pl.normalised("y", "height").alias("y_norm"),
        "distance_m", F.log10(F.greatest("distance_m", F.lit(1e-6))).alias("log10_distance_m"), "fspl_db", "los",
        "wall_count", "wall_fraction", *[f"mat_{m}_count" for m in material_ids], *LAYERS,
        "fspl_pred_db", "log_distance_pred_db", "multi_wall_pred_db",
        (F.col("multi_wall_pred_db") + F.coalesce("idw_residual", F.lit(0.0))).alias("multi_wall_residual_idw_pred_db"),
        idw.alias("anchor_residual_idw"),
        *[F.col(f"nn_value_{i + 1}").alias(f"anchor_residual_nn_{i + 1}") for i in range(k)],
        *[F.col(f"nn_dist_{i + 1}").alias(f"anchor_dist_px_nn_{i + 1}") for i in range(k)],
        F.coalesce("anchor_density", F.lit(0.0)).alias("anchor_density"),
        F.col("path_loss").alias("y_true"), F.col("multi_wall_pred_db").alias("baseline_value"), "wall")
    return out


def learner_targets(features: DataFrame) -> DataFrame:
    """Direct, residual and calibrated targets of training rows."""
    return features.withColumn("target_direct", F.col("y_true")).withColumn(
        "target_residual", F.col("y_true") - F.col("multi_wall_pred_db")).withColumn(
        "target_calibrated", F.col("y_true") - F.col("multi_wall_residual_idw_pred_db"))


def map_frame(features: DataFrame) -> DataFrame:
    """Features with position, target, multi-wall prediction and residual under their frame names."""
    return features.withColumnsRenamed({"y_true": "path_loss_db", "multi_wall_pred_db": "multiwall_pred_db"}).withColumn(
        "residual_db", F.col("path_loss_db") - F.col("multiwall_pred_db")).drop("baseline_value")


def point_features(points: DataFrame, protocol: str, walls: Sequence[str], scenarios: Sequence[str],
                   configs: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Distance, walls and one-hot identity of point rows; identity of the held-out side is left out."""
    out = points.withColumn("log10_distance", F.log10(F.greatest("distance_m", F.lit(1e-3))))
    names = ["log10_distance", "distance_m", *walls]
    hot = []
    if protocol not in ("leave_scenario_out", "leave_scenario_fewshot"):
        hot += [("scenario", s) for s in scenarios]
    if protocol != "leave_config_out":
        hot += [("config", c) for c in configs]
    for column, value in hot:
        out = out.withColumn(f"{column}_{value}", (F.col(column) == value).cast("double"))
        names.append(f"{column}_{value}")
    return out, names


def survey_features(points: DataFrame, walls: Sequence[str], default_hz: float = 3.5e9) -> tuple[DataFrame, list[str]]:
    """Forest inputs of survey rows: log distance, frequency, wall counts and a visibility flag."""
    out = points.withColumn("log10_distance", F.log10(F.greatest("distance_m", F.lit(1e-3)))).withColumn(
        "frequency_hz", F.coalesce("frequency_hz", F.lit(float(default_hz)))).withColumn(
        "los_numeric", F.coalesce((F.upper("los_nlos") == "LOS").cast("double"), F.lit(0.0)))
    for w in walls:
        out = out.withColumn(w, F.coalesce(F.col(w).cast("double"), F.lit(0.0)))
    return out, ["log10_distance", "frequency_hz", *walls, "los_numeric"]
