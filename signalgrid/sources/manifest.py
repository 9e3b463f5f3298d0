"""Sample index: a CSV with one row per raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalgrid.operators.cleaning import numeric

REQUIRED = ("scene_id", "sample_id", "scene_path")
NUMBERS = ("tx_x", "tx_y", "frequency_hz", "resolution_m")
COLUMNS = ("scene_id", "sample_id", "scene_path", "frequency_hz", "resolution_m", "height", "width", "task_id", "building_id",
           "antenna_id", "frequency_id", "sample_index")


def resolve_path(root: str, path: str = "scene_path") -> Column:
    """Absolute paths stay; others hang below the data root."""
    p = F.col(path)
    return F.when(p.startswith("/"), p).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), p))


def read_manifest(spark: SparkSession, path: str, data_root: str) -> DataFrame:
    """Read and check a manifest; columns beyond the contract are kept as text.

    Nothing is inferred, so the file is scanned once and only when used.
    """
    df = spark.read.option("header", True).csv(path)
    if "scene_path" not in df.columns and "map_path" in df.columns:
        df = df.withColumnRenamed("map_path", "scene_path")
    absent = [c for c in REQUIRED if c not in df.columns]
    if absent:
        raise ValueError(f"manifest {path} lacks columns {absent}")
    if df.isEmpty():
        raise ValueError(f"manifest {path} has no rows")
    for c in NUMBERS:
        if c in df.columns:
            df = df.withColumn(c, numeric(c))
    return df.withColumn("resolved_path", resolve_path(data_root))
