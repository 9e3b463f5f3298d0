"""Bindings from the general-purpose star-schema tables to the radio data model.

Each view is a list of projection steps. The steps are plain SQL expressions that mean
the same in Spark and in ANSI engines, so `view_sql` can hand the same binding to an
outside engine for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RASTER_SIDE = 20
CELLS_PER_SAMPLE = RASTER_SIDE * RASTER_SIDE

# Every step keeps the columns listed and may refer only to those of the step before.
CELL_STEPS = [
    [
        "CAST(floor(o_orderkey / 4e2) AS INT) AS s",
        "CAST(o_orderkey % 400 AS INT) AS i",
        "o_orderkey",
        "o_totalprice",
    ],
    [
        "s", "o_orderkey", "o_totalprice",
        "CAST(i % 20 AS INT) AS x",
        "CAST(floor(i / 2e1) AS INT) AS y",
        "CAST(4 + s % 9 AS DOUBLE) + 3e-1 AS tx_x",
        "CAST(5 + s % 7 AS DOUBLE) + 2e-1 AS tx_y",
        "CASE s % 3 WHEN 0 THEN 8.68e8 WHEN 1 THEN 1.8e9 ELSE 3.5e9 END AS frequency_hz",
        "25e-2 AS resolution_m",
        "concat('B', CAST(s % 5 + 1 AS STRING), '_Ant', CAST(CAST(floor(s / 5e0) AS INT) % 5 + 1 AS STRING),"
        " '_f', CAST(s % 3 + 1 AS STRING), '_S', CAST(s AS STRING)) AS sample_id",
        "concat('B', CAST(s % 5 + 1 AS STRING)) AS scene_id",
    ],
    [
        "s", "o_orderkey", "o_totalprice", "x", "y", "tx_x", "tx_y", "frequency_hz", "resolution_m", "sample_id", "scene_id",
        "CAST(CASE WHEN x = 0 OR y = 0 OR x = 19 OR y = 19 THEN 1"
        " WHEN x = 7 + s % 5 AND y % 6 <> 3 THEN 2"
        " WHEN y = 11 AND x % 5 <> 2 THEN 3 ELSE 0 END AS INT) AS material",
        "sqrt((x - tx_x) * (x - tx_x) + (y - tx_y) * (y - tx_y)) * resolution_m AS raw_distance",
    ],
    [
        "sample_id", "scene_id", "y", "x", "CAST(20 AS INT) AS height", "CAST(20 AS INT) AS width",
        "tx_x", "tx_y", "frequency_hz", "resolution_m",
        "CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE"
        " 4e1 + 2e1 * log10(CASE WHEN raw_distance < 25e-2 THEN 25e-2 ELSE raw_distance END) + o_totalprice / 5e4 END AS path_loss",
        "material = 0 AS valid",
        "material > 0 AS wall",
        "material",
        "CASE WHEN material > 0 THEN material * 5e-1 + (o_orderkey % 7) / 1e1 ELSE 0e0 END AS transmittance",
        "CASE WHEN material > 0 THEN material * 25e-2 + (o_orderkey % 11) / 2e1 ELSE 0e0 END AS reflectance",
    ],
]

POINT_STEPS = [
    [
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),"
        " CAST(l_linenumber AS STRING)) AS coord",
        "l_orderkey AS reading",
        "CASE l_returnflag WHEN 'A' THEN 'Annex' WHEN 'N' THEN 'North' ELSE 'River' END AS scenario",
        "CASE l_linestatus WHEN 'F' THEN 'C1' ELSE 'C2' END AS config",
        "l_quantity AS distance_m",
        "CAST(l_linenumber % 4 AS DOUBLE) AS num_brick_wall",
        "CAST(CAST(round(l_discount * 100) AS INT) % 3 AS DOUBLE) AS num_wood_wall",
        "CAST(CAST(round(l_tax * 100) AS INT) % 3 AS DOUBLE) AS num_glass_wall",
        "CAST(l_partkey % 2 AS DOUBLE) AS num_drywall",
        "CAST(l_suppkey % 2 AS DOUBLE) AS num_column",
        "CAST(CASE WHEN l_linestatus = 'F' AND l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS elevator",
        "4e1 + 2e1 * log10(l_quantity) + l_extendedprice / 1e4 AS pl_db",
        "CAST(l_partkey % 50 AS DOUBLE) AS rx_x",
        "CAST(l_suppkey % 50 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 1e1 AS rx_y",
    ],
    [
        "concat('PL_', scenario, '_', config, '.csv::', coord) AS row_uid",
        "scenario", "config", "coord",
        "concat('PL_', scenario, '_', config, '.csv') AS source_file",
        "distance_m", "num_brick_wall", "num_wood_wall", "num_glass_wall", "num_drywall", "num_column", "elevator",
        "1e1 - pl_db AS p_rx_dbm", "pl_db", "rx_x", "rx_y", "reading",
    ],
]

WALL_COLUMNS = ("num_brick_wall", "num_wood_wall", "num_glass_wall", "num_drywall", "num_column", "elevator")
SCENARIOS = ("Annex", "North", "River")
CONFIGS = ("C1", "C2")

# One row per event; the per-map table averages repeated (method, sample, seed) keys.
METRIC_STEPS = [
    [
        "event_id",
        "CASE event_type WHEN 'view' THEN 'residual_extra' WHEN 'purchase' THEN 'direct_rf'"
        " WHEN 'error' THEN 'multi_wall' WHEN 'signup' THEN 'idw' ELSE 'log_distance' END AS method",
        "CAST(user_id AS INT) AS u",
        "CASE event_id % 3 WHEN 0 THEN 11 WHEN 1 THEN 22 ELSE 33 END AS sparse_seed",
        "CASE WHEN event_id % 211 = 7 THEN NULL ELSE value END AS value",
    ],
    [
        "method", "CAST(sparse_seed AS INT) AS sparse_seed",
        "CASE WHEN u % 2 = 0 THEN 'task2' ELSE 'task3' END AS task",
        "concat('B', CAST(u % 5 + 21 AS STRING), '_Ant', CAST(CAST(floor(u / 5e0) AS INT) % 5 + 1 AS STRING), '_f',"
        " CAST(u % 3 + 1 AS STRING), '_S', CAST(u AS STRING)) AS sample_id",
        "concat('B', CAST(u % 5 + 21 AS STRING)) AS scene_id",
        "value",
    ],
]
METRIC_KEYS = ("task", "method", "sparse_seed", "scene_id", "sample_id")
METRIC_AGGS = {
    "rmse": "avg(value)",
    "mae": "avg(value) * 7e-1",
    "p90_ae": "max(value)",
    "bias_db": "min(value) - 5e0",
}

MANIFEST_STEPS = [
    [
        "c_name AS sample_id",
        "concat('N', CAST(c_nationkey AS STRING)) AS scene_id",
        "concat('scenes/', c_name, '.npz') AS map_path",
        "CAST(c_custkey % 17 AS DOUBLE) - 3e0 AS tx_x",
        "CAST(c_custkey % 29 AS DOUBLE) - 4e0 AS tx_y",
        "c_acctbal * 1e6 AS frequency_hz",
        "c_mktsegment AS segment",
        "c_custkey",
    ],
]


def _project(df: DataFrame, steps: list[list[str]]) -> DataFrame:
    for step in steps:
        df = df.selectExpr(*step)
    return df


def _step_sql(table: str, steps: list[list[str]]) -> str:
    sql = table
    for n, step in enumerate(steps):
        sql = f"(SELECT {', '.join(step)} FROM {sql} AS step{n})" if n else f"(SELECT {', '.join(step)} FROM {sql})"
    return sql


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rasters, one row per cell; wall cells are invalid and a few targets are missing."""
    return _project(read_table(spark, sf_dir, "orders"), CELL_STEPS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point measurements, one row per reading."""
    return _project(read_table(spark, sf_dir, "lineitem"), POINT_STEPS)


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-map metric rows of several runs (seeds) and methods."""
    from pyspark.sql import functions as F

    raw = _project(read_table(spark, sf_dir, "events"), METRIC_STEPS)
    return raw.groupBy(*METRIC_KEYS).agg(*[F.expr(e).alias(n) for n, e in METRIC_AGGS.items()]).withColumn(
        "sparse_rate", F.expr("CAST(1e-2 AS DOUBLE)"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample index with its scene grouping."""
    return _project(read_table(spark, sf_dir, "customer"), MANIFEST_STEPS)


def view_sql(name: str) -> str:
    """The same binding as a common table expression body."""
    if name == "cells":
        return f"SELECT * FROM {_step_sql('orders', CELL_STEPS)}"
    if name == "points":
        return f"SELECT * FROM {_step_sql('lineitem', POINT_STEPS)}"
    if name == "manifest":
        return f"SELECT * FROM {_step_sql('customer', MANIFEST_STEPS)}"
    if name == "run_metrics":
        aggs = ", ".join(f"{e} AS {n}" for n, e in METRIC_AGGS.items())
        keys = ", ".join(METRIC_KEYS)
        return f"SELECT {keys}, {aggs}, CAST(1e-2 AS DOUBLE) AS sparse_rate FROM {_step_sql('events', METRIC_STEPS)} GROUP BY {keys}"
    raise KeyError(name)
