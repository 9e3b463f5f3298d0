"""Geometry, sampling, fits, interpolation and features on the raster view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalgrid.functions import hashing, pathloss as pl
from signalgrid.operators import features, fits, interpolation as interp, metrics, rays, sampling
from signalgrid.plans import evaluation as ev
from signalgrid.plans import views
from signalgrid.plans.geometry_store import stored_base_maps
from signalgrid.queries import sql_parts as sq
from signalgrid.queries.registry import query, scan_rows, tidy
from signalgrid.session import materialise

RATE, SEEDS = 0.1, (11, 22)
R = repr(RATE)


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_base_maps(views.read_table(spark, sf_dir, "orders"), views.cells(spark, sf_dir))


def bound(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the largest raster: the proven bound on groups whose keys name the sample."""
    return views.cells(spark, sf_dir).groupBy("sample_id").count().agg(F.max("count")).first()[0] or 0


def anchors(spark: SparkSession, sf_dir: str, rate: float = RATE, seeds=SEEDS) -> DataFrame:
    return ev.anchor_rows(maps(spark, sf_dir), [rate], list(seeds), 4, bound(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Physics predictions on all cells, and the anchors with their prediction."""
    # Anchors and fits are a small part of the cells and are read many times, so they are worked out once.
    taken = materialise(anchors(spark, sf_dir), "anchors")
    fitted = materialise(ev.physics_fits(taken), "fits")
    preds = ev.physics_predictions(maps(spark, sf_dir), fitted, [RATE], list(SEEDS))
    with_fit = taken.join(fitted.drop("anchor_count"), list(ev.SWEEP), "left").withColumn(
        "multi_wall_pred_db",
        F.coalesce(fits.linear_prediction(["log_d", *ev.MATERIALS], "mw_coef", "mw_intercept"), F.lit(0.0)))
    return preds, materialise(with_fit, "anchors-fitted")


def known(taken: DataFrame) -> DataFrame:
    return sampling.usable_anchors(taken).withColumn("residual", F.col("path_loss") - F.col("multi_wall_pred_db"))


ALL = sq.chain(sq.BASE_MAPS, sq.anchors(R, SEEDS), sq.FITS, sq.predictions(SEEDS, R), sq.KNOWN, sq.IDW)
FIT_CHAIN = sq.chain(sq.BASE_MAPS, sq.anchors(R, SEEDS), sq.FITS)

# --- scalar math -----------------------------------------------------------------


@query("mth1_distance_map", """
SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x,
  round(greatest(sqrt((x - tx_x) * (x - tx_x) + (y - tx_y) * (y - tx_y)) * resolution_m, 25e-2), 6) AS distance_m FROM cells""", ["cells"])
def mth1(spark, sf_dir):
    return tidy(views.cells(spark, sf_dir).select("sample_id", "y", "x", pl.distance_m().alias("distance_m")))


@query("mth2_fspl", """
SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(20 * log10(greatest(
  sqrt((x - tx_x) * (x - tx_x) + (y - tx_y) * (y - tx_y)) * resolution_m, 25e-2)) + 20 * log10(frequency_hz) - 147.55e0, 6) AS fspl_db
FROM cells""", ["cells"])
def mth2(spark, sf_dir):
    return tidy(views.cells(spark, sf_dir).select("sample_id", "y", "x", pl.fspl_db(pl.distance_m(), "frequency_hz", 0.25).alias("fspl_db")))


@query("mth3_log_distance_feature", """
SELECT row_uid, round(10 * log10(greatest(distance_m, 25e-2) / 1e0), 6) AS log_distance FROM points""", ["points"])
def mth3(spark, sf_dir):
    return tidy(views.points(spark, sf_dir).select("row_uid", pl.log_distance().alias("log_distance")))


@query("mth4_normalised_coordinates", """
SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(x / 19e0, 6) AS x_norm, round(y / 19e0, 6) AS y_norm FROM cells""", ["cells"])
def mth4(spark, sf_dir):
    return tidy(views.cells(spark, sf_dir).select(
        "sample_id", "y", "x", pl.normalised("x", "width").alias("x_norm"), pl.normalised("y", "height").alias("y_norm")))


@query("mth5_bounds_overflow", """
WITH o AS (SELECT sample_id, greatest(-tx_x, 0) AS l, greatest(tx_x - 9, 0) AS r, greatest(-tx_y, 0) AS t, greatest(tx_y - 19, 0) AS b FROM manifest),
w AS (SELECT *, greatest(l, r, t, b) AS m FROM o)
SELECT sample_id, CAST(l AS DOUBLE) AS over_left_px, CAST(r AS DOUBLE) AS over_right_px, CAST(t AS DOUBLE) AS over_top_px,
  CAST(b AS DOUBLE) AS over_bottom_px, CAST(m AS DOUBLE) AS max_clip_px, CAST(m * 25e-2 AS DOUBLE) AS max_clip_m, m > 0 AS out_of_bounds,
  m > 0 AND m <= 5 AS within_tolerance, m > 5 AS would_reject FROM w""", ["manifest"])
def mth5(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).withColumns({"width": F.lit(10), "height": F.lit(20), "resolution_m": F.lit(0.25)})
    return tidy(rows.select("sample_id", *[c.alias(n) for n, c in pl.edge_overflow().items()]))


@query("mth6_improvement_percent", """
SELECT row_uid, round(100 * (nullif(num_brick_wall, 0) - num_wood_wall) / nullif(num_brick_wall, 0), 6) AS gain FROM points""", ["points"])
def mth6(spark, sf_dir):
    return tidy(views.points(spark, sf_dir).select("row_uid", pl.improvement_percent("num_brick_wall", "num_wood_wall").alias("gain")))


@query("mth7_stable_hash", f"""
SELECT sample_id, CAST({sq.hash_sql("'split'", "scene_id", "sample_id", "'42'")} AS BIGINT) AS h FROM manifest""", ["manifest"])
def mth7(spark, sf_dir):
    return views.manifest(spark, sf_dir).select(
        "sample_id", hashing.stable_hash(F.lit("split"), "scene_id", "sample_id", F.lit("42")).alias("h"))


# --- rays ------------------------------------------------------------------------

# The raster a reading belongs to, by the same rule as the cells view.
OWN_RASTER = ("concat('B', CAST(s % 5 + 1 AS STRING), '_Ant', CAST(CAST(floor(s / 5e0) AS INT) % 5 + 1 AS STRING),"
              " '_f', CAST(s % 3 + 1 AS STRING), '_S', CAST(s AS STRING))")
SEGMENTS = """segs AS (SELECT row_uid, CAST(floor(reading / 4e2) AS INT) AS s, CAST(rx_x AS INT) % 20 AS x0, CAST(floor(rx_y) AS INT) % 20 AS y0,
  CAST(distance_m AS INT) % 20 AS x1, CAST(num_brick_wall * 5 AS INT) AS y1 FROM points)"""


def segments(spark, sf_dir):
    return views.points(spark, sf_dir).selectExpr(
        "row_uid", "CAST(floor(reading / 4e2) AS INT) AS s", "CAST(rx_x AS INT) % 20 AS x0", "CAST(floor(rx_y) AS INT) % 20 AS y0",
        "CAST(distance_m AS INT) % 20 AS x1", "CAST(num_brick_wall * 5 AS INT) AS y1")


@query("ray1_bresenham_line", f"""
WITH {SEGMENTS}, d AS (SELECT *, abs(x1 - x0) AS dx, abs(y1 - y0) AS dy FROM segs),
s AS (SELECT *, unnest(range(0, greatest(dx, dy) + 1)) AS step FROM d)
SELECT row_uid, CAST(step AS BIGINT) AS step,
  CAST(x0 + CASE WHEN x1 >= x0 THEN 1 ELSE -1 END * CASE WHEN dx >= dy THEN step ELSE (2 * step * dx + dy) // greatest(2 * dy, 1) END AS BIGINT) AS ray_x,
  CAST(y0 + CASE WHEN y1 >= y0 THEN 1 ELSE -1 END * CASE WHEN dx >= dy THEN (2 * step * dy + dx) // greatest(2 * dx, 1) ELSE step END AS BIGINT) AS ray_y
FROM s""", ["points"])
def ray1(spark, sf_dir):
    return tidy(rays.ray_cells(segments(spark, sf_dir)).select("row_uid", "step", "ray_x", "ray_y"))


@query("ray2_base_maps", sq.chain(sq.BASE_MAPS) + """
SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(distance_m, 6) AS distance_m, round(fspl_db, 6) AS fspl_db,
  CAST(los AS BIGINT) AS los, CAST(wall_count AS BIGINT) AS wall_count, round(wall_fraction, 6) AS wall_fraction,
  CAST(mat_1_count AS BIGINT) AS mat_1_count, CAST(mat_2_count AS BIGINT) AS mat_2_count, CAST(mat_3_count AS BIGINT) AS mat_3_count,
  round(CAST(transmittance_sum AS DOUBLE), 6) AS transmittance_sum, round(CAST(reflectance_sum AS DOUBLE), 6) AS reflectance_sum FROM maps""", ["cells"])
def ray2(spark, sf_dir):
    return tidy(rays.ray_base_maps(views.cells(spark, sf_dir)).drop(
        "scene_id", "path_loss", "wall", "height", "width", "frequency_hz", "resolution_m"))


RAY3_SQL = f"""
WITH {SEGMENTS}, d AS (SELECT *, abs(x1 - x0) AS dx, abs(y1 - y0) AS dy FROM segs),
s AS (SELECT *, unnest(range(0, greatest(dx, dy) + 1)) AS step FROM d),
c AS (SELECT row_uid, {OWN_RASTER} AS sample_id,
  x0 + CASE WHEN x1 >= x0 THEN 1 ELSE -1 END * CASE WHEN dx >= dy THEN step ELSE (2 * step * dx + dy) // greatest(2 * dy, 1) END AS rx,
  y0 + CASE WHEN y1 >= y0 THEN 1 ELSE -1 END * CASE WHEN dx >= dy THEN (2 * step * dy + dx) // greatest(2 * dx, 1) ELSE step END AS ry FROM s),
w AS (SELECT sample_id, x, y, material FROM cells WHERE material > 0)
SELECT row_uid, count(material) AS wall_count, count(material) = 0 AS los, count(*) FILTER (material = 1) AS mat_1_count,
  count(*) FILTER (material = 2) AS mat_2_count, count(*) FILTER (material = 3) AS mat_3_count
FROM c LEFT JOIN w ON w.sample_id = c.sample_id AND w.x = c.rx AND w.y = c.ry GROUP BY 1"""


@query("ray3_line_material_stats", RAY3_SQL, ["points", "cells"])
def ray3(spark, sf_dir):
    segs = segments(spark, sf_dir).withColumn("sample_id", F.expr(OWN_RASTER))
    return tidy(rays.segment_material_stats(segs, views.cells(spark, sf_dir), ["row_uid"]))


@query("ray4_static_feature_frame", sq.chain(sq.BASE_MAPS) + """
SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(distance_m, 6) AS distance_m, CAST(los AS BIGINT) AS los,
  CAST(wall_count AS BIGINT) AS wall_count, CAST(mat_1_count AS BIGINT) AS count_mat_1, CAST(mat_2_count AS BIGINT) AS count_mat_2,
  CAST(mat_3_count AS BIGINT) AS count_mat_3 FROM maps""", ["cells"])
def ray4(spark, sf_dir):
    # The minimum distance is the cell size, which is the stored one here.
    return tidy(maps(spark, sf_dir).select(
        "sample_id", "y", "x", "distance_m", "los", "wall_count", *[F.col(f"mat_{m}_count").alias(f"count_mat_{m}") for m in (1, 2, 3)]))


@query("ray5_geometry_reuse", sq.chain(sq.BASE_MAPS) + """
SELECT sample_id, count(*) AS cells, CAST(sum(wall_count) AS BIGINT) AS walls, round(avg(wall_fraction), 6) AS wall_fraction FROM maps GROUP BY 1""", ["cells"])
def ray5(spark, sf_dir):
    maps(spark, sf_dir)
    again = maps(spark, sf_dir)  # read back, not traced again
    return tidy(again.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("wall_count").alias("walls"), F.avg("wall_fraction").alias("wall_fraction")))


# --- sampling --------------------------------------------------------------------


@query("smp1_sparse_anchors", sq.chain(
    "valid_cells AS (SELECT sample_id, y, x FROM cells WHERE valid)",
    sq.anchors("0.05", (11, 22), 4, "valid_cells", "a05"), sq.anchors("0.1", (11, 22), 4, "valid_cells", "a10")) + """
SELECT sample_id, rate, CAST(seed AS BIGINT) AS seed, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM a05
UNION ALL SELECT sample_id, rate, CAST(seed AS BIGINT), CAST(y AS BIGINT), CAST(x AS BIGINT) FROM a10""", ["cells"])
def smp1(spark, sf_dir):
    valid = views.cells(spark, sf_dir).where("valid").select("sample_id", "y", "x")
    return tidy(sampling.sparse_anchors(valid, [0.05, 0.1], [11, 22], 4, bound(spark, sf_dir)).select("sample_id", "rate", "seed", "y", "x"))


@query("smp2_anchor_validity", sq.chain("valid_cells AS (SELECT sample_id, y, x FROM cells WHERE valid)",
                                        sq.anchors("0.05", (11,), 4, "valid_cells", "a05")) + """
SELECT a.sample_id, CAST(count(*) AS BIGINT) AS anchors, CAST(count(*) FILTER (NOT c.valid) AS BIGINT) AS outside FROM a05 a
JOIN cells c USING (sample_id, y, x) GROUP BY 1""", ["cells"])
def smp2(spark, sf_dir):
    valid = views.cells(spark, sf_dir).where("valid").select("sample_id", "y", "x")
    taken = sampling.sparse_anchors(valid, [0.05], [11], 4, bound(spark, sf_dir))
    outside = sampling.anchors_outside_valid(taken, valid).groupBy("sample_id").agg(F.count(F.lit(1)).alias("outside"))
    return taken.groupBy("sample_id").agg(F.count(F.lit(1)).alias("anchors")).join(outside, "sample_id", "left").select(
        "sample_id", "anchors", F.coalesce("outside", F.lit(0).cast("bigint")).alias("outside"))


@query("smp3_usable_anchors", sq.chain("valid_cells AS (SELECT sample_id, y, x, path_loss FROM cells WHERE valid)",
                                       sq.anchors("0.1", (11, 22), 4, "valid_cells", "a")) + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(path_loss, 6) AS path_loss
FROM a WHERE path_loss IS NOT NULL""", ["cells"])
def smp3(spark, sf_dir):
    valid = views.cells(spark, sf_dir).where("valid").select("sample_id", "y", "x", "path_loss")
    taken = sampling.sparse_anchors(valid, [0.1], [11, 22], 4, bound(spark, sf_dir))
    return tidy(sampling.usable_anchors(taken).select("sample_id", "seed", "y", "x", "path_loss"))


def _top_sql(tag: str, seed: str, cap: int) -> str:
    h = sq.hash_sql(f"'{tag}'", f"'{seed}'", "sample_id", "CAST(y AS VARCHAR)", "CAST(x AS VARCHAR)")
    return f"""SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM (SELECT *, row_number() OVER (
      PARTITION BY sample_id ORDER BY {h}, y, x) AS rn FROM cells WHERE valid) WHERE rn <= {cap}"""


@query("smp4_training_row_cap", _top_sql("train", "42", 150), ["cells"])
def smp4(spark, sf_dir):
    rows = views.cells(spark, sf_dir).where("valid").select("sample_id", "y", "x")
    return tidy(sampling.training_rows(rows, 150, 42, ["sample_id"], bound(spark, sf_dir)))


@query("smp5_frame_anchors", f"""
SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, row_number() OVER (
  PARTITION BY sample_id ORDER BY {sq.hash_sql("'frame'", "'7'", "sample_id", "CAST(y AS VARCHAR)", "CAST(x AS VARCHAR)")}, y, x) AS rn FROM cells)
WHERE rn <= least(n, greatest(10, CAST(ceil(n * 3e-2) AS BIGINT)))""", ["cells"])
def smp5(spark, sf_dir):
    rows = views.cells(spark, sf_dir).select("sample_id", "y", "x")
    rank = hashing.stable_hash(F.lit("frame"), F.lit("7"), "sample_id", "y", "x")
    return tidy(sampling.take_smallest(rows, ["sample_id"], sampling.frame_count(0.03, 10), rank, ("y", "x"), bound(spark, sf_dir)))


FEWSHOT_HASH = sq.hash_sql("'fewshot'", "'fraction'", "'0.01'", "'101'", "row_uid")


@query("smp6_fewshot_anchors", f"""
SELECT row_uid, scenario, rn <= least(greatest(1, CAST(round_even(n * 1e-2, 0) AS BIGINT)), greatest(1, n - 1)) AS is_anchor FROM (
  SELECT row_uid, scenario, count(*) OVER (PARTITION BY scenario) AS n,
  row_number() OVER (PARTITION BY scenario ORDER BY {FEWSHOT_HASH}, row_uid) AS rn FROM points)""", ["points"])
def smp6(spark, sf_dir):
    rows = views.points(spark, sf_dir).select("row_uid", "scenario")
    rank = hashing.stable_hash(F.lit("fewshot"), F.lit("fraction"), F.lit("0.01"), F.lit("101"), "row_uid")
    return sampling.take_smallest(rows, ["scenario"], sampling.fewshot_count("fraction", 0.01, 0), rank, ("row_uid",),
                                  scan_rows(spark, sf_dir, "lineitem"), mark="is_anchor", few_groups=True)


@query("smp7_audit_pixel_subset", _top_sql("audit", "3", 64), ["cells"])
def smp7(spark, sf_dir):
    rows = views.cells(spark, sf_dir).where("valid").select("sample_id", "y", "x")
    rank = hashing.stable_hash(F.lit("audit"), F.lit("3"), "sample_id", "y", "x")
    return tidy(sampling.take_smallest(rows, ["sample_id"], sampling.capped_count(64), rank, ("y", "x"), bound(spark, sf_dir)))


# --- fits ------------------------------------------------------------------------


@query("fit1_log_distance", FIT_CHAIN + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, status, round(slope, 6) AS slope, round(intercept, 6) AS intercept, anchor_count FROM log_fits""", ["cells"])
def fit1(spark, sf_dir):
    taken = sampling.usable_anchors(anchors(spark, sf_dir))
    return tidy(fits.log_distance_fits(taken, ev.SWEEP).select("sample_id", "seed", "status", "slope", "intercept", "anchor_count"))


@query("fit1_maps_without_anchors", FIT_CHAIN + """, near AS (SELECT sample_id, seed, count(path_loss) AS n, avg(path_loss) AS my, avg(log_d) AS mx, count(path_loss) * covar_pop(log_d, path_loss) / (count(path_loss) * var_pop(log_d) + 1e-6) AS w
  FROM anchors WHERE y = 0 AND path_loss IS NOT NULL GROUP BY 1, 2),
every AS (SELECT m.sample_id, s.seed FROM (SELECT DISTINCT sample_id FROM cells) m, (SELECT DISTINCT seed FROM anchors) s)
SELECT sample_id, CAST(seed AS BIGINT) AS seed, coalesce(n, 0) AS anchor_count, CASE WHEN n >= 2 THEN 'log_distance' ELSE 'log_distance_fallback_anchor_mean' END AS status,
  coalesce(n, 0) >= 2 AS fitted, round(CASE WHEN n >= 2 THEN w ELSE 0 END, 5) AS slope,
  round(coalesce(my - CASE WHEN n >= 2 THEN w ELSE 0 END * mx, 0), 5) AS intercept FROM every LEFT JOIN near USING (sample_id, seed)""", ["cells"])
def fit1_empty(spark, sf_dir):
    """Only anchors of the first raster row count, so most maps have one or none; every map and seed keeps its row."""
    every = maps(spark, sf_dir).select("sample_id").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    near = sampling.usable_anchors(anchors(spark, sf_dir)).where("y = 0")
    out = fits.log_distance_fits(near, ["sample_id", "seed"], groups=every)
    return tidy(out.select("sample_id", "seed", "anchor_count", "status", (F.col("status") == "log_distance").alias("fitted"), "slope", "intercept"), 5)


@query("fit2_multi_wall", FIT_CHAIN + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, status, round(w0, 4) AS w_log, round(w1, 4) AS w_mat_1, round(w2, 4) AS w_mat_2,
  round(w3, 4) AS w_mat_3, round(intercept, 4) AS intercept, anchor_count FROM wall_fits""", ["cells"])
def fit2(spark, sf_dir):
    out = fits.multi_wall_fits(sampling.usable_anchors(anchors(spark, sf_dir)), ev.SWEEP, ev.MATERIALS)
    names = ["w_log", "w_mat_1", "w_mat_2", "w_mat_3"]
    return tidy(out.select("sample_id", "seed", "status", *[F.get("coef", F.lit(i)).alias(n) for i, n in enumerate(names)],
                           "intercept", "anchor_count"), 4)


@query("fit3_design_rank", FIT_CHAIN + """,
g0 AS (SELECT sample_id, seed, count(*) AS anchor_count, sum(log_d * log_d) AS a00, sum(log_d * mat_2_count) AS a01, sum(log_d * mat_3_count) AS a02,
  sum(mat_2_count * mat_2_count) AS a11, sum(mat_2_count * mat_3_count) AS a12, sum(mat_3_count * mat_3_count) AS a22, sum(mat_1_count) AS b
  FROM anchors WHERE path_loss IS NOT NULL GROUP BY 1, 2),
g1 AS (SELECT *, CASE WHEN a00 > 0 THEN a11 - a01 * a01 / a00 ELSE a11 END AS p1, CASE WHEN a00 > 0 THEN a12 - a01 * a02 / a00 ELSE a12 END AS q,
  CASE WHEN a00 > 0 THEN a22 - a02 * a02 / a00 ELSE a22 END AS p2 FROM g0)
SELECT sample_id, CAST(seed AS BIGINT) AS seed, anchor_count, CAST(CASE WHEN a00 > 0 THEN 1 ELSE 0 END + CASE WHEN p1 > 1e-6 THEN 1 ELSE 0 END
  + CASE WHEN CASE WHEN p1 > 1e-6 THEN p2 - q * q / p1 ELSE p2 END > 1e-6 THEN 1 ELSE 0 END AS BIGINT) AS design_rank FROM g1""", ["cells"])
def fit3(spark, sf_dir):
    taken = sampling.usable_anchors(anchors(spark, sf_dir))
    return tidy(fits.ridge_fits(taken, ["sample_id", "seed"], ["log_d", "mat_2_count", "mat_3_count"], "path_loss", 1e-6).select(
        "sample_id", "seed", F.col("n").alias("anchor_count"), "design_rank"))


@query("fit4_free_log_distance", """
WITH s AS (SELECT count(*) AS n, avg(log10(distance_m)) AS mx, avg(pl_db) AS my, var_pop(log10(distance_m)) AS vx, covar_pop(log10(distance_m), pl_db) AS vxy FROM points)
SELECT round(n * vxy / (n * vx + 1e-3), 6) AS slope_db_per_decade, round(my - n * vxy / (n * vx + 1e-3) * mx, 6) AS reference_db, n FROM s""", ["points"])
def fit4(spark, sf_dir):
    return tidy(fits.free_log_distance_fit(views.points(spark, sf_dir), "distance_m", "pl_db", 1.0, 1e-3))


FOLD_X = ("lg", *views.WALL_COLUMNS)


@query("fit5_fold_regressions", "WITH src AS (SELECT f.fold, log10(greatest(p.distance_m, 1e-3)) AS lg, p.* FROM points p JOIN (VALUES ('Annex'), ('North'), ('River')) f(fold) ON p.scenario <> f.fold),\n"
       + sq.ridge("mw", "src", ("fold",), FOLD_X, "pl_db", "1e0") + ",\n" + sq.ridge("ols", "src", ("fold",), ("lg",), "pl_db", "0e0") + """
SELECT fold, mw.n, round(ols.w0, 5) AS ols_slope, round(ols.intercept, 5) AS ols_intercept, round(mw.w0, 5) AS ridge_log, round(mw.w1, 5) AS ridge_brick,
  round(mw.w6, 5) AS ridge_elevator, round(mw.intercept, 5) AS ridge_intercept FROM mw JOIN ols USING (fold)""", ["points"])
def fit5(spark, sf_dir):
    from signalgrid.operators.splits import leave_out_train
    train = leave_out_train(views.points(spark, sf_dir), "scenario", views.SCENARIOS).withColumn(
        "lg", F.log10(F.greatest("distance_m", F.lit(1e-3))))
    ols = fits.ridge_fits(train, ["fold"], ["lg"], "pl_db", 0.0).select(
        "fold", F.get("coef", F.lit(0)).alias("ols_slope"), F.col("intercept").alias("ols_intercept"))
    ridge = fits.ridge_fits(train, ["fold"], FOLD_X, "pl_db", 1.0)
    return tidy(ridge.join(ols, "fold").select(
        "fold", "n", "ols_slope", "ols_intercept", F.get("coef", F.lit(0)).alias("ridge_log"), F.get("coef", F.lit(1)).alias("ridge_brick"),
        F.get("coef", F.lit(6)).alias("ridge_elevator"), F.col("intercept").alias("ridge_intercept")), 5)


@query("fit6_bias_calibration", f"""
WITH m AS (SELECT *, 4e1 + 2e1 * log10(distance_m) AS pred, count(*) OVER (PARTITION BY scenario) AS n,
  row_number() OVER (PARTITION BY scenario ORDER BY {FEWSHOT_HASH}, row_uid) AS rn FROM points),
a AS (SELECT *, rn <= least(greatest(1, CAST(round_even(n * 1e-2, 0) AS BIGINT)), greatest(1, n - 1)) AS is_anchor FROM m),
b AS (SELECT scenario, avg(pl_db - pred) AS bias FROM a WHERE is_anchor GROUP BY 1)
SELECT row_uid, scenario, round(pred + bias, 6) AS calibrated FROM a JOIN b USING (scenario) WHERE NOT is_anchor""", ["points"])
def fit6(spark, sf_dir):
    rows = views.points(spark, sf_dir).withColumn("pred", 40.0 + 20.0 * F.log10("distance_m"))
    rank = hashing.stable_hash(F.lit("fewshot"), F.lit("fraction"), F.lit("0.01"), F.lit("101"), "row_uid")
    marked = sampling.take_smallest(rows, ["scenario"], sampling.fewshot_count("fraction", 0.01, 0), rank, ("row_uid",),
                                    scan_rows(spark, sf_dir, "lineitem"), mark="is_anchor", few_groups=True)
    out = fits.bias_calibrated(marked.where("NOT is_anchor"), marked.where("is_anchor"), ["scenario"], "pred", "pl_db")
    return tidy(out.select("row_uid", "scenario", "calibrated"))


# --- interpolation ---------------------------------------------------------------


@query("idw1_predict_points", ALL + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(idw_path_loss, 5) AS idw_path_loss, exact_hit FROM idw""", ["cells"])
def idw1(spark, sf_dir):
    preds, taken = predictions(spark, sf_dir)
    out = interp.raster_idw(preds.select(*ev.SWEEP, "y", "x"), known(taken), ["path_loss"], max_rate=RATE)
    return tidy(out.select("sample_id", "seed", "y", "x", "idw_path_loss", "exact_hit"), 5)


@query("idw2_map_from_mask", sq.chain(sq.BASE_MAPS, sq.anchors(R, (11,), 4)) + """,
ok AS (SELECT * FROM anchors WHERE path_loss IS NOT NULL AND scene_id <> 'B3'),
m AS (SELECT sample_id, avg(path_loss) AS mean_anchor FROM ok GROUP BY 1),
p AS (SELECT q.sample_id, q.y, q.x, k.path_loss AS v, (q.x - k.x) * (q.x - k.x) + (q.y - k.y) * (q.y - k.y) AS d2 FROM maps q JOIN ok k USING (sample_id)),
i AS (SELECT sample_id, y, x, coalesce(min(v) FILTER (d2 = 0), sum(v / greatest(d2, 1e-12)) / sum(1 / greatest(d2, 1e-12))) AS v FROM p GROUP BY 1, 2, 3)
SELECT c.sample_id, CAST(c.y AS BIGINT) AS y, CAST(c.x AS BIGINT) AS x, round(coalesce(i.v, m.mean_anchor, -1e0), 5) AS value
FROM cells c LEFT JOIN i USING (sample_id, y, x) LEFT JOIN m ON m.sample_id = c.sample_id""", ["cells"])
def idw2(spark, sf_dir):
    # Scene B3 gets no anchors: its cells take the constant. Cells outside the query mask
    # take the mean of the anchors.
    taken = sampling.usable_anchors(anchors(spark, sf_dir, RATE, (11,))).where("scene_id <> 'B3'")
    valid = ev.sweep_cells(maps(spark, sf_dir), [RATE], [11]).select(*ev.SWEEP, "y", "x")
    shaped = interp.raster_idw(valid, taken, ["path_loss"], max_rate=RATE)
    means = taken.groupBy("sample_id").agg(F.avg("path_loss").alias("mean_anchor"))
    every = views.cells(spark, sf_dir).select("sample_id", "y", "x")
    out = every.join(shaped, ["sample_id", "y", "x"], "left").join(means, "sample_id", "left")
    return tidy(interp.fill_empty(out, "idw_path_loss", F.coalesce("mean_anchor", F.lit(-1.0))).select(
        "sample_id", "y", "x", F.col("idw_path_loss").alias("value")), 5)


@query("idw3_path_loss_baseline", ALL + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, count(*) AS cells, round(sqrt(avg((p - path_loss) * (p - path_loss))), 5) AS rmse FROM (
  SELECT q.*, coalesce(i.idw_path_loss, avg(q.multi_wall_pred_db) OVER (PARTITION BY q.sample_id, q.seed), 0) AS p
  FROM preds q LEFT JOIN idw i USING (sample_id, seed, y, x)) GROUP BY 1, 2""", ["cells"])
def idw3(spark, sf_dir):
    preds, taken = predictions(spark, sf_dir)
    shaped = interp.raster_idw(preds.select(*ev.SWEEP, "y", "x", "path_loss"), known(taken), ["path_loss"], max_rate=RATE)
    means = preds.groupBy("sample_id", "seed").agg(F.avg("multi_wall_pred_db").alias("mean_mw"))
    e = F.coalesce("idw_path_loss", "mean_mw", F.lit(0.0)) - F.col("path_loss")
    return tidy(shaped.join(means, ["sample_id", "seed"]).groupBy("sample_id", "seed").agg(
        F.count(F.lit(1)).alias("cells"), F.sqrt(F.avg(e * e)).alias("rmse")), 5)


@query("idw4_multi_wall_residual", ALL + """
SELECT q.sample_id, CAST(q.seed AS BIGINT) AS seed, CAST(q.y AS BIGINT) AS y, CAST(q.x AS BIGINT) AS x,
  round(q.multi_wall_pred_db + coalesce(i.idw_residual, 0), 4) AS pred FROM preds q LEFT JOIN idw i USING (sample_id, seed, y, x)""", ["cells"])
def idw4(spark, sf_dir):
    preds, taken = predictions(spark, sf_dir)
    shaped = interp.raster_idw(preds.select(*ev.SWEEP, "y", "x", "multi_wall_pred_db"), known(taken), ["residual"], max_rate=RATE)
    return tidy(shaped.select("sample_id", "seed", "y", "x",
                              (F.col("multi_wall_pred_db") + F.coalesce("idw_residual", F.lit(0.0))).alias("pred")), 4)


@query("idw5_anchor_residual_feature", ALL + """
SELECT q.sample_id, CAST(q.seed AS BIGINT) AS seed, CAST(q.y AS BIGINT) AS y, CAST(q.x AS BIGINT) AS x,
  round(coalesce(i.idw_residual, m.r, 0), 4) AS anchor_residual_idw FROM preds q LEFT JOIN idw i USING (sample_id, seed, y, x)
LEFT JOIN (SELECT sample_id, seed, avg(residual) AS r FROM known GROUP BY 1, 2) m USING (sample_id, seed)""", ["cells"])
def idw5(spark, sf_dir):
    preds, taken = predictions(spark, sf_dir)
    anchors_known = known(taken)
    shaped = interp.raster_idw(preds.select(*ev.SWEEP, "y", "x"), anchors_known, ["residual"], max_rate=RATE)
    mean = anchors_known.groupBy("sample_id", "seed").agg(F.avg("residual").alias("r"))
    return tidy(shaped.join(mean, ["sample_id", "seed"], "left").select(
        "sample_id", "seed", "y", "x", F.coalesce("idw_residual", "r", F.lit(0.0)).alias("anchor_residual_idw")), 4)


@query("idw6_frame_anchor_features", ALL + """,
pm AS (SELECT q.sample_id, q.seed, q.y, q.x, k.path_loss, k.residual, ((q.x - k.x) * (q.x - k.x) + (q.y - k.y) * (q.y - k.y)) * 625e-4 AS d2
  FROM preds q JOIN known k ON k.sample_id = q.sample_id AND k.seed = q.seed)
SELECT sample_id, CAST(seed AS BIGINT) AS seed, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, count(*) FILTER (d2 = 0) > 0 AS is_anchor,
  round(coalesce(min(path_loss) FILTER (d2 = 0), sum(path_loss / d2) / sum(1 / d2)), 4) AS idw_path_loss,
  round(coalesce(min(residual) FILTER (d2 = 0), sum(residual / d2) / sum(1 / d2)), 4) AS idw_residual
FROM (SELECT * REPLACE (CASE WHEN d2 = 0 THEN 0 ELSE d2 END AS d2) FROM pm) GROUP BY 1, 2, 3, 4""".replace("path_loss / d2", "path_loss / nullif(d2, 0)").replace(
    "residual / d2", "residual / nullif(d2, 0)").replace("1 / d2", "1 / nullif(d2, 0)"), ["cells"])
def idw6(spark, sf_dir):
    # Positions in metres: both interpolations come from one pass over the pairs.
    preds, taken = predictions(spark, sf_dir)
    metre = {"xm": F.col("x") * F.col("resolution_m"), "ym": F.col("y") * F.col("resolution_m")}
    q = preds.withColumns(metre).select(*ev.SWEEP, "y", "x", "ym", "xm")
    out = interp.anchor_features(q, known(taken).withColumns(metre), ev.SWEEP, ("y", "x"), ["path_loss", "residual"],
                                 interp.raster_tiles(), interp.raster_tiles(interp.anchor_block_side(RATE)), x="xm", y="ym")
    return tidy(out.select("sample_id", "seed", "y", "x", F.col("exact_hit").alias("is_anchor"), "idw_path_loss", "idw_residual"), 4)


@query("idw7_fewshot_target_idw", f"""
WITH m AS (SELECT *, count(*) OVER (PARTITION BY scenario) AS n, row_number() OVER (PARTITION BY scenario ORDER BY {FEWSHOT_HASH}, row_uid) AS rn FROM points),
a AS (SELECT *, rn <= least(greatest(1, CAST(round_even(n * 1e-2, 0) AS BIGINT)), greatest(1, n - 1)) AS is_anchor FROM m),
p AS (SELECT t.row_uid, k.pl_db, 1 / ((sqrt((t.rx_x - k.rx_x) * (t.rx_x - k.rx_x) + (t.rx_y - k.rx_y) * (t.rx_y - k.rx_y)) + 1e-6)
  * (sqrt((t.rx_x - k.rx_x) * (t.rx_x - k.rx_x) + (t.rx_y - k.rx_y) * (t.rx_y - k.rx_y)) + 1e-6)) AS w
  FROM a t JOIN a k ON k.scenario = t.scenario AND k.is_anchor AND NOT t.is_anchor)
SELECT row_uid, round(sum(w * pl_db) / sum(w), 3) AS pred FROM p GROUP BY 1""", ["points"])
def idw7(spark, sf_dir):
    rows = views.points(spark, sf_dir).select("row_uid", "scenario", "rx_x", "rx_y", "pl_db")
    rank = hashing.stable_hash(F.lit("fewshot"), F.lit("fraction"), F.lit("0.01"), F.lit("101"), "row_uid")
    marked = sampling.take_smallest(rows, ["scenario"], sampling.fewshot_count("fraction", 0.01, 0), rank, ("row_uid",),
                                    scan_rows(spark, sf_dir, "lineitem"), mark="is_anchor", few_groups=True)
    out = interp.point_idw(marked.where("NOT is_anchor").drop("is_anchor"), marked.where("is_anchor"), ["scenario"], "pl_db")
    return tidy(out.select("row_uid", F.col("idw_pl_db").alias("pred")), 3)


@query("knn1_nearest_anchors", ALL + "," + sq.KNN + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(d1, 6) AS dist_1, round(d2, 6) AS dist_2,
  round(d3, 6) AS dist_3, round(d4, 6) AS dist_4, round(v1, 4) AS residual_1, round(v2, 4) AS residual_2, round(v3, 4) AS residual_3, round(v4, 4) AS residual_4 FROM near""", ["cells"])
def knn1(spark, sf_dir):
    preds, taken = predictions(spark, sf_dir)
    out = interp.raster_idw(preds.select(*ev.SWEEP, "y", "x"), known(taken), ["residual"], max_rate=RATE, k=4)
    return tidy(out.select("sample_id", "seed", "y", "x", *[F.col(f"nn_dist_{i}").alias(f"dist_{i}") for i in range(1, 5)],
                           *[F.round(f"nn_value_{i}", 4).alias(f"residual_{i}") for i in range(1, 5)]))


@query("knn2_neighbour_block", sq.chain(sq.BASE_MAPS, sq.anchors("0.001", (11,), 1).replace("greatest(1,", "greatest(1 + CAST(substr(scene_id, 2) AS INT) % 5,")) + """,
known AS (SELECT sample_id, seed, y, x, path_loss AS residual, path_loss FROM anchors WHERE path_loss IS NOT NULL),
preds AS (SELECT *, 11 AS seed FROM maps),
""" + sq.IDW + "," + sq.KNN + """
SELECT q.sample_id, CAST(q.y AS BIGINT) AS y, CAST(q.x AS BIGINT) AS x,
  round(coalesce(d1, f.far + 1, 0), 6) AS dist_1, round(coalesce(d2, f.far + 1, 0), 6) AS dist_2, round(coalesce(d3, f.far + 1, 0), 6) AS dist_3,
  round(coalesce(d4, f.far + 1, 0), 6) AS dist_4, round(coalesce(v1, 0), 6) AS value_1, round(coalesce(v2, 0), 6) AS value_2,
  round(coalesce(v3, 0), 6) AS value_3, round(coalesce(v4, 0), 6) AS value_4
FROM preds q LEFT JOIN near n USING (sample_id, seed, y, x) LEFT JOIN near_far f ON f.sample_id = q.sample_id AND f.seed = q.seed""", ["cells"])
def knn2(spark, sf_dir):
    # Scenes ask for one to five anchors, so some maps have fewer than four.
    base = ev.with_log_distance(maps(spark, sf_dir)).withColumns({"rate": F.lit(0.001), "seed": F.lit(11)})
    want = 1 + F.substring("scene_id", 2, 9).cast("int") % 5
    rank = hashing.stable_hash(F.lit("anchor"), "sample_id", F.lit("0.001"), "seed", "y", "x")
    taken = sampling.take_smallest(
        base, ["sample_id", "rate", "seed", "scene_id"], lambda n: F.least(n, F.greatest(want, F.ceil(n * F.lit(0.001)))), rank,
        ("y", "x"), bound(spark, sf_dir))
    out = interp.raster_idw(base.select(*ev.SWEEP, "y", "x"), sampling.usable_anchors(taken), ["path_loss"], max_rate=0.001, k=4)
    out = interp.pad_neighbours(out, ev.SWEEP, 4)
    return tidy(out.select("sample_id", "y", "x", *[F.col(f"nn_dist_{i}").alias(f"dist_{i}") for i in range(1, 5)],
                           *[F.col(f"nn_value_{i}").alias(f"value_{i}") for i in range(1, 5)]))


@query("knn3_anchor_density", sq.chain(sq.BASE_MAPS, sq.anchors(R, SEEDS)) + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, round(count(*) / CAST(max(n_valid) AS DOUBLE), 6) AS anchor_density FROM anchors GROUP BY 1, 2""", ["cells"])
def knn3(spark, sf_dir):
    return tidy(interp.anchor_density(maps(spark, sf_dir), anchors(spark, sf_dir)).select("sample_id", "seed", "anchor_density"))


# --- features --------------------------------------------------------------------

FEATURES_SQL = ALL + "," + sq.KNN + """,
feats AS (SELECT q.sample_id, q.seed, q.scene_id, q.y, q.x, q.path_loss, q.wall, q.x / 19e0 AS x_norm, q.y / 19e0 AS y_norm, q.distance_m,
  log10(greatest(q.distance_m, 1e-6)) AS log10_distance_m, q.fspl_db, q.los, q.wall_count, q.wall_fraction, q.mat_1_count, q.mat_2_count, q.mat_3_count,
  q.transmittance_sum, q.reflectance_sum, q.fspl_pred_db, q.log_distance_pred_db, q.multi_wall_pred_db,
  q.multi_wall_pred_db + coalesce(i.idw_residual, 0) AS multi_wall_residual_idw_pred_db, coalesce(i.idw_residual, m.r, 0) AS anchor_residual_idw,
  coalesce(n.v1, 0) AS anchor_residual_nn_1, coalesce(n.v2, 0) AS anchor_residual_nn_2, coalesce(n.v3, 0) AS anchor_residual_nn_3, coalesce(n.v4, 0) AS anchor_residual_nn_4,
  coalesce(n.d1, f.far + 1, 0) AS anchor_dist_px_nn_1, coalesce(n.d2, f.far + 1, 0) AS anchor_dist_px_nn_2,
  coalesce(n.d3, f.far + 1, 0) AS anchor_dist_px_nn_3, coalesce(n.d4, f.far + 1, 0) AS anchor_dist_px_nn_4,
  coalesce(t.taken, 0) / CAST(t.n_valid AS DOUBLE) AS anchor_density
  FROM preds q LEFT JOIN idw i USING (sample_id, seed, y, x) LEFT JOIN near n USING (sample_id, seed, y, x)
  LEFT JOIN near_far f ON f.sample_id = q.sample_id AND f.seed = q.seed
  LEFT JOIN (SELECT sample_id, seed, avg(residual) AS r FROM known GROUP BY 1, 2) m ON m.sample_id = q.sample_id AND m.seed = q.seed
  LEFT JOIN (SELECT sample_id, seed, count(*) AS taken, max(n_valid) AS n_valid FROM anchors GROUP BY 1, 2) t ON t.sample_id = q.sample_id AND t.seed = q.seed)
"""


def feature_table(spark, sf_dir, k: int = 4) -> DataFrame:
    preds, taken = predictions(spark, sf_dir)
    density = interp.anchor_density(maps(spark, sf_dir), taken)
    return features.dense_features(preds, taken, density, RATE, k)


NUMERIC = [n for n in features.feature_names() if n not in ("los", "wall_count", "mat_1_count", "mat_2_count", "mat_3_count")]
INTEGER = ["los", "wall_count", "mat_1_count", "mat_2_count", "mat_3_count"]


@query("fea1_feature_table", FEATURES_SQL + "SELECT sample_id, CAST(seed AS BIGINT) AS seed, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, "
       + ", ".join(f"round(CAST({n} AS DOUBLE), 4) AS {n}" for n in NUMERIC) + ", " + ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in INTEGER)
       + " FROM feats", ["cells"])
def fea1(spark, sf_dir):
    return tidy(feature_table(spark, sf_dir).select("sample_id", "seed", "y", "x", *NUMERIC, *INTEGER), 4)


@query("fea2_training_targets", FEATURES_SQL + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, count(path_loss) AS "rows", round(avg(path_loss), 4) AS target_direct,
  round(avg(path_loss - multi_wall_pred_db), 4) AS target_residual, round(avg(path_loss - multi_wall_residual_idw_pred_db), 4) AS target_calibrated
FROM feats WHERE path_loss IS NOT NULL GROUP BY 1, 2""", ["cells"])
def fea2(spark, sf_dir):
    rows = features.learner_targets(feature_table(spark, sf_dir, 0).where("y_true IS NOT NULL"))
    return tidy(rows.groupBy("sample_id", "seed").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in ("target_direct", "target_residual", "target_calibrated")]), 4)


@query("fea3_map_frame", FEATURES_SQL + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(path_loss, 4) AS path_loss_db,
  round(multi_wall_pred_db, 4) AS multiwall_pred_db, round(path_loss - multi_wall_pred_db, 4) AS residual_db FROM feats""", ["cells"])
def fea3(spark, sf_dir):
    return tidy(features.map_frame(feature_table(spark, sf_dir, 0)).select(
        "sample_id", "seed", "y", "x", "path_loss_db", "multiwall_pred_db", "residual_db"), 4)


# --- the flagship: sparse anchors, log-distance fit, error per map -----------------

FLAGSHIP_SQL = sq.chain(sq.BASE_MAPS, sq.anchors("0.05", (11,)), sq.LOG_FITS) + """,
scored AS (SELECT m.sample_id, m.los, m.wall_count, m.path_loss, coalesce(f.intercept + f.slope * m.log_d, 0) AS pred
  FROM maps m LEFT JOIN log_fits f USING (sample_id) WHERE m.path_loss IS NOT NULL)
SELECT sample_id, """ + sq.core_metrics("pred", "path_loss") + " FROM scored GROUP BY 1"


@query("met1_core_errors", FLAGSHIP_SQL, ["cells"])
def met1(spark, sf_dir):
    base = ev.with_log_distance(maps(spark, sf_dir))
    rows = bound(spark, sf_dir)
    taken = sampling.usable_anchors(ev.anchor_rows(maps(spark, sf_dir), [0.05], [11], 4, rows))
    fitted = fits.log_distance_fits(taken, ["sample_id"])
    scored = base.join(fitted, "sample_id", "left").withColumn(
        "pred", F.coalesce(F.col("intercept") + F.col("slope") * F.col("log_d"), F.lit(0.0)))
    return tidy(metrics.error_metrics(scored, ["sample_id"], "pred", "path_loss", rows_bound=rows))
