"""Error metrics on dense maps and points, and their aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.functions import pathloss as pl
from signalgrid.operators import metrics as M
from signalgrid.operators import sampling
from signalgrid.plans import evaluation as ev
from signalgrid.plans import views
from signalgrid.queries import dense as D
from signalgrid.queries import sql_parts as sq
from signalgrid.queries.registry import query, scan_rows, tidy

# Long prediction table: three physics methods on every cell, with the anchor flag.
SCORED = sq.chain(sq.BASE_MAPS, sq.anchors(D.R, D.SEEDS), sq.FITS, sq.predictions(D.SEEDS, D.R)) + """,
flagged AS (SELECT p.*, a.sample_id IS NOT NULL AS is_anchor FROM preds p
  LEFT JOIN (SELECT sample_id, seed, y, x FROM anchors) a USING (sample_id, seed, y, x)),
long AS (SELECT 'fspl' AS method, fspl_pred_db AS pred, * FROM flagged UNION ALL SELECT 'log_distance', log_distance_pred_db, * FROM flagged
  UNION ALL SELECT 'multi_wall', multi_wall_pred_db, * FROM flagged),
scored AS (SELECT *, pred - path_loss AS e FROM long WHERE path_loss IS NOT NULL)
"""


def scored(spark, sf_dir) -> DataFrame:
    preds, taken = D.predictions(spark, sf_dir)
    marks = taken.select(*ev.SWEEP, "y", "x", F.lit(True).alias("is_anchor"))
    flagged = preds.join(marks, [*ev.SWEEP, "y", "x"], "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    methods = F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(c).alias("pred"))
        for m, c in (("fspl", "fspl_pred_db"), ("log_distance", "log_distance_pred_db"), ("multi_wall", "multi_wall_pred_db"))]))
    return flagged.withColumn("_m", methods).withColumn("method", F.col("_m.method")).withColumn("pred", F.col("_m.pred")).drop("_m")


KEYS = ["method", "seed", "sample_id"]
LEAD = "SELECT method, CAST(seed AS BIGINT) AS seed, sample_id, "
TAIL = " FROM scored GROUP BY 1, 2, 3"


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) AS {name}"


def rmse_sql(where: str) -> str:
    return f"sqrt(avg(e * e) FILTER ({where}))"


@query("met2_los_nlos", SCORED + LEAD
       + r(f"CASE WHEN count(*) FILTER (los = 1) >= 5 THEN {rmse_sql('los = 1')} END", "los_rmse") + ", "
       + r(f"CASE WHEN count(*) FILTER (los = 0) >= 5 THEN {rmse_sql('los = 0')} END", "nlos_rmse") + TAIL, ["cells"])
def met2(spark, sf_dir):
    rows = M.marked_error(scored(spark, sf_dir), "pred", "path_loss")
    return tidy(rows.groupBy(*KEYS).agg(*M.region_columns(los="los")), 4)


@query("met3_high_wall", SCORED + LEAD + r(rmse_sql("wall_count >= 2"), "high_wall_rmse") + TAIL, ["cells"])
def met3(spark, sf_dir):
    rows = M.marked_error(scored(spark, sf_dir), "pred", "path_loss")
    return tidy(rows.groupBy(*KEYS).agg(*M.region_columns(wall_count="wall_count")), 4)


@query("met4_clipping", SCORED + LEAD + r(rmse_sql("path_loss < 5e1 - 1e-5"), "unclipped_rmse")
       + ", count(*) FILTER (path_loss < 5e1 - 1e-5) AS unclipped_count, "
       + r("count(*) FILTER (path_loss >= 5e1 - 1e-5 OR path_loss <= 4e1 + 1e-5) / CAST(count(*) AS DOUBLE)", "clipped_pixel_fraction") + TAIL, ["cells"])
def met4(spark, sf_dir):
    rows = M.marked_error(scored(spark, sf_dir), "pred", "path_loss")
    return tidy(rows.groupBy(*KEYS).agg(*M.region_columns(target="path_loss", clip_min_db=40.0, clip_max_db=50.0)), 4)


def _region_sql(where: str, name: str) -> str:
    return r(f"CASE WHEN count(*) FILTER ({where}) >= 5 THEN {rmse_sql(where)} END", name)


@query("met5_non_anchor", SCORED + LEAD + r(rmse_sql("NOT is_anchor"), "non_anchor_rmse") + ", "
       + r("avg(abs(e)) FILTER (NOT is_anchor)", "non_anchor_mae") + ", " + r("quantile_cont(abs(e), 0.9) FILTER (NOT is_anchor)", "non_anchor_p90_ae")
       + ", count(*) FILTER (NOT is_anchor) AS non_anchor_count, " + _region_sql("NOT is_anchor AND los = 1", "non_anchor_los_rmse") + ", "
       + _region_sql("NOT is_anchor AND los = 0", "non_anchor_nlos_rmse") + TAIL, ["cells"])
def met5(spark, sf_dir):
    out = M.error_metrics(scored(spark, sf_dir), KEYS, "pred", "path_loss", rows_bound=D.bound(spark, sf_dir), los="los", is_anchor="is_anchor")
    return tidy(out.select(*KEYS, *[c for c in out.columns if c.startswith("non_anchor")]), 4)


@query("met6_free_space", """
WITH s AS (SELECT sample_id, wall, 45e0 + 18e0 * log10(greatest(sqrt((x - tx_x) * (x - tx_x) + (y - tx_y) * (y - tx_y)) * resolution_m, 25e-2)) - path_loss AS e
  FROM cells WHERE path_loss IS NOT NULL)
SELECT sample_id, """ + r(rmse_sql("NOT wall"), "free_space_rmse", 6) + ", " + r("avg(abs(e)) FILTER (NOT wall)", "free_space_mae", 6) + ", "
       + r("quantile_cont(abs(e), 0.9) FILTER (NOT wall)", "free_space_p90_ae", 6) + ", count(*) FILTER (NOT wall) AS free_space_count, "
       + r(rmse_sql("wall"), "wall_region_rmse", 6) + " FROM s GROUP BY 1", ["cells"])
def met6(spark, sf_dir):
    rows = views.cells(spark, sf_dir).withColumn("pred", 45.0 + 18.0 * F.log10(pl.distance_m()))
    out = M.error_metrics(rows, ["sample_id"], "pred", "path_loss", rows_bound=D.bound(spark, sf_dir), wall="wall")
    return tidy(out.select("sample_id", *[c for c in out.columns if c.startswith("free_space")], "wall_region_rmse"))


FULL_ROW = SCORED + """,
rows AS (SELECT method, seed, sample_id, count(*) AS valid_count, count(*) FILTER (NOT is_anchor) AS non_anchor_count,
  round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(quantile_cont(abs(e), 0.9), 4) AS p90_ae, round(avg(e), 4) AS bias_db,
  sqrt(avg(e * e)) AS raw FROM scored GROUP BY 1, 2, 3)
"""


@query("met7_metric_rows", FULL_ROW + """
SELECT r.method, CAST(r.seed AS BIGINT) AS seed, r.sample_id, valid_count, non_anchor_count, r.rmse, r.mae, r.p90_ae, r.bias_db,
  f.anchor_count, f.status AS mw_status FROM rows r JOIN wall_fits f ON f.sample_id = r.sample_id AND f.seed = r.seed""", ["cells"])
def met7(spark, sf_dir):
    taken = D.anchors(spark, sf_dir)
    fitted = ev.physics_fits(taken).select("sample_id", "seed", "anchor_count", "mw_status")
    out = M.error_metrics(scored(spark, sf_dir), KEYS, "pred", "path_loss", rows_bound=D.bound(spark, sf_dir), los="los",
                          wall_count="wall_count", is_anchor="is_anchor", wall="wall")
    # Maps without usable anchors have no fit: they keep their row, with no anchors and no status.
    return tidy(out.join(fitted, ["sample_id", "seed"], "left").select(
        *KEYS, F.col("count").alias("valid_count"), "non_anchor_count", "rmse", "mae", "p90_ae", "bias_db",
        F.coalesce("anchor_count", F.lit(0).cast(fitted.schema["anchor_count"].dataType)).alias("anchor_count"), "mw_status"), 4)


@query("met8_paired_deltas", FULL_ROW + """
SELECT method, CAST(seed AS BIGINT) AS seed, sample_id, round(raw - max(raw) FILTER (method = 'multi_wall') OVER w, 4) AS rmse_minus_multi_wall,
  round(raw - coalesce(max(raw) FILTER (method = 'direct_rf') OVER w, max(raw) FILTER (method = 'log_distance') OVER w), 4) AS rmse_minus_direct_rf
FROM rows WINDOW w AS (PARTITION BY sample_id, seed)""", ["cells"])
def met8(spark, sf_dir):
    rows = M.marked_error(scored(spark, sf_dir), "pred", "path_loss").groupBy(*KEYS).agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))
    return tidy(M.paired_deltas(rows, ["sample_id", "seed"], "multi_wall", ("direct_rf", "log_distance")).drop("rmse"), 4)


RUN_METRICS = ("rmse", "mae", "p90_ae", "bias_db")


def _mean_std_sql(keys: str, columns=RUN_METRICS, single: str = "0e0", source: str = "run_metrics", names=("{c}", "{c}_std")) -> str:
    parts = []
    for c in columns:
        parts.append(f"round(avg({c}), 6) AS {names[0].format(c=c)}")
        parts.append(f"round(CASE WHEN count(*) = 1 THEN {single} ELSE stddev_samp({c}) END, 6) AS {names[1].format(c=c)}")
    return f"SELECT {keys}, {', '.join(parts)}, count(*) AS num_rows FROM {source} GROUP BY {keys}"


@query("met9_aggregate_rows", _mean_std_sql("method, scene_id"), ["run_metrics"])
def met9(spark, sf_dir):
    return tidy(M.mean_std(views.run_metrics(spark, sf_dir), ["method", "scene_id"], RUN_METRICS))


# Point predictions: three closed-form methods scored on whole leave-one-out folds.
POINT_PREDS = """WITH preds AS (
  SELECT 'log_distance' AS method, 42e0 + 19e0 * log10(distance_m) AS pred_pl_db, * FROM points
  UNION ALL SELECT 'multi_wall_linear', 41e0 + 19e0 * log10(distance_m) + 5e-1 * (num_brick_wall + num_wood_wall + num_glass_wall), * FROM points
  UNION ALL SELECT 'direct_rf', 43e0 + distance_m / 2, * FROM points),
point_preds AS (SELECT row_uid, scenario, config, method, pl_db AS target_pl_db, pred_pl_db, 'leave_scenario_out' AS split, concat('holdout_', scenario) AS fold,
  distance_m, num_brick_wall + num_wood_wall + num_glass_wall + num_drywall + num_column + elevator AS walls, pred_pl_db - pl_db AS e,
  CAST(CASE WHEN distance_m > 25 THEN 22 ELSE 11 END AS INT) AS random_seed FROM preds)
"""


def point_predictions(spark, sf_dir) -> DataFrame:
    d = F.log10("distance_m")
    walls = F.col("num_brick_wall") + F.col("num_wood_wall") + F.col("num_glass_wall")
    methods = F.explode(F.array(
        F.struct(F.lit("log_distance").alias("method"), (42.0 + 19.0 * d).alias("pred_pl_db")),
        F.struct(F.lit("multi_wall_linear").alias("method"), (41.0 + 19.0 * d + 0.5 * walls).alias("pred_pl_db")),
        F.struct(F.lit("direct_rf").alias("method"), (43.0 + F.col("distance_m") / 2).alias("pred_pl_db"))))
    return views.points(spark, sf_dir).withColumn("_m", methods).select(
        "row_uid", "scenario", "config", "_m.method", F.col("pl_db").alias("target_pl_db"), "_m.pred_pl_db",
        F.lit("leave_scenario_out").alias("split"), F.concat(F.lit("holdout_"), "scenario").alias("fold"), "distance_m",
        (walls + F.col("num_drywall") + F.col("num_column") + F.col("elevator")).alias("walls"),
        F.when(F.col("distance_m") > 25, 22).otherwise(11).alias("random_seed"))


@query("met10_point_metrics", POINT_PREDS + "SELECT method, fold, " + sq.core_metrics("pred_pl_db", "target_pl_db", "stddev_pop")
       + " FROM point_preds GROUP BY 1, 2", ["points"])
def met10(spark, sf_dir):
    return tidy(M.error_metrics(point_predictions(spark, sf_dir), ["method", "fold"], "pred_pl_db", "target_pl_db", std="pop",
                                rows_bound=scan_rows(spark, sf_dir, "lineitem")))


@query("met11_point_metrics_short", POINT_PREDS + """SELECT method, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
  round(quantile_cont(abs(e), 0.5), 6) AS median_ae, round(quantile_cont(abs(e), 0.9), 6) AS p90_ae, count(*) AS n FROM point_preds GROUP BY 1""", ["points"])
def met11(spark, sf_dir):
    out = M.error_metrics(point_predictions(spark, sf_dir), ["method"], "pred_pl_db", "target_pl_db", rows_bound=scan_rows(spark, sf_dir, "lineitem"))
    return tidy(out.select("method", "rmse", "mae", "median_ae", "p90_ae", F.col("count").alias("n")))


@query("met12_pooled_metrics", POINT_PREDS + "SELECT split, method, CAST(random_seed AS BIGINT) AS random_seed, "
       + sq.core_metrics("pred_pl_db", "target_pl_db", "stddev_pop")
       + ", count(DISTINCT row_uid) AS unique_test_points FROM point_preds GROUP BY split, method, random_seed", ["points"])
def met12(spark, sf_dir):
    return tidy(M.pooled_point_metrics(point_predictions(spark, sf_dir), ["split", "method", "random_seed"],
                                       rows_bound=scan_rows(spark, sf_dir, "lineitem")))


@query("met13_partitioned_metrics", POINT_PREDS + """, long AS (
  SELECT 'overall' AS "partition", 'all' AS "group", * FROM point_preds UNION ALL SELECT 'scenario', scenario, * FROM point_preds
  UNION ALL SELECT 'los', CASE WHEN walls > 0 THEN 'NLOS' ELSE 'LOS' END, * FROM point_preds
  UNION ALL SELECT 'walls', CASE WHEN walls <= 0 THEN '0_walls' WHEN walls <= 2 THEN '1-2_walls' ELSE '3+_walls' END, * FROM point_preds)
SELECT method, "partition", "group", round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(quantile_cont(abs(e), 0.5), 6) AS median_ae,
  round(quantile_cont(abs(e), 0.9), 6) AS p90_ae, count(*) AS n FROM long GROUP BY 1, 2, 3""", ["points"])
def met13(spark, sf_dir):
    from signalgrid.operators.cleaning import wall_region
    return tidy(M.partitioned_metrics(
        point_predictions(spark, sf_dir), "pred_pl_db", "target_pl_db", "method",
        {"scenario": F.col("scenario"), "los": F.when(F.col("walls") > 0, "NLOS").otherwise("LOS"), "walls": wall_region("walls")},
        rows_bound=scan_rows(spark, sf_dir, "lineitem")))


FOLD_ROWS = POINT_PREDS + """, fold_rows AS (SELECT split, method, random_seed, fold, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
  quantile_cont(abs(e), 0.9) AS p90_ae FROM point_preds GROUP BY 1, 2, 3, 4)
"""


def fold_rows(spark, sf_dir, preds: DataFrame | None = None) -> DataFrame:
    return M.error_metrics(point_predictions(spark, sf_dir) if preds is None else preds, ["split", "method", "random_seed", "fold"], "pred_pl_db", "target_pl_db", std="pop",
                           rows_bound=scan_rows(spark, sf_dir, "lineitem")).select("split", "method", "random_seed", "fold", "rmse", "mae", "p90_ae")


def fold_means(spark, sf_dir) -> DataFrame:
    """`fold_rows` without its percentile, for those that do not read it: one aggregation whatever the size of a fold."""
    rows = M.marked_error(point_predictions(spark, sf_dir), "pred_pl_db", "target_pl_db")
    return rows.groupBy("split", "method", "random_seed", "fold").agg(*M.core_columns("pop")).select("split", "method", "random_seed", "fold", "rmse", "mae")


@query("met14_macro_mean", FOLD_ROWS + """SELECT split, method, CAST(random_seed AS BIGINT) AS random_seed, count(*) AS folds, round(avg(rmse), 6) AS rmse,
  round(avg(mae), 6) AS mae, round(avg(p90_ae), 6) AS p90_ae FROM fold_rows GROUP BY 1, 2, 3""", ["points"])
def met14(spark, sf_dir):
    return tidy(fold_rows(spark, sf_dir).groupBy("split", "method", "random_seed").agg(
        F.count(F.lit(1)).alias("folds"), *[F.avg(c).alias(c) for c in ("rmse", "mae", "p90_ae")]))


@query("met15_fold_aggregate", FOLD_ROWS + "SELECT method, " + ", ".join(
    f"round(avg({c}), 6) AS {c}, round(stddev_pop({c}), 6) AS {c}_std" for c in ("rmse", "mae", "p90_ae")) + ", count(*) AS num_rows FROM fold_rows GROUP BY 1", ["points"])
def met15(spark, sf_dir):
    return tidy(M.mean_std(fold_rows(spark, sf_dir), ["method"], ["rmse", "mae", "p90_ae"], ddof=0))


@query("met16_best_method", FOLD_ROWS + """SELECT fold, CAST(random_seed AS BIGINT) AS random_seed, method AS best_method, round(rmse, 6) AS best_rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, random_seed ORDER BY rmse, method) AS rn FROM fold_rows) WHERE rn = 1""", ["points"])
def met16(spark, sf_dir):
    return tidy(M.best_by(fold_means(spark, sf_dir), ["fold", "random_seed"]))


@query("met17_across_seeds", "SELECT sparse_rate, method, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, count({c}) AS {c}_n" for c in RUN_METRICS)
    + ", count(*) AS n_runs, array_to_string(list_sort(list_distinct(list(CAST(sparse_seed AS VARCHAR)))), ';') AS seeds FROM ("
    + "SELECT sparse_rate, method, sparse_seed, " + ", ".join(f"avg({c}) AS {c}" for c in RUN_METRICS) + " FROM run_metrics GROUP BY 1, 2, 3) GROUP BY 1, 2", ["run_metrics"])
def met17(spark, sf_dir):
    runs = views.run_metrics(spark, sf_dir).groupBy("sparse_rate", "method", "sparse_seed").agg(*[F.avg(c).alias(c) for c in RUN_METRICS])
    return tidy(M.across_seeds(runs, RUN_METRICS))


@query("met18_seed_extremes", "SELECT task, method, " + ", ".join(
    f"round(avg({c}), 9) AS {c}, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp({c}) END, 9) AS {c}_std, round(min({c}), 9) AS {c}_min, round(max({c}), 9) AS {c}_max"
    for c in ("rmse", "mae")) + ", count(*) AS num_rows FROM (SELECT task, method, sparse_seed, avg(rmse) AS rmse, avg(mae) AS mae FROM run_metrics GROUP BY 1, 2, 3) GROUP BY 1, 2", ["run_metrics"])
def met18(spark, sf_dir):
    per_seed = views.run_metrics(spark, sf_dir).groupBy("task", "method", "sparse_seed").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    return tidy(M.mean_std(per_seed, ["task", "method"], ["rmse", "mae"], extremes=True), 9)


SUBGROUP = """WITH parsed AS (SELECT *, CAST(regexp_extract(sample_id, '(?:^|_)Ant(\\d+)(?:_|$)', 1) AS INT) AS antenna,
  CAST(regexp_extract(sample_id, '(?:^|_)f(\\d+)(?:_|$)', 1) AS INT) AS frequency, CAST(regexp_extract(sample_id, '(?:^|_)B(\\d+)(?:_|$)', 1) AS INT) AS building FROM run_metrics),
cond AS (SELECT *, CASE WHEN antenna = 1 AND frequency = 1 THEN 'Ant1-f1 source-like' WHEN antenna = 1 AND frequency IN (2, 3) THEN 'Ant1-f2-f3 frequency shift'
  WHEN antenna IN (2, 3, 4, 5) THEN 'Ant2-Ant5 additional antennas across frequencies' ELSE 'unexpected' END AS transfer_condition FROM parsed)
"""


@query("met19_subgroup_summary", SUBGROUP + """SELECT task, transfer_condition, method, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std,
  round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std, count(*) AS n FROM (
  SELECT task, transfer_condition, method, sparse_seed, avg(rmse) AS rmse, avg(mae) AS mae FROM cond GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", ["run_metrics"])
def met19(spark, sf_dir):
    from signalgrid.operators.paired import with_condition
    rows = with_condition(views.run_metrics(spark, sf_dir))
    coarse = ["task", "transfer_condition", "method"]
    return tidy(M.two_level_mean_std(rows, [*coarse, "sparse_seed"], coarse, ["rmse", "mae"]))


@query("met20_dataset_profile", """
SELECT source_file, count(*) AS "rows", round(min(distance_m), 6) AS distance_min, round(max(distance_m), 6) AS distance_max, round(min(pl_db), 6) AS path_loss_min,
  round(max(pl_db), 6) AS path_loss_max, count(DISTINCT scenario) AS scenarios, count(*) FILTER (num_brick_wall + num_wood_wall + num_glass_wall + num_drywall + num_column <= 0) AS los_rows,
  count(*) FILTER (num_brick_wall + num_wood_wall + num_glass_wall + num_drywall + num_column > 0) AS nlos_rows, count(*) FILTER (rx_x IS NULL) AS rx_x_nulls,
  count(*) FILTER (pl_db IS NULL) AS pl_db_nulls FROM points GROUP BY 1""", ["points"])
def met20(spark, sf_dir):
    from signalgrid.sources.survey import profile
    rows = views.points(spark, sf_dir).withColumn("walls", sum((F.col(c) for c in views.WALL_COLUMNS[:5]), F.lit(0.0)))
    return tidy(profile(rows, "source_file", {"distance": "distance_m", "path_loss": "pl_db"}, F.col("walls") > 0, ["rx_x", "pl_db"]))


@query("met21_preflight", """
SELECT source_file, count(*) AS "rows", count(*) FILTER (pl_db IS NOT NULL AND distance_m > 0) AS valid_rows, count(*) FILTER (NOT (pl_db IS NOT NULL AND distance_m > 0)) AS invalid_rows,
  count(*) - count(DISTINCT coord) AS duplicate_coords, round(min(pl_db), 6) AS pl_min, round(max(pl_db), 6) AS pl_max,
  count(*) FILTER (abs((1e1 - p_rx_dbm) - pl_db) > 1e-6) AS derived_mismatch FROM points GROUP BY 1""", ["points"])
def met21(spark, sf_dir):
    from signalgrid.sources.campaign import preflight
    return tidy(preflight(views.points(spark, sf_dir)))


@query("met22_curve_data", """SELECT method, sparse_rate, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS std, count(rmse) AS n FROM run_metrics GROUP BY 1, 2""", ["run_metrics"])
def met22(spark, sf_dir):
    return tidy(M.curve_data(views.run_metrics(spark, sf_dir)))


@query("met23_comparison_at_rate", """SELECT method, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS std, count(mae) AS n FROM run_metrics WHERE abs(sparse_rate - 1e-2) <= 1e-8 + 1e-7 GROUP BY 1""", ["run_metrics"])
def met23(spark, sf_dir):
    return tidy(M.comparison_at_rate(views.run_metrics(spark, sf_dir), "mae"))


@query("met24_region_means", """SELECT method, round(avg(rmse), 6) AS rmse, round(avg(p90_ae), 6) AS p90_ae, round(avg(bias_db), 6) AS bias_db FROM run_metrics GROUP BY 1""", ["run_metrics"])
def met24(spark, sf_dir):
    return tidy(M.region_means(views.run_metrics(spark, sf_dir), ["rmse", "p90_ae", "bias_db"]))


@query("met25_top_features", """WITH imp AS (SELECT method, sparse_seed, scene_id AS feature, avg(rmse) AS importance FROM run_metrics GROUP BY 1, 2, 3)
SELECT method, feature, round(avg(importance), 6) AS importance_mean, round(stddev_samp(importance), 6) AS importance_std FROM imp WHERE method = 'direct_rf'
GROUP BY 1, 2 ORDER BY avg(importance) DESC, feature LIMIT 3""", ["run_metrics"])
def met25(spark, sf_dir):
    importances = views.run_metrics(spark, sf_dir).groupBy("method", "sparse_seed", F.col("scene_id").alias("feature")).agg(F.avg("rmse").alias("importance"))
    return tidy(M.top_features(importances, ["residual_rf", "direct_rf", "residual_extra"], 3))


@query("met26_primary_row", """SELECT method AS primary_method, CAST(sparse_seed AS BIGINT) AS primary_sparse_seed, sample_id AS primary_sample_id, round(rmse, 6) AS primary_rmse
FROM run_metrics WHERE method = 'residual_extra' ORDER BY rmse NULLS LAST, method, sparse_seed, sample_id LIMIT 1""", ["run_metrics"])
def met26(spark, sf_dir):
    rows = views.run_metrics(spark, sf_dir).where("rmse IS NOT NULL")
    return tidy(M.primary_row(rows, "residual_extra", ["method", "sparse_seed", "sample_id", "rmse"]))


@query("met27_dataset_counts", """SELECT segment AS side, count(sample_id) AS samples, count(DISTINCT scene_id) AS "groups" FROM manifest GROUP BY 1""", ["manifest"])
def met27(spark, sf_dir):
    return tidy(M.dataset_counts(views.manifest(spark, sf_dir).withColumnRenamed("segment", "side"), "side"))
