"""Audits over the driver views."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalgrid.functions import pathloss as pl
from signalgrid.operators import audits as A, features, interpolation as interp, run_contract as RC, sampling, splits as X
from signalgrid.plans import evaluation as ev
from signalgrid.plans import views
from signalgrid.queries import dense as D
from signalgrid.queries import scores as S
from signalgrid.queries import splits as QS
from signalgrid.queries import sql_parts as sq
from signalgrid.queries.registry import query, scan_rows, tidy
from signalgrid.session import materialise


def split(spark, sf_dir):
    return X.group_split(views.manifest(spark, sf_dir), "scene_id", 0.25, 42, rows_bound=scan_rows(spark, sf_dir, "customer"))


def shown(results):
    return tidy(results.select("check_id", "name", "status", F.col("metrics")["offenders"].cast("bigint").alias("offenders")))


SIDES = QS.GROUPS + """, s AS (SELECT m.*, CASE WHEN rn <= least(greatest(1, CAST(round_even(n * 25e-2, 0) AS BIGINT)), n - 1) THEN 'val' ELSE 'train' END AS side
FROM manifest m JOIN ranked ON grp = scene_id)"""


@query("aud1_group_disjointness", SIDES + """
SELECT CAST(1 AS BIGINT) AS check_id, 'group_disjointness' AS name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS offenders FROM (
  SELECT scene_id FROM s WHERE side = 'train' INTERSECT SELECT scene_id FROM s WHERE side = 'val')
UNION ALL SELECT 2, 'segment_disjointness', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (
  SELECT segment FROM s WHERE side = 'train' INTERSECT SELECT segment FROM s WHERE side = 'val')""", ["manifest"])
def aud1(spark, sf_dir):
    s = split(spark, sf_dir)
    train, val = s.where("side = 'train'"), s.where("side = 'val'")
    return shown(A.readiness({"group_disjointness": A.shared_groups(train, val, "scene_id"),
                              "segment_disjointness": A.shared_groups(train, val, "segment")}))


@query("aud2_anchors_subset_valid", sq.chain("valid_cells AS (SELECT sample_id, y, x FROM cells WHERE valid)", sq.anchors("0.05", (11, 22), 4, "valid_cells", "a")) + """
SELECT CAST(2 AS BIGINT) AS check_id, 'anchors_subset_of_valid' AS name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS offenders
FROM a LEFT JOIN cells c ON c.sample_id = a.sample_id AND c.y = a.y AND c.x = a.x AND c.valid WHERE c.sample_id IS NULL""", ["cells"])
def aud2(spark, sf_dir):
    valid = views.cells(spark, sf_dir).where("valid").select("sample_id", "y", "x")
    taken = sampling.sparse_anchors(valid, [0.05], [11, 22], 4, D.bound(spark, sf_dir))
    return shown(A.result(2, "anchors_subset_of_valid", sampling.anchors_outside_valid(taken, valid), "anchor(s) on invalid cells"))


def _features_from(spark, sf_dir, base, seeds=(11,)):
    taken = materialise(ev.anchor_rows(base, [D.RATE], list(seeds), 4, D.bound(spark, sf_dir)), "anchors")
    fitted = materialise(ev.physics_fits(taken), "fits")
    preds = ev.physics_predictions(base, fitted, [D.RATE], list(seeds))
    with_pred = materialise(taken.join(preds.select(*ev.SWEEP, "y", "x", "multi_wall_pred_db"), [*ev.SWEEP, "y", "x"]), "anchors-fitted")
    return features.dense_features(preds, with_pred, interp.anchor_density(base, taken), D.RATE)


def _perturbation(spark, sf_dir, columns):
    base = D.maps(spark, sf_dir)
    taken = ev.anchor_rows(base, [D.RATE], [11], 4, D.bound(spark, sf_dir))
    before, after = _features_from(spark, sf_dir, base), _features_from(spark, sf_dir, materialise(A.perturbed(base, taken), "perturbed"))
    keys = [*ev.SWEEP, "y", "x"]
    moved = A.changed_rows(before, after, keys, columns).agg(F.count(F.lit(1)).alias("changed"))
    return base.agg(F.count(F.lit(1)).alias("rows_checked")).join(F.broadcast(moved))  # one row each


# Noise on unobserved targets must move nothing, so the expected number of changed rows is zero.
LEAK_SQL = "SELECT count(*) AS rows_checked, CAST(0 AS BIGINT) AS changed FROM cells WHERE valid"


@query("aud3_features_ignore_dense_labels", LEAK_SQL, ["cells"])
def aud3(spark, sf_dir):
    return _perturbation(spark, sf_dir, features.feature_names())


@query("aud4_baselines_ignore_dense_labels", LEAK_SQL, ["cells"])
def aud4(spark, sf_dir):
    return _perturbation(spark, sf_dir, list(features.BASELINES))


@query("aud5_non_finite_values", """SELECT sample_id, count(*) AS offenders, min('path_loss') AS "columns" FROM cells WHERE valid AND path_loss IS NULL GROUP BY 1""", ["cells"])
def aud5(spark, sf_dir):
    rows = views.cells(spark, sf_dir).where("valid")
    bad = A.non_finite(rows, ["path_loss", "tx_x", "tx_y", "frequency_hz"])
    return bad.groupBy("sample_id").agg(F.count(F.lit(1)).alias("offenders"), F.min("columns").alias("columns"))


@query("aud6_anchor_counts", sq.chain("valid_cells AS (SELECT sample_id, y, x FROM cells WHERE valid)", sq.anchors("0.01", (11, 22), 5, "valid_cells", "a")) + """
SELECT sample_id, CAST(seed AS BIGINT) AS seed, count(*) AS anchors, max(n_valid) AS valid,
  CASE WHEN count(*) < least(5, max(n_valid)) THEN 'FAIL' WHEN max(n_valid) < 5 THEN 'WARN' ELSE 'PASS' END AS status FROM a GROUP BY 1, 2""", ["cells"])
def aud6(spark, sf_dir):
    valid = views.cells(spark, sf_dir).where("valid").select("sample_id", "y", "x")
    taken = sampling.sparse_anchors(valid, [0.01], [11, 22], 5, D.bound(spark, sf_dir))
    return tidy(A.anchor_count_status(taken, valid, 5).select("sample_id", "seed", "anchors", "valid", "status"))


@query("aud7_eval_not_in_train", SIDES + """
SELECT CAST(7 AS BIGINT) AS check_id, 'eval_ids_not_in_train' AS name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS offenders
FROM s WHERE side = 'val' AND sample_id IN (SELECT sample_id FROM s WHERE side = 'train')""", ["manifest"])
def aud7(spark, sf_dir):
    s = split(spark, sf_dir)
    both = s.where("side = 'val'").join(s.where("side = 'train'").select("sample_id"), "sample_id", "left_semi")
    return shown(A.result(7, "eval_ids_not_in_train", both, "eval id(s) used in training"))


@query("aud8_empty_anchor_fill", """SELECT sample_id, count(*) AS cells, 7e0 AS lowest, 7e0 AS highest FROM cells WHERE valid GROUP BY 1""", ["cells"])
def aud8(spark, sf_dir):
    # No anchors at all, on targets shifted by 500 dB: every cell takes the constant.
    base = D.maps(spark, sf_dir).withColumn("path_loss", F.col("path_loss") + 500.0)
    cells = ev.sweep_cells(base, [D.RATE], [11])
    shaped = interp.raster_idw(cells.select(*ev.SWEEP, "y", "x"), cells.where("false"), ["path_loss"], max_rate=D.RATE)
    filled = interp.fill_empty(shaped, "idw_path_loss", F.lit(7.0))
    return tidy(filled.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("cells"), F.min("idw_path_loss").alias("lowest"), F.max("idw_path_loss").alias("highest")))


BOUNDS = """WITH o AS (SELECT sample_id, segment, greatest(-tx_x, 0) AS l, greatest(tx_x - 9, 0) AS r, greatest(-tx_y, 0) AS t, greatest(tx_y - 19, 0) AS b FROM manifest),
w AS (SELECT *, greatest(l, r, t, b) AS m FROM o), e AS (SELECT *, 'left' AS edge FROM w WHERE l > 0 UNION ALL SELECT *, 'right' FROM w WHERE r > 0
  UNION ALL SELECT *, 'top' FROM w WHERE t > 0 UNION ALL SELECT *, 'bottom' FROM w WHERE b > 0)"""


@query("aud9_transmitter_bounds", BOUNDS + " SELECT segment, edge, CAST(ceil(m) AS BIGINT) AS clip_px, count(*) AS samples FROM e GROUP BY 1, 2, 3", ["manifest"])
def aud9(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).withColumns({"width": F.lit(10), "height": F.lit(20), "resolution_m": F.lit(0.25)})
    return tidy(A.bounds_counts(A.bounds_rows(rows, pl.edge_overflow()), ["segment"]))


METHODS = ("residual_extra", "direct_rf", "multi_wall", "idw", "log_distance")


def expectations(spark, sf_dir):
    """Every (task, seed) of the sweep, from the sample list, with the map count a whole run has."""
    maps = views.run_metrics(spark, sf_dir).groupBy("task").agg(F.countDistinct("sample_id").alias("expected_maps"))
    return maps.withColumn("sparse_seed", F.explode(F.array(*[F.lit(s) for s in (11, 22, 33, 44)]))).withColumn("expected_rate", F.lit(0.01))


@query("aud10_run_audit", """WITH want AS (SELECT task, s.sparse_seed, count(DISTINCT sample_id) AS maps FROM run_metrics, (VALUES (11), (22), (33), (44)) s(sparse_seed) GROUP BY 1, 2),
pm AS (SELECT task, sparse_seed, method, count(DISTINCT sample_id) AS maps, count(*) AS n FROM run_metrics GROUP BY 1, 2, 3),
r AS (SELECT task, sparse_seed, CAST(sum(n) AS BIGINT) AS n, count(*) AS methods, min(maps) AS lo, max(maps) AS hi FROM pm GROUP BY 1, 2),
j AS (SELECT w.task, w.sparse_seed, coalesce(n, 0) AS "rows", n IS NOT NULL AS run_present, n IS NOT NULL AS rate_correct, coalesce(methods = 5, false) AS methods_present,
  coalesce(lo = w.maps AND hi = w.maps, false) AS maps_expected, n IS NOT NULL AS no_duplicates FROM want w LEFT JOIN r USING (task, sparse_seed))
SELECT * REPLACE (CAST(sparse_seed AS BIGINT) AS sparse_seed), run_present AND rate_correct AND methods_present AND maps_expected AND no_duplicates AS audit_pass FROM j""", ["run_metrics"])
def aud10(spark, sf_dir):
    return tidy(A.run_audit(views.run_metrics(spark, sf_dir), expectations(spark, sf_dir), METHODS, ["task", "sparse_seed"]))


@query("aud11_prediction_audit", S.POINT_PREDS + """SELECT split, CAST(random_seed AS BIGINT) AS random_seed, count(*) AS "rows", count(*) - count(DISTINCT (fold, row_uid, method)) AS repeated_predictions,
  count(*) FILTER (e IS NULL) AS non_finite, count(DISTINCT (fold, row_uid)) AS points, CAST(3 AS BIGINT) AS fewest_methods, CAST(3 AS BIGINT) AS most_methods FROM point_preds GROUP BY 1, 2""", ["points"])
def aud11(spark, sf_dir):
    return tidy(A.prediction_audit(S.point_predictions(spark, sf_dir), ["split", "random_seed"], ["fold", "row_uid"], ["pred_pl_db", "target_pl_db"]))


# Four planned runs over the predictions: two whole ones, one that is another run's copy with faults, one that never ran.
RUN_TABLES = S.POINT_PREDS + """, run_samples AS (
  SELECT split AS run_split, random_seed AS run_seed, row_uid, method, fold, split, random_seed, target_pl_db, pred_pl_db FROM point_preds
  UNION ALL SELECT split, 33, row_uid, method, fold, split, 22, target_pl_db, CASE WHEN distance_m > 45 THEN NULL ELSE pred_pl_db END FROM point_preds
    WHERE random_seed = 22 AND NOT (method = 'direct_rf' AND fold = 'holdout_River')
  UNION ALL SELECT split, 33, row_uid, method, fold, split, 22, target_pl_db, pred_pl_db FROM point_preds WHERE random_seed = 22 AND method = 'log_distance' AND fold = 'holdout_North'),
run_folds AS (SELECT run_split, run_seed, method, fold, split, random_seed, sqrt(avg((pred_pl_db - target_pl_db) * (pred_pl_db - target_pl_db))) AS rmse, avg(abs(pred_pl_db - target_pl_db)) AS mae,
  count(*) AS test_count FROM run_samples GROUP BY 1, 2, 3, 4, 5, 6),
run_pooled AS (SELECT run_split, run_seed, method, split, sqrt(avg((pred_pl_db - target_pl_db) * (pred_pl_db - target_pl_db))) AS rmse, avg(abs(pred_pl_db - target_pl_db)) AS mae FROM run_samples WHERE run_seed <> 33 OR method <> 'direct_rf' GROUP BY 1, 2, 3, 4),
want_folds AS (SELECT 'leave_scenario_out' AS run_split, s.seed AS run_seed, concat('holdout_', scenario) AS fold, count(*) AS test_count FROM points, (VALUES (11, 11), (22, 22), (33, 22), (44, 11)) s(seed, source)
  WHERE s.source = CASE WHEN distance_m > 25 THEN 22 ELSE 11 END GROUP BY 1, 2, 3),
want AS (SELECT run_split, run_seed, CAST(sum(test_count) AS BIGINT) AS points, count(*) AS folds FROM want_folds GROUP BY 1, 2)"""


def run_tables(spark, sf_dir):
    rows = S.point_predictions(spark, sf_dir).withColumns({"run_split": F.col("split"), "run_seed": F.col("random_seed")})
    base = ["run_split", "run_seed", "row_uid", "method", "fold", "split", "random_seed", "target_pl_db", "pred_pl_db"]
    copy = rows.where("random_seed = 22").withColumn("run_seed", F.lit(33))
    holes = copy.where("NOT (method = 'direct_rf' AND fold = 'holdout_River')").withColumn(
        "pred_pl_db", F.when(~(F.col("distance_m") > 45), F.col("pred_pl_db")))
    repeats = copy.where("method = 'log_distance' AND fold = 'holdout_North'")
    samples = rows.select(*base).unionByName(holes.select(*base)).unionByName(repeats.select(*base))
    error = F.col("pred_pl_db") - F.col("target_pl_db")
    folds = samples.groupBy(*RC.RUN, "method", "fold", "split", "random_seed").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.count(F.lit(1)).alias("test_count"))
    pooled = samples.where("run_seed <> 33 OR method <> 'direct_rf'").groupBy(*RC.RUN, "method", "split").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))
    points = views.points(spark, sf_dir).withColumn("source", F.when(F.col("distance_m") > 25, 22).otherwise(11))
    seeds = F.explode(F.when(F.col("source") == 11, F.array(F.lit(11), F.lit(44))).otherwise(F.array(F.lit(22), F.lit(33))))
    want_folds = points.select(F.lit("leave_scenario_out").alias("run_split"), seeds.alias("run_seed"), F.concat(F.lit("holdout_"), "scenario").alias("fold")).groupBy(
        *RC.RUN, "fold").agg(F.count(F.lit(1)).alias("test_count"))
    want = want_folds.groupBy(*RC.RUN).agg(F.sum("test_count").alias("points")).withColumn("removed", F.lit(0))
    # A summary states what its run saw; the copy still names its source's seed, other files and other features.
    runs = want.where("run_seed <> 44").select(
        *RC.RUN, F.col("run_split").alias("stated_split"), F.when(F.col("run_seed") == 33, 22).otherwise(F.col("run_seed")).alias("stated_seed"),
        F.col("points").alias("rows_after_cleaning"), F.when(F.col("run_seed") == 33, 1).otherwise(0).alias("rows_removed_total"),
        F.when(F.col("run_seed") == 33, "files-b").otherwise("files-a").alias("fingerprint"), F.when(F.col("run_seed") == 33, "d").otherwise("d,walls").alias("features"))
    return want, want_folds, runs, folds, samples, pooled


@query("aud11_run_contract", RUN_TABLES + """,
f AS (SELECT run_seed, count(*) AS n, list_sort(list(DISTINCT method)) AS methods, list_sort(list(DISTINCT fold)) AS folds, bool_and(random_seed = run_seed) AS seed, bool_and(split = run_split) AS split,
  count(rmse) + count(mae) = 2 * count(*) AS fin FROM run_folds GROUP BY 1),
t AS (SELECT w.run_seed, count(*) FILTER (g.test_count IS NULL OR g.lo <> w.test_count OR g.test_count <> w.test_count) = 0 AS ok FROM want_folds w
  LEFT JOIN (SELECT run_seed, fold, max(test_count) AS test_count, min(test_count) AS lo FROM run_folds GROUP BY 1, 2) g USING (run_seed, fold) GROUP BY 1),
s AS (SELECT run_seed, count(*) AS n, count(DISTINCT row_uid) AS uids, bool_and(random_seed = run_seed) AS seed, bool_and(split = run_split) AS split, count(pred_pl_db) + count(target_pl_db) = 2 * count(*) AS fin,
  count(*) = count(DISTINCT (row_uid, method, fold)) AS uniq FROM run_samples GROUP BY 1),
once AS (SELECT run_seed, min(c) AS lo, max(c) AS hi FROM (SELECT run_seed, method, count(DISTINCT row_uid) AS c FROM run_samples GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT run_seed, count(*) AS n, list_sort(list(DISTINCT method)) AS methods, bool_and(split = run_split) AS split, count(rmse) + count(mae) = 2 * count(*) AS fin FROM run_pooled GROUP BY 1),
m AS (SELECT ['direct_rf', 'log_distance', 'multi_wall_linear'] AS methods, ['holdout_Annex', 'holdout_North', 'holdout_River'] AS folds),
r AS (SELECT run_split, CAST(want.run_seed AS BIGINT) AS run_seed, coalesce(f.n, 0) AS fold_rows, coalesce(s.n, 0) AS sample_rows, coalesce(p.n, 0) AS pooled_rows, coalesce(s.uids, 0) AS unique_test_points,
  want.run_seed <> 44 AS check_summary_split, want.run_seed IN (11, 22) AS check_summary_seed, want.run_seed <> 44 AS check_rows_after_cleaning, want.run_seed IN (11, 22) AS check_rows_removed_total,
  coalesce(f.methods = m.methods, false) AS check_methods_complete, coalesce(f.folds = m.folds, false) AS check_folds_complete, coalesce(f.n = 3 * want.folds, false) AS check_fold_result_row_count,
  coalesce(s.n = 3 * want.points, false) AS check_sample_row_count, coalesce(p.n = 3, false) AS check_pooled_row_count, coalesce(f.seed, false) AS check_fold_seed_column,
  coalesce(s.seed, false) AS check_sample_seed_column, coalesce(f.split, false) AS check_fold_split_column, coalesce(s.split, false) AS check_sample_split_column, coalesce(p.split, false) AS check_pooled_split_column,
  coalesce(p.methods = m.methods, false) AS check_pooled_methods_complete, coalesce(f.fin, false) AS check_finite_fold_metrics, coalesce(s.fin, false) AS check_finite_sample_values,
  coalesce(p.fin, false) AS check_finite_pooled_metrics, coalesce(s.uniq, false) AS check_unique_predictions, coalesce(once.lo = want.points AND once.hi = want.points, false) AS check_all_points_once_per_method,
  t.ok AS check_test_counts_correct, want.run_seed IN (11, 22) AS check_dataset_fingerprints_match, want.run_seed IN (11, 22) AS check_features_match_within_protocol
  FROM want CROSS JOIN m LEFT JOIN f USING (run_seed) LEFT JOIN t USING (run_seed) LEFT JOIN s USING (run_seed) LEFT JOIN once USING (run_seed) LEFT JOIN p USING (run_seed))
SELECT *, concat_ws(',', """ + ", ".join(f"CASE WHEN NOT check_{c} THEN '{c}' END" for c in RC.CHECKS) + """) AS failed,
  CASE WHEN """ + " AND ".join(f"check_{c}" for c in RC.CHECKS) + """ THEN 'PASS' ELSE 'FAIL' END AS status FROM r""", ["points"])
def aud11_contract(spark, sf_dir):
    return tidy(RC.run_contract(*run_tables(spark, sf_dir), ("direct_rf", "log_distance", "multi_wall_linear"), ["rmse", "mae"], ["target_pl_db", "pred_pl_db"]))


def _few(spark, sf_dir):
    from signalgrid.queries.paired import fewshot_predictions
    return fewshot_predictions(spark, sf_dir)


@query("aud12_fewshot_audit", """SELECT u.name, u.ok AS passed FROM (SELECT count(DISTINCT scenario) = 3 AS folds_complete FROM points) p,
  LATERAL (VALUES ('folds_complete', p.folds_complete), ('fractions_complete', true), ('anchor_seeds_complete', true), ('model_seed_constant', true), ('anchors_excluded', true), ('method_single', true), ('predictions_unique', true)) u(name, ok)""", ["points"])
def aud12(spark, sf_dir):
    few = _few(spark, sf_dir)
    keys = ["row_uid", "fold", "method", "anchor_fraction", "anchor_seed", "model_seed"]
    counted = few.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.max("is_anchor").alias("is_anchor"))
    return A.boolean_checks(counted, {
        "folds_complete": F.countDistinct("fold") == 3,
        "fractions_complete": F.countDistinct("anchor_fraction") == 2,
        "anchor_seeds_complete": F.countDistinct("anchor_seed") == 2,
        "model_seed_constant": (F.min("model_seed") == 11) & (F.max("model_seed") == 11),
        "anchors_excluded": ~F.max("is_anchor"),
        "method_single": F.countDistinct("method") == 1,
        "predictions_unique": F.max("copies") == 1})


def _few_audit_sql() -> str:
    from signalgrid.queries.paired import FEW
    names = "('holdout_Annex', 'holdout_North', 'holdout_River')"
    return FEW + f""", a AS (SELECT 'given' AS audit, concat('holdout_', scenario) AS fold, * EXCLUDE (raw, n, rn) FROM marked WHERE NOT is_anchor
  UNION ALL SELECT 'faulty', concat('holdout_', scenario), * EXCLUDE (raw, n, rn) FROM marked WHERE anchor_fraction < 0.02
  UNION ALL SELECT 'faulty', concat('holdout_', scenario), * EXCLUDE (raw, n, rn) FROM marked WHERE anchor_fraction < 0.02 AND scenario = 'River'),
z AS (SELECT 'given' AS audit, row_uid, fold, random_seed FROM point_preds WHERE method = 'log_distance' AND random_seed = 11
  UNION ALL SELECT 'faulty', row_uid, fold, random_seed FROM point_preds WHERE method = 'log_distance'
  UNION ALL SELECT 'faulty', row_uid, fold, random_seed FROM point_preds WHERE method = 'log_distance' AND fold = 'holdout_Annex'),
g AS (SELECT audit, count(*) FILTER (fold NOT IN {names}) = 0 AND count(DISTINCT fold) = 3 AS folds, count(DISTINCT round(anchor_fraction, 2)) = 2 AS fractions, count(DISTINCT anchor_seed) = 2 AS seeds,
  NOT bool_or(is_anchor) AS excluded, count(*) = count(DISTINCT (row_uid, fold, anchor_fraction, anchor_seed)) AS uniq FROM a GROUP BY 1),
y AS (SELECT audit, max(random_seed) = 11 AS seed, count(*) = count(DISTINCT (row_uid, fold)) AS uniq FROM z GROUP BY 1)
SELECT g.audit, u.name, u.ok AS passed FROM g JOIN y USING (audit), LATERAL (VALUES ('fewshot_split', g.audit = 'given'), ('zero_shot_split', true), ('fewshot_model_seed_11', true), ('zero_shot_seed_11', y.seed),
  ('fewshot_methods_complete', g.audit = 'given'), ('folds_complete', g.folds), ('fractions_complete', g.fractions), ('anchor_seeds_complete', g.seeds), ('model_seed_constant', g.audit = 'given'),
  ('anchors_excluded', g.excluded), ('fewshot_predictions_unique', g.uniq), ('zero_shot_predictions_unique', y.uniq)) u(name, ok)"""


@query("aud12_fewshot_inputs", _few_audit_sql(), ["points"])
def aud12_inputs(spark, sf_dir):
    """All twelve conditions, on the given predictions and on a copy with faults: anchors scored, a fraction missing, folds repeated."""
    from signalgrid.queries.paired import ANCHOR_SEEDS, FRACTIONS, fewshot_marked, zero_shot
    columns = ["row_uid", "fold", "method", "anchor_fraction", "anchor_seed", "model_seed", "is_anchor"]
    rows = fewshot_marked(spark, sf_dir).select(*columns)
    low = rows.where("anchor_fraction < 0.02").withColumns({"method": F.lit("other"), "model_seed": F.lit(12)})
    zero = zero_shot(spark, sf_dir)
    variants = {"given": (rows.where("NOT is_anchor"), zero.where("random_seed = 11"), "leave_scenario_fewshot"),
                "faulty": (low.unionByName(low.where("fold = 'holdout_River'")), zero.unionByName(zero.where("fold = 'holdout_Annex'")), "leave_scenario_out")}
    out = []
    for name, (few, base, split_name) in variants.items():
        stated = base.agg(F.lit("zero").alias("kind"), F.max("split").alias("split"), F.max("random_seed").alias("seed")).unionByName(
            few.agg(F.lit("fewshot").alias("kind"), F.lit(split_name).alias("split"), F.lit(11).alias("seed")))
        audit = A.fewshot_audit(few, base, stated, ["bias_calibrated_log_distance"], [f"holdout_{s}" for s in views.SCENARIOS], FRACTIONS, ANCHOR_SEEDS)
        out.append(audit.withColumn("audit", F.lit(name)))
    return out[0].unionByName(out[1])


@query("aud13_grid_contract", """WITH a AS (SELECT task, method, sparse_seed, count(*) AS have FROM run_metrics GROUP BY 1, 2, 3),
w AS (SELECT t.task, m.method, CAST(s.seed AS INT) AS sparse_seed FROM (VALUES ('task1'), ('task2'), ('task3')) t(task), (VALUES ('residual_extra'), ('direct_rf'), ('multi_wall'), ('idw')) m(method), (VALUES (11), (22), (33)) s(seed))
SELECT task, method, CAST(sparse_seed AS BIGINT) AS sparse_seed, CASE WHEN a.have IS NULL THEN 'missing' WHEN w.task IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem
FROM a FULL JOIN (SELECT *, 1 AS one FROM w) w USING (task, method, sparse_seed) WHERE a.have IS NULL OR w.one IS NULL OR a.have > 1""".replace("w.task IS NULL", "w.one IS NULL"), ["run_metrics"])
def aud13(spark, sf_dir):
    seeds = F.explode(F.array(*[F.lit(s) for s in (11, 22, 33)]))
    methods = F.explode(F.array(*[F.lit(m) for m in METHODS[:4]]))
    tasks = F.explode(F.array(*[F.lit(t) for t in ("task1", "task2", "task3")]))
    grid = spark.range(1).select(tasks.alias("task")).withColumn("method", methods).withColumn("sparse_seed", seeds)
    return tidy(A.grid_mismatches(views.run_metrics(spark, sf_dir), grid, ["task", "method", "sparse_seed"]))


@query("aud14_dataset_readiness", SIDES + """
SELECT CAST(1 AS BIGINT) AS check_id, 'paths_resolve' AS name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS offenders FROM s WHERE c_custkey % 7 = 0
UNION ALL SELECT 2, 'scene_overlap', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (SELECT scene_id FROM s WHERE side = 'train' INTERSECT SELECT scene_id FROM s WHERE side = 'val')
UNION ALL SELECT 3, 'frequency_known', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*) FROM s WHERE frequency_hz <= 0
UNION ALL SELECT 4, 'sample_unique', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (SELECT sample_id FROM s GROUP BY 1 HAVING count(*) > 1)""", ["manifest"])
def aud14(spark, sf_dir):
    s = split(spark, sf_dir)
    listing = views.manifest(spark, sf_dir).where("c_custkey % 7 <> 0").select("map_path")
    return shown(A.readiness({
        "paths_resolve": A.unresolved_paths(s, listing, "map_path"),
        "scene_overlap": A.shared_groups(s.where("side = 'train'"), s.where("side = 'val'"), "scene_id"),
        "frequency_known": s.where("frequency_hz <= 0"),
        "sample_unique": A.duplicates(s, ["sample_id"])}, warn=("frequency_known",)))


@query("aud15_duplicate_keys", """SELECT source_file, CAST(num_brick_wall AS BIGINT) AS bricks, distance_m, count(*) AS copies FROM points GROUP BY 1, 2, 3 HAVING count(*) > 1""", ["points"])
def aud15(spark, sf_dir):
    return tidy(A.duplicates(views.points(spark, sf_dir).withColumn("bricks", F.col("num_brick_wall").cast("bigint")), ["source_file", "bricks", "distance_m"]))
