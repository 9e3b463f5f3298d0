"""Paired statistics, bootstrap, rankings and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.functions import hashing
from signalgrid.operators import fits, metrics as M, paired as P, reports as R, sampling
from signalgrid.plans import views
from signalgrid.queries import scores as S
from signalgrid.queries import sql_parts as sq
from signalgrid.queries.registry import query, scan_rows, tidy

PRIMARY, BASELINES, COLS = "residual_extra", ("direct_rf", "multi_wall", "idw"), ("rmse", "p90_ae")
IN = "('residual_extra', 'direct_rf', 'multi_wall', 'idw')"
KEYS = ", ".join(P.MAP_KEYS)


def conditioned(spark, sf_dir) -> DataFrame:
    return P.with_condition(views.run_metrics(spark, sf_dir))


def averaged(spark, sf_dir) -> DataFrame:
    return P.seed_averaged(conditioned(spark, sf_dir), (PRIMARY, *BASELINES), COLS)


def pairs(spark, sf_dir) -> DataFrame:
    return P.paired_comparisons(averaged(spark, sf_dir), PRIMARY, BASELINES, COLS)


def maps_bound(spark, sf_dir) -> int:
    """Pairs of one (scope, baseline, metric) cannot outnumber the events they come from."""
    return scan_rows(spark, sf_dir, "events")


def _win(d: str) -> str:
    return f"CASE WHEN {d} IS NULL THEN 'missing' WHEN {d} > 1e-12 THEN 'residual_extra' WHEN {d} < -1e-12 THEN 'baseline' ELSE 'tie' END"


AVG = S.SUBGROUP + f""", averaged AS (SELECT {KEYS}, method, avg(rmse) AS rmse, avg(p90_ae) AS p90_ae, count(DISTINCT sparse_seed) AS num_seeds
  FROM cond WHERE method IN {IN} GROUP BY {KEYS}, method)"""
PAIRED = AVG + f""", long AS (SELECT {KEYS}, method, 'rmse' AS metric, rmse AS v FROM averaged UNION ALL SELECT {KEYS}, method, 'p90_ae', p90_ae FROM averaged),
pairs AS (SELECT p.* EXCLUDE (method, v), p.v AS primary_value, b.v AS baseline_value, b.method AS baseline_method, b.v - p.v AS d,
  100 * (b.v - p.v) / nullif(b.v, 0) AS pct, {_win('(b.v - p.v)')} AS winner
  FROM long p JOIN long b USING ({KEYS}, metric) WHERE p.method = 'residual_extra' AND b.method <> 'residual_extra'),
scoped AS (SELECT 'overall' AS scope, * FROM pairs UNION ALL SELECT transfer_condition, * FROM pairs)"""


@query("sta1_seed_average", AVG + f"""SELECT task, sample_id, CAST(building AS BIGINT) AS building, CAST(antenna AS BIGINT) AS antenna, CAST(frequency AS BIGINT) AS frequency,
  transfer_condition, method, round(rmse, 6) AS rmse, round(p90_ae, 6) AS p90_ae, num_seeds FROM averaged""", ["run_metrics"])
def sta1(spark, sf_dir):
    return tidy(averaged(spark, sf_dir))


@query("sta2_paired_comparisons", PAIRED + """SELECT task, sample_id, baseline_method, metric, round(primary_value, 6) AS primary_value, round(baseline_value, 6) AS baseline_value,
  round(d, 6) AS paired_difference, round(pct, 4) AS improvement_percent, d IS NOT NULL AS valid_pair, winner FROM pairs""", ["run_metrics"])
def sta2(spark, sf_dir):
    return tidy(pairs(spark, sf_dir).select("task", "sample_id", "baseline_method", "metric", "primary_value", "baseline_value", "paired_difference",
                                            "improvement_percent", "valid_pair", "winner"), improvement_percent=4)


@query("sta1_incomplete_seeds", AVG + """SELECT task, sample_id, method, num_seeds FROM averaged WHERE num_seeds <> 3""", ["run_metrics"])
def sta1_incomplete(spark, sf_dir):
    return tidy(P.incomplete_seeds(averaged(spark, sf_dir)).select("task", "sample_id", "method", "num_seeds"))


@query("sta2_unmatched_maps", AVG + f""", b AS (SELECT * FROM (VALUES ('direct_rf'), ('multi_wall'), ('idw')) t(baseline_method)),
want AS (SELECT DISTINCT {KEYS}, baseline_method FROM averaged, b WHERE method = 'residual_extra' OR method = baseline_method)
SELECT task, sample_id, baseline_method, CASE WHEN l = 0 THEN 'missing_left' WHEN r = 0 THEN 'missing_right' ELSE 'repeated' END AS problem, l AS left_rows, r AS right_rows FROM (
  SELECT w.task, w.sample_id, w.baseline_method, count(*) FILTER (a.method = 'residual_extra') AS l, count(*) FILTER (a.method = w.baseline_method) AS r
  FROM want w JOIN averaged a ON {" AND ".join(f"w.{k} IS NOT DISTINCT FROM a.{k}" for k in P.MAP_KEYS)} GROUP BY ALL) WHERE l <> 1 OR r <> 1""", ["run_metrics"])
def sta2_unmatched(spark, sf_dir):
    return tidy(P.unmatched_maps(averaged(spark, sf_dir), PRIMARY, BASELINES).select("task", "sample_id", "baseline_method", "problem", "left_rows", "right_rows"))


RATES_SQL = PAIRED + """, rates AS (SELECT task, scope, baseline_method, metric, count(*) AS num_candidate_maps, count(d) AS num_valid_maps,
  count(*) - count(d) AS num_missing_pairs, count(*) FILTER (winner = 'residual_extra') AS primary_map_wins, count(*) FILTER (winner = 'baseline') AS baseline_map_wins,
  count(*) FILTER (winner = 'tie') AS ties, avg(primary_value) FILTER (d IS NOT NULL) AS mp, avg(baseline_value) FILTER (d IS NOT NULL) AS mb,
  avg(d) AS md, median(d) AS med FROM scoped GROUP BY 1, 2, 3, 4)"""


@query("sta3_win_rates", RATES_SQL + """SELECT task, scope, baseline_method, metric, num_candidate_maps, num_valid_maps, num_missing_pairs, primary_map_wins, baseline_map_wins, ties,
  round(primary_map_wins / CAST(num_valid_maps AS DOUBLE), 6) AS primary_map_win_rate, round(baseline_map_wins / CAST(num_valid_maps AS DOUBLE), 6) AS baseline_map_win_rate,
  round(mp, 6) AS mean_primary_value, round(mb, 6) AS mean_baseline_value, round(md, 6) AS mean_paired_difference, round(med, 6) AS median_paired_difference,
  round(100 * (mb - mp) / mb, 4) AS mean_improvement_percent FROM rates WHERE num_valid_maps > 0""", ["run_metrics"])
def sta3(spark, sf_dir):
    return tidy(P.win_rates(pairs(spark, sf_dir), PRIMARY, maps_bound(spark, sf_dir)), mean_improvement_percent=4)


BUILDINGS_SQL = PAIRED + f""", buildings AS (SELECT task, scope, building, baseline_method, metric, count(DISTINCT sample_id) AS num_valid_maps, avg(primary_value) AS mp,
  avg(baseline_value) AS mb, avg(d) AS md, median(d) AS med, avg(CASE WHEN winner = 'residual_extra' THEN 1e0 ELSE 0e0 END) AS wr FROM scoped WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


@query("sta4_building_summary", BUILDINGS_SQL + f"""SELECT task, scope, CAST(building AS BIGINT) AS building, baseline_method, metric, num_valid_maps, round(mp, 6) AS mean_primary_value,
  round(mb, 6) AS mean_baseline_value, round(md, 6) AS mean_paired_difference, round(med, 6) AS median_paired_difference, round(wr, 6) AS primary_map_win_rate,
  round(100 * (mb - mp) / nullif(mb, 0), 4) AS improvement_percent, {_win('md')} AS building_winner FROM buildings""", ["run_metrics"])
def sta4(spark, sf_dir):
    return tidy(P.building_summary(pairs(spark, sf_dir), PRIMARY, maps_bound(spark, sf_dir)), improvement_percent=4)


BOOT_SQL = BUILDINGS_SQL + f""", clusters AS (SELECT task, scope, baseline_method, metric, building, md, 100 * (mb - mp) / nullif(mb, 0) AS pct,
  row_number() OVER (PARTITION BY task, scope, baseline_method, metric ORDER BY building) - 1 AS pos,
  count(*) OVER (PARTITION BY task, scope, baseline_method, metric) AS n FROM buildings),
sizes AS (SELECT DISTINCT task, scope, baseline_method, metric, n FROM clusters),
picked AS ({sq.bootstrap_draws("sizes", 20000, 20260, ("task", "scope", "baseline_method", "metric"))}),
reps AS (SELECT p.task, p.scope, p.baseline_method, p.metric, p.b, avg(c.md) AS diff, avg(c.pct) AS pct FROM picked p
  JOIN clusters c USING (task, scope, baseline_method, metric, pos) GROUP BY 1, 2, 3, 4, 5),
ci AS (SELECT task, scope, baseline_method, metric, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi, quantile_cont(pct, 0.025) AS plo,
  quantile_cont(pct, 0.975) AS phi, avg(CASE WHEN diff > 0 THEN 1e0 ELSE 0e0 END) AS better FROM reps GROUP BY 1, 2, 3, 4),
base AS (SELECT task, scope, baseline_method, metric, count(*) AS num_buildings, array_to_string(list('B' || CAST(building AS VARCHAR) ORDER BY building), ',') AS buildings,
  avg(md) AS cm, median(md) AS cmed, avg(pct) AS cp, count(*) FILTER (md > 0) AS pos_n, count(*) FILTER (md < 0) AS neg_n, count(*) FILTER (md = 0) AS tie_n
  FROM clusters GROUP BY 1, 2, 3, 4),
boot AS (SELECT *, least(1e0, 2 * (SELECT sum(CASE WHEN i = 0 THEN 1 ELSE exp(lgamma(pos_n + neg_n + 1e0) - lgamma(i + 1e0) - lgamma(pos_n + neg_n - i + 1e0)) END)
   FROM range(0, least(pos_n, neg_n) + 1) t(i)) / pow(2, pos_n + neg_n)) AS p FROM base JOIN ci USING (task, scope, baseline_method, metric))"""


def bootstrap(spark, sf_dir) -> DataFrame:
    return P.cluster_bootstrap(P.building_summary(pairs(spark, sf_dir), PRIMARY, maps_bound(spark, sf_dir)), ["task", "scope", "baseline_method", "metric"])


@query("sta5_cluster_bootstrap", BOOT_SQL + """SELECT task, scope, baseline_method, metric, num_buildings, buildings, round(cm, 6) AS cluster_mean_paired_difference,
  round(cmed, 6) AS cluster_median_paired_difference, round(cp, 4) AS cluster_mean_improvement_percent, round(lo, 6) AS difference_ci_low, round(hi, 6) AS difference_ci_high,
  round(plo, 4) AS improvement_percent_ci_low, round(phi, 4) AS improvement_percent_ci_high, round(better, 6) AS probability_primary_better, pos_n AS primary_building_wins,
  neg_n AS baseline_building_wins, tie_n AS building_ties, round(p, 6) AS sign_test_p_two_sided, lo > 0 OR hi < 0 AS difference_ci_excludes_zero FROM boot""", ["run_metrics"])
def sta5(spark, sf_dir):
    return tidy(bootstrap(spark, sf_dir), cluster_mean_improvement_percent=4, improvement_percent_ci_low=4, improvement_percent_ci_high=4)


@query("sta6_sign_test", PAIRED + """, c AS (SELECT task, building, count(*) FILTER (winner = 'residual_extra') AS pos_n, count(*) FILTER (winner = 'baseline') AS neg_n
  FROM pairs WHERE metric = 'rmse' AND baseline_method = 'idw' GROUP BY 1, 2)
SELECT task, CAST(building AS BIGINT) AS building, pos_n AS positive, neg_n AS negative, round(CASE WHEN pos_n + neg_n > 0 THEN least(1e0, 2 * (
  SELECT sum(exp(lgamma(pos_n + neg_n + 1e0) - lgamma(i + 1e0) - lgamma(pos_n + neg_n - i + 1e0) - (pos_n + neg_n) * ln(2e0))) FROM range(0, least(pos_n, neg_n) + 1) t(i))) END, 6) AS p FROM c""", ["run_metrics"])
def sta6(spark, sf_dir):
    counts = pairs(spark, sf_dir).where("metric = 'rmse' AND baseline_method = 'idw'").groupBy("task", "building").agg(
        F.count(F.when(F.col("winner") == PRIMARY, 1)).alias("positive"), F.count(F.when(F.col("winner") == "baseline", 1)).alias("negative"))
    return tidy(counts.withColumn("p", P.sign_test(F.col("positive"), F.col("negative"))))


PER_SEED_CTE = f""", slong AS (SELECT {KEYS}, sparse_seed, method, 'rmse' AS metric, rmse AS v FROM cond WHERE method IN {IN}
  UNION ALL SELECT {KEYS}, sparse_seed, method, 'p90_ae', p90_ae FROM cond WHERE method IN {IN}),
spairs AS (SELECT p.task, p.sparse_seed, p.metric, p.v AS pv, b.v AS bv, b.method AS baseline_method, b.v - p.v AS d FROM slong p JOIN slong b USING ({KEYS}, sparse_seed, metric)
  WHERE p.method = 'residual_extra' AND b.method <> 'residual_extra'),
per_seed AS (SELECT task, sparse_seed, baseline_method, metric, count(*) AS num_valid_maps, avg(pv) AS mp, avg(bv) AS mb, avg(d) AS md,
  avg(CASE WHEN d > 1e-12 THEN 1e0 ELSE 0e0 END) AS wr FROM spairs WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4)"""
PER_SEED_SQL = S.SUBGROUP + PER_SEED_CTE


def per_seed(spark, sf_dir) -> DataFrame:
    return P.per_seed_consistency(conditioned(spark, sf_dir), PRIMARY, BASELINES, COLS)


@query("sta7_per_seed_consistency", PER_SEED_SQL + f"""SELECT task, CAST(sparse_seed AS BIGINT) AS sparse_seed, baseline_method, metric, num_valid_maps, round(mp, 6) AS mean_primary_value,
  round(mb, 6) AS mean_baseline_value, round(md, 6) AS mean_paired_difference, round(wr, 6) AS primary_map_win_rate, round(100 * (mb - mp) / mb, 4) AS improvement_percent,
  {_win('md')} AS seed_winner FROM per_seed""", ["run_metrics"])
def sta7(spark, sf_dir):
    return tidy(per_seed(spark, sf_dir), improvement_percent=4)


@query("sta8_headline", BOOT_SQL + """, rates AS (SELECT task, baseline_method, metric, count(*) FILTER (winner = 'residual_extra') / CAST(count(d) AS DOUBLE) AS wr,
  avg(primary_value) FILTER (d IS NOT NULL) AS mp, avg(baseline_value) FILTER (d IS NOT NULL) AS mb FROM pairs GROUP BY 1, 2, 3)""" + PER_SEED_CTE + """,
seeds AS (SELECT task, baseline_method, metric, count(*) FILTER (md > 1e-12) AS wins, count(*) AS n FROM per_seed GROUP BY 1, 2, 3)
SELECT r.task, r.baseline_method, r.metric, round(mp, 6) AS mean_primary_value, round(mb, 6) AS mean_baseline_value, round(100 * (mb - mp) / mb, 4) AS mean_improvement_percent,
  round(wr, 6) AS primary_map_win_rate, round(cm, 6) AS cluster_mean_paired_difference, round(lo, 6) AS difference_ci_low, round(hi, 6) AS difference_ci_high,
  pos_n AS primary_building_wins, num_buildings, round(p, 6) AS sign_test_p_two_sided, s.wins AS primary_seed_wins, s.n AS num_seeds
FROM rates r JOIN boot b ON b.task = r.task AND b.baseline_method = r.baseline_method AND b.metric = r.metric AND b.scope = 'overall'
JOIN seeds s ON s.task = r.task AND s.baseline_method = r.baseline_method AND s.metric = r.metric""", ["run_metrics"])
def sta8(spark, sf_dir):
    out = R.headline(P.win_rates(pairs(spark, sf_dir), PRIMARY, maps_bound(spark, sf_dir)), bootstrap(spark, sf_dir), per_seed(spark, sf_dir), PRIMARY)
    return tidy(out, mean_improvement_percent=4)


@query("sta9_bootstrap_mean_ci", f"""WITH rows AS (SELECT method, sample_id, sparse_seed, rmse AS v, row_number() OVER (PARTITION BY method ORDER BY {sq.hash_sql("sample_id", "CAST(sparse_seed AS VARCHAR)")}, sample_id, sparse_seed) - 1 AS pos,
  count(*) OVER (PARTITION BY method) AS n FROM run_metrics WHERE rmse IS NOT NULL),
sizes AS (SELECT method, count(*) AS n, avg(v) AS mean FROM rows GROUP BY 1),
picked AS ({sq.bootstrap_draws("sizes", 1000, 42, ("method",))}),
reps AS (SELECT p.method, p.b, avg(r.v) AS m FROM picked p JOIN rows r USING (method, pos) GROUP BY 1, 2),
ci AS (SELECT method, avg(m) AS bm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM reps GROUP BY 1)
SELECT method, n, round(mean, 5) AS mean, round(bm, 5) AS bootstrap_mean, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high FROM sizes JOIN ci USING (method)""", ["run_metrics"])
def sta9(spark, sf_dir):
    return tidy(P.bootstrap_mean_ci(views.run_metrics(spark, sf_dir), ["method"], "rmse", ["sample_id", "sparse_seed"], 1000,
                                    rows_bound=scan_rows(spark, sf_dir, "events")), 5)


TASK_MEANS = "SELECT task, method, avg(rmse) AS rmse_mean FROM run_metrics GROUP BY 1, 2"


@query("sta10_rank_by_metric", f"""SELECT task, method, round(rmse_mean, 6) AS rmse_mean, rank() OVER (PARTITION BY task ORDER BY rmse_mean) AS rank FROM ({TASK_MEANS})""", ["run_metrics"])
def sta10(spark, sf_dir):
    means = views.run_metrics(spark, sf_dir).groupBy("task", "method").agg(F.avg("rmse").alias("rmse_mean"))
    return tidy(P.ranked(means, ["task"], "rmse_mean"))


POOLED_SEED = """pooled_seed AS (SELECT split, method, random_seed, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM point_preds GROUP BY 1, 2, 3),
macro_seed AS (SELECT split, method, random_seed, avg(rmse) AS rmse FROM fold_rows GROUP BY 1, 2, 3)"""


def pooled_seed(spark, sf_dir) -> DataFrame:
    rows = M.with_error(S.point_predictions(spark, sf_dir), "pred_pl_db", "target_pl_db")
    return rows.groupBy("split", "method", "random_seed").agg(
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"))


def macro_seed(spark, sf_dir) -> DataFrame:
    return S.fold_means(spark, sf_dir).groupBy("split", "method", "random_seed").agg(F.avg("rmse").alias("rmse"))


@query("sta11_rankings_union", S.FOLD_ROWS + ", " + POOLED_SEED + """, p AS (SELECT split, method, avg(rmse) AS rmse FROM pooled_seed GROUP BY 1, 2), m AS (SELECT split, method, avg(rmse) AS rmse FROM macro_seed GROUP BY 1, 2)
SELECT 'pooled' AS ranking_type, split, method, round(rmse, 6) AS rmse, rank() OVER (PARTITION BY split ORDER BY rmse) AS rank FROM p
UNION ALL SELECT 'macro', split, method, round(rmse, 6), rank() OVER (PARTITION BY split ORDER BY rmse) FROM m""", ["points"])
def sta11(spark, sf_dir):
    def mean(df):
        return df.groupBy("split", "method").agg(F.avg("rmse").alias("rmse"))
    return tidy(R.rankings(mean(pooled_seed(spark, sf_dir)), mean(macro_seed(spark, sf_dir)), "split"))


IMPROVE = S.FOLD_ROWS + ", " + POOLED_SEED + """, imp AS (SELECT a.split, a.random_seed, a.method, b.method AS baseline, a.rmse AS pm, b.rmse AS pb, 100 * (b.rmse - a.rmse) / b.rmse AS pg,
  100 * (b.mae - a.mae) / b.mae AS mg, c.rmse AS mm, d.rmse AS mb, 100 * (d.rmse - c.rmse) / d.rmse AS macro_gain
  FROM pooled_seed a JOIN pooled_seed b USING (split, random_seed) JOIN macro_seed c ON c.split = a.split AND c.random_seed = a.random_seed AND c.method = a.method
  JOIN macro_seed d ON d.split = a.split AND d.random_seed = a.random_seed AND d.method = b.method
  WHERE b.method IN ('log_distance', 'direct_rf') AND a.method <> b.method)"""
BASE2 = ("log_distance", "direct_rf")


@query("sta12_per_seed_improvement", IMPROVE + """SELECT split, CAST(random_seed AS BIGINT) AS random_seed, method, baseline, round(pm, 5) AS pooled_method_rmse, round(pb, 5) AS pooled_baseline_rmse,
  round(pg, 5) AS pooled_rmse_improvement_percent, round(mg, 5) AS pooled_mae_improvement_percent, round(mm, 5) AS macro_method_rmse, round(mb, 5) AS macro_baseline_rmse,
  round(macro_gain, 5) AS macro_rmse_improvement_percent FROM imp""", ["points"])
def sta12(spark, sf_dir):
    return tidy(R.per_seed_improvement(pooled_seed(spark, sf_dir), macro_seed(spark, sf_dir), "split", BASE2), 5)


FOLD_CMP = S.FOLD_ROWS + """, fc AS (SELECT a.split, a.random_seed, a.fold, a.method, b.method AS baseline, a.rmse AS method_rmse, b.rmse AS baseline_rmse, b.rmse - a.rmse AS d
  FROM fold_rows a JOIN fold_rows b USING (split, random_seed, fold) WHERE b.method IN ('log_distance', 'direct_rf') AND a.method <> b.method)"""


@query("sta13_fold_comparison", FOLD_CMP + """SELECT split, CAST(random_seed AS BIGINT) AS random_seed, fold, method, baseline, round(method_rmse, 5) AS method_rmse, round(baseline_rmse, 5) AS baseline_rmse,
  round(d, 5) AS rmse_difference, round(100 * d / baseline_rmse, 5) AS rmse_improvement_percent, CASE WHEN d > 1e-12 THEN 'method' WHEN d < -1e-12 THEN 'baseline' ELSE 'tie' END AS winner FROM fc""", ["points"])
def sta13(spark, sf_dir):
    return tidy(R.fold_comparison(S.fold_means(spark, sf_dir), "split", BASE2), 5)


POINT_CMP = """, pc AS (SELECT a.split, a.random_seed, a.method, b.method AS baseline, abs(a.e) AS ea, abs(b.e) AS eb FROM point_preds a JOIN point_preds b USING (split, random_seed, fold, row_uid)
  WHERE b.method IN ('log_distance', 'direct_rf') AND a.method <> b.method),
pcs AS (SELECT split, random_seed, method, baseline, count(*) AS n, sqrt(avg(ea * ea)) AS mr, sqrt(avg(eb * eb)) AS br, avg(ea) AS mm, avg(eb) AS bm, count(*) FILTER (ea < eb) AS mw,
  count(*) FILTER (eb < ea) AS bw FROM pc GROUP BY 1, 2, 3, 4)"""


def point_pairs(spark, sf_dir) -> DataFrame:
    return R.paired_points(S.point_predictions(spark, sf_dir), ["split", "random_seed"], BASE2)


@query("sta14_point_comparison", S.POINT_PREDS + POINT_CMP + """SELECT split, CAST(random_seed AS BIGINT) AS random_seed, method, baseline, n AS paired_points, round(mr, 5) AS method_rmse, round(br, 5) AS baseline_rmse,
  round(mm, 5) AS method_mae, round(bm, 5) AS baseline_mae, mw AS method_point_wins, bw AS baseline_point_wins, n - mw - bw AS ties, round(100 * (br - mr) / br, 5) AS rmse_improvement_percent,
  round(100 * (bm - mm) / bm, 5) AS mae_improvement_percent, round(1e2 * mw / n, 5) AS method_point_win_percent FROM pcs""", ["points"])
def sta14(spark, sf_dir):
    return tidy(R.point_comparison(point_pairs(spark, sf_dir), ["split", "random_seed"], strict=True), 5)


@query("sta13_key_problems", S.FOLD_ROWS + """, m AS (SELECT DISTINCT method FROM fold_rows), b AS (SELECT method AS baseline FROM m WHERE method IN ('log_distance', 'direct_rf')),
k AS (SELECT DISTINCT split, random_seed, fold FROM fold_rows), n AS (SELECT k.*, m.method, b.baseline,
  (SELECT count(*) FROM fold_rows f WHERE f.split = k.split AND f.random_seed = k.random_seed AND f.fold = k.fold AND f.method = m.method) AS l,
  (SELECT count(*) FROM fold_rows f WHERE f.split = k.split AND f.random_seed = k.random_seed AND f.fold = k.fold AND f.method = b.baseline) AS r FROM k, m, b WHERE m.method <> b.baseline)
SELECT split, CAST(random_seed AS BIGINT) AS random_seed, fold, method, baseline, l AS left_rows, r AS right_rows,
  CASE WHEN l = 0 THEN 'missing_left' WHEN r = 0 THEN 'missing_right' ELSE 'repeated' END AS problem FROM n WHERE l + r > 0 AND (l <> 1 OR r <> 1)""", ["points"])
def sta13_problems(spark, sf_dir):
    return tidy(R.side_problems(S.fold_means(spark, sf_dir), ["split", "random_seed", "fold"], BASE2))


@query("sta15_comparison_summary", IMPROVE + FOLD_CMP[len(S.FOLD_ROWS):] + POINT_CMP + """, s AS (SELECT split, method, baseline, count(DISTINCT random_seed) AS num_seeds, avg(pm) AS pm_mean,
  stddev_samp(pm) AS pm_std, avg(pg) AS g_mean, stddev_samp(pg) AS g_std, avg(macro_gain) AS mg_mean, count(*) FILTER (pm < pb) AS seed_wins FROM imp GROUP BY 1, 2, 3),
f AS (SELECT split, method, baseline, count(*) FILTER (m < b) AS fold_wins, count(*) AS num_folds FROM (
  SELECT split, method, baseline, fold, avg(method_rmse) AS m, avg(baseline_rmse) AS b FROM fc GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
p AS (SELECT split, method, baseline, avg(1e2 * mw / n) AS win FROM pcs GROUP BY 1, 2, 3)
SELECT split, method, baseline, num_seeds, round(pm_mean, 5) AS pooled_method_rmse_mean, round(pm_std, 5) AS pooled_method_rmse_std, round(g_mean, 5) AS pooled_improvement_mean,
  round(g_std, 5) AS pooled_improvement_std, round(mg_mean, 5) AS macro_improvement_mean, seed_wins, fold_wins, num_folds, round(win, 5) AS mean_point_win_percent
FROM s JOIN f USING (split, method, baseline) JOIN p USING (split, method, baseline)""", ["points"])
def sta15(spark, sf_dir):
    seeds = R.per_seed_improvement(pooled_seed(spark, sf_dir), macro_seed(spark, sf_dir), "split", BASE2)
    folds = R.fold_comparison(S.fold_means(spark, sf_dir), "split", BASE2)
    points = R.point_comparison(point_pairs(spark, sf_dir), ["split", "random_seed"])
    return tidy(R.comparison_summary(seeds, folds, points, "split"), 5)


# Few-shot rows: the closed-form prediction shifted by the mean error of a scenario's anchors.
FRACTIONS, ANCHOR_SEEDS = (0.01, 0.05), (101, 202)


def _swept(spark, sf_dir) -> DataFrame:
    """Every point under every fraction and anchor seed, with the mark of the anchors."""
    rows = views.points(spark, sf_dir).select(
        "row_uid", "scenario", "config", F.col("pl_db").alias("target_pl_db"), (40.0 + 20.0 * F.log10("distance_m")).alias("raw"))
    bound = scan_rows(spark, sf_dir, "lineitem")
    parts = []
    for fraction in FRACTIONS:
        swept = rows.withColumn("anchor_seed", F.explode(F.array(*[F.lit(s) for s in ANCHOR_SEEDS]))).withColumn("anchor_fraction", F.lit(fraction))
        rank = hashing.stable_hash(F.lit("fewshot"), F.lit("fraction"), F.lit(repr(fraction)), "anchor_seed", "row_uid")
        parts.append(sampling.take_smallest(swept, ["scenario", "anchor_fraction", "anchor_seed"], sampling.fewshot_count("fraction", fraction, 0),
                                            rank, ("row_uid",), bound, mark="is_anchor", few_groups=True))
    return parts[0].unionByName(parts[1])


def fewshot_marked(spark, sf_dir) -> DataFrame:
    """Keys of few-shot predictions before the anchors are taken out."""
    return _swept(spark, sf_dir).withColumns({
        "fold": F.concat(F.lit("holdout_"), "scenario"), "method": F.lit("bias_calibrated_log_distance"), "model_seed": F.lit(11)})


def fewshot_predictions(spark, sf_dir) -> DataFrame:
    marked = _swept(spark, sf_dir)
    out = fits.bias_calibrated(marked.where("NOT is_anchor"), marked.where("is_anchor"), ["scenario", "anchor_fraction", "anchor_seed"], "raw", "target_pl_db")
    return out.select("row_uid", "scenario", "config", F.concat(F.lit("holdout_"), "scenario").alias("fold"), F.lit("bias_calibrated_log_distance").alias("method"),
                      "anchor_fraction", "anchor_seed", F.lit(11).alias("model_seed"), "target_pl_db", F.col("calibrated").alias("pred_pl_db"), "is_anchor")


def zero_shot(spark, sf_dir) -> DataFrame:
    return S.point_predictions(spark, sf_dir).where("method = 'log_distance'")


def _few_sql() -> str:
    parts = []
    for f in FRACTIONS:
        for s in ANCHOR_SEEDS:
            h = sq.hash_sql("'fewshot'", "'fraction'", f"'{f!r}'", f"'{s}'", "row_uid")
            parts.append(f"SELECT *, CAST({f} AS DOUBLE) AS anchor_fraction, {s} AS anchor_seed, rn <= least(greatest(1, CAST(round_even(n * CAST({f} AS DOUBLE), 0) AS BIGINT)), greatest(1, n - 1)) AS is_anchor "
                         f"FROM (SELECT row_uid, scenario, pl_db, 4e1 + 2e1 * log10(distance_m) AS raw, count(*) OVER (PARTITION BY scenario) AS n, "
                         f"row_number() OVER (PARTITION BY scenario ORDER BY {h}, row_uid) AS rn FROM points)")
    return ", marked AS (" + " UNION ALL ".join(parts) + """),
bias AS (SELECT scenario, anchor_fraction, anchor_seed, avg(pl_db - raw) AS bias FROM marked WHERE is_anchor GROUP BY 1, 2, 3),
few AS (SELECT m.row_uid, concat('holdout_', scenario) AS fold, anchor_fraction, anchor_seed, pl_db, raw + bias - pl_db AS ea, z.e AS eb FROM marked m JOIN bias USING (scenario, anchor_fraction, anchor_seed)
  LEFT JOIN (SELECT row_uid, fold, e FROM point_preds WHERE method = 'log_distance') z ON z.row_uid = m.row_uid WHERE NOT m.is_anchor)"""


FEW = S.POINT_PREDS + _few_sql()


@query("sta16_adaptation_gains", FEW + """, g AS (SELECT fold, anchor_fraction, anchor_seed, count(*) AS n, sqrt(avg(ea * ea)) AS ar, sqrt(avg(eb * eb)) AS br, avg(abs(ea)) AS am, avg(abs(eb)) AS bm,
  quantile_cont(abs(ea), 0.9) AS ap, quantile_cont(abs(eb), 0.9) AS bp, count(*) FILTER (abs(ea) < abs(eb)) AS aw, count(*) FILTER (abs(eb) < abs(ea)) AS bw FROM few GROUP BY 1, 2, 3)
SELECT fold, anchor_fraction, CAST(anchor_seed AS BIGINT) AS anchor_seed, round(ar, 5) AS adapted_rmse, round(am, 5) AS adapted_mae, round(ap, 5) AS adapted_p90_ae, round(br, 5) AS baseline_rmse,
  round(bm, 5) AS baseline_mae, round(bp, 5) AS baseline_p90_ae, n AS test_count, aw AS adapted_point_wins, bw AS baseline_point_wins, round(100 * (br - ar) / br, 4) AS rmse_improvement_percent,
  round(100 * (bm - am) / bm, 4) AS mae_improvement_percent, round(100 * (bp - ap) / bp, 4) AS p90_ae_improvement_percent, n - aw - bw AS ties, round(1e2 * aw / n, 5) AS adapted_point_win_percent FROM g""", ["points"])
def sta16(spark, sf_dir):
    matched = R.adaptation_pairs(fewshot_predictions(spark, sf_dir), zero_shot(spark, sf_dir), strict=True)
    out = R.adaptation_gains(matched, ["fold", "anchor_fraction", "anchor_seed"], scan_rows(spark, sf_dir, "lineitem"))
    return tidy(out, 5, rmse_improvement_percent=4, mae_improvement_percent=4, p90_ae_improvement_percent=4)


@query("sta17_adaptation_summary", FEW + """, ps AS (SELECT anchor_fraction, anchor_seed, sqrt(avg(ea * ea)) AS ar, sqrt(avg(eb * eb)) AS br, avg(abs(ea)) AS am FROM few GROUP BY 1, 2),
pf AS (SELECT anchor_fraction, fold, avg(a) AS a, avg(b) AS b FROM (SELECT anchor_fraction, anchor_seed, fold, sqrt(avg(ea * ea)) AS a, sqrt(avg(eb * eb)) AS b FROM few GROUP BY 1, 2, 3) GROUP BY 1, 2),
w AS (SELECT anchor_fraction, count(*) FILTER (a < b) AS scenario_rmse_wins, count(*) AS num_scenarios FROM pf GROUP BY 1)
SELECT anchor_fraction, round(avg(ar), 5) AS adapted_rmse_mean, round(stddev_samp(ar), 5) AS adapted_rmse_std, round(avg(br), 5) AS baseline_rmse_mean, round(avg(am), 5) AS adapted_mae_mean,
  round(avg(100 * (br - ar) / br), 4) AS rmse_improvement_mean_percent, round(stddev_samp(100 * (br - ar) / br), 4) AS rmse_improvement_std_percent, count(*) FILTER (ar < br) AS anchor_seed_rmse_wins,
  max(scenario_rmse_wins) AS scenario_rmse_wins, max(num_scenarios) AS num_scenarios FROM ps JOIN w USING (anchor_fraction) GROUP BY 1""", ["points"])
def sta17(spark, sf_dir):
    matched = R.adaptation_pairs(fewshot_predictions(spark, sf_dir), zero_shot(spark, sf_dir))
    return tidy(R.adaptation_summary(matched), 5, rmse_improvement_mean_percent=4, rmse_improvement_std_percent=4)


@query("sta18_seed_winner", """WITH s AS (SELECT task, sparse_seed, method, avg(rmse) AS rmse FROM run_metrics GROUP BY 1, 2, 3)
SELECT a.task, b.method AS baseline, count(*) AS seeds, count(*) FILTER (a.rmse < b.rmse) AS seed_wins, round(avg(100 * (b.rmse - a.rmse) / b.rmse), 5) AS mean_gain_percent
FROM s a JOIN s b USING (task, sparse_seed) WHERE a.method = 'residual_extra' AND b.method <> a.method GROUP BY 1, 2""", ["run_metrics"])
def sta18(spark, sf_dir):
    means = views.run_metrics(spark, sf_dir).groupBy("task", "sparse_seed", "method").agg(F.avg("rmse").alias("rmse"))
    return tidy(R.seed_winners(means, PRIMARY), 5)


@query("sta19_subgroup_counts", S.SUBGROUP + """SELECT task, transfer_condition, CAST(sparse_seed AS BIGINT) AS sparse_seed, count(*) AS maps FROM cond WHERE method = 'residual_extra' GROUP BY 1, 2, 3""", ["run_metrics"])
def sta19(spark, sf_dir):
    return tidy(conditioned(spark, sf_dir).where("method = 'residual_extra'").groupBy("task", "transfer_condition", "sparse_seed").agg(F.count(F.lit(1)).alias("maps")))


WIDE = """WITH m AS (SELECT method, task, avg(rmse) AS mean, stddev_samp(rmse) AS std FROM run_metrics GROUP BY 1, 2), b AS (SELECT *, min(mean) OVER (PARTITION BY task) AS best FROM m)"""


@query("sta20_wide_table", WIDE + " SELECT method, " + ", ".join(
    f"round(max(mean) FILTER (task = '{t}'), 6) AS {t}_mean, round(max(std) FILTER (task = '{t}'), 6) AS {t}_std, bool_or(mean - best <= 1e-12) FILTER (task = '{t}') AS {t}_is_best"
    for t in ("task2", "task3")) + " FROM b GROUP BY 1", ["run_metrics"])
def sta20(spark, sf_dir):
    means = views.run_metrics(spark, sf_dir).groupBy("method", "task").agg(F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("std"))
    return tidy(P.wide_table(means, "method", "task", ["task2", "task3"], "mean", "std"))


@query("sta21_unique_winner", WIDE + " SELECT task, min(method) AS winner, count(*) AS winners, round(min(mean), 6) AS best_value FROM b WHERE mean - best <= 1e-12 GROUP BY 1", ["run_metrics"])
def sta21(spark, sf_dir):
    means = views.run_metrics(spark, sf_dir).groupBy("method", "task").agg(F.avg("rmse").alias("mean"))
    return tidy(P.unique_winner(means, ["task"], "method", "mean"))


@query("sta22_stacked_sources", S.FOLD_ROWS + ", " + POOLED_SEED + """SELECT 'grouped_pooled' AS condition_id, method, round(avg(rmse), 6) AS rmse FROM pooled_seed GROUP BY 2
UNION ALL SELECT 'grouped_macro', method, round(avg(rmse), 6) FROM macro_seed GROUP BY 2 UNION ALL SELECT fold, method, round(avg(rmse), 6) FROM fold_rows GROUP BY 1, 2""", ["points"])
def sta22(spark, sf_dir):
    def mean(df):
        return df.groupBy("method").agg(F.avg("rmse").alias("rmse"))
    folds = S.fold_means(spark, sf_dir).groupBy("fold", "method").agg(F.avg("rmse").alias("rmse")).withColumnRenamed("fold", "condition_id")
    stacked = R.stack_sources({"grouped_pooled": mean(pooled_seed(spark, sf_dir)), "grouped_macro": mean(macro_seed(spark, sf_dir))})
    return tidy(stacked.unionByName(folds))


@query("sta23_headline_best", f"""WITH r AS (SELECT task, method, rmse_mean, rank() OVER (PARTITION BY task ORDER BY rmse_mean) AS rank FROM ({TASK_MEANS})),
s AS (SELECT task, sparse_seed, method, avg(rmse) AS rmse FROM run_metrics GROUP BY 1, 2, 3),
c AS (SELECT a.task, count(*) FILTER (a.rmse < b.rmse) AS seed_wins FROM s a JOIN s b USING (task, sparse_seed) WHERE a.method = 'residual_extra' AND b.method = 'direct_rf' GROUP BY 1)
SELECT task, method AS best_method, round(rmse_mean, 6) AS rmse_mean, seed_wins FROM r JOIN c USING (task) WHERE rank = 1""", ["run_metrics"])
def sta23(spark, sf_dir):
    runs = views.run_metrics(spark, sf_dir)
    ranks = P.ranked(runs.groupBy("task", "method").agg(F.avg("rmse").alias("rmse_mean")), ["task"], "rmse_mean")
    comparison = R.seed_winners(runs.groupBy("task", "sparse_seed", "method").agg(F.avg("rmse").alias("rmse")), PRIMARY).where(
        "baseline = 'direct_rf'").select("task", "seed_wins")
    return tidy(R.headline_best(ranks, comparison, ["task"]).drop("rank"))
