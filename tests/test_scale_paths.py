"""The plans for hot groups must give the rows of the one-task plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalgrid.functions.hashing import stable_hash
from signalgrid.operators import metrics, paired, sampling, splits
from signalgrid.operators.percentiles import exact_percentiles
from signalgrid.skew import fits_one_task


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, float(v), bool(i % 4 == 0)) for i, v in enumerate(rng.exponential(5.0, 4000))]
    rows += [("hot", 10000 + i, 2.5, False) for i in range(1500)] + [("one", 99999, 7.0, True)]
    return spark.createDataFrame(rows, "k string, id int, v double, flag boolean").cache()


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bound_rule():
    assert not fits_one_task(None) and fits_one_task(10, 10) and not fits_one_task(11, 10)


@pytest.mark.parametrize("mark", [None, "chosen"])
def test_take_smallest(skewed, mark):
    args = (["k"], sampling.sparse_count(0.13, 3), stable_hash("k", "id"), ("id",))
    small = sampling.take_smallest(skewed, *args, rows_bound=10_000, mark=mark)
    large = sampling.take_smallest(skewed, *args, rows_bound=None, max_group_rows=50, mark=mark)
    columns = [*skewed.columns, *([mark] if mark else [])]
    assert same(small.select(columns), large.select(columns))
    sizes = {r.k: (r.n, r.c) for r in skewed.groupBy("k").agg(F.count("*").alias("n"), F.lit(0).alias("c")).collect()}
    chosen = small.where(mark) if mark else small
    for r in chosen.groupBy("k").count().collect():
        n = sizes[r.k][0]
        assert r["count"] == min(n, max(3, int(np.ceil(n * 0.13))))


def test_dense_positions(skewed):
    out = sampling.dense_positions(skewed, ["k"], ["id"], "pos", None, 60)
    got = out.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    assert all(r.n == r.d and r.a == 0 and r.b == r.n - 1 for r in got)


def test_exact_percentiles_match_builtin(skewed):
    probs = {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(skewed, ["k"], "v", probs, max_group_rows=20).collect()}
    want = skewed.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()
    for r in want:
        for n in probs:
            assert getattr(got[r.k], n) == pytest.approx(getattr(r, n), abs=1e-12)


def test_error_metrics_both_ways(skewed):
    rows = skewed.withColumns({"pred": F.col("v"), "target": F.lit(1.0), "los": F.col("flag").cast("int"), "walls": F.col("id") % 4})
    args = dict(los="los", wall_count="walls", is_anchor="flag", wall="flag")
    small = metrics.error_metrics(rows, ["k"], rows_bound=10_000, **args)
    large = metrics.error_metrics(rows, ["k"], rows_bound=None, max_group_rows=30, **args).select(small.columns)
    a = {r.k: r.asDict() for r in small.collect()}
    for r in large.collect():
        assert r.asDict() == pytest.approx(a[r.k], abs=1e-9, nan_ok=True) or all(
            (x is None and y is None) or x == y or x == pytest.approx(y, abs=1e-9) for x, y in zip(r.asDict().values(), a[r.k].values(), strict=True))


def test_win_rates_both_ways(spark):
    rng = np.random.default_rng(4)
    rows = [("t", f"B{b}_Ant{1 + i % 3}_f1_S{i}", int(b), 1 + i % 3, 1, f"c{i % 2}", "base", "rmse", float(p), float(q), float(q - p), float(100 * (q - p) / q), True,
             "prim" if q > p else "baseline") for i, (b, p, q) in enumerate(zip(rng.integers(1, 4, 300), rng.random(300), rng.random(300) + 0.1))]
    df = spark.createDataFrame(rows, "task string, sample_id string, building int, antenna int, frequency int, transfer_condition string, baseline_method string,"
                               " metric string, primary_value double, baseline_value double, paired_difference double, improvement_percent double, valid_pair boolean, winner string")
    for fn in (paired.win_rates, paired.building_summary):
        a = fn(df, "prim", rows_bound=1000)
        b = fn(df, "prim", rows_bound=None, max_group_rows=20).select(a.columns)
        order = [c for c, t in a.dtypes if t in ("string", "int")]
        for x, y in zip(a.orderBy(*order).collect(), b.orderBy(*order).collect(), strict=True):
            assert all(p == q or p == pytest.approx(q, abs=1e-9) for p, q in zip(x, y, strict=True))


def test_random_fold_both_ways(skewed):
    rows = skewed.withColumn("uid", F.col("id").cast("string"))
    a = splits.random_fold(rows, "uid", 0.2, 5, 10_000).select("uid", "is_test")
    b = splits.random_fold(rows, "uid", 0.2, 5, None, 100).select("uid", "is_test")
    assert same(a, b)


def test_dense_positions_do_not_depend_on_the_plan(skewed):
    hot = sampling.dense_positions(skewed, ["k"], ["id"], "pos", None, 60).select("k", "id", "pos")
    small = sampling.dense_positions(skewed, ["k"], ["id"], "pos", 10**6, 10**6).select("k", "id", "pos")
    assert hot.exceptAll(small).isEmpty() and hot.count() == small.count()


def test_three_way_split_leaves_a_group_for_every_side(spark):
    from signalgrid.operators.splits import three_way_split

    manifest = spark.createDataFrame([(f"g{i}", f"s{i}") for i in range(4)], "scene_id string, sample_id string")
    sides = {r["side"] for r in three_way_split(manifest, "scene_id", 0.8, 0.2, 1).collect()}
    assert sides == {"train", "val", "test"}


def test_calibration_refuses_unknown_predictions():
    from signalgrid.operators import features

    assert features.calibration_allowed(["oracle_pred_db", "los", "mat_7_count", "anchor_residual_nn_2", "multi_wall_pred_db"]) == ["los", "mat_7_count", "multi_wall_pred_db"]


def test_runs_are_read_by_header(spark, tmp_path):
    from signalgrid.sources.runs import read_runs

    for run, text in (("run_0", "method,sparse_rate,rmse\nidw,0.01,3.5\n"), ("run_1", "sparse_rate,rmse,method\n0.05,2.5,rf\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.csv").write_text(text)
    got = {(r["source_run"], r["method"], r["sparse_rate"], r["rmse"]) for r in read_runs(spark, [str(tmp_path)]).collect()}
    assert got == {("run_0", "idw", 0.01, 3.5), ("run_1", "rf", 0.05, 2.5)}


def test_forest_scores_rows_with_missing_features(spark):
    from signalgrid.operators.learners import apply_random_forest, fit_random_forest

    rows = spark.createDataFrame([(float(i), None if i % 4 == 0 else float(i % 7), float(i)) for i in range(80)], "a double, b double, y double")
    model = fit_random_forest(rows, ["a", "b"], "y", 3, 3)
    out = apply_random_forest(model, rows, "p")
    assert out.count() == 80 and out.where("p IS NULL OR isnan(p)").count() == 0


def test_bootstrap_mean_does_not_depend_on_the_plan(skewed):
    hot = paired.bootstrap_mean_ci(skewed, ["k"], "v", ["id"], 20, rows_bound=None, max_group_rows=60)
    small = paired.bootstrap_mean_ci(skewed, ["k"], "v", ["id"], 20, rows_bound=10**6)
    a, b = ({r["k"]: r for r in df.collect()} for df in (hot, small.select(hot.columns)))
    assert a.keys() == b.keys() and all(x == y or x == pytest.approx(y, abs=1e-9) for k in a for x, y in zip(a[k], b[k], strict=True))


def test_bootstrap_draws_fall_evenly_on_all_blocks():
    import numpy as np

    from signalgrid.operators.bootstrap import block_draws, block_sums

    n, rows, replicates = 1_050, 100, np.arange(400)
    counts = np.stack([block_draws(7, k, n, replicates, rows) for k in range(11)])
    assert (counts.sum(axis=0) == n).all()
    share = np.array([100] * 10 + [50]) / n
    assert np.abs(counts.mean(axis=1) - n * share).max() < 5 * np.sqrt(n * 0.1 / 400)
    assert np.allclose(counts.var(axis=1), n * share * (1 - share), rtol=0.4)
    assert (block_draws(7, 3, n, np.arange(60), rows) == counts[3, :60]).all()

    # Every unit is drawn once a replicate on average, with the spread of a multinomial count.
    single = np.stack([block_sums(7, 2, n, [np.eye(100)[u]], 400, rows)[0] for u in range(100)])
    assert (single.sum(axis=0) == counts[2]).all()
    assert abs(single.mean() - 1) < 0.05 and abs(single.var() - 1) < 0.1
    assert np.abs(np.corrcoef(single[:, :40].T) - np.eye(40)).max() < 0.55
    assert (block_sums(7, 2, n, [np.arange(100.0)], 60, rows)[0] == block_sums(7, 2, n, [np.arange(100.0)], 400, rows)[0][:60]).all()


def test_bootstrap_over_blocks_agrees_with_theory_and_keeps_null_groups(spark):
    rows = spark.range(3_000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'big' END AS k", "CAST(id % 50 AS DOUBLE) AS v").unionByName(
        spark.createDataFrame([(9_001, "one", 4.0), (9_002, "big", float("nan")), (9_003, "big", float("inf")), (9_004, "none", None)], "id bigint, k string, v double"))
    got = {r["k"]: r for r in paired.bootstrap_mean_ci(rows, ["k"], "v", ["id"], 1000, block_rows=64).collect()}
    assert set(got) == {None, "big", "one"} and [got[k]["n"] for k in (None, "big", "one")] == [1000, 2000, 1]
    assert got["one"]["ci_low"] == got["one"]["ci_high"] == 4.0
    for k in (None, "big"):
        r, half = got[k], 1.96 * 14.43 / got[k]["n"] ** 0.5
        assert abs(r["bootstrap_mean"] - r["mean"]) < 0.1 * half
        assert r["mean"] - r["ci_low"] == pytest.approx(half, rel=0.12) and r["ci_high"] - r["mean"] == pytest.approx(half, rel=0.12)
    again = {r["k"]: r for r in paired.bootstrap_mean_ci(rows.repartition(5), ["k"], "v", ["id"], 1000, block_rows=64, max_group_rows=90).collect()}
    assert all(again[k]["ci_low"] == pytest.approx(got[k]["ci_low"], abs=1e-9) for k in got)


def test_position_rows_do_not_carry_their_file(spark):
    from signalgrid.sources import rasters

    files = spark.createDataFrame([("Positions_B2_Ant3_f1.csv", "Id,Y,X\r\n\n7,1.5,2\n8,,x\n"), ("Positions_B1_Ant1_f2.csv", "X,Y\n"), ("Positions_B1_Ant1_f3.csv", None)],
                                  "file_name string, value string")
    out = rasters.positions(files)
    assert [tuple(r) for r in out.orderBy("sample_index").collect()] == [(2, 3, 1, 0, 1.5, 2.0), (2, 3, 1, 1, None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(value" not in plan[:plan.index("Generate")]
