import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalgrid.operators import features as FT
from signalgrid.operators import fits, interpolation as interp, learners, metrics, paired, splits, trees


def test_slope_recovery(spark):
    d = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame([(x, 40 + 20 * math.log10(x)) for x in d], "d double, y double")
    r = fits.free_log_distance_fit(df, "d", "y", alpha=0.0).first()
    assert r.slope_db_per_decade == pytest.approx(20.0) and r.reference_db == pytest.approx(40.0)


def test_single_anchor_is_constant(spark):
    df = spark.createDataFrame([("a", 1.0, 50.0)], "k string, log_d double, path_loss double")
    r = fits.log_distance_fits(df, ["k"]).first()
    assert (r.status, r.slope, r.intercept, r.design_rank) == ("log_distance_fallback_anchor_mean", 0.0, 50.0, 0)


def test_multi_wall_matches_closed_form_and_falls_back(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.random(40), rng.integers(0, 4, 40), np.ones(40)])
    y = 30 + x @ np.array([25.0, 4.0, 0.0]) + rng.normal(0, 1, 40)
    rows = [("full", *map(float, r), float(t)) for r, t in zip(x, y)] + [("few", 1.0, 0.0, 0.0, 50.0), ("few", 2.0, 1.0, 0.0, 60.0)]
    df = spark.createDataFrame(rows, "k string, log_d double, m1 double, m2 double, path_loss double")
    got = {r.k: r for r in fits.multi_wall_fits(df, ["k"], ["m1", "m2"]).collect()}
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 1e-6 * np.eye(3), c.T @ (y - y.mean()))
    assert got["full"].coef == pytest.approx(want, abs=1e-6)
    assert got["full"].intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-6)
    assert got["full"].design_rank == np.linalg.matrix_rank(x)
    assert got["few"].status == "multi_wall_fallback_log_distance" and got["few"].design_rank == 1
    assert got["few"].coef == pytest.approx([10.0, 0.0, 0.0], abs=1e-4)


def test_idw_hits_and_between(spark):
    anchors = spark.createDataFrame([("s", 0.1, 1, 0, 0, 10.0), ("s", 0.1, 1, 0, 2, 20.0)], "sample_id string, rate double, seed int, y int, x int, v double")
    q = spark.createDataFrame([("s", 0.1, 1, 0, x) for x in range(4)] + [("t", 0.1, 1, 0, 0)], "sample_id string, rate double, seed int, y int, x int")
    got = {(r.sample_id, r.x): r for r in interp.raster_idw(q, anchors, ["v"], k=3).collect()}
    assert got[("s", 0)].idw_v == 10.0 and got[("s", 0)].exact_hit
    assert 10.0 < got[("s", 1)].idw_v < 20.0
    assert got[("t", 0)].idw_v is None
    padded = {(r.sample_id, r.x): r for r in interp.pad_neighbours(interp.raster_idw(q, anchors, ["v"], k=3), ["sample_id"], 3).collect()}
    assert (padded[("s", 0)].nn_dist_3, padded[("s", 0)].nn_value_3) == (4.0, 0.0)  # largest distance is 3
    assert (padded[("t", 0)].nn_dist_1, padded[("t", 0)].nn_value_1) == (0.0, 0.0)


def test_neighbours_against_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    cells = rng.permutation(200 * 200)[:1500]
    a, q = cells[:500], cells[500:]
    anchors = spark.createDataFrame([("s", 0.1, 1, int(c // 200), int(c % 200), float(i)) for i, c in enumerate(a)], "sample_id string, rate double, seed int, y int, x int, v double")
    queries = spark.createDataFrame([("s", 0.1, 1, int(c // 200), int(c % 200)) for c in q], "sample_id string, rate double, seed int, y int, x int")
    out = interp.anchor_features(queries, anchors, ["sample_id", "rate", "seed"], ("y", "x"), ["v"], interp.raster_tiles(16), interp.raster_tiles(25), k=4).collect()
    assert len(out) == 1000
    ay, ax, v = a // 200, a % 200, np.arange(500.0)
    for r in out:
        d2 = (ay - r.y) ** 2 + (ax - r.x) ** 2
        order = np.lexsort((ax, ay, d2))[:4]
        assert [getattr(r, f"nn_value_{i}") for i in range(1, 5)] == list(v[order])
        w = 1 / np.maximum(d2, 1e-12)
        assert r.idw_v == pytest.approx((w * v).sum() / w.sum())


def frame(spark, rows):
    return spark.createDataFrame(rows, "pred double, target double, los int, anchor boolean, wall boolean, walls int").withColumn("k", F.lit(1))


def score(spark, rows, **kw):
    return metrics.error_metrics(frame(spark, rows), ["k"], rows_bound=100, **kw).first()


def test_core_metrics(spark):
    r = score(spark, [(float(i), 0.0, 1, False, False, 0) for i in (1, 2, 3, 4)])
    assert (r.mae, r.rmse) == (2.5, pytest.approx(math.sqrt(7.5)))
    assert r.p90_ae == pytest.approx(np.percentile([1, 2, 3, 4], 90)) and r.p95_ae == pytest.approx(np.percentile([1, 2, 3, 4], 95))
    one = score(spark, [(1.0, 0.0, 1, False, False, 0), (float("nan"), 0.0, 1, False, False, 0), (1.0, float("inf"), 1, False, False, 0)])
    assert one["count"] == 1 and one.std_error_db is None


def test_regions(spark):
    rows = [(0.0, 0.0, 1, True, True, 0)] * 2 + [(2.0, 0.0, 0, False, False, 3)] * 6
    r = score(spark, rows, los="los", is_anchor="anchor", wall="wall", wall_count="walls", clip_max_db=160.0, clip_min_db=0.0)
    assert r.los_rmse is None and r.nlos_rmse == 2.0
    assert r.non_anchor_rmse == 2.0 and r.rmse == pytest.approx(math.sqrt(3))
    assert (r.wall_region_rmse, r.free_space_rmse, r.high_wall_rmse, r.clipped_pixel_fraction) == (0.0, 2.0, 2.0, 1.0)


def test_keys_without_a_finite_target(spark):
    rows = [("full", 1.0, 0.0, 1, False, False, 0)] * 6 + [("empty", 1.0, None, 1, False, False, 3)] * 6 + [("empty", 1.0, float("nan"), 0, True, True, 0)] * 6
    df = spark.createDataFrame(rows, "k string, pred double, target double, los int, anchor boolean, wall boolean, walls int")
    args = dict(los="los", is_anchor="anchor", wall="wall", wall_count="walls", clip_max_db=160.0, clip_min_db=0.0)
    for how in (dict(rows_bound=100), dict(max_group_rows=5)):
        got = {r.k: r.asDict() for r in metrics.error_metrics(df, ["k"], **how, **args).collect()}
        assert got["full"]["rmse"] == got["full"]["los_rmse"] == got["full"]["clipped_pixel_fraction"] == 1.0 and got["full"]["count"] == 6
        assert all(v == (0 if n.endswith("count") else None) for n, v in got["empty"].items() if n != "k")


def test_group_kfold_keeps_points_without_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "g string, v int")
    got = {r.v: r.fold for r in splits.group_kfold(df, "g", 3).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1] == got[2] and len(set(got.values())) == 3


def test_spread_of_single_row_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), (None, 5.0)], "k string, v double")
    got = {r.k: r for r in metrics.mean_std(df, ["k"], ["v"]).collect()}
    assert (got["a"].v_std, got["b"].v, got[None].num_rows) == (0.0, 3.0, 1)


@pytest.mark.parametrize("p,n,expected", [(5, 0, 0.0625), (4, 1, 0.375), (0, 0, None), (3, 3, 1.0)])
def test_sign_test(spark, p, n, expected):
    assert spark.range(1).select(paired.sign_test(F.lit(p), F.lit(n)).alias("v")).first().v == expected


def test_feature_lists():
    names = FT.feature_names()
    assert len(names) == 27
    assert not [n for n in FT.geometry_only(names) if "pred" in n or "residual" in n]
    assert "multi_wall_pred_db" in FT.sparse_anchor_allowed(names) and "anchor_residual_idw" not in FT.sparse_anchor_allowed(names)
    assert "multi_wall_residual_idw_pred_db" in FT.calibration_allowed(names) and not [n for n in FT.calibration_allowed(names) if n.startswith("anchor_residual")]
    assert {FT.group_of(n) for n in names} == set(FT.GROUPS) and FT.group_of("new_thing") == "other"
    assert sorted(c for g in FT.GROUPS for c in FT.in_groups(names, [g])) == sorted(names)


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(9)
    x = rng.random((400, 3))
    rows = [(i, *map(float, r), float(10 * (r[0] > 0.5) + r[1]), i % 2) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y double, m int").cache()
    model = trees.fit_extra_trees(df, ["a", "b", "c"], "y", n_trees=6, max_depth=7, min_leaf=2, seed=3, model="m", allowed=[["a", "b", "c"], ["b", "c"]])
    return df, model


def test_trees_partition_rows_and_respect_leaf_size(grown):
    df, model = grown
    nodes = model.nodes.toPandas()
    leaves = nodes[nodes.feature.isna()]
    assert (leaves.groupby("tree").n.sum() == 200).all() and (leaves.n >= 2).all()
    assert set(nodes[nodes.tree >= 6].feature.dropna()) <= {1, 2}


def test_tree_predictions_agree_and_learn(grown):
    df, model = grown
    a = trees.predict_extra_trees(model, df, ["id"], "p", "m")
    b = trees.predict_extra_trees(model, df, ["id"], "p", "m", sent_bytes=1)
    pa, pb = {r.id: r.p for r in a.collect()}, {r.id: r.p for r in b.collect()}
    assert pa == pytest.approx(pb)
    err = a.where("m = 0").select(F.avg(F.abs(F.col("p") - F.col("y"))).alias("e")).first().e
    assert err < 1.0


def test_trees_are_reproducible(spark, grown):
    df, model = grown
    again = trees.fit_extra_trees(df.repartition(5), ["a", "b", "c"], "y", n_trees=6, max_depth=7, min_leaf=2, seed=3, model="m", allowed=[["a", "b", "c"], ["b", "c"]])
    key = ["tree", "node", "feature", "n"]
    assert sorted(map(tuple, model.nodes.select(key).collect()), key=str) == sorted(map(tuple, again.nodes.select(key).collect()), key=str)


@pytest.mark.parametrize("local_rows", [3, 20, 150])
def test_passes_over_levels_grow_the_same_trees(spark, grown, local_rows):
    df, model = grown
    allowed = [["a", "b", "c"], ["b", "c"]]
    levels = trees.fit_extra_trees(df.repartition(6), ["a", "b", "c"], "y", n_trees=6, max_depth=7, min_leaf=2, seed=3, model="m", allowed=allowed, local_rows=local_rows)
    shown = lambda t: sorted((r.tree, r.node, r.feature, r.n, r.threshold and round(r.threshold, 9), round(r.value, 9), r.gain and round(r.gain, 6)) for r in t.nodes.collect())
    assert str(shown(levels)) == str(shown(model))


def test_trees_with_missing_features_and_single_values(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 7), None, float(i % 5), 1.0 if i < 50 else float(i % 4), None if i == 9 else i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y double, y2 int")
    one, two = (trees.fit_extra_trees(df, ["a", "b", "c"], "y", n_trees=4, max_depth=5, seed=1, local_rows=n) for n in (1000, 10))
    key = lambda t: sorted((r.tree, r.node, str(r.feature), r.n, round(r.value, 9)) for r in t.nodes.collect())
    assert key(one) == key(two) and {r.feature for r in one.nodes.collect()} <= {None, 0, 2}
    assert trees.predict_extra_trees(one, df, ["id"]).where("prediction is null").count() == 0
    flat = trees.fit_extra_trees(df.withColumn("y", F.lit(2.0)), ["a", "c"], "y", n_trees=2, max_depth=3, local_rows=10)
    assert [(r.node, r.n, r.value) for r in flat.nodes.collect()] == [(1, 120, 2.0)] * 2
    empty = trees.fit_extra_trees(df.limit(0), ["a"], "y", n_trees=2, max_depth=3)
    assert empty.nodes.count() == 0


def test_two_levels_against_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, r)) for r in np.column_stack([rng.random((60, 2)), rng.random(60)])]
    got = trees.fit_extra_trees(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y", n_trees=3, max_depth=2, min_leaf=2, seed=5)

    def expect(tree, node, part, depth):
        y = [r[2] for r in part]
        mean, best = sum(y) / len(y), None
        if depth < 2 and len(part) >= 4 and min(y) < max(y):
            for f, name in enumerate("ab"):
                lo, hi = min(r[f] for r in part), max(r[f] for r in part)
                cut = lo + float(trees.draws(5, tree, np.array([node]), trees.feature_codes([name]))[0, 0]) * (hi - lo)
                left = [r[2] - mean for r in part if r[f] <= cut]
                if lo < hi and 2 <= len(left) <= len(part) - 2:
                    gain = sum(left) ** 2 / len(left) + sum(left) ** 2 / (len(part) - len(left))
                    if best is None or gain > best[0]:
                        best = (gain, f, cut)
        out = [(tree, node, len(part), round(mean, 9), best and best[1], best and round(best[2], 9), best and round(best[0], 9))]
        if best:
            for side in (0, 1):
                out += expect(tree, 2 * node + side, [r for r in part if (r[best[1]] > best[2]) == bool(side)], depth + 1)
        return out

    want = sorted(x for t in range(3) for x in expect(t, 1, rows, 0))
    assert sorted((r.tree, r.node, r.n, round(r.value, 9), r.feature, r.threshold and round(r.threshold, 9), r.gain and round(r.gain, 9)) for r in got.nodes.collect()) == want


def test_model_round_trip(spark, grown, tmp_path):
    df, model = grown
    model.save(str(tmp_path / "m"))
    loaded = trees.ExtraTrees.load(spark, str(tmp_path / "m"))
    assert loaded.features == model.features and loaded.nodes.count() == model.nodes.count()


def test_composition(spark):
    method = learners.dense_methods()["residual_extra"]
    df = spark.createDataFrame([(50.0, 1.5)], "multi_wall_pred_db double, out double")
    assert learners.compose(df, method, "out").first().pred == 51.5


def test_models_grown_together_do_not_change_each_other(spark, grown):
    df, model = grown
    # Ties go to the earlier feature, so the order of a model's own features is kept.
    alone = trees.fit_extra_trees(df.where("m = 1"), ["b", "c"], "y", n_trees=6, max_depth=7, min_leaf=2, seed=3)
    key = ["tree", "node", "n", "threshold"]
    together = model.nodes.where("tree >= 6").withColumn("tree", F.col("tree") - 6).select(key).collect()
    a, b = ({(r.tree, r.node): (r.n, r.threshold and round(r.threshold, 9)) for r in rows} for rows in (together, alone.nodes.select(key).collect()))
    assert a == b


def test_seed_of_each_model_counts(spark, grown):
    df, _ = grown
    two = trees.fit_extra_trees(df.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))), ["a", "b"], "y", n_trees=2, max_depth=2, seed=[3, 4], model="m")
    roots = [r.threshold for r in two.nodes.where("node = 1").orderBy("tree").collect()]
    assert len(set(roots)) == 4
