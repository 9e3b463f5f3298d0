"""Strict calls end at the first broken rule; the frames of violations list every one."""

import pytest

from signalgrid.operators import contracts, paired as P, reports as R


@pytest.fixture(scope="module")
def averaged(spark):
    rows = [("t", s, m, 1.0 + len(m), n) for s, m, n in (
        ("a", "p", 3), ("a", "b", 3), ("b", "p", 3), ("b", "b", 2), ("c", "p", 3), ("d", "b", 3), (None, "p", 3), (None, "b", 3))]
    return spark.createDataFrame(rows, "task string, sample_id string, method string, rmse double, num_seeds int")


KEYS = ["task", "sample_id"]


def test_pairs(averaged):
    found = {(r["sample_id"], r["problem"]) for r in P.unmatched_maps(averaged, "p", ["b"], KEYS).collect()}
    assert found == {("c", "missing_right"), ("d", "missing_left")}
    whole = averaged.where("sample_id is null or sample_id in ('a', 'b')")
    strict = P.paired_comparisons(whole, "p", ["b"], ["rmse"], KEYS, strict=True)
    assert strict.count() == 3 and P.paired_comparisons(averaged, "p", ["b"], ["rmse"], KEYS).count() == 2  # null ids match only in the strict call
    with pytest.raises(Exception, match="maps of both methods differ.*sample_id=[cd]"):
        P.paired_comparisons(averaged, "p", ["b"], ["rmse"], KEYS, strict=True).collect()


def test_seeds(spark, averaged):
    assert [r["sample_id"] for r in P.incomplete_seeds(averaged).collect()] == ["b"]
    runs = spark.createDataFrame([("a", "p", 1.0, s) for s in (1, 2, 3)] + [("b", "p", 2.0, 1)] * 2, "sample_id string, method string, rmse double, sparse_seed int")
    assert P.seed_averaged(runs.where("sample_id = 'a'"), ["p"], ["rmse"], ["sample_id"], expected_seeds=3).count() == 1
    with pytest.raises(Exception, match="not 3 seeds: sample_id=b, method=p"):
        P.seed_averaged(runs, ["p"], ["rmse"], ["sample_id"], expected_seeds=3).collect()


def test_repeated_and_missing_keys(spark):
    folds = spark.createDataFrame([(1, "m"), (1, "b"), (2, "m"), (2, "m"), (2, "b"), (3, "b"), (4, "m")], "fold int, method string")
    got = {(r["fold"], r["method"], r["left_rows"], r["right_rows"], r["problem"]) for r in R.side_problems(folds, ["fold"], ["b"]).collect()}
    assert got == {(2, "m", 2, 1, "repeated"), (3, "m", 0, 1, "missing_left"), (4, "m", 1, 0, "missing_right")}


def test_targets_and_matches(spark):
    pairs = spark.createDataFrame([(1, "m", "b", 1.0, 2.0, 5.0, 5.0), (1, "m", "b", 1.0, 2.0, 5.0, 6.0)],
                                  "k int, method string, baseline string, method_pred_pl_db double, baseline_pred_pl_db double, method_target_pl_db double, baseline_target_pl_db double")
    assert R.target_mismatches(pairs).count() == 1 and R.point_comparison(pairs, ["k"]).count() == 1
    with pytest.raises(Exception, match="same target: k=1"):
        R.point_comparison(pairs, ["k"], strict=True).collect()
    few = spark.createDataFrame([("u", "f", 1.0, 1.0), ("v", "f", 1.0, 2.0)], "row_uid string, fold string, target_pl_db double, pred_pl_db double")
    zero = few.where("row_uid = 'u'")
    loose = R.adaptation_pairs(few, zero)
    assert loose.count() == 2 and [r["row_uid"] for r in R.unmatched_adaptations(loose).collect()] == ["v"]
    with pytest.raises(Exception, match="zero-shot match with its target: row_uid=v"):
        R.adaptation_pairs(few, zero, strict=True).collect()
    assert R.adaptation_pairs(zero, few, strict=True).count() == 1


def test_require_keeps_rows(spark):
    rows = spark.range(3)
    assert contracts.require(rows, rows["id"] >= 0, "never", ["id"]).count() == 3


def test_fixed_split(spark):
    from signalgrid.operators import splits

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "scene string, i int")

    def listed(*pairs):
        return spark.createDataFrame(list(pairs), "scene string, side string")
    whole = listed(("a", "train"), ("b", "val"), ("c", "train"))
    assert {(r["i"], r["side"]) for r in splits.fixed_split(rows, "scene", whole).collect()} == {(1, "train"), (2, "train"), (3, "val"), (4, "train")}
    for extra, name in (([("c", "val")], "c"), ([("z", "val")], "z"), ([("a", "train")], "a")):
        with pytest.raises(Exception, match=f"every group once: _group={name}"):
            splits.fixed_split(rows, "scene", whole.unionByName(listed(*extra))).collect()
    with pytest.raises(Exception, match="every group once: _group=c"):
        splits.fixed_split(rows, "scene", whole.where("scene <> 'c'")).collect()
    with pytest.raises(ValueError, match="both sides"):
        splits.fixed_split(rows, "scene", whole.where("side = 'train'"))


def test_groups_without_anchors_keep_a_row(spark):
    from signalgrid.operators import fits

    anchors = spark.createDataFrame([("a", 0.0, 1.0, 50.0), ("a", 1.0, 0.0, 70.0), ("a", 2.0, 2.0, 90.0), ("b", 1.0, 0.0, 64.0), (None, 1.0, 0.0, 8.0)], "k string, log_d double, w double, path_loss double")
    groups = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    line = {r["k"]: r for r in fits.log_distance_fits(anchors, ["k"], groups=groups).collect()}
    assert [(line[k]["anchor_count"], line[k]["slope"] > 0, line[k]["intercept"], line[k]["design_rank"]) for k in ("b", "c", None)] == [
        (1, False, 64.0, 0), (0, False, 0.0, 0), (1, False, 8.0, 0)]
    assert line["c"]["status"] == "log_distance_fallback_anchor_mean" and line["a"]["slope"] == pytest.approx(20, abs=1e-4)
    walls = {r["k"]: r for r in fits.multi_wall_fits(anchors, ["k"], ["w"], groups=groups).collect()}
    assert walls["c"]["status"] == "multi_wall_fallback_log_distance" and (walls["c"]["coef"], walls["c"]["intercept"], walls["c"]["anchor_count"]) == ([0.0, 0.0], 0.0, 0)
    assert walls["a"]["status"] == "multi_wall" and len(walls) == 4 and fits.multi_wall_fits(anchors, ["k"], ["w"]).count() == 3


def test_images_of_different_shapes_end_the_job(spark):
    from signalgrid.sources import rasters

    def image(name, height, width, channels, data):
        return (f"/x/{name}.png", height, width, channels, bytearray(data))

    def frame(*rows):
        flat = spark.createDataFrame(list(rows), "origin string, height int, width int, nChannels int, data binary")
        return flat.selectExpr("named_struct('origin', origin, 'height', height, 'width', width, 'nChannels', nChannels, 'data', data) AS image")
    good = image("s", 1, 2, 3, [1, 2, 3, 4, 5, 6])
    cells = rasters.image_cells(frame(good), frame(image("s", 1, 2, 1, [7, 8]))).orderBy("x").collect()
    assert [(r["distance_img"], r["transmittance"], r["reflectance"], r["path_loss"]) for r in cells] == [(1, 2, 3, 7), (4, 5, 6, 8)]
    with pytest.raises(Exception, match="images of different shapes: s has 1 x 2 and 2 x 1"):
        rasters.image_cells(frame(good), frame(image("s", 2, 1, 1, [7, 8]))).collect()
