"""Hot groups are answered without putting a group into one task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalgrid.operators import interpolation, sampling
from signalgrid.skew import split_hot


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    # Two groups and the null group; every row stands twice, so quotas end among rows that are alike.
    base = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 < 8, "a").otherwise("b").alias("k"), F.col("id").alias("u"))
    return base.unionByName(base)


def test_quota_without_shuffle(spark, rows):
    args = (["k"], lambda n: F.floor(n / 7).cast("bigint"), F.pmod(F.col("u") * 7919, F.lit(2**32)), ("u",))
    small = sampling.take_smallest(rows, *args, rows_bound=10_000, mark="m")
    large = sampling.take_smallest(rows, *args, max_group_rows=50, mark="m", few_groups=True)
    count = lambda df: {(r["k"], r["u"]): r["n"] for r in df.where("m").groupBy("k", "u").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count(large) == count(small) and large.count() == 6000
    assert any(n == 1 for n in count(large).values())
    single = sampling.take_smallest(rows.distinct(), *args, max_group_rows=50, mark="m", few_groups=True)
    whole = sampling.take_smallest(spark.range(10**4).withColumn("k", F.lit(1)).withColumnRenamed("id", "u"), *args, max_group_rows=50, mark="m", few_groups=True)
    assert "Exchange hashpartitioning" not in plan(whole) and "Window" not in plan(whole) and single.count() == 3000


def test_hot_rows_stay(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cold, hot = split_hot(rows, ["k"], None, 1500)
        assert "SortMergeJoin" not in plan(cold) + plan(hot) and hot.count() == 4200 and cold.count() == 1800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_are_answered_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, f"k{i % 2}", float(rng.integers(0, 5)), float(rng.integers(0, 4)) / 10, float(rng.normal()), bool(i % 3 == 0)) for i in range(600)]
    points = spark.createDataFrame(data, "u bigint, k string, rx_x double, rx_y double, v double, a boolean")
    seen, real = [], interpolation.anchor_features

    def counted(queries, anchors, *args, **kw):
        seen.append((queries.count(), anchors.count()))
        return real(queries, anchors, *args, **kw)

    monkeypatch.setattr(interpolation, "anchor_features", counted)
    got = {r["u"]: r["idw_v"] for r in interpolation.point_idw(points.where("NOT a").drop("a"), points.where("a"), ["k"], value="v").collect()}
    assert max(seen[0]) <= 40  # 2 groups x 20 places
    for u, k, x, y, _, anchor in data:
        if not anchor:
            near = [((math.hypot(x - p[2], y - p[3]) + 1e-6) ** -2, p[4]) for p in data if p[5] and p[1] == k]
            assert math.isclose(got[u], sum(w * v for w, v in near) / sum(w for w, _ in near), rel_tol=1e-9)


def test_fold_means_need_one_aggregation(spark, monkeypatch):
    from signalgrid.queries import load_all, scores

    monkeypatch.setattr(scores, "scan_rows", lambda *a: None)  # no proof that a fold is small
    for name in ("met16_best_method", "sta11_rankings_union", "sta13_fold_comparison", "sta13_key_problems", "sta15_comparison_summary", "sta22_stacked_sources"):
        shown = load_all()[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in shown and "LeftAnti" not in shown


def test_adaptation_summary_reads_pairs_once(spark):
    from signalgrid.operators import reports

    pairs = spark.range(40).select(
        F.lit(0.01).alias("anchor_fraction"), (F.col("id") % 2).alias("anchor_seed"), (F.col("id") % 5).cast("string").alias("fold"),
        F.lit(1.0).alias("target_pl_db"), (F.col("id") * 1.0).alias("pred_pl_db"), (F.col("id") * 2.0).alias("baseline_pred_pl_db"))
    out = reports.adaptation_summary(pairs)
    assert out.first()["num_scenarios"] == 5
    errors = [[(i - 1.0) ** 2 for i in range(s, 40, 2)] for s in (0, 1)]
    assert math.isclose(out.first()["adapted_rmse_mean"], sum(math.sqrt(sum(e) / 20) for e in errors) / 2)
    assert "Range (" not in plan(out)  # what is read twice are the sums
