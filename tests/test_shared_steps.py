"""Steps that several dense queries share: worked out once, and without merging where there is nothing to merge."""

import random

from signalgrid.operators import interpolation as interp
from signalgrid.operators import metrics as M
from signalgrid.queries import dense, intake
from signalgrid.plans import views

SF = "/root/testdata/sf0.001"


def test_one_block_a_key_needs_no_merging(spark):
    rnd = random.Random(2)
    places = [(k, y, x) for k in "abc" for y in range(9) for x in range(9)]
    asked = spark.createDataFrame([(*p, f"t{i}", float(i)) for i, p in enumerate(places)], "sample_id string, y int, x int, name string, value double")
    anchors = spark.createDataFrame([(*p, rnd.random()) for p in rnd.sample(places[:81], 20) + rnd.sample(places[81:162], 2)],
                                    "sample_id string, y int, x int, residual double")  # c has none, b has fewer than k
    merged, alone, looked = [interp.raster_idw(asked, anchors, ["residual"], ["sample_id"], k=4, alone=a) for a in (False, True, None)]
    want = sorted(map(str, merged.collect()))
    assert sorted(map(str, alone.collect())) == want and sorted(map(str, looked.collect())) == want
    assert alone.columns == merged.columns
    plans = [df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") for df in (merged, alone, looked)]
    assert plans[1] == plans[2] < plans[0]


def test_bound_is_the_largest_raster(spark):
    sizes = [r["count"] for r in views.cells(spark, SF).groupBy("sample_id").count().collect()]
    assert dense.bound(spark, SF) == max(sizes) < sum(sizes)


def test_labelled_maps_are_joined_once(spark):
    first, second = dense.maps(spark, SF), dense.maps(spark, SF)
    assert first.inputFiles() == second.inputFiles() and "base-maps" in first.inputFiles()[0]
    assert first.count() == views.cells(spark, SF).where("valid").count()


def test_point_results_score_a_table(spark, monkeypatch):
    read, score = [], M.error_metrics
    monkeypatch.setattr(M, "error_metrics", lambda df, *a, **k: (read.append(df), score(df, *a, **k))[1])
    assert intake.snk4(spark, SF).count() == 3
    assert len(read) == 2 and all("scored" in f for df in read for f in df.inputFiles())
