"""Counts along free segments, beside a walk over every ray cell, on rasters of several tiles."""

import random

from pyspark.sql import functions as F

from signalgrid.operators import rays


def test_segments_beside_ray_cells(spark):
    rnd = random.Random(9)
    cells = [(s, rnd.randrange(200), rnd.randrange(150), rnd.randint(0, 4)) for s in "ab" for _ in range(3000)]
    cells += cells[:50]  # cells that occur twice count twice
    segs = [(f"k{i}", rnd.choice(["a", "b", "none", None]), rnd.randrange(-20, 220), rnd.randrange(-20, 170), rnd.randrange(-20, 220), rnd.randrange(-20, 170)) for i in range(300)]
    segs += [("p", "a", 3, 3, 3, 3), ("null", "a", None, 1, 2, 3), ("gone", "a", None, None, 2, 3), *segs[:5]]
    c = spark.createDataFrame(cells, "sample_id string, x int, y int, material int")
    s = spark.createDataFrame(segs, "row_uid string, sample_id string, x0 int, y0 int, x1 int, y1 int")
    walls = c.where("material > 0").select("sample_id", F.col("x").alias("ray_x"), F.col("y").alias("ray_y"), "material")
    hit = rays.ray_cells(s).join(walls, ["sample_id", "ray_x", "ray_y"], "left")
    want = hit.groupBy("row_uid").agg(F.count("material").alias("wall_count"), (F.count("material") == 0).alias("los"),
                                      *[F.count(F.when(F.col("material") == m, 1)).alias(f"mat_{m}_count") for m in (1, 2, 3)])
    got = rays.segment_material_stats(s, c, ["row_uid"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.dtypes == want.dtypes


def test_segments_are_not_walked_as_rows(spark):
    s = spark.createDataFrame([("a", "a", 0, 0, 9, 9)], "row_uid string, sample_id string, x0 int, y0 int, x1 int, y1 int")
    c = spark.createDataFrame([("a", 1, 1, 1)], "sample_id string, x int, y int, material int")
    assert "ray_x" not in rays.segment_material_stats(s, c, ["row_uid"])._jdf.queryExecution().optimizedPlan().toString()
