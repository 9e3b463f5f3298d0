import numpy as np
import pytest
from pyspark.sql import functions as F

from signalgrid.functions import pathloss as pl
from signalgrid.operators import rays

CELL_SCHEMA = ("sample_id string, scene_id string, y int, x int, height int, width int, tx_x double, tx_y double, frequency_hz double,"
               " resolution_m double, path_loss double, valid boolean, wall boolean, material int, transmittance double, reflectance double")


def step_line(x0, y0, x1, y1):
    """Reference digital line by error stepping."""
    out, dx, dy = [], abs(x1 - x0), -abs(y1 - y0)
    sx, sy, err = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1), abs(x1 - x0) - abs(y1 - y0)
    while True:
        out.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        twice = 2 * err
        if twice >= dy:
            err, x0 = err + dy, x0 + sx
        if twice <= dx:
            err, y0 = err + dx, y0 + sy


def raster(spark, material, tx, sample="s", res=0.25, trans=None):
    h, w = material.shape
    rows = [(sample, "B", y, x, h, w, float(tx[0]), float(tx[1]), 3.5e9, res, float(40 + x + y), True, bool(material[y, x] > 0), int(material[y, x]),
             None if trans is None else float(trans[y, x]), None) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, CELL_SCHEMA)


def test_ray_cells_match_stepping(spark):
    pairs = [(0, 0, x, y) for x in range(-12, 13) for y in range(-12, 13)] + [(3, -2, 8, 5), (7, 7, 7, 7)]
    df = spark.createDataFrame(pairs, "x0 int, y0 int, x1 int, y1 int")
    got = rays.ray_cells(df).orderBy("x0", "y0", "x1", "y1", "step").collect()
    found = {}
    for r in got:
        found.setdefault((r.x0, r.y0, r.x1, r.y1), []).append((r.ray_x, r.ray_y))
    assert all(found[p] == step_line(*p) for p in pairs)
    assert len(found[(0, 0, 5, 5)]) == 6


def test_wall_column(spark):
    m = np.zeros((8, 8), int)
    m[:, 4] = 1
    got = {(r.y, r.x): r for r in rays.ray_base_maps(raster(spark, m, (1, 1))).collect()}
    assert got[(1, 6)].wall_count > 0 and got[(1, 6)].los == 0
    assert got[(1, 2)].los == 1
    assert got[(1, 1)].distance_m == 0.25


@pytest.mark.parametrize("tile", [16, 64])
def test_large_raster_over_tiles(spark, tile):
    rng = np.random.default_rng(3)
    m = rng.choice([0, 0, 0, 0, 1, 2, 3], size=(70, 90))
    t = rng.random((70, 90))
    got = rays.ray_base_maps(raster(spark, m, (61.4, 20.5), trans=t), tile=tile).collect()
    assert len(got) == m.size
    for r in [got[i] for i in rng.choice(len(got), 300, replace=False)]:
        line = step_line(61, 20, r.x, r.y)  # 20.5 rounds half to even
        assert r.wall_count == sum(m[y, x] > 0 for x, y in line)
        assert (r.mat_1_count, r.mat_3_count) == tuple(sum(m[y, x] == k for x, y in line) for k in (1, 3))
        assert r.transmittance_sum == pytest.approx(sum(t[y, x] for x, y in line))
        assert r.wall_fraction == pytest.approx(r.wall_count / len(line))


def test_transmitter_outside_is_clipped_for_rays_only(spark):
    m = np.zeros((5, 5), int)
    got = {(r.y, r.x): r for r in rays.ray_base_maps(raster(spark, m, (-3.0, 2.0), res=1.0)).collect()}
    assert got[(2, 0)].distance_m == 3.0
    assert got[(2, 4)].wall_fraction == 0.0


def test_segment_stats(spark):
    m = np.zeros((8, 8), int)
    m[:, 4] = 2
    segs = spark.createDataFrame([("s", 1, 0, 3, 7, 3), ("s", 2, 0, 0, 3, 3)], "sample_id string, id int, x0 int, y0 int, x1 int, y1 int")
    got = {r.id: r for r in rays.segment_material_stats(segs, raster(spark, m, (0, 0)), ["id"]).collect()}
    assert (got[1].wall_count, got[1].los, got[1].mat_2_count) == (1, False, 1)
    assert (got[2].wall_count, got[2].los) == (0, True)


def test_free_space_loss(spark):
    row = spark.range(1).select(pl.fspl_db(F.lit(1.0), F.lit(1e9)).alias("v")).first()
    assert 32 < row.v < 33


@pytest.mark.parametrize("value,size,expected", [(-3.0, 180, 0.0), (165.0, 219, 165.0), (468.0, 464, 463.0), (-6.0, 100, None), (99.0, 100, 99.0)])
def test_snap(spark, value, size, expected):
    assert spark.range(1).select(pl.snap_to_edge(F.lit(value), F.lit(size)).alias("v")).first().v == expected


def test_kernel_batches_do_not_matter(spark):
    rng = np.random.default_rng(5)
    cells = raster(spark, rng.choice([0, 0, 1], size=(30, 30)), (4, 5), "a").union(raster(spark, rng.choice([0, 0, 1], size=(30, 30)), (20, 5), "b"))
    one = rays.ray_base_maps(cells.coalesce(1), tile=8).select("sample_id", "y", "x", "wall_count")
    many = rays.ray_base_maps(cells.repartition(7), tile=8).select("sample_id", "y", "x", "wall_count")
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
