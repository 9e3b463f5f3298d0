"""The geometry store: what misses, what is shared, and what readers see of two writers."""

import pytest
from pyspark.sql import functions as F

from signalgrid.operators.rays import ray_base_maps
from signalgrid.plans import geometry_store as store


@pytest.fixture(scope="module")
def cells(spark):
    rows = []
    for sample, tx in (("a", 1.2), ("b", 1.2), ("c", 4.0)):  # a and b are one geometry
        for y in range(6):
            for x in range(6):
                wall = x == 3 and y != 2
                rows.append((sample, "S", y, x, 6, 6, tx, 2.0, 1e9, 0.25, float(x * y), not wall, wall, 2 if wall else 0, 0.5 if wall else 0.0, 0.0))
    return spark.createDataFrame(rows, "sample_id string, scene_id string, y int, x int, height int, width int, tx_x double, tx_y double, frequency_hz double,"
                                       " resolution_m double, path_loss double, valid boolean, wall boolean, material int, transmittance double, reflectance double")


def key_of(cells, sample="a", **params):
    return {r["sample_id"]: r["geometry_key"] for r in store.geometry_keys(cells, **params).collect()}[sample]


def test_keys_follow_the_geometry_only(cells):
    base = key_of(cells)
    assert key_of(cells.repartition(5)) == base == key_of(cells, "b") != key_of(cells, "c")
    changed = {
        "tx": cells.withColumn("tx_x", F.col("tx_x") + 0.5), "frequency": cells.withColumn("frequency_hz", F.lit(2e9)),
        "resolution": cells.withColumn("resolution_m", F.lit(0.5)), "material": cells.withColumn("material", F.when((F.col("x") == 3) & (F.col("y") == 0), 1).otherwise(F.col("material"))),
        "layer": cells.withColumn("reflectance", F.lit(0.1)), "no layer": cells.withColumn("reflectance", F.lit(None).cast("double")),
        "valid": cells.withColumn("valid", F.lit(True))}
    keys = {name: key_of(c) for name, c in changed.items()}
    keys |= {"materials": key_of(cells, material_ids=(1, 2)), "distance": key_of(cells, min_distance_m=0.5)}
    assert base not in keys.values() and len(set(keys.values())) == len(keys)
    assert key_of(cells.withColumn("path_loss", F.lit(1.0)).withColumn("scene_id", F.lit("T"))) == base


def test_only_missing_entries_are_computed(spark, cells, tmp_path):
    root, keys = f"file://{tmp_path}/g", store.geometry_keys(cells)
    assert store.add_missing(cells.where("sample_id = 'a'"), keys.where("sample_id = 'a'"), root) == 1
    assert store.add_missing(cells, keys, root) == 1  # b shares the entry of a
    assert store.add_missing(cells, keys, root) == 0
    got = store.stored_maps(keys, root)
    assert not {"path_loss", "wall", "scene_id"} & set(spark.read.parquet(f"{root}/objects").columns)
    want = ray_base_maps(cells, carry=())
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count()


def test_two_writers_and_a_broken_one(spark, cells, tmp_path):
    root, keys = f"file://{tmp_path}/g", store.geometry_keys(cells)
    maps = ray_base_maps(cells.where("sample_id <> 'b'"), carry=()).join(keys, "sample_id").drop("sample_id")
    for run in ("r2", "r1"):
        maps.write.parquet(f"{root}/objects/run={run}")
        maps.select("geometry_key").distinct().write.parquet(f"{root}/commits/run={run}")
    maps.withColumn("los", F.lit(-1)).write.parquet(f"{root}/objects/run=r0")  # never committed
    assert {r["run"] for r in store.committed(spark, root).collect()} == {"r1"}
    got = store.stored_maps(keys, root)
    assert got.count() == ray_base_maps(cells, carry=()).count() and got.where("los < 0").isEmpty()


def test_labels_are_those_of_the_cells(spark, cells, tmp_path):
    path = f"file://{tmp_path}/cells"
    cells.write.parquet(path)
    source = spark.read.parquet(path)
    once = store.stored_base_maps(source, source, root=f"file://{tmp_path}/g")
    other = source.withColumn("path_loss", F.lit(7.0))
    again = store.stored_base_maps(source, other, root=f"file://{tmp_path}/g")
    assert once.where("path_loss <> x * y").isEmpty() and again.where("path_loss <> 7").isEmpty() and once.count() == again.count() > 0
    assert len(list((tmp_path / "g" / "commits").glob("run=*"))) == 1
