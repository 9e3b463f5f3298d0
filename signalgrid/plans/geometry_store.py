"""A store of label-independent geometry, shared by jobs.

An entry is the base maps of one raster as seen from one transmitter. Its key is a digest
of everything that changes the maps: the raster's cells (positions, materials, layer
values, validity), transmitter, frequency, resolution, size, whether layers are present,
materials and minimum distance. So samples with one geometry share one entry, and a
changed raster or parameter is another entry. No label is stored.

    objects/run=<id>/   maps written by one job, each row with its key
    commits/run=<id>/   the keys of that job; complete once Spark's _SUCCESS is in it

A job computes only keys that no commit names (an anti join), writes its objects under a
name of its own, then its commit. Readers see committed runs only; of a key that two jobs
have written at once, the run with the smaller name counts. Nothing is overwritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalgrid.functions.hashing import stable_hash
from signalgrid.operators.rays import ray_base_maps
from signalgrid.session import materialise, shared_dir

VERSION = "2"
#: Key tables of this process, by session, plan of the cells, parameters and state of the source's files.
_KEYS: dict[tuple, tuple[DataFrame, DataFrame]] = {}
#: Their maps beside the labels, under the same marks and the labels' names.
_LABELLED: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def source_signature(table: DataFrame, params: str) -> str:
    """Key of a file-backed table and a parameter text."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    # Per-file hashes are summed, so file lists of any length reduce to one number.
    row = files.select(stable_hash("file_path", "file_size", F.col("file_modification_time").cast("string")).alias("h")).agg(
        F.sum("h").alias("s"), F.count(F.lit(1)).alias("n")).select(
        F.substring(F.sha2(F.concat_ws("::", "s", "n", F.lit(params)), 256), 1, 24).alias("key")).first()
    return row["key"]


def geometry_keys(cells: DataFrame, material_ids: Sequence[int] = (1, 2, 3), min_distance_m: float = 0.25) -> DataFrame:
    """(sample_id, geometry_key). Cell hashes are summed twice under different salts, so rows may come in any order."""
    cell = ["y", "x", "material", "valid", F.coalesce("transmittance", F.lit(0.0)), F.coalesce("reflectance", F.lit(0.0))]
    sums = [F.sum(F.xxhash64(F.lit(salt), *cell).cast("decimal(38,0)")).cast("string").alias(f"cells{salt}") for salt in (1, 2)]
    view = [F.min(c).cast("string").alias(c) for c in ("tx_x", "tx_y", "frequency_hz", "resolution_m", "height", "width")]
    layers = [(F.count(c) > 0).cast("string").alias(c) for c in ("transmittance", "reflectance")]
    found = cells.groupBy("sample_id").agg(F.count(F.lit(1)).cast("string").alias("n"), *sums, *view, *layers)
    fixed = f"{VERSION}||{','.join(str(int(m)) for m in material_ids)}||{float(min_distance_m)!r}"
    text = F.concat_ws("||", F.lit(fixed), *[F.coalesce(c, F.lit("-")) for c in found.columns if c != "sample_id"])
    return found.select("sample_id", F.sha2(text, 256).alias("geometry_key"))


def _runs(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed runs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(p.getName().removeprefix("run=") for p in done)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(geometry_key, run) of every entry that readers may see."""
    runs = _runs(spark, root)
    if not runs:
        return spark.createDataFrame([], "geometry_key string, run string")
    table = spark.read.option("basePath", f"{root}/commits").schema("geometry_key string, run string").parquet(*[f"{root}/commits/run={r}" for r in runs])
    return table.groupBy("geometry_key").agg(F.min("run").alias("run"))


def add_missing(cells: DataFrame, keys: DataFrame, root: str, material_ids: Sequence[int] = (1, 2, 3), min_distance_m: float = 0.25) -> int:
    """Compute and commit the entries of `keys` that the store lacks; the number of new ones."""
    spark = cells.sparkSession
    # One sample stands for all that share its geometry.
    missing = keys.join(committed(spark, root), "geometry_key", "left_anti").groupBy("geometry_key").agg(F.min("sample_id").alias("sample_id"))
    missing = materialise(missing, "geometry-missing")
    count = missing.count()
    if count:
        run = uuid.uuid4().hex
        maps = ray_base_maps(cells.join(missing, "sample_id", "left_semi"), material_ids, min_distance_m, ())
        maps.join(missing, "sample_id").drop("sample_id").write.mode("errorifexists").parquet(f"{root}/objects/run={run}")
        missing.select("geometry_key").write.mode("errorifexists").parquet(f"{root}/commits/run={run}")
    return count


def stored_maps(keys: DataFrame, root: str) -> DataFrame:
    """Base maps of every sample in `keys` from the store."""
    spark = keys.sparkSession
    entries = committed(spark, root)
    runs = _runs(spark, root)
    if not runs:
        raise ValueError(f"nothing is stored under {root}")
    maps = spark.read.option("basePath", f"{root}/objects").parquet(*[f"{root}/objects/run={r}" for r in runs]).withColumn("run", F.col("run").cast("string"))
    return maps.join(keys.join(entries, "geometry_key"), ["geometry_key", "run"]).drop("geometry_key", "run")


def stored_base_maps(source: DataFrame, cells: DataFrame, material_ids: Sequence[int] = (1, 2, 3), min_distance_m: float = 0.25,
                     carry: Sequence[str] = ("scene_id", "path_loss", "wall"), root: str | None = None) -> DataFrame:
    """Base maps of `cells`, each geometry computed at most once, with the columns `carry` of the cells as they are now.

    `source` is the file-backed table behind `cells`: while its files are unchanged, this
    process works out neither the keys nor the labelled maps again."""
    spark = cells.sparkSession
    root = root or f"{shared_dir(spark)}/geometry"
    params = f"{root}{tuple(material_ids)}{min_distance_m}"
    mark = (spark.sparkContext.applicationId, cells.semanticHash(), source_signature(source, params))
    known = _KEYS.get(mark)
    if known is None or not known[0].sameSemantics(cells):
        keys = materialise(geometry_keys(cells, material_ids, min_distance_m), "geometry-keys")
        add_missing(cells, keys, root, material_ids, min_distance_m)
        known = _KEYS[mark] = (cells, keys)
    done = _LABELLED.get((*mark, *carry))
    if done is not None and done[0].sameSemantics(cells):
        return done[1]
    maps = stored_maps(known[1], root)
    labels = cells.where("valid").select("sample_id", "y", "x", *carry)
    ordered = ["sample_id", "y", "x", *carry, *[c for c in maps.columns if c not in ("sample_id", "y", "x")]]
    # A query reads them several times, and the join shuffles both sides by cell.
    labelled = materialise(maps.join(labels, ["sample_id", "y", "x"]).select(*ordered), "base-maps")
    _LABELLED[(*mark, *carry)] = (cells, labelled)
    return labelled
