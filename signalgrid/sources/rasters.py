"""Raster files to cell rows: array archives, images, position tables and building sizes."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalgrid.functions.pathloss import snap_to_edge
from signalgrid.operators.cleaning import wall_mask

# Carrier frequency of each frequency id (fixed values).
FREQUENCY_HZ = {1: 868.0e6, 2: 1.8e9, 3: 3.5e9}

# Array names accepted for each field, best first (fixed values of the file contract).
ARRAY_NAMES = {
    "path_loss": ("path_loss", "path_loss_db", "target", "target_db"),
    "valid": ("valid_mask", "mask", "receiver_mask"),
    "material": ("material_map", "materials", "building_map"),
}
SCALAR_NAMES = {"frequency_hz": ("frequency_hz", "freq_hz"), "resolution_m": ("resolution_m", "cell_size_m", "pixel_size_m")}

SCENE_SCHEMA = (
    "path string, file_sample_id string, file_scene_id string, file_tx_x double, file_tx_y double, file_frequency_hz double,"
    " file_resolution_m double, height int, width int, y int, x int, path_loss double, valid boolean, wall boolean,"
    " material int, transmittance double, reflectance double")


def plain_path(path: Column | str) -> Column:
    """File path without its scheme."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def _decode_scenes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def first(z, names):
        return next((z[n] for n in names if n in z), None)

    def scalar(value):
        return None if value is None else float(np.asarray(value).reshape(-1)[0])

    def text(value):
        if value is None:
            return None
        v = np.asarray(value).reshape(-1)[0]
        return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            z = np.load(io.BytesIO(content), allow_pickle=False)
            arrays = {k: first(z, names) for k, names in ARRAY_NAMES.items()}
            absent = [k for k, v in arrays.items() if v is None]
            if absent:
                raise ValueError(f"{path} lacks arrays {absent}")
            material = arrays["material"].astype(np.int32)
            wall = z["wall_mask"].astype(bool) if "wall_mask" in z else material > 0
            shape = arrays["path_loss"].shape
            if any(a.shape != shape for a in (arrays["valid"], material, wall)):
                raise ValueError(f"{path} has arrays of different shapes")
            if "tx_xy" in z:
                tx = z["tx_xy"].astype(float).reshape(-1)[:2]
            else:
                tx = (scalar(first(z, ("tx_x",))), scalar(first(z, ("tx_y",))))
            ys, xs = np.indices(shape)
            n = ys.size

            def layer(name, z=z, n=n):
                return z[name].astype(float).ravel() if name in z else np.full(n, np.nan)
            yield pd.DataFrame({
                "path": path, "file_sample_id": text(first(z, ("sample_id",))), "file_scene_id": text(first(z, ("scene_id",))),
                "file_tx_x": tx[0], "file_tx_y": tx[1],
                "file_frequency_hz": scalar(first(z, SCALAR_NAMES["frequency_hz"])),
                "file_resolution_m": scalar(first(z, SCALAR_NAMES["resolution_m"])),
                "height": shape[0], "width": shape[1], "y": ys.ravel().astype("int32"), "x": xs.ravel().astype("int32"),
                "path_loss": arrays["path_loss"].astype(float).ravel(), "valid": arrays["valid"].astype(bool).ravel(),
                "wall": wall.ravel(), "material": material.ravel(),
                "transmittance": layer("transmittance"), "reflectance": layer("reflectance")})


def scene_cells(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cell rows of array archives (columns path, content), completed from the manifest.

    Names, frequency and resolution come from the manifest first, the transmitter from
    the file first; a scalar found in neither stays null for `missing_scalars`.
    """
    stem = F.regexp_extract(plain_path("path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    cells = files.mapInPandas(_decode_scenes, SCENE_SCHEMA).withColumn("stem", stem).withColumn("resolved_path", plain_path("path"))
    known = set(manifest.columns)

    def own(name):
        return F.col(f"m_{name}") if name in known else F.lit(None)
    side = manifest.select("resolved_path", *[F.col(c).alias(f"m_{c}") for c in manifest.columns if c != "resolved_path"])
    joined = cells.join(side, "resolved_path")

    def null_nan(c):
        return F.nanvl(c, F.lit(None).cast("double"))
    return joined.select(
        F.coalesce(own("sample_id"), "file_sample_id", "stem").alias("sample_id"),
        F.coalesce(own("scene_id"), "file_scene_id", "stem").alias("scene_id"),
        "y", "x", "height", "width", F.coalesce(null_nan(F.col("file_tx_x")), own("tx_x")).alias("tx_x"),
        F.coalesce(null_nan(F.col("file_tx_y")), own("tx_y")).alias("tx_y"),
        F.coalesce(own("frequency_hz"), null_nan(F.col("file_frequency_hz"))).alias("frequency_hz"),
        F.coalesce(own("resolution_m"), null_nan(F.col("file_resolution_m"))).alias("resolution_m"),
        null_nan(F.col("path_loss")).alias("path_loss"), "valid", "wall", "material",
        null_nan(F.col("transmittance")).alias("transmittance"), null_nan(F.col("reflectance")).alias("reflectance"))


def missing_scalars(cells: DataFrame) -> DataFrame:
    """Samples without transmitter, frequency or resolution; must be empty."""
    return cells.where("tx_x IS NULL OR tx_y IS NULL OR frequency_hz IS NULL OR resolution_m IS NULL").select("sample_id").distinct()


def read_scenes(spark: SparkSession, glob: str, manifest: DataFrame) -> DataFrame:
    return scene_cells(spark.read.format("binaryFile").load(glob).select("path", "content"), manifest)


def parse_sample_name(name: str = "name") -> dict[str, Column]:
    """The four numbers of a raster name B<b>_Ant<a>_f<f>_S<s>; null when the name does not fit."""
    pattern = r"^B(\d+)_Ant(\d+)_f(\d+)_S(\d+)$"
    fields = ("building_id", "antenna_id", "frequency_id", "sample_index")
    return {f: F.regexp_extract(name, pattern, i + 1).try_cast("int") for i, f in enumerate(fields)}


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder. Only the path column is kept, so no file content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def discover_samples(inputs: DataFrame, outputs: DataFrame, task: int) -> tuple[DataFrame, DataFrame]:
    """Paired rasters, and the files that break the layout with the reason."""
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)
    have = inputs.select(F.col("path").alias("input_path"), stem.alias("name")).withColumns(parse_sample_name())
    out = outputs.select(F.col("path").alias("output_path"), stem.alias("name"))
    joined = have.join(out, "name", "left")
    reason = (F.when(F.col("sample_index").isNull(), "bad_name").when(F.col("output_path").isNull(), "missing_output")
              .when(~F.col("frequency_id").isin(*FREQUENCY_HZ), "unknown_frequency"))
    tagged = joined.withColumn("problem", reason)
    frequency = F.coalesce(*[F.when(F.col("frequency_id") == k, F.lit(v)) for k, v in FREQUENCY_HZ.items()])
    samples = tagged.where("problem IS NULL").select(
        F.col("name").alias("sample_id"), F.concat(F.lit("B"), F.col("building_id").cast("string")).alias("scene_id"),
        F.lit(int(task)).alias("task_id"), "building_id", "antenna_id", "frequency_id", "sample_index",
        frequency.alias("frequency_hz"), "input_path", "output_path")
    return samples, tagged.where("problem IS NOT NULL").select("name", "problem")


PAIR_SCHEMA = "sample_id string, y int, x int, height int, width int, reflectance double, transmittance double, distance_img double, path_loss double"


def _decode_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both images of a sample at once; images of different shapes end the job."""
    for batch in batches:
        for pair in batch.itertuples(index=False):
            if (pair.h_in, pair.w_in) != (pair.h_out, pair.w_out):
                raise ValueError(f"images of different shapes: {pair.sample_id} has {pair.h_in} x {pair.w_in} and {pair.h_out} x {pair.w_out}")
            shape = (int(pair.h_in), int(pair.w_in))
            # Stored as B, G, R; an image of fewer channels answers with its last one.
            planes = np.frombuffer(pair.d_in, dtype=np.uint8).reshape(*shape, -1)
            loss = np.frombuffer(pair.d_out, dtype=np.uint8).reshape(*shape, -1)
            blue, green, red = (planes[:, :, min(i, planes.shape[2] - 1)].ravel().astype(float) for i in range(3))
            ys, xs = np.indices(shape, dtype="int32")
            yield pd.DataFrame({"sample_id": pair.sample_id, "y": ys.ravel(), "x": xs.ravel(), "height": shape[0], "width": shape[1], "reflectance": red,
                                "transmittance": green, "distance_img": blue, "path_loss": loss[:, :, min(2, loss.shape[2] - 1)].ravel().astype(float)})


def image_cells(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cells from input images (colour: reflectance, transmittance, distance) and path-loss images.

    A colour path-loss image counts by its red channel. Images are paired by name before
    they are decoded, so whole files are shuffled instead of pixels. A pair of unequal
    shapes ends the job (`shape_mismatches` lists them); an image without a partner is
    reported by `discover_samples` and gives no cells.
    """
    stem = F.regexp_extract("image.origin", r"([^/]+?)\.[^./]*$", 1)

    def files(df, tag):
        return df.select(stem.alias("sample_id"), F.col("image.height").alias(f"h_{tag}"), F.col("image.width").alias(f"w_{tag}"), F.col("image.data").alias(f"d_{tag}"))
    cells = files(inputs, "in").join(files(outputs, "out"), "sample_id").mapInPandas(_decode_pairs, PAIR_SCHEMA)
    return cells.withColumn("valid", F.col("path_loss").isNotNull()).withColumn("wall", wall_mask())


def shape_mismatches(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Image pairs of unequal size, judged from image headers; must be empty."""
    stem = F.regexp_extract("image.origin", r"([^/]+?)\.[^./]*$", 1)

    def sizes(df, tag):
        return df.select(stem.alias("name"), F.col("image.height").alias(f"h_{tag}"), F.col("image.width").alias(f"w_{tag}"))
    return sizes(inputs, "in").join(sizes(outputs, "out"), "name").where("h_in <> h_out OR w_in <> w_out")


def positions(files: DataFrame) -> DataFrame:
    """Transmitter rows from whole position files (columns file_name, value).

    The row number inside a file is the sample index. The axes swap: tx_x is the Y
    column and tx_y the X column, wherever the header puts them.
    """
    name = r"Positions_B(\d+)_Ant(\d+)_f(\d+)"
    ids = ["building_id", "antenna_id", "frequency_id"]
    # Columns beside a generator are worked out for each of its rows, so whatever needs the whole file is put
    # into the generated array: a row carries its line and the places of the two axes, not the file.
    lines = files.select("file_name", F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "").alias("lines"))
    header = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda s: F.upper(F.trim(s)))
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    places = F.struct(*[(F.array_position(header, axis).cast("int") - 1).alias(axis) for axis in ("X", "Y")])
    rows = F.explode(F.arrays_zip(body.alias("line"), F.sequence(F.lit(0), F.size(body) - 1).alias("sample_index"), F.array_repeat(places, F.size(body)).alias("at")))
    parsed = lines.where(F.size("lines") > 1).select("file_name", rows.alias("r"))

    def field(axis):
        return F.get(F.split("r.line", ","), F.col(f"r.at.{axis}")).try_cast("double")
    return parsed.select(
        *[F.regexp_extract("file_name", name, i + 1).cast("int").alias(c) for i, c in enumerate(ids)], F.col("r.sample_index").alias("sample_index"),
        field("Y").alias("tx_x"), field("X").alias("tx_y"))


def read_positions(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="Positions_*.csv")
    return positions(files.select(F.col("_metadata.file_name").alias("file_name"), "value"))


def attach_positions(samples: DataFrame, tx: DataFrame, tolerance_px: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples with a usable transmitter, the snapped ones, and those rejected with the reason.

    Samples carry height and width. A position up to the tolerance outside snaps to the edge.
    """
    keys = ["building_id", "antenna_id", "frequency_id", "sample_index"]
    joined = samples.join(tx.withColumnsRenamed({"tx_x": "tx_x_raw", "tx_y": "tx_y_raw"}), keys, "left").withColumn(
        "tx_x", snap_to_edge("tx_x_raw", "width", tolerance_px)).withColumn("tx_y", snap_to_edge("tx_y_raw", "height", tolerance_px))
    reason = F.when(F.col("tx_x_raw").isNull() | F.col("tx_y_raw").isNull(), "no_position_row").when(
        F.col("tx_x").isNull() | F.col("tx_y").isNull(), "outside_tolerance")
    tagged = joined.withColumn("problem", reason)
    good = tagged.where("problem IS NULL").drop("problem")
    return good, good.where("tx_x <> tx_x_raw OR tx_y <> tx_y_raw"), tagged.where("problem IS NOT NULL")


def dimension_warnings(samples: DataFrame, details: DataFrame) -> DataFrame:
    """One warning per building whose stated (W, H) differs from its rasters."""
    odd = samples.join(details, "building_id").where("w <> width OR h <> height")
    return odd.groupBy("building_id").agg(F.min("w").alias("w"), F.min("h").alias("h"), F.min("width").alias("width"), F.min("height").alias("height"))


def material_classes(cells: DataFrame) -> DataFrame:
    """Material 0-3 from interface strength: terciles of each sample's wall strengths.

    Strengths are counted per value first (image bytes have at most 511 sums), so the
    percentile of a sample of any size works on a short list.
    """
    strength = F.abs("reflectance") + F.abs("transmittance")
    marked = cells.withColumn("_s", strength).withColumn("_wall", wall_mask())
    counted = marked.where("_wall").groupBy("sample_id", "_s").agg(F.count(F.lit(1)).alias("_c"))
    cuts = counted.groupBy("sample_id").agg(
        F.percentile("_s", F.array(F.lit(1.0 / 3.0), F.lit(2.0 / 3.0)), F.col("_c")).alias("_q"),
        F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_distinct"))
    flat = (F.col("_n") < 3) | (F.col("_distinct") < 3)
    level = (F.when(~F.col("_wall"), 0).when(flat, 1).when(F.col("_s") > F.get("_q", F.lit(1)), 3)
             .when(F.col("_s") > F.get("_q", F.lit(0)), 2).otherwise(1))
    return marked.join(cuts, "sample_id", "left").withColumn("material", level).drop("_s", "_wall", "_q", "_n", "_distinct")


def conversion_summary(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Dataset totals after conversion: path-loss range, wall share per sample, distinct ids."""
    per_sample = cells.groupBy("sample_id").agg(
        F.avg(F.col("wall").cast("double")).alias("walls"), F.min("path_loss").alias("lo"), F.max("path_loss").alias("hi"),
        F.sum("path_loss").alias("total"), F.count("path_loss").alias("n"))
    values = per_sample.agg(
        F.count(F.lit(1)).alias("samples"), F.min("lo").alias("path_loss_min"), F.max("hi").alias("path_loss_max"),
        (F.sum("total") / F.sum("n")).alias("path_loss_mean"), F.min("walls").alias("wall_fraction_min"),
        F.avg("walls").alias("wall_fraction_mean"), F.max("walls").alias("wall_fraction_max"))
    ids = samples.agg(F.countDistinct("building_id").alias("buildings"), F.countDistinct("antenna_id").alias("antennas"),
                      F.countDistinct("frequency_id").alias("frequencies"), F.countDistinct("height", "width").alias("shapes"))
    return values.join(F.broadcast(ids))  # one row each
