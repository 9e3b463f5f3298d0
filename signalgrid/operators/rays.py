"""Ray tracing over rasters: wall and material counts from transmitter to every cell.

A ray is the digital line between two cells. Along its longer axis it moves one cell per
step i; on the shorter axis it sits at round-half-up(i * minor / major). That closed form
lets any piece of a ray be evaluated alone, so rasters are cut into square tiles and each
(receiver tile, crossed tile) pair is a row. No row per ray cell ever exists, a raster of
any size spreads over many tasks, and what is shuffled is tiles, not rays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgrid.functions import pathloss as pl
from signalgrid.operators.percentiles import null_safe_join
from signalgrid.session import spread

TILE = 64


def minor_offset(i: Column, major: Column, minor: Column) -> Column:
    """Cells moved on the shorter axis after `i` steps on the longer one."""
    twice = F.greatest(2 * major, F.lit(1))
    return F.floor((2 * i * minor + major) / twice).cast("int")


def ray_cells(segments: DataFrame, x0="x0", y0="y0", x1="x1", y1="y1") -> DataFrame:
    """Every cell of every segment, endpoints included, as columns `step`, `ray_x`, `ray_y`."""
    dx, dy = F.abs(F.col(x1) - F.col(x0)), F.abs(F.col(y1) - F.col(y0))
    major, minor = F.greatest(dx, dy), F.least(dx, dy)
    sx = F.when(F.col(x1) >= F.col(x0), 1).otherwise(-1)
    sy = F.when(F.col(y1) >= F.col(y0), 1).otherwise(-1)
    out = segments.withColumn("step", F.explode(F.sequence(F.lit(0), major.cast("int"))))
    off = minor_offset(F.col("step"), major, minor)
    return out.withColumn(
        "ray_x", F.col(x0) + sx * F.when(dx >= dy, F.col("step")).otherwise(off)
    ).withColumn("ray_y", F.col(y0) + sy * F.when(dx >= dy, off).otherwise(F.col("step")))


#: Segments of a raster and tile that travel together (some 100 bytes each).
SEGMENTS_TOGETHER = 16_384


def segment_material_stats(segments: DataFrame, cells: DataFrame, segment_key: Sequence[str],
                           material_ids: Sequence[int] = (1, 2, 3), tile: int = TILE) -> DataFrame:
    """Line-of-sight flag, wall total and per-material counts for arbitrary segments.

    Segments carry (sample_id, x0, y0, x1, y1). As for whole rasters, the segments that may cross
    a tile are packed beside the tile's walls, so neither ray cells nor a raster's walls per segment
    become rows. Segments of one raster and tile are cut by hash into packs of about `SEGMENTS_TOGETHER`.
    """
    key, ids, ends = list(segment_key), tuple(int(m) for m in material_ids), ("_x0", "_y0", "_x1", "_y1")

    def at(c):
        return F.floor(F.col(c) / F.lit(tile)).cast("int")

    # Tiles in the rectangle between the ends that lie near the line, by the same margin as in `ray_base_maps`.
    # A segment that lacks a coordinate on one axis meets no wall; without either axis it has no cells and no row.
    whole = F.expr("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    known = segments.where("(x0 IS NOT NULL AND x1 IS NOT NULL) OR (y0 IS NOT NULL AND y1 IS NOT NULL)").select(
        *key, F.when(whole, F.col("sample_id")).alias("_raster"), *[F.when(whole, F.col(c[1:])).otherwise(0).cast("bigint").alias(c) for c in ends])
    one = (at("_x0") == at("_x1")) & (at("_y0") == at("_y1"))
    over = known.withColumn("over_y", F.explode(F.sequence(F.least(at("_y0"), at("_y1")), F.greatest(at("_y0"), at("_y1"))))).withColumn(
        "over_x", F.explode(F.sequence(F.least(at("_x0"), at("_x1")), F.greatest(at("_x0"), at("_x1")))))
    mid, reach = (tile - 1) / 2.0, tile * 2.0**0.5 + 1.0
    lx, ly = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    px, py = F.col("over_x") * tile + mid - F.col("_x0"), F.col("over_y") * tile + mid - F.col("_y0")
    home = (F.col("over_x") == at("_x0")) & (F.col("over_y") == at("_y0"))
    over = over.withColumn("home", home).where(one | home | (F.abs(lx * py - ly * px) <= reach * F.sqrt((lx * lx + ly * ly).cast("double"))))
    packs = over.groupBy("_raster").agg(F.ceil(F.count(F.lit(1)) / SEGMENTS_TOGETHER).alias("_packs"))
    dealt = null_safe_join(over, packs, ["_raster"]).withColumn("_pack", F.pmod(F.xxhash64(*key, *ends), "_packs")).drop("_packs")
    where = ["_raster", "over_y", "over_x"]
    carried = [*key, *ends, "home"]
    packed = dealt.groupBy(*where, "_pack").agg(F.collect_list(F.struct(*carried)).alias("segs"))
    walls = cells.where("material > 0").groupBy(
        F.col("sample_id").alias("_raster"), F.floor(F.col("y") / tile).cast("int").alias("over_y"), F.floor(F.col("x") / tile).cast("int").alias("over_x")
    ).agg(F.collect_list(F.struct(((F.col("y") % tile) * tile + F.col("x") % tile).cast("int").alias("pos"), "material")).alias("w"))

    names = ["walls", *[f"m{m}" for m in ids]]

    @F.pandas_udf("struct<" + ",".join(f"{n}:array<bigint>" for n in names) + ">")
    def trace(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for x0, y0, x1, y1, left, top, pos, mat in batches:
            rows = []
            for r in range(len(x0)):
                p, m = np.asarray(pos.iloc[r], dtype=np.int64), np.asarray(mat.iloc[r], dtype=np.int64)
                counts = [np.bincount(some, minlength=tile * tile + 1) for some in (p, *[p[m == i] for i in ids])]
                b = [np.asarray(c.iloc[r], dtype=np.int64) for c in (x0, y0, x1, y1)]
                # The first row counts cells of `dense` and is not used; the others add up walls, also where a cell occurs twice.
                rows.append(_trace(*b, int(left.iloc[r]), int(top.iloc[r]), tile, counts[0], counts, ())[1:].astype(np.int64))
            yield pd.DataFrame({n: [row[j] for row in rows] for j, n in enumerate(names)})

    pairs = packed.join(walls, where, "left")
    traced = pairs.withColumn("ray", trace(
        *[F.col(f"segs.{c}") for c in ends], F.col("over_x") * tile, F.col("over_y") * tile,
        F.coalesce("w.pos", F.array().cast("array<int>")), F.coalesce("w.material", F.array().cast("array<int>"))))
    rows = traced.select(F.explode(F.arrays_zip("segs", *[F.col(f"ray.{n}").alias(n) for n in names])).alias("z")).where("z.segs.home OR z.walls > 0")
    found = rows.select(*[F.col(f"z.segs.{k}").alias(k) for k in key], *[F.col(f"z.{n}").alias(n) for n in names])
    return found.groupBy(*key).agg(
        F.sum("walls").alias("wall_count"), (F.sum("walls") == 0).alias("los"),
        *[F.sum(f"m{m}").alias(f"mat_{m}_count") for m in ids])


def ray_origin(cells: DataFrame) -> DataFrame:
    """Integer ray start: half-even rounded transmitter clipped to the raster."""
    def clip(pos, size):
        return F.greatest(F.lit(0), F.least(F.bround(pos).cast("int"), F.col(size) - 1))
    return cells.withColumn("ray_x0", clip("tx_x", "width")).withColumn("ray_y0", clip("tx_y", "height"))


def _trace(tx, ty, xs, ys, left, top, side, dense, layers, material_ids):
    """Counts for rays (tx,ty)->(xs,ys) over the cells of one tile."""
    n_cells = len(xs)
    out = np.zeros((1 + len(material_ids) + len(layers), n_cells))
    dx, dy = np.abs(xs - tx), np.abs(ys - ty)
    x_major = dx >= dy
    major, minor = np.maximum(dx, dy), np.minimum(dx, dy)
    sx, sy = np.where(xs >= tx, 1, -1), np.where(ys >= ty, 1, -1)
    start = np.where(x_major, tx, ty)
    sign = np.where(x_major, sx, sy)
    low_edge = np.where(x_major, left, top)
    first = np.where(sign > 0, low_edge - start, start - (low_edge + side - 1))
    last = np.minimum(first + side - 1, major)
    first = np.maximum(first, 0)
    twice = np.maximum(2 * major, 1)
    live = np.nonzero(first <= last)[0]
    if live.size == 0:
        return out
    # Drop rays whose minor axis never enters the tile while the major axis is inside it.
    m_start = np.where(x_major, ty, tx)[live]
    m_sign = np.where(x_major, sy, sx)[live]
    m_edge = np.where(x_major, top, left)[live]
    a = m_start + m_sign * ((2 * first[live] * minor[live] + major[live]) // twice[live])
    b = m_start + m_sign * ((2 * last[live] * minor[live] + major[live]) // twice[live])
    touch = (np.maximum(a, b) >= m_edge) & (np.minimum(a, b) < m_edge + side)
    live, m_start, m_sign = live[touch], m_start[touch], m_sign[touch]
    if live.size == 0:
        return out
    steps = first[live][:, None] + np.arange(int((last[live] - first[live]).max()) + 1)
    inside = steps <= last[live][:, None]
    maj = start[live][:, None] + sign[live][:, None] * steps
    mnr = m_start[:, None] + m_sign[:, None] * ((2 * steps * minor[live][:, None] + major[live][:, None]) // twice[live][:, None])
    xm = x_major[live][:, None]
    cx, cy = np.where(xm, maj, mnr) - left, np.where(xm, mnr, maj) - top
    inside &= (cx >= 0) & (cx < side) & (cy >= 0) & (cy < side)
    where = np.where(inside, cy * side + cx, side * side)
    seen = dense[where]
    out[0, live] = (seen > 0).sum(axis=1)
    for n, m in enumerate(material_ids):
        out[1 + n, live] = (seen == m).sum(axis=1)
    for n, layer in enumerate(layers):
        out[1 + len(material_ids) + n, live] = layer[where].sum(axis=1)
    return out


def _tile_kernel(side: int, material_ids: tuple[int, ...]):
    names = ["walls", *[f"m{m}" for m in material_ids], "trans", "refl"]
    result = "struct<" + ",".join(f"{n}:array<double>" for n in names) + ">"

    @F.pandas_udf(result)
    def trace(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for tx, ty, xs, ys, left, top, pos, mat, trans, refl in batches:
            rows = []
            for r in range(len(tx)):
                dense = np.zeros(side * side + 1, dtype=np.int32)
                layer_t, layer_r = np.zeros(side * side + 1), np.zeros(side * side + 1)
                p = np.asarray(pos.iloc[r], dtype=np.int64)
                dense[p] = mat.iloc[r]
                layer_t[p], layer_r[p] = trans.iloc[r], refl.iloc[r]
                rows.append(_trace(int(tx.iloc[r]), int(ty.iloc[r]),
                                   np.asarray(xs.iloc[r], dtype=np.int64), np.asarray(ys.iloc[r], dtype=np.int64),
                                   int(left.iloc[r]), int(top.iloc[r]), side, dense, (layer_t, layer_r), material_ids))
            yield pd.DataFrame({n: [row[j] for row in rows] for j, n in enumerate(names)})

    return trace, names


def pack_tiles(cells: DataFrame, side: int) -> DataFrame:
    """One row per (sample, tile): the occupied raster cells as parallel arrays, at most side*side long."""
    at = F.struct(
        ((F.col("y") % side) * side + F.col("x") % side).cast("int").alias("pos"),
        F.col("material"), F.coalesce("transmittance", F.lit(0.0)).alias("t"), F.coalesce("reflectance", F.lit(0.0)).alias("r"))
    packed = cells.groupBy(
        "sample_id", F.floor(F.col("y") / side).cast("int").alias("tile_y"), F.floor(F.col("x") / side).cast("int").alias("tile_x")
    ).agg(F.collect_list(at).alias("c"))
    return packed.select("sample_id", "tile_y", "tile_x", F.col("c.pos").alias("pos"), F.col("c.material").alias("mat"),
                         F.col("c.t").alias("trans"), F.col("c.r").alias("refl"))


def ray_base_maps(cells: DataFrame, material_ids: Sequence[int] = (1, 2, 3), min_distance_m: float = 0.25,
                  carry: Sequence[str] = ("scene_id", "path_loss", "wall"), tile: int = TILE) -> DataFrame:
    """Geometry features of every valid cell of every sample.

    Adds distance_m, fspl_db, los, wall_count, wall_fraction, mat_<id>_count,
    transmittance_sum and reflectance_sum. Both ray ends count. Cells missing from the
    raster count as free space.
    """
    ids = tuple(int(m) for m in material_ids)
    located = ray_origin(cells)
    per_sample = ["tx_x", "tx_y", "frequency_hz", "resolution_m", "height", "width", "ray_x0", "ray_y0"]
    per_sample += [c for c in carry if c == "scene_id"]
    per_cell = ["x", "y", *[c for c in carry if c != "scene_id"]]
    side = F.lit(tile)

    # Only wall cells and cells with a layer value change any sum.
    payload = pack_tiles(
        cells.where("material > 0 OR coalesce(transmittance, 0D) <> 0 OR coalesce(reflectance, 0D) <> 0"), tile
    ).withColumnsRenamed({"tile_y": "over_y", "tile_x": "over_x"})
    receivers = located.where("valid").groupBy(
        "sample_id", F.floor(F.col("y") / side).cast("int").alias("tile_y"), F.floor(F.col("x") / side).cast("int").alias("tile_x")
    ).agg(*[F.first(c).alias(c) for c in per_sample], F.collect_list(F.struct(*per_cell)).alias("cells"))

    # Tiles a ray may cross: those in the rectangle between transmitter and receiver tile
    # that lie near the centre line. The margin is two tile half-diagonals plus one cell.
    otx, oty = F.floor(F.col("ray_x0") / side).cast("int"), F.floor(F.col("ray_y0") / side).cast("int")
    crossed = receivers.withColumn(
        "over_y", F.explode(F.sequence(F.least(oty, "tile_y"), F.greatest(oty, "tile_y")))
    ).withColumn("over_x", F.explode(F.sequence(F.least(otx, "tile_x"), F.greatest(otx, "tile_x"))))
    mid = (tile - 1) / 2.0
    lx, ly = F.col("tile_x") * tile + mid - F.col("ray_x0"), F.col("tile_y") * tile + mid - F.col("ray_y0")
    px, py = F.col("over_x") * tile + mid - F.col("ray_x0"), F.col("over_y") * tile + mid - F.col("ray_y0")
    reach = tile * 2.0**0.5 + 1.0
    home = (F.col("over_x") == F.col("tile_x")) & (F.col("over_y") == F.col("tile_y"))
    near = (F.abs(lx * py - ly * px) <= reach * F.sqrt(lx * lx + ly * ly)) | (F.sqrt(px * px + py * py) <= reach)
    crossed = crossed.where(home | near)

    trace, names = _tile_kernel(tile, ids)
    empty = F.array().cast("array<int>")
    blank = F.array().cast("array<double>")
    # Pairs without any wall in the crossed tile add nothing, unless they are the home pair
    # that makes sure every receiver is present in the result.
    pairs = crossed.join(payload, ["sample_id", "over_y", "over_x"], "left").where(home | F.col("pos").isNotNull())
    dealt = spread(pairs, "sample_id", "tile_y", "tile_x", "over_y", "over_x")
    traced = dealt.withColumn("ray", trace(
        "ray_x0", "ray_y0", F.col("cells.x"), F.col("cells.y"), F.col("over_x") * tile, F.col("over_y") * tile,
        F.coalesce("pos", empty), F.coalesce("mat", empty), F.coalesce("trans", blank), F.coalesce("refl", blank)))
    keys = ["sample_id", "tile_y", "tile_x"]
    rows = traced.select(
        *keys, *per_sample, F.explode(F.arrays_zip("cells", *[F.col(f"ray.{n}").alias(n) for n in names])).alias("z"))
    # Text attributes ride along as keys, which keeps this a hash aggregation.
    text = [c for c in per_sample if c == "scene_id"]
    summed = rows.groupBy(*keys, *text, F.col("z.cells.y").alias("y"), F.col("z.cells.x").alias("x")).agg(
        *[F.first(c).alias(c) for c in per_sample if c not in text],
        *[F.first(f"z.cells.{c}").alias(c) for c in per_cell if c not in ("x", "y")],
        *[F.sum(f"z.{n}").alias(n) for n in names])

    dx, dy = F.abs(F.col("x") - F.col("ray_x0")), F.abs(F.col("y") - F.col("ray_y0"))
    dist = pl.distance_m(min_distance_m=min_distance_m)
    return summed.select(
        "sample_id", "y", "x", *carry, "height", "width", "frequency_hz", "resolution_m",
        dist.alias("distance_m"),
        pl.fspl_db(dist, "frequency_hz", min_distance_m).alias("fspl_db"),
        (F.col("walls") <= 0).cast("int").alias("los"),
        F.col("walls").cast("int").alias("wall_count"),
        (F.col("walls") / (F.greatest(dx, dy) + 1)).alias("wall_fraction"),
        *[F.col(f"m{m}").cast("int").alias(f"mat_{m}_count") for m in ids],
        F.col("trans").alias("transmittance_sum"), F.col("refl").alias("reflectance_sum"))
