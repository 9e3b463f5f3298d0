"""Sources, sinks, projections and cleaning on files and rows derived from the driver tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from signalgrid.functions import pathloss as pl
from signalgrid.operators import cleaning, features, metrics as M, paired as P
from signalgrid.plans import views
from signalgrid.queries import dense as D
from signalgrid.queries import scores as S
from signalgrid.queries import sql_parts as sq
from signalgrid.queries.registry import query, scan_rows, tidy
from signalgrid.session import fresh_path, materialise
from signalgrid.sources import campaign, manifest as MF, rasters, runs, sinks, survey

# --- sources ---------------------------------------------------------------------


@query("src1_manifest_scan", """SELECT sample_id, scene_id, concat('/data/', map_path) AS resolved_path, round(tx_x, 6) AS tx_x, round(tx_y, 6) AS tx_y,
  round(frequency_hz, 1) AS frequency_hz, segment FROM manifest""", ["manifest"])
def src1(spark, sf_dir):
    path = fresh_path(spark, "manifest-csv")
    views.manifest(spark, sf_dir).write.option("header", True).csv(path)
    out = MF.read_manifest(spark, path, "/data")
    return tidy(out.select("sample_id", "scene_id", "resolved_path", "tx_x", "tx_y", "frequency_hz", "segment"), frequency_hz=1)


def _encode_scene(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One raster as an array archive; cells that do not exist stay invalid."""
    h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
    at = (pdf["y"].to_numpy(), pdf["x"].to_numpy())
    grids = {n: np.zeros((h, w)) for n in ("path_loss_db", "mask", "materials", "transmittance", "reflectance")}
    grids["path_loss_db"][:] = np.nan
    for n, c in (("path_loss_db", "path_loss"), ("mask", "valid"), ("materials", "material"), ("transmittance", "transmittance"), ("reflectance", "reflectance")):
        grids[n][at] = pdf[c].to_numpy(dtype=float)
    out = io.BytesIO()
    np.savez_compressed(out, tx_xy=np.array([pdf["tx_x"].iloc[0], pdf["tx_y"].iloc[0]]), cell_size_m=np.array(0.25),
                        sample_id=np.array("inner-" + key[0]), **grids)
    return pd.DataFrame({"path": [f"file:/data/scenes/{key[0]}.npz"], "content": [out.getvalue()]})


@query("src2_scene_arrays", """SELECT sample_id, scene_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(tx_x, 5) AS tx_x, round(tx_y, 5) AS tx_y, frequency_hz, resolution_m,
  round(path_loss, 5) AS path_loss, wall, CAST(material AS BIGINT) AS material, round(transmittance, 5) AS transmittance, round(reflectance, 5) AS reflectance FROM cells WHERE valid""", ["cells"])
def src2(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    files = cells.groupBy("sample_id").applyInPandas(_encode_scene, "path string, content binary")
    index = cells.select("sample_id", "scene_id", "frequency_hz").distinct().withColumn(
        "resolved_path", F.concat(F.lit("/data/scenes/"), "sample_id", F.lit(".npz")))
    out = rasters.scene_cells(files, index).where("valid")
    return tidy(out.select("sample_id", "scene_id", "y", "x", "tx_x", "tx_y", "frequency_hz", "resolution_m", "path_loss", "wall", "material",
                           "transmittance", "reflectance"), 5)


def _listing(spark, sf_dir):
    """Input and output file listings named after the customers; some names, outputs and frequencies are wrong."""
    k = views.manifest(spark, sf_dir).select("c_custkey")
    name = F.concat(F.lit("B"), F.col("c_custkey") % 25 + 1, F.lit("_Ant"), F.col("c_custkey") % 5 + 1, F.lit("_f"), F.col("c_custkey") % 4 + 1,
                    F.when(F.col("c_custkey") % 50 == 9, "_X").otherwise("_S"), F.col("c_custkey"))
    named = k.withColumn("name", name)
    inputs = named.select(F.concat(F.lit("/raw/Inputs/"), "name", F.lit(".png")).alias("path"))
    outputs = named.where("c_custkey % 11 <> 4").select(F.concat(F.lit("/raw/Outputs/"), "name", F.lit(".png")).alias("path"))
    return inputs, outputs


@query("src3_discover_samples", """WITH n AS (SELECT c_custkey AS k, concat('B', c_custkey % 25 + 1, '_Ant', c_custkey % 5 + 1, '_f', c_custkey % 4 + 1, CASE WHEN c_custkey % 50 = 9 THEN '_X' ELSE '_S' END, c_custkey) AS name FROM manifest)
SELECT name, CASE WHEN k % 50 = 9 THEN 'bad_name' WHEN k % 11 = 4 THEN 'missing_output' WHEN k % 4 = 3 THEN 'unknown_frequency' ELSE 'ok' END AS problem,
  CASE WHEN k % 50 <> 9 AND k % 11 <> 4 AND k % 4 <> 3 THEN CASE k % 4 WHEN 0 THEN 8.68e8 WHEN 1 THEN 1.8e9 ELSE 3.5e9 END END AS frequency_hz FROM n""", ["manifest"])
def src3(spark, sf_dir):
    samples, problems = rasters.discover_samples(*_listing(spark, sf_dir), 1)
    good = samples.select(F.col("sample_id").alias("name"), F.lit("ok").alias("problem"), "frequency_hz")
    return tidy(good.unionByName(problems.withColumn("frequency_hz", F.lit(None).cast("double"))))


def _images(spark, sf_dir):
    """Rasters as image rows: blue distance, green transmittance, red reflectance; gray path loss."""
    cells = views.cells(spark, sf_dir)

    def byte(c):
        return F.lpad(F.hex(F.least(F.lit(255), F.floor(c)).cast("int")), 2, "0")
    pos = (F.col("y") * F.col("width") + F.col("x")).alias("pos")
    colour = F.concat(byte(F.coalesce("path_loss", F.lit(0.0)) * 2), byte(F.col("transmittance") * 100), byte(F.col("reflectance") * 100))
    gray = byte(F.coalesce("path_loss", F.lit(0.0)))
    packed = cells.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct(pos, colour.alias("c")))).alias("c"), F.array_sort(F.collect_list(F.struct(pos, gray.alias("g")))).alias("g"),
        F.max("y").alias("last"))

    def image(folder, data, channels):
        return packed.select(F.struct(
            F.concat(F.lit(f"/raw/{folder}/"), "sample_id", F.lit(".png")).alias("origin"), (F.col("last") + 1).alias("height"), F.lit(20).alias("width"),
            F.lit(channels).alias("nChannels"), F.unhex(F.array_join(data, "")).alias("data")).alias("image"))
    return image("Inputs", F.col("c.c"), 3), image("Outputs", F.col("g.g"), 1)


IMG = """img AS (SELECT sample_id, y, x, least(255, floor(reflectance * 100)) AS refl, least(255, floor(transmittance * 100)) AS trans,
  least(255, floor(coalesce(path_loss, 0))) AS pl FROM cells)"""


@query("src4_image_cells", "WITH " + IMG + """ SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(refl AS DOUBLE) AS reflectance, CAST(trans AS DOUBLE) AS transmittance,
  CAST(pl AS DOUBLE) AS path_loss, refl > 0 OR trans > 0 AS wall FROM img""", ["cells"])
def src4(spark, sf_dir):
    out = rasters.image_cells(*_images(spark, sf_dir))
    return tidy(out.select("sample_id", "y", "x", "reflectance", "transmittance", "path_loss", "wall"))


def _position_files(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select(
        "c_custkey", F.concat(F.lit("Positions_B"), F.col("c_custkey") % 25 + 1, F.lit("_Ant"), F.col("c_custkey") % 3 + 1, F.lit("_f1.csv")).alias("file_name"),
        F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("tx_y").cast("string"), F.col("tx_x").cast("string")).alias("line"))
    return rows.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("l")).select(
        "file_name", F.concat(F.lit("Id,X,Y\n"), F.array_join(F.col("l.line"), "\n"), F.lit("\n")).alias("value"))


POSITIONS = """pos AS (SELECT c_custkey % 25 + 1 AS building_id, c_custkey % 3 + 1 AS antenna_id, tx_x, tx_y,
  row_number() OVER (PARTITION BY c_custkey % 25, c_custkey % 3 ORDER BY c_custkey) - 1 AS sample_index FROM manifest)"""


@query("src5_transmitter_positions", "WITH " + POSITIONS + """ SELECT CAST(building_id AS BIGINT) AS building_id, CAST(antenna_id AS BIGINT) AS antenna_id, CAST(1 AS BIGINT) AS frequency_id,
  CAST(sample_index AS BIGINT) AS sample_index, tx_x, tx_y FROM pos""", ["manifest"])
def src5(spark, sf_dir):
    return tidy(rasters.positions(_position_files(spark, sf_dir)))


@query("src6_building_dimensions", """SELECT CAST(c_custkey % 25 + 1 AS BIGINT) AS building_id, CAST(CASE WHEN c_custkey % 25 % 4 = 0 THEN 10 ELSE 20 END AS BIGINT) AS w, CAST(20 AS BIGINT) AS h,
  CAST(20 AS BIGINT) AS width, CAST(20 AS BIGINT) AS height FROM manifest WHERE c_custkey % 25 % 4 = 0 GROUP BY ALL""", ["manifest"])
def src6(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select((F.col("c_custkey") % 25 + 1).alias("building_id"), F.lit(20).alias("width"), F.lit(20).alias("height"))
    details = rows.select("building_id").distinct().select(
        "building_id", F.when((F.col("building_id") - 1) % 4 == 0, 10).otherwise(20).alias("w"), F.lit(20).alias("h"))
    return tidy(rasters.dimension_warnings(rows, details))


@query("src7_survey_union", """SELECT source_file, count(*) AS "rows", count(DISTINCT scenario) AS scenarios, round(sum(measured_path_loss_db), 3) AS path_loss_sum, round(min(frequency_hz), 1) AS frequency_min,
  round(max(frequency_hz), 1) AS frequency_max, count(*) FILTER (los_nlos = 'LOS') AS los, count(*) FILTER (los_nlos = 'NLOS') AS nlos, count(antenna_height) AS with_height,
  count(drywall_count) AS with_drywall FROM (
  SELECT 'first' AS source_file, scenario, pl_db AS measured_path_loss_db, 3.5e9 AS frequency_hz, CASE WHEN elevator = 1 THEN 'NLOS' ELSE 'LOS' END AS los_nlos, distance_m / 2 AS antenna_height, NULL AS drywall_count FROM points WHERE config = 'C1'
  UNION ALL SELECT 'second', scenario, pl_db, 3.5e9, CASE WHEN num_drywall + num_column > 0 THEN 'NLOS' ELSE 'LOS' END, NULL, num_drywall FROM points WHERE config = 'C2') GROUP BY 1""", ["points"])
def src7(spark, sf_dir):
    folder = fresh_path(spark, "survey")
    rows = views.points(spark, sf_dir)
    first = rows.where("config = 'C1'").select(
        F.col("scenario").alias("Building"), F.col("config").alias("Config ID"), F.col("coord").alias("Rx_ID"), F.col("pl_db").alias("Path Loss (dB)"),
        F.col("distance_m").alias("Distance [m]"), F.lit(3.5).alias("Frequency (GHz)"), F.when(F.col("elevator") == 1, "non-los").otherwise("line_of_sight").alias("LOS/NLOS"),
        F.col("num_brick_wall").alias("Brick Walls"), (F.col("distance_m") / 2).alias("antenna_height"))
    second = rows.where("config = 'C2'").select(
        "scenario", F.col("coord").alias("point_id"), F.col("pl_db").alias("pathloss_db"), "distance_m", F.col("num_drywall").alias("drywall"), F.col("num_column").alias("column"))
    first.write.option("header", True).csv(f"{folder}/first")
    second.write.option("header", True).csv(f"{folder}/second")
    out = survey.read_campaigns(spark, [f"{folder}/first", f"{folder}/second"])
    return tidy(out.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("scenario").alias("scenarios"), F.sum("measured_path_loss_db").alias("path_loss_sum"),
        F.min("frequency_hz").alias("frequency_min"), F.max("frequency_hz").alias("frequency_max"), F.count(F.when(F.col("los_nlos") == "LOS", 1)).alias("los"),
        F.count(F.when(F.col("los_nlos") == "NLOS", 1)).alias("nlos"), F.count("antenna_height").alias("with_height"), F.count("drywall_count").alias("with_drywall")),
        3, frequency_min=1, frequency_max=1)


@query("src8_campaign_scan", """SELECT row_uid, scenario, config, round(distance_m, 6) AS distance_m, round(pl_db, 6) AS pl_db, CASE WHEN config = 'C1' THEN 0e0 ELSE elevator END AS elevator,
  round(p_rx_dbm, 6) AS p_rx_dbm, round(rx_x, 6) AS rx_x FROM points""", ["points"])
def src8(spark, sf_dir):
    folder = fresh_path(spark, "campaign")
    rows = views.points(spark, sf_dir).select(
        "scenario", "config", F.col("coord").alias("Coord."), F.col("distance_m").alias("Distance (m)"), F.col("num_brick_wall").alias("Num_brick_wall"),
        F.col("num_wood_wall").alias("Num_wood_wall"), F.col("num_glass_wall").alias("Num_glass_wall"), F.col("num_drywall").alias("Num_drywall"),
        F.col("num_column").alias("Num_column"), F.col("elevator").alias("Elevator"), F.col("p_rx_dbm").alias("P_rx (dBm)"), F.col("pl_db").alias("PL (dB)"), F.col("rx_x").alias("x"))
    for s in views.SCENARIOS:
        for c in views.CONFIGS:
            one = rows.where((F.col("scenario") == s) & (F.col("config") == c)).drop("scenario", "config")
            # Files of the first configuration have no elevator column.
            (one.drop("Elevator") if c == "C1" else one).write.option("header", True).csv(f"{folder}/PL_{s}_{c}.csv")
    out = campaign.load_campaign(spark, folder, views.SCENARIOS, views.CONFIGS)
    return tidy(out.select("row_uid", "scenario", "config", "distance_m", "pl_db", "elevator", "p_rx_dbm", "rx_x"))


@query("src9_run_results", """SELECT concat('run_', CAST(sparse_seed AS VARCHAR)) AS source_run, method, count(*) AS "rows", round(avg(rmse), 6) AS rmse FROM run_metrics GROUP BY 1, 2""", ["run_metrics"])
def src9(spark, sf_dir):
    folder = fresh_path(spark, "runs")
    rows = views.run_metrics(spark, sf_dir)
    for seed in (11, 22, 33):
        rows.where(F.col("sparse_seed") == seed).select("method", "sparse_rate", "sparse_seed", "sample_id", "rmse").write.option("header", True).csv(f"{folder}/run_{seed}")
    out = runs.read_runs(spark, [folder])
    return tidy(out.groupBy("source_run", "method").agg(F.count(F.lit(1)).alias("rows"), F.avg("rmse").alias("rmse")))


@query("src10_saved_models", """SELECT DISTINCT method, 1e-2 AS rate, CAST(sparse_seed AS BIGINT) AS seed, concat('/models/', method, '_rate_0p01_seed_', CAST(sparse_seed AS VARCHAR)) AS path FROM run_metrics""", ["run_metrics"])
def src10(spark, sf_dir):
    rows = views.run_metrics(spark, sf_dir).select("method", "sparse_seed").distinct()
    good = rows.select(F.concat(F.lit("/models/"), "method", F.lit("_rate_0p01_seed_"), F.col("sparse_seed").cast("string")).alias("path"))
    other = rows.select(F.concat(F.lit("/models/"), "method", F.lit("_notes")).alias("path"))
    return tidy(runs.discover_models(good.unionByName(other)), 9)


# --- sinks -----------------------------------------------------------------------


@query("snk1_converted_dataset", """SELECT CAST(regexp_extract(sample_id, '^B(\\d+)_', 1) AS BIGINT) AS building_id, count(DISTINCT sample_id) AS samples, count(*) AS cells FROM cells GROUP BY 1""", ["cells"])
def snk1(spark, sf_dir):
    folder = fresh_path(spark, "converted")
    cells = views.cells(spark, sf_dir).withColumns({"building_id": F.regexp_extract("sample_id", r"^B(\d+)_", 1).cast("int"), "task_id": F.lit(1)})
    samples = cells.select("sample_id", "scene_id", "building_id", "task_id", "height", "width").distinct()
    early = "CAST(regexp_extract(sample_id, '_S([0-9]+)$', 1) AS INT) % 2 = 0"
    sinks.write_dataset(cells.where(early), samples.where(early), folder)
    sinks.write_dataset(cells, samples, folder, mode="skip_existing")
    stored = spark.read.parquet(f"{folder}/cells")
    return tidy(stored.groupBy("building_id").agg(F.countDistinct("sample_id").alias("samples"), F.count(F.lit(1)).alias("cells")))


@query("snk2_metric_tables", """SELECT method, round(avg(rmse), 6) AS rmse, count(*) AS num_rows FROM run_metrics GROUP BY 1""", ["run_metrics"])
def snk2(spark, sf_dir):
    folder = fresh_path(spark, "metrics")
    rows = views.run_metrics(spark, sf_dir)
    final = M.mean_std(rows, ["sparse_rate", "method"], ["rmse"])
    sinks.write_metrics(rows, final, folder)
    back = spark.read.option("header", True).csv(f"{folder}/final_results")
    return tidy(back.select("method", F.col("rmse").cast("double"), F.col("num_rows").cast("bigint")))


@query("snk3_dense_predictions", S.SCORED + """SELECT method, count(*) AS cells, round(avg(pred), 4) AS pred FROM long WHERE seed = 11 GROUP BY 1""", ["cells"])
def snk3(spark, sf_dir):
    folder = fresh_path(spark, "dense")
    sinks.write_predictions(S.scored(spark, sf_dir).select("sample_id", "rate", "seed", "method", "y", "x", "pred", "path_loss"), folder, D.RATE, 11)
    return tidy(spark.read.parquet(f"{folder}/predictions").groupBy("method").agg(F.count(F.lit(1)).alias("cells"), F.avg("pred").alias("pred")), 4)


@query("snk4_point_results", S.POINT_PREDS + "SELECT method, count(*) AS points, round(sqrt(avg(e * e)), 6) AS rmse FROM point_preds GROUP BY 1", ["points"])
def snk4(spark, sf_dir):
    folder = fresh_path(spark, "points")
    # Percentiles of groups beyond one task read their rows several times: these read a narrow table.
    preds = S.point_predictions(spark, sf_dir)
    bound = scan_rows(spark, sf_dir, "lineitem")
    scored = materialise(preds.select("split", "method", "random_seed", "fold", "pred_pl_db", "target_pl_db"), "scored")
    pooled = materialise(M.error_metrics(scored, ["method"], "pred_pl_db", "target_pl_db", std="pop", rows_bound=bound), "pooled")
    sinks.write_point_results(S.fold_rows(spark, sf_dir, scored), preds, pooled, pooled.agg(F.min("rmse").alias("best_rmse")), folder)
    counts = spark.read.parquet(f"{folder}/point_predictions").groupBy("method").agg(F.count(F.lit(1)).alias("points"))
    back = spark.read.option("header", True).csv(f"{folder}/pooled_metrics").select("method", F.col("rmse").cast("double"))
    return tidy(counts.join(back, "method"))


@query("snk5_file_fingerprints", """SELECT concat('docs/', CAST(doc_id AS VARCHAR), '.txt') AS path, md5(text) AS md5, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents""")
def snk5(spark, sf_dir):
    return sinks.fingerprints(_documents(spark, sf_dir), exclude=(".git", "__pycache__"))


def _documents(spark, sf_dir):
    return views.read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))


@query("snk5_tree_digest", """SELECT count(*) AS num_files, sha256('[' || string_agg('{"md5": "' || md5(text) || '", "path": "' || path || '", "sha256": "' || sha256(text) || '"}', ', ' ORDER BY path) || ']') AS manifest_sha256
FROM (SELECT *, concat('docs/', CAST(doc_id AS VARCHAR), '.txt') AS path FROM documents)""")
def snk5_tree(spark, sf_dir):
    return sinks.tree_hash(sinks.fingerprints(_documents(spark, sf_dir)))


# --- projections and cleaning ------------------------------------------------------

HEADER = "concat('  ', p_type, ' (', p_brand, ') % #', CAST(p_size AS VARCHAR), ' [°C]')"


def _headers(spark, sf_dir):
    return views.read_table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("  "), "p_type", F.lit(" ("), "p_brand", F.lit(") % #"), F.col("p_size").cast("string"), F.lit(" [°C]")).alias("raw"))


@query("prj1_header_names", f"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(trim({HEADER})), '%', '_pct'), '#', '_num'), '[°℃]', '', 'g'),
  '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM part""")
def prj1(spark, sf_dir):
    return _headers(spark, sf_dir).select("p_partkey", survey.header_name_column(F.col("raw")).alias("name"))


@query("prj2_header_keys", f"""SELECT p_partkey, regexp_replace(regexp_replace(trim(regexp_replace(lower(trim({HEADER})), '[()/-]', ' ', 'g')), '\\s+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part""")
def prj2(spark, sf_dir):
    return _headers(spark, sf_dir).select("p_partkey", campaign.header_key_column(F.col("raw")).alias("name"))


@query("prj3_alias_binding", """SELECT scenario, coord AS rx_id, round(pl_db, 6) AS measured_path_loss_db, round(distance_m, 6) AS distance_m, config AS campaign_id, round(rx_x, 6) AS x_pos FROM points""", ["points"])
def prj3(spark, sf_dir):
    raw = views.points(spark, sf_dir).select(F.col("scenario").alias("Site"), F.col("config").alias("Setup"), F.col("coord").alias("Point"), F.col("pl_db").alias("PL dB"),
                                             F.col("distance_m").alias("Range (m)"), F.col("rx_x").alias("X pos"))
    out = survey.canonical_table(raw, "points")
    return tidy(out.select("scenario", "rx_id", "measured_path_loss_db", "distance_m", "campaign_id", "x_pos"))


@query("prj4_numeric_coercion", """SELECT row_uid, CASE WHEN reading % 5 = 0 THEN NULL ELSE round(distance_m, 6) END AS value FROM points""", ["points"])
def prj4(spark, sf_dir):
    text = F.when(F.col("reading") % 5 == 0, "n/a").otherwise(F.col("distance_m").cast("string"))
    return tidy(views.points(spark, sf_dir).withColumn("t", text).select("row_uid", cleaning.numeric("t").alias("value")))


@query("prj5_frequency_units", """WITH m AS (SELECT median(frequency_hz / 1e6) AS med FROM manifest WHERE c_custkey % 13 <> 5)
SELECT sample_id, round(CASE WHEN c_custkey % 13 = 5 THEN 3.5e9 ELSE frequency_hz / 1e6 * CASE WHEN med < 1e3 THEN 1e9 WHEN med < 1e6 THEN 1e6 ELSE 1 END END, 1) AS frequency_hz FROM manifest, m""", ["manifest"])
def prj5(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select("sample_id", F.when(F.col("c_custkey") % 13 != 5, F.col("frequency_hz") / 1e6).alias("frequency_hz"))
    return tidy(cleaning.frequency_hz(rows, "frequency_hz", "carrier"), 1)


WORDS = ("LOS", " yes", "0", "Non-LOS path", "obstructed", "nan", "partial los", "NLOS?", "")


@query("prj6_los_labels", "SELECT sample_id, CASE c_custkey % 9 WHEN 0 THEN 'LOS' WHEN 1 THEN 'LOS' WHEN 2 THEN 'NLOS' WHEN 3 THEN 'NLOS' WHEN 4 THEN 'obstructed' WHEN 6 THEN 'LOS' WHEN 7 THEN 'NLOS' END AS label FROM manifest", ["manifest"])
def prj6(spark, sf_dir):
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("c_custkey") % 9).cast("int"))
    return views.manifest(spark, sf_dir).withColumn("w", word).select("sample_id", cleaning.los_label("w").alias("label"))


@query("prj7_los_from_walls", "SELECT row_uid, CASE WHEN num_brick_wall + num_wood_wall + num_glass_wall > 0 THEN 'NLOS' ELSE 'LOS' END AS label FROM points", ["points"])
def prj7(spark, sf_dir):
    return views.points(spark, sf_dir).select("row_uid", cleaning.los_from_walls(("num_brick_wall", "num_wood_wall", "num_glass_wall")).alias("label"))


@query("prj8_wall_mask", "SELECT sample_id, count(*) FILTER (abs(reflectance) > 1e-6 OR abs(transmittance) > 1e-6) AS walls FROM cells GROUP BY 1", ["cells"])
def prj8(spark, sf_dir):
    return views.cells(spark, sf_dir).groupBy("sample_id").agg(F.count(F.when(cleaning.wall_mask(), 1)).alias("walls"))


@query("prj9_transmitter_snap", """SELECT sample_id, CAST(CASE WHEN tx_x < 0 AND tx_x >= -2 THEN 0 WHEN tx_x > 9 AND tx_x <= 11 THEN 9 WHEN tx_x BETWEEN 0 AND 9 THEN tx_x END AS DOUBLE) AS tx_x,
  CAST(CASE WHEN tx_y < 0 AND tx_y >= -2 THEN 0 WHEN tx_y > 19 AND tx_y <= 21 THEN 19 WHEN tx_y BETWEEN 0 AND 19 THEN tx_y END AS DOUBLE) AS tx_y FROM manifest""", ["manifest"])
def prj9(spark, sf_dir):
    return tidy(views.manifest(spark, sf_dir).select("sample_id", pl.snap_to_edge("tx_x", F.lit(10), 2.0).alias("tx_x"), pl.snap_to_edge("tx_y", F.lit(20), 2.0).alias("tx_y")))


def _dirty(spark, sf_dir):
    """Points with missing targets, non-positive distances and missing walls."""
    return views.points(spark, sf_dir).withColumnRenamed("reading", "k").withColumns({
        "pl_db": F.when(F.col("k") % 101 == 3, None).otherwise(F.col("pl_db")), "distance_m": F.when(F.col("k") % 97 == 2, 0.0).otherwise(F.col("distance_m")),
        "num_drywall": F.when(F.col("k") % 89 == 1, None).otherwise(F.col("num_drywall")), "elevator": F.when(F.col("k") % 83 == 7, None).otherwise(F.col("elevator"))})


DIRTY = """d AS (SELECT row_uid, source_file, scenario, reading AS k, num_brick_wall, distance_m FROM points),
t AS (SELECT *, CASE WHEN k % 97 = 2 THEN 0e0 ELSE distance_m END AS d, CASE WHEN k % 101 = 3 OR k % 97 = 2 THEN 'invalid_path_loss_or_distance' WHEN k % 89 = 1 OR k % 83 = 7 THEN 'missing_wall_counts'
  WHEN scenario = 'North' AND num_brick_wall = 3 THEN 'known_anomaly' END AS reason FROM d)"""


@query("prj10_row_cleaning", "WITH " + DIRTY + """ SELECT reason AS reject_reason, source_file, count(*) AS "rows", min(d) AS distance_min, max(d) AS distance_max FROM t WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'kept', source_file, count(*), min(d), max(d) FROM t WHERE reason IS NULL GROUP BY 2""", ["points"])
def prj10(spark, sf_dir):
    kept, rejected = campaign.clean(_dirty(spark, sf_dir), {"scenario": "North", "num_brick_wall": 3.0})
    good = kept.groupBy("source_file").agg(F.lit("kept").alias("reject_reason"), F.count(F.lit(1)).alias("rows"), F.min("distance_m").alias("distance_min"), F.max("distance_m").alias("distance_max"))
    return tidy(campaign.reject_log(rejected).unionByName(good))


@query("prj11_usable_points", "WITH " + DIRTY + " SELECT scenario, count(*) FILTER (k % 101 <> 3 AND k % 97 <> 2) AS kept, count(*) FILTER (k % 101 = 3 OR k % 97 = 2) AS dropped FROM t GROUP BY 1", ["points"])
def prj11(spark, sf_dir):
    ok = cleaning.usable_point()
    return _dirty(spark, sf_dir).groupBy("scenario").agg(F.count(F.when(ok, 1)).alias("kept"), F.count(F.when(~ok, 1)).alias("dropped"))


@query("prj12_sample_metadata", S.SUBGROUP + "SELECT DISTINCT sample_id, CAST(building AS BIGINT) AS building, CAST(antenna AS BIGINT) AS antenna, CAST(frequency AS BIGINT) AS frequency FROM cond", ["run_metrics"])
def prj12(spark, sf_dir):
    return tidy(P.parse_metadata(views.run_metrics(spark, sf_dir).select("sample_id").distinct()))


@query("prj13_transfer_condition", S.SUBGROUP + "SELECT transfer_condition, count(*) AS \"rows\" FROM cond GROUP BY 1", ["run_metrics"])
def prj13(spark, sf_dir):
    return P.with_condition(views.run_metrics(spark, sf_dir)).groupBy("transfer_condition").agg(F.count(F.lit(1)).alias("rows"))


@query("prj14_wall_region", "SELECT row_uid, CASE WHEN num_brick_wall <= 0 THEN '0_walls' WHEN num_brick_wall <= 2 THEN '1-2_walls' ELSE '3+_walls' END AS region FROM points", ["points"])
def prj14(spark, sf_dir):
    return views.points(spark, sf_dir).select("row_uid", cleaning.wall_region("num_brick_wall").alias("region"))


GEOMETRY = features.geometry_only(features.feature_names())


@query("prj15_feature_allow_lists", D.FEATURES_SQL + "SELECT sample_id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in GEOMETRY) + " FROM feats GROUP BY 1", ["cells"])
def prj15(spark, sf_dir):
    table = D.feature_table(spark, sf_dir)
    allowed = features.geometry_only([c for c in table.columns if features.group_of(c) != "other"])
    return tidy(table.groupBy("sample_id").agg(*[F.avg(c).alias(c) for c in allowed]))


@query("prj16_point_features", """SELECT row_uid, round(log10(greatest(distance_m, 1e-3)), 6) AS log10_distance, distance_m, num_brick_wall, num_wood_wall, num_glass_wall, num_drywall, num_column, elevator,
  CASE WHEN config = 'C1' THEN 1e0 ELSE 0e0 END AS "config_C1", CASE WHEN config = 'C2' THEN 1e0 ELSE 0e0 END AS "config_C2" FROM points""", ["points"])
def prj16(spark, sf_dir):
    out, names = features.point_features(views.points(spark, sf_dir), "leave_scenario_out", views.WALL_COLUMNS, views.SCENARIOS, views.CONFIGS)
    return tidy(out.select("row_uid", *names))


@query("prj17_survey_features", """SELECT row_uid, round(log10(greatest(distance_m, 1e-3)), 6) AS log10_distance, 3.5e9 AS frequency_hz, num_brick_wall AS brick_wall_count,
  CASE WHEN num_brick_wall > 0 THEN 0e0 ELSE 1e0 END AS los_numeric FROM points""", ["points"])
def prj17(spark, sf_dir):
    rows = views.points(spark, sf_dir).withColumns({
        "los_nlos": F.when(F.col("num_brick_wall") > 0, "nlos").otherwise("los"), "frequency_hz": F.lit(None).cast("double"), "brick_wall_count": F.col("num_brick_wall")})
    out, names = features.survey_features(rows, ["brick_wall_count"])
    return tidy(out.select("row_uid", *names))


# --- image-based geometry ------------------------------------------------------------


@query("ray6_material_classes", "WITH " + IMG + """, w AS (SELECT sample_id, refl + trans AS s FROM img WHERE refl > 0 OR trans > 0),
q AS (SELECT sample_id, quantile_cont(s, 1e0 / 3) AS a, quantile_cont(s, 2e0 / 3) AS b, count(*) AS n, count(DISTINCT s) AS d FROM w GROUP BY 1)
SELECT sample_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE WHEN refl <= 0 AND trans <= 0 THEN 0 WHEN n < 3 OR d < 3 THEN 1 WHEN refl + trans > b THEN 3 WHEN refl + trans > a THEN 2 ELSE 1 END AS BIGINT) AS material
FROM img LEFT JOIN q USING (sample_id)""", ["cells"])
def ray6(spark, sf_dir):
    return tidy(rasters.material_classes(rasters.image_cells(*_images(spark, sf_dir))).select("sample_id", "y", "x", "material"))


@query("ray7_conversion_summary", "WITH " + IMG + """, p AS (SELECT sample_id, avg(CASE WHEN refl > 0 OR trans > 0 THEN 1e0 ELSE 0e0 END) AS walls FROM img GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS samples, CAST(min(pl) AS DOUBLE) AS path_loss_min, CAST(max(pl) AS DOUBLE) AS path_loss_max, round(avg(pl), 6) AS path_loss_mean,
  (SELECT round(min(walls), 6) FROM p) AS wall_fraction_min, (SELECT round(avg(walls), 6) FROM p) AS wall_fraction_mean, (SELECT round(max(walls), 6) FROM p) AS wall_fraction_max,
  count(DISTINCT regexp_extract(sample_id, 'B(\\d+)', 1)) AS buildings, count(DISTINCT regexp_extract(sample_id, 'Ant(\\d+)', 1)) AS antennas,
  count(DISTINCT regexp_extract(sample_id, 'f(\\d+)', 1)) AS frequencies, (SELECT count(DISTINCT h) FROM (SELECT max(y) AS h FROM cells GROUP BY sample_id)) AS shapes FROM img""", ["cells"])
def ray7(spark, sf_dir):
    cells = rasters.image_cells(*_images(spark, sf_dir))
    samples = cells.select("sample_id", "height", "width").distinct().withColumns(rasters.parse_sample_name("sample_id"))
    return tidy(rasters.conversion_summary(cells, samples))
