import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalgrid.operators import cleaning, splits
from signalgrid.sources import campaign, manifest, rasters, runs, sinks, survey


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    raw = b"".join(b"\x00" + pixels[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture()
def raw_tree(tmp_path):
    rgb = np.zeros((16, 16, 3), int)
    rgb[:, 8, 0], rgb[:, 8, 1] = 120, 90
    rgb[:, :, 2] = np.arange(16)
    gray = np.arange(256).reshape(16, 16) % 160
    for d in ("Inputs", "Outputs", "Positions"):
        (tmp_path / d).mkdir()
    for s in range(2):
        (tmp_path / "Inputs" / f"B1_Ant1_f1_S{s}.png").write_bytes(png(rgb))
        (tmp_path / "Outputs" / f"B1_Ant1_f1_S{s}.png").write_bytes(png(gray))
    (tmp_path / "Positions" / "Positions_B1_Ant1_f1.csv").write_text("X,Y\n3,5\n40,2\n")
    return tmp_path, rgb, gray


def test_image_release(spark, raw_tree):
    root, rgb, gray = raw_tree
    listed = [rasters.list_files(spark, str(root / d), "*.png") for d in ("Inputs", "Outputs")]
    samples, problems = rasters.discover_samples(*listed, 1)
    assert problems.isEmpty() and [r.sample_id for r in samples.orderBy("sample_index").collect()] == ["B1_Ant1_f1_S0", "B1_Ant1_f1_S1"]
    images = [spark.read.format("image").load(str(root / d)) for d in ("Inputs", "Outputs")]
    assert rasters.shape_mismatches(*images).isEmpty()
    cells = rasters.image_cells(*images)
    for r in cells.where("sample_id = 'B1_Ant1_f1_S0'").collect():
        assert (r.reflectance, r.transmittance, r.distance_img) == tuple(rgb[r.y, r.x])
        assert r.path_loss == gray[r.y, r.x] and r.wall == (r.x == 8)
    assert {r.material for r in rasters.material_classes(cells).where("wall").select("material").distinct().collect()} == {1}
    sized = samples.withColumns({"height": F.lit(16), "width": F.lit(16)})
    good, snapped, rejected = rasters.attach_positions(sized, rasters.read_positions(spark, str(root / "Positions")))
    assert [(r.tx_x, r.tx_y) for r in good.collect()] == [(5.0, 3.0)] and snapped.isEmpty()
    assert [r.problem for r in rejected.collect()] == ["outside_tolerance"]


def test_scene_archives(spark, tmp_path):
    grid = np.arange(12.0).reshape(3, 4)
    buf = io.BytesIO()
    np.savez(buf, target_db=grid, receiver_mask=np.ones((3, 4)), building_map=(grid > 9).astype(int), tx_x=1.0, tx_y=2.0, freq_hz=1e9)
    (tmp_path / "a.npz").write_bytes(buf.getvalue())
    index = spark.createDataFrame([(f"{tmp_path}/a.npz", "named", 0.5)], "resolved_path string, sample_id string, resolution_m double")
    cells = rasters.read_scenes(spark, f"{tmp_path}/*.npz", index)
    rows = cells.collect()
    assert len(rows) == 12 and {r.sample_id for r in rows} == {"named"} and {r.scene_id for r in rows} == {"a"}
    assert all(r.path_loss == grid[r.y, r.x] and r.wall == (grid[r.y, r.x] > 9) for r in rows)
    assert (rows[0].tx_x, rows[0].frequency_hz, rows[0].resolution_m, rows[0].transmittance) == (1.0, 1e9, 0.5, None)
    assert rasters.missing_scalars(cells).isEmpty()
    bad = io.BytesIO()
    np.savez(bad, target_db=grid, receiver_mask=np.ones((2, 2)), building_map=grid)
    (tmp_path / "b.npz").write_bytes(bad.getvalue())
    index = spark.createDataFrame([(f"{tmp_path}/b.npz",)], "resolved_path string")
    with pytest.raises(Exception, match="different shapes"):
        rasters.read_scenes(spark, f"{tmp_path}/b.npz", index).collect()


def test_manifest_contract(spark, tmp_path):
    (tmp_path / "m.csv").write_text("scene_id,sample_id,map_path,tx_x,note\ns,a,x.npz,1.5,hi\ns,b,/abs/y.npz,bad,\n")
    rows = manifest.read_manifest(spark, str(tmp_path / "m.csv"), "/data").orderBy("sample_id").collect()
    assert [r.resolved_path for r in rows] == ["/data/x.npz", "/abs/y.npz"] and [r.tx_x for r in rows] == [1.5, None] and rows[0].note == "hi"
    (tmp_path / "n.csv").write_text("scene_id,sample_id\ns,a\n")
    with pytest.raises(ValueError, match="scene_path"):
        manifest.read_manifest(spark, str(tmp_path / "n.csv"), "/data")


def test_survey_union(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Building,Config ID,TX,Rx_ID,Path Loss (dB),Distance [m],Frequency (GHz),LOS/NLOS,Brick Walls,Glass,antenna_height_m\n"
                                      "A,1,t,r1,70,3,3.5,LOS,0,0,1.5\nA,1,t,r2,80,6,,non-los,1,0,1.5\nA,1,t,r3,oops,6,3.6,,1,0,1.5\n")
    (tmp_path / "two.csv").write_text("scenario,tx_id,point_id,pathloss_db,distance_m,wood,column\nB,t,p1,60,2,0,0\nB,t,p2,90,9,2,1\n")
    out = survey.read_campaigns(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    rows = {r.rx_id: r for r in out.collect()}
    assert len(rows) == 5 and out.columns[:3] == ["scenario", "campaign_id", "tx_id"] and out.columns[-3:] == ["antenna_height_m", "frequency_ghz", "source_file"]
    # A header with its unit is no listed frequency name: kept as an extra, the default applies.
    assert (rows["r1"].frequency_hz, rows["r3"].frequency_ghz, rows["p1"].frequency_hz) == (3.5e9, "3.6", 3.5e9)
    assert (rows["r2"].los_nlos, rows["r3"].los_nlos, rows["p1"].los_nlos, rows["p2"].los_nlos) == ("NLOS", None, "LOS", "NLOS")
    assert rows["r3"].measured_path_loss_db is None and rows["p1"].antenna_height_m is None


def test_header_rules():
    assert survey.header_name(" Path Loss (dB) ") == "path_loss_db" and survey.header_name("Humidity %") == "humidity_pct"
    assert survey.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]
    assert campaign.header_key("Coord.") == "coord." and campaign.header_key("Distance (m)") == "distance_m"
    bound, rest = survey.bind_columns(["pl", "path_loss_db", "x"])
    assert bound == {"pl": "measured_path_loss_db"} and rest == ["path_loss_db", "x"]


def test_campaign_cleaning(spark, tmp_path):
    head = "Coord.,Distance (m),Num_brick_wall,Num_wood_wall,Num_glass_wall,Num_drywall,Num_column,P_rx (dBm),PL (dB)"
    for s in ("A", "B"):
        for c in ("C1", "C2"):
            body = [f"{c}-{i},{i + 1},0,0,0,0,0,-60,70" for i in range(3)] + [f"{c}-9,0,0,0,0,0,0,-60,70", f"{c}-8,4,,0,0,0,0,-60,70", f"{c}-7,4,0,0,0,0,0,70,-60"]
            (tmp_path / f"PL_{s}_{c}.csv").write_text("\n".join([head, *body]))
    rows = campaign.load_campaign(spark, str(tmp_path), ("A", "B"))
    assert campaign.duplicate_keys(rows).isEmpty() and {r.elevator for r in rows.collect()} == {0.0}
    kept, rejected = campaign.clean(rows, {"source_file": "PL_A_C2.csv", "coord": "C2-7", "pl_db": -60.0})
    assert kept.count() == 4 * 4 - 1
    reasons = {r.reject_reason: r["count"] for r in rejected.groupBy("reject_reason").count().collect()}
    assert reasons == {"invalid_path_loss_or_distance": 4, "missing_wall_counts": 4, "known_anomaly": 1}
    assert {r.missing_columns for r in rejected.where("reject_reason = 'missing_wall_counts'").collect()} == {"num_brick_wall"}


def test_frequency_by_size(spark):
    df = spark.createDataFrame([("3.5",), ("3.6",), (None,)], "f string")
    assert [r.f for r in cleaning.frequency_hz(df, "f", "carrier").orderBy("f").collect()] == [3.5e9, 3.5e9, 3.6e9]
    assert [r.f for r in cleaning.frequency_hz(df, "f", "f_mhz", 1.0).orderBy("f").collect()] == [1.0, 3.5e6, 3.6e6]


def test_model_names(spark):
    name = runs.model_name("residual_extra", 0.01, 33)
    row = spark.createDataFrame([(name,), ("notes",)], "n string").withColumns(runs.parse_model_name("n")).where("method IS NOT NULL").collect()
    assert [(r.method, r.rate, r.seed) for r in row] == [("residual_extra", 0.01, 33)]


def test_dataset_modes(spark, tmp_path):
    cells = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "sample_id string, task_id int, building_id int")
    folder = str(tmp_path / "out")
    sinks.write_dataset(cells, cells, folder, dry_run=True)
    assert not (tmp_path / "out").exists()
    sinks.write_dataset(cells.where("sample_id = 'a'"), cells.where("sample_id = 'a'"), folder)
    sinks.write_dataset(cells, cells, folder, mode="skip_existing")
    assert sorted(r.sample_id for r in spark.read.parquet(f"{folder}/cells").collect()) == ["a", "b"]


def test_split_errors(spark):
    df = spark.createDataFrame([("a",), ("a",)], "g string")
    with pytest.raises(ValueError, match="missing group column"):
        splits.group_split(df, "nope", 0.5, 1)
    with pytest.raises(ValueError, match="val_ratio"):
        splits.group_split(df, "g", 1.0, 1)
    with pytest.raises(ValueError, match="at least 2"):
        splits.group_split(df, "g", 0.5, 1)
