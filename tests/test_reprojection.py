"""Reprojection of rasters over several tiles against numpy, and areas on the ellipsoid against projected and spherical ones."""

from __future__ import annotations

import re
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazone.operators import geometry, projection

SOURCE = projection.Grid(45, 70, (2e-5, 0.0, 10.2, 0.0, -2e-5, 48.1), 4326)


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(4)
    value, held = rng.random((SOURCE.rows, SOURCE.cols)), rng.random((SOURCE.rows, SOURCE.cols)) > 0.2
    value[rng.random(value.shape) < 0.1] = np.nan
    value[10:20, 30:45] = np.nan
    return value, held


def raster(spark, cells):
    value, held = cells
    rows = [(r, c, None if np.isnan(value[r, c]) else float(value[r, c]), bool(held[r, c]), "x") for r in range(SOURCE.rows) for c in range(SOURCE.cols)]
    return spark.createDataFrame(rows, "row_idx int, col_idx int, v double, m boolean, tr string").repartition(3)


def test_target_grid_holds_the_raster(spark):
    grid = projection.target_grid(spark, SOURCE, 32632)
    size, _, x0, _, _, y1 = grid.transform
    a, _, lon, _, e, lat = SOURCE.transform
    corners = spark.createDataFrame([(lon + a * c, lat + e * r) for r in (0, SOURCE.rows) for c in (0, SOURCE.cols)], "lon double, lat double")
    for x, y in corners.select(*projection.utm(F.col("lon"), F.col("lat"), F.lit(32632))).collect():
        assert -1e-6 < x - x0 < (grid.cols + 0.5) * size and -1e-6 < y1 - y < (grid.rows + 0.5) * size
    assert math.hypot(grid.rows, grid.cols) == pytest.approx(math.hypot(SOURCE.rows, SOURCE.cols), rel=0.02) and projection.is_north_up(grid.transform)


@pytest.mark.parametrize("tile", [16, 256])
def test_to_metric_equals_numpy(spark, cells, tile):
    value, held = cells
    told, grid = projection.to_metric(raster(spark, cells), SOURCE, ["v"], "m", tile)
    assert grid.epsg == 32632
    got = {(r.row_idx, r.col_idx): (r.v, r.m) for r in told.collect()}
    places = projection.places(spark, grid, SOURCE).collect()
    assert len(places) == len(got) > 0.8 * grid.rows * grid.cols
    seen = 0
    for p in places:
        r0, c0 = math.floor(p.src_row), math.floor(p.src_col)
        near = [(r, c, (1 - abs(r - p.src_row)) * (1 - abs(c - p.src_col))) for r in (r0, r0 + 1) for c in (c0, c0 + 1) if 0 <= r < SOURCE.rows and 0 <= c < SOURCE.cols]
        near = [(value[r, c], w) for r, c, w in near if not np.isnan(value[r, c]) and w > 0]
        m = bool(held[math.floor(p.src_row + 0.5), math.floor(p.src_col + 0.5)])
        v, told_m = got[p.row_idx, p.col_idx]
        assert told_m == m
        if m and near:
            assert v == pytest.approx(sum(x * w for x, w in near) / sum(w for _, w in near), abs=1e-12)
            seen += 1
        else:
            assert v is None
    assert seen > 1000


def test_empty_raster_and_centre_without_a_zone(spark, cells):
    told, _ = projection.to_metric(raster(spark, cells).limit(0), SOURCE, ["v"], "m")
    rows = told.collect()
    assert rows and all(r.v is None and r.m is False for r in rows)
    with pytest.raises(Exception, match="no UTM zone"):
        projection.to_metric(raster(spark, cells), projection.Grid(10, 10, (1e-5, 0.0, 10.0, 0.0, -1e-5, 89.0), 4326), ["v"])


def hectares(spark, *rings):
    told = spark.createDataFrame([(None if r is None else [[(float(x), float(y)) for x, y in q] for q in r],) for r in rings], "rings array<array<struct<x:double,y:double>>>")
    return [r[0] for r in told.select(geometry.geographic_hectares(F.col("rings"))).collect()]


def test_field_area_equals_projected_area(spark):
    """In UTM areas are too small by the square of the scale, 0.9996 at the middle meridian."""
    field = [(8.999, 48.0), (9.004, 48.001), (9.003, 48.006), (9.001, 48.003), (8.998, 48.005), (8.999, 48.0)]
    hole = [(9.0, 48.001), (9.001, 48.001), (9.001, 48.002), (9.0, 48.001)]
    df = spark.createDataFrame([(x, y) for x, y in field], "lon double, lat double").coalesce(1)
    flat = [tuple(r) for r in df.select(*projection.utm(F.col("lon"), F.col("lat"), F.lit(32632))).collect()]
    plain = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(flat, flat[1:]))) / 2 / 0.9996**2 / 1e4
    whole, less, part = hectares(spark, [field], [field, hole], [hole[::-1]])
    assert whole == pytest.approx(plain, rel=1e-6) and less == pytest.approx(whole - part, rel=1e-9)


def test_antimeridian_poles_and_degenerate_rings(spark):
    here, there, north, south, octant, nothing, null = hectares(
        spark, [[(10, 5), (14, 5), (13, 9), (10, 5)]], [[(178, 5), (-178, 5), (-179, 9), (178, 5)]], [[(x, 60) for x in (0, 1, *range(2, 360), 0)]], [[(x, -60) for x in (0, *range(359, 0, -1), 0)]],
        [[(0, 0), (90, 0), (0, 90), (0, 0)]], [], None,
    )
    globe = 510065621724088.4 / 1e4  # fixed value: square metres of the ellipsoid's surface
    assert there == pytest.approx(here, rel=1e-9) and nothing == 0 and null is None
    cap = spark.range(1).select(geometry.geographic_box_hectares(F.lit(0.0), F.lit(60.0), F.lit(360.0), F.lit(90.0))).first()[0]
    assert north == pytest.approx(south, rel=1e-9) and north == pytest.approx(cap, rel=2e-4)  # sides of a degree bend to the pole
    assert octant == pytest.approx(globe / 8, rel=1e-9)


def test_long_rasters_make_no_more_cells_than_they_have(spark):
    source = projection.Grid(100_000, 3, (1e-5, 0.0, 10.2, 0.0, -1e-5, 48.1), 4326)
    target = projection.target_grid(spark, source, 32632)
    assert target.rows * target.cols > 100 * source.rows * source.cols
    told = projection.places(spark, target, source, 64)
    made = int(re.search(r"Range \(0, (\d+)", told._jdf.queryExecution().optimizedPlan().toString()).group(1))
    assert made <= -(-source.rows // 64)
    found = told.select("row_idx", "col_idx").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_idx", "col_idx").alias("apart")).first()
    metres = 6_370_000.0 * math.radians(1e-5)
    area = source.rows * source.cols * metres * metres * math.cos(math.radians(47.6))
    assert found.n == found.apart and abs(found.n * target.transform[0] ** 2 / area - 1) < 0.02
