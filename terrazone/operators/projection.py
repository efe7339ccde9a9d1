"""Map projection as Columns, and warping as a join: transverse Mercator by Krueger's series (Karney 2011), web Mercator, bilinear cells; rasters in degrees to UTM."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# WGS 84 and UTM.
A, FLAT, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_ECC = (FLAT * (2 - FLAT)) ** 0.5
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _zone(epsg: Column) -> tuple[Column, Column]:
    """Central meridian in degrees, and the northing of the equator."""
    return (epsg % 100) * 6 - 183.0, F.when(epsg >= 32700, SOUTH).otherwise(0.0)


def utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing of a point in a UTM system (326zz, 327zz)."""
    middle, equator = _zone(epsg)
    phi, lam = F.radians(lat), F.radians(lon - middle)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * _RADIUS * x, equator + SCALE * _RADIUS * y


def utm_inverse(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point in a UTM system."""
    middle, equator = _zone(epsg)
    y, x = (north - equator) / (SCALE * _RADIUS), (east - EAST) / (SCALE * _RADIUS)
    xi, eta = y, x
    for j, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(2 * j * y) * F.cosh(2 * j * x)
        eta = eta - b * F.cos(2 * j * y) * F.sinh(2 * j * x)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return middle + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(F.radians(lat) / 2 + 0.7853981633974483)) * A


def pixel_centre(transform: tuple[float, ...], row: Column, col: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = transform
    return c + a * (col + 0.5) + b * (row + 0.5), f + d * (col + 0.5) + e * (row + 0.5)


def pixel_area(transform: tuple[float, ...]) -> float:
    a, b, _, d, e, _ = transform
    return abs(a * e - b * d)


def is_north_up(transform: tuple[float, ...], tolerance: float = 1e-12) -> bool:
    return abs(transform[1]) <= tolerance and abs(transform[3]) <= tolerance


def metric_system(spark_row: DataFrame) -> DataFrame:
    """epsg of the system that a raster (projected, unit_m, epsg, lon, lat of its centre) is measured in: its own if in metres, else its UTM zone; an error without one."""
    from terrazone.functions.indices import utm_zone

    own = F.col("projected") & (F.abs(F.col("unit_m") - 1) <= 1e-6)
    told = F.coalesce(F.when(own, F.col("epsg")), utm_zone(F.col("lon"), F.col("lat")))
    return spark_row.withColumn("epsg", F.when(told.isNotNull(), told).otherwise(F.raise_error(F.lit("no UTM zone holds the raster's centre")).cast("int")))


def warp(target: DataFrame, source: DataFrame, values: list[str], mask: str | None = None) -> DataFrame:
    """Values at the cells of target (row_idx, col_idx, src_row, src_col: places among the source's cell centres), each the weighted mean of the four cells
    around that have a value; null without any. A mask is that of the nearest cell. One join by cell: four rows a target cell."""
    r, c = F.floor("src_row"), F.floor("src_col")
    near = F.explode(F.array(*[F.struct((r + i).cast("int").alias("r"), (c + j).cast("int").alias("c"), (F.abs(1 - i - (F.col("src_row") - r)) * F.abs(1 - j - (F.col("src_col") - c))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    asked = target.select("row_idx", "col_idx", (F.floor(F.col("src_row") + 0.5)).cast("int").alias("mr"), F.floor(F.col("src_col") + 0.5).cast("int").alias("mc"), near.alias("n")).select("*", "n.*").drop("n")
    cells = source.select(F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), *values, *([mask] if mask else []))
    met = asked.join(cells, ["r", "c"])
    seen = lambda v: F.when(F.col(v).isNotNull() & (F.col("w") > 0), F.col("w"))
    aggs = [F.try_divide(F.sum(F.col(v) * seen(v)), F.sum(seen(v))).alias(v) for v in values]
    if mask:
        aggs.append(F.coalesce(F.bool_or(F.when((F.col("r") == F.col("mr")) & (F.col("c") == F.col("mc")), F.col(mask))), F.lit(False)).alias(mask))
    return met.groupBy("row_idx", "col_idx").agg(*aggs)


@dataclass(frozen=True)
class Grid:
    """Size, system and affine transform (a, b, c, d, e, f) of a raster."""

    rows: int
    cols: int
    transform: tuple[float, ...]
    epsg: int


def target_grid(spark: SparkSession, source: Grid, epsg: int, per_edge: int = 21) -> Grid:
    """The north-up grid of square cells in a UTM system that holds a raster in degrees: its edges are followed by per_edge points each, and a cell is as wide as makes as many of them
    to the diagonal as the raster has."""
    a, b, c, d, e, f = source.transform
    step = F.col("id") % per_edge / (per_edge - 1.0)
    edge = F.floor(F.col("id") / per_edge)
    col = F.when(edge < 2, step).otherwise((edge - 2).cast("double")) * source.cols
    row = F.when(edge < 2, edge.cast("double")).otherwise(step) * source.rows
    x, y = utm(c + a * col + b * row, f + d * col + e * row, F.lit(epsg))
    x0, x1, y0, y1 = spark.range(4 * per_edge).select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    size = math.hypot(x1 - x0, y1 - y0) / math.hypot(source.rows, source.cols)
    return Grid(max(1, math.floor((y1 - y0) / size + 0.5)), max(1, math.floor((x1 - x0) / size + 0.5)), (size, 0.0, x0, 0.0, -size, y1), epsg)


def places(spark: SparkSession, target: Grid, source: Grid, tile: int = 256) -> DataFrame:
    """row_idx, col_idx, src_row, src_col of the cells of target, a UTM grid, whose centres lie on source, a raster in degrees: its cells' centres are at whole places.

    Made by tasks from a range of the source's tiles: each gives the cells of target in the box of its outline, and keeps those whose centre is its own. So the work grows with the
    source's cells, also where a long raster bends away from the grid's columns. A box is wider by an eighth and two cells, as outlines are followed by points.
    """
    a, b, c, d, e, f = source.transform
    ta, _, tc, _, te, tf = target.transform
    high, wide = -(-source.rows // tile), -(-source.cols // tile)
    tiles = spark.range(high * wide).select(F.expr(f"int(id div {wide})").alias("tr"), F.expr(f"int(id % {wide})").alias("tc"))
    told = lambda n, of: (F.greatest(F.lit(0), F.col(n) * tile).cast("double"), F.least(F.lit(of), (F.col(n) + 1) * tile).cast("double"))
    (r0, r1), (c0, c1) = told("tr", source.rows), told("tc", source.cols)
    steps = [i / 8 for i in range(9)]
    outline = [F.struct((r0 + (r1 - r0) * u).alias("r"), (c0 + (c1 - c0) * v).alias("c")) for u in steps for v in steps if u in (0, 1) or v in (0, 1)]
    points = tiles.select("tr", "tc", F.explode(F.array(*outline)).alias("p"))
    x, y = utm(c + a * F.col("p.c") + b * F.col("p.r"), f + d * F.col("p.c") + e * F.col("p.r"), F.lit(target.epsg))
    boxes = points.select("tr", "tc", ((x - tc) / ta).alias("col"), ((y - tf) / te).alias("row"))
    # a tile is a few numbers here and many cells below, so tiles are dealt to a fixed number of tasks
    boxes = boxes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tr", "tc").groupBy("tr", "tc").agg(*[g(n).alias(f"{n}{i}") for n in ("row", "col") for i, g in enumerate((F.min, F.max))])
    span = lambda n, of: F.expr(f"sequence(int(greatest(0, floor({n}0 - ({n}1 - {n}0) / 8 - 2))), int(least({of - 1}, ceil({n}1 + ({n}1 - {n}0) / 8 + 2))))")
    meets = " and ".join(f"{n}1 + ({n}1 - {n}0) / 8 + 2 >= 0 and {n}0 - ({n}1 - {n}0) / 8 - 2 <= {of - 1}" for n, of in (("row", target.rows), ("col", target.cols)))
    cells = boxes.where(meets).select("tr", "tc", F.explode(span("row", target.rows)).alias("row_idx"), span("col", target.cols).alias("cols")).select("tr", "tc", "row_idx", F.explode("cols").alias("col_idx"))
    lon, lat = utm_inverse(*pixel_centre(target.transform, F.col("row_idx"), F.col("col_idx")), F.lit(target.epsg))
    # generated columns: a filter on plain ones would repeat the whole projection for each of its bounds
    told = cells.select("tr", "tc", "row_idx", "col_idx", F.inline(F.array(F.struct((lon - c).alias("x"), (lat - f).alias("y")))))
    det = a * e - b * d
    place = F.struct(((a * F.col("y") - d * F.col("x")) / det - 0.5).alias("src_row"), ((e * F.col("x") - b * F.col("y")) / det - 0.5).alias("src_col"))
    told = told.select("tr", "tc", "row_idx", "col_idx", F.inline(F.array(place)))
    on = (F.col("src_row") >= -0.5) & (F.col("src_row") < source.rows - 0.5) & (F.col("src_col") >= -0.5) & (F.col("src_col") < source.cols - 0.5)
    own = lambda n: F.greatest(F.lit(0.0), F.floor((F.col(n) + 0.5) / tile)) == F.col("tr" if n == "src_row" else "tc")
    return told.where(on & own("src_row") & own("src_col")).select("row_idx", "col_idx", "src_row", "src_col")


def warped(target: DataFrame, source: DataFrame, values: list[str], mask: str | None = None, tile: int = 256) -> DataFrame:
    """What warp gives, for every cell of target: null values and a false mask where nothing is near, missing values where the mask is false. NaN is missing.

    Cells of target and source meet by tiles of the source, a source cell in every tile that has it or its upper or left neighbour: each cell is shuffled about once, not four times.
    """
    tr, tc = (F.floor(F.floor(c) / tile).cast("int") for c in ("src_row", "src_col"))
    asked = target.select("row_idx", "col_idx", "src_row", "src_col", tr.alias("tr"), tc.alias("tc"))
    near = lambda c: F.explode(F.expr(f"sequence(int(floor(({c} - 1) / {tile})), int(floor({c} / {tile})))"))
    cells = source.select(F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), *[F.col(v).cast("double") for v in values], *([F.col(mask).cast("boolean")] if mask else []))
    cells = cells.withColumn("tr", near("r")).withColumn("tc", near("c"))

    def met(key: tuple, ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        top, left = key[0] * tile, key[1] * tile
        at = own["r"].to_numpy() - top, own["c"].to_numpy() - left
        r, c = ask["src_row"].to_numpy(), ask["src_col"].to_numpy()
        r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
        fr, fc = r - r0, c - c0
        out = ask[["row_idx", "col_idx"]].copy()
        held = None
        if mask:
            on = np.zeros((tile + 1, tile + 1), bool)
            on[at] = own[mask].fillna(False).to_numpy(bool)
            held = on[np.floor(r + 0.5).astype(int) - top, np.floor(c + 0.5).astype(int) - left]
        for v in values:
            full = np.full((tile + 1, tile + 1), np.nan)
            full[at] = own[v].to_numpy(float)
            total, weight = np.zeros(len(ask)), np.zeros(len(ask))
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                x, w = full[r0 - top + i, c0 - left + j], (fr if i else 1 - fr) * (fc if j else 1 - fc)
                seen = ~np.isnan(x) & (w > 0)
                total += np.where(seen, w * np.nan_to_num(x), 0.0)
                weight += np.where(seen, w, 0.0)
            good = weight > 0 if held is None else (weight > 0) & held
            out[v] = np.where(good, total / np.where(good, weight, 1.0), np.nan)
        if mask:
            out[mask] = held
        return out

    schema = "row_idx int, col_idx int, " + ", ".join(f"`{v}` double" for v in values) + (f", `{mask}` boolean" if mask else "")
    return asked.groupBy("tr", "tc").cogroup(cells.groupBy("tr", "tc")).applyInPandas(met, schema)


def to_metric(px: DataFrame, source: Grid, values: list[str], mask: str | None = None, tile: int = 256) -> tuple[DataFrame, Grid]:
    """A raster in degrees in the UTM zone of its centre: its cells and their grid. An error where no zone holds the centre."""
    spark = px.sparkSession
    x, y = pixel_centre(source.transform, F.lit((source.rows - 1) / 2), F.lit((source.cols - 1) / 2))
    row = spark.range(1).select(F.lit(False).alias("projected"), F.lit(1.0).alias("unit_m"), F.lit(source.epsg).alias("epsg"), x.alias("lon"), y.alias("lat"))
    target = target_grid(spark, source, metric_system(row).first()["epsg"])
    return warped(places(spark, target, source, tile), px, values, mask, tile), target
