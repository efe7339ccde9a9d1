"""Archives, tile sets, boundaries, previews and reports as files, written and read back."""

from __future__ import annotations

import hashlib
import math
import os
import shutil
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.operators.deliverables import unsafe_members, world_file
from terrazone.operators.geometry import overlaps
from terrazone.operators.rules import PACKAGE, UPLOAD_BYTES, UPLOAD_RATIO, faults
from terrazone.sources import geotiff

# What a rate package must hold, and the most that is copied along.
MEMBERS = (
    "DJI/Shapefile/application_boundary.shp", "DJI/Shapefile/application_boundary.shx", "DJI/Shapefile/application_boundary.dbf", "DJI/Shapefile/application_boundary.prj",
    "DJI/Rx/application_rate.tif", "DJI/Rx/application_rate.tfw",
)
COMPANION_BYTES, CHUNK = 250_000_000, 1 << 20


def sha256(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(CHUNK):
            found.update(part)
    return found.hexdigest()


def save_upload(chunks: Iterable[bytes], path: str, most: int = UPLOAD_BYTES) -> int:
    """Write an upload as it comes; what is over the bound is an error, and no part of it stays."""
    if not path.lower().endswith((".tif", ".tiff", ".zip")):
        raise ValueError("an upload is a .tif, .tiff or .zip")
    size = 0
    try:
        with open(path, "wb") as f:
            for part in chunks:
                size += len(part)
                if size > most:
                    raise ValueError("the upload is too large")
                f.write(part)
    except BaseException:
        os.unlink(path)
        raise
    return size


def members(spark: SparkSession, path: str) -> DataFrame:
    """archive, seq, name, file_size, compress_size, mode of an archive's members."""
    with zipfile.ZipFile(path) as z:
        found = [(path, i, m.filename, m.file_size, m.compress_size, m.external_attr >> 16) for i, m in enumerate(z.infolist())]
    return spark.createDataFrame(found, "archive string, seq int, name string, file_size long, compress_size long, mode int")


def extract(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Unpack an archive all of whose members are safe; no byte is written otherwise."""
    bad = unsafe_members(members(spark, path)).collect()  # at most as many rows as an archive has members
    if bad:
        raise ValueError(f"unsafe members {[(r.seq, r.problem) for r in bad]}")
    with zipfile.ZipFile(path) as z:
        for m in z.infolist():
            if m.is_dir():
                continue
            to = Path(folder) / m.filename.replace("\\", "/")
            to.parent.mkdir(parents=True, exist_ok=True)
            left = m.file_size
            with z.open(m) as source, open(to, "wb") as out:
                while part := source.read(CHUNK):
                    left -= len(part)
                    if left < 0:
                        raise ValueError(f"{m.filename} is larger than it says")
                    out.write(part)
        return [m.filename for m in z.infolist() if not m.is_dir()]


def extract_raster(path: str, member: str, to: str) -> None:
    """One raster of an uploaded archive, within the bounds of uploads."""
    with zipfile.ZipFile(path) as z:
        m = z.getinfo(member)
        if m.file_size > UPLOAD_RATIO * max(1, m.compress_size):
            raise ValueError("the raster is packed too tightly")
        with z.open(m) as source:
            save_upload(iter(lambda: source.read(CHUNK), b""), to)


def pack(folder: str, path: str, leave_out: Sequence[str] = ()) -> list[str]:
    """All files of a folder as an archive, members in order of path."""
    found = sorted(p.relative_to(folder).as_posix() for p in Path(folder).rglob("*") if p.is_file())
    found = [p for p in found if p not in leave_out]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for name in found:
            z.write(Path(folder) / name, name)
    return found


def copy_companion(path: str, folder: str, most: int = COMPANION_BYTES) -> bool:
    """Copy a file along unless it is too large."""
    if os.path.getsize(path) > most:
        return False
    shutil.copy(path, folder)
    return True


def clear(folder: str, keep: str, faults: Sequence[str]) -> None:
    """Empty an output folder, only once all checks are passed, and never one that holds the input."""
    if faults:
        raise ValueError("; ".join(faults))
    if Path(keep).resolve().is_relative_to(Path(folder).resolve()):
        raise ValueError("the output folder holds the input")
    for item in Path(folder).iterdir() if os.path.isdir(folder) else ():
        shutil.rmtree(item) if item.is_dir() else item.unlink()
    os.makedirs(folder, exist_ok=True)


# -- boundaries ----------------------------------------------------------------------------------------


def write_shapefile(path: str, polygons: Sequence[tuple[str, list[list[tuple[float, float]]]]], crs: str) -> None:
    """(name, rings) as .shp, .shx, .dbf and .prj beside each other; path without suffix. Outer rings run with the clock."""
    records, at, box = [], 50, [math.inf, math.inf, -math.inf, -math.inf]
    for number, (_, rings) in enumerate(polygons, 1):
        turned = []
        for i, ring in enumerate(rings):
            area = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:]))
            turned.append(ring if (area < 0) == (i == 0) else ring[::-1])
        points = [p for r in turned for p in r]
        xs, ys = zip(*points)
        one = (min(xs), min(ys), max(xs), max(ys))
        box = [min(box[0], one[0]), min(box[1], one[1]), max(box[2], one[2]), max(box[3], one[3])]
        starts = np.cumsum([0, *map(len, turned)])[:-1].tolist()
        body = struct.pack("<i4d2i", 5, *one, len(turned), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        records.append((struct.pack(">2i", number, len(body) // 2) + body, at, len(body) // 2))
        at += 4 + len(body) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *(box if records else [0.0] * 4), 0, 0, 0, 0)
    Path(f"{path}.shp").write_bytes(head(at) + b"".join(r for r, *_ in records))
    Path(f"{path}.shx").write_bytes(head(50 + 4 * len(records)) + b"".join(struct.pack(">2i", a, n) for _, a, n in records))
    rows = b"".join(b" " + name.encode()[:64].ljust(64) for name, _ in polygons)
    Path(f"{path}.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 100, 1, 1, len(polygons), 65, 65) + b"name".ljust(11, b"\0") + b"C" + struct.pack("<I2B14x", 0, 64, 0) + b"\r" + rows + b"\x1a")
    Path(f"{path}.prj").write_text(crs)


def read_shapefile(path: str) -> list[tuple[str, list[list[tuple[float, float]]]]]:
    """(name, rings) of a file of polygons."""
    data, names, found, at = Path(f"{path}.shp").read_bytes(), Path(f"{path}.dbf").read_bytes(), [], 100
    first, width = struct.unpack("<2H", names[8:12])
    while at < len(data):
        n = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + n]
        parts, points = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts :])
        xy = list(zip(flat[::2], flat[1::2]))
        row = names[first + len(found) * width :][:width]
        found.append((row[1:].decode().rstrip(), [xy[a:b] for a, b in zip(starts, starts[1:])]))
        at += 8 + n
    return found


# -- pictures and tile sets ---------------------------------------------------------------------------


def png(pixels: np.ndarray) -> bytes:
    """An image of bytes (row, column, 3 or 4) as PNG."""
    height, width, depth = pixels.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + np.ascontiguousarray(line, np.uint8).tobytes() for line in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, {3: 2, 4: 6}[depth], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def tiles(px: DataFrame, side: int = 256) -> DataFrame:
    """zoom_level, tile_column, tile_row (from below, as tile sets count), tile_data of pixels (zoom, x, y from above, red, green, blue, alpha as bytes); a task a tile."""

    def run(group: pa.Table) -> pa.Table:
        zoom, tx, ty = (group.column(c)[0].as_py() for c in ("zoom", "tx", "ty"))
        image = np.zeros((side, side, 4), np.uint8)
        at = group.column("y").to_numpy() % side, group.column("x").to_numpy() % side
        for k, c in enumerate(("red", "green", "blue", "alpha")):
            image[at[0], at[1], k] = group.column(c).to_numpy()
        image[image[:, :, 3] == 0] = 0
        return pa.table({"zoom_level": pa.array([zoom], pa.int32()), "tile_column": pa.array([tx], pa.int32()), "tile_row": pa.array([(1 << zoom) - 1 - ty], pa.int32()), "tile_data": [png(image)]})

    place = px.select("*", F.floor(F.col("x") / side).cast("int").alias("tx"), F.floor(F.col("y") / side).cast("int").alias("ty"))
    return place.groupBy("zoom", "tx", "ty").applyInArrow(run, "zoom_level int, tile_column int, tile_row int, tile_data binary")


def coarser(px: DataFrame) -> DataFrame:
    """The pixels of the next lower zoom: means of two by two, over those that are seen."""
    seen = F.col("alpha") > 0
    mean = lambda c: F.coalesce(F.bround(F.avg(F.when(seen, F.col(c)))).cast("int"), F.lit(0)).alias(c)
    return px.groupBy((F.col("zoom") - 1).alias("zoom"), F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(mean("red"), mean("green"), mean("blue"), F.max("alpha").alias("alpha"))


def write_mbtiles(path: str, metadata: dict[str, str], found: DataFrame) -> int:
    """A tile set of tiles(); the database is one file, so its rows pass the driver one by one. Metadata of equal names is replaced."""
    count = 0
    with sqlite3.connect(path) as db:
        db.execute("create table if not exists metadata (name text primary key, value text)")
        db.execute("create table if not exists tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob, primary key (zoom_level, tile_column, tile_row))")
        db.executemany("insert or replace into metadata values (?, ?)", sorted(metadata.items()))
        for r in found.toLocalIterator():
            db.execute("insert or replace into tiles values (?, ?, ?, ?)", (r.zoom_level, r.tile_column, r.tile_row, bytes(r.tile_data)))
            count += 1
    db.close()
    return count


def read_mbtiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """metadata (name, value) and tiles (zoom_level, tile_column, tile_row, tile_data), read by tasks, a zoom each."""
    db = sqlite3.connect(path)
    tables = {r[0] for r in db.execute("select name from sqlite_master where type in ('table', 'view')")}
    if not {"metadata", "tiles"} <= tables:
        raise ValueError("a tile set has the tables metadata and tiles")
    metadata, zooms = db.execute("select name, value from metadata").fetchall(), db.execute("select distinct zoom_level from tiles").fetchall()
    db.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(path) as own:
            for batch in batches:
                for zoom in batch.column("zoom").to_pylist():
                    rows = own.execute("select zoom_level, tile_column, tile_row, tile_data from tiles where zoom_level = ?", (zoom,))
                    while part := rows.fetchmany(256):
                        z, x, y, data = zip(*part)
                        yield pa.RecordBatch.from_pydict({"zoom_level": pa.array(z, pa.int32()), "tile_column": pa.array(x, pa.int32()), "tile_row": pa.array(y, pa.int32()), "tile_data": pa.array(data, pa.binary())})

    asked = spark.createDataFrame(zooms, "zoom int").repartition(max(1, len(zooms)))
    return spark.createDataFrame(metadata, "name string, value string"), asked.mapInArrow(run, "zoom_level int, tile_column int, tile_row int, tile_data binary")


def preview(bands: Sequence[np.ndarray]) -> bytes:
    """A PNG of one or three decimated bands, stretched from their 2nd to their 98th percentile; one band is gray."""
    out = []
    for x in bands:
        good = np.isfinite(x)
        lo, hi = np.percentile(x[good], (2, 98)) if good.any() else (0.0, 1.0)
        out.append(np.where(good, np.clip((x - lo) * 255 / ((hi - lo) or 1.0), 0, 255), 0).astype(np.uint8))
    return png(np.stack(out * 3 if len(out) == 1 else out, axis=-1))


def pdf(lines: Sequence[str], per_page: int = 56) -> bytes:
    """Lines of text as pages; characters outside Latin-1 are question marks."""
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))) + b"]/Count %d>>" % len(pages), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    for i, page in enumerate(pages):
        quoted = [t.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for t in page]
        body = b"BT /F1 10 Tf 50 800 Td 13 TL " + b" ".join(b"(%s) Tj T*" % t for t in quoted) + b" ET"
        objects += [b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (5 + 2 * i), b"<</Length %d>>stream\n%s\nendstream" % (len(body), body)]
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, table, len(at) + 1, len(out))


# -- rate packages ------------------------------------------------------------------------------------


def write_rate_package(spark: SparkSession, zones: DataFrame, epsg: int, folder: str, path: str, resolution: float | None = None) -> list[str]:
    """Boundary and rate raster of zones (zone_id, rate, x0, y0, x1, y1 in metres) as an archive, which is then read back and must be sound.

    The raster has a pixel's rate where its centre lies in a zone. It and the boundary are files of one field, so zones pass the driver.
    """
    boxes = zones.select("zone_id", F.col("rate").cast("double"), "x0", "y0", "x1", "y1").orderBy("zone_id").collect()
    if not boxes or any(b.rate is None or not math.isfinite(b.rate) for b in boxes):
        raise ValueError("a package needs zones, each with a rate")
    if not overlaps(zones.withColumnRenamed("zone_id", "id")).isEmpty():
        raise ValueError("zones overlap")
    x0, y0, x1, y1 = min(b.x0 for b in boxes), min(b.y0 for b in boxes), max(b.x1 for b in boxes), max(b.y1 for b in boxes)
    size = resolution or max(0.05, min(0.25, math.sqrt(max(sum((b.x1 - b.x0) * (b.y1 - b.y0) for b in boxes), 1.0) / 250_000)))
    if size <= 0:
        raise ValueError("the resolution is positive")
    width, height = max(1, math.ceil((x1 - x0) / size)), max(1, math.ceil((y1 - y0) / size))
    raster = np.full((height, width), -9999.0, "f4")
    xs, ys = x0 + size * (np.arange(width) + 0.5), y1 - size * (np.arange(height) + 0.5)
    for b in boxes:
        rows, cols = np.flatnonzero((ys > b.y0) & (ys <= b.y1)), np.flatnonzero((xs >= b.x0) & (xs < b.x1))
        raster[np.ix_(rows, cols)] = b.rate
    base = Path(folder) / "DJI"
    for part in ("Shapefile", "Rx"):
        (base / part).mkdir(parents=True, exist_ok=True)
    rings = [(str(b.zone_id), [[(b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1), (b.x0, b.y0)]]) for b in boxes]
    write_shapefile(str(base / "Shapefile" / "application_boundary"), rings, f"EPSG:{epsg}")
    at = (size, 0.0, x0, 0.0, -size, y1)
    geotiff.write(str(base / "Rx" / "application_rate.tif"), raster[None], at, epsg, -9999.0, ["TargetRate"])
    (base / "Rx" / "application_rate.tfw").write_text(world_file(*at))
    names = pack(folder, path, ["package_manifest.json"])
    broken = [r.message for r in package_faults(spark, path, folder + "-read").collect()]  # a row a rule
    if broken:
        raise ValueError("; ".join(broken))
    return names


def read_package(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """One row of what an archive holds: members, features, reference systems, pixels, least and largest rate, areas."""
    names = extract(spark, path, folder)
    shape, tif = Path(folder) / MEMBERS[0].removesuffix(".shp"), Path(folder) / MEMBERS[4]
    polygons = read_shapefile(str(shape)) if Path(f"{shape}.shp").exists() else []
    area = sum(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2 * (-1 if i else 1) for _, rings in polygons for i, ring in enumerate(rings))
    crs = Path(f"{shape}.prj").read_text() if Path(f"{shape}.prj").exists() else None
    system, pixels, lo, hi, covered = None, 0, None, None, 0.0
    if tif.exists():
        h = geotiff.header(str(tif))
        rates = geotiff.rows(h, 0, h.height, [1])[0]
        good = rates[np.isfinite(rates) & (rates != h.nodata)]
        system, pixels, covered = f"EPSG:{h.epsg}" if h.epsg else None, len(good), len(good) * abs(h.transform[0] * h.transform[4])
        lo, hi = (float(good.min()), float(good.max())) if len(good) else (None, None)
    row = (path, len(set(MEMBERS) & set(names)), len(polygons), crs, system, pixels, lo, hi, float(area), float(covered))
    return spark.createDataFrame([row], "package string, members int, features int, boundary_crs string, raster_crs string, pixels long, least double, most double, polygon_area double, raster_area double")


def package_faults(spark: SparkSession, path: str, folder: str) -> DataFrame:
    return faults(read_package(spark, path, folder), ["package"], PACKAGE)
