"""GeoTIFF in plain Python: headers, windows of rows as a Spark source, and blocks written by tasks.

Files must be readable by every executor at the same path. Strips or tiles, deflate or none, horizontal differences, chunky or planar, classic or big.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Field types of TIFF, as struct codes, and its tags.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, PACKED, COLOURS, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT, SCALE, TIE, KEYS, METADATA, NODATA = 322, 323, 324, 325, 338, 339, 33550, 33922, 34735, 42112, 42113
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass(frozen=True)
class Header:
    path: str
    order: str
    tags: dict = field(repr=False)

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    width = property(lambda self: self.one(WIDTH))
    height = property(lambda self: self.one(HEIGHT))
    bands = property(lambda self: self.one(SAMPLES, 1))
    dtype = property(lambda self: np.dtype(self.order + KINDS[self.one(FORMAT, 1), self.one(BITS, 8)]))

    @property
    def transform(self) -> tuple[float, ...]:
        """a, b, c, d, e, f of the affine map from column and row to x and y."""
        sx, sy = self.tags.get(SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y, _ = self.tags.get(TIE, (0.0,) * 6)[:6]
        return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(KEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        return found.get(3072, found.get(2048))

    @property
    def nodata(self) -> float | None:
        text = self.tags.get(NODATA, "").strip("\0 ")
        return float(text) if text else None

    @property
    def descriptions(self) -> list[str | None]:
        names: list[str | None] = [None] * self.bands
        for item in ElementTree.fromstring(self.tags[METADATA].strip("\0")).iter("Item") if METADATA in self.tags else ():
            if item.get("role") == "description":
                names[int(item.get("sample"))] = item.text
        return names

    @property
    def colours(self) -> list[str]:
        """red, green, blue, alpha or gray by band."""
        rgb = ["red", "green", "blue"] if self.one(COLOURS, 1) == 2 else ["gray"]
        extra = list(self.tags.get(EXTRA, ()))
        plain = (rgb + ["gray"] * self.bands)[: self.bands - len(extra)]
        return plain + ["alpha" if e in (1, 2) else "gray" for e in extra]


def header(path: str) -> Header:
    with open(path, "rb") as f:
        start = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or struct.unpack(order + "H", start[2:4])[0] not in (42, 43):
            raise ValueError(f"{path} is no TIFF")
        big = struct.unpack(order + "H", start[2:4])[0] == 43
        at = struct.unpack(order + "Q", start[8:16])[0] if big else struct.unpack(order + "I", start[4:8])[0]
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size, inline = (20, 8) if big else (12, 4)
        tags = {}
        for entry in [f.read(size) for _ in range(n)]:
            tag, kind = struct.unpack(order + "HH", entry[:4])
            count = struct.unpack(order + ("Q" if big else "I"), entry[4 : size - inline])[0]
            if kind not in TYPES:
                continue
            code = TYPES[kind]
            length = struct.calcsize("=" + code) * count
            raw = entry[size - inline :][:length]
            if length > inline:
                f.seek(struct.unpack(order + ("Q" if big else "I"), entry[size - inline :])[0])
                raw = f.read(length)
            tags[tag] = raw.decode("utf-8", "replace") if code == "s" else struct.unpack(f"{order}{count}{code}" if len(code) == 1 else order + code * count, raw)
    found = Header(path, order, tags)
    if found.one(PACKED, 1) not in (1, 8, 32946):
        raise ValueError(f"{path}: compression {found.one(PACKED)} isn't supported")
    return found


def rows(h: Header, row0: int, row1: int, bands: list[int]) -> np.ndarray:
    """Values of bands (from 1) in some rows: band, row, column. Only the blocks, and of planar files only the bands, that are asked for are read."""
    tiled = TILE_OFFSETS in h.tags
    bw, bh = (h.one(TILE_WIDTH), h.one(TILE_HEIGHT)) if tiled else (h.width, min(h.one(ROWS, h.height), h.height))
    offsets, counts = (h.tags[TILE_OFFSETS], h.tags[TILE_COUNTS]) if tiled else (h.tags[OFFSETS], h.tags[COUNTS])
    across, down = -(-h.width // bw), -(-h.height // bh)
    planar = h.one(PLANAR, 1) == 2 and h.bands > 1
    depth = 1 if planar else h.bands
    out = np.zeros((len(bands), row1 - row0, h.width), h.dtype.newbyteorder("="))
    with open(h.path, "rb") as f:
        for by in range(row0 // bh, -(-row1 // bh)):
            for bx in range(across):
                for plane in [b - 1 for b in bands] if planar else [0]:
                    block = plane * across * down + by * across + bx
                    f.seek(offsets[block])
                    raw = f.read(counts[block])
                    raw = raw if h.one(PACKED, 1) == 1 else zlib.decompress(raw)
                    high = bh if tiled else min(bh, h.height - by * bh)
                    data = np.frombuffer(raw, h.dtype, high * bw * depth).reshape(high, bw, depth).astype(h.dtype.newbyteorder("="))
                    if h.one(PREDICTOR, 1) == 2:
                        data = np.cumsum(data, axis=1, dtype=data.dtype)
                    lo, hi, wide = max(row0, by * bh), min(row1, by * bh + high), min(bw, h.width - bx * bw)
                    for k, b in enumerate(bands):
                        if not planar or b - 1 == plane:
                            out[k, lo - row0 : hi - row0, bx * bw : bx * bw + wide] = data[lo - by * bh : hi - by * bh, :wide, 0 if planar else b - 1]
    return out


def write(path: str, bands: np.ndarray, transform: tuple[float, ...], epsg: int | None = None, nodata: float | None = None, descriptions: list[str] | None = None, alpha: bool = False, block: int = 64) -> None:
    """bands (band, row, column) as a deflated, planar GeoTIFF. Integers can't hold what is missing unless there is a nodata value."""
    if abs(transform[1]) > 1e-12 or abs(transform[3]) > 1e-12:
        raise ValueError("rasters are north-up")
    data = np.ma.filled(bands, nodata) if np.ma.isMaskedArray(bands) and nodata is not None else bands
    if np.ma.isMaskedArray(bands) and nodata is None and bands.mask.any():
        raise ValueError("missing values need a nodata value")
    if data.dtype.kind == "f" and nodata is not None:
        data = np.where(np.isfinite(data), data, nodata).astype(data.dtype)
    depth, height, width = data.shape
    kind = {v: k for k, v in KINDS.items()}[data.dtype.newbyteorder("=").str[1:]]
    blobs = [zlib.compress(np.ascontiguousarray(band[r : r + block].astype(data.dtype.newbyteorder("<"))).tobytes(), 6) for band in data for r in range(0, height, block)]
    ends = 8 + np.cumsum([0, *map(len, blobs)])
    tags = {
        WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [kind[1]] * depth), PACKED: ("H", [8]), COLOURS: ("H", [1]), OFFSETS: ("I", ends[:-1].tolist()), SAMPLES: ("H", [depth]), ROWS: ("I", [block]),
        COUNTS: ("I", [len(b) for b in blobs]), PLANAR: ("H", [2]), FORMAT: ("H", [kind[0]] * depth), SCALE: ("d", [transform[0], -transform[4], 0.0]), TIE: ("d", [0.0, 0.0, 0.0, transform[2], transform[5], 0.0]),
    }
    if depth > 1:
        tags[EXTRA] = ("H", [0] * (depth - 2) + [2 if alpha else 0])
    if epsg is not None:
        geographic = 4000 <= epsg < 5000
        tags[KEYS] = ("H", [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg])
    if nodata is not None:
        tags[NODATA] = ("s", f"{nodata:g}\0".encode())
    if descriptions:
        items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(d)}</Item>' for i, d in enumerate(descriptions) if d)
        tags[METADATA] = ("s", f"<GDALMetadata>{items}</GDALMetadata>\0".encode())
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    entries, more, at = [], b"", int(ends[-1]) + 2 + 12 * len(tags) + 4
    for tag, (code, values) in sorted(tags.items()):
        raw = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        held = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(more))
        if len(raw) > 4:
            more += raw + b"\0" * (len(raw) % 2)
        entries.append(struct.pack("<HHI", tag, codes[code], len(values)) + held)
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", int(ends[-1])) + b"".join(blobs) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0" + more)


@dataclass
class Window(InputPartition):
    row0: int
    row1: int


class GeoTiffSource(DataSource):
    """Options: path, bands as `red=1,nir=4`, alpha (a band's number), step (of rows and columns: a decimated read), rows (of a window)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_pixels"

    def _bands(self) -> dict[str, int]:
        return {k: int(v) for k, v in (p.split("=") for p in self.options["bands"].split(","))}

    def schema(self) -> str:
        return "row_idx int, col_idx int, " + ", ".join(f"{role} double" for role in self._bands()) + ", inside boolean"

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(self.options, self._bands())


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], bands: dict[str, int]):
        self.path, self.bands = options["path"], bands
        self.step, self.size, self.alpha = int(options.get("step", 1)), int(options.get("rows", 256)), int(options.get("alpha", 0))
        self.first, self.last = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of row_idx leave windows out and shorten those at the ends; every filter is still Spark's to apply."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row_idx",):
                if isinstance(f, In):
                    within = [v for v in f.value if v is not None]
                    self._keep(min(within, default=1), max(within, default=0))
                elif isinstance(f, EqualTo):
                    self._keep(f.value, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._keep(f.value + isinstance(f, GreaterThan), None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._keep(0, f.value - isinstance(f, LessThan))
            yield f

    def _keep(self, first: int, last: int | None) -> None:
        self.first = max(self.first, first)
        if last is not None:
            self.last = last if self.last is None else min(self.last, last)

    def partitions(self) -> list[Window]:
        height = header(self.path).height
        end = height if self.last is None else min(height, self.last + 1)
        # one window without rows where none is asked for: a reader without partitions would be asked for all
        return [Window(max(r, self.first), min(r + self.size, end)) for r in range(self.first // self.size * self.size, end, self.size)] or [Window(0, 0)]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        if partition.row0 >= partition.row1:
            return
        h = header(self.path)
        wanted = [*self.bands.values(), *([self.alpha] if self.alpha else [])]
        data = rows(h, partition.row0, partition.row1, wanted).astype(np.float64)
        at = np.arange(partition.row0, partition.row1)
        keep = at % self.step == 0
        data, at, cols = data[:, keep, :: self.step], at[keep], np.arange(0, h.width, self.step)
        inside = np.isfinite(data[-1]) & (data[-1] > 0) if self.alpha else np.ones(data.shape[1:], bool)
        found = {"row_idx": np.repeat(at, len(cols)).astype(np.int32), "col_idx": np.tile(cols, len(at)).astype(np.int32)}
        for k, role in enumerate(self.bands):
            missing = ~np.isfinite(data[k]) | (data[k] == h.nodata if h.nodata is not None else False)
            found[role] = pa.array(data[k].ravel(), mask=missing.ravel())
        yield pa.RecordBatch.from_pydict({**found, "inside": inside.ravel()})


def scan(spark: SparkSession, path: str, bands: Mapping[str, int], alpha: int | None = None, step: int = 1) -> DataFrame:
    """Pixels of a stacked raster: row_idx, col_idx, a column for each role, inside (alpha over 0). Missing and non-finite values are null.

    Of a filter on row_idx the bounds reach the reader, so that only the windows between them are read. Allows filters for Python sources in the session.
    """
    h = header(path)
    bad = {r: b for r, b in bands.items() if not 1 <= b <= h.bands}
    if bad or len(set(bands.values())) < len(bands):
        raise ValueError(f"bands are distinct and 1 to {h.bands}: {dict(bands)}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses a reader that takes filters without it
    spark.dataSource.register(GeoTiffSource)
    told = spark.read.format("geotiff_pixels").option("path", path).option("bands", ",".join(f"{r}={b}" for r, b in bands.items())).option("step", step)
    return (told.option("alpha", alpha) if alpha else told).load()


def preview_step(h: Header, most: int = 1600) -> int:
    """The step of a decimated read of at most so many rows and columns."""
    return max(1, -(-max(h.width, h.height) // most))


def scan_inputs(spark: SparkSession, stacked: str | None = None, bands: Mapping[str, int] | None = None, separate: Mapping[str, str] | None = None, footprint: str | None = None) -> DataFrame:
    """Pixels of one stacked raster, or of one raster a role, whose first band is read; within a footprint mask where there is one. All grids must be equal."""
    separate = {r: p for r, p in (separate or {}).items() if p}
    if bool(stacked) == bool(separate):
        raise ValueError("inputs are stacked or separate")
    if stacked:
        first, px = header(stacked), scan(spark, stacked, bands or {})
    else:
        first, px = header(next(iter(separate.values()))), None
        for role, path in separate.items():
            same_grid(first, header(path))
            one = scan(spark, path, {role: 1}).drop("inside")
            px = one if px is None else px.join(one, ["row_idx", "col_idx"])
        px = px.withColumn("inside", F.lit(True))
    if footprint:
        same_grid(first, header(footprint))
        mask = scan(spark, footprint, {"mask": 1}).where(F.col("mask") > 0).select("row_idx", "col_idx")
        px = px.join(mask, ["row_idx", "col_idx"], "left_semi")
    return px


def same_grid(a: Header, b: Header) -> None:
    for what, x, y in (("shape", (a.height, a.width), (b.height, b.width)), ("transform", a.transform, b.transform), ("reference system", a.epsg, b.epsg)):
        if x != y:
            raise ValueError(f"{b.path}: its {what} is {y}, not {x}")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]  # name, row0, pixels


class GeoTiffSink(DataSource):
    """Rows (block, row_idx, col_idx, v), sorted by block, as a file for each block. Tasks write to a folder of the job's own; what the job commits is moved to its place.

    A task that fails, is tried again or runs twice leaves nothing behind: only the files that committed attempts name are moved, and the folder goes, committed or aborted.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff_blocks"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return GeoTiffWriter(self.options)


class GeoTiffWriter(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str]):
        told = json.loads(options["plan"])
        self.folder, self.value, self.width, self.height, self.rows_each = (told[k] for k in ("folder", "value", "width", "height", "rows_each"))
        self.transform, self.epsg, self.nodata, self.dtype = tuple(told["transform"]), told["epsg"], told["nodata"], np.dtype(told["dtype"])
        self.staging = f"{self.folder}/_staging-{told['job']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        files, block, held, some = [], None, None, 0

        def close() -> None:
            if block is not None:
                name, row0 = f"{uuid.uuid4().hex}.tif", block * self.rows_each
                a, b, c, d, e, f = self.transform
                write(f"{self.staging}/{name}", held.astype(self.dtype)[None], (a, b, c + b * row0, d, e, f + e * row0), self.epsg, self.nodata, [self.value])
                files.append((name, row0, some))

        for batch in iterator:
            blocks, at, col, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "row_idx", "col_idx", "v"))
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if blocks[lo] != block:
                    close()
                    block, some = int(blocks[lo]), 0
                    missing = self.nodata if self.nodata is not None else np.nan if self.dtype.kind == "f" else 0
                    held = np.full((min(self.rows_each, self.height - block * self.rows_each), self.width), missing, np.float64)
                good = np.isfinite(v[lo:hi])
                held[at[lo:hi][good] - block * self.rows_each, col[lo:hi][good]] = v[lo:hi][good]
                some += int(good.sum())
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        told = []
        for name, row0, some in sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]):
            path = f"{self.folder}/{self.value}-{row0 // self.rows_each:06d}.tif"
            os.replace(f"{self.staging}/{name}", path)
            told.append({"path": path, "row0": row0, "pixels": some})
        shutil.rmtree(self.staging, ignore_errors=True)  # of attempts that came second
        with open(f"{self.folder}/{self.value}-blocks.json", "w") as f:  # a line a file
            f.writelines(json.dumps(t) + "\n" for t in told)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def write_blocks(px: DataFrame, value: str, folder: str, width: int, height: int, transform: tuple[float, ...], epsg: int, nodata: float | None = None, dtype: str = "f4", rows_each: int = 1024) -> DataFrame:
    """Files of some rows each, written by the tasks into a shared folder, all of them or none; returns path, row0 and pixels of each. Missing cells are nodata.

    A task holds one block at a time. Tasks that are still running when the job is aborted may write into its staging folder afterwards, never beside it.
    """
    if np.dtype(dtype).kind in "iu" and nodata is None:
        px = px.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.lit("missing values need a nodata value")).cast("double")).otherwise(F.col(value)))
    dealt = px.select(F.floor(F.col("row_idx") / rows_each).cast("int").alias("block"), F.col("row_idx").cast("int"), F.col("col_idx").cast("int"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"))
    spark = px.sparkSession
    spark.dataSource.register(GeoTiffSink)
    plan = {"folder": folder, "value": value, "width": width, "height": height, "rows_each": rows_each, "transform": [float(x) for x in transform], "epsg": epsg, "nodata": nodata, "dtype": dtype, "job": uuid.uuid4().hex}
    dealt.repartition("block").sortWithinPartitions("block").write.format("geotiff_blocks").option("plan", json.dumps(plan)).mode("append").save()
    return spark.read.schema("path string, row0 int, pixels long").json(f"{folder}/{value}-blocks.json")
