"""Jobs: configurations as JSON, the rasters they name, and candidates in a folder."""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.operators.deliverables import rank_rasters
from terrazone.operators.rules import CONFIG, faults
from terrazone.sources import geotiff

#: Fields of a configuration; what may be a number, a word or a boolean is text.
CONFIG_SCHEMA = """out_dir string, orthomosaic_path string, multispectral_path string, zones int, offline_basemap string, max_pixels long, reflectance_scale double, band_map map<string,double>,
  red_path string, nir_path string, hotspot_percentile double, hotspot_min_area_m2 double"""
RASTER_SCHEMA = "path string, name string, driver string, crs string, width long, height long, bands int, descriptions array<string>, colours array<string>"


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """job (its file) and the fields of configurations, a JSON object a file; an error names files that hold no object."""
    told = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("job"), F.from_json("value", CONFIG_SCHEMA, {"mode": "PERMISSIVE"}).alias("c"), F.try_parse_json("value").alias("v"))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return told.select(F.when(good, F.col("job")).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.col("job")))).alias("job"), "c.*")


def inspect(spark: SparkSession, paths: Sequence[str] | DataFrame) -> DataFrame:
    """Headers of files, named by a list or by a column path of unique names; the driver is null where a file is missing or no GeoTIFF. Headers alone are read, by tasks."""

    def run(batches):
        for frame in batches:
            rows = []
            for path in frame["path"]:
                try:
                    h = geotiff.header(path)
                    rows.append((path, os.path.basename(path), "GTiff", f"EPSG:{h.epsg}" if h.epsg else None, h.width, h.height, h.bands, h.descriptions, h.colours))
                except (OSError, ValueError):
                    rows.append((path, os.path.basename(path), None, None, None, None, None, None, None))
            frame = frame.iloc[:0].reindex(columns=[c.split()[0] for c in RASTER_SCHEMA.split(", ")])
            for i, row in enumerate(rows):
                frame.loc[i] = list(row)
            yield frame

    if not isinstance(paths, DataFrame):
        files = [p for p in dict.fromkeys(paths) if p]
        paths = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, min(len(files), 64)))
    return paths.select("path").mapInPandas(run, RASTER_SCHEMA)


def config_faults(configs: DataFrame, rasters: DataFrame) -> DataFrame:
    """job, check_id, message: what speaks against configurations, given the headers of the rasters that they name."""
    path = F.coalesce("orthomosaic_path", "multispectral_path")
    told = configs.withColumn("raster_path", path).join(rasters.withColumnRenamed("path", "raster_path"), "raster_path", "left")
    return faults(
        told.select(
            "job", "raster_path", "out_dir", "zones", F.col("offline_basemap").alias("basemap"), "max_pixels", "width", "height", F.col("reflectance_scale").alias("scale"), "driver", "crs",
            (F.col("raster_path").isNotNull()).alias("stacked"), (F.col("red_path").isNotNull() | F.col("nir_path").isNotNull()).alias("separate"), F.col("band_map").isNotNull().alias("band_map_given"), "red_path", "nir_path",
        ),
        ["job"], CONFIG,
    )


def _real(batches):
    """Files among the paths, with the file that each leads to."""
    schema = pa.schema([("path", pa.string()), ("place", pa.int32()), ("real", pa.string())])
    for batch in batches:
        rows = [{**r, "real": os.path.realpath(r["path"])} for r in batch.to_pylist() if os.path.isfile(r["path"])]
        yield pa.RecordBatch.from_pylist(rows, schema)


def discover(spark: SparkSession, folder: str, known: Sequence[str] = (), main: str = "odm_orthophoto.tif") -> DataFrame:
    """Rasters of a folder: those of the known places, then all below it, each once; best first. Files that aren't readable are left out, and those below it whose names begin with a dot or a low line.

    Spark lists the folder and reads no content; tasks follow links and read headers. A file of several names keeps the first known one, else the least.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[tT][iI][fF],[tT][iI][fF][fF]}").load(folder)
    below = listed.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(len(known)).alias("place"))
    named = spark.createDataFrame([(str(Path(folder) / k), i) for i, k in enumerate(known)], "path string, place int")
    told = named.unionByName(below).mapInArrow(_real, "path string, place int, real string")
    single = told.groupBy("real").agg(F.min(F.struct("place", "path"))["path"].alias("path"))
    return rank_rasters(inspect(spark, single).where(F.col("driver").isNotNull()).select("path", "name", "bands"), main)


def rgb_bands(raster: geotiff.Header) -> tuple[int, int, int]:
    """Bands of red, green and blue: by description, else by colour, else the first three (a single band thrice)."""
    names = [(d or "").strip().lower() for d in raster.descriptions]
    for told in (names, raster.colours):
        if all(told.count(c) == 1 for c in ("red", "green", "blue")):
            return tuple(told.index(c) + 1 for c in ("red", "green", "blue"))
    return (1, 2, 3) if raster.bands >= 3 else (1, 1, 1)
