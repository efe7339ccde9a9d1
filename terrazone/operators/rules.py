"""Checks as tables of rules: every fault of every row at once, instead of the first."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
ROLES = ("red", "green", "blue", "nir", "red_edge")
FORMATS, RESAMPLINGS = ("PNG", "JPEG", "WEBP"), ("nearest", "bilinear", "cubic", "average", "lanczos")
MAX_ZOOM, UPLOAD_BYTES, UPLOAD_RATIO = 24, 20 << 30, 1000
FIELD_PIXELS, STEADY_PIXELS = 20, 500


class Rule(NamedTuple):
    """broken is SQL of the row's columns, true where the rule is broken; null is not broken."""

    id: str
    broken: str
    message: str


def faults(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """keys, check_id and message for each rule that a row breaks."""
    found = F.array(*[F.when(F.expr(r.broken), F.struct(F.lit(r.id).alias("check_id"), F.lit(r.message).alias("message"))) for r in rules])
    return df.select(*keys, F.inline(F.array_compact(found)))


def checks(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """check_id, rows that break it, ok and message, one row for each rule."""
    counts = df.agg(*[F.count_if(F.coalesce(F.expr(r.broken), F.lit(False))).alias(r.id) for r in rules])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(r.id).alias("check_id"), F.col(r.id).alias("rows"), (F.col(r.id) == 0).alias("ok"), F.lit(r.message).alias("message")) for r in rules])))


def demand(df: DataFrame, rules: Sequence[Rule]) -> None:
    """An error that names all rules that some row breaks."""
    broken = [r.message for r in checks(df, rules).where(~F.col("ok")).collect()]  # a row a rule
    if broken:
        raise ValueError("; ".join(broken))


def sql(rules: Sequence[Rule], table: str, keys: Sequence[str]) -> str:
    """The faults of a table as SQL text, for engines without these functions."""
    names = ", ".join(keys)
    return " union all ".join(f"select {names}, '{r.id}' as check_id, '{r.message}' as message from {table} where {r.broken}" for r in rules)


def _listed(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _rate(x: str) -> str:
    return f"({x} is not null and ({x} < 0 or isnan({x}) or {x} = cast('infinity' as double)))"


def _blank(x: str) -> str:
    return f"(coalesce(trim({x}), '') = '')"


_PHYSICAL, _RELATIVE = "mode = 'physical'", "mode = 'relative'"
_EXPLICIT = "strategy = 'explicit_by_zone'"
_GIVEN = " or ".join(f"{c} is not null" for c in ("operation", "product_name", "rate_basis", "unit", "min_rate", "max_rate", "zones_given", "equipment_min_rate", "equipment_max_rate", "approved_by"))
# Names that plans may hold.
OPERATIONS = ("fertilizer", "seeding", "spray", "spread")
BASES = ("active_ingredient", "nutrient", "product")
TOTAL_UNITS = {"KG_HA": "KG", "L_HA": "L", "SEEDS_HA": "SEEDS"}
UNITS = (*TOTAL_UNITS, "LB_AC", "GAL_AC")

#: Rate plans. zones_given: number of zones with a rate, null without rates by zone; zones_odd, rates_odd: those whose number or rate is bad.
PLAN = (
    Rule("plan_mode", "mode is null or mode not in ('relative', 'physical')", "mode is relative or physical"),
    Rule("plan_strategy", "strategy is null or strategy not in ('direct', 'inverse', 'explicit_by_zone', 'target_hotspots')", "strategy is direct, inverse, explicit_by_zone or target_hotspots"),
    Rule("relative_fields", f"{_RELATIVE} and ({_GIVEN})", "a relative plan gives no rates, units, product or approval"),
    Rule("relative_explicit", f"{_RELATIVE} and {_EXPLICIT}", "a relative plan has no rates by zone"),
    Rule("plan_operation", f"{_PHYSICAL} and (operation is null or operation not in ({_listed(OPERATIONS)}))", "operation is fertilizer, seeding, spray or spread"),
    Rule("plan_basis", f"{_PHYSICAL} and (rate_basis is null or rate_basis not in ({_listed(BASES)}))", "rate_basis is active_ingredient, nutrient or product"),
    Rule("plan_unit", f"{_PHYSICAL} and (unit is null or upper(unit) not in ({_listed(UNITS)}))", "unit is a unit of product by area"),
    Rule("plan_product", f"{_PHYSICAL} and {_blank('product_name')}", "product_name is needed"),
    Rule("plan_approval", f"{_PHYSICAL} and {_blank('approved_by')}", "approved_by is needed"),
    Rule("equipment_least", _rate("equipment_min_rate"), "equipment_min_rate is finite and non-negative"),
    Rule("equipment_most", _rate("equipment_max_rate"), "equipment_max_rate is finite and non-negative"),
    Rule("equipment_order", "equipment_max_rate < equipment_min_rate", "equipment bounds are in order"),
    Rule("explicit_zones", f"{_PHYSICAL} and {_EXPLICIT} and coalesce(zones_given, 0) = 0", "rates by zone are needed"),
    Rule("explicit_bounds", f"{_PHYSICAL} and {_EXPLICIT} and (min_rate is not null or max_rate is not null)", "rates by zone exclude min_rate and max_rate"),
    Rule("explicit_numbers", "zones_odd > 0", "zones are named by whole numbers"),
    Rule("explicit_rates", "rates_odd > 0", "rates by zone are finite and non-negative"),
    Rule("bounds_zones", f"{_PHYSICAL} and strategy <> 'explicit_by_zone' and zones_given is not null", "rates by zone need strategy explicit_by_zone"),
    Rule("bounds_needed", f"{_PHYSICAL} and strategy <> 'explicit_by_zone' and (min_rate is null or max_rate is null)", "min_rate and max_rate are needed"),
    Rule("bounds_least", _rate("min_rate"), "min_rate is finite and non-negative"),
    Rule("bounds_most", _rate("max_rate"), "max_rate is finite and non-negative"),
    Rule("bounds_order", "max_rate < min_rate", "max_rate is at least min_rate"),
)

_NUMBER = "try_cast({0} as double)"
#: Job configurations, as text where text may come. Booleans, zones and limits are parsed here.
CONFIG = (
    Rule("raster_given", _blank("raster_path"), "a raster is needed"),
    Rule("zones_range", "coalesce(zones, 3) < 2 or coalesce(zones, 3) > 8", "zones is 2 to 8"),
    Rule("zones_named", "zones between 6 and 8", "more than five zones have no names"),
    Rule("basemap_boolean", "basemap is not null and lower(trim(basemap)) not in ('1', 'true', 'yes', 'on', '0', 'false', 'no', 'off', '')", "basemap is a boolean"),
    Rule("max_pixels", "max_pixels <= 0", "max_pixels is positive"),
    Rule("pixel_limit", "max_pixels > 0 and width * height > max_pixels", "the raster has more pixels than max_pixels"),
    Rule("scale_positive", "scale is not null and (scale <= 0 or isnan(scale) or scale = cast('infinity' as double))", "a reflectance scale is finite and positive"),
    Rule("driver", "driver is null or driver <> 'GTiff'", "the raster is a GeoTIFF"),
    Rule("crs", _blank("crs"), "the raster has a coordinate reference system"),
    Rule("output_apart", "raster_path like concat(out_dir, '/%')", "the output folder does not hold the raster"),
    Rule("one_input", "stacked and separate", "inputs are stacked or separate"),
    Rule("map_needs_stack", "band_map_given and not stacked", "a band map needs a stacked raster"),
    Rule("bands_apart", "red_path = nir_path", "red and nir are different files"),
)
#: Rasters that are read together, against the first: shape, transform and reference system.
TOGETHER = (
    Rule("shape", "height <> height0 or width <> width0", "shapes are equal"),
    Rule("transform", " or ".join(f"{c} <> {c}0" for c in "abcdef"), "transforms are equal"),
    Rule("reference", "crs <> crs0", "reference systems are equal"),
    Rule("north_up", "abs(b) > 1e-12 or abs(d) > 1e-12", "rasters are north-up"),
    Rule("metric", "not projected or abs(unit_m - 1) > 1e-6", "a rate grid needs a projected system in metres"),
    Rule("alpha_role", "colour = 'alpha'", "an alpha band is no spectral band"),
    Rule("other_role", "described <> role", "a band described as another role is refused"),
)
#: Tile sets to be written.
BASEMAP = (
    Rule("auto_zoom", f"max_auto_zoom < 0 or max_auto_zoom > {MAX_ZOOM}", "max_auto_zoom is 0 to 24"),
    Rule("zooms", f"min_zoom < 0 or max_zoom > {MAX_ZOOM} or min_zoom > max_zoom", "zooms are in order and 0 to 24"),
    Rule("tile_format", f"upper(tile_format) not in ({_listed(FORMATS)})", "tiles are PNG, JPEG or WEBP"),
    Rule("quality", "quality < 1 or quality > 100", "quality is 1 to 100"),
    Rule("resampling", f"lower(resampling) not in ({_listed(RESAMPLINGS)})", "the resampling is known"),
    Rule("source_size", "width <= 0 or height <= 0", "the source has pixels"),
    Rule("source_limit", "width * height > max_source_pixels", "the source has more pixels than allowed"),
    Rule("output_limit", "output_bytes > max_output_bytes", "the tile set is larger than allowed"),
)
#: Uploads.
UPLOAD = (
    Rule("suffix", "not (lower(name) like '%.tif' or lower(name) like '%.tiff' or lower(name) like '%.zip')", "an upload is a .tif, .tiff or .zip"),
    Rule("bytes", f"file_size > {UPLOAD_BYTES}", "an upload has at most 20 GiB"),
    Rule("ratio", f"file_size > cast({UPLOAD_RATIO} as bigint) * compress_size", "an upload is packed at most 1000 to 1"),
)
#: Finished prescriptions, row by row; ids: rows that share the zone id.
PRESCRIPTION = (
    Rule("zone_number", "zone_id is null or zone_id <> round(zone_id)", "zone ids are whole numbers"),
    Rule("zone_repeats", "ids > 1", "zone ids are unique"),
    Rule("rx_range", "rx_index is null or isnan(rx_index) or rx_index < 0 or rx_index > 1", "the index is in [0, 1]"),
    Rule("rate_negative", "target_rate is null or isnan(target_rate) or target_rate < 0 or target_rate = cast('infinity' as double)", "rates are finite and non-negative"),
    Rule("pct_over_100", "upper(rate_unit) = 'PCT' and target_rate > 100", "a percentage is at most 100"),
)
#: Packages of a prescription. members: how many of those needed are there; crs of the boundary and of the raster; features; pixels; areas.
PACKAGE = (
    Rule("members", "members < 6", "all six members are there"),
    Rule("features", "features = 0", "the boundary has features"),
    Rule("boundary_crs", _blank("boundary_crs"), "the boundary has a reference system"),
    Rule("raster_crs", _blank("raster_crs"), "the raster has a reference system"),
    Rule("same_crs", "boundary_crs <> raster_crs", "reference systems are equal"),
    Rule("pixels", "pixels = 0", "the raster has rates"),
    Rule("area", "polygon_area <= 0 or abs(100 * (raster_area - polygon_area)) > 2 * polygon_area", "areas differ by at most two percent"),
)


def field_pixels(crop: int, finite: int) -> tuple[str, list[str]]:
    """Which cells are zoned, `crop` or `finite`, and warnings; an error where neither are enough."""
    if crop >= FIELD_PIXELS:
        return "crop", ["few crop cells: zones may be unstable"] if crop < STEADY_PIXELS else []
    if finite >= FIELD_PIXELS:
        return "finite", ["few crop cells: zones may be unstable", "zones of the whole footprint, for diagnosis alone: no prescriptions are written"]
    raise ValueError("too few valid cells")
