"""Metadata, archives, tiles and text deliverables as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazone.functions.indices import normal_description, xml_escape

# Roles of bands by description.
ALIASES = {
    "red": ("red", "r"),
    "green": ("green", "g"),
    "blue": ("blue", "b"),
    "nir": ("nir", "near infrared", "near-infrared", "nearinfrared"),
    "red_edge": ("red edge", "rededge", "red-edge", "re"),
}
# Layouts by number of bands below; limits of archives.
MEMBERS, TOTAL_BYTES, MEMBER_BYTES, RATIO = 256, 512 << 20, 256 << 20, 1000.0
MERCATOR_RESOLUTION = 156543.03392804097


def roles_by_description(bands: DataFrame) -> DataFrame:
    """raster_id, role, band, n: the first band of each role and how many claim it; more than one is a fault (bands.resolve_roles). bands: raster_id, band, description."""
    names = F.create_map(*[F.lit(x) for role, many in ALIASES.items() for a in many for x in (a, role)])
    told = bands.withColumn("role", F.try_element_at(names, normal_description(F.coalesce("description", F.lit("")))))
    return told.where(F.col("role").isNotNull()).groupBy("raster_id", "role").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("n"))


def standard_layout(count: Column, alphas: Column) -> Column:
    """Roles in band order where neither description nor colour tell; null where no layout fits."""
    plain = count - alphas
    layout = lambda *r: F.array(*[F.lit(x) for x in r])
    return (
        F.when((count >= 6) & (plain >= 5), layout("red", "green", "blue", "nir", "red_edge"))
        .when((count == 5) & (plain >= 4), layout("red", "green", "nir", "red_edge"))
        .when((count == 4) & (plain >= 4), layout("red", "green", "blue", "nir"))
    )


def rank_rasters(found: DataFrame, main: str = "odm_orthophoto.tif") -> DataFrame:
    """Candidates (path, name, bands), best first: the main name, then more bands, then the shorter path."""
    return found.orderBy(F.col("name") != main, F.desc("bands"), F.length("path"), "path")


def pick_member(members: DataFrame) -> DataFrame:
    """The raster of an archive: one with ortho in its name, else the shortest name."""
    tif = F.lower("name").endswith(".tif") | F.lower("name").endswith(".tiff")
    at = Window.partitionBy("archive").orderBy(~F.contains(F.lower("name"), F.lit("ortho")), F.length("name"), "name")
    return members.where(tif).withColumn("_n", F.row_number().over(at)).where(F.col("_n") == 1).drop("_n")


def unsafe_members(members: DataFrame) -> DataFrame:
    """archive, seq, problem of every member that may not be unpacked. members: archive, seq, name, file_size, compress_size, mode; seq tells an archive's members apart.

    Only the first MEMBERS of an archive are judged by what came before them. So those that have as many before them in their own part of the archive (by hash) are left to that part, and no task sorts an archive.
    """
    name = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    order = Window.partitionBy("archive", "late").orderBy("seq")
    part = F.pmod(F.xxhash64("seq"), F.lit(256))
    among = F.row_number().over(Window.partitionBy("archive", "part").orderBy("seq"))
    late = F.when(F.col("among") > MEMBERS, F.col("part")).otherwise(-1)  # -1: at most 256 * MEMBERS rows of an archive
    told = members.withColumn("part", part).withColumn("among", among).withColumn("late", late).withColumn("key", F.lower(name)).withColumns(
        {"first": F.row_number().over(Window.partitionBy("archive", "late", "key").orderBy("seq")), "running": F.sum("file_size").over(order), "place": F.row_number().over(order)}
    )
    # depth below the root after each part of the path
    depth = F.aggregate(F.split(name, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low")))["low"]
    kind = F.col("mode").bitwiseAND(0o170000)
    ratio = F.when(F.col("compress_size") == 0, F.col("file_size") > 0).otherwise(F.col("file_size") / F.nullif(F.col("compress_size"), F.lit(0)) > RATIO)
    problem = (
        F.when((F.col("late") >= 0) | (F.col("place") > MEMBERS), "count").when(F.col("first") > 1, "duplicate").when(kind == 0o120000, "symlink").when(~kind.isin(0, 0o100000, 0o040000), "kind")
        .when(name.startswith("/") | (F.substring(name, 2, 1) == ":"), "path").when(depth < 0, "path").when(F.col("file_size") > MEMBER_BYTES, "size").when(F.col("running") > TOTAL_BYTES, "total").when(ratio, "ratio")
    )
    return told.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("archive", "seq", "problem")


def zoom_histogram(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("zoom_level").agg(F.count(F.lit(1)).alias("tiles")).orderBy("zoom_level")


def upsert(metadata: DataFrame) -> DataFrame:
    """Last value by name. metadata: seq, name, value."""
    return metadata.groupBy("name").agg(F.max_by("value", "seq").alias("value"))


def mbtiles_problems(metadata: DataFrame, tiles: DataFrame) -> DataFrame:
    """check_id and ok for a tile set's metadata against its tiles."""
    m = metadata.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))  # a handful of names
    t = tiles.agg(F.count(F.lit(1)).alias("n"), F.min("zoom_level").alias("lo"), F.max("zoom_level").alias("hi"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    b = F.transform(F.split(get("bounds"), ","), lambda x: x.try_cast("double"))
    at = lambda i: F.get(b, F.lit(i))
    checks = {
        "tiles": F.col("n") > 0, "format": get("format").isin("png", "jpg", "jpeg", "webp"), "zoom_order": get("minzoom").try_cast("int") <= get("maxzoom").try_cast("int"),
        "zoom_match": (get("minzoom").try_cast("int") == F.col("lo")) & (get("maxzoom").try_cast("int") == F.col("hi")),
        "bounds": (F.size(b) == 4) & (at(0) >= -180) & (at(0) < at(2)) & (at(2) <= 180) & (at(1) >= -85.0512) & (at(1) < at(3)) & (at(3) <= 85.0512),
    }
    both = m.crossJoin(F.broadcast(t))  # one row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_id"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in checks.items()])))


def auto_zoom(resolution: Column) -> Column:
    """Web-mercator zoom of a ground resolution, half to even."""
    return F.bround(F.log2(F.lit(MERCATOR_RESOLUTION) / resolution)).cast("int")


def number_patches(patches: DataFrame) -> DataFrame:
    """patch_id Z{zone}-P{nnn} by falling area and place, share_pct of its zone, without slivers. patches: zone_id, area_m2, x0, y0."""
    zone = Window.partitionBy("zone_id")
    told = patches.withColumns({"n": F.row_number().over(zone.orderBy(F.desc("area_m2"), "x0", "y0")), "parent": F.sum("area_m2").over(zone)})
    share = 100 * F.col("area_m2") / F.nullif(F.col("parent"), F.lit(0.0))
    told = told.withColumn("share_pct", share).where((F.col("n") == 1) | ((F.col("area_m2") >= 1) & ((F.col("parent") <= 0) | (F.col("share_pct") >= 0.01))))
    return told.select("zone_id", F.format_string("Z%s-P%03d", F.col("zone_id").cast("string"), "n").alias("patch_id"), "area_m2", F.bround("share_pct", 6).alias("share_pct"))


def ring_text(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed coordinates of a box, eight decimals."""
    corner = lambda x, y: F.format_string("%.8f,%.8f,0", x, y)
    return F.concat_ws(" ", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def kml_placemark(name: Column, ring: Column) -> Column:
    return F.concat(F.lit("<Placemark><name>"), xml_escape(name), F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))


def world_file(a: float, b: float, c: float, d: float, e: float, f: float) -> str:
    """Six lines of an affine transform with the origin at the first pixel's centre."""
    return "".join(f"{v:.12f}\n" for v in (a, d, b, e, c + a / 2 + b / 2, f + d / 2 + e / 2))


def export_decision(gate: Column, fallback: Column, zones: Column, requested: Column, override: Column) -> Column:
    """Whether prescriptions are written."""
    passed = gate & ~fallback & (zones >= 2)
    return requested & (zones > 0) & (passed | override)


def rate_grid(zones: DataFrame, cells: DataFrame) -> DataFrame:
    """Rate of each cell by the zone box that holds its centre; of several the last zone's. Boxes become cell ranges, so cells meet them by key."""
    box = zones.select("zone_id", "rate", F.explode(F.sequence(F.ceil(F.col("y0") - 0.5).cast("int"), (F.ceil(F.col("y1") - 0.5) - 1).cast("int"))).alias("row_idx"), "x0", "x1")
    stripe = lambda c: F.floor(c / 64).cast("int")
    box = box.where(F.col("x0") < F.col("x1")).withColumn("stripe", F.explode(F.sequence(stripe(F.ceil(F.col("x0") - 0.5)), stripe(F.ceil(F.col("x1") - 0.5)))))
    hit = cells.select("row_idx", "col_idx", stripe(F.col("col_idx")).alias("stripe")).join(box, ["row_idx", "stripe"]).where((F.col("col_idx") + 0.5 >= F.col("x0")) & (F.col("col_idx") + 0.5 < F.col("x1")))
    return hit.groupBy("row_idx", "col_idx").agg(F.max_by("rate", "zone_id").alias("rate"), F.count(F.lit(1)).alias("zones"))


def spot_totals(area_ha: Column, rate: Column, unit: Column) -> tuple[Column, Column]:
    """Total product and its unit; none where the unit isn't by hectare."""
    per_ha = unit.isin("KG_HA", "L_HA", "SEEDS_HA")
    return F.when(per_ha, F.bround(area_ha * rate, 2)), F.when(per_ha, F.regexp_extract(unit, "^([A-Z]+)_", 1))
