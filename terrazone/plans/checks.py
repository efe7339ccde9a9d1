"""Queries of the checks, band roles and prescriptions' refusals, over rows of the driver's tables that break each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from terrazone.functions import indices as ix
from terrazone.operators import bands, deliverables, prescription, rules
from terrazone.plans.registry import query
from terrazone.session import table


def _rows(spark, sf_dir, name: str, text: str):
    return spark.sql(text.replace(f"from {name}", "from {rows}"), rows=table(spark, sf_dir, name))


def _by_hand(conditions: dict[str, str], keys: list[str], book) -> str:
    """The oracle of a book of rules from conditions that share no text with it: each fault where its condition, written for the fixed rows at hand, is true."""
    messages = {r.id: r.message for r in book}
    names = ", ".join(keys)
    return " union all ".join(f"select {names}, '{i}' as check_id, '{messages.get(i, '')}' as message from rows where {told}" for i, told in conditions.items())


def _checked(name: str, source: str, text: str, keys: list[str], book, conditions: dict[str, str] | None = None) -> None:
    """A query of the faults of rows that a text of both engines makes. conditions: the oracle's, by fault; the book's own text without them."""

    def run(spark, sf_dir):
        return rules.faults(_rows(spark, sf_dir, source, text), keys, book)

    run.__name__ = name
    query(f"with rows as ({text}) " + (_by_hand(conditions, keys, book) if conditions else rules.sql(book, "rows", keys)), view=False)(run)


def _pick(column: str, n: int, *values: str) -> str:
    """One of some SQL values, by a number."""
    return "case " + " ".join(f"when {column} % {n} = {i} then {v}" for i, v in enumerate(values)) + " end"


K = "o_orderkey"
PLANS = f"""select {K} as plan_id, {_pick(K, 13, "'physical'", "'relative'", "'both'", "null")[:-4]} else 'physical' end as mode,
  {_pick(K, 7, "'direct'", "'inverse'", "'explicit_by_zone'", "'target_hotspots'", "'guess'")[:-4]} else 'direct' end as strategy,
  case when {K} % 4 > 0 then {_pick(K, 11, "'fertilizer'", "'mow'", "null")[:-4]} else 'spray' end end as operation, case when {K} % 13 <> 1 then {_pick(K, 17, "'urea'", "' '", "''")[:-4]} else 'lime' end end as product_name,
  case when {K} % 13 <> 1 then {_pick(K, 19, "'product'", "'mass'")[:-4]} else 'nutrient' end end as rate_basis, case when {K} % 13 <> 1 then {_pick(K, 5, "'kg_ha'", "'PCT'", "'L_HA'", "null")[:-4]} else 'LB_AC' end end as unit,
  case when {K} % 7 <> 2 then {_pick(K, 23, "-1e0", "5e2")[:-4]} else 1e1 + {K} % 10 end end as min_rate, case when {K} % 7 <> 2 then 2e1 end as max_rate,
  case when {K} % 7 = 2 or {K} % 29 = 0 then {K} % 4 end as zones_given, case when {K} % 31 = 2 then 1 else 0 end as zones_odd, case when {K} % 37 = 2 then 2 else 0 end as rates_odd,
  case when {K} % 6 = 0 then -3e0 when {K} % 6 = 1 then 3e1 end as equipment_min_rate, case when {K} % 3 = 1 then 2e1 + {K} % 20 when {K} % 41 = 0 then -1e0 end as equipment_max_rate,
  case when {K} % 13 <> 1 then case when {K} % 9 = 0 then '' else 'me' end end as approved_by from orders"""
_checked("plan_checks", "orders", PLANS, ["plan_id"], rules.PLAN, {
    "plan_mode": "mode is distinct from 'relative' and mode is distinct from 'physical'", "plan_strategy": "strategy = 'guess'", "relative_explicit": "mode = 'relative' and strategy = 'explicit_by_zone'",
    "relative_fields": "mode = 'relative' and coalesce(operation, product_name, rate_basis, unit, approved_by, concat_ws('', min_rate, max_rate, zones_given, equipment_min_rate, equipment_max_rate)) <> ''",
    "plan_operation": "mode = 'physical' and coalesce(operation, '') not in ('spray', 'spread', 'seeding', 'fertilizer')", "plan_basis": "mode = 'physical' and coalesce(rate_basis, '') not in ('product', 'nutrient', 'active_ingredient')",
    "plan_unit": "mode = 'physical' and not regexp_full_match(coalesce(unit, ''), '(KG|L|SEEDS)_HA|(LB|GAL)_AC', 'i')", "plan_product": "mode = 'physical' and not regexp_matches(coalesce(product_name, ''), '[^ ]')",
    "plan_approval": "mode = 'physical' and not regexp_matches(coalesce(approved_by, ''), '[^ ]')", "equipment_least": "equipment_min_rate < 0", "equipment_most": "equipment_max_rate < 0", "equipment_order": "equipment_min_rate > equipment_max_rate",
    "explicit_zones": "mode = 'physical' and strategy = 'explicit_by_zone' and not coalesce(zones_given >= 1, false)", "explicit_bounds": "mode = 'physical' and strategy = 'explicit_by_zone' and coalesce(min_rate, max_rate) is not null",
    "explicit_numbers": "plan_id % 31 = 2", "explicit_rates": "plan_id % 37 = 2", "bounds_zones": "mode = 'physical' and strategy in ('direct', 'inverse', 'target_hotspots', 'guess') and zones_given >= 0",
    "bounds_needed": "mode = 'physical' and strategy is distinct from 'explicit_by_zone' and min_rate + max_rate is null", "bounds_least": "min_rate < 0", "bounds_most": "max_rate < 0", "bounds_order": "min_rate > max_rate",
})

CONFIGS = f"""select {K} as job, case when {K} % 11 = 0 then '' when {K} % 11 = 1 then 'out/7/in.tif' else 'in.tif' end as raster_path, concat('out/', cast({K} % 3 + 6 as varchar(9))) as out_dir,
  case when {K} % 12 < 11 then {K} % 12 end as zones, {_pick(K, 6, "'yes'", "'OFF '", "''", "'maybe'", "null", "'2'")} as basemap, case when {K} % 5 = 0 then {K} % 3 * 1000 end as max_pixels, {K} % 60 as width, {K} % 50 as height,
  case when {K} % 8 = 0 then {K} % 3 * 5e-1 - 5e-1 end as scale, {_pick(K, 9, "'PNG'", "null")[:-4]} else 'GTiff' end as driver, case when {K} % 10 > 0 then 'EPSG:32633' else ' ' end as crs,
  {K} % 2 = 0 as stacked, {K} % 14 = 0 as separate, {K} % 15 = 0 as band_map_given, case when {K} % 4 = 0 then 'a.tif' end as red_path, case when {K} % 8 = 0 then 'a.tif' else 'b.tif' end as nir_path from orders"""
_checked("config_checks", "orders", CONFIGS, ["job"], rules.CONFIG, {
    "raster_given": "length(replace(raster_path, ' ', '')) = 0", "zones_range": "zones in (0, 1) or zones > 8", "zones_named": "zones in (6, 7, 8)", "basemap_boolean": "basemap in ('maybe', '2')", "max_pixels": "max_pixels is not null and not max_pixels >= 1",
    "pixel_limit": "max_pixels in (1000, 2000) and width::bigint * height::bigint - max_pixels >= 1", "scale_positive": "scale in (-5e-1, 0)", "driver": "driver is distinct from 'GTiff'", "crs": "crs not like 'EPSG:%'",
    "output_apart": "starts_with(raster_path, out_dir || '/')", "one_input": "job % 14 = 0", "map_needs_stack": "job % 15 = 0 and job % 2 = 1", "bands_apart": "job % 8 = 0",
})

RASTERS = f"""select {K} as raster, 180 as height0, 180 as width0, 180 + case when {K} % 7 = 0 then 1 else 0 end as height, 180 as width, 'EPSG:32633' as crs0, case when {K} % 5 = 0 then 'EPSG:4326' else 'EPSG:32633' end as crs,
  1e0 as a0, 0e0 as b0, 5e5 as c0, 0e0 as d0, -1e0 as e0, 1e3 as f0, 1e0 as a, case when {K} % 11 = 0 then 1e-1 else 0e0 end as b, 5e5 + case when {K} % 13 = 0 then 5e-1 else 0e0 end as c, 0e0 as d, -1e0 as e, 1e3 as f,
  {K} % 5 <> 0 as projected, case when {K} % 17 = 0 then 3048e-4 else 1e0 end as unit_m, case when {K} % 19 = 0 then 'alpha' else 'gray' end as colour, {_pick(K, 4, "'red'", "null", "'nir'", "'red'")} as described, 'red' as role from orders"""
_checked("raster_checks", "orders", RASTERS, ["raster"], rules.TOGETHER, {
    "shape": "[height, width] <> [height0, width0]", "transform": "[a, b, c, d, e, f] <> [a0, b0, c0, d0, e0, f0]", "reference": "crs is distinct from crs0", "north_up": "[b, d] <> [0e0, 0e0]", "metric": "raster % 5 = 0 or unit_m < 1",
    "alpha_role": "raster % 19 = 0", "other_role": "raster % 4 = 2",
})

BASEMAPS = f"""select {K} as job, {K} % 30 - 2 as max_auto_zoom, {K} % 7 - 1 as min_zoom, {K} % 29 as max_zoom, {_pick(K, 5, "'png'", "'JPEG'", "'webp'", "'gif'", "null")} as tile_format, {K} % 110 as quality,
  {_pick(K, 4, "'cubic'", "'Average'", "'magic'", "'nearest'")} as resampling, {K} % 40 as width, 20 as height, 600 as max_source_pixels, {K} as output_bytes, 4000 as max_output_bytes from orders"""
_checked("basemap_checks", "orders", BASEMAPS, ["job"], rules.BASEMAP, {
    "auto_zoom": "max_auto_zoom not between 0 and 24", "zooms": "not (0 <= min_zoom and min_zoom <= max_zoom and max_zoom <= 24)", "tile_format": "tile_format = 'gif'", "quality": "quality not between 1 and 100", "resampling": "resampling = 'magic'",
    "source_size": "width = 0", "source_limit": "width > 30", "output_limit": "output_bytes >= 4001",
})

UPLOADS = f"""select {K} as upload, concat('f', cast({K} as varchar(20)), {_pick(K, 5, "'.tif'", "'.TIFF'", "'.zip'", "'.jpg'", "''")}) as name, cast({K} % 100 as bigint) * 300000000 as file_size, cast({K} % 7 as bigint) * 5000000 as compress_size from orders"""
_checked("upload_checks", "orders", UPLOADS, ["upload"], rules.UPLOAD, {
    "suffix": "not regexp_matches(name, '[.](tiff?|zip)$', 'i')", "bytes": "file_size / 1024e0 / 1024e0 / 1024e0 > 20", "ratio": "case when compress_size = 0 then file_size > 0 else file_size / compress_size::double > 1e3 end",
})

PACKAGES = f"""select {K} as package, 6 - {K} % 3 as members, {K} % 4 as features, case when {K} % 5 = 0 then '' else 'EPSG:32633' end as boundary_crs, {_pick(K, 6, "'EPSG:32633'", "' '", "'EPSG:32632'")[:-4]} else 'EPSG:32633' end as raster_crs,
  {K} % 9 as pixels, 1e4 as polygon_area, 1e4 + {K} % 500 as raster_area from orders"""
_checked("package_checks", "orders", PACKAGES, ["package"], rules.PACKAGE, {
    "members": "members <> 6", "features": "features < 1", "boundary_crs": "boundary_crs not like 'EPSG:%'", "raster_crs": "raster_crs not like 'EPSG:%'", "same_crs": "boundary_crs is distinct from raster_crs",
    "pixels": "package % 9 = 0", "area": "raster_area not between 98e-2 * polygon_area and 102e-2 * polygon_area",
})


@query("""with p as (select p_partkey as k, case when p_partkey % 9 = 0 then p_partkey + 5e-1 when p_partkey % 11 = 0 then 7 else p_partkey end as z, (p_partkey % 130) / 1e2 - 1e-1 as x, (p_partkey % 140) - 1e1 as r, case when p_partkey % 2 = 0 then 'pct' else 'KG_HA' end as u from part),
 q as (select *, count(*) over (partition by z) as ids from p)
select 'zone_number' as check_id, count(*) filter (z <> round(z)) as rows from q union all select 'zone_repeats', count(*) filter (ids > 1) from q union all select 'rx_range', count(*) filter (x < 0 or x > 1) from q
union all select 'rate_negative', count(*) filter (r < 0) from q union all select 'pct_over_100', count(*) filter (u = 'pct' and r > 100) from q""", view=False)
def rx_problems(spark, sf_dir):
    k = F.col("p_partkey")
    zone = F.when(k % 9 == 0, k + 0.5).when(k % 11 == 0, 7.0).otherwise(k.cast("double"))
    rx = table(spark, sf_dir, "part").select(zone.alias("rx_zone_id"), ((k % 130) / 100 - 0.1).alias("Rx_Index"), ((k % 140) - 10).cast("double").alias("TargetRate"), F.when(k % 2 == 0, "pct").otherwise("KG_HA").alias("Rate_Unit"))
    return prescription.problems(rx)


_BANDS = """select (p_partkey - 1) div 6 as raster_id, cast((p_partkey - 1) % 6 + 1 as int) as band,
  case p_size % 9 when 0 then 'Red' when 1 then ' NIR ' when 2 then 'red_EDGE' when 3 then 'G' when 4 then 'near  infrared' when 5 then 'depth' when 6 then 'Blue' end as description,
  case (p_size * 7 + p_partkey) % 11 when 0 then 'red' when 1 then 'green' when 2 then 'blue' when 3 then 'alpha' else 'gray' end as colour from part"""
_GIVEN = """select distinct (p_partkey - 1) div 6 as raster_id, case when p_partkey % 31 = 0 then 'swir' when p_partkey % 2 = 0 then 'red' else 'nir' end as role, case when p_partkey % 23 = 0 then 25e-1 when p_partkey % 29 = 0 then 9e0 else cast((p_partkey - 1) % 6 + 1 as double) end as band from part where p_partkey % 7 = 0"""
_ROLES_SQL = f"""with b as ({_BANDS.replace(' div ', ' // ')}), g as ({_GIVEN.replace(' div ', ' // ')}), n as (select raster_id, count(*) as c, count(*) filter (colour = 'alpha') as a from b group by all),
 known as (select unnest(['red', 'green', 'blue', 'nir', 'red_edge']) as role), gg as (select g.*, g.role in (from known) as known, band = floor(band) and band between 1 and c as whole from g join n using (raster_id)),
 d as (select raster_id, band, case trim(regexp_replace(replace(lower(coalesce(description, '')), '_', ' '), '\\s+', ' ', 'g')) when 'red' then 'red' when 'nir' then 'nir' when 'near infrared' then 'nir' when 'red edge' then 'red_edge' when 'g' then 'green' when 'blue' then 'blue' end as role from b),
 dd as (select raster_id, role, min(band) as band, count(*) as many from d where role is not null and not exists (select 1 from g where g.raster_id = d.raster_id and g.role = d.role) group by all),
 w as (select raster_id, role, band::int as band, 0 as way from gg where known and whole union all select raster_id, role, band, 1 from dd union all select raster_id, colour, min(band), 2 from b where colour in ('red', 'green', 'blue') group by all),
 s as (select raster_id, role, arg_min(band, (way, band)) as band, min(way) as way from w group by all),
 l as (select raster_id, case when c >= 6 and c - a >= 5 then ['red', 'green', 'blue', 'nir', 'red_edge'] when c = 5 and c - a >= 4 then ['red', 'green', 'nir', 'red_edge'] when c = 4 and c - a >= 4 then ['red', 'green', 'blue', 'nir'] end as roles from n
   where raster_id not in (select raster_id from s where role in ('red', 'nir') group by all having count(*) = 2)),
 lx as (select raster_id, unnest(roles) as role, unnest(range(1, len(roles) + 1)) as band from l where roles is not null),
 r as (select raster_id, role, arg_min(band, way)::int as band, ['given', 'described', 'colour', 'layout'][min(way) + 1] as how from (select * from s union all select raster_id, role, band, 3 from lx) group by all)"""


def _resolved(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return bands.resolve_roles(spark.sql(_BANDS.replace("from part", "from {p}"), p=part), spark.sql(_GIVEN.replace("from part", "from {p}"), p=part))


@query(f"{_ROLES_SQL} select * from r", view=False)
def band_roles(spark, sf_dir):
    return _resolved(spark, sf_dir)[0]


@query(f"""{_ROLES_SQL} select raster_id, 'unknown_role' as check_id, role from gg where not known union all select raster_id, 'band_number', role from gg where known and not whole
union all select raster_id, 'several_described', role from dd where many > 1 union all select r.raster_id, 'alpha_role', r.role from r join b on r.raster_id = b.raster_id and r.band = b.band and colour = 'alpha'
union all select raster_id, 'band_twice', min(role) from r group by raster_id, band having count(*) > 1 union all (select raster_id, 'role_missing', role from (select raster_id, unnest(['red', 'nir']) as role from n) x where not exists (select 1 from r where r.raster_id = x.raster_id and r.role = x.role))""", view=False)
def band_role_faults(spark, sf_dir):
    return _resolved(spark, sf_dir)[1]


@query(f"with b as ({_BANDS.replace(' div ', ' // ')}) select raster_id, case when count(*) filter (colour = 'alpha') = 1 then max(case when colour = 'alpha' then band end) end as alpha from b group by all", view=False)
def alpha_bands(spark, sf_dir):
    return bands.alpha_band(spark.sql(_BANDS.replace("from part", "from {p}"), p=table(spark, sf_dir, "part")))


@query("""with r as (select distinct s_nationkey as zone_id from supplier where s_nationkey % 2 = 0), z as (select distinct c_nationkey as zone_id from customer)
select zone_id, 'missing' as fault from z where zone_id not in (from r) union all select zone_id, 'extra' from r where zone_id not in (from z)""", view=False)
def rx_rate_integrity(spark, sf_dir):
    zones = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("zone_id")).distinct()
    return prescription.rate_faults(zones, table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("zone_id")).distinct())


@query("""select s_suppkey, coalesce(nullif(case when s_nationkey % 3 = 0 then 0e0 when s_nationkey % 3 = 1 then s_nationkey::double end, 0), nullif(case when s_nationkey % 2 = 0 then 0e0 else 5e1 end, 0), 100) as rate from supplier""", view=False)
def spot_target_rate(spark, sf_dir):
    n = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", prescription.spot_rate(F.when(n % 3 == 0, 0.0).when(n % 3 == 1, n.cast("double")), F.when(n % 2 == 0, 0.0).otherwise(50.0)).alias("rate"))


@query("""select s_suppkey, case when u in ('KG_HA', 'L_HA', 'SEEDS_HA') then round_even(s_suppkey / 3e0 * 7e0, 2) end as total, case when u in ('KG_HA', 'L_HA', 'SEEDS_HA') then regexp_extract(u, '^([A-Z]+)_', 1) end as unit from (select s_suppkey, ['KG_HA', 'L_HA', 'SEEDS_HA', 'LB_AC', 'PCT'][s_suppkey % 5 + 1] as u from supplier)""", view=False)
def spot_totals(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KG_HA", "L_HA", "SEEDS_HA", "LB_AC", "PCT")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    total, name = deliverables.spot_totals(F.col("s_suppkey") / 3.0, F.lit(7.0), unit)
    return table(spark, sf_dir, "supplier").select("s_suppkey", total.alias("total"), name.alias("unit"))


# an archive of a third of all members, and one of each customer's others; every twelfth member breaks one rule
_KINDS = "case when o_orderkey % 3 = 0 then 0 else o_custkey end as archive, o_orderkey as seq, o_orderkey % 12 as kind"


@query(f"""with m as (select {_KINDS} from orders), s as (select *, case kind when 6 then 300000000 when 8 then 5001 else 1000 end as size from m),
 w as (select *, row_number() over (partition by archive order by seq) as place, sum(size) over (partition by archive order by seq) as running, row_number() over (partition by archive, kind order by seq) as nth from s)
select archive, seq, case when place > 256 then 'count' when kind = 3 and nth > 1 then 'duplicate' when kind = 4 then 'symlink' when kind = 5 then 'kind' when kind in (0, 1, 2) then 'path' when kind = 6 then 'size' when running > 536870912 then 'total' else 'ratio' end as problem
from w where place > 256 or (kind = 3 and nth > 1) or kind in (0, 1, 2, 4, 5, 6, 7, 8) or running > 536870912""", view=False)
def zip_refusals(spark, sf_dir):
    k = F.col("seq").cast("string")
    of = lambda *told, other: reduce(lambda col, kv: col.when(F.col("kind") == kv[0], kv[1]), told, F.when(F.lit(False), other)).otherwise(other)
    name = of(
        (0, F.concat(F.lit("a/../../b"), k)), (1, F.concat(F.lit("/abs"), k)), (2, F.concat(F.lit("C:\\x"), k)), (3, F.when(F.col("seq") % 24 == 3, "Dup\\a.TIF").otherwise("dup/a.tif")), (9, F.concat(F.lit("d/../e/./"), k)), other=F.concat(F.lit("a/"), k)
    )
    size = of((6, F.lit(300_000_000)), (8, F.lit(5001)), other=F.lit(1000)).cast("long")
    packed = of((6, F.lit(200_000_000)), (7, F.lit(0)), (8, F.lit(5)), other=F.lit(500)).cast("long")
    mode = of((4, F.lit(0o120777)), (5, F.lit(0o010644)), (9, F.lit(0o040755)), (10, F.lit(0)), other=F.lit(0o100644))
    members = table(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _KINDS.split(",")])
    return deliverables.unsafe_members(members.select("archive", "seq", name.alias("name"), size.alias("file_size"), packed.alias("compress_size"), mode.alias("mode")))


_FOOTPRINT = "select crop, finite, case when crop >= 20 then 'crop' when finite >= 20 then 'finite' else 'refused' end as zoned, crop < 500 as few from (select s_suppkey * 7 as crop, s_suppkey * 9 as finite from supplier)"


@query(_FOOTPRINT, view=False)
def field_pixels(spark, sf_dir):
    crop, finite = F.col("s_suppkey") * 7, F.col("s_suppkey") * 9
    told = F.when(crop >= rules.FIELD_PIXELS, "crop").when(finite >= rules.FIELD_PIXELS, "finite").otherwise("refused")
    return table(spark, sf_dir, "supplier").select(crop.alias("crop"), finite.alias("finite"), told.alias("zoned"), (crop < rules.STEADY_PIXELS).alias("few"))


@query("select event_id, case lower(trim(v)) when 'yes' then true when '1' then true when 'off' then false when '' then false end as flag from (select event_id, ['yes', ' OFF', '', 'maybe', '1'][event_id % 5 + 1] as v from events)", view=False)
def boolean_words(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in ("yes", " OFF", "", "maybe", "1")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", ix.parse_boolean(word, strict=False).alias("flag"))
