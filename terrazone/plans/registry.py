"""All queries of the raster engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrazone.functions import indices as ix
from terrazone.operators import crop, deliverables, masks, prescription, quality
from terrazone.session import cut, table
from terrazone.sources.pixels import BANDS, PIXELS_SQL, decimate, footprint, join_bands, pixels, with_indices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEW = f"""with recursive px as ({PIXELS_SQL.format(div="//")}),
fp as (select * from px where red is not null and not {ix.ALL_ZERO}),
ix as (select *, {", ".join(f"{sql} as {name}" for name, sql in ix.INDICES.items())} from fp),
thr as (select n, pct_thr, med, mad, case when mad > 0 then med - 15e-1 * 14826e-4 * mad else pct_thr end as robust_thr from (
  select count(*) as n, any_value(pct_thr) as pct_thr, any_value(med) as med, median(abs(ndvi - med)) as mad from (select ndvi, quantile_cont(ndvi, 1e-1) over () as pct_thr, median(ndvi) over () as med from ix where {ix.CROP}))),
cut as (select *, case when least(pct_thr, robust_thr) < 2e-1 and pct_thr >= 2e-1 then pct_thr else least(pct_thr, robust_thr) end as thr from thr)
"""


def query(oracle: str | None = None, view: bool = True):
    def note(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = (VIEW if view else "") + oracle
        return f

    return note


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indices(footprint(pixels(spark, sf_dir)))


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid, written once: for what passes over it several times, so that its expressions are computed once."""
    return cut(grid(spark, sf_dir), "grid")


def r6(c, name: str):
    return F.bround(c, 6).alias(name)


# -- indices and their statistics ------------------------------------------------------------------


@query(f"select cls, count(*) as pixels, round_even(avg(ndvi), 6) as mean_ndvi, round_even(median(ndvi), 6) as median_ndvi, cast(count(*) as double) as area_m2 from (select ndvi, {ix.classify_sql()} as cls from ix) group by cls")
def ndvi_class_hist(spark, sf_dir):
    px = cut(with_indices(footprint(pixels(spark, sf_dir)), ("ndvi",)).select("ndvi", F.expr(ix.classify_sql()).alias("cls")), "classes")
    middle = [F.lit(x) for c, (m,) in quality.quantiles(px, "ndvi", [0.5], "cls").items() for x in (c, m)]  # a pair a class
    told = px.groupBy("cls").agg(F.count(F.lit(1)).alias("pixels"), r6(F.avg("ndvi"), "mean_ndvi"), F.count(F.lit(1)).cast("double").alias("area_m2"))
    return told.withColumn("median_ndvi", F.bround(F.element_at(F.create_map(*middle), F.col("cls")), 6) if middle else F.lit(None).cast("double"))


def _index_stats(name: str) -> None:
    def stats(spark, sf_dir):
        px = cut(with_indices(footprint(pixels(spark, sf_dir)), (name,)).select(name), "index")
        middle = quality.one_row(px, med=quality.quantiles(px, name, [0.5])[0])
        told = px.agg(F.count(name).alias("n"), r6(F.avg(name), "mean"), r6(F.min(name), "lo"), r6(F.max(name), "hi"))
        return quality.with_scalars(told, middle).withColumn("med", F.bround("med", 6))

    stats.__name__ = f"{name}_stats"
    query(f"select count({name}) as n, round_even(avg({name}), 6) as mean, round_even(min({name}), 6) as lo, round_even(max({name}), 6) as hi, round_even(median({name}), 6) as med from ix")(stats)


for _name in ix.INDICES:
    _index_stats(_name)


def _union_sql(template: str, names) -> str:
    return " union all ".join(template.format(x=n) for n in names)


@query(_union_sql("select '{x}' as band, count({x}) as n, round_even(100*avg(case when {x} = 0 then 1e0 when {x} is not null then 0e0 end), 6) as zero_pct, round_even(100*avg(case when {x} > 1 or {x} < 0 then 1e0 when {x} is not null then 0e0 end), 6) as outside_pct, round_even(max({x}), 6) as hi from px", BANDS))
def band_qa(spark, sf_dir):
    px = pixels(spark, sf_dir)
    sides = [x for b in BANDS for x in (F.lit(b), F.col(b))]
    long = px.select(F.inline(F.array(*[F.struct(sides[i].alias("band"), sides[i + 1].alias("x")) for i in range(0, len(sides), 2)])))
    return long.groupBy("band").agg(F.count("x").alias("n"), r6(quality.share(F.col("x") == 0), "zero_pct"), r6(quality.share((F.col("x") < 0) | (F.col("x") > 1)), "outside_pct"), r6(F.max("x"), "hi"))


@query(_union_sql("select '{x}' as name, count(*) - count({x}) as missing, sum(case when abs({x}) > 1 then 1 else 0 end)::bigint as outside from ix", ix.INDICES))
def index_qa(spark, sf_dir):
    long = grid(spark, sf_dir).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in ix.INDICES])))
    return long.groupBy("name").agg((F.count(F.lit(1)) - F.count("x")).alias("missing"), F.count_if(F.abs("x") > 1).alias("outside"))


@query("select 'red' as band, max(red) - min(red) <= greatest(1e-12, abs(median(red)) * 1e-8) as constant from fp union all select 'flat', max(f) - min(f) <= greatest(1e-12, abs(median(f)) * 1e-8) from (select 4e-1 + 0 * red as f from fp)")
def band_constant_check(spark, sf_dir):
    px = footprint(pixels(spark, sf_dir)).withColumn("flat", F.lit(0.4) + 0 * F.col("red"))
    return quality.is_constant(px, "red").select(F.lit("red").alias("band"), "constant").unionByName(quality.is_constant(px, "flat").select(F.lit("flat").alias("band"), "constant"))


@query("""select factor, round_even(outside_pct, 6) as outside_pct, round_even(mean, 6) as mean, n from (
  select any_value(f) as factor, any_value(o) as outside_pct, avg(least(greatest(dn / f, 0e0), 1e0)) as mean, count(dn) as n from (
    select dn, o, case when o > 5 and m > 1 then case when m <= 255 then 255e0 when m <= 10000 then 1e4 when m <= 65535 then 65535e0 else m end else 1e0 end as f from (
      select nir*1e4 as dn, max(nir*1e4) over () as m, 100*avg(case when nir*1e4 < 0 or nir*1e4 > 1 then 1e0 else 0e0 end) over () as o from fp)))""")
def dn_autoscale(spark, sf_dir):
    px = footprint(pixels(spark, sf_dir)).withColumn("nir", F.col("nir") * 1e4)
    told = quality.autoscale_factor(px, "nir")
    after = quality.autoscale(px, "nir").agg(F.avg("nir").alias("mean"), F.count("nir").alias("n"))
    return quality.with_scalars(told, after).select("factor", r6("outside_pct", "outside_pct"), r6("mean", "mean"), "n")


@query("select 'plain' as variant, greatest(quantile_cont(red, 99e-2), quantile_cont(nir, 99e-2)) >= 1e-2 as plausible from fp union all select 'dark', greatest(quantile_cont(red*1e-3, 99e-2), quantile_cont(nir*1e-3, 99e-2)) >= 1e-2 from fp")
def reflectance_gate(spark, sf_dir):
    px = cut(footprint(pixels(spark, sf_dir)).select("red", "nir"), "bands")
    dark = px.withColumns({b: F.col(b) * 1e-3 for b in px.columns})
    return quality.reflectance_gate(px).select(F.lit("plain").alias("variant"), "plausible").unionByName(quality.reflectance_gate(dark).select(F.lit("dark").alias("variant"), "plausible"))


@query(f"select count(*) as total, sum(case when red is null then 1 else 0 end)::bigint as missing, sum(case when {ix.ALL_ZERO} then 1 else 0 end)::bigint as background, (select count(*) from fp) as inside from px")
def footprint_counts(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return quality.with_scalars(px.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("red").isNull()).alias("missing"), F.count_if(F.expr(ix.ALL_ZERO)).alias("background")), footprint(px).agg(F.count(F.lit(1)).alias("inside")))


@query("select count(*) as n, round_even(sum(nir - red), 6) as total from px where red is not null")
def coreg_join(spark, sf_dir):
    px = pixels(spark, sf_dir)
    parts = {b: px.select("row_idx", "col_idx", F.col(b).alias("value")) for b in ("red", "nir")}
    return join_bands(parts).where(F.col("red").isNotNull()).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("nir") - F.col("red")), "total"))


@query("select count(*) as n, round_even(avg(nir), 6) as nir from px where red is not null and nir is not null and (row_idx + col_idx) % 3 = 0")
def footprint_semi_join(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return footprint(px, mask=px.where((F.col("row_idx") + F.col("col_idx")) % 3 == 0)).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("nir"), "nir"))


@query(f"select {ix.SHADOW} as shadow, {ix.WATER} as water, ndvi >= 2e-1 as green_enough, coalesce(msavi2 >= 15e-2, false) as msavi_enough, count(*) as n from ix group by all")
def crop_predicates(spark, sf_dir):
    px = grid(spark, sf_dir)
    return px.groupBy(F.expr(ix.SHADOW).alias("shadow"), F.expr(ix.WATER).alias("water"), (F.col("ndvi") >= ix.CROP_NDVI).alias("green_enough"), F.coalesce(F.col("msavi2") >= ix.CROP_MSAVI2, F.lit(False)).alias("msavi_enough")).agg(F.count(F.lit(1)).alias("n"))


@query("select sum(case when ndvi >= 2e-1 then 1 else 0 end)::bigint as veg_pixels, count(*) as valid_pixels, round_even(100e0*sum(case when ndvi >= 2e-1 then 1 else 0 end)/count(*), 6) as cover_pct, sum(case when ndvi >= 2e-1 then 1e0 else 0e0 end) as veg_area_m2 from ix")
def canopy_cover(spark, sf_dir):
    return quality.canopy_cover(grid(spark, sf_dir), F.col("ndvi") >= ix.CROP_NDVI).withColumn("cover_pct", F.bround("cover_pct", 6))


@query("select n, round_even(pct_thr, 6) as pct_thr, round_even(med, 6) as med, round_even(mad, 6) as mad, round_even(robust_thr, 6) as robust_thr, round_even(thr, 6) as thr from cut")
def hotspot_threshold(spark, sf_dir):
    told = quality.hotspot_threshold(held(spark, sf_dir).where(ix.CROP))
    return told.select("n", *[r6(c, c) for c in ("pct_thr", "med", "mad", "robust_thr", "thr")])


# -- neighbourhoods ------------------------------------------------------------------------------------


def _near(table_: str, value: str, op: str) -> str:
    joins = " ".join(f"left join {table_} n{i} on n{i}.row_idx = t.row_idx + ({dr}) and n{i}.col_idx = t.col_idx + ({dc})" for i, (dr, dc) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1))))
    return f"select t.row_idx, t.col_idx, t.{value} {op} " + f" {op} ".join(f"coalesce(n{i}.{value}, false)" for i in range(4)) + f" as {value} from {table_} t {joins}"


_CROP0 = f", m0 as materialized (select row_idx, col_idx, coalesce({ix.CROP}, false) as v from ix)"
_SIZES = "select row_idx % 100 as row_mod, count(*) as n, sum(case when v then 1 else 0 end)::bigint as on_cells from {t} group by all"


def _mask(spark, sf_dir):
    return grid(spark, sf_dir).select("row_idx", "col_idx", F.coalesce(F.expr(ix.CROP), F.lit(False)).alias("v"))


def _mask_sizes(df):
    return df.groupBy((F.col("row_idx") % 100).alias("row_mod")).agg(F.count(F.lit(1)).alias("n"), F.count_if("v").alias("on_cells"))


@query(f"{_CROP0}, m1 as ({_near('m0', 'v', 'and')}) " + _SIZES.format(t="m1"))
def erode_crop(spark, sf_dir):
    return _mask_sizes(masks.erode(_mask(spark, sf_dir)))


@query(f"{_CROP0}, m1 as ({_near('m0', 'v', 'or')}) " + _SIZES.format(t="m1"))
def dilate_mask(spark, sf_dir):
    return _mask_sizes(masks.dilate(_mask(spark, sf_dir)))


@query(f"{_CROP0}, m1 as materialized ({_near('m0', 'v', 'and')}), m2 as materialized ({_near('m1', 'v', 'or')}), m3 as materialized ({_near('m2', 'v', 'or')}), m4 as ({_near('m3', 'v', 'and')}) " + _SIZES.format(t="m4"))
def open_close_mask(spark, sf_dir):
    return _mask_sizes(masks.open_close(_mask(spark, sf_dir)))


_LABEL0 = f", l0 as materialized (select row_idx, col_idx, cast(nullif({ix.classify_sql()}, 0) as int) as label from ix), box as (select max(row_idx) as r, max(col_idx) as c from l0)"


@query(f"""{_LABEL0}, asked as (select t.row_idx, t.col_idx, least(greatest(t.row_idx + i, 0), box.r) as y, least(greatest(t.col_idx + j, 0), box.c) as x from l0 t, box, (values (-1),(0),(1)) as di(i), (values (-1),(0),(1)) as dj(j)),
nb as (select a.row_idx, a.col_idx, list_sort(list(coalesce(o.label, -1))) as vs from asked a left join l0 o on o.row_idx = a.y and o.col_idx = a.x group by all)
select case when vs[5] < 0 or l0.label is null then l0.label else vs[5] end as label, count(*) as n from nb join l0 using (row_idx, col_idx) group by all""")
def median3x3_labels(spark, sf_dir):
    px = grid(spark, sf_dir).select("row_idx", "col_idx", F.nullif(F.expr(ix.classify_sql()), F.lit(0)).cast("int").alias("label"))
    return masks.median3(px).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _components(cells: str, name: str) -> str:
    """CTEs that label the cells of a table by runs: {name}_runs(id, row_idx, c0, c1) and {name}_cc(id, lbl)."""
    return f""", {name}_runs as materialized (select row_idx, min(col_idx) as c0, max(col_idx) as c1, row_idx * 100000 + min(col_idx) as id from (
    select row_idx, col_idx, col_idx - row_number() over (partition by row_idx order by col_idx) as g from {cells}) group by row_idx, g),
  {name}_e as materialized (select a.id as s, b.id as t from {name}_runs a join {name}_runs b on b.row_idx = a.row_idx + 1 and a.c0 <= b.c1 and b.c0 <= a.c1),
  {name}_e2 as materialized (select s, t from {name}_e union all select t, s from {name}_e),
  {name}_cc(id, lbl) using key (id) as (select id, id from {name}_runs union (select e.t, min(c.lbl) from {name}_cc c join {name}_e2 e on e.s = c.id join recurring.{name}_cc k on k.id = e.t where c.lbl < k.lbl group by e.t)),
  {name}_size as materialized (select lbl, sum(c1 - c0 + 1)::bigint as n from {name}_runs join {name}_cc using (id) group by lbl)"""


_CROP_CELLS = f", cells as materialized (select row_idx, col_idx from ix where {ix.CROP})"


@query(f"{_CROP_CELLS}{_components('cells', 'k')} select (lbl // 100000)::int as label_row, (lbl % 100000)::int as label_col, n from k_size")
def components_crop(spark, sf_dir):
    return masks.component_sizes(grid(spark, sf_dir).where(ix.CROP)).select("label_row", "label_col", "n")


_SMALL = 100
_KEPT = f"{_CROP_CELLS}{_components('cells', 'k')}, kept as (select sum(n)::bigint as cells, count(*) as parts from k_size where n >= {_SMALL})"


@query(f"{_KEPT} select cells, (select count(*) from cells) as before_ from kept")
def small_component_filter(spark, sf_dir):
    cells = cut(grid(spark, sf_dir).where(ix.CROP).select(*masks.CELL), "cells")
    return quality.with_scalars(masks.keep_large(cells, _SMALL).agg(F.count(F.lit(1)).alias("cells")), cells.agg(F.count(F.lit(1)).alias("before_")))


_EXPAND = "(select r.row_idx, c as col_idx, z.n from {k}_runs r join {k}_cc using (id) join {k}_size z using (lbl), range(0, 100) t(c) where c between r.c0 and r.c1)"
_QC = f""", base as materialized (select row_idx, col_idx, ndvi, coalesce({ix.CROP}, false) as crop, {ix.SHADOW} as shadow, {ix.WATER} as water, ({ix.SHADOW} or {ix.WATER}) as excluded from ix where ndvi is not null),
 cropcells as materialized (select row_idx, col_idx from base where crop){_components('cropcells', 'p')},
 filt as materialized (select b.*, coalesce(x.n >= 2, false) as filtered from base b left join {_EXPAND.format(k='p')} x using (row_idx, col_idx)),
 others as materialized (select row_idx, col_idx from filt where not filtered){_components('others', 'q')},
 big as materialized (select f.*, coalesce(x.n >= 10, false) as large_other, not coalesce(x.n >= 10, false) and not excluded as mask from filt f left join {_EXPAND.format(k='q')} x using (row_idx, col_idx)),
 eroded as materialized ({_near('big', 'mask', 'and')}), done as materialized (select b.* exclude (mask), e.mask from big b join eroded e using (row_idx, col_idx))"""


@query(f"{_QC} select sum(crop::int)::bigint as crop_before, sum(mask::int)::bigint as crop_after, sum(large_other::int)::bigint as large_other, sum(shadow::int)::bigint as shadow, sum(water::int)::bigint as water, sum(excluded::int)::bigint as excluded, count(*) as valid from done")
def crop_mask_qc(spark, sf_dir):
    return crop.crop_qc(crop.crop_mask(held(spark, sf_dir)))


_SPOT = f""", h0 as materialized (select row_idx, col_idx, ndvi, coalesce({ix.CROP} and ndvi <= (select thr from cut) and ndvi >= 2e-1 and (select n from cut) >= 100, false) as v from ix),
 h1 as materialized ({_near('h0', 'v', 'and')}), h2 as materialized ({_near('h1', 'v', 'or')}), h3 as materialized ({_near('h2', 'v', 'or')}), h4 as materialized ({_near('h3', 'v', 'and')}),
 hcells as materialized (select row_idx, col_idx from h4 where v){_components('hcells', 'h')},
 hs as (select lbl, count(*) as n, avg(ndvi) as mean, median(ndvi) as med from (select r.row_idx, c as col_idx, k.lbl from h_runs r join h_cc k using (id), range(0, 100) t(c) where c between r.c0 and r.c1) join h0 using (row_idx, col_idx) group by lbl having count(*) >= 50),
 spots as (select row_number() over (order by lbl)::int as hotspot_id, row_number() over (order by mean, lbl)::int as severity_rank, round_even(n * 1e0, 2) as area_m2, round_even(mean, 3) as mean_ndvi, round_even(med, 3) as median_ndvi from hs)"""


def _hotspots(spark, sf_dir):
    px = held(spark, sf_dir)
    return crop.hotspots(cut(crop.hotspot_cells(px, px.where(ix.CROP)), "stress"))


@query(f"{_SPOT} select * from spots")
def hotspots(spark, sf_dir):
    return _hotspots(spark, sf_dir)


@query(f"{_SPOT} select * from spots where severity_rank <= 10")
def hotspots_topk(spark, sf_dir):
    return _hotspots(spark, sf_dir).orderBy("severity_rank").limit(10)


_SPOT_RX = """ select *, severity_rank as "Zone_ID", 1e0 as "Rx_Index", 100e0 as "TargetRate", 'PCT' as "Rate_Unit", 'spot_spray_target' as "Cmd_Mode", 'spot_spray' as "Rx_Mode", 'SPOT_SPRAY' as "IndexFld" from spots"""


@query(f"{_SPOT}{_SPOT_RX}")
def spot_spray_rx(spark, sf_dir):
    return prescription.spot_prescription(_hotspots(spark, sf_dir))


@query(f"""{_SPOT}{_SPOT_RX} union all select null, null, null, null, null, count(*) + 1, 0e0, 0e0, 'PCT', 'no_spray_background', 'spot_spray', 'SPOT_SPRAY' from spots having count(*) > 0""")
def spot_spray_background(spark, sf_dir):
    return prescription.spot_prescription(_hotspots(spark, sf_dir), background_rate=0.0)


# -- zones ---------------------------------------------------------------------------------------------


def _lloyd_sql(k: int, rounds: int, tag: str = "") -> str:
    sql = f", z0{tag} as materialized (select row_idx, col_idx, ndvi, gli from ix where {ix.CROP} and ndvi is not null and gli is not null order by md5(row_idx || ':' || col_idx || ':42') limit {10_000 if tag else 1 << 40}), q0{tag} as (select unnest(range({k})) as i, unnest(quantile_cont(ndvi, [{', '.join(repr((i + 0.5) / k) + 'e0' for i in range(k))}])) as q from z0{tag})"
    sql += f", a0{tag} as materialized (select row_idx, col_idx, any_value(ndvi) as ndvi, any_value(gli) as gli, arg_min(i, (abs(ndvi - q), i)) as cluster from z0{tag}, q0{tag} group by row_idx, col_idx)"
    for n in range(rounds):
        sql += f", m{n + 1}{tag} as materialized (select cluster as i, avg(ndvi) as a, avg(gli) as b from a{n}{tag} group by cluster), a{n + 1}{tag} as materialized (select row_idx, col_idx, any_value(ndvi) as ndvi, any_value(gli) as gli, arg_min(i, (pow(ndvi - a, 2) + pow(gli - b, 2), i)) as cluster from a{n}{tag}, m{n + 1}{tag} group by row_idx, col_idx)"
    sql += f", ordered{tag} as (select cluster, row_number() over (order by avg(ndvi), cluster) - 1 as zone from a{rounds}{tag} group by cluster), zoned{tag} as materialized (select a.row_idx, a.col_idx, a.ndvi, a.gli, o.zone::int as cluster from a{rounds}{tag} a join ordered{tag} o using (cluster))"
    return sql


_ZONES = _lloyd_sql(3, 10)


def _zones(spark, sf_dir):
    cells = cut(grid(spark, sf_dir).where(ix.CROP).select(*masks.CELL, "ndvi", "gli"), "features")
    return cut(crop.kmeans(cells, ["ndvi", "gli"], 3), "zones")


@query(f"{_ZONES} select cluster, count(*) as n, round_even(avg(ndvi), 6) as ndvi, round_even(avg(gli), 6) as gli from zoned group by cluster")
def kmeans_lloyd(spark, sf_dir):
    return _zones(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ndvi"), "ndvi"), r6(F.avg("gli"), "gli"))


_ZONE_STATS = f"{_ZONES}, zs as (select cluster as zone_id, list_value('lower_relative_vigor', 'typical_relative_vigor', 'higher_relative_vigor')[cluster + 1] as relative_vigor_label, count(*) as pixels, count(*)::double as area_m2, round_even(avg(ndvi), 6) as ndvi_mean, round_even(median(ndvi), 6) as ndvi_median from zoned group by cluster having count(*) >= 100)"


def _zone_stats(spark, sf_dir):
    found = crop.zone_stats(_zones(spark, sf_dir), ["ndvi"], 3)
    return found.withColumns({c: F.bround(c, 6) for c in ("ndvi_mean", "ndvi_median")})


@query(f"{_ZONE_STATS} select * from zs")
def zone_stats(spark, sf_dir):
    return _zone_stats(spark, sf_dir)


@query(f"{_ZONE_STATS} select arg_min(zone_id, ndvi_mean) as lowest, arg_max(zone_id, ndvi_mean) as highest from zs")
def zone_best_worst(spark, sf_dir):
    return _zone_stats(spark, sf_dir).agg(F.min_by("zone_id", "ndvi_mean").alias("lowest"), F.max_by("zone_id", "ndvi_mean").alias("highest"))


def _strips(spark, sf_dir):
    return grid(spark, sf_dir).select(*masks.CELL, F.expr(ix.classify_sql()).alias("cluster"))


@query(f""", s0 as materialized (select row_idx, col_idx, {ix.classify_sql()} as cluster from ix)""" + "".join(f", s0_{v} as materialized (select row_idx, col_idx from s0 where cluster = {v}){_components(f's0_{v}', f's{v}')}, x{v} as materialized (select row_idx, col_idx, {v} as cluster, n from {_EXPAND.format(k=f's{v}')})" for v in range(4)) + """, parts as materialized (select * from x0 union all select * from x1 union all select * from x2 union all select * from x3),
 moved as (select p.row_idx, p.col_idx, arg_min(k.cluster, ((k.row_idx - p.row_idx) * (k.row_idx - p.row_idx) + (k.col_idx - p.col_idx) * (k.col_idx - p.col_idx), k.row_idx, k.col_idx)) as cluster from (select * from parts where n < 30) p, (select * from parts where n >= 30) k group by all)
select cluster, count(*) as n from (select cluster from moved union all select cluster from parts where n >= 30) group by cluster""")
def zone_merge_small(spark, sf_dir):
    return crop.merge_small(_strips(spark, sf_dir), 30).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_MANAGED = f"""{_ZONES}, l0 as materialized (select row_idx, col_idx, cluster from zoned), box as (select max(row_idx) as r, max(col_idx) as c from l0),
 asked as (select t.row_idx, t.col_idx, least(greatest(t.row_idx + i, 0), box.r) as y, least(greatest(t.col_idx + j, 0), box.c) as x from l0 t, box, (values (-1),(0),(1)) as di(i), (values (-1),(0),(1)) as dj(j)),
 nb as (select a.row_idx, a.col_idx, list_sort(list(coalesce(o.cluster, -1))) as vs from asked a left join l0 o on o.row_idx = a.y and o.col_idx = a.x group by all),
 s0 as materialized (select row_idx, col_idx, case when vs[5] < 0 then l0.cluster else vs[5] end as cluster from nb join l0 using (row_idx, col_idx))""" + "".join(
    f", s0_{v} as materialized (select row_idx, col_idx from s0 where cluster = {v}){_components(f's0_{v}', f's{v}')}, x{v} as materialized (select row_idx, col_idx, {v} as cluster, n from {_EXPAND.format(k=f's{v}')})" for v in range(3)
) + """, parts as materialized (select * from x0 union all select * from x1 union all select * from x2),
 moved as (select p.row_idx, p.col_idx, arg_min(k.cluster, ((k.row_idx - p.row_idx) * (k.row_idx - p.row_idx) + (k.col_idx - p.col_idx) * (k.col_idx - p.col_idx), k.row_idx, k.col_idx)) as cluster from (select * from parts where n < 100) p, (select * from parts where n >= 100) k group by all),
 managed as (select z.row_idx, z.col_idx, z.ndvi, m.cluster from zoned z join (select * from moved union all select row_idx, col_idx, cluster from parts where n >= 100) m using (row_idx, col_idx))"""


@query(f"""{_MANAGED} select cluster as zone_id, list_value('lower_relative_vigor', 'typical_relative_vigor', 'higher_relative_vigor')[cluster + 1] as relative_vigor_label, count(*) as pixels, count(*)::double as area_m2, round_even(avg(ndvi), 6) as ndvi_mean, round_even(median(ndvi), 6) as ndvi_median,
 (select count(*) from zoned)::double as field_m2 from managed group by cluster having count(*) >= 100""")
def management_zones(spark, sf_dir):
    cells = cut(grid(spark, sf_dir).where(ix.CROP).select(*masks.CELL, "ndvi", "gli"), "features")
    told = crop.zone_stats(crop.management_zones(cells, ["ndvi", "gli"], 3), ["ndvi"], 3).withColumns({c: F.bround(c, 6) for c in ("ndvi_mean", "ndvi_median")})
    return quality.with_scalars(told, cells.dropna(subset=["ndvi", "gli"]).agg(F.count(F.lit(1)).cast("double").alias("field_m2")))


_SCORE = """sc{k} as materialized (select row_idx, col_idx, ndvi, gli, cluster from {of} order by md5(row_idx || ':' || col_idx || ':42') limit 5000),
  sd{k} as (select a.row_idx, a.col_idx, a.cluster, b.cluster as other, sum(sqrt(pow(a.ndvi - b.ndvi, 2) + pow(a.gli - b.gli, 2))) as d, count(*) as n from sc{k} a, sc{k} b group by all),
  sa{k} as (select row_idx, col_idx, max(case when other = cluster then d / greatest(n - 1, 1) end) as a, max(case when other = cluster then n end) as n, min(case when other <> cluster then d / n end) as b from sd{k} group by all),
  ss{k} as (select avg(case when n > 1 and greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0e0 end) as s from sa{k})"""


@query(f"{_ZONES}, {_SCORE.format(k=3, of='zoned')} select round_even(s, 6) as silhouette from ss3")
def silhouette_sample(spark, sf_dir):
    return crop.silhouette(_zones(spark, sf_dir), ["ndvi", "gli"]).select(r6("silhouette", "silhouette"))


_TRIED = {k: _lloyd_sql(k, 10, f"t{k}") for k in (2, 3, 4, 5)}


@query("".join(_TRIED[k] + ", " + _SCORE.format(k=k, of=f"zonedt{k}") for k in _TRIED) + ", scored as (" + " union all ".join(f"select {k} as k, round_even(s, 6) as silhouette, s from ss{k}" for k in _TRIED) + """), best as (select arg_max(k, (s, -k)) as k, max(s) as s from scored)
select scored.k, silhouette, scored.k = case when best.s >= 25e-2 then best.k else 2 end as chosen from scored, best""")
def zone_choice(spark, sf_dir):
    cells = held(spark, sf_dir).where(ix.CROP).select(*masks.CELL, "ndvi", "gli")
    return crop.choose_zones(cells, ["ndvi", "gli"]).withColumn("silhouette", F.bround("silhouette", 6))


@query("select cluster, count(*) as n, round_even(avg(ndvi), 6) as ndvi, rank() over (order by avg(ndvi)) - 1 = cluster as in_order from zoned group by cluster".join([_ZONES + " ", ""]))
def zone_rank_labels(spark, sf_dir):
    told = _zones(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("ndvi").alias("mean"))
    order = F.rank().over(Window.orderBy("mean")) - 1  # two to five rows
    return told.select("cluster", "n", r6("mean", "ndvi"), (order == F.col("cluster")).alias("in_order"))


@query(f"{_ZONE_STATS}, t as (select sum(area_m2) as z from zs), u as (select count(*)::double as usable from ix where {ix.CROP}) select z as zone_area_m2, usable as usable_area_m2, round_even(100 * z / usable, 6) as zone_pct, greatest(0e0, usable - z) as uncovered_m2 from t, u")
def action_coverage(spark, sf_dir):
    usable = grid(spark, sf_dir).where(ix.CROP).agg(F.count(F.lit(1)).cast("double").alias("usable_area_m2"))
    told = quality.with_scalars(_zone_stats(spark, sf_dir).agg(F.sum("area_m2").alias("zone_area_m2")), usable)
    return told.select("zone_area_m2", "usable_area_m2", F.bround(F.try_divide(100 * F.col("zone_area_m2"), F.col("usable_area_m2")), 6).alias("zone_pct"), F.greatest(F.lit(0.0), F.col("usable_area_m2") - F.col("zone_area_m2")).alias("uncovered_m2"))


# -- prescriptions over zone-like tables --------------------------------------------------------------


def _zone_table(spark, sf_dir):
    """Suppliers as zones: an index with negative values, and an area."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("zone_id"), (F.col("s_acctbal") / 1e4).alias("ndvi_mean"), (F.lit(1000.0) + F.col("s_nationkey") * 10).alias("area_m2"))


_ZT = "with z as (select s_suppkey::int as zone_id, s_acctbal / 1e4 as ndvi_mean, 1e3 + s_nationkey * 10 as area_m2 from supplier), n as (select *, (ndvi_mean - min(ndvi_mean) over ()) / (max(ndvi_mean) over () - min(ndvi_mean) over ()) as x from z)"
_RX = """, rx as (select zone_id, ndvi_mean, area_m2::double as area_m2, zone_id as rx_zone_id, round_even({rx}, 4) as "Rx_Index", round_even({rate}, 2) as "TargetRate", '{unit}' as "Rate_Unit", '{cmd}' as "Cmd_Mode", '{mode}' as "Rx_Mode", 'ndvi_mean' as "IndexFld" from n)"""
_PHYSICAL = {"mode": "physical", "operation": "fertilizer", "product_name": "urea", "rate_basis": "product", "unit": "KG_HA", "strategy": "direct", "min_rate": 100.0, "max_rate": 180.0, "approved_by": "agronomist"}
_MINMAX = _ZT + _RX.format(rx="x", rate="1e2 + x * 8e1", unit="KG_HA", cmd="physical_product_rate", mode="direct")


@query(_ZT + _RX.format(rx="1 - x", rate="(1 - x) * 1e2", unit="PCT", cmd="normalized_percent", mode="inverse") + " select * from rx", view=False)
def rx_relative_inverse(spark, sf_dir):
    return prescription.resolve(_zone_table(spark, sf_dir))


@query(_ZT + _RX.format(rx="x", rate="x * 1e2", unit="PCT", cmd="normalized_percent", mode="direct") + " select * from rx", view=False)
def rx_relative_direct(spark, sf_dir):
    return prescription.resolve(_zone_table(spark, sf_dir), {"strategy": "direct"})


@query(_MINMAX + " select * from rx", view=False)
def rx_physical_minmax(spark, sf_dir):
    return prescription.resolve(_zone_table(spark, sf_dir), _PHYSICAL)


@query(_MINMAX + """ select count(*) as zone_count, min("TargetRate") as resolved_min_rate, max("TargetRate") as resolved_max_rate, round_even(sum(area_m2 / 1e4), 6) as treated_area_ha, round_even(sum("TargetRate" * area_m2 / 1e4), 6) as estimated_total_product, 'KG' as total_product_unit from rx""", view=False)
def rx_plan_summary(spark, sf_dir):
    told = prescription.summary(prescription.resolve(_zone_table(spark, sf_dir), _PHYSICAL), "KG_HA")
    return told.withColumns({c: F.bround(c, 6) for c in ("treated_area_ha", "estimated_total_product")})


@query("""select n_nationkey as zone_id, n_regionkey::double as ndvi_mean, 100e0 + n_nationkey as "TargetRate", 'explicit' as "Rx_Mode" from nation""", view=False)
def rx_explicit_rates(spark, sf_dir):
    zones = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").cast("double").alias("ndvi_mean"))
    plan = _PHYSICAL | {"strategy": "explicit_by_zone", "min_rate": None, "max_rate": None, "zone_rates": {i: 100.0 + i for i in range(25)}}
    return prescription.resolve(zones, plan).select("zone_id", "ndvi_mean", "TargetRate", "Rx_Mode")


# -- deliverables ---------------------------------------------------------------------------------------


_BOXES = "with z as (select p_partkey as zone_id, p_retailprice as rate, (p_size % 10)::double * 8 as x0, (p_partkey % 10)::double * 2 as y0, p_size from part), b as (select zone_id, rate, x0, y0, x0 + 5 + p_size % 7 as x1, y0 + 3 as y1 from z)"


def _boxes(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("zone_id"), F.col("p_retailprice").alias("rate"), (F.col("p_size") % 10).cast("double").alias("a"), (F.col("p_partkey") % 10).cast("double").alias("b"), "p_size")
    told = part.select("zone_id", "rate", (F.col("a") * 8).alias("x0"), (F.col("b") * 2).alias("y0"), (F.col("a") * 8 + 5 + F.col("p_size") % 7).alias("x1"))
    return told.withColumn("y1", F.col("y0") + 3)


@query(f"{_BOXES}, px as ({PIXELS_SQL.format(div='//')}) select row_idx, col_idx, arg_max(rate, zone_id) as rate, count(*) as zones from px join b on row_idx + 5e-1 >= y0 and row_idx + 5e-1 < y1 and col_idx + 5e-1 >= x0 and col_idx + 5e-1 < x1 group by all", view=False)
def rate_grid_rasterize(spark, sf_dir):
    return deliverables.rate_grid(_boxes(spark, sf_dir), pixels(spark, sf_dir))


@query("""with p as (select p_size % 5 as zone_id, p_retailprice as area_m2, p_partkey::double as x0, 0e0 as y0 from part), n as (select *, row_number() over (partition by zone_id order by area_m2 desc, x0, y0) as n, sum(area_m2) over (partition by zone_id) as parent from p)
select zone_id, printf('Z%d-P%03d', zone_id, n) as patch_id, area_m2, round_even(100 * area_m2 / parent, 6) as share_pct from n where n = 1 or (area_m2 >= 1 and 100 * area_m2 / parent >= 1e-2)""", view=False)
def patch_numbers(spark, sf_dir):
    return deliverables.number_patches(table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("zone_id"), F.col("p_retailprice").alias("area_m2"), F.col("p_partkey").cast("double").alias("x0"), F.lit(0.0).alias("y0")))


@query(f"""{_BOXES} select zone_id, '<Placemark><name>Zone &amp; ' || zone_id || '</name><Polygon><outerBoundaryIs><LinearRing><coordinates>' || printf('%.8f,%.8f,0 %.8f,%.8f,0 %.8f,%.8f,0 %.8f,%.8f,0 %.8f,%.8f,0', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' as kml from b""", view=False)
def kml_text(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return b.select("zone_id", deliverables.kml_placemark(F.concat(F.lit("Zone & "), F.col("zone_id").cast("string")), deliverables.ring_text(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).alias("kml"))


@query("""select doc_id % 7 as raster_id, role, min(band) as band, count(*) as n from (select doc_id, (doc_id % 6 + 1)::int as band, case lower(replace(case doc_id % 6 when 0 then 'Red' when 1 then 'NIR' when 2 then 'red_EDGE' when 3 then 'G' when 4 then 'depth' end, '_', ' ')) when 'red' then 'red' when 'nir' then 'nir' when 'red edge' then 'red_edge' when 'g' then 'green' end as role from documents) where role is not null group by all""", view=False)
def band_role_resolve(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Red", "NIR", "red_EDGE", "G", "depth", None)]), (F.col("doc_id") % 6 + 1).cast("int"))
    return deliverables.roles_by_description(d.select((F.col("doc_id") % 7).alias("raster_id"), (F.col("doc_id") % 6 + 1).cast("int").alias("band"), name.alias("description")))


@query("""select page_id, case when c >= 6 and c - a >= 5 then 'red,green,blue,nir,red_edge' when c = 5 and c - a >= 4 then 'red,green,nir,red_edge' when c = 4 and c - a >= 4 then 'red,green,blue,nir' end as layout from (select page_id, page_id % 8 as c, page_id % 2 as a from pages)""", view=False)
def standard_layout(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(deliverables.standard_layout(F.col("page_id") % 8, F.col("page_id") % 2), ",").alias("layout"))


@query("""select path, bands from (select p_name || p_partkey as path, p_size as bands from part) order by bands desc, length(path), path limit 1""", view=False)
def candidate_rank(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("bands"))
    return deliverables.rank_rasters(found).limit(1).select("path", "bands")


@query("""with m as (select o_custkey as archive, o_orderkey as seq, (o_totalprice * 2000)::bigint as file_size from orders), w as (select *, sum(file_size) over (partition by archive order by seq) as running from m)
select archive, seq, case when file_size > 268435456 then 'size' when running > 536870912 then 'total' when file_size > 1000 * 1000000 then 'ratio' end as problem from w where file_size > 268435456 or running > 536870912""", view=False)
def zip_safety(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    members = o.select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("a/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("name"), F.bround(F.col("o_totalprice") * 2000).cast("long").alias("file_size"), F.lit(1000000).alias("compress_size"), F.lit(0).alias("mode"))
    return deliverables.unsafe_members(members)


@query("select p_size as zoom_level, count(*) as tiles from part group by all", view=False)
def mbtiles_zoom_hist(spark, sf_dir):
    return deliverables.zoom_histogram(table(spark, sf_dir, "part").select(F.col("p_size").alias("zoom_level")))


@query("select n_regionkey::varchar as name, arg_max(n_name, n_nationkey) as value from nation group by all", view=False)
def mbtiles_metadata_upsert(spark, sf_dir):
    return deliverables.upsert(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_regionkey").cast("string").alias("name"), F.col("n_name").alias("value")))


@query("select round_even(quantile_cont(red, 2e-2), 6) as lo, round_even(quantile_cont(red, 98e-2), 6) as hi from fp")
def rgb_stretch_cuts(spark, sf_dir):
    return quality.stretch_cuts(footprint(pixels(spark, sf_dir)), "red").select(r6("lo", "lo"), r6("hi", "hi"))


@query("select alpha, level // 32 as band, count(*) as n from (select coalesce(floor(least(greatest((red - lo) * 255 / (hi - lo), 0e0), 255e0))::int, 0) as level, case when red is null then 0 else 255 end as alpha from px, (select quantile_cont(red, 2e-2) as lo, quantile_cont(red, 98e-2) as hi from px)) group by all")
def rgba_stretch(spark, sf_dir):
    told = quality.stretch(pixels(spark, sf_dir), "red")
    return told.groupBy("alpha", F.floor(F.col("level") / 32).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("select row_idx, col_idx, red, green, blue from px where row_idx % 7 = 0 and col_idx % 7 = 0")
def preview_sample(spark, sf_dir):
    return decimate(pixels(spark, sf_dir), 7).select("row_idx", "col_idx", "red", "green", "blue")


@query("select row_idx // 16 as ty, col_idx // 16 as tx, round_even(avg(red), 6) as mean, count(red) as n from px group by all")
def overview_avg(spark, sf_dir):
    return quality.overview(pixels(spark, sf_dir), "red", 4).withColumn("mean", F.bround("mean", 6))


@query("select n_nationkey % 2 = 0 as gate, n_nationkey % 3 = 0 as fallback, (n_nationkey % 4)::int as zones, n_nationkey, (n_nationkey % 4) > 0 and ((n_nationkey % 2 = 0 and not n_nationkey % 3 = 0 and n_nationkey % 4 >= 2) or n_nationkey % 5 = 0) as export from nation", view=False)
def export_decision(spark, sf_dir):
    n = F.col("n_nationkey")
    told = table(spark, sf_dir, "nation").select((n % 2 == 0).alias("gate"), (n % 3 == 0).alias("fallback"), (n % 4).cast("int").alias("zones"), "n_nationkey")
    return told.withColumn("export", deliverables.export_decision(F.col("gate"), F.col("fallback"), F.col("zones"), F.lit(True), n % 5 == 0))
