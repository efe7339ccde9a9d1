"""Queries of geometry and of deliverables as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrazone.functions import indices as ix
from terrazone.operators import deliverables, geometry, masks, outlines, quality, texts
from terrazone.plans.registry import _BOXES, _ZONE_STATS, _CROP_CELLS, _boxes, _components, _zone_stats, grid, held, query, r6
from terrazone.session import cut, table
from terrazone.sources.pixels import pixels, with_indices

_B = ("x0", "y0", "x1", "y1")
_RING = "printf('[%.8f,%.8f],[%.8f,%.8f],[%.8f,%.8f],[%.8f,%.8f],[%.8f,%.8f]', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)"


def _ring():
    return F.array(geometry.box_ring(*[F.col(c) for c in _B]))


@query(f"{_BOXES} select count(*) as pairs, round_even(sum(area), 6) as area from (select (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as area from b a join b on a.zone_id < b.zone_id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)", view=False)
def rx_overlap_check(spark, sf_dir):
    return geometry.overlap_totals(_boxes(spark, sf_dir)).select("pairs", r6("area", "area"))


_UNION = f"""{_BOXES}, bb as (select zone_id % 7 as g, x0 + p_size / 9e1 as x0, y0, x1, y1 from b), xs as (select g, x, lead(x) over (partition by g order by x) as nx from (select distinct g, unnest([x0, x1]) as x from bb)),
 sl as (select bb.g, x, nx - x as w, y0, y1, max(y1) over (partition by bb.g, x order by y0, y1 rows between unbounded preceding and 1 preceding) as reach from bb join xs on bb.g = xs.g and x0 <= x and nx <= x1)"""
_UNION = _UNION.replace("select zone_id, rate, x0, y0, x0 + 5", "select zone_id, rate, p_size, x0, y0, x0 + 5")


@query(f"{_UNION} select g, round_even(sum(w * greatest(0e0, y1 - greatest(y0, coalesce(reach, y0)))), 6) as area from sl group by g", view=False)
def union_areas(spark, sf_dir):
    return geometry.union_area(_grouped_boxes(spark, sf_dir), "g").select("g", r6("area", "area"))


def _grouped_boxes(spark, sf_dir):
    size = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("zone_id"), "p_size")
    return _boxes(spark, sf_dir).join(size, "zone_id").select((F.col("zone_id") % 7).alias("g"), (F.col("x0") + F.col("p_size") / 90.0).alias("x0"), "y0", "x1", "y1")


@query(f"{_UNION} select g, round_even(1e2 * 4e1 - sum(w * greatest(0e0, y1 - greatest(y0, coalesce(reach, y0)))), 6) as area from sl group by g", view=False)
def spot_area_of_interest(spark, sf_dir):
    holes = _grouped_boxes(spark, sf_dir)
    whole = holes.select("g").distinct().select("g", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(40.0).alias("y1"))
    return geometry.difference_area(whole, holes, "g").select("g", r6("area", "area"))


@query(f"{_BOXES} select zone_id, (x1 - x0) * (y1 - y0) as area, x0 as min_x, y0 as min_y, x1 as max_x, y1 as max_y, true as valid, x0 <= 20 and x1 > 20 and y0 <= 45e-1 and y1 > 45e-1 as inside from b", view=False)
def polygon_measures(spark, sf_dir):
    told = geometry.with_validity(_boxes(spark, sf_dir).withColumn("rings", _ring()).withColumn("b", geometry.bounds(F.col("rings"))), "zone_id")
    return told.select("zone_id", geometry.area(F.col("rings")).alias("area"), "b.*", "valid", geometry.contains(F.col("rings"), F.lit(20.0), F.lit(4.5)).alias("inside"))


@query(f"{_BOXES} select min(x0) as min_x, min(y0) as min_y, max(x1) as max_x, max(y1) as max_y from b", view=False)
def total_bounds(spark, sf_dir):
    b = _boxes(spark, sf_dir).select(geometry.bounds(_ring()).alias("b"))
    return b.agg(F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"), F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y"))


@query("""select p_partkey, ok, round_even(error, 6) as error_pct, round_even(greatest(5e-2, least(25e-2, sqrt(greatest(a, 1) / 25e4))), 6) as resolution from (select p_partkey, p_retailprice as a, 100 * ((p_retailprice + p_size % 40) - p_retailprice) / p_retailprice as error, abs(error) <= 2 as ok from part)""", view=False)
def rate_grid_area_check(spark, sf_dir):
    a = F.col("p_retailprice")
    told = table(spark, sf_dir, "part").select("p_partkey", geometry.area_check(a + F.col("p_size") % 40, a).alias("c"), r6(geometry.grid_resolution(a), "resolution"))
    return told.select("p_partkey", "c.ok", r6("c.error_pct", "error_pct"), "resolution")


@query(f"{_CROP_CELLS}{_components('cells', 'k')} select (lbl // 100000)::int as label_row, (lbl % 100000)::int as label_col, n::double as raster_area, n::double as outline_area, 0e0 as delta_pct from k_size where n >= 20")
def zone_area_consistency(spark, sf_dir):
    cells = masks.label_cells(held(spark, sf_dir).where(ix.CROP))
    size = cells.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("raster_area")).where("raster_area >= 20")
    told = outlines.multipolygons(cells.join(size.select("label"), "label", "left_semi")).join(size, "label").withColumn("outline_area", geometry.parts_area(F.col("parts")))
    return told.select(F.floor(F.col("label") / (1 << 31)).cast("int").alias("label_row"), (F.col("label") % (1 << 31)).cast("int").alias("label_col"), "raster_area", "outline_area", (100 * (F.col("outline_area") - F.col("raster_area")) / F.col("raster_area")).alias("delta_pct"))


# cells of four patterns around every corner tell rings and corners without any tracing: parts less holes are cells - shared sides + full squares of four
_AROUND = f""", cl as materialized (select row_idx as r, col_idx as c, {ix.classify_sql()} as k from ix),
 q as (select k, r, c, count(*) as n, bit_or(bit) as bits from (select k, r, c, 8 as bit from cl union all select k, r, c + 1, 4 from cl union all select k, r + 1, c, 2 from cl union all select k, r + 1, c + 1, 1 from cl) group by k, r, c),
 s as (select k, count(*) as shared from (select a.k from cl a join cl b on a.k = b.k and a.r = b.r and a.c + 1 = b.c union all select a.k from cl a join cl b on a.k = b.k and a.c = b.c and a.r + 1 = b.r) group by k)"""


@query(f"""{_AROUND} select a.k as cls, a.cells::double as area, a.cells::double as rings_area, a.cells - coalesce(s.shared, 0) + coalesce(f.full_, 0) as parts_less_holes, f.corners from (select k, count(*) as cells from cl group by k) a left join s on a.k = s.k
 left join (select k, count(*) filter (n = 4) as full_, sum(case when n in (1, 3) then 1 when bits in (6, 9) then 2 else 0 end)::bigint as corners from q group by k) f on a.k = f.k""")
def class_multipolygons(spark, sf_dir):
    cells = held(spark, sf_dir).select("row_idx", "col_idx", F.expr(ix.classify_sql()).alias("cls"))
    told = cut(outlines.multipolygons(cells, "cls"), "class-polygons")
    each = told.select("cls", "parts", F.flatten("parts").alias("rings"))
    size = cells.groupBy("cls").agg(F.count(F.lit(1)).cast("double").alias("area"))
    corners = F.aggregate(F.transform("rings", lambda r: F.size(r) - 1), F.lit(0), lambda a, n: a + n).cast("long")
    return each.select("cls", geometry.parts_area(F.col("parts")).alias("rings_area"), (2 * F.size("parts") - F.size("rings")).cast("long").alias("parts_less_holes"), corners.alias("corners")).join(size, "cls")


# quadrangles, some of which cross themselves or turn back
_QUADS = "select p_partkey as k, array(0, p_partkey % 5 + 1, p_partkey % 7, p_size % 6) as x, array(0, p_size % 4, p_partkey % 4 + 1, p_size % 3 + 2) as y from part"
_SIDE_OF = "sign((x[{q}] - x[{p}]) * (y[{s}] - y[{p}]) - (y[{q}] - y[{p}]) * (x[{s}] - x[{p}]))"


def _meet(a: tuple[int, int], b: tuple[int, int]) -> str:
    """Whether two sides of a quadrangle have a point in common, as SQL: by their boxes and by which side of one the other's ends are."""
    w = lambda p, q, s: _SIDE_OF.format(p=p, q=q, s=s)
    box = " and ".join(f"greatest(least({v}[{a[0]}], {v}[{a[1]}]), least({v}[{b[0]}], {v}[{b[1]}])) <= least(greatest({v}[{a[0]}], {v}[{a[1]}]), greatest({v}[{b[0]}], {v}[{b[1]}]))" for v in "xy")
    return f"({w(*a, b[0])} * {w(*a, b[1])} <= 0 and {w(*b, a[0])} * {w(*b, a[1])} <= 0 and {box})"


def _back(p: int, q: int, s: int) -> str:
    return f"({_SIDE_OF.format(p=p, q=q, s=s)} = 0 and (x[{q}] - x[{p}]) * (x[{s}] - x[{q}]) + (y[{q}] - y[{p}]) * (y[{s}] - y[{q}]) < 0)"


_QUAD_BAD = " or ".join([_meet((1, 2), (3, 4)), _meet((2, 3), (4, 1)), *[_back(*t) for t in ((1, 2, 3), (2, 3, 4), (3, 4, 1), (4, 1, 2))]])
_APART = " and ".join(f"(x[{p}] <> x[{q}] or y[{p}] <> y[{q}])" for p, q in ((1, 2), (2, 3), (3, 4), (4, 1)))


@query(f"""with f as ({_QUADS.replace("array(", "list_value(")}), g as (select *, x[1] * y[2] - x[2] * y[1] + x[2] * y[3] - x[3] * y[2] + x[3] * y[4] - x[4] * y[3] + x[4] * y[1] - x[1] * y[4] as twice from f where {_APART})
 select k as part_id, twice <> 0 and not ({_QUAD_BAD}) as valid from g""", view=False)
def polygon_validity(spark, sf_dir):
    quads = spark.sql(_QUADS.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))
    corner = lambda i: F.struct(F.col("x")[i].cast("double").alias("x"), F.col("y")[i].cast("double").alias("y"))
    told = quads.select(F.col("k").alias("part_id"), F.array(F.array(*[corner(i) for i in (0, 1, 2, 3, 0)])).alias("rings"))
    apart = F.forall(geometry._sides(F.col("rings")[0]), lambda s: s["p"] != s["q"])
    return geometry.with_validity(told.where(apart), "part_id").select("part_id", "valid")


@query(f"""{_BOXES} select zone_id, '{{"geometry":{{"coordinates":[[' || {_RING} || ']],"type":"Polygon"}},"properties":{{"name":"Zone \\"' || zone_id || '\\"","zone_id":' || zone_id || '}},"type":"Feature"}}' as feature from b""", view=False)
def geojson_text(spark, sf_dir):
    told = _boxes(spark, sf_dir)
    return told.select("zone_id", texts.geojson_feature(_ring(), F.struct("zone_id", F.concat(F.lit('Zone "'), F.col("zone_id").cast("string"), F.lit('"')).alias("name"))).alias("feature"))


@query("""select p_partkey, p_partkey || ',' || case when contains(n, ',') or contains(n, '"') then '"' || replace(n, '"', '""') || '"' else n end || ',' || case when p_size % 3 = 0 then '' else p_size::varchar end as line from (select *, case p_partkey % 3 when 0 then p_name || ', x' when 1 then '"' || p_name || '"' else p_name end as n from part)""", view=False)
def csv_text(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    told = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, F.concat(name, F.lit(", x"))).when(k % 3 == 1, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name).alias("n"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("s"))
    return told.select("p_partkey", texts.csv_line(told).alias("line"))


@query("""select n_nationkey, '{"a":{"x":null,"y":' || n_nationkey || '},"b":["' || n_name || '"],"z":' || (n_regionkey = 1)::varchar || '}' as text from nation""", view=False)
def json_sorted(spark, sf_dir):
    nested = F.struct((F.col("n_regionkey") == 1).alias("z"), F.array("n_name").alias("b"), F.struct(F.col("n_nationkey").alias("y"), F.lit(None).cast("int").alias("x")).alias("a"))
    return table(spark, sf_dir, "nation").select("n_nationkey", texts.json_text(nested).alias("text"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'extra' || n_nationkey else 'base' end as a, n_name as b, case when n_nationkey % 2 = 0 then 'new' end as c from nation", view=False)
def outputs_merged(spark, sf_dir):
    k = F.col("n_nationkey")
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.col("n_name"))
    more = F.when(k % 2 == 0, F.create_map(F.lit("a"), F.concat(F.lit("extra"), k.cast("string")), F.lit("c"), F.lit("new"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    told = table(spark, sf_dir, "nation").select("n_nationkey", texts.merged(base, more).alias("m"))
    return told.select("n_nationkey", *[F.try_element_at("m", F.lit(x)).alias(x) for x in "abc"])


_SEVERITY = "['High', 'very high', 'medium', 'low', '1', '2.0', '3', '9', '', 'x'][p_size % 10 + 1]"


@query(f"""select p_partkey, case when lower(v) like '%high%' or r = 1 then 'severity_high' when lower(v) like '%medium%' or r = 2 then 'severity_medium' when lower(v) like '%low%' or r >= 3 then 'severity_low' else 'severity_medium' end as style,
 case when p_size % 4 = 0 then 'zone_a' when p_size % 4 = 1 then 'zone_b' else 'plain' end as row_style from (select *, {_SEVERITY} as v, try_cast({_SEVERITY} as double)::int as r from part)""", view=False)
def kml_styles(spark, sf_dir):
    words = ("High", "very high", "medium", "low", "1", "2.0", "3", "9", "", "x")
    size = F.col("p_size")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), size % 10 + 1)
    raw = F.when(size % 4 == 0, "a").when(size % 4 == 1, "zone_b").when(size % 4 == 2, "q")
    return table(spark, sf_dir, "part").select("p_partkey", texts.severity_style(word).alias("style"), texts.style_of(raw, ("zone_a", "zone_b"), "plain", "zone_").alias("row_style"))


@query("select p_partkey, case when p_size % 5 < 5 then ['Lowest relative vigor', 'Typical relative vigor', 'High priority', 'Odd Patch Name', 'Watch'][p_size % 5 + 1] end as label, case when p_size % 2 = 0 then '#00ff00' else 'ff563412' end as colour, case when x < 1 then printf('%.4f', x) else printf('%,.2f', x) end as number from (select *, p_retailprice * (p_size % 3) / 4e3 as x from part)".replace("printf('%,.2f', x)", "format('{:,.2f}', x)"), view=False)
def report_labels(spark, sf_dir):
    size = F.col("p_size")
    label = F.element_at(F.array(*[F.lit(w) for w in ("lowest_relative_vigor", "typical_relative_vigor", "critical", "odd_patch_name", "watch")]), size % 5 + 1)
    number = F.col("p_retailprice") * (size % 3) / 4e3
    return table(spark, sf_dir, "part").select("p_partkey", texts.farmer_label(label).alias("label"), F.when(size % 2 == 0, F.lit("#00ff00")).otherwise(ix.kml_colour(F.lit("#123456"))).alias("colour"), texts.kml_number(number).alias("number"))


_PARTS = """with p as (select p_partkey % 9 as id, p_partkey, (p_size % 30)::double / 1e1 as s, p_partkey::double as x from part), n as (select *, row_number() over (partition by id order by s * s desc, x) as n, sum(s * s) over (partition by id) as whole from p),
 k as (select *, row_number() over (partition by id order by n) as m from n where n = 1 or (s * s >= 1 and 100 * s * s / whole >= 1e-2))"""


@query(f"{_PARTS} select id, printf('Z%d-P%03d', id, m) as patch_id, round_even(s * s, 6) as area_m2, round_even(100 * s * s / whole, 6) as share_pct from k", view=False)
def patch_explode(spark, sf_dir):
    return _patches(spark, sf_dir).select("id", "patch_id", r6("area_m2", "area_m2"), r6("share_pct", "share_pct"))


def _patches(spark, sf_dir):
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % 9).alias("id"), ((F.col("p_size") % 30) / 10.0).alias("s"), F.col("p_partkey").cast("double").alias("x"))
    boxes = part.withColumn("p", F.array(geometry.box_ring(F.col("x"), F.lit(0.0), F.col("x") + F.col("s"), F.col("s"))))
    # sizes of exact squares: sides that start at x would round
    return texts.exploded(boxes.groupBy("id").agg(F.collect_list("p").alias("parts")), lambda p: F.bround(geometry.area(p), 6))


@query(f"{_PARTS} select id, count(*) as kept, (select count(*) from n where n.id = k.id) - count(*) as slivers from k group by id", view=False)
def patch_filter(spark, sf_dir):
    kept = _patches(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("kept"))
    every = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 9).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return kept.join(every, "id").select("id", "kept", (F.col("n") - F.col("kept")).alias("slivers"))


@query(f"""{_BOXES} select zone_id, '<Placemark><name>Z&lt;' || zone_id || '</name><styleUrl>#severity_medium</styleUrl><description>Rate: ' || format('{{:,.2f}}', rate) || '&#10;Kind &amp; unit: kg</description><MultiGeometry>' || p || p || '</MultiGeometry></Placemark>' as kml
 from (select *, '<Polygon><outerBoundaryIs><LinearRing><coordinates>' || printf('%.8f,%.8f,0 %.8f,%.8f,0 %.8f,%.8f,0 %.8f,%.8f,0 %.8f,%.8f,0', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) || '</coordinates></LinearRing></outerBoundaryIs></Polygon>' as p from b)""", view=False)
def kml_features(spark, sf_dir):
    told = _boxes(spark, sf_dir)
    description = texts.kml_description({"Rate": texts.kml_number(F.col("rate")), "Kind & unit": F.lit("kg")})
    return told.select("zone_id", texts.kml_feature(F.concat(F.lit("Z<"), F.col("zone_id").cast("string")), texts.severity_style(F.lit(None)), description, texts.kml_geometry(F.array(_ring(), _ring()))).alias("kml"))


@query("""select path, '{"path":"' || path || '","sha256":"' || sha256(text) || '","size_bytes":' || octet_length(encode(text)) || '}' as line from (select 'out/' || lpad(doc_id::varchar, 9, '0') || '.txt' as path, text from documents where text is not null)""", view=False)
def manifest_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return texts.manifest(d.select(F.concat(F.lit("out/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content")))


@query(f"""{_ZONE_STATS}, t as (select sum(area_m2) as z from zs), u as (select count(*)::double as usable, count(*) < 500 as few from ix where {ix.CROP}), o as (select 100 * avg(case when abs(nir) > 1 then 1e0 else 0e0 end) as pct from px where nir is not null)
select seq, code, message from (select 0 as seq, 'few_crop_cells' as code, 'zones may be unstable' as message, few as said from u union all select 1, 'coverage', 'zones cover ' || printf('%.1f', 100 * z / usable) || '% of the usable area', 100 * z / usable < 95 from t, u
 union all select 2, 'always', 'operator review is required', true union all select 3, 'outside', 'values outside [0, 1]', pct > 0 from o) where said""")
def warnings_log(spark, sf_dir):
    usable = grid(spark, sf_dir).where(ix.CROP).agg(F.count(F.lit(1)).cast("double").alias("usable"))
    told = quality.with_scalars(_zone_stats(spark, sf_dir).agg(F.sum("area_m2").alias("z")), usable)
    far = pixels(spark, sf_dir).agg(quality.share(F.abs("nir") > 1).alias("outside_pct"))
    told = quality.with_scalars(told, far)
    pct = 100 * F.col("z") / F.col("usable")
    return texts.warnings_log([("few_crop_cells", F.col("usable") < 500, F.lit("zones may be unstable")), ("coverage", pct < 95, F.concat(F.lit("zones cover "), F.format_string("%.1f", pct), F.lit("% of the usable area"))), ("always", F.lit(True), F.lit("operator review is required")), ("outside", F.col("outside_pct") > 0, F.lit("values outside [0, 1]"))], told)


@query("select n_nationkey, case when n_nationkey % 4 = 3 then null else array_to_string([case when n_nationkey % 2 = 0 then 'a' end, case when n_nationkey % 4 < 2 then 'b' end], '+') end as told from nation", view=False)
def notices_selected(spark, sf_dir):
    k = F.col("n_nationkey")
    text = texts.notices(k % 2 != 0, k % 4 < 2)
    short = F.concat_ws("+", F.when(F.contains(text, F.lit("absolute")), "a"), F.when(F.contains(text, F.lit("footprint")), "b"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(text.isNotNull(), short).alias("told"))


@query("""select archive, name from (select *, row_number() over (partition by archive order by not contains(lower(name), 'ortho'), length(name), name) as n from (select p_size as archive, p_name || case p_partkey % 5 when 0 then '_Ortho' else '' end || p_partkey || case p_partkey % 3 when 0 then '.TIF' when 1 then '.tiff' else '.txt' end as name from part) where lower(name) like '%.tif' or lower(name) like '%.tiff') where n = 1""", view=False)
def zip_member_pick(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 5 == 0, "_Ortho").otherwise(""), k.cast("string"), F.when(k % 3 == 0, ".TIF").when(k % 3 == 1, ".tiff").otherwise(".txt"))
    return deliverables.pick_member(table(spark, sf_dir, "part").select(F.col("p_size").alias("archive"), name.alias("name")))


@query("select doc_id, trim(regexp_replace(s, '[^\\p{L}\\p{N}_-]', '_', 'g'), '_') as name, round_even(log2(15654303392804097e-11 / (1 + doc_id % 900)), 0)::int as zoom, case when la <= 84 then case when doc_id % 2 = 0 then 32700 else 32600 end + greatest(1, least(60, floor((lo + 180) / 6) + 1)) end::int as epsg from (select *, 'f_' || source || ' é/' || doc_id as s, (doc_id % 90)::double as la, (doc_id % 361 - 180)::double as lo from documents)", view=False)
def names_and_zooms(spark, sf_dir):
    k = F.col("doc_id")
    lat, lon = (k % 90).cast("double") * F.when(k % 2 == 0, -1.0).otherwise(1.0), (k % 361 - 180).cast("double")
    lat = F.when((lat == 0) & (k % 2 == 0), -1e-9).otherwise(lat)
    return table(spark, sf_dir, "documents").select("doc_id", ix.safe_name(F.concat(F.lit("f_"), "source", F.lit(" é/"), k.cast("string")), "x").alias("name"), deliverables.auto_zoom((1 + k % 900).cast("double")).alias("zoom"), ix.utm_zone(lon, lat).alias("epsg"))


@query("select sum(case when red is null and nir is null then 0 when red = 0 and green = 0 and blue = 0 and nir = 0 and red_edge = 0 then 1 else 0 end)::bigint as excluded, count(*) as cells from px")
def zero_background(spark, sf_dir):
    return pixels(spark, sf_dir).agg(F.count_if(F.coalesce(F.expr(ix.ALL_ZERO), F.lit(False))).alias("excluded"), F.count(F.lit(1)).alias("cells"))


@query(f"select sum(case when {ix.SHADOW} then 1 else 0 end)::bigint as shadow, sum(case when green > nir + 1e-1 then 1 else 0 end)::bigint as water, sum(case when {ix.SHADOW} or green > nir + 1e-1 then 1 else 0 end)::bigint as excluded from ix")
def shadow_water_screen(spark, sf_dir):
    wet = ix.water(0.1)
    return grid(spark, sf_dir).agg(F.count_if(F.expr(ix.SHADOW)).alias("shadow"), F.count_if(wet).alias("water"), F.count_if(F.expr(ix.SHADOW) | wet).alias("excluded"))


@query("select case when red is null or (red = 0 and nir = 0) then 255 when ndvi >= 2e-1 then 1 else 0 end as code, count(*) as n from (select px.*, (nir - red) / nullif(nir + red, 0) as ndvi from px) group by all")
def crop_mask_codes(spark, sf_dir):
    px = with_indices(pixels(spark, sf_dir), ("ndvi",))
    usable = F.col("red").isNotNull() & ~((F.col("red") == 0) & (F.col("nir") == 0))
    return px.groupBy(ix.mask_code(usable, F.col("ndvi") >= ix.CROP_NDVI).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CROP_CELLS} select round_even(100e0 * (select count(*) from cells) / count(*), 6) as crop_pct from ix where ndvi is not null")
def crop_share(spark, sf_dir):
    return grid(spark, sf_dir).where("ndvi is not null").agg(r6(100.0 * F.count_if(F.expr(ix.CROP)) / F.count(F.lit(1)), "crop_pct"))
