"""Queries of overlays and of reprojection. Polygons are diamonds with diamonds as holes, some of which touch, whose overlays DuckDB counts as cells turned by 45 degrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrazone.operators import geometry, overlay, projection
from terrazone.plans.registry import query, r6
from terrazone.session import cut, table
from terrazone.sources.pixels import PIXELS_SQL, pixels

# centre cx, cy, radius r and radius h of the hole (0: none), all even, so that sides cross in whole points
_DIAMONDS = """select p_partkey as id, p_partkey % 20 as g, p_partkey % 40 < 20 as first_layer, (p_partkey * 37 + p_size * 11) % 101 * 2 as cx, (p_partkey * 13 + p_size * 29) % 97 * 2 as cy,
 4 + p_size % 4 * 2 as r, case when p_size % 3 = 0 then 2 + p_size % 4 * 2 else 0 end as h from part"""


def _diamonds(spark, sf_dir, cx="cx"):
    told = spark.sql(_DIAMONDS.replace("from part", "from {part}"), part=table(spark, sf_dir, "part")).withColumn("cx", F.expr(cx))
    corners = lambda r: "array({})".format(", ".join(f"struct(double({x}) as x, double({y}) as y)" for x, y in ((f"cx - {r}", "cy"), ("cx", f"cy - {r}"), (f"cx + {r}", "cy"), ("cx", f"cy + {r}"))))
    return told.withColumn("rings", F.expr(f"if(h > 0, array({corners('r')}, {corners('h')}), array({corners('r')}))"))


# u = x + y and v = x - y turn diamonds to squares; a cell of 2 by 2 there is an area of 2
_CELLS = f"""with d as ({_DIAMONDS}), lay as materialized (select distinct g, first_layer, u, v from (select *, unnest(generate_series((cx + cy - r) // 2, (cx + cy + r) // 2 - 1)) as u from d), unnest(generate_series((cx - cy - r) // 2, (cx - cy + r) // 2 - 1)) as w(v)
 where not (2 * u >= cx + cy - h and 2 * u < cx + cy + h and 2 * v >= cx - cy - h and 2 * v < cx - cy + h)),
 both_ as (select g, u, v, bool_or(first_layer) as a, bool_or(not first_layer) as b from lay group by all),
 cl as materialized (select g, 'union' as how, u, v from both_ union all select g, 'intersection', u, v from both_ where a and b union all select g, 'difference', u, v from both_ where a and not b),
 q as (select g, how, u, v, count(*) as n, bit_or(bit) as bits from (select g, how, u, v, 8 as bit from cl union all select g, how, u, v + 1, 4 from cl union all select g, how, u + 1, v, 2 from cl union all select g, how, u + 1, v + 1, 1 from cl) group by all),
 k as (select g, how, sum(case when n in (1, 3) then 1 when bits in (6, 9) then 2 else 0 end)::bigint as corners, sum(case when n = 4 then 1 else 0 end) as squares from q group by all),
 s as (select g, how, count(*) as shared from (select a.g, a.how from cl a join cl b on a.g = b.g and a.how = b.how and a.u = b.u and a.v + 1 = b.v union all select a.g, a.how from cl a join cl b on a.g = b.g and a.how = b.how and a.v = b.v and a.u + 1 = b.u) group by all),
 n as (select g, how, count(*) as cells from cl group by all)"""


@query(f"{_CELLS} select n.g, n.how, 2e0 * n.cells as area, (n.cells - coalesce(s.shared, 0) + k.squares)::bigint as parts_less_holes, k.corners from n join k using (g, how) left join s using (g, how)", view=False)
def polygon_overlay(spark, sf_dir):
    told = _diamonds(spark, sf_dir)
    laid = overlay.overlay(told.where("first_layer"), told.where("not first_layer"), "g", ("union", "intersection", "difference"), steps=1, side=16.0)
    corners = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r) - 1)
    # rings of a part that touch in a point are two here, and one where holes are what is left of cells, seen across corners
    touch = corners - F.size(F.array_distinct(F.flatten("rings")))
    return laid.groupBy("g", "how").agg(F.sum(geometry.area(F.col("rings"))).alias("area"), F.sum(2 - F.size("rings") + touch).alias("parts_less_holes"), F.sum(corners).alias("corners"))


@query(f"{_CELLS}, x as (select * from cl where how = 'union') select g, 2e0 * count(*) as area, min(u + v)::double as leftmost from x group by g", view=False)
def dissolved_zones(spark, sf_dir):
    told = cut(overlay.dissolved(_diamonds(spark, sf_dir), "g", steps=1, side=16.0), "dissolved")
    return told.groupBy("g").agg(F.sum(geometry.area(F.col("rings"))).alias("area"), F.min("part.x").alias("leftmost"))


@query(f"""with d as (select id, (cx + cy)::double as u, (cx - cy)::double as v, r from (select * replace (cx + 300 * g as cx) from ({_DIAMONDS})) where h = 0), p as (select a.id as "left", b.id as "right", (least(a.u + a.r, b.u + b.r) - greatest(a.u - a.r, b.u - b.r)) as du, (least(a.v + a.r, b.v + b.r) - greatest(a.v - a.r, b.v - b.r)) as dv from d a join d b on a.id < b.id)
 select "left", "right", du * dv / 2 as area from p where du > 0 and dv > 0""", view=False)
def zone_overlaps(spark, sf_dir):
    return overlay.overlapping(_diamonds(spark, sf_dir, "cx + 300 * g").where("h = 0"), "id", steps=1, side=16.0, digits=6)


_NEAR = "abs(c + 5e-1 - cx) + abs(w + 5e-1 - cy)"


@query(f"""with d as ({_DIAMONDS}), t as (select *, unnest(generate_series(greatest(0, cy - r), cy + r - 1)) as w from d), m as (select t.*, c from t, unnest(generate_series(greatest(0, cx - r), cx + r - 1)) as x(c))
 select w::int as row_idx, c::int as col_idx, arg_max(r * 1e0, id) as rate, count(*) as zones from m where ({_NEAR} < r or ({_NEAR} = r and c + 5e-1 < cx)) and not ({_NEAR} < h or ({_NEAR} = h and c + 5e-1 < cx)) group by all""", view=False)
def rate_grid_polygons(spark, sf_dir):
    return overlay.rasterised(_diamonds(spark, sf_dir).withColumn("rate", F.col("r").cast("double")), "rate", "id")


# triangles of degrees, some over the antimeridian; their size by the solid angle of three vectors
_TRIANGLES = """select p_partkey as id, 1.7e2 + p_partkey % 17 + 0e0 as x1, p_size * 3e0 - 75 as y1, 1.7e2 + p_partkey % 17 + 1 + p_size % 3 / 2e0 as x2, p_size * 3e0 - 75 + p_partkey % 3 / 4e0 as y2,
 1.7e2 + p_partkey % 17 + p_partkey % 5 / 4e0 as x3, p_size * 3e0 - 75 + 1 + p_partkey % 7 / 8e0 as y3 from part where p_size <= 50"""
_E2 = "669437999014e-14"
_Q = f"(sin(radians({{y}})) / (1 - {_E2} * sin(radians({{y}})) ** 2) + atanh(sqrt({_E2}) * sin(radians({{y}}))) / sqrt({_E2}))"
_FIELDS = ", ".join(f"s{i} as z{i}, sqrt(1 - s{i} * s{i}) * cos(radians(x{i})) as a{i}, sqrt(1 - s{i} * s{i}) * sin(radians(x{i})) as b{i}" for i in (1, 2, 3))
_DOT = lambda i, j: f"a{i} * a{j} + b{i} * b{j} + z{i} * z{j}"


@query(f"""with t as ({_TRIANGLES}), s as (select *, {_Q.format(y=90)} as most, {", ".join(f"{_Q.format(y=f'y{i}')} / {_Q.format(y=90)} as s{i}" for i in (1, 2, 3))} from t), v as (select id, most, {_FIELDS} from s),
 o as (select id, most, abs(a1 * (b2 * z3 - z2 * b3) - b1 * (a2 * z3 - z2 * a3) + z1 * (a2 * b3 - b2 * a3)) as vol, 1 + {_DOT(1, 2)} + {_DOT(2, 3)} + {_DOT(3, 1)} as den from v)
 select id, round_even(2 * atan2(vol, den) * most * (1 - {_E2}) * 6378137e0 ** 2 / 2 / 1e10, 6) as mega_hectares from o""", view=False)
def geographic_areas(spark, sf_dir):
    told = spark.sql(_TRIANGLES.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))
    wrap = lambda x: x - 360 * F.floor((x + 180) / 360)
    point = lambda i: F.struct(wrap(F.col(f"x{i}").cast("double")).alias("x"), F.col(f"y{i}").cast("double").alias("y"))
    rings = F.array(F.array(*[point(i) for i in (1, 2, 3, 1)]))
    return told.select("id", F.bround(geometry.geographic_hectares(rings) / 1e6, 6).alias("mega_hectares"))


# the grid as a raster in degrees: cells of a 100000th, the upper left corner at 10.2 E, 48.1 N
_LON, _LAT, _CELL = 10.2, 48.1, 1e-5


def _krueger(x: str, y: str, series: tuple[float, ...], sign: str) -> tuple[str, str]:
    """x and y with the terms of a series of the transverse Mercator projection added or taken, as SQL."""
    terms = [(f"{c!r} * cos({2 * j} * {y}) * sinh({2 * j} * {x})", f"{c!r} * sin({2 * j} * {y}) * cosh({2 * j} * {x})") for j, c in enumerate(series, 1)]
    return tuple(f"({v} {sign} " + f" {sign} ".join(t[i] for t in terms) + ")" for i, v in enumerate((x, y)))


_P = projection
_TO, _BACK = _krueger("eta", "xi", _P.ALPHA, "+"), _krueger("x", "y", _P.BETA, "-")
_PHI = "chi + " + " + ".join(f"{c!r} * sin({2 * j} * chi)" for j, c in enumerate(_P.DELTA, 1))
_S = f"{_P.SCALE * _P._RADIUS!r}"
_WARP = f"""with px as materialized ({PIXELS_SQL.format(div="//")}), n as (select max(row_idx) + 1 as rows, max(col_idx) + 1 as cols from px),
 e as (select unnest([{{'c': t * cols, 'r': 0e0}}, {{'c': t * cols, 'r': rows * 1e0}}, {{'c': 0e0, 'r': t * rows}}, {{'c': cols * 1e0, 'r': t * rows}}]) as p from n, (select unnest(range(21)) / 2e1 as t)),
 s as (select radians({_LON!r} + {_CELL!r} * p.c - 9) as lam, sin(radians({_LAT!r} - {_CELL!r} * p.r)) as s from e), t as (select lam, sinh(atanh(s) - {_P._ECC!r} * atanh({_P._ECC!r} * s)) as t from s),
 m as (select atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from t), u as (select {_P.EAST!r} + {_S} * {_TO[0]} as x, {_S} * {_TO[1]} as y from m),
 b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) / sqrt(any_value(rows) ** 2 + any_value(cols) ** 2) as size, any_value(rows) as rows, any_value(cols) as cols from u, n),
 k as (select *, floor((y1 - y0) / size + 5e-1)::int as h, floor((x1 - x0) / size + 5e-1)::int as w from b),
 cells as (select r, c, (y1 - size * (r + 5e-1)) / {_S} as y, (x0 + size * (c + 5e-1) - {_P.EAST!r}) / {_S} as x, rows, cols from k, unnest(range(h)) as rr(r), unnest(range(w)) as cc(c)),
 i as (select r, c, rows, cols, {_BACK[0]} as eta, {_BACK[1]} as xi from cells), j as (select r, c, rows, cols, 9 + degrees(atan2(sinh(eta), cos(xi))) as lon, asin(sin(xi) / cosh(eta)) as chi from i),
 at_ as (select r, c, rows, cols, ({_LAT!r} - degrees({_PHI})) / {_CELL!r} - 5e-1 as sr, (lon - {_LON!r}) / {_CELL!r} - 5e-1 as sc from j),
 q as materialized (select r, c, sr, sc from at_ where sr >= -5e-1 and sr < rows - 5e-1 and sc >= -5e-1 and sc < cols - 5e-1),
 f as (select q.*, floor(sr) + o.i as nr, floor(sc) + o.j as nc, (case o.i when 0 then 1 - (sr - floor(sr)) else sr - floor(sr) end) * (case o.j when 0 then 1 - (sc - floor(sc)) else sc - floor(sc) end) as wt from q, (values (0, 0), (0, 1), (1, 0), (1, 1)) as o(i, j)),
 v as (select f.r, f.c, coalesce(bool_or(nr = floor(sr + 5e-1) and nc = floor(sc + 5e-1) and red is not null and not (red = 0 and nir = 0)), false) as valid, sum(case when red is not null then wt * red end) / sum(case when red is not null then wt end) as red, sum(wt * nir) / sum(case when nir is not null then wt end) as nir
  from f left join px on nr = row_idx and nc = col_idx group by f.r, f.c)"""


@query(f"{_WARP} select (r // 16)::int as band, count(*) as cells, count(*) filter (valid) as usable, round_even(avg(red) filter (valid), 6) as red, round_even(avg(nir) filter (valid), 6) as nir from v group by all", view=False)
def reprojected_bands(spark, sf_dir):
    px = pixels(spark, sf_dir).select("row_idx", "col_idx", "red", "nir", F.expr("red is not null and not (red = 0 and nir = 0)").alias("valid"))
    size = px.agg(F.max("row_idx"), F.max("col_idx")).first()
    source = projection.Grid(size[0] + 1, size[1] + 1, (_CELL, 0.0, _LON, 0.0, -_CELL, _LAT), 4326)
    told, _ = projection.to_metric(px, source, ["red", "nir"], "valid", tile=64)
    return told.groupBy(F.expr("int(row_idx div 16)").alias("band")).agg(F.count(F.lit(1)).alias("cells"), F.count_if("valid").alias("usable"), r6(F.avg(F.when(F.col("valid"), F.col("red"))), "red"), r6(F.avg(F.when(F.col("valid"), F.col("nir"))), "nir"))
