from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazone import session
from terrazone.functions import indices as ix
from terrazone.operators import crop, deliverables, geometry, masks, outlines, prescription, quality, rules, texts
from terrazone.sources.pixels import mask_bands

PLAN = {"mode": "physical", "operation": "spray", "product_name": "lime", "rate_basis": "nutrient", "unit": "l_ha", "strategy": "explicit_by_zone", "zone_rates": {4: 35, 7: 20.5, 9: 50}, "equipment_min_rate": 20, "equipment_max_rate": 60, "approved_by": "me"}
BOUNDS = {"mode": "physical", "operation": "seeding", "product_name": "oats", "rate_basis": "product", "unit": "SEEDS_HA", "strategy": "direct", "min_rate": 10.0, "max_rate": 30.0, "approved_by": "me"}


@pytest.fixture
def zones(spark):
    return spark.createDataFrame([(4, -0.1, 20000.0), (7, 0.15, 5000.0), (9, 0.4, 1000.0)], "zone_id int, ndvi_mean double, area_m2 double")


def test_relative_plan(zones):
    rows = prescription.resolve(zones).orderBy("zone_id").collect()
    assert [r.TargetRate for r in rows] == [100, 50, 0] and {r.Rate_Unit for r in rows} == {"PCT"}
    assert [r.TargetRate for r in prescription.resolve(zones, BOUNDS).orderBy("zone_id").collect()] == [10, 20, 30]


def test_explicit_plan(zones):
    rx = prescription.resolve(zones, PLAN)
    assert {r.zone_id: r.TargetRate for r in rx.collect()} == {4: 35, 7: 20.5, 9: 50} and {r.Rate_Unit for r in rx.collect()} == {"L_HA"}
    assert prescription.summary(rx, "L_HA").first().estimated_total_product == pytest.approx(35 * 2 + 20.5 * 0.5 + 50 * 0.1)


@pytest.mark.parametrize("change", [
    {"approved_by": " "}, {"product_name": None}, {"unit": "PCT"}, {"zone_rates": {4: 35, 7: 20}}, {"zone_rates": {4: 35, 7: 20.5, 9: 50, 11: 30}}, {"zone_rates": {}}, {"zone_rates": {4.5: 35, 7: 21, 9: 50}},
    {"zone_rates": {4: -1, 7: 21, 9: 50}}, {"zone_rates": {4: float("inf"), 7: 21, 9: 50}}, {"min_rate": 1.0, "max_rate": 2.0}, {"operation": "mow"}, {"rate_basis": None}, {"mode": "maybe"}, {"strategy": "target_hotspots"}, {"equipment_min_rate": 70}, {"mode": "relative"},
])
def test_refused_plans(zones, change):
    with pytest.raises(ValueError):
        prescription.resolve(zones, PLAN | change).collect()


def test_all_faults_are_named_at_once(spark):
    with pytest.raises(ValueError, match="operation.*product_name.*approved_by"):
        prescription.RatePlan.of(PLAN | {"operation": None, "product_name": "", "approved_by": ""}).check(spark)
    with pytest.raises(TypeError):
        prescription.RatePlan.of("plan")
    with pytest.raises(TypeError):
        prescription.RatePlan.of({"dose": 3})


def test_rate_beyond_equipment(zones):
    for change in ({"equipment_max_rate": 40}, {"equipment_min_rate": 21}):
        with pytest.raises(Exception, match="beyond"):
            prescription.resolve(zones, PLAN | change).collect()


@pytest.mark.parametrize("rates", [{"min_rate": 5.0}, {"base_rate": 5.0}, {"min_rate": -1.0, "max_rate": 2.0}, {"min_rate": 3.0, "max_rate": 2.0}, {"min_rate": 0.0, "max_rate": float("inf")}, {"response": "both"}, {"field": "ndre_mean"}])
def test_refused_rates(zones, rates):
    with pytest.raises(ValueError):
        prescription.prescribe(zones, **rates)


def test_refused_zones(spark, zones):
    for rows in ([(1.5, 0.2)], [(1.0, 0.2), (1.0, 0.3)], [(1.0, None), (2.0, 0.3)], [(1.0, float("nan")), (2.0, 0.3)], [(None, 0.1)]):
        with pytest.raises(Exception, match="zone"):
            prescription.prescribe(spark.createDataFrame(rows, "zone_id double, ndvi_mean double")).collect()
    numbered = prescription.prescribe(spark.createDataFrame([(0.2,), (0.1,)], "NDVI double")).orderBy("rx_zone_id").collect()
    assert [(r.rx_zone_id, r.Rx_Index, r.IndexFld) for r in numbered] == [(1, 1.0, "NDVI"), (2, 0.0, "NDVI")]


def test_ready_prescriptions_are_used(spark, zones):
    columns = "Zone_ID int, Rx_Index double, TargetRate double, Rate_Unit string, Cmd_Mode string, Rx_Mode string"
    good = spark.createDataFrame([(1, 0.5, 90.0, "PCT", "c", "r"), (2, 1.0, 130.0, "KG_HA", "c", "r")], columns)
    assert prescription.prescription_or_build(good) is good
    assert "IndexFld" in prescription.prescription_or_build(zones).columns
    for bad in ((2, 0.5, 101.0, "pct", "c", "r"), (1, 0.5, 1.0, "PCT", "c", "r"), (3, 1.1, 1.0, "PCT", "c", "r"), (3, 0.1, -1.0, "PCT", "c", "r"), (None, 0.1, 1.0, "PCT", "c", "r")):
        with pytest.raises(ValueError):
            prescription.prescription_or_build(good.where("Zone_ID = 1").unionByName(spark.createDataFrame([bad], columns)))


@pytest.mark.parametrize("rate", [(-1.0, None, "PCT"), (101.0, None, "pct"), (float("nan"), None, "L_HA"), (5.0, -2.0, "L_HA")])
def test_refused_spot_rates(spark, rate):
    with pytest.raises(ValueError):
        prescription.spot_prescription(spark.createDataFrame([(1,)], "severity_rank int"), *rate)


def test_field_pixels():
    assert rules.field_pixels(600, 900) == ("crop", []) and rules.field_pixels(20, 20)[0] == "crop" and len(rules.field_pixels(20, 20)[1]) == 1
    assert rules.field_pixels(19, 20)[0] == "finite" and len(rules.field_pixels(19, 20)[1]) == 2
    with pytest.raises(ValueError):
        rules.field_pixels(3, 19)


@pytest.mark.parametrize("args", [{"k_range": (1, 3)}, {"k_range": (4, 3)}, {"k_range": (2, 6)}, {"sample": 4}, {"features": ["a", "a"]}, {"features": ["a", "c"]}])
def test_refused_zone_ranges(spark, args):
    df = spark.range(300).selectExpr("cast(id as int) as row_idx", "0 as col_idx", "cast(id % 7 as double) as a", "cast(id as double) as b")
    with pytest.raises(ValueError):
        crop.choose_zones(df, **({"features": ["a", "b"]} | args))


def test_number_of_zones(spark):
    rows = [(i, 0, 10.0 * (i % 3) + (i % 5) / 50, (i % 4) / 50) for i in range(400)]
    df = spark.createDataFrame(rows, "row_idx int, col_idx int, a double, b double")
    assert [r.k for r in crop.choose_zones(df, ["a", "b"]).where("chosen").collect()] == [3]
    flat = spark.createDataFrame([(i, 0, 1.0, 2.0) for i in range(400)], "row_idx int, col_idx int, a double, b double")
    assert [r.k for r in crop.choose_zones(flat, ["a", "b"]).where("chosen").collect()] == [2]
    with pytest.raises(ValueError, match="too few"):
        crop.choose_zones(df.limit(19), ["a", "b"])


def test_quantiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(quality, "PICK", 40)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(5000), np.full(3000, 0.25), rng.standard_normal(100) * 1e9])
    group = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(group, x)] + [(9, None), (9, 1.5)], "g int, x double")
    shares = [0.0, 0.02, 0.1, 0.5, 0.777, 0.98, 1.0]
    assert quality.quantiles(df.where("g < 9"), "x", shares) == pytest.approx(np.quantile(x, shares).tolist())
    found = quality.quantiles(df, "x", shares, "g")
    assert found[9] == [1.5] * 7 and all(found[g] == pytest.approx(np.quantile(x[group == g], shares).tolist()) for g in range(3))
    assert quality.quantiles(df.where("g = 77"), "x", [0.5]) == [None]


def test_neighbourhoods_over_tiles(spark, monkeypatch):
    """Erosion, opening with closing and the median on small tiles equal plain loops."""
    monkeypatch.setattr(masks, "SIDE", 5)
    rng = np.random.default_rng(4)
    present, on, label = rng.random((17, 13)) < 0.93, rng.random((17, 13)) < 0.8, rng.integers(0, 4, (17, 13))
    rows = [(r, c, bool(on[r, c]), int(label[r, c]), f"{r}") for r in range(17) for c in range(13) if present[r, c]]
    df = spark.createDataFrame(rows, "row_idx int, col_idx int, v boolean, label int, more string")

    def walk(v, plan):
        for way in plan:
            p = np.pad(v, 1)
            near = [p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
            v = np.logical_and.reduce([v, *near]) if way == "e" else np.logical_or.reduce([v, *near]) & present
        return v

    for found, plan in ((masks.erode(df, times=2), "ee"), (masks.open_close(df), "edde"), (masks.dilate(df), "d")):
        want = walk(on & present, plan)
        assert {(r.row_idx, r.col_idx): (r.v, r.label, r.more) for r in found.collect()} == {(r, c): (bool(want[r, c]), l, m) for r, c, _, l, m in rows}
    held = np.where(present, label, -1)
    top_r, top_c = max(r for r, *_ in rows), max(c for _, c, *_ in rows)
    median = lambda r, c: sorted(held[min(max(r + i, 0), top_r), min(max(c + j, 0), top_c)] for i in (-1, 0, 1) for j in (-1, 0, 1))[4]
    out = {(r.row_idx, r.col_idx): r.label for r in masks.median3(df).collect()}
    assert out == {(r, c): l if median(r, c) < 0 else median(r, c) for r, c, _, l, _ in rows}


def test_median_keeps_the_label_of_a_lonely_cell_and_no_label(spark):
    df = spark.createDataFrame([(0, 0, 1), (5, 5, None), (4, 4, 2), (4, 5, 2), (4, 6, 2), (5, 4, 2), (5, 6, 2)], "row_idx int, col_idx int, label int")
    found = {(r.row_idx, r.col_idx): r.label for r in masks.median3(df).collect()}
    assert found[0, 0] == 1 and found[5, 5] is None and found[4, 5] == 2


def test_components_over_stripes_and_labels_equal_a_flood(spark, monkeypatch):
    """Components of each label, in one labelling, on stripes of three rows."""
    monkeypatch.setattr(masks, "STRIPE", 3)
    rng = np.random.default_rng(8)
    label = {(r, c): int(rng.integers(0, 2)) for r in range(23) for c in range(19) if rng.random() < 0.8}
    want, seen = set(), set()
    for start in sorted(label):
        if start not in seen:
            part, todo = set(), [start]
            while todo:
                at = todo.pop()
                if at not in seen and label.get(at) == label[start]:
                    seen.add(at)
                    part.add(at)
                    todo += [(at[0] + i, at[1] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            want |= {(*at, start[0] * (1 << 31) + start[1]) for at in part}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in label.items()], "row_idx int, col_idx int, v int")
    assert {(r.row_idx, r.col_idx, r.label) for r in masks.label_cells(df, "v").collect()} == want


def test_numbered_by_ranges(spark):
    from terrazone.session import numbered

    df = spark.range(5000).selectExpr("(id * 7919) % 5003 as x").repartition(9)
    assert [r.n - i for i, r in enumerate(numbered(df, "n", "x").orderBy("x").collect())] == [1] * 5000
    assert numbered(df.limit(0), "n", "x").collect() == []


def test_outlines(spark):
    df = cells(spark, "##### #.#.# ##### ....# #....").withColumn("label", F.when((F.col("row_idx") == 4), 2).otherwise(1))
    found = {r.label: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in outlines.polygons(df).collect()}
    assert found[2] == [[(0, 4), (1, 4), (1, 5), (0, 5), (0, 4)]]
    assert len(found[1]) == 3 and found[1][0] == [(0, 0), (5, 0), (5, 4), (4, 4), (4, 3), (0, 3), (0, 0)] and found[1][1][0] in [(1, 1), (2, 1), (1, 2), (2, 2)]
    area = outlines.polygons(df).select("label", geometry.area(F.col("rings")).alias("a"), geometry.is_closed(F.col("rings")).alias("ok")).collect()
    assert {(r.label, r.a, r.ok) for r in area} == {(1, 14.0, True), (2, 1.0, True)}
    inside = outlines.polygons(df.where("label = 1")).select(*[geometry.contains(F.col("rings"), F.lit(x), F.lit(y)).alias(n) for n, x, y in (("a", 0.5, 0.5), ("b", 1.5, 1.5), ("c", 4.5, 3.5), ("d", 3.5, 3.5))]).first()
    assert tuple(inside) == (True, False, True, False)


def test_parts_and_holes(spark):
    """Two parts with holes of one label, a part in a hole, cells that touch at corners, a spiral; against counts of cells and the patterns of two rows and columns."""
    text = "#######..#### #.....#..#..# #.###.#..#### #.###.#...... #.....#..#.#. #######...#.# ............. ####.#.#..... #..#.#.#..... #.##.###.....".split()
    df = cells(spark, " ".join(text)).withColumn("label", F.lit("a"))
    row = outlines.multipolygons(df).select("label", "parts", geometry.parts_area(F.col("parts")).alias("area"), texts.geojson_parts(F.col("parts"), F.struct("label")).alias("text")).first()
    full = {(r, c) for r, line in enumerate(text) for c, ch in enumerate(line) if ch == "#"}
    assert row.area == len(full) and row.text.startswith('{"geometry":{"coordinates":[[[[0.00000000,0.00000000],[7.00000000,0.00000000]') and '"type":"MultiPolygon"' in row.text
    around = [[(r + i, c + j) in full for i in (-1, 0) for j in (-1, 0)] for r in range(12) for c in range(15)]
    corners = sum(1 if sum(a) in (1, 3) else 2 if a in ([True, False, False, True], [False, True, True, False]) else 0 for a in around)
    shared = sum((r, c + 1) in full for r, c in full) + sum((r + 1, c) in full for r, c in full)
    assert sum(len(ring) - 1 for p in row.parts for ring in p) == corners
    assert sum(2 - len(p) for p in row.parts) == len(full) - shared + sum(sum(a) == 4 for a in around)
    assert [len(p) for p in row.parts].count(2) == 2 and all(ring[0] == ring[-1] for p in row.parts for ring in p)
    assert outlines.multipolygons(df.limit(0)).collect() == []


def test_outlines_broadcast_nothing(spark, monkeypatch, capsys):
    """Sides, links and labels grow with the cells: none of the rounds' joins sends them through the driver."""
    plans = []

    def noted(df, name):
        df.explain()
        plans.append((name, capsys.readouterr().out))
        return session.cut(df, name)

    for module in (outlines, masks):
        monkeypatch.setattr(module, "cut", noted)
    df = spark.range(130 * 5).selectExpr("cast(id div 5 as int) row_idx", "cast(id % 5 as int) col_idx", "id % 3 label")
    told = outlines.multipolygons(df)
    told.explain()
    plans.append(("multipolygons", capsys.readouterr().out))
    assert {"sides", "rings", "run-links", "run-labels", "multipolygons"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
    assert sum(r.cells for r in told.select(geometry.parts_area(F.col("parts")).alias("cells")).collect()) == df.count()


def test_validity(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    cases = {
        "box": ([box(0.0, 0.0, 9.0, 9.0)], True), "bow-tie": ([[(0.0, 0.0), (2.0, 2.0), (3.0, 0.0), (0.0, 2.0), (0.0, 0.0)]], False), "hole": ([box(0.0, 0.0, 200.0, 90.0), box(70.0, 2.0, 190.0, 80.0)], True),
        "crossing hole": ([box(0.0, 0.0, 200.0, 90.0), box(70.0, 2.0, 210.0, 80.0)], False), "hole outside": ([box(0.0, 0.0, 2.0, 2.0), box(5.0, 5.0, 6.0, 6.0)], False), "holes touch": ([box(0.0, 0.0, 9.0, 9.0), box(1.0, 1.0, 3.0, 3.0), box(3.0, 3.0, 4.0, 4.0)], True),
        "holes share a side": ([box(0.0, 0.0, 9.0, 9.0), box(1.0, 1.0, 3.0, 3.0), box(3.0, 1.0, 4.0, 4.0)], False), "spike": ([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 7.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]], False),
        "touches itself": ([[(0.0, 0.0), (4.0, 0.0), (2.0, 2.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0), (0.0, 0.0)]], False), "repeated point": ([[(0.0, 0.0), (0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]], True),
        "open": ([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]], False), "none": (None, False), "no ring": ([], False),
    }
    df = spark.createDataFrame([(n, rings) for n, (rings, _) in cases.items()], f"name string, rings array<{geometry.RING}>")
    assert {r.name: r.valid for r in geometry.with_validity(df, "name").collect()} == {n: ok for n, (_, ok) in cases.items()}


def test_medians_of_groups(spark):
    """One group of most rows, with many equal values; groups of one and two rows; nulls; against numpy."""
    rng = np.random.default_rng(5)
    rows = [(0, float(x), i) for i, x in enumerate(rng.integers(0, 9, 3000))] + [(g, float(x), i) for g in range(1, 40) for i, x in enumerate(rng.random(g))] + [(50, None, 0), (None, 1.0, 0)]
    told = quality.medians(spark.createDataFrame(rows, "g int, x double, i int"), "x", "g", "i").collect()
    assert {r.g: r["median"] for r in told} == pytest.approx({g: float(np.median([x for h, x, _ in rows if h == g])) for g in range(40)})
    assert len(told) == 40 and quality.medians(spark.createDataFrame([], "g int, x double"), "x", "g").collect() == []


def test_geographic_area(spark):
    """A degree square at the equator has 1.2309e6 hectares on the ellipsoid, and the whole of it 5.1007e10."""
    row = spark.range(1).select(geometry.geographic_box_hectares(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("a"), geometry.geographic_box_hectares(F.lit(-180), F.lit(-90), F.lit(180), F.lit(90)).alias("b")).first()
    assert row.a == pytest.approx(1.2309e6, rel=2e-4) and row.b == pytest.approx(5.10065622e10, rel=1e-8)


def test_boolean_words_are_strict(spark):
    df = spark.createDataFrame([("YES ",), ("off",), (None,)], "w string")
    assert [r.b for r in df.select(ix.parse_boolean(F.col("w")).alias("b")).collect()] == [True, False, None]
    with pytest.raises(Exception, match="maybe"):
        spark.createDataFrame([("maybe",)], "w string").select(ix.parse_boolean(F.col("w"))).collect()


def test_scales_of_bands(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "red double, nir double")
    assert tuple(ix.scale_bands(df, {"red": 0.5}, rules.ROLES).first()) == (1.0, 3.0) and tuple(ix.scale_bands(df, 2.0, rules.ROLES).first()) == (4.0, 6.0)
    for bad in ({"swir": 1.0}, {"red": 0.0}, float("inf")):
        with pytest.raises(ValueError):
            ix.scale_bands(df, bad, rules.ROLES)


def cells(spark, text):
    rows = [(r, c) for r, line in enumerate(text.split()) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(rows, "row_idx int, col_idx int")


def test_components_touch_by_sides_alone(spark):
    found = masks.component_sizes(cells(spark, "##..# .#..# #...# ####."))
    assert sorted(r.n for r in found.collect()) == [3, 3, 5]


def test_components_of_a_spiral(spark):
    found = masks.component_sizes(cells(spark, "####### ......# #####.# #...#.# #.###.# #.....# #######"))
    assert [r.n for r in found.collect()] == [len("####### ......# #####.# #...#.# #.###.# #.....# #######".replace(".", "").replace(" ", ""))]


def test_erosion_reads_false_beyond_the_grid(spark):
    grid = cells(spark, "### ### ###").withColumn("v", F.lit(True))
    assert [(r.row_idx, r.col_idx) for r in masks.erode(grid).where("v").collect()] == [(1, 1)]


def test_small_parts_go_to_the_nearest(spark):
    rows = [(0, c, 0 if c < 5 else 1) for c in range(12)] + [(1, 11, 0)]
    out = crop.merge_small(spark.createDataFrame(rows, "row_idx int, col_idx int, cluster int"), 2)
    assert {(r.row_idx, r.col_idx): r.cluster for r in out.collect()}[1, 11] == 1


def test_unsafe_archive_members(spark):
    members = [("a", i, n, 10, 10, m) for i, (n, m) in enumerate([("x.tif", 0), ("X.TIF", 0), ("../y", 0), ("/z", 0), ("c:/w", 0), ("l", 0o120777), ("a/../b", 0o100644)])]
    found = deliverables.unsafe_members(spark.createDataFrame(members, "archive string, seq int, name string, file_size long, compress_size long, mode int"))
    assert {r.seq: r.problem for r in found.collect()} == {1: "duplicate", 2: "path", 3: "path", 4: "path", 5: "symlink"}


def test_mbtiles_problems(spark):
    meta = spark.createDataFrame([("format", "png"), ("minzoom", "3"), ("maxzoom", "4"), ("bounds", "1,2,3,x")], "name string, value string")
    tiles = spark.createDataFrame([(3,), (4,)], "zoom_level int")
    assert {r.check_id for r in deliverables.mbtiles_problems(meta, tiles).where("not ok").collect()} == {"bounds"}


def test_missing_bands(spark):
    px = spark.createDataFrame([(float("nan"), -9999.0), (0.5, float("inf"))], "red double, nir double")
    assert [tuple(r) for r in mask_bands(px, -9999.0).collect()] == [(None, None), (0.5, None)]
