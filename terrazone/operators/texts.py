"""Deliverables as text: GeoJSON, CSV, JSON, KML, manifests, reports. Each is Columns and a writer, so rows are formatted where they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazone.functions.indices import grouped_number, kml_colour, xml_escape

# Labels of vigor in reports.
FARMER = {
    "lowest_relative_vigor": "Lowest relative vigor", "lower_relative_vigor": "Lower relative vigor", "typical_relative_vigor": "Typical relative vigor",
    "higher_relative_vigor": "Higher relative vigor", "highest_relative_vigor": "Highest relative vigor",
    "critical": "High priority", "watch": "Watch", "moderate": "Moderate", "healthy": "Healthy", "very_healthy": "Very healthy",
}
# Least area and share of a part of several that KML shows.
SLIVER_M2, SLIVER_PCT = 1.0, 0.01


def json_text(struct: Column) -> Column:
    """Canonical JSON: keys in order at every depth, nulls written."""
    return F.to_json(F.parse_json(F.to_json(struct, {"ignoreNullFields": "false"})))


def merged(*maps: Column) -> Column:
    """Maps of strings as one; of equal keys the last map's."""
    entries = F.concat(*[F.map_entries(m) for m in maps])
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def _geojson_rings(rings: Column) -> Column:
    point = lambda p: F.concat(F.lit("["), F.format_string("%.8f", p["x"]), F.lit(","), F.format_string("%.8f", p["y"]), F.lit("]"))
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, point), ","), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(rings, ring), ","), F.lit("]"))


def _geojson(kind: str | Column, coordinates: Column, properties: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit('{"geometry":{"coordinates":'), coordinates, F.lit(',"type":"'), kind, F.lit('"},"properties":'), json_text(properties), F.lit(',"type":"Feature"}'))


def geojson_feature(rings: Column, properties: Column) -> Column:
    """A polygon with properties as one line of GeoJSON."""
    return _geojson("Polygon", _geojson_rings(rings), properties)


def geojson_parts(parts: Column, properties: Column) -> Column:
    """Polygons with properties as one line of GeoJSON: a Polygon where there is one, a MultiPolygon else."""
    drawn = F.transform(parts, _geojson_rings)
    one = F.size(parts) == 1
    many = F.concat(F.lit("["), F.array_join(drawn, ","), F.lit("]"))
    return _geojson(F.when(one, "Polygon").otherwise("MultiPolygon"), F.when(one, F.get(drawn, F.lit(0))).otherwise(many), properties)


def csv_field(value: Column) -> Column:
    """A field, in quotes where it holds a comma, a quote or a line end; empty where it is null."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c)) for c in columns or df.columns])


def title_case(value: Column) -> Column:
    """Underscores as spaces, every word with a capital."""
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def farmer_label(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FARMER.items() for x in kv])
    return F.coalesce(F.try_element_at(known, value), title_case(value))


def severity_style(value: Column) -> Column:
    """Style of a severity by word or rank; medium where neither tells."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    rank = text.try_cast("double").cast("int")
    return (
        F.when(F.contains(text, F.lit("high")) | (rank == 1), "severity_high").when(F.contains(text, F.lit("medium")) | (rank == 2), "severity_medium")
        .when(F.contains(text, F.lit("low")) | (rank >= 3), "severity_low").otherwise("severity_medium")
    )


def style_of(value: Column, styles: Sequence[str], default: str, prefix: str = "") -> Column:
    """The style that a row names, with the prefix, if it is one of the styles; else the default."""
    raw = F.coalesce(F.when(value.cast("string") != "NaN", value.cast("string")), F.lit(default))
    named = F.when(raw.startswith(prefix), raw).otherwise(F.concat(F.lit(prefix), raw))
    return F.when(named.isin(*styles), named).otherwise(F.lit(default))


def kml_style(name: str, fill: str, line: str, fill_alpha: str = "55", line_alpha: str = "ff") -> Column:
    return F.concat(
        F.lit(f'<Style id="{name}"><LineStyle><color>'), kml_colour(F.lit(line), line_alpha), F.lit("</color><width>1.6</width></LineStyle><PolyStyle><color>"),
        kml_colour(F.lit(fill), fill_alpha), F.lit("</color><fill>1</fill><outline>1</outline></PolyStyle></Style>"),
    )


def kml_polygon(rings: Column) -> Column:
    """Outer boundary, then inner ones; coordinates with eight decimals."""
    point = lambda p: F.format_string("%.8f,%.8f,0", p["x"], p["y"])
    line = lambda r, side: F.concat(F.lit(f"<{side}BoundaryIs><LinearRing><coordinates>"), F.array_join(F.transform(r, point), " "), F.lit(f"</coordinates></LinearRing></{side}BoundaryIs>"))
    return F.concat(F.lit("<Polygon>"), line(rings[0], "outer"), F.array_join(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: line(r, "inner")), ""), F.lit("</Polygon>"))


def kml_geometry(parts: Column) -> Column:
    """One polygon, or several as one geometry."""
    drawn = F.transform(parts, kml_polygon)
    return F.when(F.size(parts) == 1, drawn[0]).otherwise(F.concat(F.lit("<MultiGeometry>"), F.array_join(drawn, ""), F.lit("</MultiGeometry>")))


def kml_description(fields: Mapping[str, Column]) -> Column:
    """Labelled values, one a line; numbers are grouped (Columns of strings stay)."""
    return F.concat_ws("&#10;", *[F.concat(xml_escape(F.lit(label)), F.lit(": "), xml_escape(value.cast("string"))) for label, value in fields.items()])


def kml_number(value: Column) -> Column:
    return grouped_number(value)


def kml_feature(name: Column, style: Column, description: Column, geometry: Column) -> Column:
    return F.concat(F.lit("<Placemark><name>"), xml_escape(name), F.lit("</name><styleUrl>#"), style, F.lit("</styleUrl><description>"), description, F.lit("</description>"), geometry, F.lit("</Placemark>"))


def exploded(features: DataFrame, area) -> DataFrame:
    """One row for each part of features (id, parts, ...), by falling area and bounds: part (from 0 by place), patch_id, area_m2, share_pct; slivers go, but for the first part."""
    told = features.withColumn("sized", F.array_sort(F.transform("parts", lambda p: F.struct((-area(p)).alias("size"), F.array_min(F.transform(p[0], lambda q: q["x"])).alias("x"), F.array_min(F.transform(p[0], lambda q: q["y"])).alias("y"), p.alias("part")))))
    whole = F.aggregate("sized", F.lit(0.0), lambda a, s: a - s["size"])
    told = told.withColumn("whole", whole)
    kept = F.filter("sized", lambda s, i: (i == 0) | ((-s["size"] >= SLIVER_M2) & ((F.col("whole") <= 0) | (-100 * s["size"] / F.col("whole") >= SLIVER_PCT))))
    rows = told.select(*[c for c in features.columns if c != "parts"], "whole", F.posexplode(kept).alias("place", "s"))
    share = F.when(F.col("whole") > 0, -100 * F.col("s.size") / F.nullif(F.col("whole"), F.lit(0.0)))
    return rows.select(*[c for c in features.columns if c != "parts"], F.col("s.part").alias("part"), F.format_string("Z%s-P%03d", F.col("id").cast("string"), F.col("place") + 1).alias("patch_id"), (-F.col("s.size")).alias("area_m2"), share.alias("share_pct"))


def notices(absolute: Column, fallback: Column) -> Column:
    """What a report must say of its limits; null where there is nothing."""
    told = F.concat_ws("\n\n", F.when(~absolute, F.lit("Reflectance isn't absolute: relative maps alone, no MSAVI2, shadow screen or prescriptions.")), F.when(fallback, F.lit("Too few crop cells: zones are of the whole footprint, for diagnosis alone.")))
    return F.nullif(told, F.lit(""))


def warnings_log(checks: Sequence[tuple[str, Column, Column]], df: DataFrame) -> DataFrame:
    """seq, code, message of the warnings that a one-row table gives, in the order of the checks: (code, whether, message)."""
    rows = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(i).alias("seq"), F.lit(code).alias("code"), message.alias("message"))) for i, (code, on, message) in enumerate(checks)]))
    return df.select(F.inline(rows))


def manifest(files: DataFrame) -> DataFrame:
    """One line of canonical JSON for each file (path, content), in order of path: its size and SHA-256."""
    return files.orderBy("path").select("path", json_text(F.struct("path", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))).alias("line"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Lines of text as files of a folder; nothing is written where there is no row."""
    if not df.isEmpty():
        df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
