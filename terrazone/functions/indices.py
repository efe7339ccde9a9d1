"""Row-local functions of bands, as SQL text that any engine with CASE, abs and sqrt reads alike, and as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default thresholds.
EPSILON = "1e-6"
NDVI_BREAKS = (0.2, 0.4, 0.6)
CROP_NDVI, CROP_MSAVI2, SHADOW_NIR = 0.20, 0.15, 0.05
MAD_SIGMA = 1.4826


def ratio_sql(num: str, den: str) -> str:
    """num / den; null where the denominator is near zero or the quotient leaves [-1, 1]."""
    return f"case when abs({den}) >= {EPSILON} and abs({num}) <= abs({den}) then ({num}) / ({den}) end"


NDVI = ratio_sql("nir - red", "nir + red")
NDRE = ratio_sql("nir - red_edge", "nir + red_edge")
GLI = ratio_sql("2e0*green - red - blue", "2e0*green + red + blue")
_TERM = "((2e0*nir + 1e0)*(2e0*nir + 1e0) - 8e0*(nir - red))"
MSAVI2 = f"case when {_TERM} >= 0e0 and abs((2e0*nir + 1e0 - sqrt({_TERM})) / 2e0) <= 1e0 then (2e0*nir + 1e0 - sqrt({_TERM})) / 2e0 end"
INDICES = {"ndvi": NDVI, "ndre": NDRE, "gli": GLI, "msavi2": MSAVI2}
ALL_ZERO = "(red = 0e0 and green = 0e0 and blue = 0e0 and nir = 0e0 and red_edge = 0e0)"
WATER = "(green > nir)"
SHADOW = "(nir < 5e-2)"
CROP_WITHOUT_MSAVI2 = f"(ndvi >= 2e-1 and not {SHADOW} and not {WATER})"
CROP = f"(ndvi >= 2e-1 and msavi2 >= 15e-2 and not {SHADOW} and not {WATER})"


def index(name: str) -> Column:
    return F.expr(INDICES[name])


def classify_sql(value: str = "ndvi", breaks: tuple[float, ...] = NDVI_BREAKS) -> str:
    """Number of breaks that value reaches; -1 where it is missing."""
    steps = " + ".join(f"case when {value} >= {b:e} then 1 else 0 end" for b in sorted(breaks))
    return f"case when {value} is null then -1 else {steps} end"


def clean(value: Column, nodata: float | None = None) -> Column:
    """A band value with nodata, NaN and infinities as null."""
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    return value if nodata is None else F.when(value != nodata, value)


def water(margin: float = 0.0) -> Column:
    """Green over near infrared by more than a margin; null where either is missing."""
    return F.col("green") > F.col("nir") + F.lit(float(margin))


def scale(value: Column, factor: float) -> Column:
    if not (factor > 0 and factor < float("inf")):
        raise ValueError("a reflectance scale is finite and positive")
    return value * F.lit(float(factor))


def scale_bands(df: DataFrame, factor: float | dict[str, float], roles: tuple[str, ...]) -> DataFrame:
    """Bands times one factor, or each times its own; roles that a mapping doesn't name stay."""
    by_role = factor if isinstance(factor, dict) else dict.fromkeys(roles, factor)
    unknown = sorted(set(by_role) - set(roles))
    if unknown:
        raise ValueError(f"unknown roles {unknown}")
    return df.withColumns({r: scale(F.col(r), f) for r, f in by_role.items() if r in df.columns})


def clip01(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point."""
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return F.when((F.abs(lat) <= 84) & (F.abs(lon) <= 180), F.when(lat < 0, 32700 + zone).otherwise(32600 + zone)).cast("int")


def safe_name(value: Column, default: str) -> Column:
    """Letters, digits, '-' and '_' stay, all else is '_', none at the ends."""
    kept = F.trim(F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def normal_description(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(value), F.lit("_"), F.lit(" ")), r"\s+", " "))


def xml_escape(value: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(raw), F.lit(name))
    return value


def mask_code(usable: Column, crop: Column) -> Column:
    """A cell of a mask raster: 255 where it isn't usable, else 1 for crop and 0."""
    return F.when(~F.coalesce(usable, F.lit(False)), 255).when(F.coalesce(crop, F.lit(False)), 1).otherwise(0)


def kml_colour(hex_rgb: Column, alpha: str = "ff") -> Column:
    c = F.regexp_replace(hex_rgb, "^#", "")
    return F.lower(F.concat(F.lit(alpha), F.substring(c, 5, 2), F.substring(c, 3, 2), F.substring(c, 1, 2)))


# Words for true and false.
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


def parse_boolean(value: Column, strict: bool = True) -> Column:
    """True or false by words; null stays null, another word is an error, or null unless strict."""
    v = F.lower(F.trim(value.cast("string")))
    other = F.when(value.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), value.cast("string"))).cast("boolean")) if strict else F.lit(None).cast("boolean")
    return F.when(v.isin(*TRUE), True).when(v.isin(*FALSE), False).otherwise(other)


def grouped_number(value: Column) -> Column:
    """Thousands in groups; four decimals under 1, else two."""
    return F.when(F.abs(value) < 1, F.format_number(value, 4)).otherwise(F.format_number(value, 2))
