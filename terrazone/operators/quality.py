"""Statistics and gates over whole rasters; each is one aggregate, joined back as a single row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazone.functions.indices import MAD_SIGMA, clip01
from terrazone.session import cut, numbered


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """df with the columns of a one-row table."""
    return df.crossJoin(F.broadcast(scalars.limit(1)))


#: Bins of one pass of quantiles(), and values among which the last pass picks.
BINS, PICK = 1024, 1 << 16


def quantiles(df: DataFrame, value: str, shares: list[float], by: str | None = None) -> dict:
    """Exact quantiles, linear between ranks, of value for each group of by (None without groups): a list, None where a group has no value.

    Every pass counts the values of each wanted rank's bracket in bins, and the rank's bin, from its least to its greatest value, is the next bracket, until
    a bracket holds one value or so few that they are fetched by rank. So no task sorts all values, and the driver holds bins of a bounded number of groups.
    """
    rows = df.select((F.col(by) if by else F.lit(None).cast("int")).alias("g"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    found, open_ = {}, []
    for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        for rank in sorted({f(p * (r.n - 1)) for p in shares for f in (math.floor, math.ceil)}):
            open_.append((r.g, rank, r.lo, r.hi, 0, r.n))  # below: values under the bracket; held: values in it
        found[r.g] = r.n
    at: dict[tuple, float] = {}
    while open_:
        at |= {(g, rank): lo for g, rank, lo, hi, *_ in open_ if lo == hi}
        open_ = [b for b in open_ if b[2] < b[3]]
        brackets = sorted({(g, lo, hi, below, held) for g, _, lo, hi, below, held in open_}, key=str)
        number = {b[:3]: i for i, b in enumerate(brackets)}
        if not brackets:
            break
        inside = lambda b: F.col("g").eqNullSafe(F.lit(b[0])) & F.col("x").between(F.lit(b[1]), F.lit(b[2]))
        small = {i for i, b in enumerate(brackets) if b[4] <= PICK}
        # one value is a bin of its own in brackets of few values
        bin_ = lambda i, b: F.lit(0) if i in small else F.least(F.floor((F.col("x") - F.lit(b[1])) / F.lit((b[2] - b[1]) / BINS)), F.lit(BINS - 1)).cast("int")
        placed = rows.select("x", F.explode(F.filter(F.array(*[F.when(inside(b), F.struct(F.lit(i).alias("i"), bin_(i, b).alias("bin"), F.lit(i in small).alias("pick"))) for i, b in enumerate(brackets)]), lambda b: b.isNotNull())).alias("b"))
        counted = placed.groupBy("b.i", "b.bin", F.when(F.col("b.pick"), F.col("x")).alias("own")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        bins: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r.i, r.lo)):
            bins.setdefault(r.i, []).append(r)
        after = []
        for g, rank, lo, hi, below, _ in open_:
            for r in bins[number[g, lo, hi]]:
                if rank < below + r.n:
                    after.append((g, rank, r.lo, r.hi, below, r.n))
                    break
                below += r.n
        open_ = after
    out = {}
    for g, n in found.items():
        told = []
        for p in shares:
            low, high = at[g, math.floor(p * (n - 1))], at[g, math.ceil(p * (n - 1))]
            told.append(low + (high - low) * (p * (n - 1) - math.floor(p * (n - 1))))
        out[g] = told
    return out if by else out.get(None, [None] * len(shares))


def medians(df: DataFrame, value: str, by: str, *apart: str) -> DataFrame:
    """by, median: exact medians for any number of groups of any size; null values are left out, and so are groups without one.

    Values are numbered in order of (by, value) in ranges, so a group of most rows is spread over tasks, and no task or driver holds one whole.
    apart: columns that tell rows of one value apart, so that those are spread too.
    """
    more = [f"a{i}" for i in range(len(apart))]
    rows = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("x"), *[F.col(c).alias(a) for c, a in zip(apart, more)]).where("g is not null and x is not null")
    placed = cut(numbered(rows, "place", "g", "x", *more).select("g", "x", "place"), "places")
    ends = placed.groupBy("g").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    wanted = ends.select("g", F.explode(F.array_distinct(F.array(F.floor((F.col("first") + F.col("last")) / 2), F.ceil((F.col("first") + F.col("last")) / 2)))).alias("place"))
    return placed.join(wanted, ["g", "place"]).groupBy("g").agg(F.avg("x").alias("median")).withColumnRenamed("g", by)


def one_row(df: DataFrame, **values) -> DataFrame:
    """A row of doubles, longs and booleans."""
    kind = lambda v: "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double"
    return df.sparkSession.range(1).select(*[F.lit(v).cast(kind(v)).alias(k) for k, v in values.items()])


def share(condition: Column) -> Column:
    """Percent of rows with a value that fulfil a condition."""
    return 100 * F.avg(condition.cast("double"))


def band_qa(px: DataFrame, band: str) -> DataFrame:
    x = F.col(band)
    return px.agg(F.count(x).alias("n"), share(x == 0).alias("zero_pct"), share(x < 0).alias("below_pct"), share(x > 1).alias("above_pct"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def is_constant(px: DataFrame, band: str) -> DataFrame:
    """Whether a band hardly varies: no zones can be drawn from it."""
    lo, mid, hi = quantiles(px, band, [0.0, 0.5, 1.0])
    return one_row(px, constant=lo is not None and hi - lo <= max(1e-12, abs(mid) * 1e-8))


def autoscale_factor(px: DataFrame, band: str, tolerance_pct: float = 5.0) -> DataFrame:
    """One row: the divisor that brings raw numbers to reflectance; 1 where at most the tolerance lies outside [0, 1]."""
    top, outside = F.max(band), share((F.col(band) < 0) | (F.col(band) > 1))
    divisor = F.when(top <= 255, 255.0).when(top <= 10000, 10000.0).when(top <= 65535, 65535.0).otherwise(top)
    return px.agg(outside.alias("outside_pct"), top.alias("top"), F.when((outside > tolerance_pct) & (top > 1), divisor).otherwise(1.0).alias("factor"))


def autoscale(px: DataFrame, band: str, tolerance_pct: float = 5.0) -> DataFrame:
    factor = autoscale_factor(px, band, tolerance_pct).select(F.col("factor").alias("_factor"))
    return with_scalars(px, factor).withColumn(band, clip01(F.col(band) / F.col("_factor"))).drop("_factor")


def reflectance_gate(px: DataFrame, least: float = 0.01) -> DataFrame:
    """plausible: 99th percentiles of red and nir reach absolute reflectance."""
    long = px.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("x")) for b in ("red", "nir")])))
    told = quantiles(long, "x", [0.99], "band")  # both bands in the same passes
    red, nir = (told.get(b, [None])[0] for b in ("red", "nir"))
    return one_row(px, p99_red=red, p99_nir=nir, plausible=red is not None and nir is not None and max(red, nir) >= least)


def hotspot_threshold(crop: DataFrame, percentile: float = 10.0, cutoff: float = 1.5, stress_min: float = 0.20, value: str = "ndvi") -> DataFrame:
    """One row: pct_thr, med, mad, robust_thr, thr and the count. The percentile and the robust z cutoff, whichever is lower, if it leaves anything to find."""
    if not 0 <= percentile <= 100 or cutoff < 0:
        raise ValueError("the percentile is in [0, 100] and the cutoff non-negative")
    pct, med = quantiles(crop, value, [percentile / 100, 0.5])
    mad = None if med is None else quantiles(crop.select(F.abs(F.col(value) - F.lit(med)).alias("far")), "far", [0.5])[0]
    both = one_row(crop, n=crop.where(F.col(value).isNotNull()).count(), pct_thr=pct, med=med, mad=mad)
    robust = F.when(F.col("mad") > 0, F.col("med") - cutoff * MAD_SIGMA * F.col("mad")).otherwise(F.col("pct_thr"))
    low = F.least("pct_thr", "robust_thr")
    thr = F.when((low < stress_min) & (F.col("pct_thr") >= stress_min), F.col("pct_thr")).otherwise(low)
    return both.withColumn("robust_thr", robust).withColumn("thr", thr)


def canopy_cover(px: DataFrame, vegetation: Column, pixel_area: float = 1.0) -> DataFrame:
    return px.agg(F.count_if(vegetation).alias("veg_pixels"), F.count(F.lit(1)).alias("valid_pixels"), F.try_divide(100.0 * F.count_if(vegetation), F.count(F.lit(1)).cast("double")).alias("cover_pct"), (F.count_if(vegetation) * pixel_area).alias("veg_area_m2"))


def stretch_cuts(px: DataFrame, band: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """lo and hi for an 8-bit stretch; hi = lo + 1 where they meet."""
    lo, hi = quantiles(px, band, [low, high])
    return one_row(px, lo=lo, hi=hi if lo is None or hi > lo else lo + 1)


def stretch(px: DataFrame, band: str) -> DataFrame:
    """Band as 0 to 255, cut off and truncated, with alpha 255 where it has a value."""
    told = with_scalars(px, stretch_cuts(px, band))
    level = F.least(F.greatest((F.col(band) - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(255.0))
    return told.select("row_idx", "col_idx", F.coalesce(F.floor(level).cast("int"), F.lit(0)).alias("level"), F.when(F.col(band).isNotNull(), 255).otherwise(0).alias("alpha"))


def overview(px: DataFrame, value: str, level: int) -> DataFrame:
    """Averages over blocks of 2^level cells."""
    size = 1 << level
    return px.groupBy(F.floor(F.col("row_idx") / size).cast("int").alias("ty"), F.floor(F.col("col_idx") / size).cast("int").alias("tx")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
