"""Roles of a raster's bands: given, described, by colour, by layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.functions.indices import normal_description
from terrazone.operators.deliverables import ALIASES, standard_layout
from terrazone.operators.rules import ROLES

WAYS = ("given", "described", "colour", "layout")


def _described(bands: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for role, many in ALIASES.items() for a in many for x in (a, role)])
    return bands.withColumn("role", F.try_element_at(names, normal_description(F.coalesce("description", F.lit("")))))


def resolve_roles(bands: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raster_id, role, band, how) and (raster_id, check_id, role): roles of bands, and what speaks against them.

    bands: raster_id, band (from 1), description, colour. given: raster_id, role, band (double). A role is taken from the first way that has
    it; the layout helps only where red or near infrared is still missing. Every fault of a raster is listed; a raster with faults is refused.
    """
    count = bands.groupBy("raster_id").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("colour") == "alpha").alias("alphas"))
    told = given.join(count, "raster_id").withColumn("whole", (F.col("band") == F.floor("band")) & F.col("band").between(1, F.col("count")))
    unknown = told.where(~F.col("role").isin(*ROLES)).select("raster_id", F.lit("unknown_role").alias("check_id"), "role")
    outside = told.where(F.col("role").isin(*ROLES) & ~F.coalesce("whole", F.lit(False))).select("raster_id", F.lit("band_number").alias("check_id"), "role")
    way = lambda df, name: df.select("raster_id", "role", F.col("band").cast("int").alias("band"), F.lit(WAYS.index(name)).alias("way"))
    mine = way(told.where(F.col("role").isin(*ROLES) & F.col("whole")), "given")
    named = _described(bands).where(F.col("role").isNotNull()).join(given.select("raster_id", "role"), ["raster_id", "role"], "left_anti")
    named = named.groupBy("raster_id", "role").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("n"))
    several = named.where("n > 1").select("raster_id", F.lit("several_described").alias("check_id"), "role")
    coloured = bands.where(F.col("colour").isin("red", "green", "blue")).groupBy("raster_id", F.col("colour").alias("role")).agg(F.min("band").alias("band"))
    first = F.struct("way", "band")
    so_far = mine.unionByName(way(named, "described")).unionByName(way(coloured, "colour"))
    so_far = so_far.groupBy("raster_id", "role").agg(F.min(first).alias("m")).select("raster_id", "role", "m.band", "m.way")
    lacking = count.join(so_far.where(F.col("role").isin("red", "nir")).groupBy("raster_id").agg(F.count(F.lit(1)).alias("both")).where("both = 2"), "raster_id", "left_anti")
    laid = lacking.select("raster_id", F.posexplode(standard_layout(F.col("count"), F.col("alphas"))).alias("place", "role")).withColumn("band", F.col("place") + 1)
    roles = so_far.unionByName(way(laid, "layout")).groupBy("raster_id", "role").agg(F.min(first).alias("m"))
    roles = roles.select("raster_id", "role", "m.band", F.element_at(F.array(*[F.lit(w) for w in WAYS]), F.col("m.way") + 1).alias("how"))
    alpha = roles.join(bands.where("colour = 'alpha'").select("raster_id", "band"), ["raster_id", "band"], "left_semi").select("raster_id", F.lit("alpha_role").alias("check_id"), "role")
    twice = roles.groupBy("raster_id", "band").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("role")).where("n > 1").select("raster_id", F.lit("band_twice").alias("check_id"), "role")
    needed = count.select("raster_id", F.explode(F.array(F.lit("red"), F.lit("nir"))).alias("role"))
    missing = needed.join(roles, ["raster_id", "role"], "left_anti").select("raster_id", F.lit("role_missing").alias("check_id"), "role")
    found = unknown
    for more in (outside, several, alpha, twice, missing):
        found = found.unionByName(more)
    return roles, found


def alpha_band(bands: DataFrame) -> DataFrame:
    """raster_id, alpha: the one alpha band; null where there is none or several."""
    return bands.groupBy("raster_id").agg(F.when(F.count_if(F.col("colour") == "alpha") == 1, F.max(F.when(F.col("colour") == "alpha", F.col("band")))).alias("alpha"))
