"""The pixel table: one wide, nullable row per raster cell; and sources that make one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.functions.indices import ALL_ZERO, INDICES, clean
from terrazone.session import table

BANDS = ("red", "green", "blue", "nir", "red_edge")

#: Grid of 100 columns derived from events; the text differs between engines in integer division alone.
PIXELS_SQL = """
with e as (select event_id, event_id {div} 100 as r, event_id % 100 as c, least(value, 5e2)/5e2 as n from events),
b as (select event_id, r, c, n, ((r {div} 10) * 3 + (c {div} 10) * 5) % 11 as blk, r % 100 = 99 as bg from e)
select cast(r as int) as row_idx, cast(c as int) as col_idx,
  case when event_id % 997 = 0 then null when bg then 0e0 else 1e-1 + 8e-4*c + 2e-2*n end as red,
  case when bg then 0e0 when blk = 3 then 6e-1 else 1e-1 + 3e-4*(r % 100) end as green,
  case when bg then 0e0 else 8e-2 + 2e-4*c end as blue,
  case when bg then 0e0 when blk = 2 then 16e-2 when blk = 3 then 3e-1 when blk = 5 then 4e-2
       else (case when c < 33 then 68e-2 when c < 66 then 53e-2 else 4e-1 end)
            - (case when blk = 7 then 12e-2 else 0e0 end) + 2e-2*n end as nir,
  case when bg then 0e0 else 35e-2 + 8e-4*c end as red_edge
from b
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PIXELS_SQL.format(div="div").replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


def join_bands(bands: dict[str, DataFrame]) -> DataFrame:
    """Bands of separate rasters, each (row_idx, col_idx, value), joined by position."""
    parts = [df.select("row_idx", "col_idx", F.col("value").alias(role)) for role, df in bands.items()]
    return reduce(lambda a, b: a.join(b, ["row_idx", "col_idx"]), parts)


def mask_bands(px: DataFrame, nodata: float | None = None) -> DataFrame:
    return px.withColumns({b: clean(F.col(b), nodata) for b in BANDS if b in px.columns})


def footprint(px: DataFrame, mask: DataFrame | None = None, alpha: str | None = None) -> DataFrame:
    """Cells with every band, by alpha or mask where given, else without the all-zero background."""
    px = px.dropna(subset=[b for b in BANDS if b in px.columns])
    if alpha:
        px = px.where(F.col(alpha) > 0)
    if mask is not None:
        px = px.join(mask.select("row_idx", "col_idx"), ["row_idx", "col_idx"], "left_semi")
    return px if alpha or mask is not None else px.where(f"not {ALL_ZERO}")


def with_indices(px: DataFrame, names: tuple[str, ...] = tuple(INDICES)) -> DataFrame:
    return px.withColumns({n: F.expr(INDICES[n]) for n in names})


def decimate(px: DataFrame, step: int) -> DataFrame:
    return px.where((F.col("row_idx") % step == 0) & (F.col("col_idx") % step == 0))
