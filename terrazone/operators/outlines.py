"""Outlines of labelled cells as polygons with holes and several parts: straight sides, linked to rings by pointer doubling; none of it in Python workers.

Tables of sides and links grow with the cells, so their joins name a merge: else Spark broadcasts each round's, through the driver, while it is under 10 MB.
Rows and columns are under 2^29. The interior is to the right of a side, seen with rows downwards; cells that touch at a corner alone stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazone.operators import masks
from terrazone.session import cut, drop

# Directions of sides; the next number is a turn to the right.
RIGHT, DOWN, LEFT, UP = range(4)


def _place(row: Column | str, col: Column | str) -> Column:
    return F.col(row).cast("long") * (1 << 31) + F.col(col)


def straight_sides(runs: DataFrame) -> DataFrame:
    """The rim of labelled runs (row_idx, c0, c1, kind, label) in longest straight sides: kind, part, id, way and the corners r0, c0, r1, c1 that each leads from and to."""
    unit = lambda line, at, way: F.struct(line.cast("int").alias("line"), at.cast("int").alias("at"), F.lit(way).alias("way"))
    row, first, last = F.col("row_idx"), F.col("c0"), F.col("c1")
    own = runs.select("kind", F.col("label").alias("part"), "row_idx", "c0", "c1")
    ends = own.select("kind", "part", F.inline(F.array(unit(first, row, UP), unit(last + 1, row, DOWN))))
    flat = own.select("kind", "part", "row_idx", F.explode(F.sequence("c0", "c1")).alias("c"))
    flat = flat.select("kind", "part", F.inline(F.array(unit(row, F.col("c"), RIGHT), unit(row + 1, F.col("c"), LEFT))))
    # a side that two cells of one part share is inside it
    rim = flat.groupBy("kind", "part", "line", "at").agg(F.count(F.lit(1)).alias("n"), F.min("way").alias("way")).where("n = 1").drop("n")
    along = Window.partitionBy("part", "line", "way").orderBy("at")
    told = ends.unionByName(rim).withColumn("g", F.col("at") - F.row_number().over(along))
    told = told.groupBy("kind", "part", "line", "way", "g").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    back = F.col("way").isin(LEFT, UP)
    start, end = F.when(back, F.col("hi")).otherwise(F.col("lo")), F.when(back, F.col("lo")).otherwise(F.col("hi"))
    level = F.col("way").isin(RIGHT, LEFT)
    at = lambda along, across: F.when(level, across).otherwise(along)
    line = F.col("line")
    told = told.select("kind", "part", "way", at(start, line).alias("r0"), at(line, start).alias("c0"), at(end, line).alias("r1"), at(line, end).alias("c1"))
    return told.withColumn("id", _place("r0", "c0") * 4 + F.col("way"))


def linked(sides: DataFrame) -> DataFrame:
    """sides with next: the id of the side that goes on from its end, where two do the one that turns right."""
    goes = sides.select("part", F.col("r0").alias("r1"), F.col("c0").alias("c1"), F.col("id").alias("to"), F.col("way").alias("turn"))
    met = sides.join(goes.hint("merge"), ["part", "r1", "c1"])
    rank = F.pmod(F.col("turn") - F.col("way"), F.lit(4))  # 1 is right, 3 is left
    picked = met.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "to"))["to"].alias("next"))
    return sides.join(picked.hint("merge"), "id")


def ranked(links: DataFrame) -> DataFrame:
    """id, ring and ahead of links (id, next) that are circles: the least id of the circle, and the steps from a link on to that one.

    A round doubles the stretch that a link knows, so a circle of n links takes log2 n joins by id, each id once on either side. Superseded rounds are deleted.
    """
    state = cut(links.select("id", "next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead")), "rings")
    reach = 1
    while True:
        far = state.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("ring").alias("far_ring"), F.col("ahead").alias("far_ahead"))
        less = F.col("far_ring") < F.col("ring")
        after = cut(
            state.join(far.hint("merge"), "next").select("id", F.col("far").alias("next"), F.least("ring", "far_ring").alias("ring"), F.when(less, F.col("far_ahead") + reach).otherwise(F.col("ahead")).alias("ahead"), less.alias("moved")), "rings"
        )
        drop(state)
        if after.where("moved").isEmpty():
            return after.select("id", "ring", "ahead")
        state, reach = after, 2 * reach


def rings(cells: DataFrame, label: str = "label") -> DataFrame:
    """label, part, ring, outer, area and points of each ring of cells (row_idx, col_idx, label). A part is a 4-connected component, named by its first cell, and has one outer ring.

    area is negative for holes. points are corners (x: column, y: row), the first one again at the end. A ring is one row, so its corners must fit in one.
    """
    told = cut(linked(straight_sides(cut(masks.label_runs(masks.runs(cells, label)), "part-runs"))), "sides")
    placed = told.join(ranked(told).hint("merge"), "id")
    turn = F.struct((F.col("ahead") > 0).alias("later"), (-F.col("ahead")).alias("from_end"), F.col("c0").cast("double").alias("x"), F.col("r0").cast("double").alias("y"))
    found = placed.groupBy("kind", "part", "ring").agg(F.sum(F.col("c0") * (F.col("r1") - F.col("r0")).cast("long")).cast("double").alias("area"), F.array_sort(F.collect_list(turn)).alias("turns"))
    points = F.transform("turns", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y")))
    found = found.withColumn("points", points)
    return found.select(F.col("kind").alias(label), "part", "ring", (F.col("area") > 0).alias("outer"), "area", F.concat("points", F.slice("points", 1, 1)).alias("points"))


def polygons(cells: DataFrame, label: str = "label") -> DataFrame:
    """label, part, rings: a polygon for each part, outer ring first, then holes by their first corner."""
    told = rings(cells, label)
    one = F.struct((~F.col("outer")).alias("hole"), "ring", "points")
    return told.groupBy(label, "part").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["points"]).alias("rings"))


def multipolygons(cells: DataFrame, label: str = "label") -> DataFrame:
    """label, parts: the polygons of each label, by their first cell."""
    told = polygons(cells, label)
    return told.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda p: p["rings"]).alias("parts"))
