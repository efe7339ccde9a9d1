"""Neighbourhood operators on boolean cells: erosion, dilation, opening, closing, 3x3 median, components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from terrazone.session import cut, drop

CELL = ["row_idx", "col_idx"]


#: Cells along the side of a tile.
SIDE = 256


def on_tiles(df: DataFrame, value: str, halo: int, step: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray], missing, kind: str) -> DataFrame:
    """df with value replaced by step(values, present, first row, first column) of its tile and `halo` cells around it.

    One shuffle by tiles, whatever number of neighbourhood steps: cells within the halo of other tiles go to these too. Cells without a row are `missing`.
    """
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / SIDE).cast("int"), F.floor((F.col(c) + halo) / SIDE).cast("int"))
    dealt = df.withColumn("tile_row", F.explode(span("row_idx"))).withColumn("tile_col", F.explode(span("col_idx")))
    fields = ", ".join(f"`{f.name}` {kind if f.name == value else f.dataType.simpleString()}" for f in df.schema)
    size = SIDE + 2 * halo

    def run(tile: pa.Table) -> pa.Table:
        row0, col0 = (tile.column(c)[0].as_py() * SIDE - halo for c in ("tile_row", "tile_col"))
        r, c = tile.column("row_idx").to_numpy() - row0, tile.column("col_idx").to_numpy() - col0
        given = tile.column(value).to_pandas().to_numpy()
        held = np.full((size, size), missing)
        held[r, c] = np.where(pd.isna(given), missing, given).astype(held.dtype)
        present = np.zeros((size, size), bool)
        present[r, c] = True
        found = step(held, present, row0, col0)[r, c]
        own = (r >= halo) & (r < halo + SIDE) & (c >= halo) & (c < halo + SIDE)
        tile = tile.drop_columns(["tile_row", "tile_col"])
        at = tile.column_names.index(value)
        return tile.set_column(at, value, pa.array(found).cast(arrow)).filter(pa.array(own))

    arrow = to_arrow_type(_parse_datatype_string(kind))
    return dealt.groupBy("tile_row", "tile_col").applyInArrow(run, fields)


def _shifted(v: np.ndarray) -> list[np.ndarray]:
    """The values of the four neighbours; false beyond."""
    p = np.pad(v, 1)
    return [p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]


def _eroded(v: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([v, *_shifted(v)])


def _dilated(v: np.ndarray, present: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([v, *_shifted(v)]) & present


def _steps(df: DataFrame, value: str, plan: str) -> DataFrame:
    def step(v: np.ndarray, present: np.ndarray, row0: int, col0: int) -> np.ndarray:
        for way in plan:
            v = _eroded(v) if way == "e" else _dilated(v, present)
        return v

    return on_tiles(df, value, len(plan), step, False, "boolean") if plan else df


def erode(df: DataFrame, value: str = "v", times: int = 1) -> DataFrame:
    """A cell stays while it and its four neighbours are true; beyond the grid, and where no row is, is false."""
    return _steps(df, value, "e" * times)


def dilate(df: DataFrame, value: str = "v", times: int = 1) -> DataFrame:
    return _steps(df, value, "d" * times)


def open_close(df: DataFrame, value: str = "v", times: int = 1) -> DataFrame:
    return _steps(df, value, "e" * times + "d" * 2 * times + "e" * times)


def median3(df: DataFrame, label: str = "label") -> DataFrame:
    """3x3 median of labels, missing ones and cells without a row as -1, edges of the grid repeated. Where the result is -1 a cell keeps its label; a missing label stays missing."""
    last = df.agg(F.max("row_idx"), F.max("col_idx")).first()

    def step(v: np.ndarray, present: np.ndarray, row0: int, col0: int) -> np.ndarray:
        rows, cols = (np.clip(np.arange(first, first + len(v)), 0, top) - first for first, top in ((row0, last[0]), (col0, last[1])))
        own = v
        v = v[np.clip(rows, 0, len(v) - 1)][:, np.clip(cols, 0, len(v) - 1)]
        p = np.pad(v, 1, mode="edge")
        middle = np.median(np.stack([p[i : i + len(v), j : j + len(v)] for i in range(3) for j in range(3)]), axis=0).astype(np.int64)
        return np.where((own < 0) | (middle < 0), own, middle)

    told = on_tiles(df.withColumn(label, F.col(label).cast("int")), label, 1, step, -1, "int")
    return told.withColumn(label, F.when(F.col(label) >= 0, F.col(label)))


#: Rows of cells whose runs one task joins.
STRIPE = 64


def runs(cells: DataFrame, by: str | None = None) -> DataFrame:
    """Horizontal runs of cells of one value of by: run_id, row_idx, c0, c1, kind; the id is the first cell's place."""
    kind = (F.col(by) if by else F.lit(0)).alias("kind")
    at = Window.partitionBy("row_idx", "kind").orderBy("col_idx")
    numbered = cells.select(*CELL, kind).withColumn("g", F.col("col_idx") - F.row_number().over(at))
    found = numbered.groupBy("row_idx", "kind", "g").agg(F.min("col_idx").alias("c0"), F.max("col_idx").alias("c1"))
    return found.select((F.col("row_idx").cast("long") * (1 << 31) + F.col("c0")).alias("run_id"), "row_idx", "c0", "c1", "kind")


def joined_in_stripes(found: DataFrame) -> DataFrame:
    """found with root: the least run that a run is joined to by runs of its own stripe of rows."""

    def join(stripe: pa.Table) -> pa.Table:
        row, first, last, kind = (stripe.column(c).to_pylist() for c in ("row_idx", "c0", "c1", "kind"))
        order = sorted(range(len(row)), key=lambda i: (row[i], first[i]))
        root = list(range(len(row)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        place = {i: n for n, i in enumerate(order)}
        starts: dict[int, int] = {}
        for n, i in enumerate(order):
            starts.setdefault(row[i], n)
        for r, n in starts.items():
            above, here = starts.get(r - 1, len(order)), n
            while above < n and here < len(order) and row[order[here]] == r:
                a, b = order[above], order[here]
                if first[a] <= last[b] and first[b] <= last[a] and kind[a] == kind[b]:
                    x, y = sorted((top(a), top(b)), key=place.get)
                    root[y] = x
                if last[a] < last[b]:
                    above += 1
                else:
                    here += 1
        ids = stripe.column("run_id").to_pylist()
        return stripe.append_column("root", pa.array([ids[top(i)] for i in range(len(ids))], pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.groupBy(F.floor(F.col("row_idx") / STRIPE)).applyInArrow(join, f"{fields}, root long")


def run_links(found: DataFrame) -> DataFrame:
    """Roots of runs that touch over the border of two stripes. Rows are cut into spans of 64 columns, so that runs meet by an equal key."""
    edge = found.where(F.col("row_idx") % STRIPE == STRIPE - 1).withColumn("row_idx", F.col("row_idx") + 1)
    spans = F.explode(F.sequence(F.floor(F.col("c0") / 64).cast("int"), F.floor(F.col("c1") / 64).cast("int"))).alias("span")
    a, b = (df.select("row_idx", "kind", spans, F.col("root").alias(t), F.col("c0").alias(f"{t}0"), F.col("c1").alias(f"{t}1")) for df, t in ((edge, "a"), (found.where(F.col("row_idx") % STRIPE == 0), "b")))
    return a.join(b.hint("merge"), ["row_idx", "span", "kind"]).where("a0 <= b1 and b0 <= a1").select("a", "b").distinct()


def label_runs(found: DataFrame) -> DataFrame:
    """found with label: the least run of its 4-connected component.

    Stripes of rows are joined apart; only what touches over their borders is left to rounds of least neighbour and pointer jump, whose tables are deleted when superseded,
    and whose joins name a merge, as a broadcast would send each round's table through the driver.
    """
    joined = cut(joined_in_stripes(found), "runs")
    links = run_links(joined)
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "run-links")
    labels = cut(links.select(F.col("a").alias("root")).distinct().withColumn("label", F.col("root")), "run-labels")
    while True:
        near = links.join(labels.select(F.col("root").alias("b"), F.col("label").alias("l")).hint("merge"), "b").groupBy("a").agg(F.min("l").alias("l"))
        low = labels.join(near.withColumnRenamed("a", "root").hint("merge"), "root", "left").select("root", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        jump = low.select(F.col("root").alias("label"), F.col("label").alias("far"))
        after = cut(low.join(jump.hint("merge"), "label", "left").select("root", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "run-labels")
        drop(labels)
        if after.where(F.col("was") != F.col("label")).isEmpty():
            drop(links)
            return joined.join(after.select("root", "label").hint("merge"), "root", "left").withColumn("label", F.coalesce("label", "root")).drop("root")
        labels = after


def label_cells(cells: DataFrame, by: str | None = None) -> DataFrame:
    """row_idx, col_idx, label of 4-connected components of the given cells, of one value of by each, in one labelling; the label is the place of the first cell, row * 2^31 + column."""
    return label_runs(runs(cells, by)).select("row_idx", F.explode(F.sequence("c0", "c1")).alias("col_idx"), "label")


def component_sizes(cells: DataFrame) -> DataFrame:
    """label_row, label_col, n for each component, by runs alone."""
    told = label_runs(runs(cells))
    return told.groupBy("label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"), F.min("row_idx").alias("min_row"), F.min("c0").alias("min_col")).withColumns({"label_row": F.floor(F.col("label") / (1 << 31)).cast("int"), "label_col": (F.col("label") % (1 << 31)).cast("int")})


def keep_large(cells: DataFrame, least: int) -> DataFrame:
    """Cells of components of at least `least` cells."""
    if least <= 1:
        return cells.select(*CELL)
    told = label_cells(cells)
    large = told.groupBy("label").count().where(F.col("count") >= least)
    return told.join(large, "label", "left_semi").select(*CELL)
