"""Crop mask, stress hotspots and management zones."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazone.functions.indices import CROP, CROP_WITHOUT_MSAVI2, SHADOW, WATER
from terrazone.operators import masks
from terrazone.operators.quality import hotspot_threshold, medians, quantiles, with_scalars
from terrazone.session import cut, numbered

CELL = masks.CELL
# Cells on which the number of zones is tried, and scored.
SAMPLE, SCORED = 10_000, 5_000
# Names of zones by their number, lowest vigor first.
ZONE_LABELS = {
    2: ("lower_relative_vigor", "higher_relative_vigor"),
    3: ("lower_relative_vigor", "typical_relative_vigor", "higher_relative_vigor"),
    4: ("lowest_relative_vigor", "lower_relative_vigor", "higher_relative_vigor", "highest_relative_vigor"),
    5: ("lowest_relative_vigor", "lower_relative_vigor", "typical_relative_vigor", "higher_relative_vigor", "highest_relative_vigor"),
}


def crop_mask(px: DataFrame, min_crop_m2: float = 2.0, min_other_m2: float = 10.0, edge_m: float = 1.0, pixel_m: float = 1.0, msavi2: bool = True) -> DataFrame:
    """All valid cells with crop (predicates; without MSAVI2 where reflectance isn't absolute), shadow, water, filtered, large_other and mask: small crop islands go, small holes are filled but for water and shadow, the edge is eroded."""
    if min(min_crop_m2, min_other_m2, edge_m) < 0:
        raise ValueError("component areas and edge width are non-negative")
    area = pixel_m * pixel_m
    crop = CROP if msavi2 else CROP_WITHOUT_MSAVI2
    valid = cut(px.where(F.col("ndvi").isNotNull()).withColumn("crop", F.coalesce(F.expr(crop), F.lit(False))).withColumns({"shadow": F.expr(SHADOW), "water": F.expr(WATER)}).withColumn("excluded", F.col("shadow") | F.col("water")).select(*CELL, "ndvi", "crop", "shadow", "water", "excluded"), "crop")
    kept = masks.keep_large(valid.where("crop"), max(1, math.ceil(min_crop_m2 / area))).withColumn("filtered", F.lit(True))
    valid = cut(valid.join(kept, CELL, "left").withColumn("filtered", F.coalesce("filtered", F.lit(False))), "filtered")
    large = masks.keep_large(valid.where(~F.col("filtered")), max(1, math.ceil(min_other_m2 / area))).withColumn("large_other", F.lit(True))
    told = valid.join(large, CELL, "left").withColumn("large_other", F.coalesce("large_other", F.lit(False)))
    told = told.withColumn("mask", ~F.col("large_other") & ~F.col("excluded"))
    return masks.erode(told, "mask", round(edge_m / pixel_m))


def crop_qc(masked: DataFrame) -> DataFrame:
    return masked.agg(*[F.count_if(F.col(c)).alias(n) for c, n in (("crop", "crop_before"), ("mask", "crop_after"), ("large_other", "large_other"), ("shadow", "shadow"), ("water", "water"), ("excluded", "excluded"))], F.count(F.lit(1)).alias("valid"))


def hotspot_cells(px: DataFrame, crop: DataFrame, percentile: float = 10.0, cutoff: float = 1.5, stress_min: float = 0.20, smoothing: int = 1) -> DataFrame:
    """All cells of px with v: stressed, smoothed. crop: the cells whose values set the threshold."""
    thr = hotspot_threshold(crop, percentile, cutoff, stress_min).select("thr", F.col("n").alias("_n"))
    told = with_scalars(px.join(crop.select(*CELL, F.lit(True).alias("_in")), CELL, "left"), thr)
    told = told.withColumn("v", F.coalesce(F.col("_in") & (F.col("ndvi") <= F.col("thr")) & (F.col("ndvi") >= stress_min) & (F.col("_n") >= 100), F.lit(False)))
    return masks.open_close(told.select(*CELL, "ndvi", "v"), "v", smoothing)


def hotspots(cells: DataFrame, min_area_m2: float = 50.0, pixel_m: float = 1.0) -> DataFrame:
    """One row per hotspot, most severe first: hotspot_id by position, severity_rank by mean NDVI."""
    area = pixel_m * pixel_m
    told = cut(masks.label_cells(cells.where("v")).join(cells.select(*CELL, "ndvi"), CELL), "hotspot-cells")
    found = told.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("ndvi").alias("mean")).where(F.col("n") >= max(1, math.ceil(min_area_m2 / area)))
    found = found.join(medians(told.join(found.select("label"), "label", "left_semi"), "ndvi", "label", *CELL).withColumnRenamed("median", "med"), "label", "left")
    found = numbered(numbered(found, "hotspot_id", "label"), "severity_rank", "mean", "label")
    return found.select(F.col("hotspot_id").cast("int"), F.col("severity_rank").cast("int"), F.bround(F.col("n") * area, 2).alias("area_m2"), F.bround("mean", 3).alias("mean_ndvi"), F.bround("med", 3).alias("median_ndvi"))


def kmeans(cells: DataFrame, features: list[str], k: int, rounds: int = 10) -> DataFrame:
    """Cells with cluster, numbered by rising first feature. Lloyd's rounds from evenly spaced quantiles; ties go to the lowest number."""
    if k not in ZONE_LABELS:
        raise ValueError("two to five zones are possible")
    cells = cells.dropna(subset=features)
    start = quantiles(cells, features[0], [(i + 0.5) / k for i in range(k)])
    if start[0] is None:
        return cells.withColumn("cluster", F.lit(None).cast("int"))
    gap = [F.struct(F.abs(F.col(features[0]) - F.lit(q)).alias("d"), F.lit(i).alias("i")) for i, q in enumerate(start)]
    labelled, centers = cells.withColumn("cluster", F.least(*gap)["i"]), None
    for _ in range(rounds):
        means = labelled.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in features]).collect()  # k rows
        before, centers = centers, sorted((r.cluster, [r[f] for f in features]) for r in means)
        if centers == before:
            break
        dist = [F.struct(sum((F.pow(F.col(f) - F.lit(c), F.lit(2.0)) for f, c in zip(features, center)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, center in centers]
        labelled = cells.withColumn("cluster", (F.least(*dist) if len(dist) > 1 else dist[0])["i"])
    means = labelled.groupBy("cluster").agg(F.avg(features[0]).alias("m"))
    order = means.select("cluster", (F.row_number().over(Window.orderBy("m", "cluster")) - 1).alias("zone"))  # k rows
    return labelled.join(F.broadcast(order), "cluster").drop("cluster").withColumnRenamed("zone", "cluster")


def sampled(cells: DataFrame, size: int) -> DataFrame:
    """The `size` cells of least hash, all where there are no more."""
    place = F.md5(F.concat_ws(":", *CELL, F.lit("42")))
    return cells.orderBy(place).limit(size)


def silhouette(cells: DataFrame, features: list[str], sample: int = SCORED) -> DataFrame:
    """Mean Euclidean silhouette of the `sample` cells of least hash, which bounds the pairs; a cell alone in its cluster counts 0, one cluster -1."""
    picked = cut(sampled(cells, sample).select("cluster", F.array(*features).alias("x")), "scored")
    rows = [(r.cluster, r.x) for r in picked.collect()]  # at most `sample`
    label, x = np.array([c for c, _ in rows]), np.array([v for _, v in rows], float).reshape(len(rows), -1)
    names, code = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return cells.sparkSession.range(1).select(F.lit(-1.0).alias("silhouette"))
    size = np.bincount(code)

    def score(batches):
        for batch in batches:
            own, at = np.searchsorted(names, np.array(batch.column("cluster"))), np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            total = np.zeros((len(at), len(names)))
            for c in range(len(names)):
                total[:, c] = sum(np.sqrt(((at[:, None] - part) ** 2).sum(-1)).sum(1) for part in np.array_split(x[code == c], max(1, len(x) // 256)))
            here = np.arange(len(at))
            a = total[here, own] / np.maximum(size[own] - 1, 1)
            means = total / size
            means[here, own] = np.inf
            b = means.min(axis=1)
            top = np.maximum(a, b)
            yield pa.RecordBatch.from_pydict({"s": np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)})

    return picked.repartition(16).mapInArrow(score, "s double").agg(F.avg("s").alias("silhouette"))


def choose_zones(cells: DataFrame, features: list[str], k_range: tuple[int, int] = (2, 5), sample: int = SAMPLE, uniform: float = 0.25) -> DataFrame:
    """k, silhouette and chosen for each number of zones of a range: the greatest score's, the least of equal ones; the least number where no score reaches uniform."""
    low, high = k_range
    faults = {
        "k_range rises from at least two": not (isinstance(low, int) and isinstance(high, int) and 2 <= low <= high), "at most five zones have names": high not in ZONE_LABELS,
        "the sample holds the largest k": sample < high, "features are unique": len(set(features)) != len(features) or not features, "features are columns": not set(features) <= set(cells.columns),
    }
    broken = [what for what, bad in faults.items() if bad]
    if broken:
        raise ValueError("; ".join(broken))
    usable = cut(cells.dropna(subset=features).select(*CELL, *features), "usable")
    n = usable.count()
    if n < 10 * low or high >= n:
        raise ValueError("too few cells for the range of zones")
    picked = cut(sampled(usable, sample), "sample")
    scores = []
    for k in range(low, high + 1) if n >= 50 else [low]:
        labelled = kmeans(picked, features, k)
        scores.append((k, silhouette(labelled, features).first().silhouette if n >= 50 else 0.0))
    best = max(scores, key=lambda s: (s[1], -s[0]))
    chosen = best[0] if best[1] >= uniform else low
    return cells.sparkSession.createDataFrame([(k, s, k == chosen) for k, s in scores], "k int, silhouette double, chosen boolean")


def zone_stats(cells: DataFrame, features: list[str], k: int, pixel_m: float = 1.0, min_area_m2: float = 100.0) -> DataFrame:
    """One row per zone of at least min_area_m2: counts, areas, label, mean and median of the features."""
    label = F.element_at(F.array(*[F.lit(x) for x in ZONE_LABELS[k]]), F.col("cluster") + 1)
    found = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("pixels"), *[F.avg(f).alias(f"{f}_mean") for f in features]).withColumn("area_m2", F.col("pixels") * pixel_m * pixel_m)
    for f in features:
        middle = [F.lit(x) for c, (m,) in quantiles(cells, f, [0.5], "cluster").items() for x in (c, m)]  # a pair a zone
        found = found.withColumn(f"{f}_median", F.element_at(F.create_map(*middle), F.col("cluster")) if middle else F.lit(None).cast("double"))
    return found.where(F.col("area_m2") >= min_area_m2).select(F.col("cluster").alias("zone_id"), label.alias("relative_vigor_label"), "pixels", "area_m2", *[c for f in features for c in (f"{f}_mean", f"{f}_median")])


def merge_small(cells: DataFrame, least: int, label: str = "cluster") -> DataFrame:
    """Cells of components of one label smaller than `least` take the label of the nearest kept cell (of equally near ones the first by row and column).

    The search widens by squares whose side quadruples, until the nearest is proven. Of kept cells only those with a neighbour that isn't kept are
    searched: any other has a neighbour that is nearer.
    """
    parts = masks.label_cells(cells, label).withColumnRenamed("label", "part")
    told = cut(cells.join(parts, CELL), "parts")
    large = told.groupBy("part").count().where(F.col("count") >= least)
    kept = cut(told.join(large.select("part"), "part", "left_semi").select(*CELL, label), "kept")
    if kept.isEmpty():
        raise ValueError("the least zone area removes every component")
    rim = masks.erode(kept.withColumn("inner", F.lit(True)), "inner").where(~F.col("inner"))
    rim = cut(rim.select(F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), label), "rim")
    open_, done, side = told.join(large.select("part"), "part", "left_anti").select(*CELL), None, 4
    open_ = cut(open_, "small")
    while not open_.isEmpty():
        block = lambda c: F.floor(F.col(c) / side).cast("int")
        around = open_.select(*CELL, F.explode(F.array(*[F.struct((block("row_idx") + i).alias("y"), (block("col_idx") + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("b")).select(*CELL, "b.y", "b.x")
        near = rim.select("r", "c", label, block("r").alias("y"), block("c").alias("x"))
        d2 = (F.col("r") - F.col("row_idx")) * (F.col("r") - F.col("row_idx")) + (F.col("c") - F.col("col_idx")) * (F.col("c") - F.col("col_idx"))
        best = around.join(near, ["y", "x"]).groupBy(*CELL).agg(F.min(F.struct(d2.alias("d2"), "r", "c", label)).alias("m"))
        # the blocks around hold all that is nearer than a side
        sure = best.where(F.col("m.d2") <= side * side).select(*CELL, F.col(f"m.{label}").alias(label))
        done = cut(sure if done is None else done.unionByName(sure), "merged")
        open_ = cut(open_.join(done, CELL, "left_anti"), "small")
        side *= 4
    return kept if done is None else kept.unionByName(done)


def management_zones(cells: DataFrame, features: list[str], k: int, pixel_m: float = 1.0, min_area_m2: float = 100.0, smoothing: int = 1) -> DataFrame:
    """The cells with a number of zone each: k-means ranked by the first feature, medians of 3x3, and components under the least area joined to the nearest zone. No cell is lost."""
    zoned = kmeans(cells, features, k)
    labels = cut(zoned.select(*CELL, "cluster"), "zones")
    for _ in range(smoothing):
        labels = masks.median3(labels, "cluster")
    merged = merge_small(cut(labels, "smoothed"), max(1, math.ceil(min_area_m2 / (pixel_m * pixel_m))))
    return cut(cells.join(merged, CELL), "management-zones")
