"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm.common import salted_join
from terrazone.session import cut, drop


#: Links that a file of a step holds on average; steps of few links don't write a file for each partition of a shuffle.
LINKS_A_FILE = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star contraction, both steps as grouped minimum and join; the links of a hub meet its minimum in parts."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = salted_join(both, least, "u")
    if large:
        found = told.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return found.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node in a link, label the least node of its component.

    Links may repeat, come in any direction and link a node to itself; such nodes without another link have no row.
    Each step is written to the shared folder, so a lost executor costs no more than a step; what is superseded is deleted.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = cut(edges, "links")
    state = _state(edges)
    while state[0]:
        files = -(-state[0] // LINKS_A_FILE)
        half = cut(_star(edges, True).coalesce(files), "stars")
        after = cut(_star(half, False).coalesce(files), "stars")
        found = _state(after)
        drop(edges, half)
        edges, before, state = after, state, found
        if found == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
