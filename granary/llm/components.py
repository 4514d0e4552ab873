"""Connected components of an edge table, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge.

    Large-star and small-star rounds, until only stars around smallest nodes are left: a round
    links every node's larger neighbours, then its smaller ones, to its smallest. Both
    are groupings with partial minima and equi-joins, so a node with a third of all
    edges is pre-aggregated before the shuffle; the joins' hot keys are left to
    adaptive skew handling. Each round is written to the shared folder, which cuts
    lineage. Null ends, loops and repeated edges add nothing; an empty table gives none.
    """
    flat = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    flat = stored(flat, "edges")
    while not _is_stars(flat):
        both = flat.union(flat.select(F.col("v"), F.col("u")))
        least = both.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
        # large star: larger neighbours go to the smallest of the node and its neighbours
        large = both.join(least, F.col("u") == F.col("m_u")).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: the node and its smaller neighbours go to the smallest neighbour
        low = large.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("m_u"))
        flat = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("m_u", "m")).filter("u <> v").distinct()
        flat = stored(flat, "edges")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).union(flat.select("v", "v").distinct())


def _is_stars(flat: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    several = flat.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
    chained = flat.select(F.col("v").alias("w")).join(flat.select("u"), F.col("w") == F.col("u"), "left_semi")
    return several.isEmpty() and chained.isEmpty()
