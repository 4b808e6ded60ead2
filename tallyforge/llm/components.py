"""Connected components by alternating star contraction: joins and aggregates only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, kept: Scratch) -> DataFrame:
    """``edges`` (u, v: longs) as (node, root), root the least node reachable; only nodes with an edge to another, less the roots.

    A node's neighbours are never gathered: each star step takes their minimum, pre-aggregated
    map-side, and joins it back. The number of rounds grows with the logarithm of the longest path.
    """
    e = kept.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    last = None
    while True:
        # large star: a node's larger neighbours move to its least neighbour, or to itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = up.unionByName(e.join(m, "u").select("u", F.col("m").alias("v")).where("u > v")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        m = _least(e)
        e = kept.stored(e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(m.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
