"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.session import cut

#: More steps than any graph of up to 2**60 nodes takes in practice; running out of them is an error, not a result.
MOST_STEPS = 120


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v): u's neighbours are linked with u's least neighbour instead.

    The least neighbour comes from an aggregate that is summed before it is shuffled, and the join that
    brings it back may be split where a hub is skewed.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of (u, v), the component being its least node; order and repeats of edges don't matter.

    Edges with a null end are dropped, and a loop links nothing. An empty table gives an empty one.
    """
    links = edges.select("u", "v").filter("u is not null and v is not null and u != v")
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
    seen = links.agg(*sums).first()
    if not seen.n:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MOST_STEPS):
        links = cut(_star(_star(links, True), False), "links")
        now = links.agg(*sums).first()
        if now == seen:
            ends = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
        seen = now
    raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")
