"""Fusing ranked lists on rank: reciprocal rank sums, representatives, duplicates of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
ARMS = ("text", "vector", "graph")


def _arm_order(arm: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in ARMS]), arm)


def fuse(candidates: DataFrame, top: int = 10, k: int | Column = RRF_K, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by..., rank, key, node, kind, score, best, arms) of (by..., arm, pos, key, node, kind, weight).

    ``pos`` counts from 0 within an arm. Each listing adds weight / (k + pos + 1), repeats of a key in one arm
    too. A key is represented by its first listing outside the graph arm that isn't a plain node, else by the
    last one outside the graph arm, else by its first one. Of several keys with one node only the best stays,
    but relationships always do, as do keys without a node; a relationship takes its node's place all the
    same. Keys that are empty or null are skipped. Ties go by best rank, then key.
    """
    k = F.lit(k) if isinstance(k, int) else k
    rows = candidates.filter(F.coalesce("key", F.lit("")) != "").withColumn("order", _arm_order(F.col("arm")))
    place = F.col("order") * F.lit(1 << 32) + F.col("pos")
    graph = F.col("arm") == "graph"
    choice = F.struct(
        F.when(~graph & (F.col("kind") != "node"), 0).when(~graph, 1).otherwise(2),
        F.when(~graph & (F.col("kind") == "node"), -place).otherwise(place),
    )
    keyed = rows.groupBy(*by, "key").agg(
        F.sum(F.col("weight") / (k + F.col("pos") + 1)).alias("score"),
        (F.min("pos") + 1).alias("best"),
        F.array_join(F.array_sort(F.collect_set("arm")), "+").alias("arms"),
        F.min_by(F.struct("node", "kind"), choice).alias("r"),
    )
    keyed = keyed.select(*by, "key", F.coalesce("r.node", F.lit("")).alias("node"), F.col("r.kind").alias("kind"), F.round("score", 9).alias("score"), "best", "arms")
    order = [F.desc("score"), F.col("best"), F.col("key")]
    # a node's later keys, then what is left in order
    seen = F.row_number().over(Window.partitionBy(*by, "node").orderBy(*order))
    alone = keyed.withColumn("seen", seen).filter((F.col("seen") == 1) | (F.col("kind") == "relationship") | (F.col("node") == ""))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return alone.withColumn("rank", rank).filter(F.col("rank") <= top).select(*by, "rank", "key", "node", "kind", "score", "best", "arms")


def agreement(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by..., results, agreed): how many of the fused hits more than one arm has found."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("results"), F.count_if(F.contains("arms", F.lit("+"))).alias("agreed"))


def first_ranks(hits: DataFrame, of: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by..., of, rank, hits): each value of a column at the rank at which it first comes, with how many hits it has."""
    return hits.groupBy(*by, of).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("hits"))


def survivors(candidates: DataFrame, hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by..., arm, candidates, served): how many of each arm's candidates are among the hits."""
    served = hits.select(*by, "key").distinct().withColumn("hit", F.lit(1))
    joined = candidates.join(served, [*by, "key"], "left")
    return joined.groupBy(*by, "arm").agg(F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("served"))


def prefer(listed: DataFrame, wanted: Column, top: int, by: tuple[str, ...] = ("query_id", "arm")) -> DataFrame:
    """Each arm's listing with up to half of ``top`` wanted rows first, everything else in its old order."""
    row = F.row_number().over(Window.partitionBy(*by, wanted).orderBy("pos"))
    first = F.when(wanted & (row <= top // 2), 0).otherwise(1)
    marked = listed.withColumn("__first", first)
    return marked.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("__first", "pos")) - 1).drop("__first")
