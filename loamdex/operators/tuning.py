"""Tuning the ranking: where targets get lost, fusing again under other points, halving, gates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators import evaluation, fusion

ACTIONABLE = ("lexical_candidates", "vector_candidates", "filters", "fusion", "truncation")


@dataclass(frozen=True)
class Point:
    """One setting of the fusion, by name."""

    name: str
    rrf_k: int = 60
    text: float = 1.0
    vector: float = 1.0
    graph: float = 1.0


def refuse(captured: DataFrame, points: list[Point], top: int = 10) -> DataFrame:
    """(point, query_id, rank, key, ...): captured candidates fused again under each point, all in one job."""
    spark = captured.sparkSession
    table = spark.createDataFrame([(p.name, p.rrf_k, p.text, p.vector, p.graph) for p in points], "point string, rrf_k int, w_text double, w_vector double, w_graph double")
    weight = F.when(F.col("arm") == "text", F.col("w_text")).when(F.col("arm") == "vector", F.col("w_vector")).otherwise(F.col("w_graph"))
    crossed = captured.drop("weight").crossJoin(F.broadcast(table)).withColumn("weight", weight)  # points are a given list
    return fusion.fuse(crossed, top, k=F.col("rrf_k"), by=("point", "query_id"))


def attribute(targets: DataFrame, candidates: DataFrame, fused: DataFrame, indexed: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, target, stage): the first stage that lost a wanted target, or served.

    ``candidates`` are (query_id, arm, target, survived), ``fused`` (query_id, rank, target) before the cut.
    """
    arms = candidates.groupBy("query_id", "target").agg(F.bool_or("survived").alias("survived"), F.bool_or(F.col("arm") == "text").alias("text"))
    joined = targets.join(indexed.select("target").distinct().withColumn("there", F.lit(True)), "target", "left").join(arms, ["query_id", "target"], "left")
    joined = joined.join(fused.groupBy("query_id", "target").agg(F.min("rank").alias("rank")), ["query_id", "target"], "left")
    stage = (
        F.when(F.col("rank") <= top, "served").when(F.col("there").isNull(), "absent_from_corpus").when(F.col("survived").isNull(), "lexical_candidates")
        .when(~F.col("survived"), "filters").when(F.col("rank").isNull(), "fusion").otherwise("truncation")
    )
    return joined.select("query_id", "target", stage.alias("stage"))


def histogram(attributed: DataFrame) -> DataFrame:
    """(stage, n, share): where targets were lost, with each stage's share of those not served."""
    counted = attributed.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    lost = F.sum(F.when(F.col("stage") != "served", F.col("n"))).over(Window.partitionBy())  # a row a stage
    return counted.select("stage", "n", F.when(F.col("stage") != "served", F.round(F.col("n") / lost, 6)).alias("share"))


#: The steps that each parameter of the fusion may take, one to either side of where it is.
LADDERS = {
    "rrf_k": (10, 20, 30, 60, 90, 120, 200), "text": (0.5, 0.75, 1.0, 1.5, 2.0, 3.0),
    "vector": (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0), "graph": (0.0, 0.25, 0.5, 0.75, 1.0, 1.5),
}
#: Which parameters act on what loses targets; a stage that isn't here isn't mended by fusing again.
ACTS_ON = {"fusion": ("rrf_k", "text", "vector", "graph"), "truncation": ("rrf_k", "text", "vector", "graph")}
#: Least share of misses that must lie in such stages, rounds, and share of the queries in the first of them.
LEAST_SHARE, ROUNDS, FIRST_SHARE = 0.34, 3, 0.34


def blamed(lost: DataFrame, most: int = 3) -> list[str]:
    """The stages of a ``histogram`` that lost most targets and that a parameter acts on; none if too few of the losses are theirs."""
    counts = {r["stage"]: r["n"] for r in lost.filter("stage != 'served'").collect()}  # a row a stage
    ours = sorted((s for s in counts if s in ACTS_ON), key=lambda s: (-counts[s], s))
    return ours[:most] if ours and sum(counts[s] for s in ours) >= LEAST_SHARE * sum(counts.values()) else []


def propose(stages: list[str], current: Point, budget: int = 16) -> list[Point]:
    """Points one step of one parameter away from the current one, for the blamed stages in order, as many as the budget allows."""
    out: list[Point] = []
    for parameter in dict.fromkeys(p for s in stages for p in ACTS_ON[s]):
        here = getattr(current, parameter)
        below, above = [x for x in LADDERS[parameter] if x < here], [x for x in LADDERS[parameter] if x > here]
        for value in (*below[-1:], *above[:1]):
            out.append(replace(current, name=f"{parameter}={value:g}", **{parameter: value}))
    return out[:budget]


def schedule(queries: int, points: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(queries, points) of each round: points are halved while queries double, and the last round asks all; with little to halve there is one round."""
    if points <= 2 or queries < 6 or rounds <= 1:
        return [(queries, points)]
    first = max(1, int(queries * FIRST_SHARE))
    return [(queries if r == rounds - 1 else min(queries, first << r), max(1, points >> r)) for r in range(rounds)]


def halving(captured: DataFrame, judgements: DataFrame, points: list[Point], top: int = 10) -> DataFrame:
    """(round, point, queries, score, place): successive halving of points by mean reciprocal rank.

    ``captured`` are the arms' candidates, which are not searched for again, ``judgements`` (query_id, target,
    judgement). Queries of which something good is known are asked in the order of a hash of their id, so each round's
    are among the next one's. The best points of a round, ties by name, go on to the next; the first of the last round is
    the chosen one.
    """
    spark = captured.sparkSession
    known = judgements.filter("judgement > 0").select("query_id").distinct()
    order = known.orderBy(F.md5(F.col("query_id").cast("string").cast("binary")), "query_id")
    rows, alive = [], {p.name: p for p in points}
    plan = schedule(known.count(), len(points))
    for n, (queries, _) in enumerate(plan, 1):
        asked = F.broadcast(order.limit(queries))  # ids of a cohort
        fused = refuse(captured.join(asked, "query_id", "left_semi"), list(alive.values()), top)
        results = fused.select("point", "query_id", "rank", F.col("node").alias("target"))
        scored = evaluation.per_query(results, judgements.join(asked, "query_id", "left_semi"), top, ("point", "query_id"))
        means = halve(scored, len(alive)).collect()  # a row a point
        rows += [(n, r["point"], queries, float(r["score"]), k) for k, r in enumerate(means, 1)]
        alive = {r["point"]: alive[r["point"]] for r in means[: plan[n][1] if n < len(plan) else 1]}
    return spark.createDataFrame(rows, "round int, point string, queries int, score double, place int")


def halve(scored: DataFrame, keep: int) -> DataFrame:
    """(point, score) of the best points by mean reciprocal rank, ties by name."""
    exact = F.sum(F.col("reciprocal_rank").cast("decimal(18,6)")).cast("double")  # the same sum in any order
    means = scored.groupBy("point").agg(F.round(exact / F.count(F.lit(1)), 6).alias("score"))
    return means.orderBy(F.desc("score"), "point").limit(keep)


def decide(pairs: int, gain: float | None, control: float | None, growth: float, least_pairs: int = 20, least_gain: float = 0.005, least_control: float = -0.01, most_growth: float = 0.15) -> dict[str, bool]:
    """Each gate of a promotion and whether it is passed; a missing control doesn't block."""
    return {
        "sufficient_evidence": pairs >= least_pairs, "holdout_gain": gain is not None and gain >= least_gain,
        "control": control is None or control >= least_control, "stage_growth": growth <= most_growth,
    }
