"""Evidence and retrieval metrics: what was served, what is known of it, and what follows.

Unknown is never negative: results nobody judged are left out of every denominator. A metric without enough
evidence has a null value and the status insufficient_evidence, never zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an event says of a result: polarity, strength, weight.
EVENTS = {
    "considered": ("unknown", "weak", 0.0), "served": ("unknown", "weak", 0.0), "included_in_context": ("unknown", "moderate", 0.0),
    "cited": ("positive", "weak", 0.25), "selected": ("positive", "moderate", 0.5), "explicit_accept": ("positive", "strong", 1.0),
    "downstream_success": ("positive", "strong", 1.0), "deterministic_validation_pass": ("positive", "conclusive", 1.0),
    "explicit_reject": ("negative", "strong", -1.0), "downstream_failure": ("negative", "strong", -1.0), "explicit_correction": ("negative", "strong", -1.0),
    "superseded": ("negative", "strong", -1.0), "deterministic_validation_fail": ("negative", "conclusive", -1.0),
    "immediate_reformulation": ("unknown", "weak", 0.0), "not_selected": ("unknown", "weak", 0.0),
}
STRENGTH = {"weak": 0.25, "moderate": 0.5, "strong": 1.0, "conclusive": 1.0}
FLOOR = 0.2
TERMINAL = 10_000
INSUFFICIENT = "insufficient_evidence"


def _look_up(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def weigh(event: Column, age_days: Column, half_life: float = 90.0, reliability: float = 1.0) -> Column:
    """An event's weight as evidence, halved every half-life, rounded to six digits."""
    base = _look_up(event, {k: v[2] * STRENGTH[v[1]] for k, v in EVENTS.items()})
    return F.round(base * F.pow(F.lit(0.5), age_days / half_life) * reliability, 6)


def evidence(proofs: DataFrame) -> DataFrame:
    """(query_id, target, positive, negative, seen): weights of both kinds apart, and how often the target was seen."""
    exact = lambda c: F.sum(c.cast("decimal(18,6)")).cast("double")  # noqa: E731  the same sum in any order
    return proofs.groupBy("query_id", "target").agg(
        exact(F.greatest("weight", F.lit(0.0))).alias("positive"), exact(F.greatest(-F.col("weight"), F.lit(0.0))).alias("negative"), F.count(F.lit(1)).alias("seen")
    )


def judged(known: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(query_id, target, judgement 1 or -1) where one kind of evidence reaches the floor and outweighs the other."""
    good = (F.col("positive") >= floor) & (F.col("positive") > F.col("negative"))
    bad = (F.col("negative") >= floor) & (F.col("negative") > F.col("positive"))
    return known.withColumn("judgement", F.when(good, 1).when(bad, -1)).filter("judgement is not null").select("query_id", "target", "judgement")


def conflicts(known: DataFrame, floor: float = FLOOR) -> DataFrame:
    """One row: targets, and those with enough evidence of both kinds."""
    both = (F.col("positive") >= floor) & (F.col("negative") >= floor)
    return known.agg(F.count(F.lit(1)).alias("targets"), F.count_if(both).alias("conflicting"))


def per_query(results: DataFrame, judgements: DataFrame, k: int = 10, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per query with positives: positives found to k, first rank, negatives served, gain over the ideal, preference order.

    ``results`` are (by..., rank from 1, target), ``judgements`` (query_id, target, judgement). A query without
    results still counts. Ranks beyond the list count as ``TERMINAL``.
    """
    first = results.groupBy(*by, "target").agg(F.min("rank").alias("rank"))
    runs = results.select(*[c for c in by if c != "query_id"]).distinct() if len(by) > 1 else None
    asked = judgements if runs is None else judgements.crossJoin(F.broadcast(runs))  # runs are variants: few
    seen = asked.join(first, [*by, "target"], "left").withColumn("rank", F.coalesce("rank", F.lit(TERMINAL)))
    good, bad = F.col("judgement") > 0, F.col("judgement") < 0
    inside = F.col("rank") <= k
    gain = F.when(inside, F.col("judgement") / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ordered = seen.withColumn("negatives_above", F.sum(bad.cast("int")).over(Window.partitionBy(*by).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)))
    ordered = ordered.withColumn("negatives_above", F.coalesce("negatives_above", F.lit(0)))
    out = ordered.groupBy(*by).agg(
        F.count_if(good).alias("positives"), F.count_if(bad).alias("negatives"), F.count_if(good & inside).alias("found"), F.count_if(bad & inside).alias("exposed"),
        F.min(F.when(good & (F.col("rank") < TERMINAL), F.col("rank"))).alias("first_rank"), F.sum(gain).alias("gain"),
        F.collect_list(F.when(good, F.col("negatives_above"))).alias("above"),
        F.sum(F.when(good, F.col("negatives_above"))).alias("misordered"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("positives", F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    bpref = F.aggregate("above", F.lit(0.0), lambda s, n: s + 1.0 - F.least(n, F.col("positives")) / F.col("positives")) / F.col("positives")
    return out.filter("positives > 0").select(
        *by, "positives", "negatives", "found", "exposed", F.coalesce("first_rank", F.lit(0)).cast("long").alias("first_rank"),
        F.round(F.col("found") / F.col("positives"), 6).alias("recall"), (F.col("found") > 0).cast("int").alias("hit"),
        F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gain") / ideal)), 6).alias("gain"), F.round(bpref, 6).alias("bpref"), "misordered",
    )


def summary(scored: DataFrame, by: tuple[str, ...] = (), least: int = 5) -> DataFrame:
    """Long rows (by..., metric, value, denominator, status) of ``per_query``; below ``least`` queries the value is null."""
    means = [F.avg(c).alias(c) for c in ("recall", "hit", "reciprocal_rank", "gain", "bpref")]
    wide = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("denominator"), *means)
    long = wide.unpivot([*by, "denominator"], ["recall", "hit", "reciprocal_rank", "gain", "bpref"], "metric", "value")
    enough = F.col("denominator") >= least
    return long.select(*by, "metric", F.when(enough, F.round("value", 6)).alias("value"), "denominator", F.when(enough, "ok").otherwise(INSUFFICIENT).alias("status"))


def paired(baseline: DataFrame, treatment: DataFrame, measure: str = "reciprocal_rank") -> DataFrame:
    """(query_id, delta, reason): the difference where both runs have the query, else why it is left out."""
    a, b = baseline.select("query_id", F.col(measure).alias("a")), treatment.select("query_id", F.col(measure).alias("b"))
    joined = a.join(b, "query_id", "full")
    reason = F.when(F.col("a").isNull(), "missing in baseline").when(F.col("b").isNull(), "missing in treatment").otherwise("paired")
    return joined.select("query_id", F.round(F.col("b") - F.col("a"), 6).alias("delta"), reason.alias("reason"))


def churn(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, churn): the share of the first k results that two runs don't have in common."""
    top = lambda df, name: df.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("target").alias(name))
    joined = top(before, "a").join(top(after, "b"), "query_id")
    return joined.select("query_id", F.round(1 - F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.size("b"), F.lit(1)), 6).alias("churn"))


def displacement(control: DataFrame, memory: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, displacement, positive_displacement): what of the control's first k results another run lost."""
    base = control.filter(F.col("rank") <= k).select("query_id", "target").distinct()
    other = memory.filter(F.col("rank") <= k).select("query_id", "target", F.lit(1).alias("kept")).distinct()
    good = judgements.filter("judgement > 0").select("query_id", "target", F.lit(1).alias("good"))
    joined = base.join(other, ["query_id", "target"], "left").join(good, ["query_id", "target"], "left")
    lost = F.col("kept").isNull()
    return joined.groupBy("query_id").agg(
        F.round(F.count_if(lost) / F.count(F.lit(1)), 6).alias("displacement"), F.round(F.try_divide(F.count_if(lost & F.col("good").isNotNull()), F.count("good")), 6).alias("positive_displacement")
    )


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p50, p95, most, n): nearest ranks."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return rows.groupBy(by).agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))


def history(rows: DataFrame, by: str, at: str) -> DataFrame:
    """``rows`` (by, at, value) with the change of the value since the row before in each group; null for the first."""
    before = F.lag("value").over(Window.partitionBy(by).orderBy(at))
    return rows.select(by, at, "value", F.round(F.col("value") - before, 6).alias("change"))


def composite(metrics: DataFrame, weights: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., composite): the weighted geometric mean of metrics above zero, weights renewed over those that count."""
    weight = _look_up(F.col("metric"), weights)
    fit = metrics.withColumn("w", weight).filter("w is not null and value > 0")
    return fit.groupBy(*by).agg(F.round(F.exp(F.sum(F.col("w") * F.log("value")) / F.sum("w")), 6).alias("composite"))


def gates(tests: DataFrame) -> DataFrame:
    """One row (gates, passed): passed only if there are gates and each is."""
    return tests.agg(F.count(F.lit(1)).alias("gates"), F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("passed"))


def sufficiency(proofs: DataFrame, eligible: int, least: tuple[int, int, int] = (10, 5, 5), most_share: float = 0.5) -> DataFrame:
    """One row (evidenced, interactions, share, sufficient): enough queries, none of which makes up too much."""
    counted = proofs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.agg(F.count(F.lit(1)).alias("evidenced"), F.coalesce(F.sum("n"), F.lit(0)).alias("interactions"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))
    fine = reduce(lambda a, b: a & b, [F.lit(eligible >= least[0]), F.col("evidenced") >= least[1], F.col("interactions") >= least[2], F.coalesce(F.col("share") <= most_share, F.lit(False))])
    return sums.withColumn("sufficient", fine)
