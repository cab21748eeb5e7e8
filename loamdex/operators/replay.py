"""Replaying queries under many variants of memory and steering, in one job: a variant is a column.

What a variant changes is turned into inputs of each query: its tokens, its preferred folders, what is held back. Arms
run once for each different input, however many variants share it; variants then differ in joins alone. A record that is
left out is excluded from results and rules. It is never weighted by zero, which would keep it among the results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import evaluation, fusion, lexical
from loamdex.session import cut, small

#: Kinds of steering.
KINDS = ("alias", "preference", "exclusion")
#: How much more is fetched than served, as some of it may be held back.
OVERFETCH = 3
MOST_ROWS = 200_000


@dataclass(frozen=True)
class Variant:
    """What of memory and steering a replay uses, and what it is compared with."""

    name: str
    memory: bool = False
    kinds: tuple[str, ...] = ()
    baseline: str = ""
    without: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ("hot",)
    candidates: bool = False


def matrix(candidates: bool = True) -> list[Variant]:
    """The corpus alone, memory alone, each kind of steering alone, all of it, and all with what is only proposed."""
    out = [Variant("B0"), Variant("B1", memory=True, baseline="B0")]
    out += [Variant(f"B{n}", kinds=(kind,), baseline="B0") for n, kind in enumerate(KINDS, 2)]
    out.append(Variant("B5", True, KINDS, "B0"))
    return [*out, Variant("B6", True, KINDS, "B5", candidates=True)] if candidates else out


def without(base: Variant, name: str, *records: str) -> Variant:
    """``base`` with some records held out, compared with ``base``: what these records are worth."""
    return replace(base, name=f"{base.name}-{name}", baseline=base.name, without=(*base.without, *sorted(records)), candidates=base.candidates)


def with_cold(base: Variant) -> Variant:
    """``base`` that sees cold memory too."""
    return replace(base, name=f"{base.name}-cold", baseline=base.name, tiers=("hot", "cold"))


def _table(like: DataFrame, variants: list[Variant]) -> DataFrame:
    rows = [(v.name, v.memory, list(v.kinds), v.baseline, list(v.without), list(v.tiers), v.candidates) for v in variants]
    return F.broadcast(like.sparkSession.createDataFrame(rows, "variant string, memory boolean, kinds array<string>, baseline string, without array<string>, tiers array<string>, candidates boolean"))  # a given list


def fired(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, record_id, kind, values) of alias and preference rules that fire: one of their terms is among the tokens, whole or in all its parts."""
    keyed = rules.filter(F.col("kind").isin("alias", "preference")).select("record_id", "kind", "values", F.explode("terms").alias("term"))
    keyed = keyed.withColumn("token", F.explode(F.array_distinct(F.array("term", F.split("term", "[_ ]")[0]))))
    asked = tokens.select("query_id", "tokens", F.explode("tokens").alias("token"))
    there = F.array_contains("tokens", F.col("term")) | (F.size(F.array_except(F.split("term", "[_ ]"), F.col("tokens"))) == 0)
    return asked.join(small(keyed, MOST_ROWS), "token").filter(there).select("query_id", "record_id", "kind", "values").distinct()


def admitted(rules: DataFrame, variants: list[Variant]) -> DataFrame:
    """(variant, record_id): the rules that each variant takes."""
    v = _table(rules, variants)
    fine = F.array_contains("kinds", F.col("kind")) & ~F.array_contains("without", F.col("record_id")) & ((F.col("status") == "admitted") | F.col("candidates"))
    return rules.select("record_id", "kind", "status").crossJoin(v).filter(fine).select("variant", "record_id")  # a variant is a row of a given list


def inputs(queries: DataFrame, rules: DataFrame, variants: list[Variant]) -> DataFrame:
    """(variant, query_id, query, tokens, prefixes, arm): what each variant asks of each query; equal inputs of a query share their ``arm``.

    ``queries`` are (query_id, query), ``rules`` (record_id, kind, terms, values, status). Rules fire once for all
    variants; which of them count is a join.
    """
    asked = queries.select("query_id", "query", T.query_tokens(F.col("query")).alias("own"))
    hits = fired(asked.withColumnRenamed("own", "tokens"), rules).join(small(admitted(rules, variants), MOST_ROWS), "record_id")
    gathered = lambda kind: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("values"))))))
    added = hits.groupBy("variant", "query_id").agg(gathered("alias").alias("added"), gathered("preference").alias("prefixes"))
    grid = asked.crossJoin(_table(queries, variants).select("variant")).join(added, ["variant", "query_id"], "left")
    none = F.expr("cast(array() as array<string>)")
    grid = grid.withColumn("tokens", F.array_sort(F.array_union("own", F.coalesce("added", none)))).withColumn("prefixes", F.coalesce("prefixes", none))
    return grid.select("variant", "query_id", "query", "tokens", "prefixes", F.xxhash64("query_id", F.array_join("tokens", " "), F.array_join("prefixes", " ")).alias("arm"))


def distinct_arms(asked: DataFrame) -> DataFrame:
    """(arm, query_id, query, tokens, prefixes): each different input once."""
    return asked.dropDuplicates(["arm"]).select("arm", "query_id", "query", "tokens", "prefixes")


def prior(paths: DataFrame, arms: DataFrame, key: str = "doc_id") -> Callable[[DataFrame], DataFrame]:
    """For BM25 over arms: hits with the prior of their path, cheaper under one of the arm's preferred folders."""
    return lexical.path_prior(paths, arms.select(F.col("arm").alias("query_id"), F.explode("prefixes").alias("prefix")), key)


def candidates(asked: DataFrame, found: DataFrame, records: DataFrame, barred: DataFrame, variants: list[Variant], top: int = 20) -> DataFrame:
    """(variant, query_id, arm, pos, key, node, kind, weight): what each variant may fuse.

    ``found`` are (of, arm, pos, key, node, kind), where ``of`` names the input; ``records`` (record_id, node, tier) are
    memory among the nodes, ``barred`` (record_id, node) what each exclusion keeps out. Memory shows where the variant
    takes it, in its tiers, and unless it is left out; positions close up behind what is gone.
    """
    v = _table(asked, variants)
    rows = asked.select("variant", "query_id", F.col("arm").alias("of")).join(found, "of").join(v.select("variant", "memory", "without", "tiers"), "variant")
    rows = rows.join(records.select("node", F.col("record_id").alias("__record"), "tier"), "node", "left")
    shows = F.col("__record").isNull() | (F.col("memory") & F.array_contains("tiers", F.col("tier")) & ~F.array_contains("without", F.col("__record")))
    rows = rows.filter(F.coalesce(shows, F.lit(False))).join(barred.select("variant", "node").distinct(), ["variant", "node"], "left_anti")
    place = F.row_number().over(Window.partitionBy("variant", "query_id", "arm").orderBy("pos", "key")) - 1
    return rows.withColumn("pos", place.cast("long")).filter(F.col("pos") < top).select("variant", "query_id", "arm", "pos", "key", "node", "kind", F.lit(1.0).alias("weight"))


def replay(asked: DataFrame, found: DataFrame, records: DataFrame, barred: DataFrame, variants: list[Variant], top: int = 10) -> DataFrame:
    """(variant, query_id, rank, key, node, ...): the fused results of every query under every variant."""
    rows = candidates(asked, found, records, barred, variants, 2 * top)
    return fusion.fuse(rows, top, by=("variant", "query_id"))


MEASURES = ("recall", "hit", "reciprocal_rank", "gain", "bpref")


def compared(results: DataFrame, judgements: DataFrame, variants: list[Variant], k: int = 10) -> DataFrame:
    """(variant, baseline, measure, queries, value, pairs, delta, better, worse): each variant's means, and its differences from its baseline by query.

    ``results`` are (variant, query_id, rank, node); a query of which nothing is known is left out, and one without
    results counts as nothing found.
    """
    scored = cut(evaluation.per_query(results.select("variant", "query_id", "rank", F.col("node").alias("target")), judgements, k, ("variant", "query_id")), "replayed")
    long = scored.unpivot(["variant", "query_id"], [F.col(m).cast("double").alias(m) for m in MEASURES], "measure", "value")
    base = _table(results, variants).select("variant", "baseline")
    paired = long.join(base, "variant").join(long.select(F.col("variant").alias("baseline"), "query_id", "measure", F.col("value").alias("before")), ["baseline", "query_id", "measure"], "left")
    delta: Column = F.round(F.col("value") - F.col("before"), 6)
    exact = lambda c: F.sum(c.cast("decimal(18,6)")).cast("double")  # noqa: E731  the same sum in any order
    return paired.groupBy("variant", "baseline", "measure").agg(
        F.count(F.lit(1)).alias("queries"), F.round(exact(F.col("value")) / F.count(F.lit(1)), 6).alias("value"), F.count("before").alias("pairs"),
        F.round(F.try_divide(exact(delta), F.count("before")), 6).alias("delta"), F.count_if(delta > 0).alias("better"), F.count_if(delta < 0).alias("worse"),
    )
