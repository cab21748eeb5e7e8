"""Joins whose keys may be crowded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of keys whose rows are counted; a bucket is crowded from so many times its fair share on, and from so many rows.
BUCKETS, CROWDED, LEAST = 4096, 8, 1000


def crowded(rows: DataFrame, keys: list[str]) -> dict[int, int]:
    """By crowded bucket of keys the number of tasks its rows are dealt over: at most BUCKETS / CROWDED entries."""
    counted = rows.groupBy(_bucket(keys).alias("bucket")).count().collect()  # at most BUCKETS rows
    fair = sum(r["count"] for r in counted) / BUCKETS
    return {r.bucket: int(-(-r["count"] // (fair * CROWDED / 2))) for r in counted if r["count"] > max(CROWDED * fair, LEAST)}


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(BUCKETS)).cast("int")


def spread_join(large: DataFrame, small: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``large`` joined with ``small`` on ``keys``, where a few keys may hold much of ``large``.

    Rows of crowded buckets are dealt over several tasks by a hash of ``by``, and the rows of ``small`` in them are
    repeated for each. ``how`` keeps nothing of ``small`` alone: inner, left or left_semi. ``large`` is read
    twice, so it should be a written table. Null keys meet nothing, as in any join.
    """
    parts = crowded(large, keys)
    if not parts:
        return large.join(small, keys, how)
    tasks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), _bucket(keys)), F.lit(1))
    dealt = large.withColumn("dealt", F.pmod(F.xxhash64(*by), tasks).cast("int"))
    repeated = small.withColumn("dealt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return dealt.join(repeated, [*keys, "dealt"], how).drop("dealt")
