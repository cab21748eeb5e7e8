"""Sketches that are merged instead of counting again, with the error that they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a distinct count's sketch; its relative error is about 0.83 / sqrt(2 ** BITS), and three times that is stated.
BITS = 12
ERROR = 3 * 0.83 / 2 ** (BITS / 2)
#: How exact quantiles are: their rank is off by at most one part in so many.
ACCURACY = 1000


def daily(rows: DataFrame, at: str, value: str, *by: str) -> DataFrame:
    """(by..., day, sketch): a sketch of the distinct values of each day."""
    return rows.groupBy(*by, F.to_date(at).alias("day")).agg(F.hll_sketch_agg(value, F.lit(BITS)).alias("sketch"))


def rolled_up(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., estimate) of distinct values over all days, from their sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """(by..., share, value): approximate quantiles, in one pass."""
    found = rows.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(s) for s in shares]), F.lit(ACCURACY)).alias("q"))
    return found.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("q").alias("value"))).alias("z")).select(*by, "z.share", "z.value")


def within(estimate: Column, exact: Column, error: float = ERROR) -> Column:
    """Whether an estimate is as near as stated; small counts may be off by one."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * error)
