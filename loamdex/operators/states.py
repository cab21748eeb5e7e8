"""States of a knowledge base: what two of them share and where they differ, from digests that no task gathers rows for."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions import text as T

#: Digits of a row's digest that are summed, and the modulus of the sum.
DIGITS, MODULUS = 15, Decimal(10**24)


def _number(*parts: Column) -> Column:
    return F.conv(F.substring(T.digest(*parts), 1, DIGITS), 16, 10).cast("decimal(38,0)")


def _sum(number: Column) -> Column:
    return F.lpad((F.coalesce(F.sum(number), F.lit(0)) % F.lit(MODULUS).cast("decimal(38,0)")).cast("decimal(24,0)").cast("string"), 24, "0")


def section(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (n, digest) of a set of rows, whatever their order; repeated rows count."""
    return rows.agg(F.count(F.lit(1)).alias("n"), _sum(_number(*[F.col(c) for c in columns])).alias("digest"))


def ranked(rows: DataFrame, rank: str, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, digest) of ranked rows, which another order changes: each row's digest is of its rank too, so sums of parts are enough."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _sum(_number(F.col(rank), *[F.col(c) for c in columns])).alias("digest"))


def manifest(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, n, digest, state) of named sections (n, digest); ``state`` is the whole's id, without a clock in it: the same state has the same id."""
    listed = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("section"), "n", "digest") for name, df in sections.items()])
    whole = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "section", "n", "digest"))), "|")
    state = listed.agg(F.concat(F.lit("state-"), F.substring(F.sha2(whole, 256), 1, 16)).alias("state"))  # a row a section
    return listed.crossJoin(F.broadcast(state))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(section, change) of two manifests: added, removed, or changed, which takes a digest: a count alone is no change."""
    a, b = before.select("section", F.col("digest").alias("a")), after.select("section", F.col("digest").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "section", "full").select("section", change.alias("change")).filter("change is not null")
