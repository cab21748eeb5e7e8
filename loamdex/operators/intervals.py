"""Intervals and samples in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covered(rows: DataFrame, by: str) -> DataFrame:
    """(by, covered, spans): how many seconds the intervals [begin, end) of each group cover together, and in how many spans.

    An interval that begins after all earlier ones have ended opens a span. Intervals that end before they begin are
    empty, and null ends are left out.
    """
    rows = rows.filter("begin is not null and `end` > begin").select(by, "begin", "end")
    before = Window.partitionBy(by).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    opened = rows.withColumn("reach", F.max("end").over(before)).withColumn("opens", F.coalesce(F.col("begin") > F.col("reach"), F.lit(True)).cast("int"))
    upto = Window.partitionBy(by).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = opened.withColumn("span", F.sum("opens").over(upto)).groupBy(by, "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    length = F.unix_micros("end") - F.unix_micros("begin")
    return spans.groupBy(by).agg(F.round(F.sum(length) / 1e6, 3).alias("covered"), F.count(F.lit(1)).alias("spans"))


def rate(samples: DataFrame, by: str) -> DataFrame:
    """(by, samples, rate): change of ``value`` a second between each group's first and last sample by ``ts``; null for one instant."""
    ends = samples.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.min(F.struct("ts", "value")).alias("a"), F.max(F.struct("ts", "value")).alias("b"))
    seconds = (F.unix_micros("b.ts") - F.unix_micros("a.ts")) / 1e6
    return ends.select(by, "samples", F.round(F.try_divide(F.col("b.value") - F.col("a.value"), seconds), 9).alias("rate"))
