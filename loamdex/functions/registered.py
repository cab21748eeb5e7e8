"""Functions that a user's SQL may call once they are registered: expressions, a grouped aggregate, a function that gives rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def geometric_mean(values: pd.Series) -> float:
    """The geometric mean of what is above zero; null if nothing is."""
    fit = values.dropna()
    fit = fit[fit > 0]
    return float(np.exp(np.log(fit).mean())) if len(fit) else None


class Words:
    """Words of a text with their places, in order."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        for n, m in enumerate(re.finditer("[a-z0-9]+", (text or "").lower())):
            yield m.group(), n


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL, and give their names."""
    spark.udf.register("geometric_mean", geometric_mean)
    spark.udtf.register("words", F.udtf(Words, returnType="word string, place int"))
    spark.sql("create or replace temporary function unit_score(cosine double) returns double return greatest(0d, least(1d, (1d + cosine) / 2d))")
    return ["geometric_mean", "words", "unit_score"]


