"""Joins on one text lying inside another, as equi-joins on short grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unfolded

GRAM = 3


def inside_pairs(short: DataFrame, a: str, long: DataFrame, b: str) -> DataFrame:
    """Distinct (a, b) where text ``a`` of ``short`` lies inside text ``b`` of ``long``.

    Each a is looked up by its first ``GRAM`` characters (fewer if it has fewer) among
    all runs of 0 to ``GRAM`` characters of each b.
    """
    x = short.select(F.col(a).alias("__a")).filter("__a is not null").distinct().withColumn("__g", F.substring("__a", 1, GRAM))
    starts = F.sequence(F.lit(1), F.greatest(F.length("__b"), F.lit(1)))
    runs = F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("__b"), i, F.lit(n)) for n in range(GRAM + 1)])))
    y = long.select(F.col(b).alias("__b")).filter("__b is not null").distinct()
    y = unfolded(y, F.array_distinct(runs), "__g").select("__b", "__g")
    return x.join(y, "__g").filter(F.contains("__b", F.col("__a"))).select(F.col("__a").alias(a), F.col("__b").alias(b)).distinct()
