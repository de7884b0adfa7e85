"""Ranks within groups without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], part: Column, name: str = "nth") -> DataFrame:
    """Add the 1-based rank within ``keys`` by ``order``.

    ``part`` must not fall as ``order`` rises; a group is counted part by part and numbered
    inside a part, so a group with a third of all rows is as many tasks as it has parts.
    """
    cut = df.withColumn("__part", part)
    before = (
        cut.groupBy(*keys, "__part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    inside = cut.withColumn("__in", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
    return inside.join(before, [*keys, "__part"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__before", "__in")
