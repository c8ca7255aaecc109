"""Consecutive numbers in a sorted order, without a task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.operators.workspace import materialise


def numbered_by(df: DataFrame, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """df with `into`: 0, 1, 2, ... in the order of some columns, within each value of others.

    Rows are sorted by ranges and written with their place in the range; running counts of the ranges give each its first number.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__i", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("__part", F.shiftright("__i", 33)))
    parts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__new"), F.min("__i").alias("__low"))
    start = parts.withColumn("__start", F.sum("__new").over(W.partitionBy(*by).orderBy("__part")) - F.col("__new") - F.col("__low")).drop("__new", "__low")  # a row a range
    same = F.col("a.__part") == F.col("b.__part")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = ranged.alias("a").join(F.broadcast(start).alias("b"), same)
    return met.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b.__start") + F.col("a.__i")).alias(into))
