"""Places of rows in an order, without gathering them."""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .lookup import lookup

_WITHIN = (1 << 33) - 1


def with_positions(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with each row's place in the order of some columns, from `start`; equal rows come in any order.

    Rows are dealt by range and sorted there; a row's place is its place in its range, which its running number tells, and the rows of
    the ranges before, of which there is one count a range.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    dealt = cut_lineage(dealt).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)))
    counts = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect())
    before = accumulate((n for _, n in counts), initial=start)
    offsets = spark.createDataFrame([(r, b) for (r, _), b in zip(counts, before)], "__range int, __before long")
    return lookup(dealt, offsets, ["__range"]).withColumn(name, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")
