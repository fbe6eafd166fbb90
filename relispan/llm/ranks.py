"""Gapless numbers within groups, counted over all rows without an order in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relispan.plans.shared import shared_table


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, ascending by ``order``, null first) and ``n`` (rows) within each ``group``.

    Rows are dealt by ranges of (group, order) and sorted where they land, so that a group that holds most rows spreads
    over tasks; only one count for each group and range meets in a window. Group and order columns are part of the key:
    rows that agree in all of them are numbered in any order. ``group`` must not be null.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    table = shared_table(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = table.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy(group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = shared_table(counts.select(group, "__part", "__first", before.alias("__before"), F.sum("__n").over(w).alias("n")), "counts")
    joined = placed.join(counts, [group, "__part"])
    return joined.withColumn("rank", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")
