"""Intervals: overlapping spans merged, and overlays where earlier and longer spans win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_overlaps(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end, spans: spans that touch or overlap within a key made one (gaps and islands). Null or empty spans are dropped."""
    rows = spans.where(F.col(start) < F.col(end))
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("spans")).drop("_island")


def overlay(base: DataFrame, extra: DataFrame, keys: list[str], width: int = 1 << 12) -> DataFrame:
    """Base spans, and the extra spans [s, e) that overlap none of them, by an equi-join on stretches of positions.

    base and extra: keys, s, e, id. Extra spans are not compared with each other.
    """
    cell = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))
    taken = base.where("s < e").select(*keys, F.col("s").alias("bs"), F.col("e").alias("be"), cell.alias("_cell"))
    asked = extra.where("s < e").withColumn("_cell", cell)
    hit = asked.join(taken, [*keys, "_cell"]).where("s < be and bs < e").select(*keys, "s", "e", "id").distinct()
    return base.select(*keys, "s", "e", "id").unionByName(extra.where("s < e").select(*keys, "s", "e", "id").join(hit, [*keys, "s", "e", "id"], "left_anti"))
