"""Running aggregates over the rows of an entity, in two levels, so that a hot entity is no single task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, entity: list[str], position: str, order: list[str], value: str, out: str, agg: Callable[[Column], Column] = F.sum, stretch: int = 1 << 15, inclusive: bool = True) -> DataFrame:
    """Adds ``out``: the aggregate (sum, max, min) of ``value`` over the entity's rows up to the row, or before it.

    Order is (position, *order). The aggregate must be its own combination (sum, max, min). Rows with a null position are dropped;
    an aggregate over no rows is null. A stretch of positions of one entity is sorted in one task.
    """
    part = [*entity, "_stretch"]
    rows = rows.where(F.col(position).isNotNull()).withColumn("_stretch", F.floor(F.col(position) / stretch)).repartition(*part)
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*part).orderBy(position, *order).rowsBetween(Window.unboundedPreceding, end)
    earlier = Window.partitionBy(*entity).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*part).agg(agg(F.col(value)).alias("_v")).withColumn("_base", agg(F.col("_v")).over(earlier)).drop("_v")
    both = rows.withColumn("_inside", agg(F.col(value)).over(inside)).join(base, part)
    if agg is F.sum:
        total = F.when(F.col("_inside").isNull(), F.col("_base")).otherwise(F.col("_inside") + F.coalesce("_base", F.lit(0)))
    else:
        total = (F.greatest if agg is F.max else F.least)("_inside", "_base")
    return both.withColumn(out, total).drop("_inside", "_base", "_stretch")


def within_spans(points: DataFrame, spans: DataFrame, scope: str, point: str, start: str, end: str, width: int = 1 << 14) -> DataFrame:
    """Points joined to the spans [start, end) of their scope that hold them, by an equi-join on stretches of positions.

    Columns of both sides must differ but for the scope. Null scopes, points and bounds match nothing; empty spans hold nothing.
    """
    cells = spans.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    placed = points.withColumn("_cell", F.floor(F.col(point) / width))
    return placed.join(cells, [scope, "_cell"]).where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_cell")


def ranked(rows: DataFrame, entity: list[str], position: str, order: list[str], out: str = "rank", stretch: int = 1 << 15) -> DataFrame:
    """Adds ``out``: the place of each row of its entity from 1, in the order (position, *order), counted in two levels."""
    return running(rows.withColumn("_one", F.lit(1)), entity, position, order, "_one", out, stretch=stretch).drop("_one")


def sliding(rows: DataFrame, entity: list[str], position: str, order: list[str], last: int, width: int = 4096, **aggregates: Column) -> DataFrame:
    """Adds aggregates over the last ``last`` rows of the entity up to each row.

    Rows are cut by their rank into runs of ``width``; the end of each run is shown to the next one too, so no run waits for another and a
    hot entity has many tasks.
    """
    placed = ranked(rows, entity, position, order, "_rank")
    shown = F.when((F.col("_rank") - 1) % width >= width - (last - 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    runs = placed.withColumn("_copy", F.explode(shown)).withColumn("_run", F.floor((F.col("_rank") - 1) / width) + F.col("_copy"))
    window = Window.partitionBy(*entity, "_run").orderBy("_rank").rowsBetween(-(last - 1), Window.currentRow)
    return runs.withColumns({name: agg.over(window) for name, agg in aggregates.items()}).where("_copy = 0").drop("_rank", "_copy", "_run")
