"""Attributes as they were known at an event's position.

Every change of an attribute gets a number within its entity; every event gets the number of changes
that precede it, by a cumulative count over narrow rows of positions; the wide attribute row is then
found by an equi-join on entity and number.  No range join and no sort of wide rows is needed.

The cumulative count works in two levels, by stretches of positions, so that an entity that holds a
third of all rows is counted in as many tasks as it has stretches:

  count inside (entity, stretch)  +  sum of the counts of the entity's earlier stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Positions in a stretch. The rows of one entity in one stretch are sorted together, so this bounds a task.
STRETCH = 1 << 15
#: Copies of an entity's key list, over which the events of a hot entity are spread.
SPREAD = 8

_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def fold_key(column: F.Column) -> F.Column:
    """A key without regard to case and outer blanks."""
    return F.lower(F.regexp_replace(column, _BLANKS, ""))


def is_blank(column: F.Column) -> F.Column:
    """Null, empty or white space only."""
    return column.isNull() | (F.regexp_replace(column, r"[\s\p{Z}]", "") == "")


def cumulative_versions(rows: DataFrame, entity: list[str], position: str, order: list[str], change: str, stretch: int = STRETCH) -> DataFrame:
    """Distinct rows with ``version``: how many rows with ``change`` = 1 the entity has up to and including the row.

    Order within an entity is (position, *order), which should be total; ties get an arbitrary order.
    Repeated rows count once. Rows with a null position have no place and are dropped. An empty table
    gives an empty table. The rows of one entity in one stretch of positions are sorted in one task.
    """
    part = [*entity, "_stretch"]
    rows = rows.where(F.col(position).isNotNull()).withColumn("_stretch", F.floor(F.col(position) / stretch))
    rows = rows.repartition(*part).dropDuplicates()
    inside = Window.partitionBy(*part).orderBy(position, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*entity).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*part).agg(F.sum(change).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    counted = rows.withColumn("_inside", F.sum(change).over(inside))
    return counted.join(base, part).withColumn("version", F.col("_inside") + F.col("_base")).drop("_inside", "_base", "_stretch")


def attributes_as_of(events: DataFrame, attrs: DataFrame, stretch: int = STRETCH, spread: int = SPREAD) -> DataFrame:
    """For each event and each key of its entity, the attribute record in force at the event's position.

    events: scope, entity, p, event_rec. attrs: scope, entity, key, p, ord, attr_rec. Further columns are ignored.
    In force is the record of the scope, entity and key with p <= the event's p and the greatest (p, ord); among
    equal (p, ord) the greatest attr_rec. Keys must already be folded (fold_key).
    Rows with a null in scope, entity, key or p take no part; a null ord counts as the smallest.
    Repeated rows count once. Where nothing is in force there is no row.
    Returns event_rec, scope, entity, key, attr_rec.
    """
    events = events.select("scope", "entity", "p", "event_rec").where("scope is not null and entity is not null and p is not null")
    attrs = attrs.select("scope", "entity", "key", "p", "ord", "attr_rec").where("scope is not null and entity is not null and key is not null and p is not null")
    own = ["scope", "entity", "key"]
    # The keys an entity ever has, with the position of the first record; copied so that a hot entity's events spread.
    first = attrs.groupBy(*own).agg(F.min("p").alias("_first"))
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    asked = events.withColumn("_salt", F.pmod(F.xxhash64("event_rec"), F.lit(spread)).cast("int"))
    asked = asked.join(first, ["scope", "entity", "_salt"]).where(F.col("_first") <= F.col("p"))
    narrow = attrs.select(*own, "p", F.lit(0).alias("side"), "ord", F.col("attr_rec").alias("rec"), F.lit(1).alias("change")).unionByName(
        asked.select(*own, "p", F.lit(1).alias("side"), F.lit(None).cast("long").alias("ord"), F.col("event_rec").alias("rec"), F.lit(0).alias("change"))
    )
    # Written once: both sides of the join read it.
    placed = cut(cumulative_versions(narrow, own, "p", ["side", "ord", "rec"], "change", stretch).select("side", *own, "version", "rec"))
    changes = placed.where("side = 0").select(*own, "version", F.col("rec").alias("attr_rec"))
    return placed.where("side = 1").select(*own, "version", F.col("rec").alias("event_rec")).join(changes, [*own, "version"]).select("event_rec", "scope", "entity", "key", "attr_rec")
