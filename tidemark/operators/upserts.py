"""Optimistic upserts: operations with an expected revision, applied in order per item; and merges of two replicas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(ops: list[tuple]) -> tuple[list[tuple], tuple | None]:
    """Outcome of each (operation, expected, value, deleted) in order, and the item's last state (revision, value, deleted).

    A repeated operation changes nothing; a wrong expected revision is a conflict; else the revision grows by one. An item that was never written has revision 0.
    """
    state, seen, out = (0, None, False), set(), []
    for operation, expected, value, deleted in ops:
        if operation in seen:
            out.append((operation, "repeated", state[0]))
        elif expected != state[0]:
            out.append((operation, "conflict", state[0]))
        else:
            state = (state[0] + 1, value, bool(deleted))
            seen.add(operation)
            out.append((operation, "applied", state[0]))
    return out, state if state[0] else None


def apply_operations(ops: DataFrame) -> DataFrame:
    """item, revision, value, deleted, conflicts, repeated of every item with an applied operation.

    ops: item, seq (order), operation, expected (long), value (double), deleted. Each operation depends on the outcome of the one before, so an item is
    replayed in one task, by its own operations only. Repeated rows are repeated operations; a null item is left out.
    """

    def of_item(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seq", "operation"])
        outcomes, state = replay(list(part[["operation", "expected", "value", "deleted"]].itertuples(index=False, name=None)))
        kinds = [o[1] for o in outcomes]
        rows = [(part["item"].iloc[0], *state, kinds.count("conflict"), kinds.count("repeated"))] if state else []
        return pd.DataFrame(rows, columns=["item", "revision", "value", "deleted", "conflicts", "repeated"])

    return ops.where("item is not null").groupBy("item").applyInPandas(of_item, "item long, revision long, value double, deleted boolean, conflicts long, repeated long")


def merge_replicas(local: DataFrame, remote: DataFrame) -> DataFrame:
    """item, revision, value, outcome: the higher revision wins; equal revisions with different values conflict, and the local one stays.

    Both: item (unique), revision, value. Items of one side only are kept.
    """
    both = local.select("item", F.col("revision").alias("rl"), F.col("value").alias("vl")).join(remote.select("item", F.col("revision").alias("rr"), F.col("value").alias("vr")), "item", "full")
    theirs = F.col("rl").isNull() | (F.col("rr") > F.col("rl"))
    outcome = F.when(F.col("rr").isNull(), "local").when(theirs, "remote").when((F.col("rr") == F.col("rl")) & ~F.col("vr").eqNullSafe(F.col("vl")), "conflict").when(F.col("rr") == F.col("rl"), "same").otherwise("local")
    return both.select("item", F.when(theirs, F.col("rr")).otherwise(F.col("rl")).alias("revision"), F.when(theirs, F.col("vr")).otherwise(F.col("vl")).alias("value"), outcome.alias("outcome"))
