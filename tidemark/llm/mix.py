"""Mixing sources to target weights by fitting subset sums to token budgets.

Each source's budget is its target share of all tokens of the listed sources. Whole copies of the source are taken as often as the
budget and the cap allow; the remaining budget is fitted with a subset of its documents, each once more. The subset is
chosen by counts: documents are counted by exact token length, and a bounded-knapsack dynamic programme
over these counts finds how many of each length to take, so that the lengths add up to the budget. Which documents of a
length are taken is decided by a seeded hash. Only counts by length reach one task; documents never do.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encode import count_column
from tidemark.operators.asof import cumulative_versions
from tidemark.session import cut

#: Budget of the first programme. Where it does not meet the budget exactly, it is doubled, up to the whole budget.
FIRST = 20_000
SEED = 17


def fit_counts(counts: dict[int, int], budget: int, first: int = FIRST) -> dict[int, int]:
    """How many of each length to take, so that the sum is as near to the budget as can be (of two equally near sums the smaller).

    counts: documents by length (lengths and counts above 0). A budget of 0 or less takes none; one at or above the sum takes all.
    Lengths are first taken in proportion and the programme fits what is left. A sum that meets the budget cannot be bettered; where none is found,
    the programme gets twice as much of the budget to fit, in the end all of it, so the result is exact at any size.
    """
    whole = sum(n * c for n, c in counts.items())
    if budget <= 0:
        return {}
    if budget >= whole:
        return dict(counts)
    room = first
    while True:
        take = {n: int(c * max(0, budget - room) // whole) for n, c in counts.items()}
        left = budget - sum(n * c for n, c in take.items())
        for n in sorted(counts, reverse=True):  # bring what the rounding left within reach of the programme
            if left > room:
                more = min(counts[n] - take[n], (left - room) // n)
                take[n] += more
                left -= n * more
        missed = _fit(counts, take, left)
        if not missed or room >= budget:
            return {n: c for n, c in take.items() if c}
        room *= 2


def _fit(counts: dict[int, int], take: dict[int, int], left: int) -> int:
    """Bounded knapsack over bits: adds to ``take`` what comes nearest to the rest of the budget; returns by how much it misses.

    Bit s of reach[i] says that the first i packs can add up to s. Counts are packed in powers of two.
    """
    bound, packs = left + max(counts), []
    for n in sorted(counts):
        room, size = min(counts[n] - take[n], bound // n), 1
        while room > 0:
            size = min(size, room)
            packs.append((n, size))
            room, size = room - size, size * 2
    mask, reach = (1 << (bound + 1)) - 1, [1]
    for n, k in packs:
        reach.append((reach[-1] | reach[-1] << (n * k)) & mask)
        if reach[-1] >> left & 1:
            break
    low = (reach[-1] & ((1 << (left + 1)) - 1)).bit_length() - 1
    high = reach[-1] >> left
    above = left + (high & -high).bit_length() - 1 if high else bound + left
    best = low if left - low <= above - left else above
    missed = abs(best - left)
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> best & 1:
            n, k = packs[i - 1]
            take[n] += k
            best -= n * k
    return missed


def plan_mix(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, copies of every document with a listed source.

    docs: doc_id, source, text. targets: source, target_share, max_repeats (null: once). Other columns are ignored.
    Documents without text have no tokens and no copies. Documents of a null or unlisted source take no part. A repeated row
    counts once. A listed source without documents has no rows; a share of null or 0 takes none.
    """
    listed = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    docs = docs.select("doc_id", "source", "text").where("source is not null and doc_id is not null")
    counted = count_column(docs.join(listed, "source", "left_semi"), "text", "tokens").select("doc_id", "source", "tokens").distinct()
    counted = cut(counted)
    lengths = counted.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    total = lengths.agg(F.coalesce(F.sum(F.col("tokens") * F.col("n")), F.lit(0))).first()[0]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(part["tokens"].tolist(), part["n"].tolist()))
        share, cap = part["target_share"].iloc[0], int(part["max_repeats"].iloc[0])
        target, own = 0.0 if pd.isna(share) else float(share) * total, sum(n * c for n, c in counts.items())
        full = max(0, min(cap, int(target // own)))
        extra = fit_counts(counts, round(target - full * own)) if full < cap else {}
        return pd.DataFrame({"source": part["source"], "tokens": part["tokens"], "full": full, "extra": part["tokens"].map(lambda n: extra.get(n, 0))})

    chosen = lengths.join(listed, "source").groupBy("source").applyInPandas(fit, "source string, tokens long, full int, extra long")
    # Which documents of a length: the first in the order of a seeded hash; ranks are counted by stretches of the hash.
    drawn = counted.where("tokens > 0").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_one", F.lit(1))
    ranked = cumulative_versions(drawn, ["source", "tokens"], "_h", ["doc_id"], "_one", stretch=1 << 58)
    taken = ranked.join(chosen, ["source", "tokens"]).select("doc_id", "source", "tokens", (F.col("full") + (F.col("version") <= F.col("extra")).cast("int")).alias("copies"))
    return taken.unionByName(counted.where("tokens = 0").select("doc_id", "source", "tokens", F.lit(0).alias("copies")))


def report(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, max_repeats, documents, available and taken tokens, the target in tokens, share_of_total (of all
    listed tokens), actual_share (of the mix), most_copies and whether the target was reached to within a hundredth of a percent of the total."""
    own = plan.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").distinct().join(own, "source", "left").na.fill(0, ["documents", "available", "taken", "most_copies"])
    sums = rows.agg(F.sum("available").alias("_all"), F.sum("taken").alias("_mix"))
    joined = rows.join(F.broadcast(sums))  # one row
    return joined.select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "available",
        "taken",
        "most_copies",
        (F.col("target_share") * F.col("_all")).alias("target"),
        F.when(F.col("_all") > 0, F.col("taken") / F.col("_all")).alias("share_of_total"),
        F.when(F.col("_mix") > 0, F.col("taken") / F.col("_mix")).alias("actual_share"),
        (F.abs(F.col("taken") - F.col("target_share") * F.col("_all")) <= 0.0001 * F.col("_all")).alias("reached"),
    )
