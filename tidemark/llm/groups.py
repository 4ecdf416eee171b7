"""Consolidating pairwise matches into groups by low-diameter decomposition.

One level: every vertex draws an exponential shift; clusters start to grow at start times given by the shifts and
take one hop per time step, so a vertex joins the cluster that reaches it first; each cluster is
contracted to one super-vertex; the edges that still run between clusters go to the next level.  The
assignments of the levels are composed at the end.  Each level removes a constant share of the edges in
expectation, whatever the shape of the groups (a chain of a million links needs no million steps), and every
step is a join and an aggregation by vertex: no group is ever held in one task. The last links of all, FEW at
most whatever the input, are joined on the driver: a level of three small queries for a handful of links costs it more memory in plans. The joins are shuffled hash joins by hint, as
labels and clusters grow with the data and are never broadcast; each has one row per vertex, so no key of the hashed side is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.session import cut

#: Rate of the exponential shifts. Untruncated growth would cut about this share of a level's edges.
BETA = 0.1
#: Hops that clusters grow in one level, then they contract: with so low a rate a group of small diameter becomes one cluster at once, a long chain shrinks by about twice this. Stopping early makes clusters smaller, never wrong.
HOPS = 4
#: Links that are left to the driver; each level leaves about a tenth of its links, so this saves the last three.
FEW = 2000


def _start(vertex: str, level: int, beta: float) -> F.Column:
    """Start time of the vertex's own cluster: minus an exponential shift, drawn by hash, so that a lost task redraws the same."""
    u = (F.pmod(F.xxhash64(F.lit(level), F.col(vertex)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    return F.log(u) / F.lit(beta)


def _grow(edges: DataFrame, level: int, beta: float, hops: int) -> DataFrame:
    """v, c: the cluster (named by its centre) that reaches each vertex first. edges holds both directions, and each vertex's way to itself with a hop of 0."""
    label = edges.where("hop = 0").select(F.col("w"), F.struct(_start("w", level, beta).alias("at"), F.col("w").alias("c")).alias("first"))
    for _ in range(hops):
        reached = edges.join(label.hint("shuffle_hash"), "w").select("v", F.struct((F.col("first.at") + F.col("hop")).alias("at"), F.col("first.c").alias("c")).alias("first"))
        label = reached.groupBy("v").agg(F.min("first").alias("first")).withColumnRenamed("v", "w")
    return label.select(F.col("w").alias("v"), F.col("first.c").alias("c"))


def _both_ways(links: DataFrame) -> DataFrame:
    """v, w, hop of links v-w in both directions, with each vertex's way to itself."""
    ways = F.explode(F.array(*(F.struct(F.col(a).alias("v"), F.col(b).alias("w"), F.lit(hop).alias("hop")) for a, b, hop in (("v", "w", 1), ("w", "v", 1), ("v", "v", 0), ("w", "w", 0)))))
    return links.select(ways.alias("e")).select("e.*").distinct()


def _joined(links: list[Row], edges: DataFrame) -> DataFrame:
    """v, c: some vertex of its group, for each vertex of a few links."""
    lead: dict[str, str] = {}
    values = {str(x): x for link in links for x in link}

    def find(x: str) -> str:
        while (up := lead.get(x, x)) != x:
            lead[x] = lead.get(up, up)
            x = up
        return x

    for v, w in links:
        lead[find(str(v))] = find(str(w))
    kind = edges.schema["v"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(v, values[find(x)]) for x, v in values.items()], f"v {kind}, c {kind}")


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", beta: float = BETA, hops: int = HOPS, few: int = FEW) -> DataFrame:
    """member, group_id: every value of a pair, with the smallest value linked to it directly or indirectly (itself included).

    Values may be strings or numbers; order is that of Spark (strings: by code point). Pairs with a null, and pairs of a value with itself,
    link nothing and introduce no member. Direction and repetition of pairs are of no account. An empty table gives an
    empty table. Other columns are ignored.
    """
    links = pairs.select(F.col(a).alias("v"), F.col(b).alias("w")).where("v is not null and w is not null and v <> w")
    edges = cut(_both_ways(links))
    empty = edges.select(F.col("v").alias("member"), F.col("w").alias("group_id"))
    levels: list[DataFrame] = []
    while len(rest := edges.where("hop = 1 and v < w").select("v", "w").limit(few + 1).collect()) > few:
        cluster = cut(_grow(edges, len(levels), beta, hops))
        levels.append(cluster)
        here, there = cluster.select("v", F.col("c").alias("cv")), cluster.select(F.col("v").alias("w"), F.col("c").alias("cw"))
        between = edges.where("hop = 1 and v < w").join(here.hint("shuffle_hash"), "v").join(there.hint("shuffle_hash"), "w").where("cv <> cw")
        edges = cut(_both_ways(between.select(F.col("cv").alias("v"), F.col("cw").alias("w"))))
    if rest:
        levels.append(_joined(rest, edges))
    if not levels:
        return empty
    top = levels[-1]
    for lower in reversed(levels[:-1]):  # compose: a super-vertex without edges at the next level keeps its own name
        top = lower.join(top.select(F.col("v").alias("c"), F.col("c").alias("cc")).hint("shuffle_hash"), "c", "left").select("v", F.coalesce("cc", "c").alias("c"))
    least = top.groupBy("c").agg(F.min("v").alias("group_id"))
    return top.join(least.hint("shuffle_hash"), "c").select(F.col("v").alias("member"), "group_id")
