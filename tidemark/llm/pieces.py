"""Splitting oversized segments at natural boundaries, with overlap, by pointer doubling.

Every boundary of a segment (end of a block, end of a sentence) has one successor: the end of the
piece that starts after it, OVERLAP units back. It is the farthest block end within the limit, else the farthest sentence
end, else (in a stretch of text without either) the farthest end of a word, else the limit itself. The greedy cuts are the
boundaries reached from the segment's start; they are found by squaring the successor table, log2(pieces) rounds for all
segments at once, however long. All lookups are by (book, stretch of positions), so one huge segment or book is spread over
many tasks.

Positions are UTF-16 units; blocks are joined by one line feed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut


@dataclass(frozen=True)
class Limits:
    """Limits in UTF-16 units."""

    chinese: int = 3200
    others: int = 9000
    overlap: int = 200
    stretch: int = 1 << 14  #: positions looked up together; at least the larger limit


LIMITS = Limits()
BLOCK, SENTENCE, GRID = 2, 1, -1


class _Cutter:
    """Boundaries of a block's text, in UTF-16 units from its start; made in the worker."""

    def __init__(self) -> None:
        import regex

        self.sentence = regex.compile(r"[.!?。！？…]+[\"”»’)\]」』）]*(?=\s|\p{Han}|[“「『«—]|$)")
        self.word = regex.compile(r"(?:(?!\p{Han})[\p{L}\p{M}\p{N}_])+(?:[’'](?:(?!\p{Han})[\p{L}\p{M}\p{N}_])+)*")

    @staticmethod
    def units(text: str) -> list[int] | range:
        """UTF-16 offset of every code point, and of the end."""
        if not text or max(text) <= "￿":
            return range(len(text) + 1)
        out, at = [0], 0
        for ch in text:
            at += 1 + (ch > "￿")
            out.append(at)
        return out

    def sentence_ends(self, text: str) -> list[int]:
        units = self.units(text)
        return [units[m.end()] for m in self.sentence.finditer(text)]

    def inside_words(self, text: str) -> list[tuple[int, int]]:
        """Spans of the words and of the surrogate pairs: a position strictly inside one is no place to start or end."""
        units = self.units(text)
        spans = [(units[m.start()], units[m.end()]) for m in self.word.finditer(text) if m.end() - m.start() > 1]
        if not isinstance(units, range):
            spans += [(units[i], units[i + 1]) for i in range(len(text)) if units[i + 1] - units[i] == 2]
        return sorted(spans)

    @staticmethod
    def forward(spans: list[tuple[int, int]], at: int) -> int:
        """The position, or the end of the word that it is inside of."""
        import bisect

        i = bisect.bisect_left(spans, (at,)) - 1
        while i >= 0 and spans[i][1] <= at and at - spans[i][0] < 4:
            i -= 1
        return spans[i][1] if i >= 0 and spans[i][0] < at < spans[i][1] else at

    def chain(self, text: str, start: int, end: int, goal: int, limit: int, overlap: int) -> list[tuple[int, int]]:
        """(end, next start) of the pieces that must end between two boundaries further apart than a piece: at the farthest end of a word, else at the limit.

        start: where the first piece starts; end: the boundary before; goal: the boundary after. Positions are relative to the text and may be negative.
        """
        spans, words = self.inside_words(text), None
        out: list[tuple[int, int]] = []
        while goal > start + limit:
            most = start + limit
            best = next((a for a, b in reversed(spans) if a < most < b), most)  # not inside a word
            if best <= max(end, start + overlap) or best > most:
                best, words = most, None  # a word longer than a piece
                if any(b - a == 2 and a < most < b for a, b in ((most - 1, most + 1),)) and self._splits_pair(text, most):
                    best = most - 1
            nxt = best - overlap
            moved = self.forward(spans, nxt)
            if moved > best or moved == best and any(a < best < b for a, b in spans):
                moved = nxt + self._splits_pair(text, nxt)
            out.append((best, moved))
            start, end = moved, best
        return out

    def _splits_pair(self, text: str, at: int) -> bool:
        units = self.units(text)
        return not isinstance(units, range) and 0 < at < units[-1] and at not in set(units)


def _over_limit(segs: DataFrame, limits: Limits) -> DataFrame:
    """book_id, seg, o0, o1, lim of the segments above their limit; of repeated records with different spans the smallest (o0, o1) counts."""
    one = segs.where("o0 is not null and o1 is not null").groupBy("book_id", "seg").agg(F.min(F.struct("o0", "o1", "lang")).alias("_s")).select("book_id", "seg", "_s.*")
    return one.withColumn("lim", F.when(F.col("lang") == "zh", limits.chinese).otherwise(limits.others).cast("long")).where("o1 - o0 > lim").drop("lang")


def _stretches(a: F.Column, b: F.Column, width: int) -> F.Column:
    return F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))


def _boundaries(own: DataFrame, overlap: int) -> DataFrame:
    """Rows of kind BLOCK and SENTENCE with their position; and of kind 0: stretches (pos, goal) without a boundary that a piece may not span."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = _Cutter()
        for batch in batches:
            rows = []
            for book, seg, o0, o1, lim, no, o, size, text in batch.itertuples(index=False):
                before = o - 1 if o > o0 else o0
                ends = {o + e for e in cutter.sentence_ends(text) if o0 < o + e < min(o + size, o1)}
                last = min(o + size, o1)
                for pos in [*sorted(ends), last]:
                    if pos - before > lim - overlap:
                        rows.append((book, seg, o0, o1, lim, no, before, 0, pos))
                    if pos > o0:
                        rows.append((book, seg, o0, o1, lim, no, pos, BLOCK if pos == last else SENTENCE, None))
                        before = pos
            yield pd.DataFrame(rows, columns=["book_id", "seg", "o0", "o1", "lim", "block_no", "pos", "kind", "goal"]).astype({"kind": "int32", "goal": "Int64"})

    columns = own.select("book_id", "seg", "o0", "o1", "lim", "block_no", "o", "size", "t")
    return columns.mapInPandas(find, "book_id string, seg long, o0 long, o1 long, lim long, block_no long, pos long, kind int, goal long")


def _starts(ends: DataFrame, texts: DataFrame, limits: Limits) -> DataFrame:
    """book_id, seg, pos, start: where the piece after a boundary starts, OVERLAP back but not inside a word or a surrogate pair."""
    asked = ends.select("book_id", "seg", "o0", "pos").withColumn("q", F.greatest(F.col("pos") - limits.overlap, F.col("o0")))
    extent = texts.select("book_id", "block_no", "o", "size").distinct().select("book_id", "block_no", "o", "size", _stretches(F.col("o"), F.col("o") + F.col("size"), limits.stretch).alias("b"))
    at = asked.select("book_id", "q").distinct().withColumn("b", F.floor(F.col("q") / limits.stretch))
    placed = at.join(extent, ["book_id", "b"]).where("o < q and q < o + size").groupBy("book_id", "block_no").agg(F.collect_set("q").alias("qs"))

    @F.pandas_udf(T.MapType(T.LongType(), T.LongType()))
    def forward(text: pd.Series, o: pd.Series, qs: pd.Series) -> pd.Series:
        cutter, out = _Cutter(), []
        for t, begin, own in zip(text, o, qs):
            spans = cutter.inside_words(t)
            moved = {int(q): begin + cutter.forward(spans, int(q) - begin) for q in own}
            out.append({q: int(m) for q, m in moved.items() if m != q})
        return pd.Series(out)

    moves = placed.join(texts, ["book_id", "block_no"]).select("book_id", F.explode(forward("t", "o", "qs")).alias("q", "moved")).distinct()
    return asked.join(moves, ["book_id", "q"], "left").select("book_id", "seg", "pos", F.least(F.coalesce("moved", "q"), "pos").alias("start"))


def _chains(gaps: DataFrame, starts: DataFrame, texts: DataFrame, overlap: int) -> DataFrame:
    """book_id, seg, pos, start, next: the pieces inside stretches without a boundary. The row of the boundary before has a null start."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = _Cutter()
        for batch in batches:
            rows = []
            for book, seg, lim, pos, goal, start, o, text in batch.itertuples(index=False):
                before: tuple[int, int | None] = (pos, None)
                for end, nxt in cutter.chain(text, start - o, pos - o, goal - o, lim, overlap):
                    rows.append((book, seg, *before, end + o))
                    before = (end + o, nxt + o)
                if before[1] is not None:
                    rows.append((book, seg, *before, None))
            yield pd.DataFrame(rows, columns=["book_id", "seg", "pos", "start", "next"]).astype({"pos": "int64", "start": "Int64", "next": "Int64"})

    rows = gaps.join(starts, ["book_id", "seg", "pos"]).join(texts.select("book_id", "seg", "block_no", "o", "t"), ["book_id", "seg", "block_no"]).select("book_id", "seg", "lim", "pos", "goal", "start", "o", "t")
    return rows.mapInPandas(walk, "book_id string, seg long, pos long, start long, next long")


def split_segments(segs: DataFrame, blocks: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """book_id, seg, piece, o0, o1: the pieces of every segment above its limit, numbered from 0.

    segs: book_id, seg, o0, o1, lang (null: the limit of the others). blocks: book_id, block_no, o, t (null: empty). Other columns are ignored.
    Pieces cover the segment, keep the limit and share ``overlap`` units with the piece before; fewer only where a piece would start
    inside a word or a surrogate pair. Segments within their limit, or with a null bound, have no pieces. Repeated records
    count once. Where blocks are missing, cuts fall on a grid of half the limit. An empty table gives an empty table.
    """
    over = cut(_over_limit(segs, limits))
    texts = blocks.select("book_id", F.col("block_no").cast("long").alias("block_no"), "o", F.coalesce("t", F.lit("")).alias("t")).where("book_id is not null and o is not null")
    texts = texts.withColumn("size", F.expr("cast(octet_length(encode(t, 'UTF-16LE')) / 2 as bigint)"))
    keys = ["book_id", "seg"]
    spans = over.withColumn("b", _stretches(F.col("o0"), F.col("o1"), limits.stretch))
    # Which blocks belong to which segment is found by their extents; texts move once, and only those of oversized segments are kept.
    extents = texts.select("book_id", "block_no", "o", "size").withColumn("b", _stretches(F.col("o"), F.col("o") + F.col("size"), limits.stretch))
    hits = extents.join(spans, ["book_id", "b"]).where("o < o1 and o + size >= o0 and (o >= o0 or o + size > o0)").drop("b", "size").distinct()
    own = cut(hits.join(texts, ["book_id", "block_no", "o"]))
    found = cut(_boundaries(own, limits.overlap))
    ends = found.where("kind > 0").select(*keys, "o0", "o1", "lim", "pos", "kind").distinct()
    covered = own.groupBy(*keys).agg(F.sum(F.least(F.col("o") + F.col("size"), F.col("o1")) - F.greatest("o", "o0") + 1).alias("_n"))
    bare = over.join(covered, keys, "left").where("coalesce(_n, 0) < o1 - o0")
    half = (F.col("lim") / 2).cast("long")
    grid = bare.select(*keys, "o0", "o1", "lim", F.explode(F.sequence(F.col("o0") + half, F.col("o1"), half)).alias("pos"), F.lit(GRID).alias("kind"))
    last = over.select(*keys, "o0", "o1", "lim", F.col("o1").alias("pos"), F.lit(BLOCK).alias("kind"))
    ends = ends.unionByName(grid).unionByName(last).groupBy(*keys, "o0", "o1", "lim", "pos").agg(F.max("kind").alias("kind"))
    first = over.select(*keys, F.col("o0").alias("pos"), F.col("o0").alias("start"))
    starts = cut(_starts(ends, own, limits).unionByName(first))
    chains = cut(_chains(found.where("kind = 0").select(*keys, "lim", "block_no", "pos", "goal"), starts, own, limits.overlap))
    starts = starts.unionByName(chains.where("start is not null").select(*keys, "pos", "start"))
    # Successor: the farthest boundary of the best kind in (pos, start + limit]. Boundaries are also shown to the next stretch, so no lookup crosses one.
    bounds = over.select(*keys, "o1", "lim")
    probes = starts.join(bounds, keys).where("pos < o1").withColumn("at", F.least(F.col("start") + F.col("lim"), "o1"))
    shown = ends.select(*keys, F.col("pos").alias("at"), "kind", F.lit(None).cast("long").alias("pos"), F.explode(F.array(F.floor(F.col("pos") / limits.stretch), F.floor(F.col("pos") / limits.stretch) + 1)).alias("b"))
    seen = shown.unionByName(probes.select(*keys, "at", F.lit(9).alias("kind"), "pos", F.floor(F.col("at") / limits.stretch).alias("b")))
    window = Window.partitionBy(*keys, "b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    farthest = {k: F.last(F.when(F.col("kind") == k, F.col("at")), ignorenulls=True).over(window) for k in (BLOCK, SENTENCE, GRID)}
    seen = seen.withColumns({f"_k{i}": c for i, c in enumerate(farthest.values())}).where("kind = 9")
    beyond = [F.when(F.col(f"_k{i}") > F.col("pos"), F.col(f"_k{i}")) for i in range(3)]
    steps = seen.select(*keys, "pos", F.coalesce(*beyond[:2]).alias("_near"), beyond[2].alias("_grid"))
    steps = steps.join(chains.where("next is not null").select(*keys, "pos", "next"), [*keys, "pos"], "left")
    jump = cut(steps.select(*keys, "pos", F.coalesce("_near", "next", "_grid").alias("to")).where("to is not null").distinct())
    successors = jump
    reached = over.select(*keys, F.col("o0").alias("pos"))
    longest = over.agg(F.max((F.col("o1") - F.col("o0")) / F.greatest(F.col("lim") - 2 * limits.overlap, F.lit(1)))).first()[0]
    rounds = math.ceil(math.log2(2 * longest + 4)) if longest else 0
    for left in reversed(range(rounds)):
        reached = cut(reached.unionByName(reached.join(jump, [*keys, "pos"]).select(*keys, F.col("to").alias("pos"))).distinct())
        if not left:
            break
        ahead = jump.select(*keys, F.col("pos").alias("to"), F.col("to").alias("further"))
        jump = cut(jump.join(ahead, [*keys, "to"]).select(*keys, "pos", F.col("further").alias("to")))
    pieces = reached.join(successors, [*keys, "pos"]).join(starts.distinct(), [*keys, "pos"]).select(*keys, F.col("start").alias("o0"), F.col("to").alias("o1"))
    order = Window.partitionBy(*keys).orderBy("o1")
    return pieces.select(*keys, (F.row_number().over(order) - 1).cast("long").alias("piece"), "o0", "o1")
