"""Greedy packing of a book's blocks: a running size that starts afresh, which no window expresses.

Each chapter is packed on its own, so a task holds one chapter's block numbers and lengths, never texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import u16_length


def pack(sizes: list[int], most: int) -> list[int]:
    """Number of the segment of each block: a new one starts where the next block would exceed ``most``."""
    out, current, size = [], 0, 0
    for i, n in enumerate(sizes):
        if i and size and size + n > most:
            current, size = current + 1, 0
        out.append(current)
        size += n
    return out


def sections(sizes: list[int], target: int) -> list[int]:
    """Number of the section of each block: a section ends with the block that reaches ``target``."""
    out, current, size = [], 0, 0
    for n in sizes:
        out.append(current)
        size += n + 1
        if size >= target:
            current, size = current + 1, 0
    return out


def pack_blocks(blocks: DataFrame, most: DataFrame) -> DataFrame:
    """book_id, chapter_no, part, first_block, last_block, o0, o1, units: text blocks packed into parts of at most the book's ``most`` units.

    blocks: book_id, chapter_no, block_no, k, o, t; images and empty blocks belong to no part; a block above ``most`` is a part of its own.
    """
    sized = blocks.where("k <> 'img' and t is not null and t <> ''").select("book_id", "chapter_no", "block_no", "o", u16_length(F.col("t")).alias("n")).join(most, "book_id")

    def of_chapter(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block_no")
        part["part"] = pack(part["n"].tolist(), int(part["most"].iloc[0]))
        part["end"] = part["o"] + part["n"]
        out = part.groupby("part").agg(first_block=("block_no", "first"), last_block=("block_no", "last"), o0=("o", "first"), o1=("end", "last"), units=("n", "sum")).reset_index()
        return out.assign(book_id=part["book_id"].iloc[0], chapter_no=part["chapter_no"].iloc[0])[["book_id", "chapter_no", "part", "first_block", "last_block", "o0", "o1", "units"]]

    return sized.groupBy("book_id", "chapter_no").applyInPandas(of_chapter, "book_id string, chapter_no int, part long, first_block long, last_block long, o0 long, o1 long, units long")


def split_chapters(blocks: DataFrame, target: int, limit: int) -> DataFrame:
    """book_id, chapter_no, section, o0, o1: chapters longer than ``limit`` in sections that end with the block that reaches ``target``; others whole."""
    sized = blocks.select("book_id", "chapter_no", "block_no", "o", u16_length(F.coalesce("t", F.lit(""))).alias("n"))

    def of_chapter(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block_no")
        ends = part["o"] + part["n"]
        long = ends.iloc[-1] - part["o"].iloc[0] > limit
        part["section"] = sections(part["n"].tolist(), target) if long else 0
        out = part.assign(end=ends).groupby("section").agg(o0=("o", "first"), o1=("end", "last")).reset_index()
        return out.assign(book_id=part["book_id"].iloc[0], chapter_no=part["chapter_no"].iloc[0])[["book_id", "chapter_no", "section", "o0", "o1"]]

    return sized.groupBy("book_id", "chapter_no").applyInPandas(of_chapter, "book_id string, chapter_no int, section long, o0 long, o1 long")
