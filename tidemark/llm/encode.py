"""Encoding text with a public byte-level BPE.

Per word a contiguous rank array: the part boundaries of the word and, beside them, the rank of each
adjacent pair.  The least rank is found by scanning, its boundary deleted, the two neighbouring ranks
refreshed, until no pair has a rank.  For the short words that the split pattern yields, scanning a small
contiguous array beats any heap; a word of more than LONG bytes (a run of one letter, say) takes a heap over
linked parts, which merges in the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import spread

#: Bytes from which a word is merged with a heap.
LONG = 512
#: Words whose tokens a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 200_000

_NONE = 1 << 60


def default_vocabulary() -> str:
    """Place of the ranks file of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of a word, by scanning the array of adjacent ranks."""
    bounds = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            near[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of a word, the same as merge_short's, in n log n steps."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, end = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue  # one of the two parts has changed since
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(queue, (r, i, after[end]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:end])) is not None:
            heapq.heappush(queue, (r, k, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


def encoder(vocabulary: str, pattern: str) -> Callable[[str | None], list[int]]:
    """A function from text to ids; null and empty text give an empty list."""
    import regex

    ranks, split, known = read_ranks(vocabulary), regex.compile(pattern), {}

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for word in split.findall(text):
            found = known.get(word)
            if found is None:
                raw = word.encode("utf-8", "surrogatepass")
                if raw in ranks:
                    found = [ranks[raw]]
                else:
                    found = merge_short(raw, ranks) if len(raw) <= LONG else merge_long(raw, ranks)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(raw) <= LONG:
                    known[word] = found
            ids += found
        return ids

    return encode


_ENCODERS: dict[tuple[str, str], Callable[[str | None], list[int]]] = {}


def worker_encoder(vocabulary: str, pattern: str) -> Callable[[str | None], list[int]]:
    """The worker's encoder for a vocabulary, read once per process."""
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = encoder(vocabulary, pattern)
    return _ENCODERS[vocabulary, pattern]


def encode_column(df: DataFrame, text: str, out: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the ids of a text column, without special tokens: their strings are ordinary text.

    Null and empty text give an empty list (never null). Rows, repeated ones too, stay as they are. ``vocabulary`` is the path of a
    ranks file that every executor can read.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(worker_encoder(vocabulary, pattern))

    return spread(df).withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def count_column(df: DataFrame, text: str, out: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the number of ids of a text column; 0 for null and empty text."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    @F.pandas_udf(T.LongType())
    def length(texts: pd.Series) -> pd.Series:
        encode = worker_encoder(vocabulary, pattern)
        return texts.map(lambda text: len(encode(text))).astype("int64")

    return spread(df).withColumn(out, length(F.coalesce(F.col(text), F.lit(""))))
