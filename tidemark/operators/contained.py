"""Which names lie inside which others: an equi-join on the first characters, then a check, in place of a comparison of all with all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a name by which it is looked up, and of a long one; longer keys make smaller groups ("the tall clerk of Wick" shares four with every epithet).
KEY, LONG = 4, 12
_LENGTHS = (*range(2, KEY + 1), LONG)
#: Numbers of 64 bits in the filter of a scope's keys: a fixed size, whatever the names. It drops most parts of texts where a scope has up to a few thousand names, few where it has more.
WORDS = 128


def _keyed(names: DataFrame, name: str) -> DataFrame:
    """Names of two characters or more with the length of their key (LONG of long ones, at most KEY of others) and the hash of that beginning."""
    names = names.where(F.length(name) >= 2).withColumn("_n", F.when(F.length(name) >= LONG, LONG).otherwise(F.least(F.length(name), F.lit(KEY))))
    return names.withColumn("_key", F.xxhash64(F.substring(name, F.lit(1), F.col("_n"))))


def _parts(text: Column, n: int) -> Column:
    """Hashes of every part of a text of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.xxhash64(F.substring(text, i, F.lit(n)))))


def _filters(keyed: DataFrame, scope: str) -> DataFrame:
    """scope, _lengths, _bits: the lengths of the keys of each scope, and the filter in which the bit of every key is set."""
    bit = F.pmod("_key", F.lit(64 * WORDS))
    words = keyed.select(scope, "_n", F.shiftright(bit, 6).cast("int").alias("_word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("_bit")).groupBy(scope, "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_set"), F.collect_set("_n").alias("_ns"))
    sets = words.groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_sets"), F.array_distinct(F.flatten(F.collect_set("_ns"))).alias("_lengths"))
    return sets.select(scope, "_lengths", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.element_at("_sets", i), F.lit(0).cast("bigint"))).alias("_bits"))


def _found(texts: DataFrame, names: DataFrame, scope: str, text: str, name: str, source: Column, parts: Callable[[Column, int], Column], before: tuple[str, str] | None = None) -> DataFrame:
    """Texts with each name that they hold, looked up by its key. source: of a text; parts: hashes of the keys of one length in it, or null; before: see names_in_texts.

    Keys that no name of the scope has are dropped before they are shuffled; of the rest only hashes are; texts are joined to what was found, and compared there.
    The joins are sorted ones by hint: by the compressed size of what is exploded Spark would take it for small, and broadcast it. Names are read twice.
    """
    keyed = _keyed(names, name)
    own = (scope, "_h", *before[:1]) if before else (scope, "_h")
    marked = texts.where(F.length(text) >= 2).withColumn("_h", F.xxhash64(scope, text, *own[2:]))
    bit = lambda k: F.pmod(k, F.lit(64 * WORDS))
    known = lambda k: F.getbit(F.get("_bits", F.shiftright(bit(k), 6).cast("int")), bit(k).bitwiseAND(F.lit(63)).cast("int")) == 1
    of = lambda n: F.when(F.array_contains("_lengths", n), F.filter(parts(F.col("_source"), n), known))
    sources = marked.select(*own, text).join(_filters(keyed, scope).hint("merge"), scope).select(*own, "_lengths", "_bits", source.alias("_source"))
    keys = sources.select(*own, F.explode(F.array_distinct(F.concat(*(F.coalesce(of(n), F.array().cast("array<bigint>")) for n in _LENGTHS)))).alias("_key"))
    pairs = keys.join(keyed.drop("_n").hint("merge"), [scope, "_key"])
    found = (pairs.where(F.col(before[0]) < F.col(before[1])) if before else pairs).drop("_key", *own[2:]).repartition(scope, "_h").distinct()
    return marked.join(found.hint("merge"), [scope, "_h"]).drop("_h").where(F.col(text).contains(F.col(name)))


def names_in_texts(texts: DataFrame, names: DataFrame, scope: str, text: str, name: str, before: tuple[str, str] | None = None) -> DataFrame:
    """Rows of texts joined to the names of their scope (two characters or more) that occur in them. Null texts and names match nothing.

    A name is looked up by its first characters, a short one by itself, among the parts of the texts; so a pair is only compared where it begins alike. Columns of both sides must differ but for the scope.
    before: a column of texts and one of names; only pairs in which the first is less are sought.
    """
    found = _found(texts, names, scope, text, name, F.col(text), _parts, before)
    return found.where(F.col(before[0]) < F.col(before[1])) if before else found


def contained_names(left: DataFrame, right: DataFrame, scope: str = "book_id") -> DataFrame:
    """Pairs of left (name) and right (to_name) rows of a scope where one name is inside the other, or both are equal."""
    one = names_in_texts(left, right, scope, "name", "to_name")
    other = names_in_texts(right, left, scope, "to_name", "name")
    return one.unionByName(other).distinct()


def whole_words(texts: DataFrame, names: DataFrame, scope: str, text: str, name: str) -> DataFrame:
    """Rows of texts with each name of their scope that stands in them as a whole word (no basic Latin letter before or after): place (of the first, from 1) and times.

    Long texts are looked up by their word beginnings only, not by all their parts; names of Han characters by every ideograph. Names that begin with
    neither a letter nor a digit match nothing.
    """
    starts = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?<![A-Za-z])(?=([\p{{L}}\p{{N}}].{{0,{LONG - 1}}}))"), F.lit(1)))
    pattern = F.concat(F.lit(r"(?<![A-Za-z])\Q"), F.col(name), F.lit(r"\E(?![A-Za-z])"))
    hits = _found(texts, names, scope, text, name, starts, lambda words, n: F.transform(words, lambda s: F.xxhash64(F.substring(s, 1, n))))
    return hits.withColumn("place", F.regexp_instr(text, pattern)).where("place > 0").withColumn("times", F.regexp_count(text, pattern))
