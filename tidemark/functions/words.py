"""More text functions as column expressions: full-width marks, chapter numbers, bylines, strict UTF-16 slices, canonical JSON, loose JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and their full-width forms; what counts as Chinese next to them; digits.
MARKS = ",;:?!()", "，；：？！（）"
CHINESE = r"[\x{3400}-\x{9fff}\x{ff00}-\x{ffef}\x{3000}-\x{303f}“”‘’]"
HAN_DIGITS = "零一二三四五六七八九"
HAN_NUMBER = "^(?:(.)千)?零?(?:(.)百)?零?(?:(.)?(十))?零?(.)?$"
ORDINAL = r"(?i)^\s*(?:第\s*([0-9]+|[零一二三四五六七八九十百千]+)\s*[部章回卷节篇集]|(?:chapter|part|book|volume|chapitre|partie)\s+([0-9]+|[ivxlcdm]+)|([0-9]{1,3})[.、])"
OPENER = r"(?i)^\s*(?:楔子|序章|序幕|序言|引子|前言|自序|开篇|prologue|preface|foreword)"
ROMAN = {"m": 1000, "cm": 900, "d": 500, "cd": 400, "c": 100, "xc": 90, "l": 50, "xl": 40, "x": 10, "ix": 9, "v": 5, "iv": 4, "i": 1}
BYLINE = r"^(.*?)\s*[-_—\s]*作者\s*[:：]\s*(.*?)\s*$"
SITE = r"(?i)^[\w.-]+\.(?:com|net|org|cn|cc)$"
AUTHOR_LINE = r"^(?:作者|著者|作\s*者)\s*[:：]\s*(\S.{0,19})$"
RUN_LABEL = r"[（(].*?[)）]|\s*作者[:：].*$|\s+[-—]\s+[^-—]*$"


def full_width(text: Column) -> Column:
    """Marks next to Chinese characters in full width, short quotations in curved quotes; null stays null.

    Replaced marks are first kept as private characters, so that a mark never counts as the Chinese neighbour of the next.
    """
    out = F.regexp_replace(text, r'"([^"\n]{1,60})"', "“$1”")
    for i, mark in enumerate(MARKS[0]):
        held = chr(0xE000 + i)
        out = F.regexp_replace(out, rf"(?<={CHINESE})\s*\{mark}\s*", held)
        out = F.regexp_replace(out, rf"\s*\{mark}\s*(?={CHINESE})", held)
    return F.translate(out, "".join(chr(0xE000 + i) for i in range(len(MARKS[0]))), MARKS[1])


def han_number(digits: Column) -> Column:
    """A number below 10,000 in Chinese digits; 0 for what is none."""
    of = lambda g: F.greatest(F.instr(F.lit(HAN_DIGITS), F.regexp_extract(digits, HAN_NUMBER, g)) - 1, F.lit(0))
    some = lambda g: F.regexp_extract(digits, HAN_NUMBER, g) != ""
    tens = F.when(some(4), F.when(some(3), of(3)).otherwise(1)).otherwise(0)
    return F.when(some(1), of(1)).otherwise(0) * 1000 + F.when(some(2), of(2)).otherwise(0) * 100 + tens * 10 + F.when(some(5), of(5)).otherwise(0)


def roman_number(text: Column) -> Column:
    """Value of a Roman numeral in lower case, by taking off its signs from the greatest to the smallest."""
    counts = [F.regexp_count(text, F.lit(sign)) * value for sign, value in ROMAN.items() if len(sign) == 1]
    pairs = [F.regexp_count(text, F.lit(sign)) * (value - sum(ROMAN[c] for c in sign)) for sign, value in ROMAN.items() if len(sign) == 2]
    return reduce(lambda a, b: a + b, counts + pairs)


def ordinal(title: Column) -> Column:
    """The chapter number that a title carries: 第N章, Chapter N, in digits, Chinese or Roman numerals, or a leading number; else null."""
    first, second, third = (F.regexp_extract(title, ORDINAL, g) for g in (1, 2, 3))
    raw = F.when(first != "", first).when(second != "", second).otherwise(third)
    value = F.when(raw.rlike("^[0-9]+$"), raw.cast("long")).when(raw.rlike("(?i)^[ivxlcdm]+$"), roman_number(F.lower(raw)).cast("long")).when(raw != "", F.nullif(han_number(raw).cast("long"), F.lit(0).cast("long")))
    return F.when(title.rlike(ORDINAL), value)


def is_opener(title: Column) -> Column:
    return F.coalesce(title.rlike(OPENER), F.lit(False))


def display_title(title: Column, author: Column) -> tuple[Column, Column]:
    """Title and author for display: a byline in the title is split off and, unless it is a site's name, gives the author where there is none."""
    plain, own = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(author, F.lit("")))
    named, found = F.regexp_extract(plain, BYLINE, 1), F.regexp_extract(plain, BYLINE, 2)
    split = plain.rlike(BYLINE) & (named != "")
    return F.when(split, named).otherwise(plain), F.when(split & (own == "") & ~found.rlike(SITE), found).otherwise(own)


def work_of(title: Column) -> Column:
    """Which work a title means, without labels of runs."""
    bare = F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), RUN_LABEL, "")))
    return F.when(bare != "", bare).otherwise(F.lower(F.trim(F.coalesce(title, F.lit("")))))


def text_author(text: Column, heading: str) -> Column:
    """The author of a Chinese text: a line 作者：X among the first six, or a short name below a first line that looks like a title; else empty."""
    head = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda t: F.trim(F.regexp_replace(t, "\r", ""))), lambda t: t != ""), 1, 6)
    named = F.filter(head, lambda t: t.rlike(AUTHOR_LINE))
    titled = (F.size(head) > 2) & (F.length(F.get(head, F.lit(0))) <= 20) & ~F.lower(F.get(head, F.lit(0))).rlike(heading) & ~F.get(head, F.lit(0)).rlike("[。，！？；：、,.!?;:]")
    second = F.get(head, F.lit(1))
    return F.when(F.size(named) > 0, F.trim(F.regexp_extract(F.get(named, F.lit(0)), AUTHOR_LINE, 1))).when(titled & second.rlike(r"^[\x{4e00}-\x{9fff}·]{2,6}$") & ~F.lower(second).rlike(heading), second).otherwise(F.lit(""))


def splits_pair(encoded: Column, unit: Column) -> Column:
    """Whether a position, in units of a text in UTF-16LE, lies inside a surrogate pair: the unit before it is a high surrogate."""
    before = F.conv(F.hex(F.substring(encoded, (2 * unit).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (unit > 0) & F.coalesce(before.between(0xD8, 0xDB), F.lit(False))


def strict_slice(text: Column, start: Column, end: Column) -> Column:
    """The part [start, end) in UTF-16 units; null where a bound lies outside the text or inside a surrogate pair."""
    encoded = F.encode(text, "UTF-16LE")
    fits = (start >= 0) & (start <= end) & (2 * end <= F.octet_length(encoded)) & ~splits_pair(encoded, start) & ~splits_pair(encoded, end)
    return F.when(fits, F.decode(F.substring(encoded, (2 * start + 1).cast("int"), (2 * (end - start)).cast("int")), "UTF-16LE"))


def prefix_units(text: Column, units: Column) -> Column:
    """The first units of a text in UTF-16, one fewer where a surrogate pair would be split; the whole text where it is shorter."""
    encoded = F.encode(text, "UTF-16LE")
    wanted = F.greatest(units, F.lit(0))
    kept = wanted - F.when(splits_pair(encoded, wanted), 1).otherwise(0)
    return F.decode(F.substring(encoded, F.lit(1), (2 * kept).cast("int")), "UTF-16LE")


def loose_json(text: Column) -> Column:
    """The outermost JSON object in a text, without commas before closing brackets; null where there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.regexp_replace(found, r",\s*([}\]])", "$1"))


def canonical_digest(**columns: Column) -> Column:
    """SHA-256 of the compact JSON object of the columns, keys in order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns)))), 256)
