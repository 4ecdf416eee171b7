"""Visually identical text with different characters: one consistent form.

Characters are decomposed, invisible ones dropped, and width, blanks, hyphens, joined letters and radicals
unified. Then each token's script is resolved: every letter allows its own script and those in which the same glyph exists; the
sets are intersected across the token. One script left over all letters (first in ORDER where several
remain: a whole-script confusable) spells the whole token; where none is left the token is a true
mixture and each letter takes the first script that has its glyph. The choice depends on glyphs only, so
tokens that look alike get the same spelling. Accents, case, digits, marks of punctuation, raised figures
and simplified or traditional form stay as they are.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut, spread

# Letters that share a glyph with a Latin letter, script by script: the pairs of the public confusables data that no reader can tell apart.
LATIN_OF_CYRILLIC = ("АВСЕԌНІЈКМОРԚЅТѴԜХУаԁсеһіјӏорԛѕѵԝху", "ABCEGHIJKMOPQSTVWXYadcehijlopqsvwxy")
LATIN_OF_GREEK = ("ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖαϲιϳνορυ", "ABCEHIJKMNOPTXYZacijvopu")
LATIN_OF_ARMENIAN = ("ՍՏՕհոսզօ", "USOhnuqo")
LATIN_OF_CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ")
#: Preference where a token can be spelt in several scripts.
ORDER = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
HYPHENS = "‐‑˗᠆﹣－"
FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"
# Radicals of the supplement that have the glyph of an ideograph.
RADICALS = ("⻁⻄⻅⻆⻉⻋⻓⻔⻘⻚⻛⻜⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰⻳", "虎西见角贝车长门青页风飞马骨鬼鱼鸟麦黄齐齿龙龟")
APOSTROPHES = {"ʼ": "’", "＇": "'"}

_TABLES = {"Cyrillic": LATIN_OF_CYRILLIC, "Greek": LATIN_OF_GREEK, "Armenian": LATIN_OF_ARMENIAN, "Cherokee": LATIN_OF_CHEROKEE}


class _Unify(dict):
    """Replacement of every code point of decomposed text, worked out when first met."""

    def __missing__(self, point: int) -> str | None:
        self[point] = out = self._of(chr(point))
        return out

    @staticmethod
    def _of(ch: str) -> str | None:
        kind = unicodedata.category(ch)
        if ch.isspace() or kind in ("Zs", "Zl", "Zp"):
            return " "
        if kind in ("Cf", "Cc") or ch in FILLERS or "︀" <= ch <= "️" or "᠋" <= ch <= "᠏" or "\U000e0100" <= ch <= "\U000e01ef":
            return None
        if ch in HYPHENS:
            return "-"
        if ch in APOSTROPHES:
            return APOSTROPHES[ch]
        if ch in RADICALS[0]:
            return RADICALS[1][RADICALS[0].index(ch)]
        tag, *points = unicodedata.decomposition(ch).split() or [""]
        if tag in ("<wide>", "<narrow>") or (tag == "<compat>" and (kind[0] == "L" and len(points) > 1 or kind == "Nl" and len(points) == 1 or "⺀" <= ch <= "⿟")):
            return unicodedata.normalize("NFD", "".join(chr(int(p, 16)) for p in points))
        return ch


def _glyphs() -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """By letter: its glyph's letter in each script; and the script of the letters."""
    glyph: dict[str, dict[str, str]] = {}
    script: dict[str, str] = {}
    for name, (own, latin) in _TABLES.items():
        for a, b in zip(own, latin, strict=True):
            forms = glyph.setdefault(b, {"Latin": b})
            forms[name] = a
            glyph[a], script[a], script[b] = forms, name, "Latin"
    return glyph, script


def consistent_form():
    """The function from text to its form."""
    import regex

    unify, (glyph, script) = _Unify(), _glyphs()
    token = regex.compile(r"(?=\p{L}*[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}])?[\p{L}\p{M}]+")
    foreign = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]")
    scripts = [(name, regex.compile(rf"\p{{{name}}}")) for name in ORDER]
    known: dict[str, str] = {}

    def allowed(letter: str) -> set[str] | None:
        if letter in glyph:
            return set(glyph[letter])
        return next(({name} for name, is_in in scripts if is_in.match(letter)), None)

    def respell(match) -> str:
        word = match[0]
        if not foreign.search(word):
            return word
        if (found := known.get(word)) is None:
            sets = [s for s in map(allowed, word) if s]
            common = set.intersection(*sets) if sets else set()
            one = next((name for name in ORDER if name in common), None)
            found = "".join(forms.get(one) or next(forms[name] for name in ORDER if name in forms) if (forms := glyph.get(c)) else c for c in word)
            if len(known) > 100_000:
                known.clear()
            known[word] = found
        return found

    def form(text: str | None) -> str | None:
        if text is None or text.isascii() and text.isprintable():
            return text
        text = unicodedata.normalize("NFD", text).translate(unify)
        if foreign.search(text):
            text = token.sub(respell, text)
        return unicodedata.normalize("NFC", text)

    return form


_FORM = None


def _form():
    global _FORM
    _FORM = _FORM or consistent_form()
    return _FORM


def with_form(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """Adds the consistent form of a text column; null stays null and empty stays empty. Rows stay as they are."""

    @F.pandas_udf(T.StringType())
    def forms(texts: pd.Series) -> pd.Series:
        return texts.map(_form(), na_action="ignore")

    # Plain ASCII is its own form and needs no Python.
    plain = F.col(text).isNull() | F.col(text).rlike(r"^[ -~]*$")
    return spread(df).withColumn(out, F.when(plain, F.col(text)).otherwise(forms(F.when(~plain, F.col(text)))))


def _hash(column: str) -> F.Column:
    """128 bits of a string; equal hashes count as equal strings."""
    return F.struct(F.xxhash64(column).alias("h"), F.xxhash64(F.lit("second"), column).alias("g"))


def look_alikes(passages: DataFrame) -> DataFrame:
    """rec_a < rec_b: records of one book and type whose texts differ but have the same form.

    passages: rec_id, book_id, t, text. Null texts and null books give no pair; equal strings give none; a record delivered
    twice counts once. All texts of a record are used should it have several. Texts are compared by 128-bit hashes, so only
    hashes are shuffled, and only groups with two or more spellings are joined.
    """
    group = ["book_id", "t", "f"]
    hashed = with_form(passages.select("rec_id", "book_id", "t", "text").where("text is not null and book_id is not null"))
    # Written once, as three steps read it.
    hashed = cut(hashed.select("rec_id", "book_id", "t", _hash("form").alias("f"), _hash("text").alias("s")).distinct())
    # Distinct spellings are paired first, so that records of one spelling never meet each other.
    spellings = hashed.select(*group, "s").distinct()
    mixed = spellings.groupBy(*group).agg(F.min("s").alias("_a"), F.max("s").alias("_b")).where("_a <> _b").select(*group)
    some = cut(hashed.join(mixed, group))
    several = some.select(*group, "s").distinct()
    pairs = several.withColumnRenamed("s", "_sa").join(several.withColumnRenamed("s", "_sb"), group).where("_sa < _sb")
    left, right = (some.select(*group, F.col("rec_id").alias(f"_r{x}"), F.col("s").alias(f"_s{x}")) for x in "ab")
    both = pairs.join(left, [*group, "_sa"]).join(right, [*group, "_sb"]).where("_ra <> _rb")
    return both.select(F.least("_ra", "_rb").alias("rec_a"), F.greatest("_ra", "_rb").alias("rec_b")).distinct()
