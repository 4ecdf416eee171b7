"""Literal rules in one pass from left to right: the earlier rule wins at a place, and what was put in is not matched again."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_RULES = 64


def purified(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after the rules (from, to); null stays null; empty ``from`` and more than 64 rules are refused."""
    if len(rules) > MOST_RULES or any(not a for a, _ in rules):
        raise ValueError("at most 64 rules, none empty")
    if not rules:
        return text
    first: dict[str, str] = {}
    for a, b in rules:
        first.setdefault(a, b)
    pattern = re.compile("|".join(map(re.escape, first)))

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pattern.sub(lambda m: first[m[0]], t), na_action="ignore")

    return apply(text)
