"""SQL of the name functions, for the queries that are checked by SQL."""

from __future__ import annotations

from tidemark.functions import names as N


def words(words: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words.split())


def latin(n: str) -> str:
    return rf"(regexp_matches({n}, '[A-Za-z]') and not regexp_matches({n}, '[\x{{3400}}-\x{{9fff}}]'))"


def generic(n: str) -> str:
    bare = f"regexp_replace(rtrim(lower(trim({n})), '.'), '{N.LEADING_PATTERN}', '')"
    western = f"({bare} in ({words(N.GENERIC_LATIN)}, {words(N.PRONOUNS)}) or rtrim({bare}, 's') in ({words(N.GENERIC_LATIN)}))"
    return f"(case when {latin(n)} then {western} else trim({n}) in ({words(N.GENERIC_HAN)}) or regexp_replace(trim({n}), '^[他她的老小]+', '') in ({words(N.GENERIC_HAN)}) end)"


def core(n: str) -> str:
    bare = f"(case when {latin(n)} then regexp_replace({n}, '{N.TITLE_PATTERN}', '') else regexp_replace({n}, '{N.SUFFIX_PATTERN}', '') end)"
    return f"(case when length({bare}) >= 2 and {bare} <> {n} then {bare} else '' end)"


def short(n: str) -> str:
    bare = f"(case when {core(n)} <> '' then {core(n)} else {n} end)"
    parts = rf"list_filter(regexp_split_to_array({bare}, '\s+'), lambda w: length(w) >= 3 and lower(w) not in ({words(N.EMPTY_WORDS)}))"
    han = f"case when regexp_matches({n}, '{N.SUFFIX_PATTERN}') then [] when contains({n}, '·') then list_filter(string_split({n}, '·'), lambda w: length(w) >= 2) when length({n}) between 3 and 4 then [substr({n}, 2)] else [] end"
    return f"list_distinct(case when {latin(n)} then case when len({parts}) > 1 then {parts} else [] end else {han} end)"
