"""Groups and names."""

import random

import pytest

from tidemark.llm.groups import connected_groups
from tidemark.llm.names import Parser, pairs_of_groups, resolve

PAIRS = "a string, b string, member string, extra int"
SPELLINGS = "scope string, entity string, spelling string, introduces boolean, formal string"
NICKS = "formal string, nickname string, spelling string"


def brute(pairs):
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            lead[y] = x
    return {(v, find(v)) for v in list(lead)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "odd"])
def test_groups_against_union_find(spark, shape):
    rnd = random.Random(5)
    name = lambda i: f"P{i:04d}"
    pairs = {
        "chain": [(name(i + 1), name(i)) for i in range(200)],
        "star": [(name(0), name(i)) for i in range(1, 150)],
        "random": [(name(rnd.randrange(300)), name(rnd.randrange(300))) for _ in range(200)],
        "odd": [("x", None), (None, "y"), ("z", "z"), ("b", "a"), ("a", "b"), ("b", "a")],
    }[shape]
    got = connected_groups(spark.createDataFrame([(*p, "clash", 1) for p in pairs], PAIRS)).collect()
    assert len(got) == len({r.member for r in got})
    assert set(map(tuple, got)) == brute(pairs)


def test_groups_of_nothing(spark):
    assert connected_groups(spark.createDataFrame([], PAIRS)).count() == 0


def test_parsing():
    p = Parser({"飞": "fei", "飛": "fei", "凤": "feng", "第": "di", "五": "wu"})
    assert p.parse("Winerothorp, Zénobie D.") == ("given", "zenobie", "winerothorp", "")
    assert p.parse("Dr. Zénobie Winerothorp") == ("full", "zenobie", "winerothorp", "")
    assert p.parse("ZénobieWinerothorp") == ("full", "zenobie", "winerothorp", "")
    assert p.parse("É. Fendavenik") == ("initial", "e", "fendavenik", "")
    assert p.parse("Kenelm Cheinirdan the Elder")[3] == "e"
    assert p.parse("第五飛凤先生") == p.parse("第五·飞凤") == ("exact", "feifeng", "diwu", "")
    assert p.parse("Feifeng Diwu")[0] == "exact"
    assert p.parse("Zoo Svgs Bank Ltd") == p.parse("The Zoo Savings Bank")
    for nothing in (None, "", "  ", "the Owl", "Saltbeard", "Old Flint", "Dr. Winerothorp", "那船夫", "磨坊的石匠", "x" * 3000):
        assert p.parse(nothing) is None


def entities(spark, rows, nicks=(("Margaret", "Peggy"),)):
    frame = spark.createDataFrame([(s, e, n, True, "clash") for s, e, n in rows], SPELLINGS)
    groups = resolve(frame, spark.createDataFrame([(*n, "clash") for n in nicks], NICKS))
    return {(r.person_a, r.person_b) for r in pairs_of_groups(groups).collect()}


def test_variants_link_and_relatives_do_not(spark):
    rows = [
        ("b", "1", "Margaret Trimblow"),
        ("b", "2", "Peggy Trimblow"),
        ("b", "2", "the Heron"),
        ("b", "3", "Trimblow, Margarett"),
        ("b", "4", "M. Trimblow"),  # alone in explaining it once 1, 2 and 3 are one
        ("b", "5", "Edmund Trimblow"),
        ("b", "5", "the Heron"),
        ("b", "6", "Algernon Merga"),
        ("b", "7", "Algy Merga"),
        ("b", "8", "Kenelm Goust the Elder"),
        ("b", "9", "Kenelm Goust the Younger"),
        ("b", "A", "K. Goust"),  # ambiguous
        ("c", "B", "Margaret Trimblow"),  # another book
        ("b", "C", "University of Thimb"),
        ("b", "D", "Thimb Univ."),
        ("b", "E", "Order of Thimb"),
        ("b", "F", None),
        ("b", "G", ""),
        (None, "H", "Margaret Trimblow"),
        ("b", "1", "Margaret Trimblow"),
    ]
    assert entities(spark, rows) == {("1", "2"), ("1", "3"), ("2", "3"), ("1", "4"), ("2", "4"), ("3", "4"), ("6", "7"), ("C", "D")}


def test_organisations_of_unseen_trades(spark):
    rows = [("b", "1", "Guild of Foamoleden Cartwrights"), ("b", "2", "Foamoleden Cartwrights' Gld."), ("b", "3", "The Cartwrights Guild of Stonby"), ("b", "4", "Guild of Stonby Cartwrights"), ("b", "5", "Hosp. of Foamoleden"), ("b", "6", "Foamoleden Hospital"), ("c", "7", "Cartwrights Guild of Wick")]
    assert entities(spark, rows) == {("1", "2"), ("3", "4"), ("5", "6")}


def test_han_names(spark):
    rows = [("b", "1", "轩辕静凤"), ("b", "2", "軒轅靜鳳"), ("b", "3", "Jingfeng Xuanyuan"), ("b", "4", "轩辕静奉先生"), ("b", "5", "轩辕静书")]
    assert entities(spark, rows) == {(x, y) for x in "1234" for y in "1234" if x < y}


def test_entities_that_none_introduces_and_empty_tables(spark):
    frame = spark.createDataFrame([("b", "1", "Ann Bell", True, ""), ("b", "2", "Ann Bell", False, "")], SPELLINGS)
    nicks = spark.createDataFrame([], NICKS)
    assert resolve(frame, nicks).count() == 0
    assert resolve(frame.limit(0), nicks).count() == 0
