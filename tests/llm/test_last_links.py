"""The last links on the driver and all levels on the cluster give the same groups; small graphs need few queries."""

import random

from pyspark.sql import functions as F

from tidemark.llm import groups


def test_same_groups_with_and_without_the_driver(spark):
    rnd = random.Random(11)
    links = [(f"n{rnd.randint(0, 400)}", f"n{rnd.randint(0, 400)}") for _ in range(260)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("x", None), ("y", "y")]
    pairs = spark.createDataFrame(links, "a string, b string")
    got = [{tuple(r) for r in groups.connected_groups(pairs, few=few).collect()} for few in (0, 60, groups.FEW)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 300
    numbers = pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).where("a <> b")
    assert {tuple(r) for r in groups.connected_groups(numbers, few=0).collect()} == {tuple(r) for r in groups.connected_groups(numbers).collect()}


def test_few_links_take_one_query_and_no_levels(spark, monkeypatch):
    written = []
    monkeypatch.setattr(groups, "cut", lambda df, cut=groups.cut: written.append(1) or cut(df))
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(300)], "a string, b string")
    found = groups.connected_groups(pairs)
    assert len(written) == 1 and {tuple(r) for r in found.collect()} == {(f"n{i:03}", "n000") for i in range(301)}
