"""Text functions, sources, packing, upserts, intervals."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.replace import purified
from tidemark.operators.intervals import merge_overlaps, overlay
from tidemark.operators.packing import pack, sections
from tidemark.operators.upserts import merge_replicas, replay
from tidemark.sources import books


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first().v


def test_utf16(spark):
    assert value(spark, X.u16_length, "a😀𠮷") == 5
    assert value(spark, X.u16_length, None) is None
    assert value(spark, lambda t: X.slice_u16(t, F.lit(1), F.lit(3)), "a😀b") == "😀"


def test_clean_and_language(spark):
    assert value(spark, X.clean, "　a​ \t b \n ") == "a b"
    assert value(spark, X.language, "the cat and the dog that was with his friend " * 5) == "en"
    assert value(spark, X.language, "学" * 300) == "zh"
    assert value(spark, X.language, "が" * 300) == "ja"
    assert value(spark, X.language, "которые " * 60) == "ru"
    assert value(spark, X.language, "") == "en"
    assert value(spark, X.language, None) is None


def test_hits_and_grams(spark):
    assert value(spark, lambda t: X.hits(t, "aa"), "aaaaa") == 2
    assert value(spark, lambda t: X.overlapping_hits(t, "aa"), "aaaaa") == 4
    assert sorted(value(spark, X.grams, "The sea 海風吹")) == sorted(["the", "sea", "海風", "風吹"])
    assert value(spark, X.grams, "") == []


def test_purified_in_one_pass(spark):
    assert value(spark, lambda t: purified(t, [("a", "b"), ("b", "c"), ("a", "z")]), "ab") == "bc"
    assert value(spark, lambda t: purified(t, [("a", "b")]), None) is None
    with pytest.raises(ValueError):
        purified(F.col("t"), [("", "x")])


def test_decoding_and_blocks():
    assert books.decode("héllo".encode("utf-16")) == "héllo"
    assert books.decode("中文".encode("gb18030")) == "中文"
    assert books.text_blocks("﻿Chapter 1\r\n\r\nIt rained.\nStill.\r\n\r\n")[0][1].endswith("Chapter 1")
    page = "<html><head><title>x</title></head><body><nav>menu</nav><h1>Part &amp; one</h1><p>a<br>b</p><script>bad()</script><img src='i.png'></body></html>"
    assert books.html_blocks(page) == [("h", "Part & one", None), ("p", "a", None), ("p", "b", None), ("img", "", "i.png")]


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="urn:y"><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/></spine></package>')
        z.writestr("o/c.xhtml", "<h2>One</h2><p>Hello 😀 there</p>")
    return out.getvalue()


def test_read_books(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline 😀 two\n", encoding="utf-8")
    (tmp_path / "same.txt").write_text("line one\nline 😀 two\n", encoding="utf-8")
    (tmp_path / "b.epub").write_bytes(epub())
    (tmp_path / "c.epub").write_bytes(b"no zip")
    (tmp_path / "d.txt").write_text("\n \n")
    rows = books.read_books(spark, str(tmp_path)).orderBy("book_id", "block_no").collect()
    assert len({r.book_id for r in rows}) == 4  # equal files are one book
    assert [(r.t, r.o) for r in rows if r.t and r.t.startswith("line")] == [("line one", 0), ("line 😀 two", 9)]
    assert [(r.k, r.t, r.o) for r in rows if r.t and r.t in ("One", "Hello 😀 there")] == [("h", "One", 0), ("p", "Hello 😀 there", 4)]
    assert sorted(r.error for r in rows if r.error) == ["empty", "not an EPUB"]


def test_snapshot_round_trip(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "é", 3)], "id long, a string, n long")
    packed = books.snapshot(rows, ["id"])
    assert sorted(map(tuple, books.restore(packed, "a string, n long").collect())) == sorted(map(tuple, rows.collect()))
    assert books.restore(packed.withColumn("document", F.lit("{}")), "a string, n long").count() == 0


def test_packing():
    assert pack([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3]
    assert sections([5, 5, 5], 11) == [0, 0, 1]
    assert pack([], 10) == sections([], 10) == []


def test_operations():
    ops = [("a", 0, 1.0, False), ("a", 1, 2.0, False), ("b", 0, 3.0, False), ("c", 1, 4.0, True)]
    assert replay(ops) == ([("a", "applied", 1), ("a", "repeated", 1), ("b", "conflict", 1), ("c", "applied", 2)], (2, 4.0, True))
    assert replay([("x", 7, 1.0, False)]) == ([("x", "conflict", 0)], None)


def test_replicas_and_intervals(spark):
    local = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0), (5, 1, None)], "item long, revision long, value double")
    remote = spark.createDataFrame([(1, 1, 9.0), (2, 3, 9.0), (3, 1, 9.0), (4, 1, 9.0), (5, 1, None)], "item long, revision long, value double")
    assert {r.item: (r.value, r.outcome) for r in merge_replicas(local, remote).collect()} == {1: (1.0, "local"), 2: (9.0, "remote"), 3: (1.0, "conflict"), 4: (9.0, "remote"), 5: (None, "same")}
    spans = spark.createDataFrame([("k", 0, 5), ("k", 5, 8), ("k", 9, 12), ("k", 3, 3)], "k string, s long, e long")
    assert {(r.s, r.e, r.spans) for r in merge_overlaps(spans, ["k"], "s", "e").collect()} == {(0, 8, 2), (9, 12, 1)}
    base, extra = spark.createDataFrame([("k", 0, 5, 1)], "k string, s long, e long, id long"), spark.createDataFrame([("k", 4, 6, 2), ("k", 5, 6, 3)], "k string, s long, e long, id long")
    assert {r.id for r in overlay(base, extra, ["k"], width=2).collect()} == {1, 3}
