"""Pieces of segments, and mixes."""

import random

from tidemark.llm.mix import fit_counts, plan_mix, report
from tidemark.llm.pieces import Limits, split_segments

SMALL = Limits(chinese=60, others=100, overlap=10, stretch=128)


def units(text):
    return len(text.encode("utf-16-le")) // 2


def check(spark, texts, lang, limits=SMALL):
    blocks, at = [], 0
    for i, t in enumerate(texts):
        blocks.append(("b", i, at, t, 7))
        at += units(t or "") + 1
    end = at - 1
    whole = "\n".join(t or "" for t in texts).encode("utf-16-le")
    segs = spark.createDataFrame([("b", 0, 0, end, lang, 1), ("b", 0, 0, end, lang, 2), ("b", 1, 0, None, lang, 1)], "book_id string, seg long, o0 long, o1 long, lang string, t long")
    frame = spark.createDataFrame(blocks, "book_id string, block_no long, o long, t string, seg long").withColumnRenamed("seg", "level")
    rows = split_segments(segs, frame, limits).orderBy("piece").collect()
    limit = limits.chinese if lang == "zh" else limits.others
    if end <= limit:
        assert rows == []
        return rows, whole
    assert [r.piece for r in rows] == list(range(len(rows)))
    assert rows[0].o0 == 0 and rows[-1].o1 == end
    for a, b in zip(rows, rows[1:]):
        assert a.o1 - limits.overlap <= b.o0 <= a.o1 < b.o1
    for r in rows:
        assert r.o1 - r.o0 <= limit
        whole[2 * r.o0 : 2 * r.o1].decode("utf-16-le")  # no pair is split
    return rows, whole


def test_ends_at_blocks_then_sentences(spark):
    rows, whole = check(spark, ["One two three. Four five six." * 2, "Seven eight.", "Nine. " * 30, None, "Ten eleven."], "en")
    text = lambda r: whole[2 * r.o0 : 2 * r.o1].decode("utf-16-le")
    assert all(text(r).rstrip().endswith(".") for r in rows)
    assert text(rows[0]).endswith("Seven eight.")
    assert all(not (whole[2 * r.o0 - 2 : 2 * r.o0].decode("utf-16-le").isalpha() and text(r)[0].isalpha()) for r in rows[1:])


def test_text_without_boundaries_and_astral_characters(spark):
    check(spark, ["word " * 100], "en")
    check(spark, ["x" * 500], "en")
    check(spark, ["😀" * 200], "en")
    check(spark, ["学" * 50 + "。" + "書" * 300], "zh")
    check(spark, ["short"], "en")


def test_random_segments(spark):
    rnd = random.Random(8)
    for lang in ("en", "zh"):
        texts = ["".join(rnd.choice(["word ", "a", "学", "😀", ". ", "。", "longerword "]) for _ in range(rnd.randrange(60))) for _ in range(30)]
        check(spark, texts, lang)


def test_missing_blocks_and_empty_tables(spark):
    segs = spark.createDataFrame([("b", 0, 0, 1000, None)], "book_id string, seg long, o0 long, o1 long, lang string")
    blocks = spark.createDataFrame([], "book_id string, block_no long, o long, t string")
    rows = split_segments(segs, blocks, SMALL).orderBy("piece").collect()
    assert rows[0].o0 == 0 and rows[-1].o1 == 1000 and all(r.o1 - r.o0 <= 100 for r in rows)
    assert split_segments(segs.limit(0), blocks, SMALL).count() == 0


def test_fit_counts_reaches_what_can_be_reached():
    rnd = random.Random(1)
    for _ in range(200):
        counts = {rnd.randint(1, 40): rnd.randint(1, 6) for _ in range(rnd.randint(1, 8))}
        budget = rnd.randint(0, sum(n * c for n, c in counts.items()))
        take = fit_counts(counts, budget, rnd.choice([1, 7, 30, 20_000]))
        assert all(0 < take[n] <= counts[n] for n in take)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        # However small the first programme, nothing comes nearer.
        assert abs(sum(n * c for n, c in take.items()) - budget) == min(abs(s - budget) for s in sums)


def test_mix(spark):
    rnd = random.Random(9)
    docs = [(i, rnd.choice(["big", "big", "big", "small", None, "other"]), "the owl " * rnd.randint(1, 30), "clash") for i in range(400)]
    docs += [(1000, "big", None, ""), (1001, "small", "", ""), docs[0]]
    targets = [("big", 0.5, 1, 0), ("small", 0.3, 2, 0), ("absent", 0.2, None, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, copies string")
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int, tokens int")
    plan = plan_mix(frame, wanted)
    rows = plan.collect()
    assert len(rows) == len({r.doc_id for r in rows}) and {r.source for r in rows} == {"big", "small"}
    assert all(r.copies <= {"big": 1, "small": 2}[r.source] for r in rows) and all(r.copies == 0 for r in rows if not r.tokens)
    told = {r.source: r for r in report(plan, wanted).collect()}
    assert abs(told["big"].share_of_total - 0.5) < 0.001 and told["big"].reached
    assert told["absent"].taken == 0 and not told["absent"].reached and told["absent"].documents == 0
    assert {(r.doc_id, r.copies) for r in plan_mix(frame, wanted).collect()} == {(r.doc_id, r.copies) for r in rows}  # the same on every run
    assert plan_mix(frame.limit(0), wanted).count() == 0
    assert plan_mix(frame, wanted.limit(0)).count() == 0
