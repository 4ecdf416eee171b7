"""Look-alikes, encoding, truncation, stuffing."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import encode, glyphs, stuffing, truncation

FORM = glyphs.consistent_form()


def test_forms():
    same = [("ｆｕｌｌ，width", "full,width"), ("e\u0301te\u0301", "été"), ("a\u00a0b\u2009c", "a b c"), ("a\u200bb\u00adc", "abc"), ("co\u2010op", "co-op"), ("ﬁre", "fire"), ("thе оwl", "the owl"), ("Слaвa", "Слава"), ("⼈⻔", "人门"), ("dʼor", "d’or")]
    for a, b in same:
        assert FORM(a) == FORM(b), (a, b)
    different = [("e", "é"), ("a", "A"), ("2", "3"), ("x²", "x2"), ("国", "國"), (".", "!"), ("'", "’"), ("ab", "a b")]
    for a, b in different:
        assert FORM(a) != FORM(b), (a, b)
    assert FORM(None) is None and FORM("") == ""
    assert FORM("сосо") == "coco" and FORM("Слава") == "Слава"  # a whole-script confusable, and a word that only one script can spell


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    assert FORM(FORM(text)) == FORM(text)


def test_pairs_of_look_alikes(spark):
    rows = [(1, "b", "event", "the owl"), (2, "b", "event", "thе owl"), (3, "b", "event", "the owl"), (4, "b", "rel", "the\u00a0owl"), (5, "c", "event", "the\u00a0owl"), (6, "b", "event", None), (7, None, "event", "thе owl"), (2, "b", "event", "thе owl"), (8, "b", "event", ""), (9, "b", "event", "\u200b"), (10, "b", "event", "x" * 50_000), (11, "b", "event", "x" * 50_000 + "\u200b")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "rec_id long, book_id string, t string, text string, form string").withColumnRenamed("form", "f")
    assert {tuple(r) for r in glyphs.look_alikes(frame).collect()} == {(1, 2), (2, 3), (8, 9), (10, 11)}
    assert glyphs.look_alikes(frame.limit(0)).count() == 0


def test_encoding_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = encode.read_ranks(encode.default_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = encode.encoder(encode.default_vocabulary(), encode.default_pattern())
    rnd = random.Random(1)
    texts = ["", " ", "a", "<|endoftext|>", "a" * 5000, "好" * 900, "it's they're 12345  \n\t x", "👩‍👩‍👧 é\u0301"]
    texts += ["".join(rnd.choice(" aébc好日\n'12😀") for _ in range(rnd.randrange(200))) for _ in range(200)]
    assert all(own(t) == library.encode_ordinary(t) for t in texts)
    frame = spark.createDataFrame([(1, "the owl", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x")], "doc_id long, text string, clash string")
    got = {r.doc_id: r.ids for r in encode.encode_column(frame, "text", "ids").collect()}
    assert got == {1: library.encode_ordinary("the owl"), 2: [], 3: []}
    assert encode.encode_column(frame.limit(0), "text", "ids").count() == 0


def test_long_and_short_merges_agree():
    ranks = encode.read_ranks(encode.default_vocabulary())
    rnd = random.Random(2)
    for _ in range(60):
        word = bytes(rnd.choice(b"abcde \xe5\xa5\xbd") for _ in range(rnd.randrange(1, 90)))
        assert encode.merge_long(word, ranks) == encode.merge_short(word, ranks)


def test_look_alike_letters_are_public_confusables(spark):
    """Every pair has one skeleton in the confusables data that Spark ships, but for pairs that its version lacks. The data's looser pairs (г and r, σ and o) differ to a reader and are left out."""
    checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
    pairs = [(a, b) for own, latin in glyphs._TABLES.values() for a, b in zip(own, latin, strict=True)]
    assert {a for a, b in pairs if checker.getSkeleton(0, a) != checker.getSkeleton(0, b)} <= {"Ԛ", "ӏ"}


def texts_for_truncation():
    rnd = random.Random(4)
    places, people = ["mill", "quay", "tower", "chapel", "archive"], ["Anna Vale", "Tom Reed", "Ida Marsh"]
    rows, cut = [], set()
    for i in range(900):
        person, place = rnd.choice(people), rnd.choice(places)
        text = rnd.choice([f"Lost the {place} to {person} in a game, and has felt grief ever since.", f"Keeper of the {place}", f"Nobody knows why {person} pays the rent…", f"Nobody knows why {person} pays the rent… Pays {i} coins a year for the {place}.", f"Pays {i} coins a year for the {place}."])
        if i % 20 == 0:
            text, _ = f"Lost the {place} to {person} in a game, and has felt grief ever since."[: 25 + i % 17].rstrip() + rnd.choice(["", "…", " [", "\\"]), cut.add(i)
        rows.append((i, rnd.choice(["m1", None]), "f", text, "clash"))
    return rows, cut


def test_truncation(spark):
    rows, cut = texts_for_truncation()
    extra = [(9001, "m1", "f", None, ""), (9002, "m1", "f", "  ", ""), rows[0], (9003, "m1", "f", "Keeper of the quay", "")]
    frame = spark.createDataFrame(rows + extra, "rec_id long, source string, field string, text string, name string")
    names = spark.createDataFrame([("Anna Vale",), ("Tom Reed",), ("Ida Marsh",)], "spelling string")
    judged = truncation.judge_texts(frame, names).collect()
    assert len(judged) == len({r.rec_id for r in judged}) == 901
    found = {r.rec_id for r in judged if r.cut}
    assert found == cut
    shares = {r.model: r for r in truncation.rates(truncation.judge_texts(frame, names)).collect()}
    assert set(shares) == {"m1", None} and sum(r.cut for r in shares.values()) == len(cut)
    assert truncation.judge_texts(frame.limit(0), names.limit(0)).count() == 0


def test_censored_fit():
    rnd = np.random.default_rng(0)
    lengths = np.minimum(np.exp(rnd.normal(4.0, 0.5, 20_000)).round(), 90).astype(int)
    values, counts = np.unique(lengths, return_counts=True)
    mean, deviation = truncation.fit_censored(values, counts, 90)
    assert abs(mean - 4.0) < 0.03 and abs(deviation - 0.5) < 0.03
    part = pd.DataFrame({"source": "s", "field": "f", "han": False, "unit": "chars", "length": values, "n": counts})
    at = truncation.limit_posteriors(part)
    assert at["length"].tolist() == [90] and at["posterior"].iloc[0] > 0.9


def test_stock_phrases_are_no_limit():
    # A length with a hundred times as many longer values is no limit, however far it stands out.
    part = pd.DataFrame({"source": "s", "field": "f", "han": False, "unit": "chars", "length": [7, *range(20, 120)], "n": [200, *[30] * 100]})
    assert 7 not in truncation.limit_posteriors(part)["length"].tolist()


@pytest.mark.parametrize("times", [1, 10])
def test_stems_stay_stems_as_the_table_grows(spark, times):
    tails = ["the windmill every day", "the harbour every day", "the winter garden at dawn"]
    whole = [f"Sings in {tails[i % 3]}." for i in range(60 * times)] + [f"Owner of {t}" for t in ("the windmill", "the harbour") for _ in range(20 * times)] + ["Owner of the windmill.", "Owner of the harbour."] * times
    marked = ["She drew a w on the wall."] * times  # the stem is a word elsewhere
    cut = ["Sings in the w"] * (6 * times) + ["Sings in the"] * times + ["Sings in the harbour ev..."] * times
    texts = whole + marked + cut
    frame = spark.createDataFrame([(i, "m", "rel", t) for i, t in enumerate(texts)], "rec_id long, source string, field string, text string")
    names = spark.createDataFrame([("Wick W. Ev",)], "spelling string")
    found = {r.rec_id for r in truncation.judge_texts(frame, names).where("cut").collect()}
    assert found == set(range(len(whole) + len(marked), len(texts)))


def naive_cover(words, least=2):
    covered = set()
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            if sum(words[k : k + j - i] == words[i:j] for k in range(len(words) - (j - i) + 1)) > 1:
                covered |= set(range(i, j))
    return sum(len(words[i]) for i in covered) / max(1, sum(map(len, words)))


def test_cover_against_brute_force():
    rnd = random.Random(6)
    for _ in range(150):
        words = [rnd.choice(["a", "bb", "ccc", "d"]) for _ in range(rnd.randrange(25))]
        if len(words) >= 4:
            assert abs(stuffing.covered_by_repeats(words) - naive_cover(words)) < 1e-9
    assert stuffing.covered_by_repeats([]) == 0


def test_stuffed_pages(spark):
    sentence = "The keeper of the mill walked to the quay and thought of the lantern. "
    cast = "\n".join(f"Anna Vale — keeper, {p}" for p in ("mill", "quay", "tower") * 4)
    inventory = "She counted the lantern and the keeper at the mill, tower and quay.\n"
    keyword = lambda i: ", ".join(["free epub download", "cheap ebooks", "discount code"][(i + k) % 3] for k in range(30))
    links = "\n".join(f"http://x{i}.test/go/{i}" for i in range(12))
    rows = [(i, sentence * (2 + i % 5) + inventory) for i in range(60)]
    rows += [(100 + i, keyword(i) + f" number{i}") for i in range(6)] + [(200, sentence + "\n" + keyword(1) * 3), (201, links), (202, "#epub #cheap #mug #poster #free #slipcase #code")]
    fine = [(300, cast), (301, None), (302, ""), (303, " \n"), (304, "0" * 300), (305, sentence * 3 + " http://a.test/x"), (306, "Chapter 1. The mill ..... 12\nChapter 2. The quay ..... 30"), (307, (sentence * 20_000))]
    frame = spark.createDataFrame([(*r, True) for r in rows + fine + [rows[-1]]], "doc_id long, text string, stuffed boolean")
    judged = stuffing.judge(frame).collect()
    assert len(judged) == len(rows) + len(fine)
    assert {r.doc_id for r in judged if r.stuffed} == {100, 101, 102, 103, 104, 105, 200, 201, 202}
    assert stuffing.judge(frame.limit(0)).count() == 0


def test_stuffing_in_sentences(spark):
    sentence = "The keeper of the mill walked to the quay and thought of the lantern. "
    phrases = ["discount code", "texte intégral", "排行榜", "nouveauté"]
    fragments = [(i, ", ".join([phrases[i % 4]] * 9) + f", number{i}") for i in range(120)]
    en = "Get discount code now, discount code today, discount code every day. Looking for discount code? Our discount code is the best discount code."
    fr = "Vous cherchez texte intégral ? Notre texte intégral est le meilleur texte intégral pour tous. Pourquoi texte intégral ? Parce que texte intégral est texte intégral."
    zh = "想看排行榜？排行榜就来这里看排行榜，无删减也有。排行榜哪里好？排行榜无删减，无删减排行榜。"
    one = "Vous cherchez nouveauté ? Notre nouveauté est le meilleur nouveauté pour eux. nouveauté ici, nouveauté partout et nouveauté."
    stuffed = [(300, en), (301, fr), (302, zh), (303, sentence + en * 2), (304, one)]
    refrain = "Nobody ever asked her for the discount code again. "
    fine = [(200, sentence * 9), (201, sentence * 4 + en[:68]), (202, refrain * 6), (203, sentence + refrain * 6), (204, "她在码头等消息，一直等到天亮。" * 3 + "有人说起排行榜。")]
    assert all(stuffing._text().parts(text)[1] == [] for _, text in stuffed)  # whole sentences only
    frame = spark.createDataFrame(fragments + stuffed + fine, "doc_id long, text string")
    assert {r.doc_id for r in stuffing.judge(frame).collect() if r.stuffed} == {i for i, _ in fragments + stuffed}
