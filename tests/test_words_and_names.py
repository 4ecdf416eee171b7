"""Scalar functions, formats and lookups on small cases and against brute force."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import text as X
from tidemark.functions import words as W
from tidemark.operators import fold
from tidemark.operators.contained import contained_names, names_in_texts, whole_words
from tidemark.operators.running import ranked, sliding
from tidemark.plans import rules, words
from tidemark.sources import books, formats


def values(spark, column, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("t"))).collect()]


def test_chapter_numbers(spark):
    assert values(spark, W.ordinal, "第十二部", "第一千零三章", "第二十章", "Chapter XIV", "Chapitre 7", "3. The mill", "The mill", "", None) == [12, 1003, 20, 14, 7, 3, None, None, None]
    assert values(spark, W.is_opener, "楔子", "Prologue", "Chapter 1", None) == [True, True, False, False]


def test_full_width_marks(spark):
    assert values(spark, W.full_width, '他说,"好"!', "中,;a", "a, b", "他, b", "", None) == ["他说，“好”！", "中，;a", "a, b", "他，b", "", None]


def test_slices_never_split_a_pair(spark):
    text = "a😀b"
    strict = lambda a, b: values(spark, lambda t: W.strict_slice(t, F.lit(a), F.lit(b)), text)[0]
    assert [strict(0, 1), strict(1, 3), strict(0, 2), strict(2, 3), strict(3, 9)] == ["a", "😀", None, None, None]
    assert [values(spark, lambda t, n=n: W.prefix_units(t, F.lit(n)), text)[0] for n in (0, 1, 2, 3, 99)] == ["", "a", "a", "a😀", text]


def test_bylines_authors_and_works(spark):
    shown = values(spark, lambda t: F.concat_ws("|", *W.display_title(t, F.lit(""))), "故乡 作者：鲁迅", "故乡 作者：www.site.com", "The Mill", None)
    assert shown == ["故乡|鲁迅", "故乡|", "The Mill|", "|"]
    assert values(spark, lambda t: W.text_author(t, X.HEADING), "故乡\n鲁迅\n我冒了严寒。", "故乡\n作者：鲁迅\n一", "第1章\n鲁迅\n一", "", None) == ["鲁迅", "鲁迅", "", "", ""]
    assert values(spark, W.work_of, "The Mill (run 3)", "(all)", None) == ["the mill", "(all)", ""]
    assert values(spark, W.loose_json, 'Sure: {"k": 1,} ok', "none", None) == ['{"k": 1}', None, None]


def test_generic_names_cores_and_short_forms(spark):
    assert values(spark, N.is_generic, "the old doctor", "Doctors", "Anna Vale", "老太太", "他父亲", "鲁迅", None) == [True, True, False, True, True, False, False]
    assert values(spark, N.is_good_alias, "Anna", "the family", "贾家夫妇", "", None) == [True, False, False, False, False]
    assert values(spark, N.core, "Mr. Pocket", "郝麦太太", "Anna", None) == ["Pocket", "郝麦", "", ""]
    assert values(spark, lambda t: F.array_sort(N.short_forms(t)), "Herbert Pocket", "贾宝玉", "查理·包法利", "Anna") == [["Herbert", "Pocket"], ["宝玉"], ["包法利", "查理"], []]


def test_names_inside_names_and_texts_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab 司徒") for _ in range(rnd.randint(1, n))).strip() or "ab"
    texts, names = [(s, word(14)) for s in "xxyy" * 12], [(s, word(6)) for s in "xy" * 15]
    left = spark.createDataFrame([*texts, ("x", None), (None, "ab")], "book_id string, name string")
    right = spark.createDataFrame([*names, ("x", None)], "book_id string, to_name string")
    got = {tuple(r) for r in names_in_texts(left, right, "book_id", "name", "to_name").collect()}
    assert got == {(s, t, n) for s, t in texts for z, n in names if s == z and len(n) >= 2 and n in t}
    both = {tuple(r) for r in contained_names(left, right).select("book_id", "name", "to_name").collect()}
    assert both == {(s, t, n) for s, t in texts for z, n in names if s == z and (len(n) >= 2 and n in t or len(t) >= 2 and t in n)}


def test_whole_words(spark):
    texts = spark.createDataFrame([("b", "Ann met Anne. (Ann) O'Ann"), ("b", "司徒华云来了"), ("b", None), ("b", "")], "book_id string, t string")
    names = spark.createDataFrame([("b", "Ann"), ("b", "华云"), ("b", "Anne"), ("b", None), ("c", "met")], "book_id string, name string")
    assert sorted((r.name, r.place, r.times) for r in whole_words(texts, names, "book_id", "t", "name").collect()) == [("Ann", 1, 3), ("Anne", 9, 1), ("华云", 3, 1)]


def test_ranks_and_sliding_sums_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randint(0, 200), i, rnd.choice([1, 2, None])) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, p long, i long, v long")
    got = {r.i: (r.rank, r.total) for r in sliding(ranked(frame, ["k"], "p", ["i"], stretch=16), ["k"], "p", ["i"], 5, width=8, total=F.sum("v")).collect()}
    for key in "ab":
        own = sorted((p, i, v) for k, p, i, v in rows if k == key)
        for n, (_, i, _) in enumerate(own):
            last = [v for _, _, v in own[max(0, n - 4) : n + 1] if v is not None]
            assert got[i] == (n + 1, sum(last) if last else None)


def test_identities_on_long_chains_and_cycles(spark):
    chain = [("b", f"n{i:03}", f"n{i + 1:03}") for i in range(200)]
    ring = [("b", "r1", "r2"), ("b", "r2", "r3"), ("b", "r3", "r1"), ("b", "t1", "t2"), ("b", "t2", "r2"), ("b", "self", "self")]
    frame = spark.createDataFrame([*chain, *ring, ("c", "n000", "x")], "book_id string, id string, into_id string")
    got = {(r.book_id, r.id): r.canon for r in fold.canonical(frame).collect()}
    assert all(got["b", f"n{i:03}"] == "n200" for i in range(200)) and got["c", "n000"] == "x"
    assert [got["b", x] for x in ("r1", "r2", "r3", "t1", "t2", "self")] == ["r1", "r2", "r3", "r2", "r2", "self"]
    assert fold.canonical(frame.limit(0)).count() == 0


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_works_begin_where_numbers_begin_again(spark, tmp_path):
    rows, o = [], 0
    for chapter, title in enumerate(["Chapter 1", "Chapter 2", "Chapter 1", "Chapter 2", "Prologue", "Chapter 1"]):
        for k, t in (("h", title), ("p", "x" * 1500)):
            rows.append(("b", len(rows), chapter, k, t, o))
            o += len(t) + 1
    folder = write(spark, tmp_path, blocks=(rows, "book_id string, block_no long, chapter_no int, k string, t string, o long"))
    got = sorted((r.s, r.e) for r in words.collected_works(spark, folder).collect())
    starts = [rows[i][5] for i in (0, 4, 8)]
    assert [s for s, _ in got] == starts and got[-1][1] == o - 1


def test_mentions_take_the_longest_name(spark, tmp_path):
    blocks = [("b", 0, 0, "Ann Vale met Ann and Vale."), ("b", 1, 27, "司徒华云与司徒")]
    log = [(1, "b", "person", "P1", "Ann", None), (2, "b", "alias", "P1", None, "Ann Vale"), (3, "b", "person", "P2", "司徒华云", None), (4, "b", "alias", "P3", None, "Ann"), (5, "b", "alias", "P2", None, "司徒")]
    folder = write(spark, tmp_path, blocks=(blocks, "book_id string, block_no long, o long, t string"), kg_log=(log, "rec_id long, book_id string, t string, id string, name string, alias string"))
    got = {(r.block_no, r.name): (r.mentions, r.ambiguous) for r in rules.block_mentions(spark, folder).collect()}
    assert got == {(0, "Ann Vale"): (1, False), (0, "Ann"): (1, True), (1, "司徒华云"): (1, False), (1, "司徒"): (1, False)}


def test_licence_frames_and_readings(spark):
    framed = "Title: The Mill\nAuthor: A. Vale\n*** START OF THE PROJECT GUTENBERG EBOOK ***\nIt rained.\n*** END OF THE PROJECT GUTENBERG EBOOK ***\nlicence"
    assert formats.unframed(framed) == ("\nIt rained.\n", "The Mill", "A. Vale") and formats.unframed("It rained.") == ("It rained.", "", "")
    columns = values(spark, lambda t: F.array(*formats.unframed_columns(t)), framed, "It rained.", "")
    assert columns == [["\nIt rained.\n", "The Mill", "A. Vale"], ["It rained.", "", ""], ["", "", ""]]
    japanese = "題\n著者\n-----\n説明\n-----\n［＃大見出し］一［＃大見出し終わり］\n｜山路《やまみち》を登る。\n底本：本"
    assert formats.annotated_blocks(japanese) == ("題", "著者", [("h", "一", None), ("p", "山路を登る。", None)])
    assert values(spark, formats.is_annotated, japanese, "It rained.") == [True, False]


def epub(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        made.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        for name, body in files.items():
            made.writestr(f"o/{name.replace('_', '.')}", body)
    return out.getvalue()


def test_contents_and_covers_of_epubs():
    package = '<package><metadata><meta name="cover" content="c"/></metadata><manifest><item id="c" href="c.png" media-type="image/png"/><item id="a" href="a.html"/><item id="n" href="n.html" properties="nav"/></manifest><spine><itemref idref="a"/><itemref idref="gone"/></spine></package>'
    nav = '<html xmlns:e="http://www.idpf.org/2007/ops"><nav e:type="toc"><ol><li><a href="a.html">One</a><ol><li><a href="a.html#x">Part</a></li></ol></li></ol></nav></html>'
    raw = epub(p_opf=package, n_html=nav, a_html="<p>It rained.</p>", c_png="x")
    made = formats.Package(raw)
    assert made.contents() == [("One", 0, "o/a.html", ""), ("Part", 1, "o/a.html", "x")] and made.cover() == "o/c.png"
    assert books.epub_blocks(raw) == [("h", "One", None), ("p", "It rained.", None)]
    ncx = '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.html"/></navPoint></navMap></ncx>'
    older = '<package><manifest><item id="t" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/></spine></package>'
    made = formats.Package(epub(p_opf=older, t_ncx=ncx, a_html="<p>x</p>"))
    assert made.contents() == [("One", 0, "o/a.html", "")] and made.cover() is None
