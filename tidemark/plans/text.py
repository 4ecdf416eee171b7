"""Queries over books, blocks, segments and documents: offsets, chapters, slices, language, search, retrieval, anchoring, curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.words import prefix_units
from tidemark.operators import fold
from tidemark.operators.packing import pack_blocks, split_chapters
from tidemark.operators.running import ranked, running, within_spans
from tidemark.plans.log import CHAPTERS, U16, _chapters
from tidemark.session import cut
from tidemark.sources.tables import log_records, table

TERM = "lantern"
QUESTION = "who hid the silver whistle in the bell tower"
#: Known names in the question, whose grams weigh half as much again; how many paragraphs are given; how far the reader is.
NAMES, PARAGRAPHS, SHARE = ("bell tower",), 14, 0.6
FRONT, BACK = "(?i)preface|prologue|contents|avant-propos|序|目录", "(?i)afterword|appendix|postface|后记|附录"


def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global UTF-16 offset of each block: lengths of the blocks before, with one line feed each."""
    blocks = table(spark, sf_dir, "blocks").select("book_id", "block_no", "o", (X.u16_length(F.coalesce("t", F.lit(""))) + 1).alias("n"))
    out = running(blocks, ["book_id"], "block_no", [], "n", "before", F.sum, stretch=1 << 12, inclusive=False)
    return out.select("book_id", "block_no", F.coalesce("before", F.lit(0)).cast("long").alias("offset"), "o")


def chapter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and offsets of each chapter, with the start of the next."""
    blocks = table(spark, sf_dir, "blocks")
    ends = F.col("o") + X.u16_length(F.coalesce("t", F.lit("")))
    spans = blocks.groupBy("book_id", "chapter_no").agg(F.min("block_no").alias("b0"), (F.max("block_no") + 1).alias("b1"), F.min("o").alias("o0"), F.max(ends).alias("o1"), F.count(F.when(F.col("k") == "img", 1)).alias("images"))
    return spans.withColumn("next_o0", F.lead("o0").over(Window.partitionBy("book_id").orderBy("o0")))


def chapter_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """front before the first body chapter, body, and back matter at the end."""
    titles = table(spark, sf_dir, "blocks").groupBy("book_id", "chapter_no").agg(F.min_by("t", F.when(F.col("k") == "h", F.col("block_no"))).alias("title"), F.min("o").alias("o0"), F.max(F.col("o") + X.u16_length(F.coalesce("t", F.lit("")))).alias("o1"))
    titles = titles.withColumn("is_body", ~(F.coalesce(F.col("title").rlike(FRONT), F.lit(False)) | (F.col("o1") - F.col("o0") < 300))).withColumn("is_back", F.coalesce(F.col("title").rlike(BACK), F.lit(False)))
    order = Window.partitionBy("book_id").orderBy("chapter_no")
    seen = F.max("is_body").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tail = F.min("is_back").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return titles.select("book_id", "chapter_no", F.when(~seen, "front").when(tail, "back").otherwise("body").alias("kind"))


def thin_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books too short for a shelf of chapters: under 30,000 units or with fewer than two body chapters."""
    body = chapter_kinds(spark, sf_dir).where("kind = 'body'").groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"))
    books = table(spark, sf_dir, "books").select("book_id", "len").join(body, "book_id", "left")
    return books.select("book_id", F.coalesce("chapters", F.lit(0)).cast("long").alias("chapters"), ((F.coalesce("len", F.lit(0)) < 30_000) | (F.coalesce("chapters", F.lit(0)) < 2)).alias("thin"))


def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every segment, cut from its blocks in UTF-16 units, as its length and hash."""
    segs = table(spark, sf_dir, "segs").select("book_id", "seg", "o0", "o1").distinct()
    blocks = table(spark, sf_dir, "blocks").select("book_id", "o", F.coalesce("t", F.lit("")).alias("t")).withColumn("end", F.col("o") + X.u16_length(F.col("t")))
    # A block belongs to the segments that hold its start; segments begin at blocks, so starts suffice.
    rows = within_spans(blocks, segs, "book_id", "o", "o0", "o1")
    part = F.when(F.col("end") > F.col("o1"), X.slice_u16(F.col("t"), F.lit(0), F.col("o1") - F.col("o"))).otherwise(F.col("t"))
    whole = rows.select("book_id", "seg", "o", part.alias("t")).groupBy("book_id", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return whole.select("book_id", "seg", X.u16_length(F.col("text")).alias("units"), F.md5("text").alias("md5"))


def packed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "books").select("book_id", X.segment_limit(F.col("lang")).alias("most"))
    return pack_blocks(table(spark, sf_dir, "blocks"), most)


def long_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chapters(table(spark, sf_dir, "blocks"), 12_000, 36_000)


def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length in UTF-16 units and characters of each script."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", X.u16_length(F.col("text")).alias("units"), *(X.script_count(F.col("text"), n).cast("long").alias(n) for n in ("latin", "cjk", "kana", "cyrillic")))


def document_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.language(F.col("text")).alias("detected"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.clean(F.col("text")).alias("c"))
    return docs.select("doc_id", F.length("c").cast("long").alias("chars"), F.md5("c").alias("md5"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading lines of documents, by line number."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "heading"))
    return lines.where(X.is_heading(F.col("heading"))).select("doc_id", F.col("line").cast("long").alias("line"), "heading")


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a term: hits, and where the first one is."""
    docs = table(spark, sf_dir, "documents").where(F.lower("text").contains(TERM))
    return docs.select("doc_id", X.hits(F.col("text"), TERM).alias("hits"), F.locate(TERM, F.lower("text")).cast("long").alias("first"), F.substring("text", F.greatest(F.locate(TERM, F.lower("text")) - 24, F.lit(1)), F.lit(len(TERM) + 74)).alias("excerpt"))


def question_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that hold each gram of a question."""
    return _hits(spark, sf_dir).groupBy("gram").agg(F.count(F.lit(1)).alias("blocks"))


def _wanted(spark: SparkSession, *texts: str) -> list[str]:
    """The distinct grams of the question and of names: a constant of the query, not of the data."""
    return sorted({g for text in texts for g in spark.range(1).select(X.search_grams(F.lit(text)).alias("g")).first()["g"]})


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that begin before the reader's position, the last one cut at it: book_id, o, t."""
    ends = fold.cutoffs(table(spark, sf_dir, "kg_log").select("book_id", "p"), SHARE)
    blocks = table(spark, sf_dir, "blocks").where("k = 'p' and length(t) >= 8").select("book_id", "o", "t").join(ends, "book_id").where("o < pos")
    return blocks.select("book_id", "o", prefix_units(F.col("t"), F.col("pos") - F.col("o")).alias("t"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paragraph and gram of the question in it: only the question's grams leave a paragraph."""
    wanted = F.array(*map(F.lit, _wanted(spark, QUESTION, *NAMES)))
    blocks = _readable(spark, sf_dir).select("book_id", "o", F.length("t").alias("len"), F.array_intersect(X.search_grams(F.col("t")), wanted).alias("g"))
    return blocks.select("book_id", "o", "len", F.explode("g").alias("gram"))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen paragraphs of each book that best answer the question as far as the reader is, in the book's order.

    Rare grams weigh more, those of known names half as much again, long paragraphs count less. Where fewer paragraphs share a gram, evenly
    spaced ones with a score of 0 fill the places. The best are taken by salted parts first, so one book is no single task.
    """
    hits = cut(_hits(spark, sf_dir))
    readable = _readable(spark, sf_dir).select("book_id", "o")
    sizes = readable.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    named = [g for name in NAMES for g in _wanted(spark, name)]
    boost = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for g in set(named) for x in (g, 1.5 ** named.count(g)))), F.col("gram")), F.lit(1.0)) if named else F.lit(1.0)
    weights = hits.groupBy("book_id", "gram").agg(F.count(F.lit(1)).alias("df")).join(sizes, "book_id").select("book_id", "gram", (F.log(1 + F.col("n") / (1 + F.col("df"))) * boost).alias("w"))
    scored = hits.join(weights, ["book_id", "gram"]).groupBy("book_id", "o", "len").agg(F.round(F.sum("w") / (1 + 0.002 * F.col("len")), 6).alias("score"))
    best = [F.desc("score"), F.desc("o")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("o"), F.lit(16))).withColumn("k", F.row_number().over(Window.partitionBy("book_id", "salt").orderBy(*best))).where(F.col("k") <= PARAGRAPHS)
    top = cut(salted.withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy(*best))).where(F.col("k") <= PARAGRAPHS).select("book_id", "o", "score"))
    short = sizes.join(top.groupBy("book_id").agg(F.count(F.lit(1)).alias("have")), "book_id", "left").withColumn("slots", PARAGRAPHS - F.coalesce("have", F.lit(0))).where("slots > 0")
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.least("slots", "n").cast("long") - 1), lambda i: F.bround(i * (F.col("n") - 1) / F.greatest(F.lit(1), F.col("slots") - 1)).cast("long") + 1)
    spaced = ranked(readable, ["book_id"], "o", [], "i").join(short.select("book_id", F.explode(F.array_distinct(steps)).alias("i")), ["book_id", "i"]).select("book_id", "o").join(top, ["book_id", "o"], "left_anti")
    rows = top.unionByName(spaced.withColumn("score", F.lit(0.0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("o")).cast("long"))


def anchored_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes placed in the block that holds their position, the two on either side, or the rest of its segment: verbatim, else without marks, else (12 characters or more) by their first half."""
    quotes = log_records(spark, sf_dir, "rel").where("trim(quote) <> '' and s is not null").select("rec_id", "book_id", "s", "quote").distinct().withColumn("plain", X.without_punctuation(F.col("quote")))
    blocks = table(spark, sf_dir, "blocks").select("book_id", "block_no", "o", F.coalesce("t", F.lit("")).alias("t")).withColumn("bare", X.without_punctuation(F.col("t")))
    spans = blocks.select("book_id", "block_no", "o", (F.col("o") + X.u16_length(F.col("t")) + 1).alias("end"))
    at = within_spans(quotes, spans, "book_id", "s", "o", "end").select("rec_id", "book_id", "quote", "plain", F.col("block_no").alias("b0"))
    near = at.select("rec_id", "book_id", "quote", "plain", "b0", F.explode(F.array(*((F.col("b0") + d).alias("block_no") for d in (0, -1, 1, -2, 2)))).alias("block_no"))
    own = ["rec_id", "book_id", "quote", "plain", "b0"]
    found = near.join(blocks.select("book_id", "block_no", "t", "bare"), ["book_id", "block_no"]).groupBy(*own).agg(F.min(_anchor()).alias("near"))
    segs = table(spark, sf_dir, "segs").select("book_id", "seg", "o0", (F.col("o1") + 1).alias("o1")).distinct()
    parts = within_spans(blocks, segs, "book_id", "o", "o0", "o1").select("book_id", "seg", "block_no", "t", "bare")
    # Only quotes without a verbatim place near by have a segment to go on to: a null key joins nothing.
    places = parts.select("book_id", F.col("block_no").alias("b0"), F.col("seg").alias("_seg"))
    going = found.join(places, ["book_id", "b0"], "left").withColumn("seg", F.when(F.coalesce(F.col("near.stage") > 1, F.lit(True)), F.col("_seg"))).drop("_seg")
    best = F.min(F.least("near", _anchor())).alias("m")
    placed = going.join(parts, ["book_id", "seg"], "left").groupBy("rec_id", "book_id", "quote", "plain").agg(best).where("m is not null").select("rec_id", "book_id", "quote", "plain", "m.stage", "m.distance", "m.block_no")
    # Where in its block: marks may stand between the characters of a quote that was found without them.
    half = F.substring("plain", F.lit(1), F.floor(F.length("plain") / 2).cast("int"))
    pattern = X.marks_between(F.when(F.col("stage") == 3, half).otherwise(F.col("plain")))
    part = F.when(F.col("stage") == 1, F.col("quote")).otherwise(F.call_function("regexp_extract", F.col("t"), pattern, F.lit(0)))
    rows = placed.join(blocks.select("book_id", "block_no", "o", "t"), ["book_id", "block_no"]).withColumn("part", part)
    start = F.col("o") + X.u16_length(F.substring("t", F.lit(1), F.instr(F.col("t"), F.col("part")) - 1))
    return rows.select("rec_id", "stage", "distance", "block_no", start.alias("start"), (start + X.u16_length(F.col("part"))).alias("end"))


def _anchor() -> Column:
    """Stage at which a block holds a quote, with what decides between blocks: nearness up to two blocks, then their order; null where it does not."""
    # Marks are taken out once a quote and once a block, before the joins.
    plain, text = F.col("plain"), F.col("bare")
    half = F.substring(plain, F.lit(1), F.floor(F.length(plain) / 2).cast("int"))
    stage = F.when(F.col("t").contains(F.col("quote")), 1).when((F.length(plain) >= 3) & text.contains(plain), 2).when((F.length(plain) >= 12) & text.contains(half), 3)
    distance = F.abs(F.col("block_no") - F.col("b0"))
    return F.when(stage.isNotNull(), F.struct(stage.alias("stage"), F.least(distance, F.lit(3)).alias("rank"), F.col("block_no").alias("block_no"), distance.alias("distance")))


def seg_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each segment."""
    place = F.row_number().over(Window.partitionBy("book_id", "seg").orderBy(F.desc_nulls_last("done_at"), F.desc_nulls_last("model")))
    return table(spark, sf_dir, "segs").withColumn("k", place).where("k = 1").select("book_id", "seg", "o0", "o1", "state", "model")


def frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position up to which every segment of a book is done, and records of the log beyond it."""
    last = seg_latest(spark, sf_dir)
    ends = last.groupBy("book_id").agg(F.coalesce(F.min(F.when(F.col("state") != "done", F.col("o0"))), F.max("o1")).alias("frontier"))
    log = table(spark, sf_dir, "kg_log").select("book_id", "rec_id", "p").where("p is not null").distinct()
    beyond = log.join(ends, "book_id").where("p > frontier").groupBy("book_id").agg(F.count(F.lit(1)).alias("beyond"))
    return ends.join(beyond, "book_id", "left").select("book_id", "frontier", F.coalesce("beyond", F.lit(0)).cast("long").alias("beyond"))


def model_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each model: number, median and longest span, share of stale counts."""
    span = F.col("o1") - F.col("o0")
    return seg_latest(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("segments"), F.percentile(span, F.lit(0.5)).alias("median"), F.max(span).alias("longest"), F.countDistinct("book_id").alias("books"))


def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, minutes and cost range of every book, by its length and script."""
    units = F.coalesce("len", F.lit(0)) * F.when(F.col("lang") == "zh", 1.0).otherwise(0.35) / 10_000
    return table(spark, sf_dir, "books").select("book_id", F.round(units * 38_000, 3).alias("tokens_in"), F.round(units * 16_000, 3).alias("tokens_out"), F.round(units * 0.46, 6).alias("minutes"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each distinct text, preferring curated sources, with its copies."""
    rank = F.when(F.col("source").isin("chapters", "recaps", "sagas", "bios"), 0).when(F.col("source").isNull(), 2).otherwise(1)
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), rank.alias("rank"))
    return docs.groupBy("sha").agg(F.min(F.struct("rank", "doc_id")).alias("m"), F.count(F.lit(1)).alias("copies")).select(F.col("m.doc_id").alias("doc_id"), "sha", "copies")


def book_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, dev and test by the hash of the book (or of the text, where there is none), so that no book is in two; of equal texts the held-out one stays."""
    unit = F.coalesce("book_id", F.sha2(F.coalesce("text", F.lit("")), 256))
    bucket = F.conv(F.substring(F.sha2(unit, 256), 1, 8), 16, 10).cast("long") % 10
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.when(bucket == 0, 0).when(bucket == 1, 1).otherwise(2).alias("r"))
    kept = docs.groupBy("sha").agg(F.min(F.struct("r", "doc_id")).alias("m"))
    return kept.select(F.col("m.doc_id").alias("doc_id"), F.element_at(F.array(F.lit("test"), F.lit("dev"), F.lit("train")), F.col("m.r") + 1).alias("split"))


def capped_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to fifty documents of each source and language, in the order of a hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("lang", F.lit("?")).alias("lang"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    # Smallest hashes by an aggregate that combines before the shuffle would need arrays; a salted first cut keeps hot classes out of one task.
    salted = docs.withColumn("salt", F.substring("h", -1, 1)).withColumn("k", F.row_number().over(Window.partitionBy("source", "lang", "salt").orderBy("h"))).where("k <= 50")
    return salted.withColumn("k", F.row_number().over(Window.partitionBy("source", "lang").orderBy("h"))).where("k <= 50").select("doc_id", "source", "lang")


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, by language and by both."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    return docs.groupingSets([["source"], ["lang"], ["source", "lang"]], "source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))


def grey_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of middling length three times, others once: repetition by copies in the row."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.when(F.col("n_chars").between(300, 700), 3).otherwise(1).alias("times"))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))).alias("copy"))


QUERIES = {
    "block_offsets": block_offsets,
    "chapter_spans": chapter_spans,
    "chapter_kinds": chapter_kinds,
    "thin_books": thin_books,
    "segment_texts": segment_texts,
    "packed_segments": packed_segments,
    "long_chapters": long_chapters,
    "doc_scripts": document_scripts,
    "doc_language": document_language,
    "doc_clean": clean_documents,
    "doc_headings": headings,
    "doc_search": search_hits,
    "question_grams": question_grams,
    "retrieved_paragraphs": retrieved,
    "anchored_quotes": anchored_quotes,
    "seg_latest": seg_latest,
    "frontiers": frontiers,
    "model_bench": model_bench,
    "cost_estimates": cost_estimates,
    "doc_exact_duplicates": exact_duplicates,
    "doc_book_splits": book_splits,
    "doc_capped_classes": capped_classes,
    "doc_composition": composition,
    "doc_grey_boost": grey_boost,
}

_U = U16.format("coalesce(t, '')")
_KINDS = f"""h as (select book_id, chapter_no, arg_min(t, block_no) filter (where k = 'h') as title, min(o) as o0, max(o + {_U}) as o1 from blocks group by 1, 2),
b as (select *, not (coalesce(regexp_matches(title, '{FRONT}'), false) or o1 - o0 < 300) as is_body, coalesce(regexp_matches(title, '{BACK}'), false) as is_back from h),
kinds as (select book_id, chapter_no, case when not bool_or(is_body) over (partition by book_id order by chapter_no) then 'front' when bool_and(is_back) over (partition by book_id order by chapter_no rows between current row and unbounded following) then 'back' else 'body' end as kind from b)"""
_COUNT = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"
_SCRIPTS = {"latin": "A-Za-z", "cjk": r"\x{3400}-\x{9fff}", "kana": r"\x{3040}-\x{30ff}", "cyrillic": r"\x{0400}-\x{04ff}"}
_LAST = "last as (select book_id, seg, o0, o1, state, model from segs qualify row_number() over (partition by book_id, seg order by done_at desc nulls last, model desc nulls last) = 1)"

ORACLES = {
    "block_offsets": f"select book_id, block_no, cast(coalesce(sum({_U} + 1) over (partition by book_id order by block_no rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", o from blocks",
    "chapter_spans": f"select book_id, chapter_no, min(block_no) as b0, max(block_no) + 1 as b1, min(o) as o0, max(o + {_U}) as o1, count(*) filter (where k = 'img') as images, lead(min(o)) over (partition by book_id order by min(o)) as next_o0 from blocks group by 1, 2",
    "chapter_kinds": f"with {_KINDS} select * from kinds",
    "thin_books": f"with {_KINDS}, c as (select book_id, count(*) as n from kinds where kind = 'body' group by 1) select book_id, coalesce(n, 0) as chapters, coalesce(len, 0) < 30000 or coalesce(n, 0) < 2 as thin from books left join c using (book_id)",
    "doc_scripts": "select doc_id, " + U16.format("text") + " as units, " + ", ".join(_COUNT.format("text", r) + f" as {n}" for n, r in _SCRIPTS.items()) + " from documents where text is not null",
    "doc_clean": r"""with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '[ \t\r\n\x{a0}]+', ' ', 'g'), '^[ \x{3000}]+|[ \x{3000}]+$', '', 'g') as c from documents where text is not null)
    select doc_id, length(c) as chars, md5(c) as md5 from c""",
    "doc_search": f"select doc_id, (length(text) - length(replace(lower(text), '{TERM}', ''))) // {len(TERM)} as hits, strpos(lower(text), '{TERM}') as first, substr(text, greatest(strpos(lower(text), '{TERM}') - 24, 1), {len(TERM) + 74}) as excerpt from documents where contains(lower(text), '{TERM}')",
    "seg_latest": f"with {_LAST} select * from last",
    "frontiers": f"""with {_LAST}, f as (select book_id, coalesce(min(o0) filter (where state <> 'done'), max(o1)) as frontier from last group by 1), l as (select distinct book_id, rec_id, p from kg_log where p is not null)
    select f.book_id, frontier, count(l.rec_id) as beyond from f left join l on l.book_id = f.book_id and l.p > frontier group by 1, 2""",
    "model_bench": f"with {_LAST} select model, count(*) as segments, quantile_cont(o1 - o0, 0.5) as median, max(o1 - o0) as longest, count(distinct book_id) as books from last group by 1",
    "cost_estimates": "with u as (select book_id, coalesce(len, 0) * case when lang = 'zh' then 1.0::double else 0.35::double end / 10000 as u from books) select book_id, round(u * 38000, 3) as tokens_in, round(u * 16000, 3) as tokens_out, round(u * 0.46::double, 6) as minutes from u",
    "doc_exact_duplicates": """with d as (select doc_id, sha256(text) as sha, case when source in ('chapters', 'recaps', 'sagas', 'bios') then 0 when source is null then 2 else 1 end as r from documents where text is not null)
    select arg_min(doc_id, [r, doc_id]) as doc_id, sha, count(*) as copies from d group by sha""",
    "doc_book_splits": """with d as (select doc_id, sha256(text) as sha, ('0x' || substr(sha256(coalesce(book_id, sha256(coalesce(text, '')))), 1, 8))::bigint % 10 as b from documents where text is not null),
    r as (select doc_id, sha, case b when 0 then 0 when 1 then 1 else 2 end as r from d), m as (select sha, arg_min(doc_id, [r, doc_id]) as doc_id, min(r) as r from r group by 1) select doc_id, ['test', 'dev', 'train'][r + 1] as split from m""",
    "doc_capped_classes": "select doc_id, coalesce(source, '?') as source, coalesce(lang, '?') as lang from documents qualify row_number() over (partition by coalesce(source, '?'), coalesce(lang, '?') order by sha256(doc_id::varchar)) <= 50",
    "doc_composition": "select source, lang, count(*) as documents, cast(sum(n_chars) as bigint) as chars, cast(grouping(source, lang) as bigint) as level from documents group by grouping sets ((source), (lang), (source, lang))",
    "doc_grey_boost": "select doc_id, unnest(range(1, case when n_chars between 300 and 700 then 4 else 2 end)) as copy from documents where n_chars > 0",
    "segment_texts": f"""with s as (select distinct book_id, seg, o0, o1 from segs), x as (select s.book_id, seg, o1, o, coalesce(t, '') as t from s join blocks b on b.book_id = s.book_id and b.o >= s.o0 and b.o < s.o1),
    g as (select book_id, seg, max(o1) as o1, string_agg(t, chr(10) order by o) as text from x group by 1, 2) select book_id, seg, {U16.format('text')} as units, md5(text) as md5 from g""",
}
_CUT = f"cu as (select book_id, cast(floor(max(p) * {SHARE}) as bigint) as pos from kg_log group by 1)"
# The text of the one paragraph that the position cuts: the longest prefix that has no more units than are left.
_READ = f"""{_CUT}, rd0 as materialized (select book_id, o, t, {_U} as u, pos - o as want from blocks join cu using (book_id) where k = 'p' and length(t) >= 8 and o < pos), ct as materialized (select * from rd0 where u > want),
rd as materialized (select book_id, o, t from rd0 where u <= want union all select book_id, o, substr(t, 1, coalesce(list_max(list_filter(range(greatest(want - length(regexp_replace(substr(t, 1, want), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) - 1, 0), want + 1), lambda i: i + length(regexp_replace(substr(t, 1, i), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= want)), 0)) from ct)"""
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS.split())
_G = "g as (select distinct book_id, o, length(t) as len, replace(lower(unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z''’]{2,}'))), '’', '''') as gram from rd)"
_Q = "q as (select distinct gram from (select unnest(string_split('" + " ".join((QUESTION, *NAMES)) + f"', ' ')) as gram) where length(gram) >= 3 and gram not in ({_STOPS})), nm as (select unnest(string_split('" + " ".join(NAMES) + "', ' ')) as gram)"
ORACLES["question_grams"] = f"with {_READ}, {_Q}, {_G} select gram, count(*) as blocks from g join q using (gram) group by 1"
ORACLES["retrieved_paragraphs"] = f"""with {_READ}, {_Q}, {_G}, h as (select g.* from g join q using (gram)), n as (select book_id, count(*) as n from rd group by 1),
w as (select book_id, gram, ln(1 + n / (1 + df)) * case when gram in (select gram from nm) then 1.5::double else 1 end as w from (select book_id, gram, count(*) as df from h group by 1, 2) join n using (book_id)),
s as (select book_id, o, round(sum(w) / (1 + 0.002 * len), 6) as score from h join w using (book_id, gram) group by book_id, o, len), tp as (select * from s qualify row_number() over (partition by book_id order by score desc, o desc) <= {PARAGRAPHS}),
sl as (select n.book_id, n, {PARAGRAPHS} - count(tp.o) as slots from n left join tp using (book_id) group by 1, 2), ix as (select distinct book_id, unnest(list_transform(range(0, least(slots, n)), lambda i: round_even(i * (n - 1) / greatest(1, slots - 1), 0)::bigint + 1)) as i from sl where slots > 0),
rk as (select book_id, o, row_number() over (partition by book_id order by o) as i from rd), al as (select * from tp union all select rk.book_id, o, 0 from rk join ix using (book_id, i) where not exists (select 1 from tp where tp.book_id = rk.book_id and tp.o = rk.o))
select book_id, o, score, row_number() over (partition by book_id order by o) as place from al"""
_MARKS = X.MARKS.replace("'", "''")
_N = "regexp_replace({0}, '" + _MARKS.replace("{", "{{").replace("}", "}}") + "', '', 'g')"
ORACLES["anchored_quotes"] = f"""with qt as (select distinct rec_id, book_id, s, quote, {_N.format('quote')} as plain from kg_log where t = 'rel' and trim(quote) <> '' and s is not null),
b as materialized (select book_id, block_no, o, coalesce(t, '') as t, {_N.format("coalesce(t, '')")} as bare, o + {_U} + 1 as e from blocks), at_ as (select rec_id, qt.book_id, quote, plain, block_no as b0, o as bo from qt join b on b.book_id = qt.book_id and o <= s and s < e),
sg as (select distinct book_id, seg, o0, o1 from segs), ca as (select at_.*, b.block_no from at_ join b on b.book_id = at_.book_id and b.block_no between b0 - 2 and b0 + 2
  union select at_.*, b.block_no from at_ join sg on sg.book_id = at_.book_id and o0 <= bo and bo <= o1 join b on b.book_id = at_.book_id and o0 <= b.o and b.o <= o1),
r as (select rec_id, ca.book_id, quote, plain, abs(ca.block_no - b0) as distance, ca.block_no, case when contains(t, quote) then 1 when length(plain) >= 3 and contains(bare, plain) then 2 when length(plain) >= 12 and contains(bare, substr(plain, 1, length(plain) // 2)) then 3 end as stage from ca join b on b.book_id = ca.book_id and b.block_no = ca.block_no),
k as (select * from r where stage is not null qualify row_number() over (partition by rec_id order by stage, least(distance, 3), block_no, distance) = 1),
p as (select k.*, o, t, case when stage = 1 then quote else regexp_extract(t, array_to_string(list_transform(string_split(case when stage = 3 then substr(plain, 1, length(plain) // 2) else plain end, ''), lambda c: regexp_escape(c)), '{_MARKS}*')) end as part from k join b using (book_id, block_no))
select rec_id, stage, distance, block_no, o + {U16.format("substr(t, 1, strpos(t, part) - 1)")} as start, o + {U16.format("substr(t, 1, strpos(t, part) - 1)")} + {U16.format('part')} as "end" from p"""

# RE2 knows no Unicode word bounds: letters beside the word are ruled out one by one, and every blank counts for both its neighbours.
_WORDY = r"\p{L}\p{M}\p{N}_"
_PADDED = rf"' ' || regexp_replace(lower(text), '([^{_WORDY}])', '\1\1', 'g') || ' '"
_LANG = ", ".join(rf"len(regexp_extract_all(pad, '[^{_WORDY}]{p.replace(chr(92) + 'b', '')}[^{_WORDY}]')) as n{i}" for i, p in enumerate(X.LANGUAGE_WORDS.values()))
_BEST = "greatest(" + ", ".join(f"n{i}" for i in range(len(X.LANGUAGE_WORDS))) + ")"
ORACLES["doc_language"] = f"""with d as (select doc_id, {_PADDED} as pad, {", ".join(_COUNT.format("text", r) + f" as {n}" for n, r in _SCRIPTS.items())} from documents where text is not null), c as (select *, {_LANG} from d)
select doc_id, case when kana > greatest(200.0, cjk * 0.05) then 'ja' when cjk > 200 and cjk > latin / 20 then 'zh' when {_BEST} >= {X.LEAST_WORDS} then case {" ".join(f"when n{i} = {_BEST} then '{code}'" for i, code in enumerate(X.LANGUAGE_WORDS))} end when cyrillic > 200 then 'ru' else 'en' end as detected from c"""
ORACLES["doc_headings"] = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as heading, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents where text is not null)
select doc_id, line, heading from l where {U16.format('heading')} <= {X.HEADING_UNITS} and regexp_matches(lower(heading), '{X.HEADING}')"""
ORACLES["packed_segments"] = f"""with recursive b as materialized (select book_id, chapter_no, block_no, o, {_U} as n, case when lang = 'zh' then 3200 else 9000 end as most, row_number() over (partition by book_id, chapter_no order by block_no) as i from blocks join books using (book_id) where k <> 'img' and t <> ''),
w(book_id, chapter_no, i, part, size) as (select book_id, chapter_no, i, 0, n from b where i = 1 union all select b.book_id, b.chapter_no, b.i, w.part + case when w.size > 0 and w.size + n > most then 1 else 0 end, case when w.size > 0 and w.size + n > most then n else w.size + n end from w join b on b.book_id = w.book_id and b.chapter_no = w.chapter_no and b.i = w.i + 1)
select book_id, chapter_no, part::bigint as part, min(block_no) as first_block, max(block_no) as last_block, arg_min(o, block_no) as o0, arg_max(o + n, block_no) as o1, cast(sum(n) as bigint) as units from w join b using (book_id, chapter_no, i) group by 1, 2, 3"""
ORACLES["long_chapters"] = f"""with recursive b as materialized (select book_id, chapter_no, block_no, o, {_U} as n, row_number() over (partition by book_id, chapter_no order by block_no) as i, last_value(o + {_U}) over w - first_value(o) over w > 36000 as long from blocks window w as (partition by book_id, chapter_no order by block_no rows between unbounded preceding and unbounded following)),
w(book_id, chapter_no, i, section, size) as (select book_id, chapter_no, i, 0, n + 1 from b where i = 1 union all select b.book_id, b.chapter_no, b.i, w.section + (w.size >= 12000)::int, case when w.size >= 12000 then 0 else w.size end + n + 1 from w join b on b.book_id = w.book_id and b.chapter_no = w.chapter_no and b.i = w.i + 1)
select book_id, chapter_no, (case when long then section else 0 end)::bigint as section, arg_min(o, block_no) as o0, arg_max(o + n, block_no) as o1 from w join b using (book_id, chapter_no, i) group by 1, 2, 3"""
