"""Queries on records as they are kept: references, owners of mentions, versions, caches, batches, exports, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions.replace import purified
from tidemark.functions.text import u16_length
from tidemark.functions.words import strict_slice
from tidemark.operators import fold
from tidemark.operators.running import ranked, within_spans
from tidemark.plans import name_sql as sql
from tidemark.plans.log import CHAPTERS, LG, U16, WORLD, _chapters, _log
from tidemark.plans.rules import _MENTIONS, _mentions
from tidemark.session import cut
from tidemark.sources.tables import log_records, table

RULES = [("lantern", "lamp"), ("silver whistle", "whistle"), ("灯笼", "灯")]
# What a comment may begin with, and what shows that it is none.
COMMENT_LABEL, NO_COMMENT = r"^\s*(?:批注|评论|弹幕|短评)\s*[：:]\s*", "(?i)Markdown|JSON|系统提示"
OUTCOMES = "(?i)死|亡|遇害|被捕|真凶|结婚|成亲|复活|大结局|death|dies|murder|wedding|marri|betray|the end"
PAGE, MOST_RELATIONS, KEPT_REQUESTS, KEPT_RECEIPTS, KEPT_DRAFTS, PUBLISHED, AROUND = 1_800, 120, 2_000, 100, 120, 3, 60


def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that records refer to and that no record introduces, with the number of their records."""
    log = log_records(spark, sf_dir, "event", "rel", "merge", "attr", "alias", "name", "profile", "imp").select("book_id", "rec_id", F.explode(F.array_distinct(F.concat(F.array("id", "a", "b", "from_id", "into_id"), F.coalesce("who", F.array().cast("array<string>"))))).alias("id"))
    known = log_records(spark, sf_dir, "person").select("book_id", "id").distinct()
    return log.where("id is not null").distinct().join(known, ["book_id", "id"], "left_anti").groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("records"))


def wrong_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several persons still bear after merges, and how many persons unite known genders that differ."""
    log = _log(spark, sf_dir, "person", "name", "alias", "profile", "imp", "cnt", "merge")
    rows = cut(fold.members(cut(fold.people(log)), cut(fold.merge_map(log))).select("book_id", "id", "to"))
    named = log.where("t in ('person', 'name', 'alias')").select("book_id", "id", F.coalesce("name", "alias").alias("name")).where("trim(name) <> ''").distinct().join(rows, ["book_id", "id"])
    double = named.where(~N.is_generic(F.col("name"))).groupBy("book_id", "name").agg(F.countDistinct("to").alias("n")).where("n >= 2").groupBy("book_id").agg(F.count(F.lit(1)).alias("double_names"))
    genders = log.where("t = 'person' and trim(gender) <> ''").select("book_id", "id", "gender").distinct().join(rows, ["book_id", "id"]).groupBy("book_id", "to").agg(F.countDistinct("gender").alias("n")).where("n >= 2").groupBy("book_id").agg(F.count(F.lit(1)).alias("mixed"))
    return double.join(genders, "book_id", "full").select("book_id", F.coalesce("double_names", F.lit(0)).alias("double_names"), F.coalesce("mixed", F.lit(0)).alias("mixed"))


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that each model was given, units read, and how many are not done."""
    return table(spark, sf_dir, "segs").groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("o1") - F.col("o0")).alias("units"), F.count(F.when(F.col("state") != "done", 1)).alias("open"))


def heading_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of headings of each book that may divide it: three or more, reaching past its middle; the plainest and most frequent first."""
    kind = F.when(F.col("t").rlike(r"(?i)^chapter|^chapitre|^第.+章"), "chapter").when(F.col("t").rlike(r"(?i)^part|^第.+[部卷]"), "part").when(F.col("t").rlike(r"^[IVXLC]+\.?$|^\d+\.?$"), "number").when(F.upper("t") == F.col("t"), "shouted").otherwise("other")
    blocks = table(spark, sf_dir, "blocks")
    sizes = blocks.groupBy("book_id").agg(F.max("block_no").alias("last"))
    heads = blocks.where("k = 'h'").select("book_id", "block_no", kind.alias("kind")).groupBy("book_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("block_no").alias("reach")).join(sizes, "book_id")
    fit = heads.where("n >= 3 and reach * 2 >= last")
    return fit.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy((F.col("kind") == "shouted").cast("int"), F.desc("n"), "kind")).cast("long")).select("book_id", "kind", "n", "place")


def heading_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with the last heading one level above them."""
    order = Window.partitionBy("book_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    above = {d: F.last(F.when(F.col("level") == d, F.col("t")), ignorenulls=True).over(order) for d in range(1, 6)}
    rows = table(spark, sf_dir, "blocks").where("k = 'h'").withColumns({f"_l{d}": c for d, c in above.items()})
    return rows.select("book_id", "block_no", "level", F.coalesce(*(F.when(F.col("level") == d + 1, F.col(f"_l{d}")) for d in above)).alias("parent"))


def relation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred and twenty relations of each book that were told of last, without ended ones."""
    rows = fold.relations(_log(spark, sf_dir, "rel"))
    now = rows.groupBy("book_id", "a", "b").agg(fold.newest("status").alias("status"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("records")).where("status is null or status <> 'ended'")
    return now.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("seq"), "a", "b")).cast("long")).where(F.col("place") <= MOST_RELATIONS).select("book_id", "a", "b", "records", "place")


def first_real_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons whose introduction gives no name of their own, with the first real name or alias after it."""
    log = _log(spark, sf_dir, "person", "name", "alias")
    first = log.where("t = 'person'").groupBy("book_id", "id").agg(F.min_by("name", "seq").alias("shown"), F.min("seq").alias("seq0")).where(N.is_generic(F.col("shown")) | F.col("shown").rlike("(?i)^(the|le|la|l') ?"))
    later = log.where("t in ('name', 'alias')").select("book_id", "id", "rec_id", "seq", F.coalesce("name", "alias").alias("name")).where(~N.is_generic(F.col("name")) & ~F.col("name").rlike("(?i)^(the|le|la|l') ?"))
    named = later.join(first, ["book_id", "id"]).where("seq >= seq0").groupBy("book_id", "id").agg(F.min_by("name", F.struct("seq", "rec_id")).alias("real"))
    return first.join(named, ["book_id", "id"], "left").select("book_id", "id", "shown", "real")


def mention_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who each mention of a name means: of its bearers those whom the reader knows at the place, the one mentioned most; null where none is known yet."""
    from tidemark.plans.naming import _named, _people

    people = _people(spark, sf_dir).select("book_id", "id", "first", "mentions")
    owners = _named(spark, sf_dir).join(people, ["book_id", "id"])
    hits = _mentions(spark, sf_dir).select("book_id", "block_no", "name", "at")
    known = hits.join(owners, ["book_id", "name"], "left")
    return known.groupBy("book_id", "block_no", "name").agg(F.min_by("id", F.when(F.col("first") <= F.col("at"), F.struct(-F.col("mentions"), "id"))).alias("owner"), F.count("id").alias("bearers"))


def pending_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose newest record differs from what was checked first: their checks are due again."""
    print_ = F.sha2(F.concat_ws("|", F.col("o0").cast("string"), F.col("o1").cast("string"), F.coalesce("lang", F.lit("?")), F.coalesce("model", F.lit("?")), F.coalesce("mode", F.lit("?"))), 256)
    rows = table(spark, sf_dir, "segs").select("book_id", "seg", "done_at", print_.alias("print"))
    order = F.struct(F.coalesce(F.unix_micros(F.col("done_at").cast("timestamp")), F.lit(-1)), "print")
    return rows.groupBy("book_id", "seg").agg(F.min_by("print", order).alias("checked"), F.max_by("print", order).alias("newest")).where("checked <> newest").select("book_id", "seg", "newest")


def manual_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reader may anchor each name: its first occurrence that ends at or before the reader's position."""
    ends = fold.cutoffs(table(spark, sf_dir, "kg_log").select("book_id", "p"), 0.6)
    return _mentions(spark, sf_dir).join(ends, "book_id").where("end <= pos").groupBy("book_id", "name").agg(F.min("at").alias("at"), F.min("end").alias("end"))


def visible_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each profile: how many a reader sees, the newest of these, and whether later ones are still locked."""
    ends = fold.cutoffs(table(spark, sf_dir, "kg_log").select("book_id", "p"), 0.6)
    rows = log_records(spark, sf_dir, "profile").where("p is not null and id is not null").select("book_id", "id", "rec_id", "p", F.coalesce("ord", F.lit(-1)).alias("ord")).distinct().join(ends, "book_id")
    seen = F.col("p") <= F.col("pos")
    return rows.groupBy("book_id", "id").agg(F.count(F.when(seen, 1)).alias("visible"), F.max_by("rec_id", F.when(seen, F.struct("p", "ord", "rec_id"))).alias("newest"), F.max((~seen).cast("int")).alias("locked"))


def kept_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers kept by the content of their request: the newest of each content, of these the last two thousand.

    The last ones are cut in parts by hash first, so no task sorts them all.
    """
    rows = table(spark, sf_dir, "events").withColumn("key", F.sha2(F.concat_ws("|", "event_type", "props"), 256)).groupBy("key").agg(F.max("event_id").alias("event_id"))
    part = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("key"), F.lit(16))).orderBy(F.desc("event_id")))
    return rows.withColumn("k", part).where(F.col("k") <= KEPT_REQUESTS).drop("k").orderBy(F.desc("event_id")).limit(KEPT_REQUESTS)


def resumed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred receipts of each user after a restart: what was under way is interrupted."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    state = F.when(F.col("event_type").isin("view", "click"), "interrupted").when(F.col("event_type") == "error", "failed").otherwise("done")
    return table(spark, sf_dir, "events").where("user_id is not null").withColumn("place", place.cast("long")).where(F.col("place") <= KEPT_RECEIPTS).select("user_id", "event_id", "place", state.alias("state"))


def merged_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two drafts in one: each content once, the last hundred and twenty of each user."""
    one = table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id", "event_type", "props").agg(F.max("event_id").alias("event_id"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).cast("long")).where(F.col("place") <= KEPT_DRAFTS).select("user_id", "event_id", "place")


def publish_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of three finished segments of each book in their order: first, last, and whether the batch is full."""
    done = table(spark, sf_dir, "segs").where("state = 'done'").select("book_id", "seg").distinct()
    rows = ranked(done, ["book_id"], "seg", [], "n").withColumn("batch", F.floor((F.col("n") - 1) / PUBLISHED))
    return rows.groupBy("book_id", "batch").agg(F.min("seg").alias("first"), F.max("seg").alias("last"), (F.count(F.lit(1)) == PUBLISHED).alias("whole"))


def open_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that may be worked on: every segment of all earlier ones is settled."""
    chapters = table(spark, sf_dir, "segs").groupBy("book_id", "chapter_no").agg(F.min((F.col("state") == "done").cast("int")).alias("settled"))
    before = F.min("settled").over(Window.partitionBy("book_id").orderBy("chapter_no").rowsBetween(Window.unboundedPreceding, -1))
    return chapters.select("book_id", "chapter_no", (F.col("settled") == 1).alias("settled"), (F.coalesce(before, F.lit(1)) == 1).alias("open"))


def event_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text around the place of each event: sixty units before and after within its block, where both bounds keep surrogate pairs whole."""
    events = log_records(spark, sf_dir, "event").where("s is not null").select("book_id", "rec_id", "s").distinct()
    blocks = table(spark, sf_dir, "blocks").where("t <> ''").select("book_id", "o", "t").withColumn("end", F.col("o") + u16_length(F.col("t")))
    at = within_spans(events, blocks, "book_id", "s", "o", "end")
    start, end = F.greatest(F.col("s") - F.col("o") - AROUND, F.lit(0)), F.least(F.col("s") - F.col("o") + AROUND, F.col("end") - F.col("o"))
    return at.where(~F.col("t").rlike(r"[\x{10000}-\x{10FFFF}]")).select("rec_id", strict_slice(F.col("t"), start, end).alias("context"))


def newest_bios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The biography of each person in force: the newest by position that is not blank, never one that a judge would flag as cut off."""
    rows = _log(spark, sf_dir, "profile").where("trim(bio) <> ''").where(~F.col("bio").rlike(r"(?:\.\.\.|…)\s*$"))
    return rows.groupBy("book_id", "id").agg(F.max_by("bio", F.struct("p", "seq", "rec_id")).alias("bio"))


def kept_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wordings of relations that are kept: the quote stands in the block at its place, blanks apart."""
    quotes = log_records(spark, sf_dir, "rel").where("trim(quote) <> '' and s is not null and trim(rel_desc) <> ''").select("rec_id", "book_id", "s", "quote", "rel_desc").distinct()
    blocks = table(spark, sf_dir, "blocks").where("t <> ''").select("book_id", "o", "t").withColumn("end", F.col("o") + u16_length(F.col("t")))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    at = within_spans(quotes, blocks, "book_id", "s", "o", "end")
    return at.select("rec_id", F.when(bare("t").contains(bare("quote")), F.col("rel_desc")).alias("wording"))


def state_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes in force of each person as text, key by key: length and hash."""
    rows = fold.current_attributes(_log(spark, sf_dir, "person", "attr")).where("trim(value) <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: F.concat(F.lit("["), x["key"], F.lit("]\n"), x["value"])), "\n\n")
    return rows.groupBy("book_id", "id").agg(text.alias("x")).select("book_id", "id", F.length("x").cast("long").alias("chars"), F.md5("x").alias("md5"))


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by page of 1,800 units of their chapter's text."""
    events = log_records(spark, sf_dir, "event").where("p is not null").select("book_id", "rec_id", "p").distinct()
    placed = within_spans(events, _chapters(spark, sf_dir), "book_id", "p", "o0", "end")
    return placed.groupBy("book_id", "chapter_no", F.floor((F.col("p") - F.col("o0")) / PAGE).alias("page")).agg(F.count(F.lit(1)).alias("events"))


def purified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after literal rules, as hash; only texts that hold one go through Python."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    holds = F.col("text").rlike("|".join(a for a, _ in RULES))
    return docs.select("doc_id", F.md5(F.when(holds, purified(F.when(holds, F.col("text")), RULES)).otherwise(F.col("text"))).alias("md5"))


def clean_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader notes as comments: without label and fences, in one line of 160 characters; empty where they have under six ideographs, end on a comma or colon, or are prompts."""
    text = F.regexp_replace(F.trim("text"), COMMENT_LABEL, "")
    text = F.regexp_replace(text, "(?s)```.*?```", "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", ""))), lambda x: x != "")
    text = F.substring(F.regexp_replace(F.array_join(lines, " "), '^[“”"]+|[“”"]+$', ""), 1, 160)
    fits = (F.regexp_count(text, F.lit(N.HAN)) >= 6) & ~text.rlike("[，,：:]$") & ~text.rlike(NO_COMMENT)
    return table(spark, sf_dir, "documents").where("source = 'reader_notes' and text is not null").select("doc_id", F.when(fits, text).otherwise(F.lit("")).alias("comment"))


def safe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter titles beyond the reader's position that tell of an outcome are concealed."""
    ends = fold.cutoffs(table(spark, sf_dir, "kg_log").select("book_id", "p"), 0.6)
    rows = table(spark, sf_dir, "blocks").where("k = 'h'").join(ends, "book_id")
    hidden = (F.col("o") > F.col("pos")) & F.col("t").rlike(OUTCOMES)
    return rows.select("book_id", "block_no", F.when(hidden, F.lit(None)).otherwise(F.col("t")).alias("title"))


def note_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader notes as Markdown entries under their book: one per note, newest first; length and hash of each with its place."""
    books = table(spark, sf_dir, "books").select("book_id", "title")
    rows = table(spark, sf_dir, "documents").where("source = 'reader_notes' and trim(text) <> ''").select("doc_id", "book_id", "text", "fetched_at").join(books, "book_id", "left")
    entry = F.concat(F.lit("## "), F.coalesce("title", F.lit("?")), F.lit("\n\n> "), F.regexp_replace(F.trim("text"), "\r?\n", "\n> "), F.lit("\n"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc_nulls_last("fetched_at"), "doc_id"))
    return rows.select("doc_id", "book_id", place.cast("long").alias("place"), F.md5(entry).alias("md5"))


def offline_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader needs offline of each book: number of chapters, images, units, and a fingerprint of the block offsets."""
    blocks = table(spark, sf_dir, "blocks")
    own = blocks.groupBy("book_id").agg(F.countDistinct("chapter_no").alias("chapters"), F.countDistinct(F.when(F.trim("src") != "", F.col("src"))).alias("images"), F.max(F.col("o") + u16_length(F.coalesce("t", F.lit("")))).alias("units"), F.sum(F.pmod(F.col("block_no") * 1_000_003 + F.col("o"), F.lit(1_000_000_007))).alias("mark"))
    return table(spark, sf_dir, "books").select("book_id").join(own, "book_id", "left").na.fill(0, ["chapters", "images", "units", "mark"])


def encoded_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets by name in Base64, and whether decoding gives the name back."""
    from tidemark.plans.reading import used_assets

    coded = used_assets(spark, sf_dir).withColumn("code", F.base64(F.encode("asset", "UTF-8")))
    return coded.select("book_id", "asset", "code", (F.decode(F.unbase64("code"), "UTF-8") == F.col("asset")).alias("same"))


QUERIES = {
    "dangling_references": dangling_references,
    "wrong_merges": wrong_merges,
    "usage_by_model": usage_by_model,
    "heading_kinds": heading_kinds,
    "heading_parents": heading_parents,
    "relation_memory": relation_memory,
    "first_real_names": first_real_names,
    "mention_owners": mention_owners,
    "pending_segments": pending_segments,
    "manual_anchors": manual_anchors,
    "visible_versions": visible_versions,
    "kept_requests": kept_requests,
    "resumed_receipts": resumed_receipts,
    "merged_drafts": merged_drafts,
    "publish_batches": publish_batches,
    "open_chapters": open_chapters,
    "event_contexts": event_contexts,
    "newest_bios": newest_bios,
    "kept_wordings": kept_wordings,
    "state_texts": state_texts,
    "event_pages": event_pages,
    "doc_purified": purified_documents,
    "clean_comments": clean_comments,
    "safe_titles": safe_titles,
    "note_exports": note_exports,
    "offline_manifest": offline_manifest,
    "encoded_assets": encoded_assets,
}

_L = LG.rstrip().rstrip(",")
_ARTICLE = "regexp_matches({0}, '(?i)^(the|le|la|l'') ?')"
_EVENTS = "(select distinct book_id, rec_id, p from kg_log where t = 'event' and p is not null)"
_POS = "cu as (select book_id, cast(floor(max(p) * 0.6) as bigint) as pos from kg_log group by 1)"
_BLOCK = f"b as materialized (select book_id, o, t, o + {U16.format('t')} as e from blocks where t <> '')"
_PURE = "text"
for _a, _b in RULES:
    _PURE = f"replace({_PURE}, '{_a}', '{_b}')"
_COMMENT = rf"""regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(text), '{COMMENT_LABEL}', ''), '(?s)```.*?```', '', 'g'), chr(10)), lambda x: trim(replace(x, chr(13), ''))), lambda x: x <> ''), ' '), '^[“”"]+|[“”"]+$', '', 'g')"""

ORACLES = {
    "dangling_references": """with r as (select distinct book_id, rec_id, unnest(list_concat([id, a, b, from_id, into_id], coalesce(who, []))) as id from kg_log where t in ('event', 'rel', 'merge', 'attr', 'alias', 'name', 'profile', 'imp'))
    select book_id, id, count(*) as records from r where id is not null and not exists (select 1 from kg_log k where k.t = 'person' and k.book_id = r.book_id and k.id = r.id) group by 1, 2""",
    "wrong_merges": WORLD
    + f""", nm as (select distinct r.book_id, r.dest, coalesce(lg.name, alias) as name from lg join r using (book_id, id) where t in ('person', 'name', 'alias') and trim(coalesce(lg.name, alias)) <> ''),
    dd as (select book_id, count(*) as n from (select book_id, name from nm where not {sql.generic('name')} group by 1, 2 having count(distinct dest) >= 2) group by 1), gg as (select book_id, count(*) as n from (select r.book_id, r.dest from lg join r using (book_id, id) where t = 'person' and trim(gender) <> '' group by 1, 2 having count(distinct gender) >= 2) group by 1)
    select book_id, coalesce(dd.n, 0) as double_names, coalesce(gg.n, 0) as mixed from dd full join gg using (book_id)""",
    "usage_by_model": "select model, count(*) as calls, cast(sum(o1 - o0) as bigint) as units, count(*) filter (where state <> 'done') as open from segs group by 1",
    "heading_kinds": r"""with h as (select book_id, block_no, case when regexp_matches(t, '(?i)^chapter|^chapitre|^第.+章') then 'chapter' when regexp_matches(t, '(?i)^part|^第.+[部卷]') then 'part' when regexp_matches(t, '^[IVXLC]+\.?$|^\d+\.?$') then 'number' when upper(t) = t then 'shouted' else 'other' end as kind from blocks where k = 'h'),
    l as (select book_id, max(block_no) as last from blocks group by 1), g as (select book_id, kind, count(*) as n, max(block_no) as reach from h group by 1, 2) select book_id, kind, n, row_number() over (partition by book_id order by (kind = 'shouted')::int, n desc, kind) as place from g join l using (book_id) where n >= 3 and reach * 2 >= last""",
    "heading_parents": "select h.book_id, h.block_no, h.level, (select arg_max(x.t, x.block_no) from blocks x where x.k = 'h' and x.book_id = h.book_id and x.block_no < h.block_no and x.level = h.level - 1) as parent from blocks h where k = 'h'",
    "relation_memory": _L + f""", rr as (select book_id, least(a, b) as a, greatest(a, b) as b, status, seq from lg where t = 'rel' and a <> b), n as (select book_id, a, b, arg_max(status, seq) filter (where trim(status) <> '') as status, max(seq) as seq, count(*) as records from rr group by 1, 2, 3)
    select book_id, a, b, records, row_number() over (partition by book_id order by seq desc, a, b) as place from n where status is null or status <> 'ended' qualify place <= {MOST_RELATIONS}""",
    "first_real_names": _L + f""", f as (select book_id, id, arg_min(name, seq) as shown, min(seq) as seq0 from lg where t = 'person' group by 1, 2), g as (select * from f where {sql.generic('shown')} or {_ARTICLE.format('shown')}),
    x as (select lg.book_id, lg.id, rec_id, seq, coalesce(name, alias) as name from lg where t in ('name', 'alias')), y as (select x.book_id, x.id, arg_min(name, [seq, rec_id]) as real from x join g on g.book_id = x.book_id and g.id = x.id and seq >= seq0 where not {sql.generic('name')} and not {_ARTICLE.format('name')} group by 1, 2) select book_id, id, shown, real from g left join y using (book_id, id)""",
    "mention_owners": f"""with {_MENTIONS}, pf as (select book_id, id, min(p) as first from kg_log where t = 'person' and id is not null and p is not null group by 1, 2), mc as (select book_id, id, sum(k) as m from (select distinct book_id, rec_id, unnest(map_keys(c)) as id, unnest(map_values(c)) as k from kg_log where t = 'cnt') group by 1, 2),
    ow as (select distinct k.book_id, k.id, coalesce(name, alias) as name, first, coalesce(m, 0) as m from kg_log k join pf on pf.book_id = k.book_id and pf.id = k.id left join mc on mc.book_id = k.book_id and mc.id = k.id where t in ('person', 'name', 'alias') and trim(coalesce(name, alias)) <> '')
    select me.book_id, block_no, me.name, (list(ow.id order by m desc, ow.id) filter (where first <= "at"))[1] as owner, count(ow.id) as bearers from me left join ow on ow.book_id = me.book_id and ow.name = me.name group by 1, 2, 3""",
    "pending_segments": """with p as (select book_id, seg, coalesce(epoch_us(done_at), -1) as u, sha256(concat_ws('|', o0::varchar, o1::varchar, coalesce(lang, '?'), coalesce(model, '?'), coalesce(mode, '?'))) as print from segs), g as (select book_id, seg, (list(print order by u, print))[1] as checked, (list(print order by u desc, print desc))[1] as newest from p group by 1, 2) select book_id, seg, newest from g where checked <> newest""",
    "manual_anchors": f"""with {_MENTIONS}, {_POS} select me.book_id, name, min("at") as "at", min(e) as "end" from me join cu on cu.book_id = me.book_id where e <= pos group by 1, 2""",
    "visible_versions": f"with {_POS}, v as (select distinct k.book_id, id, rec_id, p, coalesce(ord, -1) as ord, pos from kg_log k join cu using (book_id) where t = 'profile' and p is not null and id is not null) select book_id, id, count(*) filter (where p <= pos) as visible, arg_max(rec_id, [p, ord, rec_id]) filter (where p <= pos) as newest, max((p > pos)::int) as locked from v group by 1, 2",
    "kept_requests": f"select sha256(concat_ws('|', event_type, props)) as key, max(event_id) as event_id from events group by 1 order by 2 desc limit {KEPT_REQUESTS}",
    "resumed_receipts": f"select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place, case when event_type in ('view', 'click') then 'interrupted' when event_type = 'error' then 'failed' else 'done' end as state from events where user_id is not null qualify place <= {KEPT_RECEIPTS}",
    "merged_drafts": f"with o as (select user_id, event_type, props, max(event_id) as event_id from events where user_id is not null group by 1, 2, 3) select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as place from o qualify place <= {KEPT_DRAFTS}",
    "publish_batches": f"with d as (select distinct book_id, seg from segs where state = 'done'), n as (select *, (row_number() over (partition by book_id order by seg) - 1) // {PUBLISHED} as batch from d) select book_id, batch, min(seg) as first, max(seg) as last, count(*) = {PUBLISHED} as whole from n group by 1, 2",
    "open_chapters": "with c as (select book_id, chapter_no, min((state = 'done')::int) as settled from segs group by 1, 2) select book_id, chapter_no, settled = 1 as settled, coalesce(min(settled) over (partition by book_id order by chapter_no rows between unbounded preceding and 1 preceding), 1) = 1 as open from c",
    "event_contexts": rf"with {_BLOCK}, v as (select distinct book_id, rec_id, s from kg_log where t = 'event' and s is not null) select rec_id, substr(t, greatest(s - o - {AROUND}, 0) + 1, least(s - o + {AROUND}, e - o) - greatest(s - o - {AROUND}, 0)) as context from v join b on b.book_id = v.book_id and o <= s and s < e where not regexp_matches(t, '[\x{{10000}}-\x{{10FFFF}}]')",
    "newest_bios": _L + r" select book_id, id, arg_max(bio, [p, seq, rec_id]) as bio from lg where t = 'profile' and trim(bio) <> '' and not regexp_matches(bio, '(?:\.\.\.|…)\s*$') group by 1, 2",
    "kept_wordings": rf"with {_BLOCK}, q as (select distinct rec_id, book_id, s, quote, rel_desc from kg_log where t = 'rel' and trim(quote) <> '' and s is not null and trim(rel_desc) <> '') select rec_id, case when contains(regexp_replace(t, '\s+', '', 'g'), regexp_replace(quote, '\s+', '', 'g')) then rel_desc end as wording from q join b on b.book_id = q.book_id and o <= s and s < e",
    "state_texts": _L + """, c as (select book_id, id, lower(trim(attr_key)) as key, nullif(arg_max(coalesce(attr_value, chr(1)), [p, eo, seq, rec_id]), chr(1)) as value from eff where t = 'attr' and attr_key is not null group by 1, 2, 3),
    x as (select book_id, id, string_agg('[' || key || ']' || chr(10) || value, chr(10) || chr(10) order by key, value) as x from c where trim(value) <> '' group by 1, 2) select book_id, id, length(x) as chars, md5(x) as md5 from x""",
    "event_pages": f"with {CHAPTERS} select e.book_id, chapter_no, (p - o0) // {PAGE} as page, count(*) as events from {_EVENTS} e join ch on ch.book_id = e.book_id and ch.o0 <= p and p < ch.e group by 1, 2, 3",
    "doc_purified": f"select doc_id, md5({_PURE}) as md5 from documents where text is not null",
    "clean_comments": f"with c as (select doc_id, substr({_COMMENT}, 1, 160) as c from documents where source = 'reader_notes' and text is not null) select doc_id, case when len(regexp_extract_all(c, '{N.HAN}')) >= 6 and not regexp_matches(c, '[，,：:]$') and not regexp_matches(c, '{NO_COMMENT}') then c else '' end as comment from c",
    "safe_titles": f"with {_POS} select book_id, block_no, case when o > pos and regexp_matches(t, '{OUTCOMES}') then null else t end as title from blocks join cu using (book_id) where k = 'h'",
    "note_exports": r"select doc_id, d.book_id, row_number() over (partition by d.book_id order by fetched_at desc nulls last, doc_id) as place, md5('## ' || coalesce(title, '?') || chr(10) || chr(10) || '> ' || regexp_replace(trim(text), '\r?\n', chr(10) || '> ', 'g') || chr(10)) as md5 from documents d left join books on books.book_id = d.book_id where source = 'reader_notes' and trim(text) <> ''",
    "offline_manifest": f"with o as (select book_id, count(distinct chapter_no) as chapters, count(distinct src) filter (where trim(src) <> '') as images, max(o + {U16.format(chr(99) + 'oalesce(t, ' + chr(39) * 2 + ')')}) as units, cast(sum((block_no * 1000003 + o) % 1000000007) as bigint) as mark from blocks group by 1) select book_id, coalesce(chapters, 0) as chapters, coalesce(images, 0) as images, coalesce(units, 0) as units, coalesce(mark, 0) as mark from books left join o using (book_id)",
    "encoded_assets": "with a as (select book_id, src as asset from blocks where k = 'img' and trim(src) <> '' union select book_id, cover from books where trim(cover) <> '') select book_id, asset, to_base64(encode(asset)) as code, true as same from a",
}
