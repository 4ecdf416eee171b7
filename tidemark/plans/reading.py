"""Queries of a reader's views: relations of a person, graphs, samples, recent text, summaries, comparisons of models, merges of verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import u16_length
from tidemark.operators import fold
from tidemark.operators.contained import names_in_texts
from tidemark.operators.running import ranked, running, sliding, within_spans
from tidemark.plans.log import CARD, CHAPTERS, LG, U16, _chapters, _log, _ranked
from tidemark.plans.log import RANKED as RANKED_SQL
from tidemark.session import cut
from tidemark.sources.tables import log_records, table

RECENT_CHARS, BUFFER, EVENTS_OF_A_DOSSIER, NODES = 900, 12, 45, 30
BIO_EVERY, RECAP_CHARS, SAGA_CHARS = 12_000, 300, 1500


def person_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of each person: the other one, what they are, how many roles they had before; ongoing ones first, then the newest."""
    rows = fold.relations(_log(spark, sf_dir, "rel"))
    now = rows.groupBy("book_id", "a", "b").agg(*(fold.newest(c).alias(c) for c in ("a_is", "b_is", "status")), F.max("seq").alias("seq"), F.countDistinct("a_is").alias("na"), F.countDistinct("b_is").alias("nb"))
    side = lambda me, other, role, n: now.select("book_id", F.col(me).alias("id"), F.col(other).alias("other"), F.col(role).alias("role"), F.col(n).alias("roles"), "status", "seq")
    both = side("a", "b", "b_is", "nb").unionByName(side("b", "a", "a_is", "na"))
    order = Window.partitionBy("book_id", "id").orderBy(F.coalesce(F.col("status") == "ended", F.lit(False)), F.desc("seq"), "other")
    return both.withColumn("place", F.row_number().over(order).cast("long")).drop("seq")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ongoing relations among the thirty most prominent persons of each book."""
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "id"))
    top = _ranked(spark, sf_dir).withColumn("place", place).where(F.col("place") <= NODES).select("book_id", "id")
    edges = fold.current_relations(fold.relations(_log(spark, sf_dir, "rel"))).where("status is null or status <> 'ended'").select("book_id", "a", "b", "a_is", "b_is")
    return edges.join(top.withColumnRenamed("id", "a"), ["book_id", "a"], "left_semi").join(top.withColumnRenamed("id", "b"), ["book_id", "b"], "left_semi").select("book_id", "a", "b", "a_is", "b_is")


def chapter_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by chapter: who takes part in its events, with the name on the card; a range join, then a semi join of the cast."""
    cards = fold.people(_log(spark, sf_dir, "person", "name", "profile", "imp", "cnt")).select("book_id", "id", "name")
    events = _log(spark, sf_dir, "event").select("book_id", "rec_id", "p", F.explode("who").alias("id")).where("id is not null").distinct()
    placed = within_spans(events, _chapters(spark, sf_dir), "book_id", "p", "o0", "end")
    return placed.groupBy("book_id", "chapter_no", "id").agg(F.count(F.lit(1)).alias("events")).join(cards, ["book_id", "id"])


def displayed_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a reader sees it: by position, generated records before manual ones, then by arrival; place of each record in its book."""
    rows = table(spark, sf_dir, "kg_log").where("p is not null").select("book_id", "rec_id", "p", F.coalesce(F.col("model") == "manual", F.lit(False)).cast("int").alias("manual"), F.coalesce("ord", F.lit(-1)).alias("ord")).distinct()
    return ranked(rows, ["book_id"], "p", ["manual", "ord", "rec_id"], "place").select("book_id", "rec_id", F.col("place").cast("long").alias("place"))


def recent_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and maximum of importance over the last twelve events up to each event."""
    rows = log_records(spark, sf_dir, "event").where("p is not null").select("book_id", "rec_id", "p", F.coalesce("ord", F.lit(-1)).alias("ord"), "imp").distinct()
    return sliding(rows, ["book_id"], "p", ["ord", "rec_id"], BUFFER, total=F.sum("imp"), most=F.max("imp")).select("rec_id", "total", "most")


def recent_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last paragraphs before the reader's position, until they have 900 characters; the last one is cut at the position."""
    whole = table(spark, sf_dir, "kg_log").select("book_id", "p")
    rows = table(spark, sf_dir, "blocks").where("k = 'p'").select("book_id", "block_no", "o", "t").join(fold.cutoffs(whole, 0.6), "book_id").where("o < pos")
    from tidemark.functions.words import prefix_units

    rows = rows.withColumn("n", F.length(prefix_units(F.col("t"), F.col("pos") - F.col("o")))).select("book_id", "block_no", "o", "n")
    totals = running(rows, ["book_id"], "o", ["block_no"], "n", "sum")
    all_ = rows.groupBy("book_id").agg(F.sum("n").alias("all"))
    return totals.join(all_, "book_id").where(F.col("all") - F.col("sum") < RECENT_CHARS).select("book_id", "block_no", F.col("n").cast("long").alias("chars"))


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten segments of each book in even steps, the first and the last among them."""
    segs = table(spark, sf_dir, "segs").select("book_id", "seg").distinct()
    placed = ranked(segs, ["book_id"], "seg", [], "i").join(segs.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")), "book_id")
    wanted = F.when(F.col("n") <= 10, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")), lambda k: F.bround(k * (F.col("n") - 1) / 9).cast("long")))
    return placed.where(F.array_contains(wanted, (F.col("i") - 1).cast("long"))).select("book_id", "seg")


def chapter_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters at whose end biographies are due: the positions since the last time reach 12,000. What starts afresh needs a state, so the chapters of a book (numbers only) go through one task."""

    def of_book(part: pd.DataFrame) -> pd.DataFrame:
        since, fired = 0, []
        for n in part.sort_values("o0")["n"]:
            since += int(n)
            fired.append(since >= BIO_EVERY)
            since = 0 if fired[-1] else since
        return part.sort_values("o0").assign(fires=fired)[["book_id", "chapter_no", "fires"]]

    chapters = _chapters(spark, sf_dir).select("book_id", "chapter_no", "o0", (F.col("end") - F.col("o0")).alias("n"))
    return chapters.groupBy("book_id").applyInPandas(of_book, "book_id string, chapter_no int, fires boolean")


def contents_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a contents list: near the front of the book, with fewer than 120 characters up to the next heading, and three or more of them."""
    blocks = table(spark, sf_dir, "blocks").select("book_id", "block_no", "k", F.when(F.col("k") == "h", 0).otherwise(F.length(F.coalesce("t", F.lit("")))).alias("n"))
    before = running(blocks, ["book_id"], "block_no", [], "n", "sum")
    count = blocks.groupBy("book_id").agg(F.greatest(F.lit(10), F.floor(F.count(F.lit(1)) / 10)).alias("front"))
    heads = before.where("k = 'h'").withColumn("gap", F.lead("sum").over(Window.partitionBy("book_id").orderBy("block_no")) - F.col("sum"))
    near = heads.join(count, "book_id").where("block_no < front and gap < 120").select("book_id", "block_no")
    return near.join(near.groupBy("book_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 3"), "book_id", "left_semi")


def model_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two families of models agree on the names known at ten positions of each book: common, all, their ratio."""
    whole = table(spark, sf_dir, "kg_log").select("book_id", "p")
    ends = whole.groupBy("book_id").agg(F.max("p").alias("last"))
    rows = log_records(spark, sf_dir, "person", "name", "alias").where("p is not null and model is not null").select("book_id", F.lower(F.coalesce("name", "alias")).alias("name"), F.when(F.col("model").startswith("quill"), "a").otherwise("b").alias("side"), "p").where("trim(name) <> ''")
    # A name counts from its first tenth on; a name of both sides from the later one.
    tenth = F.greatest(F.ceil(F.col("p") * 10 / F.greatest("last", F.lit(1))), F.lit(1))
    firsts = rows.join(ends, "book_id").groupBy("book_id", "name").agg(F.min(F.when(F.col("side") == "a", tenth)).alias("ta"), F.min(F.when(F.col("side") == "b", tenth)).alias("tb"))
    steps = firsts.select("book_id", F.explode(F.sequence(F.least("ta", "tb").cast("int"), F.lit(10))).alias("tenth"), F.greatest("ta", "tb").alias("both"), (F.col("ta").isNotNull() & F.col("tb").isNotNull()).alias("two"))
    return steps.groupBy("book_id", "tenth").agg(F.count(F.when(F.col("two") & (F.col("both") <= F.col("tenth")), 1)).alias("common"), F.count(F.lit(1)).alias("all")).withColumn("overlap", F.round(F.col("common") / F.col("all"), 6))


def models_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that two families of models place at the same passage of a book: a full outer join of their passages."""
    rows = log_records(spark, sf_dir, "event").where("s is not null and model is not null").select("book_id", "s", F.when(F.col("model").startswith("quill"), "a").otherwise("b").alias("side"), F.coalesce(F.size(F.array_distinct("who")), F.lit(-1)).alias("people"))
    one, two = (rows.where(F.col("side") == x).groupBy("book_id", "s").agg(F.max("people").alias(f"people_{x}")) for x in "ab")
    joined = one.join(two, ["book_id", "s"], "full")
    return joined.groupBy("book_id").agg(F.count(F.lit(1)).alias("passages"), F.count(F.when(F.col("people_a").isNotNull() & F.col("people_b").isNotNull(), 1)).alias("common"), F.count(F.when(F.col("people_a") == F.col("people_b"), 1)).alias("same"))


def merged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on each chapter from two ways of working: a finished one wins, different ones of the same standing conflict."""
    rows = table(spark, sf_dir, "segs").where("mode is not null").groupBy("book_id", "chapter_no", "mode").agg(F.max_by("state", F.struct("o0", "done_at", "state")).alias("state"))
    one, two = (rows.where(F.col("mode") == m).select("book_id", "chapter_no", F.col("state").alias(n)) for m, n in (("classic", "a"), ("two-phase", "b")))
    both = one.join(two, ["book_id", "chapter_no"], "full")
    verdict = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull() | (F.col("a") == F.col("b")) | (F.col("a") == "done"), F.col("a")).when(F.col("b") == "done", F.col("b"))
    return both.select("book_id", "chapter_no", verdict.alias("state"), verdict.isNull().alias("conflict"))


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by person as versions in order of arrival: how many, and how many lie before the version they follow."""
    rows = log_records(spark, sf_dir, "profile").where("p is not null and ord is not null and id is not null").select("book_id", "id", "rec_id", "ord", "p").distinct()
    back = F.col("p") < F.lag("p").over(Window.partitionBy("book_id", "id").orderBy("ord", "rec_id"))
    return rows.withColumn("back", F.coalesce(back, F.lit(False)).cast("int")).groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("versions"), F.sum("back").alias("backward"))


def book_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a shelf: language, segments and how many are done, progress in per cent, records, and the fingerprint of the segments."""
    segs = table(spark, sf_dir, "segs").groupBy("book_id", "seg").agg(F.max_by("state", F.struct("done_at", "model")).alias("state"), F.max("o1").alias("o1"), F.max("done_at").alias("done_at"))
    stamps = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.coalesce(F.unix_micros(F.col("done_at").cast("timestamp")), F.lit(0)).alias("u")))), lambda x: F.concat(x["seg"].cast("string"), F.lit(":"), x["u"].cast("string"))), ","), 256)
    done = segs.groupBy("book_id").agg(F.count(F.lit(1)).alias("segments"), F.count(F.when(F.col("state") == "done", 1)).alias("done"), F.max(F.when(F.col("state") == "done", F.col("o1"))).alias("reached"), stamps.alias("version"))
    log = table(spark, sf_dir, "kg_log").groupBy("book_id").agg(F.countDistinct("rec_id").alias("records"))
    books = table(spark, sf_dir, "books").select("book_id", "lang", "len").join(done, "book_id", "left").join(log, "book_id", "left")
    progress = F.round(F.coalesce("reached", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("len", F.lit(0))) * 100, 3)
    return books.select("book_id", "lang", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("done", F.lit(0)).alias("done"), progress.alias("progress"), F.coalesce("records", F.lit(0)).alias("records"), "version")


def used_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that a book refers to, its cover among them."""
    images = table(spark, sf_dir, "blocks").where("k = 'img' and trim(src) <> ''").select("book_id", F.col("src").alias("asset"))
    return images.unionByName(table(spark, sf_dir, "books").where("trim(cover) <> ''").select("book_id", F.col("cover").alias("asset"))).distinct()


def shelf_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by title; numbers in titles sort by value: they are padded."""
    books = table(spark, sf_dir, "books").select("book_id", F.lower(F.coalesce("title", F.lit(""))).alias("key"))
    padded = F.regexp_replace(F.regexp_replace("key", r"(\d+)", "000000000000$1"), r"0*(\d{12})", "$1")
    return books.select("book_id", padded.alias("sort_key"))


def notes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader notes that hold all terms, newest first within each book: the place of each."""
    rows = table(spark, sf_dir, "documents").where("source = 'reader_notes'").where(F.lower("text").contains("the") & F.lower("text").contains("a"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc_nulls_last("fetched_at"), "doc_id"))
    return rows.select("doc_id", "book_id", place.cast("long").alias("place"))


def continued_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished books, the one worked on last first."""
    segs = table(spark, sf_dir, "segs").groupBy("book_id").agg(F.max("done_at").alias("touched"), F.count(F.when(F.col("state") != "done", 1)).alias("open"))
    return segs.where("open > 0 and touched is not null").select("book_id", "touched", "open")


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that tell of each introduced person: its last forty-five events in order, as number, length and hash."""
    log = _log(spark, sf_dir, "person", "event")
    who = log.where("t = 'event' and text is not null").select("book_id", "rec_id", "seq", "text", F.explode("who").alias("id")).where("id is not null").distinct()
    who = who.join(fold.introductions(log).select("book_id", "id"), ["book_id", "id"], "left_semi")
    # A first cut by salt keeps a person of very many events out of a single task.
    salted = who.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(16))).withColumn("k", F.row_number().over(Window.partitionBy("book_id", "id", "salt").orderBy(F.desc("seq"), F.desc("rec_id")))).where(F.col("k") <= EVENTS_OF_A_DOSSIER)
    last = salted.withColumn("k", F.row_number().over(Window.partitionBy("book_id", "id").orderBy(F.desc("seq"), F.desc("rec_id")))).where(F.col("k") <= EVENTS_OF_A_DOSSIER)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rec_id", "text"))), lambda x: x["text"]), "；")
    return last.groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("events"), text.alias("x")).select("book_id", "id", "events", F.length("x").cast("long").alias("chars"), F.md5("x").alias("md5"))


def recap_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in for the recap of a chapter: its important events joined, the first 300 characters."""
    events = log_records(spark, sf_dir, "event").where("p is not null and imp >= 2 and text is not null").select("book_id", "rec_id", "p", F.coalesce("ord", F.lit(-1)).alias("ord"), "text").distinct()
    placed = within_spans(events, _chapters(spark, sf_dir), "book_id", "p", "o0", "end")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "ord", "rec_id", "text"))), lambda x: x["text"]), " ")
    return placed.groupBy("book_id", "chapter_no").agg(F.substring(text, 1, RECAP_CHARS).alias("text"))


def saga_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sagas that may be told on: every earlier one of the book has a text. What goes on is the last 1,500 characters."""
    rows = log_records(spark, sf_dir, "saga").where("p is not null").select("book_id", "rec_id", "p", F.coalesce("ord", F.lit(-1)).alias("ord"), "text").distinct()
    whole = F.min((F.coalesce(F.trim("text"), F.lit("")) != "").cast("int")).over(Window.partitionBy("book_id").orderBy("p", "ord", "rec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("whole", whole).select("rec_id", (F.col("whole") == 1).alias("complete"), F.when(F.col("whole") == 1, F.right("text", F.lit(SAGA_CHARS))).alias("tail"))


def numbered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as numbered paragraphs, headings marked, as a prompt shows them: length and hash."""
    segs = table(spark, sf_dir, "segs").select("book_id", "seg", "o0", "o1").distinct()
    rows = within_spans(table(spark, sf_dir, "blocks").where("t <> ''").select("book_id", "o", "k", "t"), segs, "book_id", "o", "o0", "o1")
    lines = rows.withColumn("n", F.row_number().over(Window.partitionBy("book_id", "seg").orderBy("o"))).select("book_id", "seg", "o", F.concat(F.lit("[P"), F.col("n").cast("string"), F.lit("] "), F.when(F.col("k") == "h", F.lit("【标题】")).otherwise(F.lit("")), F.col("t")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("book_id", "seg").agg(text.alias("x")).select("book_id", "seg", F.length("x").cast("long").alias("chars"), F.md5("x").alias("md5"))


def spoiler_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards at the reader's position whose tagline or biography holds a name of the book that is known only later."""
    cards = fold.people(_log(spark, sf_dir, "person", "name", "profile", "imp", "cnt")).select("book_id", "id", F.concat_ws(" ", "tagline", "bio").alias("text"))
    whole = table(spark, sf_dir, "kg_log").select("book_id", "p")
    names = log_records(spark, sf_dir, "person", "name", "alias").where("p is not null").select("book_id", F.coalesce("name", "alias").alias("name"), "p").groupBy("book_id", "name").agg(F.min("p").alias("known"))
    later = cut(names.join(fold.cutoffs(whole, 0.6), "book_id").where("known > pos and length(name) >= 2").select("book_id", "name"))  # read twice
    return names_in_texts(cards, later, "book_id", "text", "name").select("book_id", "id", "name").distinct()


QUERIES = {
    "person_relations": person_relations,
    "graph_edges": graph_edges,
    "chapter_cast": chapter_cast,
    "displayed_knowledge": displayed_knowledge,
    "recent_importance": recent_importance,
    "recent_paragraphs": recent_paragraphs,
    "even_sample": even_sample,
    "chapter_triggers": chapter_triggers,
    "contents_lists": contents_lists,
    "model_overlap": model_overlap,
    "models_compared": models_compared,
    "merged_verdicts": merged_verdicts,
    "version_order": version_order,
    "book_summaries": book_summaries,
    "used_assets": used_assets,
    "shelf_by_title": shelf_by_title,
    "notes_found": notes_found,
    "continued_books": continued_books,
    "dossiers": dossiers,
    "recap_fallbacks": recap_fallbacks,
    "saga_chain": saga_chain,
    "numbered_segments": numbered_segments,
    "spoiler_probes": spoiler_probes,
}

_L = LG.rstrip().rstrip(",")
_RR = "rr as (select book_id, rec_id, seq, least(a, b) as a, greatest(a, b) as b, case when a > b then b_is else a_is end as a_is, case when a > b then a_is else b_is end as b_is, status from lg where t = 'rel' and a <> b)"
_NOW = f"{_RR}, now as (select book_id, a, b, " + ", ".join(f"arg_max({c}, seq) filter (where trim({c}) <> '') as {c}" for c in ("a_is", "b_is", "status")) + ", max(seq) as seq, count(distinct a_is) as na, count(distinct b_is) as nb from rr group by 1, 2, 3)"
_UNITS = U16.format("coalesce(t, '')")
_PREFIX = "case when want >= {n} then t else substr(t, 1, coalesce(list_max(list_filter(range(greatest(want - length(regexp_replace(substr(t, 1, want), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) - 1, 0), want + 1), lambda i: i + length(regexp_replace(substr(t, 1, i), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= want)), 0)) end"

ORACLES = {
    "person_relations": f"{_L}, {_NOW}, bo as (select book_id, a as id, b as other, b_is as role, nb as roles, status, seq from now union all select book_id, b, a, a_is, na, status, seq from now) select book_id, id, other, role, roles, status, row_number() over (partition by book_id, id order by coalesce(status = 'ended', false), seq desc, other) as place from bo",
    "graph_edges": RANKED_SQL + f", {_NOW}, top as (select book_id, id from ranked qualify row_number() over (partition by book_id order by score desc, id) <= {NODES}) select now.book_id, a, b, a_is, b_is from now join top x on x.book_id = now.book_id and x.id = a join top y on y.book_id = now.book_id and y.id = b where status is null or status <> 'ended'",
    "chapter_cast": LG + CARD + f", {CHAPTERS}, ev as (select distinct book_id, rec_id, p, unnest(who) as id from lg where t = 'event') select ev.book_id, chapter_no, ev.id, count(*) as events, any_value(card.name) as name from ev join ch on ch.book_id = ev.book_id and ch.o0 <= p and p < ch.e join card on card.book_id = ev.book_id and card.id = ev.id group by 1, 2, 3",
    "displayed_knowledge": "with r as (select distinct book_id, rec_id, p, coalesce(model = 'manual', false)::int as manual, coalesce(ord, -1) as ord from kg_log where p is not null) select book_id, rec_id, row_number() over (partition by book_id order by p, manual, ord, rec_id) as place from r",
    "recent_importance": f"with r as (select distinct book_id, rec_id, p, coalesce(ord, -1) as ord, imp from kg_log where t = 'event' and p is not null) select rec_id, cast(sum(imp) over w as bigint) as total, max(imp) over w as most from r window w as (partition by book_id order by p, ord, rec_id rows between {BUFFER - 1} preceding and current row)",
    "recent_paragraphs": f"""with c as (select book_id, cast(floor(max(p) * 0.6) as bigint) as pos from kg_log group by 1), b as materialized (select book_id, block_no, o, t, {U16.format('t')} as n, pos - o as want from blocks join c using (book_id) where k = 'p' and o < pos),
    x as (select book_id, block_no, o, case when want >= n then length(t) else length({_PREFIX.format(n='n')}) end as n from (select * from b)), s as (select *, sum(n) over (partition by book_id order by o desc, block_no desc rows between unbounded preceding and 1 preceding) as after from x)
    select book_id, block_no, n as chars from s where coalesce(after, 0) < {RECENT_CHARS}""",
    "even_sample": "with s as (select distinct book_id, seg from segs), n as (select *, row_number() over (partition by book_id order by seg) - 1 as i, count(*) over (partition by book_id) as n from s) select book_id, seg from n where n <= 10 or list_contains(list_transform(range(10), lambda k: round_even(k * (n - 1) / 9, 0)::bigint), i)",
    "chapter_triggers": f"""with recursive {CHAPTERS}, n as materialized (select book_id, chapter_no, e - o0 as n, row_number() over (partition by book_id order by o0) as i from ch),
    w(book_id, chapter_no, i, since) as (select book_id, chapter_no, i, n from n where i = 1 union all select n.book_id, n.chapter_no, n.i, case when w.since >= {BIO_EVERY} then 0 else w.since end + n.n from w join n on n.book_id = w.book_id and n.i = w.i + 1) select book_id, chapter_no, since >= {BIO_EVERY} as fires from w""",
    "contents_lists": """with b as (select book_id, block_no, k, sum(case when k = 'h' then 0 else length(coalesce(t, '')) end) over (partition by book_id order by block_no rows unbounded preceding) as s, greatest(10, count(*) over (partition by book_id) // 10) as front from blocks),
    h as (select *, lead(s) over (partition by book_id order by block_no) - s as gap from b where k = 'h'), n as (select book_id, block_no from h where block_no < front and gap < 120) select * from n where book_id in (select book_id from n group by 1 having count(*) >= 3)""",
    "model_overlap": """with e as (select book_id, max(p) as last from kg_log group by 1), r as (select k.book_id, lower(coalesce(name, alias)) as name, case when model like 'quill%' then 'a' else 'b' end as side, greatest(ceil(p * 10 / greatest(last, 1)), 1) as tenth from kg_log k join e using (book_id) where t in ('person', 'name', 'alias') and p is not null and model is not null and trim(coalesce(name, alias)) <> ''),
    c as (select unnest(range(1, 11))::int as tenth), f as (select book_id, name, min(tenth) filter (where side = 'a') as ta, min(tenth) filter (where side = 'b') as tb from r group by 1, 2)
    select book_id, c.tenth, count(*) filter (where ta <= c.tenth and tb <= c.tenth) as common, count(*) as "all", round(count(*) filter (where ta <= c.tenth and tb <= c.tenth) / count(*), 6) as overlap from f join c on c.tenth >= least(ta, tb) group by 1, 2""",
    "models_compared": """with r as (select book_id, s, model like 'quill%' as a, case when who is null then -1 else len(list_distinct(who)) + (len(who) > list_count(who))::int end as people from kg_log where t = 'event' and s is not null and model is not null),
    x as (select book_id, s, max(people) as pa from r where a group by 1, 2), y as (select book_id, s, max(people) as pb from r where not a group by 1, 2)
    select book_id, count(*) as passages, count(*) filter (where pa is not null and pb is not null) as common, count(*) filter (where pa = pb) as same from x full join y using (book_id, s) group by 1""",
    "merged_verdicts": """with r as (select book_id, chapter_no, mode, (list(state order by o0 desc, done_at desc nulls last, state desc))[1] as state from segs where mode is not null group by 1, 2, 3),
    j as (select book_id, chapter_no, x.state as a, y.state as b from (select * from r where mode = 'classic') x full join (select * from r where mode = 'two-phase') y using (book_id, chapter_no)),
    v as (select book_id, chapter_no, case when a is null then b when b is null or a = b or a = 'done' then a when b = 'done' then b end as state from j) select *, state is null as conflict from v""",
    "version_order": "with r as (select distinct book_id, id, rec_id, ord, p from kg_log where t = 'profile' and p is not null and ord is not null and id is not null), b as (select *, coalesce(p < lag(p) over (partition by book_id, id order by ord, rec_id), false)::int as back from r) select book_id, id, count(*) as versions, cast(sum(back) as bigint) as backward from b group by 1, 2",
    "book_summaries": """with s as (select book_id, seg, (list(state order by done_at desc nulls last, model desc nulls last))[1] as state, max(o1) as o1, max(done_at) as done_at from segs group by 1, 2),
    d as (select book_id, count(*) as segments, count(*) filter (where state = 'done') as done, max(o1) filter (where state = 'done') as reached, sha256(string_agg(seg || ':' || coalesce(epoch_us(done_at), 0), ',' order by seg)) as version from s group by 1), l as (select book_id, count(distinct rec_id) as records from kg_log group by 1)
    select book_id, lang, coalesce(segments, 0) as segments, coalesce(done, 0) as done, round(coalesce(reached, 0) / greatest(1, coalesce(len, 0)) * 100, 3) as progress, coalesce(records, 0) as records, version from books left join d using (book_id) left join l using (book_id)""",
    "used_assets": "select book_id, src as asset from blocks where k = 'img' and trim(src) <> '' union select book_id, cover from books where trim(cover) <> ''",
    "shelf_by_title": r"select book_id, regexp_replace(regexp_replace(lower(coalesce(title, '')), '(\d+)', '000000000000\1', 'g'), '0*(\d{12})', '\1', 'g') as sort_key from books",
    "notes_found": "select doc_id, book_id, row_number() over (partition by book_id order by fetched_at desc nulls last, doc_id) as place from documents where source = 'reader_notes' and contains(lower(text), 'the') and contains(lower(text), 'a')",
    "continued_books": "select book_id, max(done_at) as touched, count(*) filter (where state <> 'done') as open from segs group by 1 having count(*) filter (where state <> 'done') > 0 and max(done_at) is not null",
    "dossiers": f"""{_L}, w as (select distinct book_id, rec_id, seq, text, unnest(who) as id from lg where t = 'event' and text is not null), k as (select w.*, row_number() over (partition by book_id, id order by seq desc, rec_id desc) as k from w join per using (book_id, id)),
    x as (select book_id, id, count(*) as events, string_agg(text, '；' order by seq, rec_id) as x from k where k <= {EVENTS_OF_A_DOSSIER} group by 1, 2) select book_id, id, events, length(x) as chars, md5(x) as md5 from x""",
    "recap_fallbacks": f"with {CHAPTERS}, e as (select distinct book_id, rec_id, p, coalesce(ord, -1) as ord, text from kg_log where t = 'event' and p is not null and imp >= 2 and text is not null) select e.book_id, chapter_no, substr(string_agg(text, ' ' order by p, ord, rec_id), 1, {RECAP_CHARS}) as text from e join ch on ch.book_id = e.book_id and ch.o0 <= p and p < ch.e group by 1, 2",
    "saga_chain": f"with r as (select distinct book_id, rec_id, p, coalesce(ord, -1) as ord, text from kg_log where t = 'saga' and p is not null), w as (select *, bool_and(coalesce(trim(text), '') <> '') over (partition by book_id order by p, ord, rec_id rows unbounded preceding) as c from r) select rec_id, c as complete, case when c then right(text, {SAGA_CHARS}) end as tail from w",
    "numbered_segments": """with s as (select distinct book_id, seg, o0, o1 from segs), r as (select s.book_id, seg, o, k, t, row_number() over (partition by s.book_id, seg order by o) as n from s join blocks b on b.book_id = s.book_id and b.o >= s.o0 and b.o < s.o1 where t <> ''),
    x as (select book_id, seg, string_agg('[P' || n || '] ' || case when k = 'h' then '【标题】' else '' end || t, chr(10) order by o) as x from r group by 1, 2) select book_id, seg, length(x) as chars, md5(x) as md5 from x""",
    "spoiler_probes": LG + CARD + """, nm as (select book_id, coalesce(name, alias) as name, min(p) as known from kg_log where t in ('person', 'name', 'alias') and p is not null group by 1, 2), lt as (select nm.book_id, name from nm join cutoffs using (book_id) where known > pos and length(name) >= 2)
    select distinct card.book_id, id, lt.name from card join lt on lt.book_id = card.book_id and contains(concat_ws(' ', tagline, bio), lt.name)""",
}
