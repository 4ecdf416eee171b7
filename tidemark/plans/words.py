"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import words as W
from tidemark.operators import fold
from tidemark.operators.intervals import merge_overlaps
from tidemark.operators.running import within_spans
from tidemark.plans.log import CARD, CHAPTERS, LG, U16, _chapters, _log
from tidemark.sources import formats
from tidemark.sources.tables import log_records, table

#: Works shorter than this, in UTF-16 units, are none.
LEAST_WORK = 2_000
# Words of claims that must not be got wrong.
CRITICAL_HAN = "死|去世|身亡|亡故|病故|病逝|自尽|自刎|投井|上吊|咽气|气绝|过世|归天|丧命|遇害|被杀|娶|嫁|成亲|成婚|完婚|拜堂|过门|订婚|定亲|婚配|凶手|元凶|主谋|幕后|行凶|刺杀|暗杀|下毒|毒杀|陷害|嫁祸"
CRITICAL_LATIN = "attacker|assailant|culprit|murderer|killer|poisoner|poisoned|framed|die[sd]?|dying|dead|death|killed|murder(?:ed)?|drown(?:s|ed)|suicide|hanged|executed|perish(?:ed|es)|marr(?:y|ies|ied)|wedding|wed|widow(?:ed)?|engaged|betrothed"
CRITICAL = f"(?i){CRITICAL_HAN}|(?:^|[^a-z])(?:{CRITICAL_LATIN})(?:[^a-z]|$)"
LIFE_KEYS = "生死 婚恋 alive life death marriage married age 年龄"


def full_width_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with full-width marks next to Chinese, as length and hash."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", W.full_width(F.col("text")).alias("w"))
    return docs.select("doc_id", F.length("w").cast("long").alias("chars"), F.md5("w").alias("md5"))


def heading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with the number they carry."""
    return table(spark, sf_dir, "blocks").where("k = 'h'").select("book_id", "block_no", "t", W.ordinal(F.col("t")).alias("n"), W.is_opener(F.col("t")).alias("opener"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.col("o") + X.u16_length(F.coalesce("t", F.lit("")))
    chapters = table(spark, sf_dir, "blocks").groupBy("book_id", "chapter_no").agg(F.min_by("t", F.when(F.col("k") == "h", F.col("block_no"))).alias("title"), F.min("o").alias("o0"), F.max(ends).alias("o1"))
    return chapters.select("book_id", "chapter_no", "o0", "o1", W.ordinal(F.col("title")).alias("n"), W.is_opener(F.col("title")).alias("opener"))


def collected_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of a collection: a new one starts with an opener, or where the numbers of chapters begin again at 1 or 2."""
    order = Window.partitionBy("book_id").orderBy("chapter_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("n").isNotNull(), F.col("n")).when(F.col("opener"), F.lit(0))
    rows = _numbered(spark, sf_dir).withColumn("prev", F.last(known, ignorenulls=True).over(before)).withColumn("i", F.row_number().over(order))
    restart = (F.col("i") > 1) & (F.col("opener") | F.coalesce((F.col("n") <= F.col("prev")) & (F.col("n") <= 2), F.lit(False)))
    rows = rows.withColumn("work", F.sum(restart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = rows.groupBy("book_id", "work").agg(F.min("o0").alias("s"), F.max("o1").alias("e")).where(F.col("e") - F.col("s") >= LEAST_WORK)
    several = spans.groupBy("book_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("book_id")
    return merge_overlaps(spans.join(several, "book_id", "left_semi"), ["book_id"], "s", "e").select("book_id", "s", "e")


def shelf_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and author for display, and the work that a title means."""
    title, author = W.display_title(F.col("title"), F.col("author"))
    return table(spark, sf_dir, "books").select("book_id", title.alias("title"), author.alias("author"), W.work_of(F.col("title")).alias("work"))


def document_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first lines name an author."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", W.text_author(F.col("text"), X.HEADING).alias("author")).where("author <> ''")


def parsed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number k of the loose JSON of each event."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(W.loose_json(F.col("props")), "$.k").cast("long").alias("k"))


def segment_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identity of each segment record: the hash of its canonical JSON."""
    columns = {c: F.col(c) for c in ("book_id", "seg", "o0", "o1", "lang", "mode", "model")}
    return table(spark, sf_dir, "segs").select("book_id", "seg", "done_at", W.canonical_digest(**columns).alias("digest"))


def critical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, relations and attributes that claim a death, a marriage or a culprit, or that hold a key of life."""
    log = log_records(spark, sf_dir, "event", "rel", "attr").select("rec_id", "t", F.when(F.col("t") == "event", F.col("text")).when(F.col("t") == "rel", F.col("rel_desc")).otherwise(F.col("attr_value")).alias("claim"), F.lower(F.trim("attr_key")).alias("key"))
    return log.where(F.coalesce(F.col("claim").rlike(CRITICAL), F.lit(False)) | F.coalesce(F.col("key").isin(*LIFE_KEYS.split()), F.lit(False))).select("rec_id", "t").distinct()


def person_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each person in a palette of twelve, by the digits of its id."""
    return log_records(spark, sf_dir, "person").where("id rlike '[0-9]'").select("id", (F.regexp_replace("id", r"\D", "").cast("decimal(30,0)") * 7 % 12).cast("long").alias("colour")).distinct()


def strict_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units 3 to 9 of each block, null where a bound splits a surrogate pair or the block is shorter."""
    return table(spark, sf_dir, "blocks").where("k <> 'img'").select("book_id", "block_no", W.strict_slice(F.col("t"), F.lit(3), F.lit(9)).alias("part"))


def book_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each book up to a third of it; the last one is cut, never inside a surrogate pair."""
    blocks = table(spark, sf_dir, "blocks").select("book_id", "block_no", "o", F.coalesce("t", F.lit("")).alias("t"))
    ends = blocks.groupBy("book_id").agg(F.floor(F.max(F.col("o") + X.u16_length(F.col("t"))) / 3).alias("cut"))
    kept = blocks.join(ends, "book_id").where("o < cut").withColumn("text", W.prefix_units(F.col("t"), F.col("cut") - F.col("o")))
    return kept.select("book_id", "block_no", X.u16_length(F.col("text")).alias("units"), F.md5("text").alias("md5"))


def label_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of roles as a reader sees them: the first sixteen words of the description, up to a bracket; where several roles of a book share a phrase the role is kept visible."""
    rows = log_records(spark, sf_dir, "rel").where("trim(a_is) <> ''").groupBy("book_id", F.col("a_is").alias("key")).agg(F.min(F.when(F.trim("rel_desc") != "", F.rtrim(F.trim("rel_desc"), F.lit(".")))).alias("d"))
    short = F.substring(F.element_at(F.split(F.array_join(F.slice(F.split("d", r"\s+"), 1, 16), " "), r" \("), 1), 1, 160)
    rows = rows.withColumn("phrase", F.when(F.col("d") != "", short).otherwise(F.translate("key", "_-", "  ")))
    same = F.count(F.lit(1)).over(Window.partitionBy("book_id", "phrase"))
    return rows.withColumn("n", same).select("book_id", "key", F.when(F.col("n") > 1, F.concat("phrase", F.lit(" ["), "key", F.lit("]"))).otherwise(F.col("phrase")).alias("label"))


def unframed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the frames of a licence, with the title and author of its header; the body as its hash."""
    body, title, author = formats.unframed_columns(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(body).alias("md5"), title.alias("title"), author.alias("author"))


def plain_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without editor's notes and readings, as hash; and whether each is an annotated Japanese text."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", formats.is_annotated(text).alias("annotated"), F.md5(formats.without_readings(text)).alias("md5"))


def verbatim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the text at a relation's place is its quote, unit by unit; a place inside a surrogate pair holds none."""
    quotes = log_records(spark, sf_dir, "rel").where("quote <> '' and s is not null").select("rec_id", "book_id", "s", "quote").distinct()
    blocks = table(spark, sf_dir, "blocks").where("t <> ''").select("book_id", "o", "t").withColumn("end", F.col("o") + X.u16_length(F.col("t")))
    at = within_spans(quotes, blocks, "book_id", "s", "o", "end").withColumn("i", F.col("s") - F.col("o"))
    part = W.strict_slice(F.col("t"), F.col("i"), F.col("i") + X.u16_length(F.col("quote")))
    return at.select("rec_id", F.coalesce(part == F.col("quote"), F.lit(False)).alias("verbatim"))


def event_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the title of the chapter they lie in: the last one that begins at or before them."""
    titles = table(spark, sf_dir, "blocks").where("k = 'h'").groupBy("book_id", "chapter_no").agg(F.min_by("t", "block_no").alias("title"))
    events = log_records(spark, sf_dir, "event").where("p is not null").select("book_id", "rec_id", "p").distinct()
    return within_spans(events, _chapters(spark, sf_dir), "book_id", "p", "o0", "end").join(titles, ["book_id", "chapter_no"], "left").select("rec_id", "chapter_no", "title")


def work_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the work begins that holds each event: 0 where the book is no collection."""
    events = log_records(spark, sf_dir, "event").where("p is not null").select("book_id", "rec_id", "p").distinct()
    works = collected_works(spark, sf_dir).withColumn("end", F.col("e") + 1)
    inside = within_spans(events, works, "book_id", "p", "s", "end").groupBy("rec_id").agg(F.max("s").alias("start"))
    return events.join(inside, "rec_id", "left").select("rec_id", F.coalesce("start", F.lit(0)).cast("long").alias("start"))


def attribute_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with key and value as facts: who it is about, by the name and tagline on the card."""
    log = _log(spark, sf_dir, "person", "name", "profile", "imp", "cnt", "attr")
    cards = fold.people(log).select("book_id", "id", "name", "tagline")
    rows = log.where("t = 'attr' and trim(attr_key) <> '' and trim(attr_value) <> ''").select("book_id", "rec_id", "id", "attr_key", "attr_value").distinct()
    return rows.join(cards, ["book_id", "id"]).select("rec_id", "name", "tagline", "attr_key", "attr_value")


QUERIES = {
    "doc_unframed": unframed_documents,
    "doc_readings": plain_readings,
    "quotes_verbatim": verbatim_quotes,
    "event_titles": event_titles,
    "work_starts": work_starts,
    "attribute_facts": attribute_facts,
    "text_full_width": full_width_texts,
    "heading_numbers": heading_numbers,
    "collected_works": collected_works,
    "shelf_titles": shelf_titles,
    "doc_authors": document_authors,
    "parsed_props": parsed_props,
    "segment_digests": segment_digests,
    "critical_records": critical_records,
    "person_colours": person_colours,
    "strict_slices": strict_slices,
    "book_prefixes": book_prefixes,
    "label_phrases": label_phrases,
}


def _sql_full_width() -> str:
    out = r"""regexp_replace(text, '"([^"\n]{1,60})"', '“\1”', 'g')"""
    for i, mark in enumerate(W.MARKS[0]):
        out = rf"regexp_replace({out}, '({W.CHINESE})\s*\{mark}\s*', '\1{chr(0xE000 + i)}', 'g')"
        out = rf"regexp_replace({out}, '\s*\{mark}\s*({W.CHINESE})', '{chr(0xE000 + i)}\1', 'g')"
    return f"translate({out}, '{''.join(chr(0xE000 + i) for i in range(len(W.MARKS[0])))}', '{W.MARKS[1]}')"


def _sql_digit(raw: str, group: int) -> str:
    found = f"regexp_extract({raw}, '{W.HAN_NUMBER}', {group})"
    return f"(case when {found} <> '' then greatest(strpos('{W.HAN_DIGITS}', {found}) - 1, 0) else 0 end)"


def _sql_ordinal(title: str) -> str:
    first, second, third = (f"regexp_extract({title}, '{W.ORDINAL}', {g})" for g in (1, 2, 3))
    raw = f"(case when {first} <> '' then {first} when {second} <> '' then {second} else {third} end)"
    tens = f"(case when regexp_extract({raw}, '{W.HAN_NUMBER}', 4) = '' then 0 when regexp_extract({raw}, '{W.HAN_NUMBER}', 3) = '' then 1 else {_sql_digit(raw, 3)} end)"
    han = f"({_sql_digit(raw, 1)} * 1000 + {_sql_digit(raw, 2)} * 100 + {tens} * 10 + {_sql_digit(raw, 5)})"
    count = lambda s: f"len(regexp_extract_all(lower({raw}), '{s}'))"
    roman = " + ".join(f"{count(s)} * {v if len(s) == 1 else v - sum(W.ROMAN[c] for c in s)}" for s, v in W.ROMAN.items())
    return f"(case when not regexp_matches({title}, '{W.ORDINAL}') then null when regexp_matches({raw}, '^[0-9]+$') then {raw}::bigint when regexp_matches({raw}, '(?i)^[ivxlcdm]+$') then ({roman})::bigint when {raw} <> '' then nullif({han}, 0)::bigint end)"


_PLAIN, _OWN = "trim(coalesce(title, ''))", "trim(coalesce(author, ''))"
_SPLIT = f"(regexp_matches({_PLAIN}, '{W.BYLINE}') and regexp_extract({_PLAIN}, '{W.BYLINE}', 1) <> '')"
_BARE = f"lower(trim(regexp_replace(coalesce(title, ''), '{W.RUN_LABEL}', '', 'g')))"
_HEAD = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(replace(x, chr(13), ''))), lambda x: x <> '')[1:6]"
_UNITS = U16.format("coalesce(t, '')")

ORACLES = {
    "text_full_width": f"with c as (select doc_id, {_sql_full_width()} as w from documents where text is not null) select doc_id, length(w) as chars, md5(w) as md5 from c",
    "heading_numbers": f"select book_id, block_no, t, {_sql_ordinal('t')} as n, regexp_matches(t, '{W.OPENER}') as opener from blocks where k = 'h'",
    "collected_works": f"""with c as (select book_id, chapter_no, arg_min(t, block_no) filter (where k = 'h') as title, min(o) as o0, max(o + {_UNITS}) as o1 from blocks group by 1, 2),
    n as (select *, {_sql_ordinal('title')} as n, coalesce(regexp_matches(title, '{W.OPENER}'), false) as opener from c),
    p as (select *, last_value(case when n is not null then n when opener then 0 end ignore nulls) over (partition by book_id order by chapter_no rows between unbounded preceding and 1 preceding) as prev, row_number() over (partition by book_id order by chapter_no) as i from n),
    w as (select *, sum((i > 1 and (opener or coalesce(n <= prev and n <= 2, false)))::int) over (partition by book_id order by chapter_no rows unbounded preceding) as work from p),
    s as (select book_id, min(o0) as s, max(o1) as e from w group by book_id, work having max(o1) - min(o0) >= {LEAST_WORK}), m as (select * from s where book_id in (select book_id from s group by 1 having count(*) >= 2)),
    g as (select *, coalesce(s > max(e) over (partition by book_id order by s, e rows between unbounded preceding and 1 preceding), true)::int as new from m), h as (select *, sum(new) over (partition by book_id order by s, e rows unbounded preceding) as k from g)
    select book_id, min(s) as s, max(e) as e from h group by book_id, k""",
    "shelf_titles": f"""select book_id, case when {_SPLIT} then regexp_extract({_PLAIN}, '{W.BYLINE}', 1) else {_PLAIN} end as title,
    case when {_SPLIT} and {_OWN} = '' and not regexp_matches(regexp_extract({_PLAIN}, '{W.BYLINE}', 2), '{W.SITE}') then regexp_extract({_PLAIN}, '{W.BYLINE}', 2) else {_OWN} end as author, case when {_BARE} <> '' then {_BARE} else lower({_PLAIN}) end as work from books""",
    "doc_authors": f"""with h as (select doc_id, {_HEAD} as head from documents where text is not null), n as (select doc_id, head, list_filter(head, lambda x: regexp_matches(x, '{W.AUTHOR_LINE}')) as named from h),
    a as (select doc_id, case when len(named) > 0 then trim(regexp_extract(named[1], '{W.AUTHOR_LINE}', 1)) when len(head) > 2 and length(head[1]) <= 20 and not regexp_matches(lower(head[1]), '{X.HEADING}') and not regexp_matches(head[1], '[。，！？；：、,.!?;:]')
      and regexp_matches(head[2], '^[\\x{{4e00}}-\\x{{9fff}}·]{{2,6}}$') and not regexp_matches(lower(head[2]), '{X.HEADING}') then head[2] else '' end as author from n) select * from a where author <> ''""",
    "parsed_props": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "segment_digests": """select book_id, seg, done_at, sha256('{"book_id":"' || book_id || '",' || coalesce('"lang":"' || lang || '",', '') || coalesce('"mode":"' || mode || '",', '') || coalesce('"model":"' || model || '",', '') || '"o0":' || o0 || ',"o1":' || o1 || ',"seg":' || seg || '}') as digest from segs""",
    "critical_records": f"""with c as (select rec_id, t, case t when 'event' then text when 'rel' then rel_desc else attr_value end as claim, lower(trim(attr_key)) as key from kg_log where t in ('event', 'rel', 'attr'))
    select distinct rec_id, t from c where coalesce(regexp_matches(claim, '{CRITICAL}'), false) or coalesce(key in ({", ".join(f"'{k}'" for k in LIFE_KEYS.split())}), false)""",
    "person_colours": r"select distinct id, (regexp_replace(id, '\D', '', 'g')::hugeint * 7 % 12)::bigint as colour from kg_log where t = 'person' and regexp_matches(id, '[0-9]')",
    "strict_slices": f"""with c as (select book_id, block_no, t, {U16.format('t')} as n, list_transform(range(1, least(length(t), 10) + 1), lambda i: {{'ch': substr(t, i, 1), 's': i - 1 + length(regexp_replace(substr(t, 1, i - 1), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')), 'w': 1 + length(regexp_replace(substr(t, i, 1), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))}}) as l from blocks where k <> 'img')
    select book_id, block_no, case when n < 9 or len(list_filter(l, lambda x: (x.s < 3 and 3 < x.s + x.w) or (x.s < 9 and 9 < x.s + x.w))) > 0 then null else array_to_string(list_transform(list_filter(l, lambda x: x.s >= 3 and x.s < 9), lambda x: x.ch), '') end as part from c""",
    "book_prefixes": f"""with b as (select book_id, block_no, o, coalesce(t, '') as t, {_UNITS} as n from blocks), e as (select book_id, max(o + n) // 3 as cut from b group by 1), k as (select b.*, cut - o as want from b join e using (book_id) where o < cut),
    c as materialized (select * from k where want < n), p as (select book_id, block_no, t as text from k where want >= n union all
    select book_id, block_no, substr(t, 1, coalesce(list_max(list_filter(range(greatest(want - length(regexp_replace(substr(t, 1, want), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) - 1, 0), want + 1), lambda i: i + length(regexp_replace(substr(t, 1, i), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= want)), 0)) as text from c) select book_id, block_no, {U16.format('text')} as units, md5(text) as md5 from p""",
    "label_phrases": r"""with r as (select book_id, a_is as key, min(rtrim(trim(rel_desc), '.')) filter (where trim(rel_desc) <> '') as d from kg_log where t = 'rel' and trim(a_is) <> '' group by 1, 2),
    p as (select book_id, key, case when d <> '' then substr(string_split(array_to_string(regexp_split_to_array(d, '\s+')[1:16], ' '), ' (')[1], 1, 160) else translate(key, '_-', '  ') end as phrase from r)
    select book_id, key, case when count(*) over (partition by book_id, phrase) > 1 then phrase || ' [' || key || ']' else phrase end as label from p""",
}
_HEAD_PART = f"regexp_extract(text, '(?is)^(.*?){formats.FRAME_START}', 1)"
_FRAMED = f"regexp_matches(text, '(?i){formats.FRAME_START}')"
_BODY = f"regexp_replace(regexp_replace(text, '(?is)^.*?{formats.FRAME_START}', ''), '(?is){formats.FRAME_END}.*$', '')"
ORACLES["doc_unframed"] = f"select doc_id, md5(case when {_FRAMED} then {_BODY} else text end) as md5, case when {_FRAMED} then trim(regexp_extract({_HEAD_PART}, '{formats.TITLE_LINE}', 1)) else '' end as title, case when {_FRAMED} then trim(regexp_extract({_HEAD_PART}, '{formats.AUTHOR_LINE}', 1)) else '' end as author from documents where text is not null"
ORACLES["doc_readings"] = rf"""select doc_id, contains(substr(text, 1, 4000), '［＃') and (contains(substr(text, 1, 4000), '《') or contains(text, '{formats.COLOPHON}')) as annotated,
md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)(?:^|\n){formats.COLOPHON}.*$', ''), '{formats.NOTE}', '', 'g'), '{formats.BAR}', '', 'g'), '{formats.READING}', '', 'g')) as md5 from documents where text is not null"""
ORACLES["quotes_verbatim"] = f"""with q as (select distinct rec_id, book_id, s, quote from kg_log where t = 'rel' and quote <> '' and s is not null), b as (select book_id, o, t, {U16.format('t')} as n from blocks where t <> ''),
a as (select rec_id, quote, t, s - o as i from q join b on b.book_id = q.book_id and o <= s and s < o + n), c as (select *, i - length(regexp_replace(substr(t, 1, i), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) as low from a)
select rec_id, len(list_filter(range(greatest(low, 0), i + 1), lambda c: c + length(regexp_replace(substr(t, 1, c), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) = i and substr(t, c + 1, length(quote)) = quote)) > 0 as verbatim from c"""
ORACLES["event_titles"] = f"with {CHAPTERS}, h as (select book_id, chapter_no, arg_min(t, block_no) as title from blocks where k = 'h' group by 1, 2), e as (select distinct book_id, rec_id, p from kg_log where t = 'event' and p is not null) select rec_id, ch.chapter_no, title from e join ch on ch.book_id = e.book_id and ch.o0 <= p and p < ch.e left join h on h.book_id = ch.book_id and h.chapter_no = ch.chapter_no"
ORACLES["work_starts"] = f"with cw as ({ORACLES['collected_works']}), e as (select distinct book_id, rec_id, p from kg_log where t = 'event' and p is not null) select rec_id, coalesce(max(s), 0) as start from e left join cw on cw.book_id = e.book_id and s <= p and p <= cw.e group by 1"
ORACLES["attribute_facts"] = LG + CARD + ", a as (select distinct book_id, rec_id, id, attr_key, attr_value from lg where t = 'attr' and trim(attr_key) <> '' and trim(attr_value) <> '') select rec_id, name, tagline, attr_key, attr_value from a join card using (book_id, id)"
