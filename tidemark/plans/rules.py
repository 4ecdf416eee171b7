"""Queries on spoiler safety: what a record may say and from where, before the reader knows who is who."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions.text import u16_length
from tidemark.operators import fold
from tidemark.operators.contained import names_in_texts, whole_words
from tidemark.operators.running import within_spans
from tidemark.plans import name_sql as sql
from tidemark.plans.log import CHAPTERS, U16, WORLD, _chapters, _log
from tidemark.plans.naming import _named
from tidemark.session import cut
from tidemark.sources.tables import log_records, table

TEXTS = {"event": "text", "attr": "attr_value", "profile": "bio", "person": "intro", "rel": "rel_desc"}


def _whole(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """All records of the types, each delivery once, with their order in the book."""
    return log_records(spark, sf_dir, *kinds).where("p is not null").drop("ingested_at").withColumn("seq", F.expr(fold.SEQ))


def _entries(log: DataFrame) -> DataFrame:
    """book_id, id, entry, name: the position and name of the last introduction of each person."""
    return log.where("t = 'person' and id is not null").groupBy("book_id", "id").agg(F.max_by("p", "seq").alias("entry"), F.max_by("name", "seq").alias("shown"))


def prereveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to an identity before its introduction that belong to the identity known by then: role, was, id of each record.

    A merge into an introduced person names the earlier identity (the last such merge counts); it takes over what lies before the
    introduction, from its own introduction on.
    """
    log = cut(_whole(spark, sf_dir, "person", "merge", "event", "attr", "alias", "profile", "rel").select("book_id", "rec_id", "t", "p", "seq", "id", "name", "from_id", "into_id", "who", "a", "b"))
    entries = _entries(log)
    early = log.where("t = 'merge' and from_id is not null and into_id is not null").groupBy("book_id", F.col("into_id").alias("was")).agg(F.max_by("from_id", F.struct("seq", "rec_id")).alias("id"))
    early = early.join(entries.select("book_id", F.col("id").alias("was"), "entry"), ["book_id", "was"]).join(entries.select("book_id", "id", F.col("entry").alias("own")), ["book_id", "id"], "left")
    part = lambda t, role, c: log.where(t).select("book_id", "rec_id", "p", F.lit(role).alias("role"), c.alias("was"))
    refs = part("t = 'event'", "who", F.explode("who")).unionByName(part("t in ('attr', 'alias', 'profile')", "id", F.col("id"))).unionByName(part("t = 'rel'", "a", F.col("a"))).unionByName(part("t = 'rel'", "b", F.col("b")))
    moved = refs.where("was is not null").distinct().join(early, ["book_id", "was"])
    return moved.where("p < entry and coalesce(own, -1) <= p and id <> was").select("rec_id", "role", "was", "id")


def _reveals(log: DataFrame) -> DataFrame:
    """book_id, name, q, old: names that become known at q, and what the reader calls the person before."""
    entries = _entries(log)
    renamed = log.where("t = 'name' and trim(name) <> ''").join(entries, ["book_id", "id"]).select("book_id", "name", F.col("p").alias("q"), F.col("shown").alias("old"))
    early = log.where("t = 'merge' and from_id is not null and into_id is not null").groupBy("book_id", F.col("into_id").alias("id")).agg(F.max_by("from_id", F.struct("seq", "rec_id")).alias("src"))
    merged = early.join(entries, ["book_id", "id"]).join(entries.select("book_id", F.col("id").alias("src"), F.col("shown").alias("old")), ["book_id", "src"]).select("book_id", F.col("shown").alias("name"), F.col("entry").alias("q"), "old")
    return renamed.unionByName(merged).where("trim(name) <> '' and trim(old) <> '' and name <> old").distinct()


def _texts(log: DataFrame) -> DataFrame:
    """book_id, rec_id, t, p, text of the records that hold generated text; those delivered again stand there again."""
    text = F.coalesce(*(F.when(F.col("t") == t, F.col(c)) for t, c in TEXTS.items()))
    return log.where(F.col("t").isin(*TEXTS)).select("book_id", "rec_id", "t", "p", text.alias("text")).where("trim(text) <> ''")


def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that would give a name away before it is known, with the name replaced by what the reader calls the person: the longest name first.

    Only texts that hold such a name meet the list of their book's reveals, which is applied in order.
    """
    log = cut(_whole(spark, sf_dir, "person", "merge", "name").select("book_id", "rec_id", "t", "p", "seq", "id", "name", "from_id", "into_id"))
    reveals, texts = cut(_reveals(log)), _texts(_whole(spark, sf_dir, *TEXTS))
    hits = names_in_texts(texts, reveals.groupBy("book_id", "name").agg(F.max("q").alias("q")), "book_id", "text", "name", ("p", "q")).select(*texts.columns).distinct()
    lists = reveals.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("l"), "name", "q", "old"))).alias("reveals"))
    swap = lambda text, r: F.when((F.col("p") < r["q"]) & text.contains(r["name"]), F.replace(F.replace(text, F.concat(r["old"], r["name"]), r["old"]), r["name"], r["old"])).otherwise(text)
    out = hits.join(lists.hint("merge"), "book_id").select("rec_id", "t", "text", F.aggregate("reveals", F.col("text"), swap).alias("safe"))
    return out.where("safe <> text").select("rec_id", "t", "safe")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word occurrences of the strong names of a book in its blocks: book_id, block_no, name, at (first UTF-16 position in the book), end, times."""
    named = _named(spark, sf_dir).where((F.length("name") >= 2) & ~N.is_generic(F.col("name"))).select("book_id", "name").distinct()
    blocks = table(spark, sf_dir, "blocks").where("t <> ''").select("book_id", "block_no", "o", "t")
    return whole_words(blocks, named, "book_id", "t", "name").select("book_id", "block_no", "name", (F.col("o") + u16_length(F.substring("t", F.lit(1), F.col("place") - 1))).alias("at"), "times").withColumn("end", F.col("at") + u16_length(F.col("name")))


def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each name of a book first stands in its text as a whole word: at, end; and in how many blocks."""
    return _mentions(spark, sf_dir).groupBy("book_id", "name").agg(F.min("at").alias("at"), F.min("end").alias("end"), F.count(F.lit(1)).alias("blocks"))


def text_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text holds a name that first stands in the book later: the position they are raised to."""
    log = _whole(spark, sf_dir, "event", "attr", "profile", "rel")
    first = cut(first_mentions(spark, sf_dir).select("book_id", "name", "end"))  # names are read twice
    hits = names_in_texts(_texts(log), first, "book_id", "text", "name", ("p", "end"))
    return hits.groupBy("rec_id").agg(F.max("p").alias("p"), F.max("end").alias("raised"))


def block_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each name in each block, the longest name first and none inside another; ambiguous where several persons bear it.

    The names that occur in a block are found by their beginnings; one alternation of these, made for the block, then reads its text from left to right.
    """
    found = _mentions(spark, sf_dir).select("book_id", "block_no", "name")
    quoted = F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E"))
    patterns = found.groupBy("book_id", "block_no").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("l"), "name", quoted.alias("quoted")))).alias("names"))
    pattern = F.concat(F.lit("(?<![A-Za-z])("), F.array_join(F.transform("names", lambda n: n["quoted"]), "|"), F.lit(")(?![A-Za-z])"))
    blocks = table(spark, sf_dir, "blocks").select("book_id", "block_no", "t")
    hits = blocks.join(patterns.select("book_id", "block_no", pattern.alias("pattern")), ["book_id", "block_no"]).select("book_id", "block_no", F.explode(F.regexp_extract_all("t", F.col("pattern"), F.lit(1))).alias("name"))
    owners = _named(spark, sf_dir).groupBy("book_id", "name").agg((F.countDistinct("id") > 1).alias("ambiguous"))
    return hits.groupBy("book_id", "block_no", "name").agg(F.count(F.lit(1)).alias("mentions")).join(owners, ["book_id", "name"])


def chapter_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by chapter: in how many of its blocks each first-known spelling stands, by a range join of positions and chapters."""
    mentions = _mentions(spark, sf_dir).select("book_id", "name", "at")
    return within_spans(mentions, _chapters(spark, sf_dir), "book_id", "at", "o0", "end").groupBy("book_id", "chapter_no").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("name").alias("names"))


def withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that refer to a tainted identity from the position of its taint on, by type. Introductions stay, without their text."""
    merges = log_records(spark, sf_dir, "merge").where("from_id is not null and into_id is not null and from_id <> into_id")
    joined = merges.select(F.concat_ws("/", "book_id", "from_id").alias("a"), F.concat_ws("/", "book_id", "into_id").alias("b"), "p")
    seeds = log_records(spark, sf_dir, "merge").where("from_id is not null").groupBy("book_id").agg(F.min("from_id").alias("s"), F.min("p").alias("taint")).select(F.concat_ws("/", "book_id", "s").alias("id"), "taint")
    taints = fold.quarantine(seeds, joined).select(F.col("id").alias("ref"), "taint")
    log = _whole(spark, sf_dir, "person", "name", "alias", "attr", "profile", "imp", "rel", "merge", "event", "cnt")
    own = F.array("id", "a", "b", "from_id", "into_id")
    none = F.array().cast("array<string>")
    refs = log.select("book_id", "rec_id", "t", "p", F.explode(F.array_distinct(F.concat(own, F.coalesce("who", none), F.coalesce(F.map_keys("c"), none)))).alias("id")).where("id is not null").distinct()
    hit = refs.withColumn("ref", F.concat_ws("/", "book_id", "id")).join(taints, "ref").where("p >= taint")
    return hit.groupBy("t").agg(F.countDistinct("rec_id").alias("records"))


def merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons after merges as a registry keeps them: how many ids they unite, mentions summed, the greatest importance, all spellings."""
    log = _log(spark, sf_dir, "person", "name", "alias", "profile", "imp", "cnt", "merge")
    rows = cut(fold.members(cut(fold.people(log)), cut(fold.merge_map(log))))
    names = log.where("t in ('person', 'name', 'alias')").select("book_id", "id", F.coalesce("name", "alias").alias("spelling")).where("trim(spelling) <> ''").distinct()
    spelled = rows.select("book_id", "id", "to").join(names, ["book_id", "id"]).groupBy("book_id", F.col("to").alias("id")).agg(F.countDistinct("spelling").alias("spellings"))
    merged = rows.groupBy("book_id", F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("mentions"), F.max("imp").alias("imp"))
    return merged.join(spelled, ["book_id", "id"], "left").na.fill(0, ["spellings"])


def active_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most active persons of the last third of what the reader knows: two events or more, or of importance three."""
    log = cut(_log(spark, sf_dir, "person", "name", "profile", "imp", "cnt", "merge", "event"))
    rows = cut(fold.members(cut(fold.people(log)), cut(fold.merge_map(log))))
    ends = log.groupBy("book_id").agg((F.max("p") * 2 / 3).alias("since"))
    who = log.where("t = 'event'").join(ends, "book_id").where("p >= since").select("book_id", "rec_id", F.explode("who").alias("id")).join(rows.select("book_id", "id", "to"), ["book_id", "id"]).select("book_id", "rec_id", F.col("to").alias("id")).distinct()
    counts = who.groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("events"))
    cards = fold.merged_cards(rows).select("book_id", "id", "imp")
    fit = counts.join(cards, ["book_id", "id"]).where("events >= 2 or imp >= 3")
    return fit.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("events"), "id")).cast("long")).where("place <= 10")


QUERIES = {
    "rule_prereveal": prereveal,
    "rule_scrubbed": scrubbed,
    "rule_first_mentions": first_mentions,
    "rule_text_floors": text_floors,
    "rule_block_mentions": block_mentions,
    "rule_chapter_mentions": chapter_mentions,
    "rule_withheld": withheld,
    "rule_merged_registry": merged_registry,
    "rule_active_people": active_people,
}

_WH = "wh as materialized (select * from kg_log where p is not null qualify row_number() over (partition by rec_id order by ingested_at) = 1), sq as materialized (select *, p * 4294967296 + coalesce(ord, 0) as seq from wh)"
_EN = "en as materialized (select book_id, id, arg_max(p, seq) as entry, arg_max(name, seq) as shown from sq where t = 'person' and id is not null group by 1, 2), ea as (select book_id, into_id as was, arg_max(from_id, [seq, rec_id]) as id from sq where t = 'merge' and from_id is not null and into_id is not null group by 1, 2)"
_TX = "tx as materialized (select distinct book_id, rec_id, t, p, case t when 'event' then text when 'attr' then attr_value when 'profile' then bio when 'person' then intro when 'rel' then rel_desc end as text from sq where t in ('event', 'attr', 'profile', 'person', 'rel'))"
_MENTIONS = f"""nm as materialized (select distinct book_id, coalesce(name, alias) as name from kg_log where t in ('person', 'name', 'alias') and id is not null and length(coalesce(name, alias)) >= 2 and trim(coalesce(name, alias)) <> '' and not {sql.generic('coalesce(name, alias)')}),
me as materialized (select b.book_id, b.block_no, nm.name, o + u16 as "at", o + u16 + {U16.format('nm.name')} as e from (
  select blocks.book_id, block_no, o, t, name, regexp_extract(' ' || t || ' ', '(?s)^(.*?[^A-Za-z])' || regexp_escape(name) || '[^A-Za-z]', 1) as pre, {U16.format("regexp_extract(' ' || t || ' ', '(?s)^(.*?[^A-Za-z])' || regexp_escape(name) || '[^A-Za-z]', 1)")} - 1 as u16
  from blocks join nm using (book_id) where contains(t, name)) b join nm on nm.book_id = b.book_id and nm.name = b.name where pre <> '')"""

ORACLES = {
    "rule_prereveal": f"""with {_WH}, {_EN}, rf as (select distinct * from (select book_id, rec_id, p, 'who' as role, unnest(who) as was from sq where t = 'event' union all select book_id, rec_id, p, 'id', id from sq where t in ('attr', 'alias', 'profile')
    union all select book_id, rec_id, p, 'a', a from sq where t = 'rel' union all select book_id, rec_id, p, 'b', b from sq where t = 'rel') where was is not null)
    select rec_id, role, rf.was, ea.id from rf join ea using (book_id, was) join en on en.book_id = rf.book_id and en.id = rf.was left join en own on own.book_id = rf.book_id and own.id = ea.id where p < en.entry and coalesce(own.entry, -1) <= p and ea.id <> rf.was""",
    "rule_scrubbed": f"""with recursive {_WH}, {_EN}, {_TX},
    rv0 as (select sq.book_id, sq.name, p as q, shown as old from sq join en using (book_id, id) where t = 'name' and trim(name) <> '' union select ea.book_id, e1.shown, e1.entry, e2.shown from ea join en e1 on e1.book_id = ea.book_id and e1.id = ea.was join en e2 on e2.book_id = ea.book_id and e2.id = ea.id),
    rv as materialized (select *, row_number() over (partition by book_id order by -length(name), name, q, old) as i from rv0 where trim(name) <> '' and trim(old) <> '' and name <> old),
    st(book_id, rec_id, t, p, i, was, text) as (select book_id, rec_id, t, p, 0, text, text from tx where trim(text) <> '' and exists (select 1 from rv where rv.book_id = tx.book_id and contains(tx.text, rv.name) and tx.p < rv.q)
      union all select st.book_id, rec_id, t, p, rv.i, was, case when p < q and contains(text, name) then replace(replace(text, old || name, old), name, old) else text end from st join rv on rv.book_id = st.book_id and rv.i = st.i + 1),
    la as (select * from st qualify row_number() over (partition by rec_id, t, was order by i desc) = 1) select rec_id, t, text as safe from la where text <> was""",
    "rule_first_mentions": f"""with {_MENTIONS} select book_id, name, min("at") as "at", min(e) as "end", count(*) as blocks from me group by 1, 2""",
    "rule_text_floors": f"with {_MENTIONS}, {_WH}, {_TX}, f as materialized (select book_id, name, min(e) as e from me group by 1, 2) select rec_id, max(p) as p, max(e) as raised from tx join f on f.book_id = tx.book_id and contains(text, name) and e > p where t <> 'person' group by 1",
    "rule_chapter_mentions": f"""with {_MENTIONS}, {CHAPTERS} select me.book_id, chapter_no, count(*) as mentions, count(distinct name) as names from me join ch on ch.book_id = me.book_id and ch.o0 <= "at" and "at" < ch.e group by 1, 2""",
    "rule_withheld": """with recursive m as (select distinct book_id || '/' || from_id as a, book_id || '/' || into_id as b, p from kg_log where t = 'merge' and from_id <> into_id and p is not null), e as (select a, b, p from m union all select b, a, p from m),
    r(id, t) as (select book_id || '/' || min(from_id), min(p) from kg_log where t = 'merge' and from_id is not null group by book_id union select e.b, greatest(r.t, e.p) from r join e on e.a = r.id), tn as (select id, min(t) as taint from r group by 1),
    rf as (select book_id, rec_id, t, p, unnest(list_concat([id, a, b, from_id, into_id], coalesce(who, []), coalesce(map_keys(c), []))) as id from kg_log where p is not null and t not in ('recap', 'saga'))
    select t, count(distinct rec_id) as records from rf join tn on tn.id = book_id || '/' || rf.id and p >= taint group by 1""",
    "rule_merged_registry": WORLD + """, sp as (select r.book_id, r.dest as id, count(distinct x.n) as spellings from r join (select book_id, id, coalesce(name, alias) as n from lg where t in ('person', 'name', 'alias')) x using (book_id, id) where trim(x.n) <> '' group by 1, 2)
    select r.book_id, r.dest as id, count(*) as ids, cast(sum(r.n) as bigint) as mentions, max(r.imp) as imp, coalesce(max(spellings), 0) as spellings from r left join sp on sp.book_id = r.book_id and sp.id = r.dest group by r.book_id, r.dest""",
    "rule_active_people": WORLD + """, en as (select book_id, max(p) * 2 / 3 as since from lg where t in ('person', 'name', 'profile', 'imp', 'cnt', 'merge', 'event') group by 1), ev as (select distinct x.book_id, x.rec_id, r.dest as id from (select book_id, rec_id, unnest(who) as id, p from lg where t = 'event') x join en using (book_id) join r on r.book_id = x.book_id and r.id = x.id where p >= since),
    ct as (select book_id, id, count(*) as events from ev group by 1, 2) select book_id, id, events, imp, row_number() over (partition by book_id order by events desc, id) as place from ct join w using (book_id, id) where events >= 2 or imp >= 3 qualify place <= 10""",
}
