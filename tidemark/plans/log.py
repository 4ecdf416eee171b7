"""Queries over the fact log: slices, the as-of fold, identities, relations, counts, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.names import is_generic
from tidemark.functions.text import u16_length
from tidemark.operators import fold
from tidemark.operators.running import running, within_spans
from tidemark.plans import name_sql as sql
from tidemark.session import cut
from tidemark.sources.tables import log_records, table

#: How far into each book the reader is.
SHARE = 0.6
#: Bounds of the range slice.
LOW, HIGH = 5_000, 20_000

LG = """
with first_delivery as (select * from kg_log where p is not null qualify row_number() over (partition by rec_id order by ingested_at) = 1),
cutoffs as (select book_id, cast(floor(max(p) * 0.6) as bigint) as pos from kg_log group by 1),
lg as (select k.*, k.p * 4294967296 + coalesce(k.ord, 0) as seq from first_delivery k join cutoffs using (book_id) where k.p <= pos),
per as (select book_id, id, min(seq) as f, max(seq) as lp from lg where t = 'person' group by 1, 2),
eff as (select lg.*, per.f, per.lp, greatest(seq, f) as eo from lg join per using (book_id, id) where greatest(seq, f) >= lp and (seq > lp or f = lp)),
m as (select book_id, from_id as id, arg_max(into_id, seq) as into_id, min(seq) as mo from lg where t = 'merge' and from_id is not null and into_id is not null group by 1, 2),
"""
CARD = """
base as (select book_id, id, arg_max(name, seq) as name0, arg_max(intro, seq) as intro0, arg_max(imp, seq) as imp0 from lg where t = 'person' group by 1, 2),
st as (select book_id, id, arg_max(name, [eo, seq]) filter (where t = 'name' and trim(name) <> '') as name1,
              arg_max(tagline, [eo, seq]) filter (where t = 'profile' and trim(tagline) <> '') as tagline1,
              arg_max(bio, [eo, seq]) filter (where t = 'profile' and trim(bio) <> '') as bio1,
              arg_max(imp, [eo, seq]) filter (where t = 'imp' and imp is not null) as imp1
       from eff where t in ('name', 'profile', 'imp') group by 1, 2),
cn as (select e.book_id, e.id, cast(sum(e.k) as bigint) as n
       from (select book_id, seq, unnest(map_keys(c)) as id, unnest(map_values(c)) as k from lg where t = 'cnt' and c is not null) e join per using (book_id, id) where e.seq > per.lp group by 1, 2),
card as (select book_id, id, coalesce(name1, name0) as name, coalesce(tagline1, intro0) as tagline, bio1 as bio, coalesce(imp1, imp0, 1) as imp, coalesce(n, 0) as n
         from base left join st using (book_id, id) left join cn using (book_id, id))
"""
CANON = """
walk(book_id, id, cur, seen) as (
  select book_id, id, into_id, [id] from m
  union all
  select w.book_id, w.id, m.into_id, list_append(w.seen, w.cur) from walk w join m on m.book_id = w.book_id and m.id = w.cur where not list_contains(w.seen, w.cur)),
canon as (select book_id, id, arg_max(cur, len(seen)) as canon from walk group by 1, 2)
"""


def _log(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The known records of the given types. The cutoffs read one column of the whole log."""
    whole = table(spark, sf_dir, "kg_log").select("book_id", "p")
    return fold.known(log_records(spark, sf_dir, *kinds), fold.cutoffs(whole, SHARE))


def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a range of positions, with the number of the book's records before it."""
    log = table(spark, sf_dir, "kg_log").select("rec_id", "book_id", "p", "t").where("p is not null").distinct()
    before = log.where(F.col("p") <= LOW).groupBy("book_id").agg(F.count(F.lit(1)).alias("before"))
    return log.where((F.col("p") > LOW) & (F.col("p") <= HIGH)).join(before, "book_id", "left").select("rec_id", "book_id", "p", "t", F.coalesce("before", F.lit(0)).cast("long").alias("before"))


RANGE_SQL = f"""
with l as (select distinct rec_id, book_id, p, t from kg_log where p is not null),
b as (select book_id, count(*) as n from l where p <= {LOW} group by 1)
select rec_id, l.book_id, p, t, coalesce(n, 0) as before from l left join b using (book_id) where p > {LOW} and p <= {HIGH}
"""


def asof_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known records by book and type."""
    log = fold.known(table(spark, sf_dir, "kg_log").select("book_id", "rec_id", "t", "p", "ord", "ingested_at"), fold.cutoffs(table(spark, sf_dir, "kg_log"), SHARE))
    return log.select("book_id", "t", "rec_id").distinct().groupBy("book_id", "t").agg(F.count(F.lit(1)).alias("records"))


def fold_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.people(_log(spark, sf_dir, "person", "name", "profile", "imp", "cnt"))


def fold_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.world(_log(spark, sf_dir, "person", "name", "profile", "imp", "cnt", "merge"))


WORLD = (
    LG.replace("with first", "with recursive first").rstrip().rstrip(",")
    + ","
    + CANON
    + ","
    + CARD
    + f""",
r as materialized (select card.*, m.mo, case when ex.id is not null then canon.canon else card.id end as dest
      from card left join canon using (book_id, id) left join m using (book_id, id) left join card ex on ex.book_id = card.book_id and ex.id = canon.canon),
g as (select *, id = dest as own, {sql.generic('name')} as generic from r),
a as (select book_id, dest as id, max(name) filter (where own) as name0, bool_or(generic) filter (where own) as generic0, arg_min(name, mo) filter (where not own and not coalesce(generic, true)) as name1,
             max(tagline) filter (where own) as tagline, max(bio) filter (where own) as bio0, arg_min(bio, mo) filter (where not own and trim(bio) <> '') as bio1,
             max(imp) filter (where own) as imp, cast(sum(n) as bigint) as n from g group by 1, 2),
w as materialized (select book_id, id, case when coalesce(generic0, true) and name1 is not null then name1 else name0 end as name, tagline, case when trim(coalesce(bio0, '')) <> '' then bio0 else bio1 end as bio, imp, n from a)
"""
)
WORLD_SQL = WORLD + " select * from w"


def world_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.world_aliases(_log(spark, sf_dir, "person", "name", "alias", "profile", "imp", "cnt", "merge"))


def world_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.world_attributes(_log(spark, sf_dir, "person", "attr", "merge"))


def attribute_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of each attribute of an introduced person, by position: its number, the value before, and where the next one begins."""
    rows = fold.effective(_log(spark, sf_dir, "person", "attr"), "attr").where("attr_key is not null").select("book_id", "id", "rec_id", F.lower(F.trim("attr_key")).alias("key"), "attr_value", "p", "eff").distinct()
    order = Window.partitionBy("book_id", "id", "key").orderBy("p", "eff", "rec_id")
    return rows.select("rec_id", "book_id", "id", "key", "attr_value", F.row_number().over(order).cast("long").alias("version"), F.lag("attr_value").over(order).alias("was"), F.lead("p").over(order).alias("until"))


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the persons that are left after merges: each event once for all ids that became one person."""
    log = _log(spark, sf_dir, "person", "name", "profile", "imp", "cnt", "merge", "event")
    rows = fold.members(fold.introductions(log).select("book_id", "id"), cut(fold.merge_map(log))).select("book_id", "id", "to")
    who = log.where("t = 'event'").select("book_id", "rec_id", "p", "imp", F.explode("who").alias("id")).join(rows, ["book_id", "id"]).select("book_id", "rec_id", "p", "imp", F.col("to").alias("id")).distinct()
    return who.groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("imp") >= 2, 1)).alias("important"), F.min("p").alias("first_p"), F.max("p").alias("last_p"))


def canon_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where following the merges from each merged id ends."""
    return fold.canonical(cut(fold.merge_map(_log(spark, sf_dir, "merge"))))


def current_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.current_attributes(_log(spark, sf_dir, "person", "attr"))


def attribute_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a person whose last four values differ."""
    rows = _log(spark, sf_dir, "attr").where("id is not null and attr_key is not null and trim(attr_value) <> ''").select("book_id", "id", F.lower(F.trim("attr_key")).alias("key"), "attr_value", "seq", "rec_id").distinct()
    window = Window.partitionBy("book_id", "id", "key").orderBy(F.desc("seq"), F.desc("rec_id"))
    last = rows.withColumn("k", F.row_number().over(window)).where("k <= 4")
    return last.groupBy("book_id", "id", "key").agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("attr_value").alias("values")).where("values > 1")


def name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name of a person with the first position at which it is known."""
    rows = _log(spark, sf_dir, "person", "name", "alias").select("book_id", "id", F.coalesce("name", "alias").alias("name"), "p").where("id is not null and trim(name) <> ''")
    return rows.groupBy("book_id", "id", "name").agg(F.min("p").alias("first_p"), F.max("p").alias("last_p"))


def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a book with two owners or more, without epithets."""
    rows = log_records(spark, sf_dir, "person", "name", "alias").select("book_id", "id", F.lower(F.coalesce("name", "alias")).alias("name")).where("trim(name) <> ''").where(~is_generic(F.col("name")))
    return rows.groupBy("book_id", "name").agg(F.countDistinct("id").alias("owners"), F.min("id").alias("first_owner")).where("owners > 1")


def unique_owner_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that exactly one other person of the book has as a name: links by a unique owner."""
    owners = log_records(spark, sf_dir, "person").where("name is not null").groupBy("book_id", F.lower("name").alias("alias")).agg(F.min("id").alias("owner"), F.max("id").alias("other")).where("owner = other")
    aliases = log_records(spark, sf_dir, "alias").where("alias is not null").select("book_id", "id", F.lower("alias").alias("alias")).distinct()
    return aliases.join(owners, ["book_id", "alias"]).where("id <> owner").select("book_id", "id", "alias", "owner")


def relation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fold.relation_history(fold.relations(_log(spark, sf_dir, "rel")))
    return rows.select("rec_id", "book_id", "a", "b", "a_is", "b_is", "rel_desc", "status")


def current_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.current_relations(fold.relations(_log(spark, sf_dir, "rel")))


def canonical_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between canonical persons, sides in order, with their number of records."""
    canon = cut(fold.canonical(cut(fold.merge_map(_log(spark, sf_dir, "merge")))))
    rows = _log(spark, sf_dir, "rel").select("book_id", "rec_id", "a", "b").where("a is not null and b is not null").distinct()
    rows = fold.with_canon(fold.with_canon(rows, canon, "a", "ca"), canon, "b", "cb").where("ca <> cb")
    return rows.groupBy("book_id", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count(F.lit(1)).alias("records"))


def person_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each introduced person: how many, how many important, first and last position."""
    log = _log(spark, sf_dir, "person", "event")
    who = log.where("t = 'event'").select("book_id", "rec_id", "p", "imp", F.explode(F.array_distinct("who")).alias("id")).where("id is not null").distinct()
    return who.join(fold.introductions(log).select("book_id", "id"), ["book_id", "id"], "left_semi").groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("imp") >= 2, 1)).alias("important"), F.min("p").alias("first_p"), F.max("p").alias("last_p"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with events and score: mentions + 8 x importance + 2 x events."""
    cards = fold_people(spark, sf_dir).join(person_events(spark, sf_dir), ["book_id", "id"], "left").withColumn("events", F.coalesce("events", F.lit(0)).cast("long"))
    return cards.select("book_id", "id", "name", "imp", "n", "events", (F.col("n") + 8 * F.col("imp") + 2 * F.col("events")).cast("long").alias("score"))


def ranked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most prominent persons of each book."""
    window = Window.partitionBy("book_id").orderBy(F.desc("score"), "id")
    return _ranked(spark, sf_dir).withColumn("place", F.row_number().over(window)).where("place <= 10").withColumn("place", F.col("place").cast("long"))


RANKED = (
    LG
    + CARD
    + """,
ev as (select book_id, w.id, count(*) as events from (select distinct book_id, rec_id, unnest(who) as id from lg where t = 'event') w join per using (book_id, id) group by 1, 2),
ranked as (select book_id, id, name, imp, n, coalesce(events, 0) as events, cast(n + 8 * imp + 2 * coalesce(events, 0) as bigint) as score from card left join ev using (book_id, id))
"""
)


def cast_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by tier of each book."""
    tier = F.when((F.col("imp") >= 3) | (F.col("n") >= 40) | (F.col("events") >= 15), 3).when((F.col("n") >= 8) | (F.col("events") >= 4), 2).otherwise(1)
    return _ranked(spark, sf_dir).groupBy("book_id", tier.alias("tier")).agg(F.count(F.lit(1)).alias("people"), F.sum("n").alias("mentions"))


def walk_ons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of hardly any mention, event or relation."""
    linked = fold.relations(_log(spark, sf_dir, "rel")).select("book_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    return _ranked(spark, sf_dir).where("imp < 3 and n <= 1 and events <= 1").join(linked, ["book_id", "id"], "left_anti").select("book_id", "id", "name")


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of every id of a count, introduced or not."""
    rows = log_records(spark, sf_dir, "cnt").where("c is not null").select("book_id", "rec_id", F.explode("c").alias("id", "k")).distinct()
    return rows.groupBy("book_id", "id").agg(F.sum("k").alias("mentions"), F.count(F.lit(1)).alias("records"))


def importance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance records that change the rating before them."""
    rows = log_records(spark, sf_dir, "imp").where("p is not null and id is not null and imp is not null").select("book_id", "id", "rec_id", "imp", F.expr(fold.SEQ).alias("seq")).distinct()
    before = F.lag("imp").over(Window.partitionBy("book_id", "id").orderBy("seq", "rec_id"))
    return rows.withColumn("was", before).where("was is null or was <> imp").select("rec_id", "book_id", "id", "was", "imp")


def latest_sagas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last summary strictly before the reader's position."""
    whole = table(spark, sf_dir, "kg_log").select("book_id", "p")
    rows = log_records(spark, sf_dir, "saga").select("book_id", "p", "rec_id", "text", "ord").where("p is not null and text is not null").join(fold.cutoffs(whole, SHARE), "book_id").where("p < pos")
    return rows.groupBy("book_id").agg(F.max_by("rec_id", F.struct("p", "ord")).alias("rec_id"), F.max("p").alias("p"))


def recaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest recap of each chapter."""
    rows = _log(spark, sf_dir, "recap").where("chapter is not null and text is not null")
    return rows.groupBy("book_id", "chapter").agg(F.max_by("text", "seq").alias("text"), F.countDistinct("rec_id").alias("versions"))


def cooccurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of persons of one event, with the number of their events."""
    events = log_records(spark, sf_dir, "event").select("rec_id", "book_id", F.array_sort(F.array_distinct(F.filter("who", lambda x: x.isNotNull()))).alias("w")).where("size(w) > 1").distinct()
    # Each event makes its own pairs, split by their first member: no join, and no row longer than the event.
    firsts = events.select("book_id", "w", F.posexplode("w").alias("i", "a"))
    return firsts.select("book_id", "a", F.explode(F.slice("w", F.col("i") + 2, F.size("w"))).alias("b")).groupBy("book_id", "a", "b").agg(F.count(F.lit(1)).alias("events"))


def never_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related pairs that share no event."""
    return current_relations(spark, sf_dir).select("book_id", "a", "b").join(cooccurring(spark, sf_dir), ["book_id", "a", "b"], "left_anti")


def held_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that arrive before the introduction of their person and are held until then, by type; and how many of them the introduction precedes by position."""
    log = log_records(spark, sf_dir, "person", "name", "alias", "attr", "profile", "imp").where("ord is not null and id is not null").select("book_id", "id", "rec_id", "t", "ord", "p").distinct()
    first = log.where("t = 'person'").groupBy("book_id", "id").agg(F.min("ord").alias("first"), F.min("p").alias("entry"))
    return log.where("t <> 'person'").join(first, ["book_id", "id"]).where("ord < first").groupBy("book_id", "t").agg(F.count(F.lit(1)).alias("held"), F.count(F.when(F.col("p") >= F.col("entry"), 1)).alias("after_entry"))


def late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that arrive behind a position already reached, by book: what a range cursor would miss."""
    log = table(spark, sf_dir, "kg_log").select("book_id", "rec_id", "ord", "p").where("p is not null and ord is not null").distinct()
    reached = running(log, ["book_id"], "ord", ["rec_id"], "p", "reached", F.max, inclusive=False)
    return reached.where("p < reached").groupBy("book_id").agg(F.count(F.lit(1)).alias("late"), F.max(F.col("reached") - F.col("p")).alias("most"))


def entry_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the position from which all their introduced persons are known."""
    log = log_records(spark, sf_dir, "person", "event").where("p is not null")
    first = log.where("t = 'person'").groupBy("book_id", "id").agg(F.min("p").alias("entry"))
    who = log.where("t = 'event'").select("book_id", "rec_id", "p", F.explode(F.array_distinct("who")).alias("id")).where("id is not null").distinct()
    return who.join(first, ["book_id", "id"]).groupBy("rec_id").agg(F.greatest(F.max("p"), F.max("entry")).alias("safe_p"), F.max("p").alias("p"))


def chapter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the chapter that holds their position: a range join."""
    spans = _chapters(spark, sf_dir)
    events = log_records(spark, sf_dir, "event").where("p is not null").select("book_id", "rec_id", "p", "imp").distinct()
    return within_spans(events, spans, "book_id", "p", "o0", "end").groupBy("book_id", "chapter_no").agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("imp") >= 2, 1)).alias("important"))


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, chapter_no, o0, end: from a chapter's first block to the next chapter's."""
    ends = F.col("o") + u16_length(F.coalesce("t", F.lit(""))) + 1
    starts = table(spark, sf_dir, "blocks").groupBy("book_id", "chapter_no").agg(F.min("o").alias("o0"), F.max(ends).alias("last"))
    return starts.withColumn("end", F.coalesce(F.lead("o0").over(Window.partitionBy("book_id").orderBy("o0")), "last")).select("book_id", "chapter_no", "o0", "end")


U16 = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
CHAPTERS = f"ch as (select book_id, chapter_no, min(o) as o0, coalesce(lead(min(o)) over (partition by book_id order by min(o)), max(o + {U16.format("coalesce(t, '')")}) + 1) as e from blocks group by 1, 2)"


def tainted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimax spread of a wrong identity from the smallest id of each book's merges."""
    merges = log_records(spark, sf_dir, "merge").select(F.concat_ws("/", "book_id", "from_id").alias("a"), F.concat_ws("/", "book_id", "into_id").alias("b"), "p").where("from_id is not null and into_id is not null and from_id <> into_id")
    seeds = log_records(spark, sf_dir, "merge").where("from_id is not null").groupBy("book_id").agg(F.min("from_id").alias("s"), F.min("p").alias("taint")).select(F.concat_ws("/", "book_id", "s").alias("id"), "taint")
    return fold.quarantine(seeds, merges)


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to verify: all important ones and one text in six of the others."""
    from tidemark.functions.text import hash_share

    rows = log_records(spark, sf_dir, "event").where("text is not null").select("rec_id", "imp", "text").distinct()
    return rows.where((F.col("imp") >= 3) | hash_share(F.col("text"), 6)).select("rec_id", "imp")


def source_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by model, by type and by both: grouping sets in one pass."""
    rows = table(spark, sf_dir, "kg_log").select("rec_id", "model", "t").distinct()
    return rows.cube("model", "t").agg(F.count(F.lit(1)).alias("records"), F.grouping_id().alias("level")).where("level < 3")


def first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records delivered more than once: deliveries, first and last."""
    rows = table(spark, sf_dir, "kg_log").groupBy("rec_id").agg(F.count(F.lit(1)).alias("deliveries"), F.min("ingested_at").alias("first"), F.max("ingested_at").alias("last"))
    return rows.where("deliveries > 1")


QUERIES = {
    "log_range_slice": range_slice,
    "log_asof_counts": asof_counts,
    "log_fold_people": fold_people,
    "log_fold_world": fold_world,
    "log_world_aliases": world_aliases,
    "log_world_attributes": world_attributes,
    "log_attribute_history": attribute_history,
    "log_canonical_events": canonical_events,
    "log_canon_chain": canon_chain,
    "log_current_attributes": current_attributes,
    "log_attribute_conflicts": attribute_conflicts,
    "log_name_history": name_history,
    "log_ambiguous_names": ambiguous_names,
    "log_unique_owner_links": unique_owner_links,
    "log_relation_versions": relation_versions,
    "log_current_relations": current_relations,
    "log_canonical_relations": canonical_relations,
    "log_person_events": person_events,
    "log_ranked_people": ranked_people,
    "log_cast_tiers": cast_tiers,
    "log_walk_ons": walk_ons,
    "log_mention_counts": mention_counts,
    "log_importance_changes": importance_changes,
    "log_latest_sagas": latest_sagas,
    "log_recaps": recaps,
    "log_cooccurring": cooccurring,
    "log_never_together": never_together,
    "log_held_records": held_records,
    "log_late_records": late_records,
    "log_entry_floor": entry_floor,
    "log_chapter_events": chapter_events,
    "log_tainted": tainted,
    "log_hash_sample": hash_sample,
    "log_source_composition": source_composition,
    "log_first_deliveries": first_deliveries,
}

_L = LG.rstrip().rstrip(",")
_REL = """,
rr as (select book_id, rec_id, seq, least(a, b) as a1, greatest(a, b) as b1, case when a > b then b_is else a_is end as ai, case when a > b then a_is else b_is end as bi, rel_desc as de, status as st from lg where t = 'rel' and a <> b)
"""
_NAMES = "(select distinct book_id, id, t, lower(coalesce(name, alias)) as n from kg_log where t in ('person', 'name', 'alias'))"
_PAIRS = """pairs as (select book_id, x as a, y as b, count(*) as events from (
  select rec_id, book_id, unnest(w) as x, w from (select distinct rec_id, book_id, list_sort(list_distinct(who)) as w from kg_log where t = 'event')) s, unnest(s.w) as u(y) where x < y group by 1, 2, 3)"""

ORACLES = {
    "log_range_slice": RANGE_SQL,
    "log_asof_counts": _L + " select book_id, t, count(*) as records from lg group by 1, 2",
    "log_fold_people": LG + CARD + " select * from card",
    "log_fold_world": WORLD_SQL,
    "log_world_aliases": WORLD
    + f""", al as (select distinct r.book_id, r.dest as id, x.alias from r join (select book_id, id, arg_max(name, seq) as alias from lg where t = 'person' group by 1, 2 union all select book_id, id, coalesce(name, alias) from eff where t in ('name', 'alias')) x using (book_id, id))
    select book_id, id, alias from (select *, regexp_replace(alias, '^[他她的老小未]+', '') as stripped from al) al join w using (book_id, id) where trim(alias) <> '' and alias is distinct from w.name and not {sql.generic('alias')} and not {sql.generic(chr(34) + 'stripped' + chr(34))} and not regexp_matches(alias, '{fold.NO_ALIAS}')
    and not exists (select 1 from w z where z.book_id = al.book_id and z.name = al.alias)""",
    "log_world_attributes": WORLD
    + """ select eff.book_id, r.dest as id, lower(trim(attr_key)) as key, nullif(arg_max(coalesce(attr_value, chr(1)), [eff.p, (r.id = r.dest)::int, case when r.id = r.dest then 0 else -coalesce(mo, 0) end, eo, seq, rec_id]), chr(1)) as value, count(*) as versions
    from eff join r using (book_id, id) where t = 'attr' and attr_key is not null group by 1, 2, 3""",
    "log_tainted": """with recursive m as (select distinct book_id || '/' || from_id as a, book_id || '/' || into_id as b, p from kg_log where t = 'merge' and from_id <> into_id and p is not null), e as (select a, b, p from m union all select b, a, p from m),
    r(id, t) as (select book_id || '/' || min(from_id), min(p) from kg_log where t = 'merge' and from_id is not null group by book_id union select e.b, greatest(r.t, e.p) from r join e on e.a = r.id) select id, min(t) as taint from r group by 1""",
    "log_canon_chain": LG.replace("with first", "with recursive first") + CANON + " select * from canon",
    "log_current_attributes": _L + " select book_id, id, lower(trim(attr_key)) as key, nullif(arg_max(coalesce(attr_value, chr(1)), [p, eo, seq, rec_id]), chr(1)) as value, count(*) as versions from eff where t = 'attr' and attr_key is not null group by 1, 2, 3",
    "log_attribute_conflicts": _L
    + """, z as (select book_id, id, lower(trim(attr_key)) as key, attr_value, row_number() over (partition by book_id, id, lower(trim(attr_key)) order by seq desc, rec_id desc) as k from lg where t = 'attr' and attr_key is not null and trim(attr_value) <> '')
    select book_id, id, key, count(*) as versions, count(distinct attr_value) as values from z where k <= 4 group by 1, 2, 3 having count(distinct attr_value) > 1""",
    "log_name_history": _L + " select book_id, id, coalesce(name, alias) as name, min(p) as first_p, max(p) as last_p from lg where t in ('person', 'name', 'alias') and id is not null and trim(coalesce(name, alias)) <> '' group by 1, 2, 3",
    "log_ambiguous_names": f"select book_id, n as name, count(distinct id) as owners, min(id) as first_owner from {_NAMES} where trim(n) <> '' and not {sql.generic('n')} group by 1, 2 having count(distinct id) > 1",
    "log_unique_owner_links": f"""with o as (select book_id, n, min(id) as owner from {_NAMES} where t = 'person' and n is not null group by 1, 2 having min(id) = max(id))
    select distinct a.book_id, a.id, a.n as alias, owner from {_NAMES} a join o on o.book_id = a.book_id and o.n = a.n where a.t = 'alias' and a.id <> owner""",
    "log_relation_versions": _L
    + _REL
    + ", "
    + "c as (select rec_id, book_id, a1, b1, "
    + ", ".join(f"last_value(nullif(case when trim({x}) <> '' then {x} end, chr(1)) ignore nulls) over w as {y}" for x, y in (("ai", "a_is"), ("bi", "b_is"), ("de", "rel_desc"), ("st", "status")))
    + " from rr window w as (partition by book_id, a1, b1 order by seq, rec_id rows unbounded preceding)) select rec_id, book_id, a1 as a, b1 as b, a_is, b_is, rel_desc, status from c",
    "log_current_relations": _L + _REL + " select book_id, a1 as a, b1 as b, " + ", ".join(f"arg_max({x}, seq) filter (where trim({x}) <> '') as {y}" for x, y in (("ai", "a_is"), ("bi", "b_is"), ("de", "rel_desc"), ("st", "status"))) + ", count(*) as versions from rr group by 1, 2, 3",
    "log_canonical_relations": LG.replace("with first", "with recursive first")
    + CANON
    + """, x as (select lg.book_id, coalesce(ca.canon, a) as ca, coalesce(cb.canon, b) as cb from lg left join canon ca on ca.book_id = lg.book_id and ca.id = a left join canon cb on cb.book_id = lg.book_id and cb.id = b where t = 'rel' and a is not null and b is not null)
    select book_id, least(ca, cb) as a, greatest(ca, cb) as b, count(*) as records from x where ca <> cb group by 1, 2, 3""",
    "log_person_events": _L
    + """, w as (select distinct book_id, rec_id, p, imp, unnest(who) as id from lg where t = 'event')
    select book_id, id, count(*) as events, count(*) filter (where imp >= 2) as important, min(p) as first_p, max(p) as last_p from w join per using (book_id, id) group by 1, 2""",
    "log_ranked_people": RANKED + " select *, row_number() over (partition by book_id order by score desc, id) as place from ranked qualify place <= 10",
    "log_cast_tiers": RANKED + " select book_id, case when imp >= 3 or n >= 40 or events >= 15 then 3 when n >= 8 or events >= 4 then 2 else 1 end as tier, count(*) as people, cast(sum(n) as bigint) as mentions from ranked group by 1, 2",
    "log_walk_ons": RANKED + " select book_id, id, name from ranked where imp < 3 and n <= 1 and events <= 1 and not exists (select 1 from lg where t = 'rel' and lg.a <> lg.b and lg.book_id = ranked.book_id and (lg.a = ranked.id or lg.b = ranked.id))",
    "log_mention_counts": "select book_id, id, cast(sum(k) as bigint) as mentions, count(*) as records from (select distinct book_id, rec_id, unnest(map_keys(c)) as id, unnest(map_values(c)) as k from kg_log where t = 'cnt' and c is not null) group by 1, 2",
    "log_importance_changes": """with i as (select distinct book_id, id, rec_id, imp, p * 4294967296 + coalesce(ord, 0) as seq from kg_log where t = 'imp' and p is not null and id is not null and imp is not null),
    w as (select *, lag(imp) over (partition by book_id, id order by seq, rec_id) as was from i) select rec_id, book_id, id, was, imp from w where was is null or was <> imp""",
    "log_latest_sagas": "with c as (select book_id, cast(floor(max(p) * 0.6) as bigint) as pos from kg_log group by 1) select book_id, arg_max(rec_id, [p, ord]) as rec_id, max(p) as p from kg_log join c using (book_id) where t = 'saga' and p < pos and text is not null group by 1",
    "log_recaps": _L + " select book_id, chapter, arg_max(text, seq) as text, count(*) as versions from lg where t = 'recap' and chapter is not null and text is not null group by 1, 2",
    "log_cooccurring": "with " + _PAIRS + " select * from pairs",
    "log_never_together": _L + ", " + _PAIRS + " select distinct lg.book_id, least(a, b) as a, greatest(a, b) as b from lg where t = 'rel' and a <> b and not exists (select 1 from pairs q where q.book_id = lg.book_id and q.a = least(lg.a, lg.b) and q.b = greatest(lg.a, lg.b))",
    "log_held_records": """with l as (select distinct book_id, id, rec_id, t, ord, p from kg_log where t in ('person', 'name', 'alias', 'attr', 'profile', 'imp') and ord is not null and id is not null),
    f as (select book_id, id, min(ord) as f, min(p) as entry from l where t = 'person' group by 1, 2) select book_id, t, count(*) as held, count(*) filter (where p >= entry) as after_entry from l join f using (book_id, id) where t <> 'person' and ord < f group by 1, 2""",
    "log_attribute_history": _L + " select rec_id, book_id, id, lower(trim(attr_key)) as key, attr_value, row_number() over w as version, lag(attr_value) over w as was, lead(p) over w as until from eff where t = 'attr' and attr_key is not null window w as (partition by book_id, id, lower(trim(attr_key)) order by p, eo, seq, rec_id)",
    "log_canonical_events": WORLD
    + """, x as (select distinct e.book_id, rec_id, r.dest as id, e.imp as weight, e.p from (select book_id, rec_id, unnest(who) as pid, imp, p from lg where t = 'event') e join r on r.book_id = e.book_id and r.id = e.pid)
    select book_id, id, count(*) as events, count(*) filter (where weight >= 2) as important, min(p) as first_p, max(p) as last_p from x group by 1, 2""",
    "log_late_records": """with l as (select distinct book_id, rec_id, ord, p from kg_log where p is not null and ord is not null), r as (select *, max(p) over (partition by book_id order by ord, rec_id rows between unbounded preceding and 1 preceding) as reached from l)
    select book_id, count(*) as late, max(reached - p) as most from r where p < reached group by 1""",
    "log_entry_floor": """with w as (select distinct book_id, rec_id, p, unnest(who) as id from kg_log where t = 'event' and p is not null), f as (select book_id, id, min(p) as entry from kg_log where t = 'person' and p is not null group by 1, 2)
    select rec_id, greatest(max(p), max(entry)) as safe_p, max(p) as p from w join f using (book_id, id) group by 1""",
    "log_chapter_events": f"with {CHAPTERS}, e as (select distinct book_id, rec_id, p, imp from kg_log where t = 'event' and p is not null) select e.book_id, chapter_no, count(*) as events, count(*) filter (where imp >= 2) as important from e join ch on ch.book_id = e.book_id and ch.o0 <= p and p < ch.e group by 1, 2",
    "log_hash_sample": "select distinct rec_id, imp from kg_log where t = 'event' and text is not null and (imp >= 3 or ('0x' || substr(sha256(text), 1, 15))::bigint % 6 = 0)",
    "log_source_composition": "select model, t, count(*) as records, cast(grouping(model, t) as bigint) as level from (select distinct rec_id, model, t from kg_log) group by cube (model, t) having grouping(model, t) < 3",
    "log_first_deliveries": "select rec_id, count(*) as deliveries, min(ingested_at) as first, max(ingested_at) as last from kg_log group by 1 having count(*) > 1",
}
