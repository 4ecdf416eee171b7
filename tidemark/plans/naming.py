"""Queries on names: their forms, strong and weak names of a person, candidates by which a late person may be an early one, pairs that may be the same, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import fold
from tidemark.operators.contained import contained_names
from tidemark.plans import name_sql as sql
from tidemark.plans.log import CANON, LG, SHARE, _log
from tidemark.session import cut
from tidemark.sources.tables import log_records, table

MOST_CANDIDATES = 6


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, id, name: every distinct spelling that is not blank."""
    rows = log_records(spark, sf_dir, "person", "name", "alias").select("book_id", "id", F.coalesce("name", "alias").alias("name"))
    return rows.where("book_id is not null and id is not null and trim(name) <> ''").distinct()


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct spelling with what it is: generic, fit as an alias, its core and its short forms in order."""
    name = F.col("name")
    return _named(spark, sf_dir).select("name").distinct().select("name", N.is_generic(name).alias("generic"), N.is_good_alias(name).alias("good"), N.core(name).alias("core"), F.array_join(F.array_sort(N.short_forms(name)), "|").alias("short"))


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong and weak names of each person, and the name to ask for: the introduced one where it is no title, else the longest strong one."""
    rows = _named(spark, sf_dir).where((F.length(F.trim("name")) >= 2) & ~N.is_pronoun(F.col("name"))).withColumn("weak", N.is_generic(F.col("name")))
    of = lambda weak: F.array_join(F.array_sort(F.collect_set(F.when(F.col("weak") == weak, F.col("name")))), "|")
    parts = rows.groupBy("book_id", "id").agg(of(False).alias("strong"), of(True).alias("weak"), F.min_by("name", F.when(~F.col("weak"), F.struct(-F.length("name"), "name"))).alias("_longest"))
    own = log_records(spark, sf_dir, "person").where("trim(name) <> '' and p is not null").groupBy("book_id", "id").agg(F.min_by("name", F.struct("p", "ord", "rec_id")).alias("_own"))
    proper = F.when(F.col("_own").isNull() | N.is_generic(F.col("_own")), F.coalesce("_longest", "_own")).otherwise(F.col("_own"))
    return parts.join(own, ["book_id", "id"], "left").select("book_id", "id", "strong", "weak", proper.alias("proper"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, id, first, gender, mentions of each introduced person; late: introduced after the reader's position."""
    rows = log_records(spark, sf_dir, "person").where("id is not null and p is not null")
    people = rows.groupBy("book_id", "id").agg(F.min("p").alias("first"), F.min(F.when(F.trim("gender") != "", F.col("gender"))).alias("gender"))
    counts = log_records(spark, sf_dir, "cnt").where("c is not null").select("book_id", "rec_id", F.explode("c").alias("id", "k")).distinct().groupBy("book_id", "id").agg(F.sum("k").alias("mentions"))
    whole = table(spark, sf_dir, "kg_log").select("book_id", "p")
    return people.join(counts, ["book_id", "id"], "left").na.fill(0, ["mentions"]).join(fold.cutoffs(whole, SHARE), "book_id").withColumn("late", F.col("first") > F.col("pos")).drop("pos")


def _clash(a: str, b: str) -> Column:
    """Both genders known and different."""
    return F.coalesce(F.col(a) != F.col(b), F.lit(False))


def linked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person introduced after the reader's position, against those known before it.

    how: name where exactly one known person bears one of its strong names (to), ask where there are candidates by whole names, short
    forms, titles, cores or containment, new where there are none. Candidates: the best six by mentions. Persons whose known genders differ are no candidates.
    """
    people = cut(_people(spark, sf_dir))
    named = cut(_named(spark, sf_dir).where((F.length(F.trim("name")) >= 2) & ~N.is_pronoun(F.col("name"))).withColumn("weak", N.is_generic(F.col("name"))).join(people, ["book_id", "id"]))
    late, known = named.where("late"), named.where("not late")
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    keys = lambda own: F.array_union(F.array(F.when(F.col("weak"), key("w", F.col("name"))).otherwise(key("s", F.col("name")))), F.array(*own))
    name = F.col("name")
    many = lambda kind: F.when(~F.col("weak"), F.transform(N.short_forms(name), lambda x: key(kind, x))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    core = F.when(N.core(name) != "", key("c", N.core(name)))
    # A known name gives itself and its short forms; a late one asks for itself, for persons so called for short, and by its own short forms.
    given = known.select("book_id", F.col("id").alias("to"), "gender", F.explode(F.filter(F.concat(keys([core, key("n", name)]), many("f")), lambda k: k.isNotNull())).alias("k")).select("book_id", "to", F.col("gender").alias("to_gender"), "k.*").distinct()
    asked = late.select("book_id", "id", "gender", F.explode(F.filter(F.concat(keys([core, F.when(~F.col("weak"), key("f", name)), F.when(F.col("weak"), key("n", name)), F.when(~F.col("weak"), key("w", name))]), F.transform(many("x"), lambda k: key("n", k["key"]))), lambda k: k.isNotNull())).alias("k")).select("book_id", "id", "gender", "k.*").distinct()
    by_key = asked.join(given, ["book_id", "kind", "key"]).where("id <> `to`").withColumn("clash", _clash("gender", "to_gender"))
    inside = contained_names(late.select("book_id", "id", "name", "gender"), known.select("book_id", F.col("id").alias("to"), F.col("name").alias("to_name"), F.col("gender").alias("to_gender")))
    inside = inside.withColumn("clash", _clash("gender", "to_gender"))
    owners = given.where("kind in ('s', 'w')").groupBy("book_id", "key").agg(F.countDistinct("to").alias("owners"))
    distinct = by_key.where("kind = 's'").join(owners.where("owners = 1"), ["book_id", "key"]).where("not clash").groupBy("book_id", "id").agg(F.countDistinct("to").alias("n"), F.min("to").alias("sure"))
    pool = by_key.select("book_id", "id", "to", "clash").unionByName(inside.select("book_id", "id", "to", "clash")).where("not clash").distinct()
    best = Window.partitionBy("book_id", "id").orderBy(F.desc("mentions"), "to")
    ranked = pool.join(people.select("book_id", F.col("id").alias("to"), "mentions"), ["book_id", "to"]).withColumn("place", F.row_number().over(best)).where(f"place <= {MOST_CANDIDATES}")
    listed = ranked.groupBy("book_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "to"))), lambda x: x["to"]), "|").alias("candidates"))
    rows = people.where("late").select("book_id", "id").join(distinct, ["book_id", "id"], "left").join(listed, ["book_id", "id"], "left")
    how = F.when(F.col("n") == 1, "name").when(F.col("candidates").isNotNull(), "ask").otherwise("new")
    return rows.select("book_id", "id", how.alias("how"), F.when(F.col("n") == 1, F.col("sure")).alias("to"), F.when(~F.coalesce(F.col("n") == 1, F.lit(False)), F.col("candidates")).alias("candidates"))


def link_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late persons by the way they were linked."""
    return linked_people(spark, sf_dir).groupBy("how").agg(F.count(F.lit(1)).alias("people"))


def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reference in the who of an event, or in an alias, stands for: an id by its merges, else the person introduced first who bears it as a name."""
    log = _log(spark, sf_dir, "person", "name", "alias", "event", "merge")
    canon = cut(fold.canonical(cut(fold.merge_map(log))))
    refs = log.where("t = 'event'").select("book_id", F.explode("who").alias("ref")).unionByName(log.where("t = 'alias'").select("book_id", F.col("alias").alias("ref"))).where("trim(ref) <> ''").distinct()
    first = fold.introductions(log).select("book_id", "id", "first")
    names = log.where("t in ('person', 'name', 'alias') and id is not null").select("book_id", "id", F.coalesce("name", "alias").alias("ref")).join(first, ["book_id", "id"])
    merged = log.where("t = 'merge'").select("book_id", F.col("from_id").alias("id")).distinct()
    by_name = names.join(merged, ["book_id", "id"], "left_anti").groupBy("book_id", "ref").agg(F.min_by("id", F.struct("first", "id")).alias("by_name"))
    ids = first.select("book_id", F.col("id").alias("ref"), F.lit(True).alias("known"))
    rows = fold.with_canon(refs.join(ids, ["book_id", "ref"], "left").join(by_name, ["book_id", "ref"], "left"), canon, "ref", "canon")
    return rows.select("book_id", "ref", F.when(F.col("known"), F.col("canon")).otherwise(F.col("by_name")).alias("id"))


def same_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: introduced persons of a book that may be one: a name or the core of a name in common, a word of a name in common, or a name inside the other's.

    Pairs seen together in an event or related to each other are none, nor persons whose known genders differ. a entered first.
    The joins are sorted ones by hint, as words, pairs and people grow with the data: by their compressed size Spark would broadcast them.
    """
    from tidemark.plans.log import cooccurring

    people = cut(_people(spark, sf_dir).select("book_id", "id", "first", "gender"))
    named = cut(_named(spark, sf_dir).where(F.length("name") >= 2).join(people.hint("merge"), ["book_id", "id"]).withColumn("weak", N.is_generic(F.col("name"))))
    name = F.col("name")
    key = lambda kind, c: F.concat(F.lit(kind), c)
    none = F.array().cast("array<string>")
    proper = F.concat(F.when(N.core(name) != "", F.array(key("c", N.core(name)))).otherwise(none), F.when(N.is_latin(name), F.transform(N.tokens(name), lambda w: key("t", w))).otherwise(none))
    keyed = named.select("book_id", "id", F.explode(F.concat(F.array(key("n", name)), F.when(F.col("weak"), none).otherwise(proper))).alias("key")).distinct()
    by_key = keyed.join(keyed.withColumnRenamed("id", "other").hint("merge"), ["book_id", "key"]).where("id < other").select("book_id", "id", "other")
    strong = named.where("not weak")
    inside = contained_names(strong.select("book_id", "id", "name"), strong.select("book_id", F.col("id").alias("to"), F.col("name").alias("to_name")))
    pairs = by_key.unionByName(inside.where("id <> `to`").select("book_id", F.least("id", "to").alias("id"), F.greatest("id", "to").alias("other"))).distinct()
    related = log_records(spark, sf_dir, "rel").where("a is not null and b is not null").select("book_id", F.least("a", "b").alias("id"), F.greatest("a", "b").alias("other"))
    together = cooccurring(spark, sf_dir).select("book_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(related).distinct()
    pairs = pairs.join(together.hint("merge"), ["book_id", "id", "other"], "left_anti")
    x = pairs.join(people.withColumnRenamed("gender", "ga").withColumnRenamed("first", "fa").hint("merge"), ["book_id", "id"]).join(people.select("book_id", F.col("id").alias("other"), F.col("first").alias("fb"), F.col("gender").alias("gb")).hint("merge"), ["book_id", "other"]).where(~_clash("ga", "gb"))
    early = F.struct("fa", "id") < F.struct("fb", "other")
    return x.select("book_id", F.when(early, F.col("id")).otherwise(F.col("other")).alias("a"), F.when(early, F.col("other")).otherwise(F.col("id")).alias("b"))


def cast_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ninety persons of each book that a reader most likely meets: mentions, with twenty more for those of the last twelve events."""
    people = _people(spark, sf_dir).where("not late").select("book_id", "id", "mentions")
    events = _log(spark, sf_dir, "event").select("book_id", "rec_id", "seq", "who").distinct()
    last = events.withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("seq"), F.desc("rec_id")))).where("k <= 12")
    recent = last.select("book_id", F.explode("who").alias("id")).where("id is not null").distinct().withColumn("recent", F.lit(20))
    rows = people.join(recent, ["book_id", "id"], "left").withColumn("score", F.col("mentions") + F.coalesce("recent", F.lit(0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "id")).cast("long")).where("place <= 90").select("book_id", "id", "score", "place")


QUERIES = {
    "name_forms": name_forms,
    "person_names": person_names,
    "linked_people": linked_people,
    "link_histogram": link_histogram,
    "resolved_references": resolved_references,
    "same_candidates": same_candidates,
    "cast_hints": cast_hints,
}


_PRONOUN = f"lower(trim(name)) in ({sql.words(N.PRONOUNS)})"
_GOOD = f"(trim(name) <> '' and not {_PRONOUN} and not {sql.generic('name')} and regexp_replace(name, '^[他她的老小未]+', '') not in ({sql.words(N.GENERIC_HAN)}) and not (case when {sql.latin('name')} then regexp_matches(lower(name), '{N.GROUPS_LATIN.replace(chr(39), chr(39) * 2)}') else regexp_matches(name, '{N.GROUPS_HAN}') end))"
_NAMED = "named as materialized (select distinct book_id, id, coalesce(name, alias) as name from kg_log where t in ('person', 'name', 'alias') and id is not null and book_id is not null and trim(coalesce(name, alias)) <> '')"
_PEOPLE = f"""pers as materialized (select book_id, id, min(p) as first, min(gender) filter (where trim(gender) <> '') as gender from kg_log where t = 'person' and id is not null and p is not null group by 1, 2),
mc as (select book_id, id, cast(sum(k) as bigint) as mentions from (select distinct book_id, rec_id, unnest(map_keys(c)) as id, unnest(map_values(c)) as k from kg_log where t = 'cnt') group by 1, 2),
cu as (select book_id, cast(floor(max(p) * {SHARE}) as bigint) as pos from kg_log group by 1),
people as materialized (select pers.*, coalesce(mentions, 0) as mentions, first > pos as late from pers left join mc using (book_id, id) join cu using (book_id))"""
_NK = f"nk as materialized (select named.*, gender, late, {sql.generic('name')} as weak, {sql.core('name')} as core, {sql.short('name')} as short from named join people using (book_id, id) where length(trim(name)) >= 2 and not {_PRONOUN})"
_LINKED = f"""with {_NAMED}, {_PEOPLE}, {_NK},
cand as (select distinct a.book_id, a.id, b.id as dest from nk a join nk b on a.book_id = b.book_id and a.late and not b.late
  where a.id <> b.id and not coalesce(a.gender <> b.gender, false) and (a.name = b.name or (a.core <> '' and a.core = b.core) or (not a.weak and not b.weak and list_contains(b.short, a.name)) or (not a.weak and list_contains(a.short, b.name))
    or contains(a.name, b.name) or contains(b.name, a.name))),
own as (select book_id, name, count(distinct id) as owners, min(id) as owner from nk where not late and not weak group by 1, 2),
sure as (select a.book_id, a.id, count(distinct owner) as n, min(owner) as sure from nk a join own on own.book_id = a.book_id and own.name = a.name and owners = 1 join people g on g.book_id = a.book_id and g.id = own.owner
  where a.late and not a.weak and not coalesce(a.gender <> g.gender, false) and a.id <> owner group by 1, 2),
ranked as (select cand.*, row_number() over (partition by cand.book_id, cand.id order by mentions desc, dest) as place from cand join people q on q.book_id = cand.book_id and q.id = dest),
li as (select book_id, id, string_agg(dest, '|' order by place) as candidates from ranked where place <= {MOST_CANDIDATES} group by 1, 2),
linked as (select book_id, id, case when n = 1 then 'name' when candidates is not null then 'ask' else 'new' end as how, case when n = 1 then sure end as "to", case when n = 1 then null else candidates end as candidates
  from people left join sure using (book_id, id) left join li using (book_id, id) where late)"""

ORACLES = {
    "name_forms": f"with {_NAMED} select distinct name, {sql.generic('name')} as generic, {_GOOD} as good, {sql.core('name')} as core, array_to_string(list_sort({sql.short('name')}), '|') as short from named",
    "person_names": f"""with {_NAMED}, x as (select *, {sql.generic('name')} as weak from named where length(trim(name)) >= 2 and not {_PRONOUN}),
    o as (select book_id, id, arg_min(name, [p, ord, rec_id]) as own from kg_log where t = 'person' and trim(name) <> '' and p is not null group by 1, 2),
    g as (select book_id, id, coalesce(string_agg(distinct name, '|' order by name) filter (where not weak), '') as strong, coalesce(string_agg(distinct name, '|' order by name) filter (where weak), '') as weak, (list(name order by length(name) desc, name) filter (where not weak))[1] as longest from x group by 1, 2)
    select book_id, id, strong, weak, case when own is null or {sql.generic('own')} then coalesce(longest, own) else own end as proper from g left join o using (book_id, id)""",
    "linked_people": _LINKED + " select * from linked",
    "link_histogram": _LINKED + " select how, count(*) as people from linked group by 1",
    "resolved_references": LG.replace("with first", "with recursive first")
    + CANON
    + """, refs as (select distinct book_id, ref from (select book_id, unnest(who) as ref from lg where t = 'event' union all select book_id, alias from lg where t = 'alias') where trim(ref) <> ''),
    nm as (select lg.book_id, coalesce(lg.name, alias) as ref, lg.id, f from lg join per using (book_id, id) where t in ('person', 'name', 'alias') and not exists (select 1 from lg z where z.t = 'merge' and z.book_id = lg.book_id and z.from_id = lg.id)),
    bn as (select book_id, ref, (list(id order by f, id))[1] as by_name from nm group by 1, 2)
    select refs.book_id, refs.ref, case when per.id is not null then coalesce(canon.canon, refs.ref) else by_name end as id from refs left join per on per.book_id = refs.book_id and per.id = refs.ref left join bn on bn.book_id = refs.book_id and bn.ref = refs.ref
    left join canon on canon.book_id = refs.book_id and canon.id = refs.ref""",
    "same_candidates": f"""with {_NAMED}, {_PEOPLE}, nk as materialized (select named.*, {sql.generic('name')} as weak, {sql.core('name')} as core, {sql.latin('name')} as latin,
      list_filter(regexp_extract_all(lower(name), '[a-z][a-z''’\\-]+'), lambda w: w not in ({sql.words(N.EMPTY_WORDS)})) as toks from named join people using (book_id, id) where length(name) >= 2),
    pr as (select distinct a.book_id, a.id as x, b.id as y from nk a join nk b on a.book_id = b.book_id and a.id < b.id where a.name = b.name or (not a.weak and not b.weak and (a.core <> '' and a.core = b.core or a.latin and b.latin and list_has_any(a.toks, b.toks) or contains(a.name, b.name) or contains(b.name, a.name)))),
    ew as (select distinct rec_id, book_id, unnest(who) as id from kg_log where t = 'event'), tg as (select distinct e.book_id, e.id as x, f.id as y from ew e join ew f on e.rec_id = f.rec_id and e.book_id = f.book_id and e.id < f.id
      union select book_id, least(a, b), greatest(a, b) from kg_log where t = 'rel' and a is not null and b is not null)
    select pr.book_id, case when (g.first, g.id) < (h.first, h.id) then pr.x else pr.y end as a, case when (g.first, g.id) < (h.first, h.id) then pr.y else pr.x end as b from pr join people g on g.book_id = pr.book_id and g.id = pr.x join people h on h.book_id = pr.book_id and h.id = pr.y
    where not coalesce(g.gender <> h.gender, false) and not exists (select 1 from tg where tg.book_id = pr.book_id and tg.x = pr.x and tg.y = pr.y)""",
    "cast_hints": LG.rstrip().rstrip(",")
    + f""", {_PEOPLE}, ev as (select distinct book_id, rec_id, seq, who from lg where t = 'event'), la as (select * from ev qualify row_number() over (partition by book_id order by seq desc, rec_id desc) <= 12),
    rc as (select distinct book_id, unnest(who) as id from la) select book_id, id, mentions + case when rc.id is null then 0 else 20 end as score, row_number() over (partition by book_id order by mentions + case when rc.id is null then 0 else 20 end desc, id) as place
    from people left join rc using (book_id, id) where not late qualify place <= 90""",
}
