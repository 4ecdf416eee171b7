"""What a reader at a position knows: the as-of fold of the fact log, as composable DataFrame operators.

Records are ordered by (p, ord) within a book; ``seq`` packs both into one number. Each state is the newest value by a
max_by, which combines before it shuffles, so a hot person costs no more than the number of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.session import cut

SEQ = "p * 4294967296 + coalesce(ord, 0)"
#: Aliases that are couples, groups or descriptions.
NO_ALIAS = "的|夫妇|夫妻|们|一家|俩"


def known(log: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Distinct records with p at or before the book's ``pos``, with ``seq``. Deliveries of a record count once; books without a cutoff and records without p are left out."""
    return log.drop("ingested_at").where("p is not null").join(cutoffs.select("book_id", "pos"), "book_id").where("p <= pos").drop("pos").withColumn("seq", F.expr(SEQ))


def cutoffs(log: DataFrame, share: float) -> DataFrame:
    """book_id, pos: the given share of the book's last position."""
    return log.groupBy("book_id").agg(F.floor(F.max("p") * share).alias("pos"))


def newest(value: str | Column, when: str = "seq") -> Column:
    """The value of the newest row where it is neither null nor blank."""
    column = F.col(value) if isinstance(value, str) else value
    return F.max_by(column, F.when(F.trim(column.cast("string")) != "", F.col(when)))


def introductions(log: DataFrame) -> DataFrame:
    """book_id, id, first, last: where each person enters and is last reset."""
    return log.where("t = 'person'").groupBy("book_id", "id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))


def _effective(log: DataFrame, persons: DataFrame, held: bool) -> DataFrame:
    """Records about introduced persons that count after the last reset; held: those that came before the introduction count right after it, else they are dropped."""
    rows = log.join(persons, ["book_id", "id"])
    rows = rows.withColumn("eff", F.struct(F.greatest("seq", "first"), "seq"))
    return rows.where("greatest(seq, first) >= last and (seq > last or first = last)" if held else "seq > last")


def effective(log: DataFrame, kind: str) -> DataFrame:
    """Records of one type about introduced persons that count, with ``eff``, where they take effect: those before the introduction right after it, those before a reset never."""
    return _effective(log.where((F.col("t") == kind) & F.col("id").isNotNull()), introductions(log), True)


def people(log: DataFrame) -> DataFrame:
    """book_id, id, name, tagline, bio, imp, n: the card of every introduced person, before merges.

    Early names, profiles and importance are held until the person enters; early counts are dropped. Blank taglines and bios never
    replace older ones. n is the sum of counts (0 without any), imp 1 without any.
    """
    persons = introductions(log)
    base = log.where("t = 'person'").groupBy("book_id", "id").agg(F.max_by("name", "seq").alias("name0"), F.max_by("intro", "seq").alias("intro0"), F.max_by("imp", "seq").alias("imp0"))
    rows = _effective(log.where("t in ('name', 'profile', 'imp') and id is not null").select("book_id", "id", "t", "name", "tagline", "bio", "imp", "seq"), persons, True)
    of = lambda t, c, blank=True: F.max_by(c, F.when((F.col("t") == t) & (F.trim(F.col(c).cast("string")) != "" if blank else F.lit(True)), F.col("eff")))
    state = rows.groupBy("book_id", "id").agg(of("name", "name").alias("name1"), of("profile", "tagline").alias("tagline1"), of("profile", "bio").alias("bio"), of("imp", "imp").alias("imp1"))
    counts = log.where("t = 'cnt' and c is not null").select("book_id", "rec_id", "seq", F.explode("c").alias("id", "k")).distinct()
    totals = counts.join(persons, ["book_id", "id"]).where("seq > last").groupBy("book_id", "id").agg(F.sum("k").alias("n"))
    card = base.join(state, ["book_id", "id"], "left").join(totals, ["book_id", "id"], "left")
    return card.select("book_id", "id", F.coalesce("name1", "name0").alias("name"), F.coalesce("tagline1", F.col("intro0")).alias("tagline"), "bio", F.coalesce("imp1", "imp0", F.lit(1)).alias("imp"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merge_map(log: DataFrame) -> DataFrame:
    """book_id, id, into_id, first_merge: the last target written for each id, and where it was first merged."""
    rows = log.where("t = 'merge' and from_id is not null and into_id is not null")
    return rows.groupBy("book_id", F.col("from_id").alias("id")).agg(F.max_by("into_id", "seq").alias("into_id"), F.min("seq").alias("first_merge"))


def canonical(merges: DataFrame) -> DataFrame:
    """book_id, id, canon: where following the merges from each merged id ends; on a cycle, at the first id met again.

    Pointer doubling: the table of targets is joined with itself, so a chain of n merges takes log2(n) rounds. Where something moves for ever there are
    cycles: once the targets of what moves stay as many from one round to the next, they are exactly the members of cycles. These stay where they
    are, and become the ends of what leads to them.
    """
    own = merges.where("id = into_id").select("book_id", "id", F.col("id").alias("canon"))
    step = cut(merges.where("id <> into_id").select("book_id", "id", F.col("into_id").alias("to")))
    jump, moving = _doubled(step)
    if moving:
        rings = cut(jump.where("going").select("book_id", F.col("to").alias("id")).distinct())
        rest, _ = _doubled(step.join(rings, ["book_id", "id"], "left_anti"))
        own = own.unionByName(rings.select("book_id", "id", F.col("id").alias("canon")))
        jump = rest
    return jump.select("book_id", "id", F.col("to").alias("canon")).unionByName(own)


def _doubled(step: DataFrame) -> tuple[DataFrame, int]:
    """book_id, id, to, going after doubling until nothing moves, or until only cycles move; and how many targets still move."""
    jump, before = step.withColumn("going", F.lit(True)), -1
    while True:
        ahead = jump.select("book_id", F.col("id").alias("to"), F.col("to").alias("further"))
        jump = cut(jump.select("book_id", "id", "to").join(ahead, ["book_id", "to"], "left").select("book_id", "id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("going")))
        moving = jump.where("going").select("book_id", "to").distinct().count()
        if moving in (0, before):
            return jump, moving
        before = moving


def with_canon(rows: DataFrame, canon: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the canonical id of a column, itself where nothing was merged."""
    return rows.join(canon.select("book_id", F.col("id").alias(column), F.col("canon").alias(out)), ["book_id", column], "left").withColumn(out, F.coalesce(out, column))


def is_generic(name: Column) -> Column:
    """A word for anyone instead of a name; also where there is none."""
    return name.isNull() | names.is_generic(name)


def members(cards: DataFrame, merges: DataFrame) -> DataFrame:
    """The cards with ``to``, the person each belongs to after merges, and first_merge.

    A merged person disappears into its canonical person if that was introduced, else stays.
    """
    exists = cards.select("book_id", F.col("id").alias("canon")).withColumn("there", F.lit(True))
    rows = cards.join(canonical(merges), ["book_id", "id"], "left").join(merges.select("book_id", "id", "first_merge"), ["book_id", "id"], "left").join(exists, ["book_id", "canon"], "left")
    return rows.withColumn("to", F.when(F.col("there"), F.col("canon")).otherwise(F.col("id"))).drop("there", "canon")


def merged_cards(rows: DataFrame) -> DataFrame:
    """book_id, id, name, tagline, bio, imp, n of the persons that are left: the target keeps its own name unless it is generic and a source has a
    proper one (first merged first), sums the counts, and takes a bio only where it has none."""
    own, proper = F.col("id") == F.col("to"), ~is_generic(F.col("name"))
    merged = rows.groupBy("book_id", F.col("to").alias("id")).agg(
        F.max(F.when(own, F.col("name"))).alias("name0"),
        F.min_by("name", F.when(~own & proper, F.col("first_merge"))).alias("name1"),
        F.max(F.when(own, F.col("tagline"))).alias("tagline"),
        F.max(F.when(own, F.col("bio"))).alias("bio0"),
        F.min_by("bio", F.when(~own & (F.trim("bio") != ""), F.col("first_merge"))).alias("bio1"),
        F.max(F.when(own, F.col("imp"))).alias("imp"),
        F.sum("n").alias("n"),
    )
    name = F.when(is_generic(F.col("name0")) & F.col("name1").isNotNull(), F.col("name1")).otherwise(F.col("name0"))
    bio = F.when(F.trim(F.coalesce("bio0", F.lit(""))) != "", F.col("bio0")).otherwise(F.col("bio1"))
    return merged.select("book_id", "id", name.alias("name"), "tagline", bio.alias("bio"), "imp", "n")


def world(log: DataFrame) -> DataFrame:
    """book_id, id, name, tagline, bio, imp, n: the cards after merges."""
    return merged_cards(members(cut(people(log)), cut(merge_map(log))))


def world_aliases(log: DataFrame) -> DataFrame:
    """book_id, id, alias: the other names of each person after merges: names it had before, aliases, and all names of those merged into it.

    Names before the introduction are held until it; those before a later reset are gone. Blank ones, the present name, words for anyone, groups, and the
    present name of another person are no aliases.
    """
    rows = cut(members(cut(people(log)), cut(merge_map(log))))
    persons = introductions(log)
    first = log.where("t = 'person'").groupBy("book_id", "id").agg(F.max_by("name", "seq").alias("alias"))
    later = _effective(log.where("t in ('name', 'alias') and id is not null").select("book_id", "id", F.coalesce("name", "alias").alias("alias"), "seq"), persons, True)
    every = first.unionByName(later.select("book_id", "id", "alias")).join(rows.select("book_id", "id", "to"), ["book_id", "id"]).select("book_id", F.col("to").alias("id"), "alias").distinct()
    present = cut(merged_cards(rows).select("book_id", "id", "name"))
    fit = every.join(present, ["book_id", "id"]).where("trim(alias) <> '' and not (alias <=> name)").where(~is_generic(F.col("alias")) & ~is_generic(F.regexp_replace("alias", "^[他她的老小未]+", "")) & ~F.col("alias").rlike(NO_ALIAS))
    return fit.join(present.select("book_id", F.col("name").alias("alias")), ["book_id", "alias"], "left_anti").select("book_id", "id", "alias")


def world_attributes(log: DataFrame) -> DataFrame:
    """book_id, id, key, value, versions: the attribute in force after merges. At one position the person's own records win, then those of persons merged earlier."""
    merges = cut(merge_map(log))
    rows = members(introductions(log), merges).select("book_id", "id", "to", "first_merge")
    attrs = _effective(log.where("t = 'attr' and id is not null and attr_key is not null").select("book_id", "id", "rec_id", "attr_key", "attr_value", "p", "seq").distinct(), introductions(log), True)
    placed = attrs.join(rows, ["book_id", "id"]).withColumn("key", F.lower(F.trim("attr_key")))
    own = F.col("id") == F.col("to")
    order = F.struct("p", own.cast("int"), F.when(own, F.lit(0)).otherwise(-F.coalesce("first_merge", F.lit(0))), "eff", "rec_id")
    return placed.groupBy("book_id", F.col("to").alias("id"), "key").agg(F.max_by("attr_value", order).alias("value"), F.count(F.lit(1)).alias("versions"))


def current_attributes(log: DataFrame) -> DataFrame:
    """book_id, id, key, value, versions: the attribute in force of each introduced person and the number of its versions."""
    rows = _effective(log.where("t = 'attr' and id is not null and attr_key is not null").select("book_id", "id", "rec_id", "attr_key", "attr_value", "p", "seq").distinct(), introductions(log), True)
    rows = rows.withColumn("key", F.lower(F.trim("attr_key")))
    return rows.groupBy("book_id", "id", "key").agg(F.max_by("attr_value", F.struct("p", "eff", "rec_id")).alias("value"), F.count(F.lit(1)).alias("versions"))


def relations(log: DataFrame) -> DataFrame:
    """One row per record of a relation: book_id, a, b (a < b), a_is, b_is swapped with them, rel_desc, status, seq; without self and half relations."""
    rows = log.where("t = 'rel' and a is not null and b is not null and a <> b").select("book_id", "rec_id", "seq", "a", "b", "a_is", "b_is", "rel_desc", "status").distinct()
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return rows.select("book_id", "rec_id", "seq", pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("a_is", "b_is").alias("a_is"), pick("b_is", "a_is").alias("b_is"), "rel_desc", "status")


def current_relations(rows: DataFrame) -> DataFrame:
    """book_id, a, b with the newest non-blank a_is, b_is, rel_desc and status, and the number of records."""
    return rows.groupBy("book_id", "a", "b").agg(*(newest(c).alias(c) for c in ("a_is", "b_is", "rel_desc", "status")), F.count(F.lit(1)).alias("versions"))


def relation_history(rows: DataFrame) -> DataFrame:
    """Every version of each relation with what earlier versions carry forward where it is blank."""
    window = Window.partitionBy("book_id", "a", "b").orderBy("seq", "rec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = {c: F.last(F.when(F.trim(c) != "", F.col(c)), ignorenulls=True).over(window) for c in ("a_is", "b_is", "rel_desc", "status")}
    return rows.withColumns(carried)


def quarantine(seeds: DataFrame, merges: DataFrame) -> DataFrame:
    """id, taint: the least position from which a wrong identity may have spread to each id.

    seeds: id, taint. merges: a, b, p, in force both ways. taint(x) = min over ways from a seed of the greatest position on the way (minimax).
    Relaxation to a fixpoint: one join and one min per round; the rounds are at most the longest way that still improves something.
    """
    edges = cut(merges.select("a", "b", "p").unionByName(merges.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")).where("a is not null and b is not null and p is not null").groupBy("a", "b").agg(F.min("p").alias("p")))
    state = cut(seeds.where("id is not null and taint is not null").groupBy("id").agg(F.min("taint").alias("taint")))
    fresh = state
    while not fresh.isEmpty():
        spread = fresh.join(edges, fresh.id == edges.a).select(F.col("b").alias("id"), F.greatest("taint", "p").alias("taint"))
        best = spread.groupBy("id").agg(F.min("taint").alias("new"))
        fresh = cut(best.join(state, "id", "left").where("taint is null or new < taint").select("id", F.col("new").alias("taint")))
        state = cut(state.unionByName(fresh).groupBy("id").agg(F.min("taint").alias("taint")))
    return state
