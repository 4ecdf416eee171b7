"""Problem 2: attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import attributes_as_of, fold_key, is_blank
from tidemark.sources.tables import log_records


def known_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_rec, scope, entity, key, attr_rec of the whole log."""
    events = log_records(spark, sf_dir, "event").select(F.col("book_id").alias("scope"), F.explode("who").alias("entity"), "p", F.col("rec_id").alias("event_rec"))
    attrs = (
        log_records(spark, sf_dir, "attr")
        .where(~is_blank(F.col("attr_value")))
        .select(F.col("book_id").alias("scope"), F.col("id").alias("entity"), fold_key(F.col("attr_key")).alias("key"), "p", "ord", F.col("rec_id").alias("attr_rec"))
    )
    return attributes_as_of(events, attrs)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_rec, person_id, attr_rec: what a reader knew of each person of an event."""
    return known_at_event(spark, sf_dir).select("event_rec", F.col("entity").alias("person_id"), "attr_rec")


P2_SQL = r"""
with ev as (
  select distinct k.rec_id as event_rec, k.book_id, w.who as person_id, k.p
  from (select distinct rec_id, book_id, p, who from kg_log where t = 'event') k, unnest(k.who) as w(who)
  where w.who is not null and k.p is not null),
facts as (
  select distinct rec_id as attr_rec, book_id, id as person_id,
         lower(regexp_replace(attr_key, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as k, p, ord
  from kg_log
  where t = 'attr' and attr_key is not null and p is not null and attr_value is not null and regexp_replace(attr_value, '[\s\p{Z}]', '', 'g') <> ''),
ranked as (
  select ev.event_rec, ev.person_id, facts.attr_rec,
         row_number() over (partition by ev.event_rec, ev.person_id, facts.k order by facts.p desc, facts.ord desc nulls last, facts.attr_rec desc) as rn
  from ev join facts on facts.book_id = ev.book_id and facts.person_id = ev.person_id and facts.p <= ev.p)
select event_rec, person_id, attr_rec from ranked where rn = 1
"""
