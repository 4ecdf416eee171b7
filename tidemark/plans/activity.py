"""Queries of activity, shelves, replicas and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import merge_overlaps, overlay
from tidemark.operators.running import running
from tidemark.operators.upserts import apply_operations, merge_replicas
from tidemark.sources.tables import table
from tidemark.streaming import activity as streams

GAP = streams.GAP
#: Microseconds of a user that are sorted together: a day.
STRETCH = 86_400_000_000


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")


def credited_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of activity of each user and day: up to 90 after each touch, split at midnight."""
    # The next touch counts only within the gap, so it lies in the same stretch or is shown to it from the next one's first.
    touches = _touches(spark, sf_dir).select("user_id", "event_id", "us").withColumn("cell", F.floor(F.col("us") / STRETCH))
    shown = touches.withColumn("home", F.col("cell")).withColumn("cell", F.explode(F.when(F.col("us") % STRETCH <= GAP * 1_000_000, F.array("cell", F.col("cell") - 1)).otherwise(F.array("cell"))))
    nxt = F.lead("us").over(Window.partitionBy("user_id", "cell").orderBy("us", "event_id"))
    rows = shown.withColumn("end", F.least(F.coalesce(nxt, F.col("us") + GAP * 1_000_000), F.col("us") + GAP * 1_000_000)).where("home = cell")
    day = 86_400_000_000
    days = F.explode(F.sequence(F.floor(F.col("us") / day), F.floor(F.greatest(F.col("end") - 1, F.col("us")) / day)))
    parts = rows.withColumn("d", days).withColumn("n", F.least("end", (F.col("d") + 1) * day) - F.greatest("us", F.col("d") * day))
    return parts.groupBy("user_id", F.date_from_unix_date(F.col("d").cast("int")).alias("day")).agg(F.floor(F.sum("n") / 1_000_000).alias("seconds"))


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days of a minute or more."""
    days = credited_days(spark, sf_dir).where("seconds >= 60")
    run = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("run", run).groupBy("user_id", "run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("days")).drop("run")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps of more than 90 seconds."""
    # Both steps work in two levels, by stretches of time, so a user with a third of all touches has many tasks.
    before = running(_touches(spark, sf_dir), ["user_id"], "us", ["event_id"], "us", "before", F.max, stretch=STRETCH, inclusive=False)
    rows = before.withColumn("new", F.coalesce(F.col("us") - F.col("before") > GAP * 1_000_000, F.lit(True)).cast("int"))
    rows = running(rows, ["user_id"], "us", ["event_id"], "new", "s", stretch=STRETCH)
    return rows.groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("touches")).select("user_id", "start", "touches")


def last_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type: the last writer wins."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("writes"))


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books whose title or author holds a term, last added first."""
    books = table(spark, sf_dir, "books").where("lower(concat_ws(' ', title, author)) like '%e%'")
    return books.select("book_id", "title", F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit("?")).alias("author"), "added_at").orderBy(F.desc("added_at"), "book_id")


def shelf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by language: all, with cover, running serials, sectioned."""
    return table(spark, sf_dir, "books").groupBy("lang").agg(F.count(F.lit(1)).alias("books"), F.count("cover").alias("covers"), F.count(F.when(F.col("len").isNull(), 1)).alias("running"), F.count(F.when(F.col("sectioned"), 1)).alias("sectioned"))


def _replica(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.groupBy(F.col("user_id").alias("item")).agg(F.count(F.lit(1)).alias("revision"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def merged_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replicas(_replica(spark, sf_dir, "click"), _replica(spark, sf_dir, "view"))


def applied_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed as operations on their user's item; each expects the number of its user's clicks so far."""
    clicks = F.count(F.when(F.col("event_type") == "click", 1)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = table(spark, sf_dir, "events").withColumn("expected", clicks)
    return apply_operations(rows.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("operation"), F.col("expected").cast("long").alias("expected"), "value", (F.col("event_type") == "error").alias("deleted")))


def seg_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a book covered by its segments without a gap of more than a line feed."""
    spans = table(spark, sf_dir, "segs").select("book_id", F.col("o0").alias("s"), (F.col("o1") + 1).alias("e")).distinct()
    return merge_overlaps(spans, ["book_id"], "s", "e").select("book_id", "s", "e", "spans")


def overlaid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, and those segments that overlap none."""
    heads = table(spark, sf_dir, "blocks").where("k = 'h'").select("book_id", F.col("o").alias("s"), (F.col("o") + F.length("t")).alias("e"), F.col("block_no").alias("id"))
    segs = table(spark, sf_dir, "segs").select("book_id", F.col("o0").alias("s"), F.col("o1").alias("e"), F.col("seg").alias("id")).distinct()
    return overlay(heads, segs, ["book_id"])


def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by which two snapshots differ as multisets: segments as delivered, and once each."""
    segs = table(spark, sf_dir, "segs").select("book_id", "seg", "o0", "o1")
    return segs.exceptAll(segs.distinct())


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.drain(streams.sessions(streams.events_stream(spark, sf_dir)))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "touches")


def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.day_totals(streams.events_stream(spark, sf_dir))).withColumn("value", F.round("value", 4))


QUERIES = {
    "activity_credited_days": credited_days,
    "activity_streaks": streaks,
    "activity_sessions": user_sessions,
    "progress_last_writer": last_progress,
    "shelf_sorted": shelf,
    "shelf_counts": shelf_counts,
    "replicas_merged": merged_replicas,
    "operations_applied": applied_operations,
    "seg_islands": seg_islands,
    "spans_overlaid": overlaid_spans,
    "snapshot_difference": snapshot_difference,
    "stream_sessions": stream_sessions,
    "stream_days": stream_days,
}

_T = "t as (select user_id, event_id, epoch_us(ts) as us, ts from events where user_id is not null and ts is not null)"
_DAYS = f"""{_T}, e as (select user_id, us, least(coalesce(lead(us) over (partition by user_id order by us, event_id), us + 90000000), us + 90000000) as ende from t),
d as (select user_id, us, ende, unnest(range(us // 86400000000, greatest(ende - 1, us) // 86400000000 + 1)) as d from e),
days as (select user_id, date '1970-01-01' + d::int as day, cast(sum(least(ende, (d + 1) * 86400000000) - greatest(us, d * 86400000000)) // 1000000 as bigint) as seconds from d group by 1, 2)"""
_SESSIONS = f"with {_T}, n as (select *, coalesce(us - lag(us) over w > 90000000, true)::int as new from t window w as (partition by user_id order by us, event_id)), s as (select *, sum(new) over (partition by user_id order by us, event_id rows unbounded preceding) as s from n) select user_id, min(ts) as start, count(*) as touches from s group by user_id, s"
_REPLICA = "(select user_id as item, count(*) as revision, arg_max(value, [epoch_us(ts), event_id]) as value from events where event_type = '{}' group by 1)"

ORACLES = {
    "activity_credited_days": f"with {_DAYS} select * from days",
    "activity_streaks": f"with {_DAYS}, r as (select user_id, day, day - row_number() over (partition by user_id order by day)::int as run from days where seconds >= 60) select user_id, min(day) as first, max(day) as last, count(*) as days from r group by user_id, run",
    "activity_sessions": _SESSIONS,
    "progress_last_writer": "select user_id, event_type, arg_max(value, [epoch_us(ts), event_id]) as value, max(ts) as ts, count(*) as writes from events group by 1, 2",
    "shelf_sorted": "select book_id, title, coalesce(nullif(trim(author), ''), '?') as author, added_at from books where lower(concat_ws(' ', title, author)) like '%e%' order by added_at desc, book_id",
    "shelf_counts": "select lang, count(*) as books, count(cover) as covers, count(*) filter (where len is null) as running, count(*) filter (where sectioned) as sectioned from books group by 1",
    "replicas_merged": f"""select coalesce(l.item, r.item) as item, case when l.item is null or r.revision > l.revision then r.revision else l.revision end as revision, case when l.item is null or r.revision > l.revision then r.value else l.value end as value,
    case when r.item is null then 'local' when l.item is null or r.revision > l.revision then 'remote' when r.revision = l.revision and r.value is distinct from l.value then 'conflict' when r.revision = l.revision then 'same' else 'local' end as outcome
    from {_REPLICA.format('click')} l full join {_REPLICA.format('view')} r on l.item = r.item""",
    "seg_islands": """with s as (select distinct book_id, o0 as s, o1 + 1 as e from segs where o0 < o1 + 1), n as (select *, coalesce(s > max(e) over (partition by book_id order by s, e rows between unbounded preceding and 1 preceding), true)::int as new from s),
    i as (select *, sum(new) over (partition by book_id order by s, e rows unbounded preceding) as i from n) select book_id, min(s) as s, max(e) as e, count(*) as spans from i group by book_id, i""",
    "spans_overlaid": """with h as (select book_id, o as s, o + length(t) as e, block_no as id from blocks where k = 'h'), x as (select distinct book_id, o0 as s, o1 as e, seg as id from segs where o0 < o1)
    select * from h union all select * from x where not exists (select 1 from h where h.book_id = x.book_id and h.s < h.e and x.s < h.e and h.s < x.e)""",
    "snapshot_difference": "select book_id, seg, o0, o1 from segs except all select distinct book_id, seg, o0, o1 from segs",
    "operations_applied": """with recursive e as materialized (select user_id as item, event_id, event_id::varchar as operation, value, event_type = 'error' as deleted, count(*) filter (where event_type = 'click') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as expected, row_number() over (partition by user_id order by event_id) as i from events where user_id is not null),
    w(item, i, revision, value, deleted, conflicts) as (select item, i, (expected = 0)::bigint, case when expected = 0 then value end, case when expected = 0 then deleted else false end, (expected <> 0)::bigint from e where i = 1
      union all select e.item, e.i, w.revision + (e.expected = w.revision)::bigint, case when e.expected = w.revision then e.value else w.value end, case when e.expected = w.revision then e.deleted else w.deleted end, w.conflicts + (e.expected <> w.revision)::bigint from w join e on e.item = w.item and e.i = w.i + 1)
    select item, revision, value, deleted, conflicts, 0::bigint as repeated from w where revision > 0 qualify row_number() over (partition by item order by i desc) = 1""",
    "stream_sessions": f"select user_id, start, touches from ({_SESSIONS.replace('min(ts) as start,', 'min(ts) as start, max(ts) as last,')}) where last + interval 90 seconds <= (select date_trunc('millisecond', max(ts)) - interval 1 hour from events)",
    "stream_days": "select cast(ts as date) as day, event_type, count(*) as events, round(sum(coalesce(value, 0)), 4) as value from events where cast(ts as date) + interval 1 day <= (select date_trunc('millisecond', max(ts)) - interval 1 day from events) group by 1, 2",
}
