"""Queries on recorded answers of a judge: what is kept at which probability, agreement of two judges, ranking by answers, valid rows.

The events table stands for the answers: the type is the kind of question, the user the subject, and the fraction of the value the probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import log_records, table

KEEP, CONTRADICTED, SURE = 0.3, 0.5, 0.7
FAMILY, LEAF = 0.35, 0.5
RERANKED, RERANK_LEAST, RERANK_BEST = 6, 0.3, 2


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, subject, kind, p: one row per answer; p to three places, null without a value."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("kind"), F.round(F.col("value") - F.floor("value"), 3).alias("p"))


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that their answer supports: left out below 0.3, and below 0.5 where an error contradicts the subject; unanswered ones stay."""
    answers = _answers(spark, sf_dir)
    against = answers.where("kind = 'error' and p >= 0.5").select("subject").distinct().withColumn("contradicted", F.lit(True))
    rows = answers.where("kind <> 'error'").join(against, "subject", "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    dropped = (F.col("p") < KEEP) | F.col("contradicted") & (F.col("p") < CONTRADICTED)
    return rows.where(~F.coalesce(dropped, F.lit(False))).select("event_id", "kind", "p", "contradicted")


def support_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: answers at or above one half, below, and those that a threshold of 0.3 or 0.5 would lose."""
    return _answers(spark, sf_dir).groupBy("kind").agg(F.count(F.when(F.col("p") >= 0.5, 1)).alias("above"), F.count(F.when(F.col("p") < 0.5, 1)).alias("below"), F.count(F.when(F.col("p") < KEEP, 1)).alias("lost_low"), F.count("p").alias("answered"), F.count(F.lit(1)).alias("asked"))


def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by what becomes of them: merges (purchases) need 0.7, others one half, unanswered ones are pending."""
    needed = F.when(F.col("kind") == "purchase", SURE).otherwise(0.5)
    return _answers(spark, sf_dir).select("event_id", F.when(F.col("p").isNull(), "pending").when(F.col("p") >= needed, "kept").otherwise("dropped").alias("outcome"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, k, before, after: the k-th click and the k-th view of each subject, as two answers to one question."""
    order = Window.partitionBy("subject", "kind").orderBy("event_id")
    rows = _answers(spark, sf_dir).where("subject is not null and kind in ('click', 'view')").withColumn("k", F.row_number().over(order).cast("long"))
    one, two = (rows.where(F.col("kind") == kind).select("subject", "k", F.col("p").alias(name)) for kind, name in (("click", "before"), ("view", "after")))
    return one.join(two, ["subject", "k"])


def settled_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites that are better: at least one half, and at least 0.2 above what they replace."""
    better = F.col("after") >= F.greatest(F.lit(0.5), F.round(F.col("before") + 0.2, 3))
    return _pairs(spark, sf_dir).select("subject", "k", F.coalesce(better, F.lit(False)).alias("kept"))


def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two judges agree on each subject: questions, share on the same side of one half, sum of differences, share of yes by each."""
    side = ((F.col("before") >= 0.5) == (F.col("after") >= 0.5)).cast("double")
    return _pairs(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(side), 9).alias("same_side"), F.round(F.sum(F.abs(F.col("before") - F.col("after"))), 3).alias("difference"), F.round(F.avg((F.col("before") >= 0.5).cast("double")), 9).alias("yes_before"), F.round(F.avg((F.col("after") >= 0.5).cast("double")), 9).alias("yes_after"))


def agreement_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty answers of each kind in the order of a hash: the same sample on every run."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.sha2(F.col("event_id").cast("string"), 256), "event_id"))
    return _answers(spark, sf_dir).withColumn("place", place.cast("long")).where("place <= 40").select("kind", "place", "event_id")


def role_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best two kinds of each subject whose best answer reaches 0.35, with that answer times the second best of the kind where this reaches one half."""
    order = Window.partitionBy("subject", "kind").orderBy(F.desc_nulls_last("p"), "event_id")
    ranked = _answers(spark, sf_dir).where("subject is not null").withColumn("k", F.row_number().over(order)).where("k <= 2")
    kinds = ranked.groupBy("subject", "kind").agg(F.max(F.when(F.col("k") == 1, F.col("p"))).alias("family"), F.max(F.when(F.col("k") == 2, F.col("p"))).alias("leaf")).where(F.col("family") >= FAMILY)
    best = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("family"), "kind"))
    return kinds.withColumn("place", best.cast("long")).where("place <= 2").select("subject", "kind", "place", "family", F.when(F.col("leaf") >= LEAF, F.round(F.col("family") * F.col("leaf"), 3)).alias("score"))


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each subject by their answer: up to six at 0.3 or more, or the best two where none reaches it."""
    order = Window.partitionBy("subject").orderBy(F.desc_nulls_last("p"), "event_id")
    rows = _answers(spark, sf_dir).where("subject is not null").withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= RERANKED)
    most = F.max("p").over(Window.partitionBy("subject"))
    return rows.withColumn("most", most).where((F.col("p") >= RERANK_LEAST) | ~F.coalesce(F.col("most") >= RERANK_LEAST, F.lit(False)) & (F.col("place") <= RERANK_BEST)).select("subject", "event_id", "place", "p")


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count records as rows of a training set: probabilities are the shares of the counts, options the introduced persons, the choice the most frequent one; what is wrong with each."""
    people = log_records(spark, sf_dir, "person").where("id is not null").select("id").distinct().withColumn("known", F.lit(True))
    rows = log_records(spark, sf_dir, "cnt").select("rec_id", F.explode_outer("c").alias("id", "k")).distinct().join(people, "id", "left")
    one = rows.groupBy("rec_id").agg(F.sum("k").alias("total"), F.count("id").alias("options"), F.max_by("known", F.struct("k", "id")).alias("choice_known"), F.count(F.when(F.col("k") < 0, 1)).alias("negative"))
    fault = F.when(F.col("options") == 0, "no options").when(F.col("negative") > 0, "not a probability").when(F.coalesce("total", F.lit(0)) == 0, "sum of nothing").when(F.col("choice_known").isNull(), "choice not among the options").otherwise("valid")
    return one.select("rec_id", fault.alias("verdict"))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds before each retry: thirty, doubled with every error of the subject, nine hundred at most."""
    n = F.row_number().over(Window.partitionBy("subject").orderBy("event_id"))
    return _answers(spark, sf_dir).where("kind = 'error' and subject is not null").withColumn("n", n).select("event_id", F.least(F.lit(900.0), 30 * F.pow(F.lit(2.0), F.least(F.col("n") - 1, F.lit(40)))).cast("long").alias("seconds"))


def label_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft labels of each subject: the mean answer of each kind, as shares that add up to one; grey where the best is between 0.3 and 0.7 of it."""
    means = _answers(spark, sf_dir).where("subject is not null and p is not null").groupBy("subject", "kind").agg(F.sum("p").alias("s"))
    total = F.sum("s").over(Window.partitionBy("subject"))
    rows = means.withColumn("share", F.when(total > 0, F.round(F.col("s") / total, 4)))
    return rows.groupBy("subject").agg(F.max_by("kind", F.struct("share", "kind")).alias("choice"), F.max("share").alias("share"), F.count(F.lit(1)).alias("labels")).withColumn("grey", F.col("share").between(0.3, 0.7))


QUERIES = {
    "answers_supported": supported,
    "answers_by_kind": support_by_kind,
    "answers_verified": verified_claims,
    "answers_settled": settled_rewrites,
    "answers_agreement": judge_agreement,
    "answers_sample": agreement_sample,
    "answers_roles": role_choices,
    "answers_reranked": reranked,
    "answers_valid_rows": valid_rows,
    "answers_retries": retry_delays,
    "answers_soft_labels": label_examples,
}

_A = "a as materialized (select event_id, user_id as subject, event_type as kind, round(value - floor(value), 3) as p from events)"
_P = f"{_A}, k as (select *, row_number() over (partition by subject, kind order by event_id) as k from a where subject is not null and kind in ('click', 'view')), pr as (select x.subject, x.k, x.p as before, y.p as after from k x join k y on x.subject = y.subject and x.k = y.k and x.kind = 'click' and y.kind = 'view')"

ORACLES = {
    "answers_supported": f"with {_A}, g as (select distinct subject from a where kind = 'error' and p >= 0.5) select event_id, kind, p, g.subject is not null as contradicted from a left join g on g.subject = a.subject where kind <> 'error' and not coalesce(p < {KEEP} or (g.subject is not null and p < {CONTRADICTED}), false)",
    "answers_by_kind": f"with {_A} select kind, count(*) filter (where p >= 0.5) as above, count(*) filter (where p < 0.5) as below, count(*) filter (where p < {KEEP}) as lost_low, count(p) as answered, count(*) as asked from a group by 1",
    "answers_verified": f"with {_A} select event_id, case when p is null then 'pending' when p >= case when kind = 'purchase' then {SURE} else 0.5 end then 'kept' else 'dropped' end as outcome from a",
    "answers_settled": f"with {_P} select subject, k, coalesce(after >= greatest(0.5, round(before + 0.2, 3)), false) as kept from pr",
    "answers_agreement": f"with {_P} select subject, count(*) as questions, round(avg(((before >= 0.5) = (after >= 0.5))::int), 9) as same_side, round(sum(abs(before - after)), 3) as difference, round(avg((before >= 0.5)::int), 9) as yes_before, round(avg((after >= 0.5)::int), 9) as yes_after from pr group by 1",
    "answers_sample": f"with {_A} select kind, row_number() over (partition by kind order by sha256(event_id::varchar), event_id) as place, event_id from a qualify place <= 40",
    "answers_roles": f"""with {_A}, r as (select *, row_number() over (partition by subject, kind order by p desc nulls last, event_id) as k from a where subject is not null), f as (select subject, kind, max(p) filter (where k = 1) as family, max(p) filter (where k = 2) as leaf from r group by 1, 2 having max(p) filter (where k = 1) >= {FAMILY})
    select subject, kind, row_number() over (partition by subject order by family desc, kind) as place, family, case when leaf >= {LEAF} then round(family * leaf, 3) end as score from f qualify place <= 2""",
    "answers_reranked": f"""with {_A}, r as (select *, row_number() over (partition by subject order by p desc nulls last, event_id) as place from a where subject is not null), m as (select *, max(p) over (partition by subject) as most from r where place <= {RERANKED})
    select subject, event_id, place, p from m where p >= {RERANK_LEAST} or (not coalesce(most >= {RERANK_LEAST}, false) and place <= {RERANK_BEST})""",
    "answers_valid_rows": """with r as (select distinct rec_id, id, k from (select rec_id, unnest(map_keys(c)) as id, unnest(map_values(c)) as k from kg_log where t = 'cnt')), w as (select distinct rec_id from kg_log where t = 'cnt'), p as (select distinct id from kg_log where t = 'person'),
    o as (select w.rec_id, sum(k) as total, count(r.id) as options, arg_max(p.id is not null, [lpad(k::varchar, 20, '0'), r.id]) as known, count(*) filter (where k < 0) as negative from w left join r using (rec_id) left join p on p.id = r.id group by 1)
    select rec_id, case when options = 0 then 'no options' when negative > 0 then 'not a probability' when coalesce(total, 0) = 0 then 'sum of nothing' when not known then 'choice not among the options' else 'valid' end as verdict from o""",
    "answers_retries": f"with {_A}, n as (select event_id, row_number() over (partition by subject order by event_id) as n from a where kind = 'error' and subject is not null) select event_id, least(900.0, 30 * pow(2.0, least(n - 1, 40)))::bigint as seconds from n",
    "answers_soft_labels": f"""with {_A}, m as (select subject, kind, sum(p) as s from a where subject is not null and p is not null group by 1, 2), h as (select subject, kind, case when sum(s) over (partition by subject) > 0 then round(s / sum(s) over (partition by subject), 4) end as share from m),
    b as (select subject, (list(kind order by share desc, kind desc))[1] as choice, max(share) as share, count(*) as labels from h group by 1) select *, share between 0.3 and 0.7 as grey from b""",
}
