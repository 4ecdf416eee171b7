"""Queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import encode, glyphs, groups, mix, names, pieces, stuffing, truncation
from tidemark.sources.tables import log_records, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_a, person_b: ids of one book that stand for the same person or organisation."""
    return names.pairs_of_groups(names.resolve(_spellings(spark, sf_dir), table(spark, sf_dir, "nicknames")))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, entity_id: each id with the smallest id of its entity."""
    return names.resolve(_spellings(spark, sf_dir), table(spark, sf_dir, "nicknames")).select(F.col("member").alias("person_id"), F.col("group_id").alias("entity_id"))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_records(spark, sf_dir, "person", "name", "alias")
    return log.select(F.col("book_id").alias("scope"), F.col("id").alias("entity"), F.coalesce("name", "alias").alias("spelling"), (F.col("t") == "person").alias("introduces"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "segs").select("book_id", "seg", "o0", "o1", "lang")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, seg, piece, o0, o1: the pieces of every segment over its limit."""
    return pieces.split_segments(_segments(spark, sf_dir), table(spark, sf_dir, "blocks").select("book_id", "block_no", "o", "t"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, seg: the segments that had to be cut."""
    return p3_pieces(spark, sf_dir).select("book_id", "seg").distinct()


def _cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_records(spark, sf_dir, "person", "profile", "rel")
    text = F.when(F.col("t") == "person", F.col("intro")).when(F.col("t") == "profile", F.col("tagline")).otherwise(F.col("rel_desc"))
    return truncation.judge_texts(log.select("rec_id", F.col("model").alias("source"), F.col("t").alias("field"), text.alias("text")), _spellings(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id: the records whose text was cut off."""
    return _cut_texts(spark, sf_dir).where("cut").select("rec_id")


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, texts, cut, share: how often each source cuts its texts."""
    return truncation.rates(_cut_texts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, group_id of every id that a merge record joins to another."""
    merges = log_records(spark, sf_dir, "merge").select("from_id", "into_id")
    return groups.connected_groups(merges, "from_id", "into_id").select(F.col("member").alias("person_id"), "group_id")


P5_SQL = """
with recursive e as (
  select distinct from_id as a, into_id as b from kg_log where t = 'merge' and from_id <> into_id
  union select distinct into_id, from_id from kg_log where t = 'merge' and from_id <> into_id),
r(v, w) as (select a, a from e union select r.v, e.b from r join e on e.a = r.w)
select v as person_id, min(w) as group_id from r group by v
"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_records(spark, sf_dir, "event", "rel")
    return log.select("rec_id", "book_id", "t", F.when(F.col("t") == "event", F.col("text")).otherwise(F.col("quote")).alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_a, rec_b: records of one book whose strings differ but look the same."""
    return glyphs.look_alikes(_passages(spark, sf_dir))


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, form: each passage in its one consistent form."""
    return glyphs.with_form(_passages(spark, sf_dir)).where("text is not null").select("rec_id", "form").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: the tokens of every document."""
    return encode.encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "ids").select("doc_id", "ids")


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix.plan_mix(docs, table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target_share, max_repeats, documents, available, taken, most_copies, target, share_of_total, actual_share, reached: what each source contributes."""
    return mix.report(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, copies: the documents of the mix."""
    return _mix(spark, sf_dir).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id: stuffed keywords, lists of links or product tags in place of sentences."""
    return stuffing.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).where("stuffed").select("doc_id")


P3_SQL = """
select distinct book_id, seg from segs where o1 - o0 > case when lang = 'zh' then 3200 else 9000 end
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_sources": p4_sources,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_forms": p6_forms,
    "p7_ids": p7_ids,
    "p8_report": p8_report,
    "p8_mix": p8_mix,
    "p9_found": p9_found,
}
ORACLES: dict[str, str] = {"p3_found": P3_SQL, "p5_found": P5_SQL}
