"""All queries of the core, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import activity, answers, asof, log, naming, reading, records, rules, text, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": asof.p2_found} | log.QUERIES | text.QUERIES | activity.QUERIES | naming.QUERIES | rules.QUERIES | words.QUERIES | answers.QUERIES | reading.QUERIES | records.QUERIES
ORACLES: dict[str, str] = {"p2_found": asof.P2_SQL} | log.ORACLES | text.ORACLES | activity.ORACLES | naming.ORACLES | rules.ORACLES | words.ORACLES | answers.ORACLES | reading.ORACLES | records.ORACLES
