"""The queries of the problems on training data, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benthos.llm import broken_pairs, cross_split, encoding, mixing, packing, related_splits, shared_spans
from benthos.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlaps(table(spark, d, "samples"))


def p1_overlap(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, d, "samples"), p1_found(spark, d))


def p3_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "samples"), table(spark, d, "data_arguments"), table(spark, d, "dataset_registry"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "samples"), table(spark, d, "data_arguments"), table(spark, d, "dataset_registry"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs.defects(table(spark, d, "samples"), table(spark, d, "predictions"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs.defect_report(table(spark, d, "samples"), table(spark, d, "predictions"), p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.groups(table(spark, d, "samples"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.deal(related_splits.groups(table(spark, d, "samples")), table(spark, d, "split_targets"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.split_report(p5_splits(spark, d), table(spark, d, "split_targets"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, the length and md5 of what its ids decode to."""
    back = encoding.decode(encoding.encode(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids")
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared_spans.shared_report(docs, shared_spans.shared_spans(docs))


def queries() -> dict[str, Query]:
    found = [p1_found, p1_overlap, p3_mixture, p3_shares, p4_found, p4_report, p5_found, p5_splits, p5_shares, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_report]
    return {f.__name__: f for f in found}


P5_GROUPS = r"""
WITH RECURSIVE keys AS (
  SELECT DISTINCT row_no, 'p:' || stem AS key FROM (
    SELECT row_no, regexp_replace(lower(regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '^.*[/\\]', '')), '\s*\.[^.\s]*$', '') AS stem
    FROM (SELECT row_no, unnest(image) AS p FROM samples)) WHERE stem <> ''
  UNION
  SELECT row_no, 'd:' || regexp_extract(id, '(?i)^[^-_/]*[-_/]\s*D0*([0-9]+)\s*([-_/]|$)', 1) FROM samples
  WHERE regexp_extract(id, '(?i)^[^-_/]*[-_/]\s*D0*([0-9]+)\s*([-_/]|$)', 1) <> ''
), anchored AS (
  SELECT row_no, min(row_no) OVER (PARTITION BY key) AS anchor FROM keys
), edges AS (
  SELECT DISTINCT a.anchor AS u, b.anchor AS v FROM anchored a JOIN anchored b USING (row_no) WHERE a.anchor <> b.anchor
), reach(node, other) AS (
  SELECT DISTINCT anchor, anchor FROM anchored
  UNION
  SELECT r.node, e.v FROM reach r JOIN edges e ON r.other = e.u
), least AS (SELECT node, min(other) AS group_no FROM reach GROUP BY node)
SELECT s.row_no, coalesce(min(l.group_no), s.row_no) AS group_no
FROM samples s LEFT JOIN anchored a ON a.row_no = s.row_no LEFT JOIN least l ON l.node = a.anchor GROUP BY s.row_no
"""

P8_SPANS = """
WITH grams AS (
  SELECT doc_id, pos, md5(substring(text, pos + 1, 200)) AS g
  FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS pos FROM documents WHERE length(text) >= 200)
), twice AS (SELECT g FROM grams GROUP BY g HAVING min(doc_id) <> max(doc_id)),
shared AS (SELECT DISTINCT doc_id, pos FROM grams JOIN twice USING (g)),
runs AS (
  SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run
  FROM (SELECT doc_id, pos, coalesce((pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 200)::INT, 1) AS new FROM shared)
), spans AS (SELECT doc_id, min(pos)::INT AS from_char, (max(pos) + 200)::INT AS to_char FROM runs GROUP BY doc_id, run)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": P5_GROUPS,
        "p6_round_trip": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
        "p8_found": P8_SPANS + "SELECT doc_id, from_char, to_char FROM spans",
        "p8_report": P8_SPANS
        + """SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(s.n, 0) AS n_spans, coalesce(s.c, 0)::BIGINT AS shared_chars,
  CASE WHEN coalesce(length(d.text), 0) = 0 THEN 0.0 ELSE coalesce(s.c, 0) / length(d.text) END::DOUBLE AS shared_part
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(to_char - from_char) AS c FROM spans GROUP BY doc_id) s USING (doc_id)""",
    }
