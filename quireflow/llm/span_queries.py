"""Problem 8: stretches of documents that occur word for word in other documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.spans import SPAN, shared_stretches
from quireflow.sources.tables import table


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return shared_stretches(table(spark, folder, "documents"), "doc_id", "text")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document with shared stretches: their number and how many of its characters they cover."""
    documents = table(spark, folder, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    shared = p8_spans(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_stretches"), F.sum("length").cast("bigint").alias("shared_chars"))
    return shared.join(documents, "doc_id").withColumn("shared_share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_spans(spark, folder).select("doc_id").distinct()


_SHARED = f"""
WITH windows AS (
  SELECT doc_id, pos, substr(text, pos + 1, {SPAN}) AS body
  FROM (SELECT doc_id, text, unnest(range(0, length(text) - {SPAN} + 1)) AS pos FROM documents WHERE length(text) >= {SPAN})
), digests AS (SELECT doc_id, pos, hash(body) AS digest FROM windows),
common AS (SELECT digest FROM digests GROUP BY digest HAVING min(doc_id) <> max(doc_id)),
shared AS (SELECT doc_id, pos FROM digests WHERE digest IN (SELECT digest FROM common)),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {SPAN} THEN 0 ELSE 1 END AS new FROM shared),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
spans AS (SELECT doc_id, min(pos)::INT AS first, (max(pos) - min(pos) + {SPAN})::INT AS length FROM runs GROUP BY doc_id, run)
"""
QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_shares": p8_shares}
SQL = {
    "p8_found": _SHARED + "SELECT DISTINCT doc_id FROM spans",
    "p8_spans": _SHARED + "SELECT * FROM spans",
    "p8_shares": _SHARED
    + """SELECT doc_id, count(*) AS n_stretches, sum(s.length)::BIGINT AS shared_chars, length(d.text) AS n_chars,
       round(sum(s.length) / length(d.text), 6) AS shared_share
FROM spans s JOIN documents d USING (doc_id) GROUP BY doc_id, d.text""",
}
