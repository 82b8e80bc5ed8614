"""Problem 3: passages carried over with small changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.near import near_classes, near_pairs
from quireflow.sources.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda name, key: table(spark, folder, name).select(F.lit(name).alias("space"), F.col(key).alias("id"), F.col("content").alias("text"))
    return one("chunks", "chunk_id").unionByName(one("elements", "element_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_pairs(_records(spark, folder), words=3, similarity=0.7, least_words=30).withColumnRenamed("space", "record_table")


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_classes(_records(spark, folder)).withColumnRenamed("space", "record_table")


_PAIRS = r"""
WITH records AS (
  SELECT DISTINCT 'chunks' AS record_table, chunk_id AS id, content FROM chunks
  UNION SELECT 'elements', element_id, content FROM elements
), worded AS (
  SELECT record_table, id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM records WHERE content IS NOT NULL
), sets AS (
  SELECT record_table, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2]))) AS s
  FROM worded WHERE len(w) >= 30
), tokens AS (SELECT record_table, id, len(s) AS n, unnest(s) AS t FROM sets)
SELECT a.record_table, a.id AS id_a, b.id AS id_b
FROM tokens a JOIN tokens b ON a.record_table = b.record_table AND a.t = b.t AND a.id < b.id
GROUP BY a.record_table, a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9
"""
_CLASSES = r"""
WITH RECURSIVE records AS (
  SELECT DISTINCT 'chunks' AS record_table, chunk_id AS id, content FROM chunks UNION SELECT 'elements', element_id, content FROM elements
), worded AS (SELECT record_table, id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM records WHERE content IS NOT NULL),
sets AS (
  SELECT record_table, id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))) AS s FROM worded WHERE len(w) >= 5
), ids AS (SELECT record_table, id, hash(record_table, s) AS set_id, s FROM sets),
one AS (SELECT record_table, set_id, any_value(s) AS s FROM ids GROUP BY ALL),
tokens AS (SELECT record_table, set_id, len(s) AS n, unnest(s) AS t FROM one),
links AS MATERIALIZED (
  SELECT a.set_id AS a, b.set_id AS b FROM tokens a JOIN tokens b ON a.record_table = b.record_table AND a.t = b.t AND a.set_id <> b.set_id
  GROUP BY a.set_id, b.set_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), reach AS (SELECT DISTINCT set_id AS root, set_id AS node FROM ids UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT r.root AS set_id, min(i.id) AS class_id FROM reach r JOIN ids i ON i.set_id = r.node GROUP BY ALL),
degree AS (SELECT a AS set_id, count(*) AS n FROM links GROUP BY a)
SELECT record_table, id, class_id, coalesce(n, 0) AS n_links FROM (SELECT DISTINCT record_table, id, set_id FROM ids) JOIN least USING (set_id) LEFT JOIN degree USING (set_id)
"""
QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}
SQL = {"p3_found": _PAIRS, "p3_classes": _CLASSES}
