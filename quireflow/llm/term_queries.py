"""Queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.term_scores import term_scores
from quireflow.sources.tables import table


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return term_scores(table(spark, folder, "chunks"), "chunk_id", ["indexed_text", "section_text"])


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).withColumn("score", F.round("score", 6))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).where((F.col("tf") >= 3) & F.col("df").between(2, 8)).select("chunk_id", "term")


_ROWS = r"""
WITH one AS (
  SELECT chunk_id, min_by(concat_ws(chr(10), indexed_text, section_text), ingested_at) AS body FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id
), words AS (SELECT chunk_id, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) AS term FROM one),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM words WHERE NOT regexp_matches(term, '\p{N}') GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)
"""
QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores}
SQL = {
    "p1_found": _ROWS + "SELECT chunk_id, term FROM tf JOIN dfs USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8",
    "p1_scores": _ROWS
    + """, lens AS (SELECT chunk_id, sum(tf) AS length FROM tf GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lens)
SELECT chunk_id, term, tf, df, round(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
FROM tf JOIN dfs USING (term) JOIN lens USING (chunk_id), stats""",
}
