"""Queries of the orphan-reference operator over the manual tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireflow.operators.references import MANUAL_KEYS, MANUAL_REFERENCES, orphan_references, orphan_totals
from quireflow.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: table(spark, folder, name) for name in MANUAL_KEYS}
    return orphan_references(tables, MANUAL_KEYS, MANUAL_REFERENCES, table(spark, folder, "tombstones"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: table(spark, folder, name) for name in MANUAL_KEYS}
    return orphan_totals(tables, MANUAL_KEYS, MANUAL_REFERENCES, table(spark, folder, "tombstones"))


_FOUND_SQL = """
WITH refs AS (
  SELECT 'chunks' AS ref_table, 'element_ids' AS ref_field, chunk_id AS record_id, min(ingested_at) AS seen, ref_id
  FROM (SELECT chunk_id, ingested_at, unnest(element_ids) AS ref_id FROM chunks) GROUP BY ALL
  UNION ALL
  SELECT 'graph_nodes', 'evidence_ids', node_id, min(ingested_at), ref_id
  FROM (SELECT node_id, ingested_at, unnest(evidence_ids) AS ref_id FROM graph_nodes) GROUP BY ALL
  UNION ALL
  SELECT 'graph_edges', 'source_id', edge_id, min(ingested_at), source_id FROM graph_edges GROUP BY ALL
  UNION ALL
  SELECT 'graph_edges', 'target_id', edge_id, min(ingested_at), target_id FROM graph_edges GROUP BY ALL
), dated AS (
  SELECT DISTINCT ref_table, ref_field, record_id, ref_id, strftime(seen, '%Y-%m') AS period,
         date_trunc('month', seen) + INTERVAL 1 MONTH AS month_end
  FROM refs WHERE ref_id IS NOT NULL AND ref_id <> ''
), lives AS (
  SELECT 'elements' AS t, element_id AS k, min(ingested_at) AS born FROM elements GROUP BY ALL
  UNION ALL SELECT 'chunks', chunk_id, min(ingested_at) FROM chunks GROUP BY ALL
  UNION ALL SELECT 'graph_nodes', node_id, min(ingested_at) FROM graph_nodes GROUP BY ALL
), targets AS (
  SELECT l.t, l.k, l.born, min(d.deleted_at) AS dead
  FROM lives l LEFT JOIN tombstones d ON d.record_table = l.t AND d.record_id = l.k GROUP BY ALL
), answered AS (
  SELECT DISTINCT r.ref_table, r.ref_field, r.record_id, r.ref_id
  FROM dated r JOIN targets g ON g.k = r.ref_id
   AND (   (r.ref_table = 'chunks' AND g.t = 'elements')
        OR (r.ref_table = 'graph_nodes' AND g.t IN ('elements', 'chunks'))
        OR (r.ref_table = 'graph_edges' AND g.t = 'graph_nodes'))
   AND g.born < r.month_end AND (g.dead IS NULL OR g.dead >= r.month_end)
)
SELECT ref_table, ref_field, record_id, ref_id, period FROM dated r
WHERE NOT EXISTS (SELECT 1 FROM answered a WHERE a.ref_table = r.ref_table AND a.ref_field = r.ref_field
                  AND a.record_id = r.record_id AND a.ref_id = r.ref_id)
"""

QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL = {
    "p5_found": _FOUND_SQL,
    "p5_counts": f"SELECT ref_table, ref_field, period, count(*) AS n_orphans FROM ({_FOUND_SQL}) GROUP BY ALL",
}
