"""Problem 2: oversized chunk contents in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.splitting import LIMIT, OVERLAP, pieces, pieces_with_sources
from quireflow.sources.tables import first_arrivals, table


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces_with_sources(table(spark, folder, "chunks"), table(spark, folder, "elements"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks the splitter makes a second piece of."""
    chunks = first_arrivals(table(spark, folder, "chunks"), "chunk_id", ["content"])
    return pieces(chunks, "chunk_id", "content").where("piece_no = 2").select("chunk_id")


def p2_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Of each chunk the pieces without their overlaps, end to end; how many there are; and whether all keep to the bounds: a
    length of at most the limit, and an overlap of 80 to 160 characters in every piece but the first."""
    p = p2_pieces(spark, folder)
    own = F.substring("piece", F.col("cut") - F.col("first") + 1, F.length("piece"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda x: x["own"])
    lap = F.col("cut") - F.col("first")
    fine = (F.length("piece") <= LIMIT) & F.when(F.col("piece_no") == 1, lap == 0).otherwise(lap.between(*OVERLAP))
    return p.groupBy("chunk_id").agg(F.array_join(ordered, "").alias("content"), (F.count(F.lit(1)) > 1).alias("split"), F.min(fine).alias("within_bounds"), (F.max("piece_no") == F.count(F.lit(1))).alias("numbered"))


_BARE = "trim(content, ' ' || chr(9) || chr(10) || chr(13))"
QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt}
SQL = {
    "p2_rebuilt": f"SELECT chunk_id, min_by({_BARE}, ingested_at) AS content, length(min_by({_BARE}, ingested_at)) > {LIMIT} AS split, true AS within_bounds, true AS numbered FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING length(min_by({_BARE}, ingested_at)) > 0",
    "p2_found": f"""
SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) > {LIMIT}""",
}
