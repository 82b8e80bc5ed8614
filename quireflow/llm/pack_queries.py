"""Problem 7: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.encode_queries import token_counts
from quireflow.llm.packing import pack
from quireflow.plans.workspace import written
from quireflow.sources.tables import table

CAPACITY = 2_048


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = written(token_counts(table(spark, folder, "documents"), "doc_id", "text"), "sizes")
    return pack(sizes, "doc_id", "n_tokens", sizes.count(), CAPACITY)


def p7_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens, fewest containers possible and share of unused space."""
    used = p7_containers(spark, folder)
    totals = used.agg(F.countDistinct("container_id").alias("containers"), F.sum("length").alias("tokens"))
    return totals.withColumn("least", F.ceil(F.col("tokens") / CAPACITY)).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6))


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Of each packed document: whether its pieces, end to end, are all of it and none is empty or over the capacity."""
    used = p7_containers(spark, folder)
    filled = used.groupBy("container_id").agg(F.sum("length").alias("filled"))
    rows = used.join(filled, "container_id")
    whole = (F.max(F.col("first") + F.col("length")) == F.sum("length")) & (F.count(F.lit(1)) == F.max("piece_no") + 1) & (F.min("length") > 0)
    return rows.groupBy("doc_id").agg(whole.alias("whole"), (F.max("filled") <= CAPACITY).alias("fits"))


QUERIES = {"p7_containers": p7_containers, "p7_usage": p7_usage, "p7_documents": p7_documents}
#: What SQL can say without the tokenizer: each non-blank document is packed, whole, within the capacity.
SQL = {"p7_documents": r"SELECT doc_id, true AS whole, true AS fits FROM documents WHERE regexp_matches(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')"}
