"""Structured Streaming of record arrivals: first arrivals into postings, and arrival counts by window.

Times without a zone are taken as the session's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quireflow.operators import bm25
from quireflow.sources.tables import first_arrivals


def first_in_stream(stream: DataFrame, key: str, arrived: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """The stream without redeliveries that come within ``late`` of the first; state of older keys is dropped, so later
    redeliveries pass. Rows that arrived more than ``late`` before the latest of earlier batches are left out."""
    return stream.where(F.col(key).isNotNull()).withColumn(arrived, F.col(arrived).cast("timestamp")).withWatermark(arrived, late).dropDuplicatesWithinWatermark([key])


def stream_postings(stream: DataFrame, key: str, weights: dict[str, float], path: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of new records to an index table, one folder a batch; a batch that is tried again replaces its
    own folder, so each record counts once. Document frequencies are aggregates of the table.

    However late it comes, a record is new if no other batch holds its key; within a batch its first arrival counts. The
    keys, also of records without a token, are kept in a table beside the index, ``path`` + ``_keys``, which every batch
    reads."""
    spark, known = stream.sparkSession, f"{path.rstrip('/')}_keys"
    spark.createDataFrame([], StructType([stream.schema[key]])).write.mode("overwrite").parquet(f"{known}/batch=-1")

    def append(batch: DataFrame, number: int) -> None:
        others = batch.sparkSession.read.parquet(known).where(F.col("batch") != number).select(key)
        fresh = first_arrivals(batch, key, list(weights)).join(others, key, "left_anti").persist()
        bm25.postings(fresh, key, weights).write.mode("overwrite").parquet(f"{path}/batch={number}")
        fresh.select(key).write.mode("overwrite").parquet(f"{known}/batch={number}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_by_window(stream: DataFrame, by: str, arrived: str = "ingested_at", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Arrivals of each value of ``by`` in each window of time; rows later than ``late`` are left out."""
    return stream.withColumn(arrived, F.col(arrived).cast("timestamp")).withWatermark(arrived, late).groupBy(F.window(arrived, window).alias("w"), by).agg(F.count(F.lit(1)).alias("arrivals")).select(F.col("w.start").alias("start"), by, "arrivals")
