"""Problem 4: markup in element and table contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.markup import clean
from quireflow.plans.workspace import spread
from quireflow.sources.tables import table


def clean_texts(df: DataFrame) -> DataFrame:
    """space, id, text, kinds of each row (space, id, text): the clean text, and the kinds of markup it had, by comma.

    One pass without a shuffle. Rows without markup, null and empty texts are unchanged, with empty kinds; repeated rows
    stay repeated; other columns are not read.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean(t) for t in batch.column(2).to_pylist()]
            texts, found = pa.array([t for t, _ in done], pa.string()), pa.array([",".join(k) for _, k in done], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, found], names=["space", "id", "text", "kinds"])

    return spread(df.select("space", "id", "text")).mapInArrow(convert, "space string, id string, text string, kinds string")


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda name: table(spark, folder, name).select(F.lit(name).alias("space"), F.col("element_id").alias("id"), F.col("content").alias("text"))
    done = clean_texts(one("elements").unionByName(one("table_elements")))
    return done.select(F.col("space").alias("record_table"), F.col("id").alias("element_id"), "text", "kinds")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_clean(spark, folder).where("kinds <> ''").select("record_table", "element_id").distinct()


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
SQL: dict = {}
