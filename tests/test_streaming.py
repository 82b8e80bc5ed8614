from conftest import SF, rows_of
from pyspark.sql import functions as F

from quireflow.operators import bm25
from quireflow.sources.tables import first_arrivals, table
from quireflow.streaming.arrivals import arrivals_by_window, stream_postings

WEIGHTS = {"content": 1.0, "section_text": 1.8}


def test_streamed_postings_are_those_of_a_batch(spark, tmp_path):
    chunks = table(spark, SF, "chunks")
    chunks.orderBy("ingested_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
    query = stream_postings(stream, "chunk_id", WEIGHTS, str(tmp_path / "ix"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "ix")).drop("batch").withColumn("tf", F.round("tf", 3))
    want = bm25.postings(first_arrivals(chunks, "chunk_id", ["content", "section_text"]), "chunk_id", WEIGHTS).withColumn("tf", F.round("tf", 3))
    assert rows_of(got.toPandas()) == rows_of(want.toPandas())


def test_redeliveries_of_later_batches_are_not_posted_again(spark, tmp_path):
    elements = table(spark, SF, "elements").withColumn("month", F.date_format("ingested_at", "yyyy-MM"))
    months = [r.month for r in elements.select("month").distinct().orderBy("month").collect()]
    late = elements.where("element_id IS NOT NULL").groupBy("element_id").agg((F.datediff(F.max("ingested_at"), F.min("ingested_at")) > 7).alias("late"))
    assert len(months) > 1 and late.where("late").count() > 0
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(elements.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for month in months:
        elements.where(F.col("month") == month).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream_postings(stream, "element_id", {"content": 1.0}, str(tmp_path / "ix"), str(tmp_path / "ck"))
        assert query.awaitTermination(120)
    # An early record that comes last of all is posted too; one known without a token stays so.
    for n, rows in enumerate(([("early", "first words", "2000-01-01"), ("bare", "", "2000-01-01")], [("early", "other words", "2000-01-02"), ("bare", "words", "2000-03-01")])):
        more = spark.createDataFrame(rows, "element_id string, content string, ingested_at string")
        more = more.select(*[(F.col(f.name) if f.name in more.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in elements.schema])
        more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert stream_postings(stream, "element_id", {"content": 1.0}, str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "ix")).drop("batch").withColumn("tf", F.round("tf", 3))
    posted = got.where("element_id IN ('early', 'bare')").select("element_id", "term").collect()
    assert sorted((r.element_id, r.term) for r in posted) == [("early", "first"), ("early", "words")]
    want = bm25.postings(first_arrivals(elements, "element_id", ["content"]), "element_id", {"content": 1.0}).withColumn("tf", F.round("tf", 3))
    assert rows_of(got.where("element_id NOT IN ('early', 'bare')").toPandas()) == rows_of(want.toPandas())


def test_arrivals_by_window(spark, tmp_path):
    rows = table(spark, SF, "graph_edges").select("edge_type", "ingested_at")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    counted = arrivals_by_window(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "edge_type")
    query = counted.writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("arrivals").agg(F.sum("arrivals")).first()[0] == rows.count()
