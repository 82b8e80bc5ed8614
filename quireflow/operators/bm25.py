"""Weighted BM25 over several text columns: kept indexes, and searches of many queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators.matches import best_matches
from quireflow.plans.workspace import checkpoint_root, kept, tidy
from quireflow.sources.files import open_index, write_index

K1, B = 1.2, 0.75
#: An inverse document frequency that is not positive counts as this.
LEAST_IDF = 1e-6
#: Scores are summed as whole numbers of this part, so that a sum does not depend on its order.
UNIT = 1e12
KIND = "bm25"

# Weights of content, section and metadata (label, text and section for graph nodes).
TEXT_WEIGHTS = {"content": 1.0, "section_text": 1.8, "metadata": 0.6}
TABLE_WEIGHTS = {"content": 1.0, "section_text": 2.0, "metadata": 0.5}
ROW_WEIGHTS = {"content": 1.0, "section_text": 1.8, "metadata": 0.5}
NODE_WEIGHTS = {"label": 2.2, "text": 1.0, "section_json": 0.6}


def postings(records: DataFrame, key: str, weights: dict[str, float], within: str | None = None, analyze=None, marked: bool = False) -> DataFrame:
    """key, term, tf (weighted), length (unweighted tokens of the record), and ``within``: one row per record and term.

    All columns' tokens are laid end to end below the generator, which would else tokenize again for each row it makes;
    a token's place tells its column. Tokens are counted by column and weighted after, so tf does not depend on an order.
    ``marked`` adds a row of the empty term for each record, and ``times``, how many records of that key and length there were.
    """
    words = analyze or (lambda c: T.tokens(c, T.PLAIN_TOKEN))
    carried = [key, within] if within else [key]
    parts = records.select(*carried, *[words(F.col(c)).alias(f"_w{i}") for i, c in enumerate(weights)])
    ends, total = [], F.lit(0)
    for i in range(len(weights)):
        total = total + F.size(f"_w{i}")
        ends.append(total)
    mark = [F.array(F.lit(""))] if marked else []
    laid = parts.select(*carried, total.alias("length"), *[e.alias(f"_e{i}") for i, e in enumerate(ends)], F.concat(*[f"_w{i}" for i in range(len(weights))], *mark).alias("ts"))
    rows = laid.select(*carried, "length", *[f"_e{i}" for i in range(len(ends))], F.posexplode("ts").alias("place", "term"))
    counts = [F.count_if((F.col("place") < F.col(f"_e{i}")) & (F.col("place") >= (F.col(f"_e{i - 1}") if i else F.lit(0)))) for i in range(len(ends))]
    tf = F.lit(0.0)
    for n, w in zip(counts, weights.values()):
        tf = tf + n * F.lit(float(w))
    return rows.groupBy(*carried, "length", "term").agg(tf.alias("tf"), *[F.count(F.lit(1)).alias("times")] * marked)


@dataclass(frozen=True)
class Index:
    """Postings by term, each term's idf and greatest share of a score, and the size of what was indexed."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str


def write(records: DataFrame, key: str, weights: dict[str, float], path: str, within: str | None = None, analyze=None) -> None:
    """Writes an index of records. Repeated keys are an error. Postings stay in the task that made them, so those of a record
    lie in one file and each file names few records; within a file they lie by term, so a search for some terms reads only
    their parts. They are written once, with a row of the empty term for each record, and never shuffled."""
    spark = records.sparkSession
    made = postings(records, key, weights, within, analyze, marked=True).withColumn("times", F.when(F.col("term") == "", F.col("times")))
    every = lambda: spark.read.schema(made.schema).parquet(f"{path}/postings")

    def stats() -> DataFrame:
        tidy(spark)
        marks = every().where("term = ''")
        twice = marks.groupBy(key).agg(F.sum("times").alias("count")).where("count > 1").first()
        if twice:
            raise ValueError(f"{key} {twice[key]} is indexed {twice['count']} times")
        n, total = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return spark.createDataFrame([(key, n, total, total / n if n else 0.0)], "key string, n bigint, tokens bigint, mean double")

    def terms() -> DataFrame:
        s = spark.read.parquet(f"{path}/stats").first()
        idf = F.log((s["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        made = _parts(every(), s["mean"]).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
        return made.withColumn("idf", F.when(idf <= 0, LEAST_IDF).otherwise(idf)).repartitionByRange("term").sortWithinPartitions("term")

    write_index({"postings": made.sortWithinPartitions("term", key), "stats": stats, "terms": terms}, path, KIND)
    tidy(spark)


def _parts(every: DataFrame, mean: float) -> DataFrame:
    """Postings with the part of a score that does not depend on the term's frequency; rows that stand for records go."""
    tf = F.col("tf")
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / (mean or 1.0)))
    return every.where("term <> ''").drop("times").withColumn("part", part)


def opened(spark: SparkSession, path: str) -> Index:
    """A written index; another kind or version is an error."""
    t = open_index(spark, path, KIND)
    stats = t["stats"].first()
    return Index(_parts(t["postings"], stats["mean"]), t["terms"], t["stats"], stats["key"])


def index_of(spark: SparkSession, name: str, records: DataFrame, key: str, weights: dict[str, float], mark: str, within: str | None = None, analyze=None, root: str | None = None) -> Index:
    """The kept index of that name and ``mark`` (a fingerprint of what records come from): written at first, opened after."""
    place = kept(spark, f"{name}-{mark}", lambda path: write(records, key, weights, path, within, analyze), root or f"{checkpoint_root(spark)}/indexes")
    return opened(spark, place)


def _units() -> Column:
    return F.round(F.col("idf") * F.col("part") * UNIT).cast("bigint")


def search(index: Index, queries: DataFrame, limit: int | None, within: str | None = None) -> DataFrame:
    """query_id, key, score, rank of the ``limit`` best records of each query (query_id, term; distinct terms).

    Statistics are of the whole index, records without tokens included. ``within`` names a column of both sides that a
    hit must share; it filters hits before ranking, never the statistics. Ranks go by the sum itself, ties to the
    smaller key; the score is rounded to 6 digits after. Only postings of terms some query asks for are read on.
    """
    if limit is not None:
        return _matched(index, queries, limit, within)
    key = index.key
    asked = queries.join(index.terms.select("term", "idf"), "term")
    hits = index.postings.join(asked, ["term", within] if within else ["term"])
    return _ranked(hits.groupBy("query_id", key).agg(F.sum(_units()).alias("_s")), key, limit)


def _matched(index: Index, queries: DataFrame, limit: int, within: str | None, pruned: bool = False) -> DataFrame:
    """Only distinct terms of queries are broadcast, of which there are as many as words, not as queries."""
    key, by = index.key, [within] if within else []
    asked = index.terms.select("term", "idf").join(F.broadcast(queries.select("term").distinct()), "term")
    posted = index.postings.join(F.broadcast(asked), "term").select(key, "term", *by, _units().alias("value"))
    sizes = index.postings.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if within else index.postings.count()
    terms = queries.groupBy("query_id", *by).agg(F.collect_list("term").alias("terms"))
    return _ranked(best_matches(terms, posted, key, limit, sizes, within, pruned), key, limit)


def pruned_search(index: Index, queries: DataFrame, limit: int, within: str | None = None) -> DataFrame:
    """``search``, but records that only common terms lead to are left out where they cannot be among the best.

    Terms are added strongest first. Once so many records have more than the greatest shares of the other terms together,
    those cannot lift a record by themselves: they are looked up only for records another term has found. Nothing is lost.
    """
    return _matched(index, queries, limit, within, pruned=True)


def _ranked(scored: DataFrame, key: str, limit: int | None) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("_s"), key)
    ranked = scored.withColumn("rank", F.row_number().over(best))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.select("query_id", key, F.round(F.col("_s") / UNIT, 6).alias("score"), "rank")


def query_terms(queries: DataFrame, text: str, stopwords=T.TEXT_STOPWORDS) -> DataFrame:
    """One row per query and distinct term, with the query's other columns."""
    return queries.withColumn("term", F.explode(T.search_terms(F.col(text), stopwords)))
