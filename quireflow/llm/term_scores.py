"""How distinctive a term is per record: probabilistic relevance weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.plans.workspace import written
from quireflow.sources.tables import first_arrivals

#: Terms in at least one of so many records are hot. Their number is at most this times the mean count of distinct
#: terms of a record, whatever the number of records, so the hot side may be broadcast.
HOT_SHARE = 256


def term_rows(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """key, term, tf, leads of each record and term; ``leads`` marks one row of each record, that of its first term. A term is a longest run of letters and digits of the lower-cased
    texts that holds no digit. Texts don't run into each other; null and empty texts add nothing."""
    words = F.regexp_extract_all(F.lower(F.concat_ws("\n", *texts)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    terms = F.filter(words, lambda w: ~w.rlike(r"\p{N}"))
    one = first_arrivals(df, key, texts).select(key, terms.alias("terms"))
    rows = one.select(key, F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    return rows.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"), (F.min("place") == 0).alias("leads"))


def term_scores(df: DataFrame, key: str, texts: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, term, tf, df, score of each record and term, over all records.

    score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)), where N
    counts the records with any term. A record without terms gives no row; redelivered records count once, by their
    first arrival; an empty table gives no rows. Records are shuffled once, by key, so the counts inside a record need
    no further exchange, and written: texts are cut into terms once. Document frequencies are summed on the map side and
    written too. Hot terms are looked up in a broadcast of proven size and scattered, so no task of the join gets a hot
    term's rows.
    """
    rows = written(term_rows(df, key, texts), "terms")
    dfs = written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "dfs")
    n, total = rows.agg(F.count_if("leads"), F.sum("tf")).first()
    mean = (total or 0) / max(1, n)
    hot = dfs.where(F.col("df") * HOT_SHARE >= n).select("term", F.col("df").alias("_hot"))
    cold = dfs.where(F.col("df") * HOT_SHARE < n).select(F.col("term").alias("_key"), F.col("df").alias("_cold"))
    scattered = F.concat(F.lit("\n"), F.xxhash64(key).cast("string"))  # no term holds a line feed
    joined = (
        rows.join(F.broadcast(hot), "term", "left")
        .withColumn("_key", F.when(F.col("_hot").isNull(), F.col("term")).otherwise(scattered))
        .join(cold, "_key", "left")
        .withColumn("df", F.coalesce("_hot", "_cold"))
    )
    idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    return joined.select(key, "term", "tf", "df", (idf * weight).alias("score"))
