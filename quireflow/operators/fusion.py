"""Rank fusion and exact vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.plans.workspace import shuffle_partitions, tidy, written

#: The constant of reciprocal rank fusion, and how many candidates each side gives.
RRF_K = 60
CANDIDATES = 50
#: Query vectors scored in one block: a fixed number, whatever their total.
BLOCK = 1_024


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, key: str, limit: int, names: tuple[str, str], k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """query_id, key, each side's rank (null where it lacks the record), rrf_score, rank: best first, ties by key."""
    # A query's ranks meet as lists: rankings lie by query already, so neither they nor the fused rows are shuffled again.
    listed = lambda df, n: df.groupBy("query_id").agg(F.collect_list(F.struct(key, F.col("rank").alias(f"{n}_rank"))).alias(n))
    both = listed(a, names[0]).join(listed(b, names[1]), "query_id", "full_outer")
    kind, none = a.schema["rank"].dataType.simpleString(), F.lit(None)
    one = lambda own: F.transform(own, lambda x: F.struct(x[key].alias(key), *[(x[f"{n}_rank"] if n == own else none).cast(kind).alias(f"{n}_rank") for n in names]))
    rows = both.select("query_id", F.inline(F.concat(*[F.coalesce(one(n), F.array()) for n in names])))
    part = lambda n, w: F.coalesce(w / (k + F.col(f"{n}_rank")), F.lit(0.0))
    joined = rows.groupBy("query_id", key).agg(*[F.min(f"{n}_rank").alias(f"{n}_rank") for n in names])
    return _ranked(joined.withColumn("rrf_score", F.round(part(names[0], weights[0]) + part(names[1], weights[1]), 15)), "rrf_score", key, limit)


def page_fusion(visual: DataFrame, text: DataFrame, key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Visual hits with the best rank of a text hit on their page; text hits on other pages are left out."""
    pages = text.select("query_id", "doc_id", F.explode("page_nos").alias("page_no"), "rank").groupBy("query_id", "doc_id", "page_no").agg(F.min("rank").alias("text_rank"))
    seen = visual.withColumnRenamed("rank", "visual_rank").join(pages, ["query_id", "doc_id", "page_no"], "left")
    score = 1.0 / (k + F.col("visual_rank")) + F.coalesce(1.0 / (k + F.col("text_rank")), F.lit(0.0))
    return _ranked(seen.drop("score").withColumn("rrf_score", F.round(score, 15)), "rrf_score", key, limit)


def _ranked(df: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


#: Rows scored with a block of queries at a time.
ROWS = 16_384


def vector_search(rows: DataFrame, queries: DataFrame, key: str, vector: str, limit: int, within: str | None = None) -> DataFrame:
    """query_id, key, score, rank: the records of highest cosine with each query vector, itself left out.

    Exact. Rows and queries are written once to the shared folder, by ranges of ``within``; each task holds a block of queries
    and reads all rows from there, or those of its values of ``within``, so many at a time. So neither side is copied for the
    other, on disk or in shuffles, and no vector passes through the driver. Cosines of single precision find candidates, a
    bound of their error below the best so far; candidates count by their cosines of double precision. Null and zero vectors
    and null keys take no part; ranks go by the raw cosine (of 12 digits), ties to the smaller key; the score has 6 digits.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    # Columns are named anew, as both sides may come from one table.
    named = [F.col(key).alias("k"), (F.col(within).cast("string") if within else F.lit("")).alias("w")]
    same = queries is rows
    sides = [df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(*named, F.col(vector).cast("array<double>").alias("v")).where("w IS NOT NULL") for df in ((rows,) if same else (rows, queries))]
    if within:
        sides = [df.repartitionByRange(shuffle_partitions(spark), "w", "k").sortWithinPartitions("w") for df in sides]
    held, *rest = [written(df, "vectors") for df in sides]
    asked = held if same else rest[0]
    tidy(spark)
    files, n = held.inputFiles(), asked.count()

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield _nearest(batch.slice(at, BLOCK), files, key, limit, bool(within))

    asked = asked if n > BLOCK * shuffle_partitions(spark) else asked.repartition(max(1, min(shuffle_partitions(spark), n)))
    found = asked.mapInArrow(score, f"query_id {kind}, `{key}` {kind}, _s double") if files else spark.createDataFrame([], f"query_id {kind}, `{key}` {kind}, _s double")
    return _ranked(found, "_s", key, limit).select("query_id", key, F.round("_s", 6).alias("score"), "rank")


def _vectors(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64))


def _nearest(asked: pa.RecordBatch, files: list[str], key: str, limit: int, within: bool) -> pa.RecordBatch:
    """The ``limit`` nearest rows of the files to each query of a block (k, w, v): query, key and cosine."""
    from pyarrow import dataset, fs

    own, place = _vectors(asked.column(2)), asked.column(1).to_numpy(zero_copy_only=False)
    ids, single = asked.column(0).to_numpy(zero_copy_only=False), own.astype(np.float32)
    slack = (own.shape[1] + 8) * 2.0**-22  # more than products of unit vectors lose in single precision
    system, _ = fs.FileSystem.from_uri(files[0])
    table = dataset.dataset([fs.FileSystem.from_uri(f)[1] for f in files], format="parquet", filesystem=system)
    wanted = dataset.field("w").isin(list(dict.fromkeys(place))) if within else None
    best = [(ids[:0], np.zeros(0)) for _ in ids]
    floor = np.full(len(ids), -np.inf)
    for batch in table.to_batches(columns=["k", "w", "v"], filter=wanted, batch_size=ROWS, use_threads=False):
        if not batch.num_rows:
            continue
        keys, values, groups = batch.column(0).to_numpy(zero_copy_only=False), _vectors(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False)
        halves = values.astype(np.float32)
        for name in dict.fromkeys(place):  # '' alone without ``within``
            mine = np.flatnonzero(place == name)
            theirs = np.flatnonzero(groups == name) if within else np.arange(len(keys))
            if not len(theirs):
                continue
            near = single[mine] @ halves[theirs].T
            if len(theirs) > limit:  # itself may be among them, so one more
                near[np.isnan(near)] = -np.inf
                here = np.partition(near, -limit - 1, axis=1)[:, -limit - 1] if np.isinf(floor[mine]).any() else np.full(len(mine), -np.inf, np.float32)
                low = np.maximum(floor[mine], here) - slack
            else:
                low = np.full(len(mine), -np.inf)
            at, row = np.nonzero(near >= low.astype(np.float32)[:, None])
            exact = np.round(np.einsum("ij,ij->i", own[mine[at]], values[theirs[row]]), 12)
            cuts = np.searchsorted(at, np.arange(len(mine) + 1))
            for i, q in enumerate(mine):
                part = slice(cuts[i], cuts[i + 1])
                k, s = keys[theirs[row[part]]], exact[part]
                fine = ~np.isnan(s) & (k != ids[q])
                if fine.any():
                    k, s = np.concatenate([best[q][0], k[fine]]), np.concatenate([best[q][1], s[fine]])
                    order = np.lexsort((np.argsort(np.argsort(k, kind="stable"), kind="stable"), -s))[:limit]
                    best[q] = (k[order], s[order])
                    if len(order) == limit:
                        floor[q] = s[order[-1]]
    sizes = [len(b[0]) for b in best]
    pick = pa.array(np.repeat(np.arange(len(ids)), sizes))
    kind = asked.column(0).type
    return pa.RecordBatch.from_arrays([asked.column(0).take(pick), pa.array(np.concatenate([b[0] for b in best]), kind), pa.array(np.concatenate([b[1] for b in best]))], names=["query_id", key, "_s"])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)
