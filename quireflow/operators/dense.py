"""Signed feature hashing, TF-IDF and randomized latent semantic vectors of texts."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.plans.workspace import release, summed, written, written_so_far

# Features, dimensions, further directions of the random projection, its seed.
FEATURES, DIMENSIONS, OVERSAMPLE, SEED = 2048, 128, 16, 2026
#: Personalization of the term hash, at most 16 bytes; another index's vectors need that index's own.
PERSON = b"quireflow-lsa-v1"
#: Texts laid out as one dense matrix at a time.
ROWS_AT_ONCE = 1_000


def feature(term: str, features: int = FEATURES, person: bytes = PERSON) -> tuple[int, int]:
    """Bucket and sign of a term: 64 bits of a keyed hash, little-endian, modulo ``features``; the top one set is +1."""
    value = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8, person=person).digest(), "little")
    return value % features, 1 if value >> 63 else -1


class _Features(dict):
    """Signed buckets (sign times bucket + 1) of a worker's common terms."""

    def __init__(self, features: int, person: bytes):
        super().__init__()
        self.features, self.person = features, person

    def __missing__(self, term: str) -> int:
        bucket, sign = feature(term, self.features, self.person)
        if len(self) < 500_000:
            self[term] = sign * (bucket + 1)
        return sign * (bucket + 1)


_caches: dict[tuple[int, bytes], _Features] = {}


def _lists(keys: pa.Array, buckets: list[np.ndarray], values: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    offsets = np.zeros(len(buckets) + 1, np.int32)
    np.cumsum([len(b) for b in buckets], out=offsets[1:])
    flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    b = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat(buckets, np.int32)))
    return pa.RecordBatch.from_arrays([keys, b, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat(values, np.float64)))], names=names)


def hashed_counts(df: DataFrame, key: str, text: str, features: int = FEATURES, person: bytes = PERSON) -> DataFrame:
    """key, buckets, counts of each row: signed counts of its terms and neighbour pairs, ascending by bucket; sums of zero
    are left out. A null or empty text has empty lists. One pass without a shuffle."""

    def count(batches):
        known = _caches.setdefault((features, person), _Features(features, person))
        for batch in batches:
            buckets, counts = [], []
            for terms in batch.column(1).to_pylist():
                f = np.array([known[t] for t in terms or ()], np.int64)
                sums = np.bincount(np.abs(f) - 1, weights=np.sign(f), minlength=features) if len(f) else np.zeros(features)
                buckets.append(np.flatnonzero(sums))
                counts.append(sums[buckets[-1]])
            yield _lists(batch.column(0), buckets, counts, [key, "buckets", "counts"])

    terms = df.select(key, T.dense_words(F.col(text)).alias("ws")).select(key, T.with_pairs(F.col("ws")).alias("ts"))
    return terms.mapInArrow(count, f"`{key}` {df.schema[key].dataType.simpleString()}, buckets array<int>, counts array<double>")


def weights(df: DataFrame, key: str, text: str, features: int = FEATURES, person: bytes = PERSON) -> DataFrame:
    """key, buckets, weights: (1 + ln|n|) sign idf, each text's vector of length 1; idf = ln((1 + N) / (1 + df)) + 1.

    N counts all rows; texts without terms have no row. Counts are written once; document frequencies, at most
    ``features`` numbers, are the only thing that travels.
    """
    counts = written(hashed_counts(df, key, text, features, person), "counts")
    n = counts.count()
    idf = np.zeros(features)
    for r in counts.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("df")).collect():  # at most ``features`` rows
        idf[r["b"]] = math.log((1 + n) / (1 + r["df"])) + 1
    shared = df.sparkSession.sparkContext.broadcast(idf)

    def weigh(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            b, c = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            w = np.sign(c) * (1 + np.log(np.abs(c))) * shared.value[b]
            row = np.repeat(np.arange(len(sizes)), sizes)
            w /= np.sqrt(np.bincount(row, weights=w * w, minlength=len(sizes)))[row]
            cuts = np.cumsum(sizes)[:-1]
            yield _lists(batch.column(0), np.split(b, cuts), np.split(w, cuts), [key, "buckets", "weights"])

    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, buckets array<int>, weights array<double>"
    return counts.where(F.size("buckets") > 0).mapInArrow(weigh, kind)


def tfidf(df: DataFrame, key: str, text: str, features: int = FEATURES, person: bytes = PERSON) -> DataFrame:
    """key, bucket, weight: ``weights`` in long form."""
    rows = weights(df, key, text, features, person)
    return rows.select(key, F.explode(F.arrays_zip("buckets", "weights")).alias("z")).select(key, F.col("z.buckets").alias("bucket"), F.col("z.weights").alias("weight"))


def _matrices(batch: pa.RecordBatch, features: int):
    """Dense matrices of the rows of a batch (key, buckets, weights), so many rows at a time."""
    buckets, weights = batch.column(1), batch.column(2)
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        b, w = buckets.slice(at, ROWS_AT_ONCE), weights.slice(at, ROWS_AT_ONCE)
        out = np.zeros((len(b), features))
        row = np.repeat(np.arange(len(b)), b.value_lengths().to_numpy(zero_copy_only=False))
        out[row, b.flatten().to_numpy()] = w.flatten().to_numpy()
        yield out


def lsa_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``lsa`` of texts; counts and weights go as soon as the vectors are written."""
    mark = written_so_far()
    vectors = lsa(weights(df, key, text), key)
    release(mark, keep=1)
    return vectors


def lsa(weighed: DataFrame, key: str, features: int = FEATURES, dimensions: int = DIMENSIONS, oversample: int = OVERSAMPLE, seed: int = SEED) -> DataFrame:
    """key and vector (array<double>, length 1) of rows key, buckets, weights: each text in the leading right singular directions of all texts' weights.

    With Y = A Omega of a fixed random Omega, only Y'Y and Y'A, whose sizes do not depend on the number of texts, are
    summed over the cluster in steps; B = Q'A follows by a Cholesky factor of Y'Y, and its right singular vectors go back
    out. The weights are written once, and so are the vectors. No text at all gives no rows.
    """
    spark = weighed.sparkSession
    width = dimensions + oversample
    omega = np.random.default_rng(seed).standard_normal((features, width))
    shared = spark.sparkContext.broadcast(omega)
    rows = written(weighed, "weights")

    def sums(batches):
        from pyspark import TaskContext

        yy, ya = np.zeros((width, width)), np.zeros((width, features))
        for batch in batches:
            for a in _matrices(batch, features):
                y = a @ shared.value
                yy += y.T @ y
                ya += y.T @ a
        if yy.any():
            lines = [zlib.compress(x.tobytes(), 1) for x in np.concatenate([yy, ya], axis=1)]
            task = np.full(width, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(task, pa.int32()), pa.array(lines, pa.binary())], names=["part", "source", "blob"])

    total = np.zeros((width, width + features))
    for line, values in summed(rows.mapInArrow(sums, "part int, source int, blob binary"), "float64", rows.rdd.getNumPartitions()).items():
        total[line] = values
    yy, ya = total[:, :width], total[:, width:]
    values, vectors = np.linalg.eigh(yy)
    good = values > max(values.max(), 0) * 1e-12
    b = (vectors[:, good] / np.sqrt(values[good])).T @ ya
    _, _, vt = np.linalg.svd(b, full_matrices=False)
    directions = spark.sparkContext.broadcast(vt[:dimensions].T.copy())

    def embed(batches):
        for batch in batches:
            out = [np.zeros((0, directions.value.shape[1]))]
            for a in _matrices(batch, features):
                e = a @ directions.value
                norm = np.linalg.norm(e, axis=1, keepdims=True)
                out.append(np.divide(e, norm, out=e, where=norm > 0))
            flat = np.concatenate(out)
            offsets = np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))], names=[key, "vector"])

    return written(rows.mapInArrow(embed, f"`{key}` {weighed.schema[key].dataType.simpleString()}, vector array<double>"), "vectors")
