"""Problem 6: the corpus in ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quireflow.llm import bpe
from quireflow.plans.workspace import spread
from quireflow.sources.tables import table

#: Texts encoded before their ids leave the worker.
TEXTS_AT_ONCE = 200


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """``key`` and ``ids`` of every row, by the tokenizer without special tokens; a null or empty text has no ids.

    One pass without a shuffle (inputs of fewer splits than cores are spread first). The special tokens' strings are
    ordinary text. Repeated rows stay repeated; an empty table gives no rows; other columns are not read.
    """
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.text_encoder(tokenizer, folder)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                lists = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(encode, schema)


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """``key`` and ``n_tokens`` of every row whose text is neither null nor only white space."""
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.text_encoder(tokenizer, folder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            held = [i for i, t in enumerate(texts) if t and not t.isspace()]
            counts = pa.array([encoder.count(texts[i]) for i in held], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held, pa.int64())), counts], names=[key, "n_tokens"])

    return spread(df.select(key, text)).mapInArrow(count, schema)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"), "doc_id", "text")


def decoded(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """``key`` and ``text`` of every row of ids: the tokens' bytes end to end, read as UTF-8."""
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.text_encoder(tokenizer, folder).tokens()
        for batch in batches:
            texts = [b"".join(tokens[i] for i in x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(decode, schema)


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts once more, from their ids."""
    return decoded(p6_ids(spark, folder), "doc_id", "ids")


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
SQL = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
