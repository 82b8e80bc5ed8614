"""Files in and out: manifests, parser output, JSON lines, curated rows, assets, and versioned index tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = ["doc_id", "brand", "model", "year", "region", "language", "manual_type"]
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in (*META, "source_url", "downloaded_at", "local_filename")])
INDEX_VERSION = 1
#: A file keeps the distinct values of a column once, as ids that many rows repeat: up to so many bytes, decided by its first page.
_DICTIONARY = {"parquet.dictionary.page.size": 16 << 20, "parquet.page.row.count.limit": 1 << 17}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV, with or without a byte order mark. Missing columns, empty or duplicate documents, bad ids, URLs and
    times are errors that name the first case."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = [c for c in MANIFEST.names if c not in raw.columns]
    if missing:
        raise ValueError(f"manifest lacks columns {missing}")
    df = raw.select(*[F.btrim(c).alias(c) for c in MANIFEST.names])
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rules = {f"{c} is blank": text(c) for c in MANIFEST.names[:-1]}
    rules |= {
        "doc_id is malformed": F.col("doc_id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"),
        "source_url is no http(s) address": F.col("source_url").rlike("^https?://"),
        "downloaded_at is no time": F.try_to_timestamp("downloaded_at").isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))
    bad = df.select("doc_id", broken.alias("b")).where(F.size("b") > 0).first()
    if bad:
        raise ValueError(f"manifest row {bad['doc_id']}: {bad['b'][0]}")
    twice = df.groupBy("doc_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"manifest has {twice['doc_id']} {twice['count']} times")
    if df.isEmpty():
        raise ValueError("manifest is empty")
    return df


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """source_file, source_index and item (JSON text) of parser output: files that each hold one JSON array."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_content_list.json").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("source_file"), F.from_json("value", "array<string>").alias("items"))
    return rows.select("source_file", F.posexplode("items").alias("source_index", "item"))


def only_content_list(spark: SparkSession, path: str, doc_id: str) -> str:
    """The one content list of a document below a folder: in a folder of its name or so named itself, first where parsers put
    it; a document whose id another's begins with is another. None or several are an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_content_list.json").load(path).select("path")
    own = re.escape(doc_id)
    names = [r["path"] for r in found.where(F.col("path").rlike(f"/{own}/") | F.col("path").rlike(f"/{own}_content_list[.]json$")).take(1_000)]
    preferred = [n for n in names if n.endswith(f"/{doc_id}/auto/{doc_id}_content_list.json")]
    names = preferred or names
    if len(names) != 1:
        raise ValueError(f"{doc_id}: {'no' if not names else 'more than one'} content list")
    return names[0]


def parser_versions(spark: SparkSession, path: str, field: str) -> DataFrame:
    """doc_id and version of parsed documents below a folder, from the marker file of success in each one's folder; null where it
    cannot be read, lacks the field or has it blank."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*/_SUCCESS.json")
    system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for status in system.globStatus(pattern):  # one a document; readers of tables leave such names out
        stream = system.open(status.getPath())
        try:
            value = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).get(field)
        except (ValueError, AttributeError):
            value = None
        finally:
            stream.close()
        rows.append((status.getPath().getParent().getName(), str(value).strip() or None if value is not None else None))
    return spark.createDataFrame(rows, "doc_id string, version string")


def relative_paths(value: Any, root: str) -> Any:
    """A nested value with the texts that are paths below the root made relative; others stay. Keys are kept."""
    top = root.rstrip("/") + "/"
    if isinstance(value, str):
        return value.removeprefix(top) if value.startswith(top) else value
    if isinstance(value, Mapping):
        return {k: relative_paths(v, root) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [relative_paths(v, root) for v in value]
    return value


ITEM = "type string, text string, text_level int, page_idx int, bbox array<double>, img_path string, content string, html string, table_body string"


def native_items(rows: DataFrame) -> DataFrame:
    """Items with their fields; ones that are no objects have null fields and stay, to be counted."""
    return rows.withColumn("f", F.from_json("item", ITEM)).select("source_file", "source_index", "item", "f.*")


def flatten_text(column: str) -> Column:
    """Text of nested JSON: strings as they are; of maps the preferred keys, else all values; of lists all items."""
    preferred = ("text", "content", "caption", "title_content", "paragraph_content")  # fixed values

    def walk(value: Any) -> list[str]:
        if isinstance(value, str):
            return [value.strip()] if value.strip() else []
        if isinstance(value, Mapping):
            keys = [k for k in preferred if k in value] or list(value)
            return [t for k in keys for t in walk(value[k])]
        if isinstance(value, list):
            return [t for v in value for t in walk(v)]
        return []

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                return walk(json.loads(t)) if t else []
            except ValueError:
                return walk(t)

        return texts.map(one)

    return run(column)


def _line_of(spark: SparkSession, path: str, value: str) -> int:
    """The number of a line in its file, for an error's text."""
    numbered = spark.sparkContext.textFile(path, 1).zipWithIndex().filter(lambda x: x[0] == value)
    found = numbered.take(1)
    return found[0][1] + 1 if found else 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; blank lines are skipped. Strict reading fails with the first line that is no record."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    raw = spark.read.text(path)
    read = F.from_json("value", full, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    lines = raw.where(F.btrim("value") != "").select(F.col("_metadata.file_path").alias("_file"), "value", read.alias("r"))
    if strict:
        bad = lines.where(F.col("r").isNull() | F.col("r._broken").isNotNull()).first()
        if bad:
            raise ValueError(f"{bad['_file']}:{_line_of(spark, bad['_file'], bad['value'])}: no record in {bad['value']!r}")
    return lines.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def write_jsonl(df: DataFrame, path: str) -> None:
    """Compact records with sorted keys, nulls kept; the committer publishes them at once."""
    ordered = df.select(*sorted(df.columns))
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)


CURATED = T.StructType(
    [
        T.StructField("row_id", T.StringType()), T.StructField("element_id", T.StringType()), *[T.StructField(c, T.StringType()) for c in META],
        T.StructField("page_no", T.IntegerType()), T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("cells", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("asset_path", T.StringType()), T.StructField("asset_sha256", T.StringType()),
        T.StructField("transcription_method", T.StringType()), T.StructField("verified_at", T.StringType()),
    ]
)


def read_curated_rows(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Curated table rows, cells as header and value in their order; with ``root`` the assets' SHA-256 must agree.

    Under two cells, a malformed digest, a path that leaves the root, a repeated row id or another digest are errors.
    """
    rows = read_jsonl(spark, path, CURATED)
    keys = F.json_object_keys("cells")
    values = F.from_json("cells", "map<string,string>")
    rows = rows.withColumn("cells", F.transform(keys, lambda k: F.struct(k.alias("header"), F.try_element_at(values, k).alias("value"))))
    fine = (F.size("cells") >= 2) & F.col("asset_sha256").rlike("^[0-9a-f]{64}$") & ~F.col("asset_path").rlike(r"(^/|(^|/)\.\.(/|$))")
    bad = rows.where(~F.coalesce(fine, F.lit(False))).first()
    if bad:
        raise ValueError(f"curated row {bad['row_id']} is malformed")
    twice = rows.groupBy("row_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"curated row {twice['row_id']} comes {twice['count']} times")
    if root:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("sha"))
        wrong = rows.join(files, F.endswith(files["path"], F.concat(F.lit("/"), rows["asset_path"])) & (files["sha"] == rows["asset_sha256"]), "left_anti").first()
        if wrong:
            raise ValueError(f"curated row {wrong['row_id']}: the asset is missing or another")
    return rows


def relative_path(path: Column, root: str) -> Column:
    """Paths below the root made relative; others stay."""
    return F.regexp_replace(path, f"^{re.escape(root.rstrip('/'))}/", "")


def write_index(tables: Mapping[str, DataFrame | Callable[[], DataFrame]], path: str, kind: str) -> None:
    """Tables of an index in one folder, and last its description, without which nothing opens it. The first is a table; one that
    is made from those before it is given as a function."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df = df() if callable(df) else df
        df.write.mode("overwrite").options(**_DICTIONARY).parquet(f"{path}/{name}")
        stored = spark.read.parquet(f"{path}/{name}")
        total = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)")).cast("string").alias("s")).first()
        rows.append((kind, INDEX_VERSION, name, total["n"], total["s"]))
    spark.createDataFrame(rows, "kind string, version int, name string, n_rows bigint, checksum string").coalesce(1).write.mode("overwrite").json(f"{path}/_index_meta")


def payload_digest(df: DataFrame, order: list[str]) -> str:
    """SHA-256 of the rows' compact JSON texts, in order, a line feed after each; rows stream through the driver one at a time."""
    import hashlib

    digest = hashlib.sha256()
    lines = df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("j"))
    for row in lines.toLocalIterator():
        digest.update(row["j"].encode() + b"\n")
    return digest.hexdigest()


def open_index(spark: SparkSession, path: str, kind: str, verify: bool = False) -> dict[str, DataFrame]:
    """An index's tables. Another kind or version is an error; verifying counts rows and checksums again."""
    meta = spark.read.schema("kind string, version int, name string, n_rows bigint, checksum string").json(f"{path}/_index_meta").collect()
    if not meta or any(m["kind"] != kind or m["version"] != INDEX_VERSION for m in meta):
        raise ValueError(f"{path} is no {kind} index of version {INDEX_VERSION}")
    out = {m["name"]: spark.read.parquet(f"{path}/{m['name']}") for m in meta}
    for m in meta if verify else ():
        df = out[m["name"]]
        got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("s")).first()
        if (got["n"], got["s"]) != (m["n_rows"], m["checksum"]):
            raise ValueError(f"{path}/{m['name']} does not agree with its description")
    return out
