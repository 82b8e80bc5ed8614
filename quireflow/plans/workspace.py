"""Where plans cut their lineage: written tables in the folder all executors share, kept tables, and sums in steps."""

from __future__ import annotations

import atexit
import gc
import hashlib
import math
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a task of a sized shuffle reads, whatever the size of the whole.
TASK_BYTES = 12 << 20
#: Tables that share a key are worked on in so many turns, where one has this many rows.
TURNS, MANY_ROWS = 6, 100_000
#: Arrays one group of a stepwise sum adds up.
SUM_FAN = 64

_written: list[str] = []
_hooked = False


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary one; any other
    has executors that could not read one machine's folder, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder all executors of {master} share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"quireflow-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(_remove, root)  # also what is kept goes with a folder made for one application
    return root.rstrip("/")


def _register(path: str) -> None:
    global _hooked
    _written.append(path)
    if not _hooked:
        atexit.register(_remove_all)
        _hooked = True


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _remove(path: str) -> None:
    if path.startswith("file:"):  # goes without a session, which has often ended by then
        shutil.rmtree(path.removeprefix("file:").replace("//", "", 1), ignore_errors=True)
        return
    spark = SparkSession.getActiveSession()
    if spark is not None:
        system, where = _file_system(spark, path)
        system.delete(where, True)


def remove(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def _remove_all() -> None:
    release(0)


def release(mark: int, keep: int = 0) -> None:
    """Removes the tables written since ``mark``, a value of ``written_so_far()``, but the last ``keep``."""
    while len(_written) > mark + keep:
        try:
            _remove(_written.pop(mark))
        except Exception:  # the JVM may already be gone
            return


def written_so_far() -> int:
    return len(_written)


@contextmanager
def released() -> Iterator[None]:
    """Tables written inside are removed at the end of the block; take results out before."""
    mark = written_so_far()
    try:
        yield
    finally:
        release(mark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once to the shared folder, so that a lost executor re-reads files and recomputes nothing.

    An empty ``df`` gives an empty table of the same columns. Tables are removed when the application ends, or before
    by ``released``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _register(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, paths: list[str], *settings: object) -> str:
    """Hex digest of the files of tables (name, size, time) and of settings: what a kept table depends on."""
    seen = []
    for path in paths:
        system, where = _file_system(spark, path)
        if system.getFileStatus(where).isDirectory():
            files = system.listFiles(where, True)
            while files.hasNext():
                s = files.next()
                seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        else:
            s = system.getFileStatus(where)
            seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr((sorted(seen), settings)).encode()).hexdigest()[:24]


def kept(spark: SparkSession, name: str, make: Callable[[str], None], root: str | None = None) -> str:
    """Path of what ``make`` writes, made once: later calls and sessions find it there. It is made aside and renamed, so
    nothing unfinished is ever found."""
    final = f"{(root or checkpoint_root(spark) + '/kept').rstrip('/')}/{name}"
    system, where = _file_system(spark, final)
    if not system.exists(where):
        aside = f"{final}-{uuid.uuid4().hex}"
        make(aside)
        _, made = _file_system(spark, aside)
        if not system.rename(made, where) and not system.exists(where):
            raise OSError(f"{final} could not be put in place")
        system.delete(made, True)
    return final


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least one partition per core; only inputs of fewer splits than cores are shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that are over, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_turns(sides: list[DataFrame], key: str, make: Callable[..., DataFrame], name: str) -> DataFrame:
    """``make(*sides)``, written. No row of it may depend on two values of ``key``: large tables are then taken in turns, by its
    hash, all rows in one or the other, and what a turn shuffled goes before the next."""
    turns, parts = TURNS if any(df.count() >= MANY_ROWS for df in sides) else 1, []
    for turn in range(turns):
        own = [df.where(F.pmod(F.xxhash64(key), F.lit(turns)) == turn) for df in sides] if turns > 1 else sides
        parts.append(written(make(*own), name))
        tidy(parts[0].sparkSession)
    return reduce(DataFrame.unionByName, parts)


def partitions_for(spark: SparkSession, size: float) -> int:
    """Partitions of a shuffle of ``size`` bytes, so that a task's share stays about the same at any total."""
    return max(shuffle_partitions(spark), math.ceil(size / TASK_BYTES))


def summed(arrays: DataFrame, dtype: str, sources: int) -> dict[int, np.ndarray]:
    """Sums by ``part`` of arrays (part int, source int, blob binary: zlib of ``dtype``), whose number of parts is fixed.

    ``source`` counts from 0 below ``sources`` (the map task). Sums go up in steps of ``SUM_FAN``, so no group holds more
    arrays than that, however many map tasks there were. What reaches the driver is one array a part.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(zlib.decompress(b), dtype) for b in rows["blob"]], axis=0).astype(dtype)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "source": rows["source"].iloc[:1], "blob": [zlib.compress(total.tobytes(), 1)]})

    while True:
        arrays = arrays.withColumn("source", F.floor(F.col("source") / SUM_FAN).cast("int")).groupBy("part", "source").applyInPandas(add, "part int, source int, blob binary")
        sources = -(-sources // SUM_FAN)
        if sources <= 1:
            break
    return {r["part"]: np.frombuffer(zlib.decompress(r["blob"]), dtype) for r in arrays.collect()}
