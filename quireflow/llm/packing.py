"""Filling fixed-capacity containers: sum-of-squares packing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items packed by one task. Their keys' hashes choose the task, so a shard holds about as many whatever the sizes.
SHARD_ITEMS = 25_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item (0 < size <= capacity), largest items first, equal ones in order.

    Each item goes where the sum over gaps of the squared number of open containers with that gap becomes smallest;
    ties go to the container it fills most, a new one last.
    """
    out = np.empty(len(sizes), dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; full ones don't count
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        rest = capacity - size
        best, gap = (2 * int(count[rest]) + 1 if rest else 0), 0
        if size < capacity:
            have = count[size:capacity]
            change = 1 - 2 * have
            change[1:] += 2 * count[1:rest] + 1
            change[have == 0] = np.iinfo(np.int64).max
            at = int(np.argmin(change))
            if change[at] <= best:
                best, gap = change[at], size + at
        if gap:
            number = open_at[gap].pop()
            count[gap] -= 1
            rest = gap - size
        else:
            number = used
            used += 1
        if rest:
            open_at[rest].append(number)
            count[rest] += 1
        out[i] = number
    return out


def pack(df: DataFrame, key: str, size: str, n_items: int, capacity: int) -> DataFrame:
    """key, piece_no, first, length, container_id: an assignment of every item to containers of ``capacity``.

    Only an item above the capacity is divided: into whole containers and one rest, which is packed like an item.
    Items are packed in ``ceil(n_items / SHARD_ITEMS)`` shards by the hash of their key; sizes of 0 and null sizes or
    keys take no container; an empty table gives no rows. A key given twice is two items.
    """
    shards = max(1, math.ceil(n_items / SHARD_ITEMS))
    kind = df.schema[key].dataType.simpleString()

    def packed(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["k", "n"], kind="stable", ignore_index=True)
        full, rest = items["n"] // capacity, items["n"] % capacity
        pieces = (full + (rest > 0)).to_numpy()
        row = np.repeat(np.arange(len(items)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(items["n"].to_numpy()[row] - piece * capacity, capacity)
        number = sum_of_squares(length, capacity)
        shard = int(items["shard"].iloc[0])
        return pd.DataFrame({key: items["k"].to_numpy()[row], "piece_no": piece, "first": piece * capacity, "length": length, "container_id": (shard << 32) + number})

    held = df.where(F.col(key).isNotNull() & (F.col(size) > 0))
    sharded = held.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("n"), F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
    spread = sharded.repartition(max(shards, 1), "shard")  # by as many tasks as shards
    return spread.groupBy("shard").applyInPandas(packed, f"`{key}` {kind}, piece_no bigint, first bigint, length bigint, container_id bigint")
