"""Long exact spans shared between records: content-defined chunks by a gear rolling hash.

A cut point is where the gear hash of the last ``GEAR`` code points is least in some window of ``window`` positions, so it
depends on nearby text only and moves with it when text is inserted before. From every cut point goes a chunk of
``anchor`` code points; chunks are deduplicated by digest. With window + anchor + GEAR <= span + 1 every stretch of ``span``
code points that two records share holds a chunk cut in both, so the chunks whose digest occurs in two records
mark all places where a shared stretch can be. There, and only there, the digest of each ``span`` code points is
compared the same way, by 96 bits, which gives the stretches to the code point.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quireflow.plans.workspace import partitions_for, spread, written

SPAN = 200
WINDOW = 95
ANCHOR = 90
#: Code points a gear hash depends on: each step shifts it by 4 of 64 bits.
GEAR = 16
#: Code points hashed at once in a worker; a longer text is taken alone.
HASHED_AT_ONCE = 1 << 18

#: Digests that leave a worker together, so that it finds those of two keys among them itself.
RESOLVED_AT_ONCE = 1 << 18
#: Bytes of such a row in a shuffle.
_ROW_BYTES = 24

_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xD1342543DE82EF95


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _gears() -> np.ndarray:
    """A random number for each code point, by rule."""
    return _mixed((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


@functools.cache
def _powers(size: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
    np.multiply.accumulate(np.full(size - 1, base, np.uint64), out=up[1:])
    np.multiply.accumulate(np.full(size - 1, pow(base, -1, 1 << 64), np.uint64), out=down[1:])
    return up, down


class Hashed:
    """Code points of some texts laid end to end, with digests of any stretch."""

    def __init__(self, texts: list[str]):
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.sizes = np.array([len(p) for p in points], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.gear = _gears()[np.concatenate(points)] if points else np.zeros(0, np.uint64)
        size = len(self.gear)
        up, self.down = _powers(1 << max(HASHED_AT_ONCE + 1, size + 1).bit_length())
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(self.gear * up[:size], out=self.sums[1:])
        self._other: tuple[np.ndarray, np.ndarray] | None = None

    def digests(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[at + length] - self.sums[at]) * self.down[at]).view(np.int64)

    def checks(self, at: np.ndarray, length: int) -> np.ndarray:
        """32 further bits of a stretch, from sums of another base over other numbers of its code points."""
        if self._other is None:
            up, down = _powers(len(self.down), _OTHER)
            sums = np.zeros(len(self.gear) + 1, np.uint64)
            np.cumsum(_mixed(self.gear + np.uint64(1)) * up[: len(self.gear)], out=sums[1:])
            self._other = sums, down
        sums, down = self._other
        return (_mixed((sums[at + length] - sums[at]) * down[at]) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def _gear_hashes(self) -> np.ndarray:
        h = self.gear
        for step in (1, 2, 4, 8):
            shifted = np.zeros_like(h)
            shifted[step:] = h[:-step] << np.uint64(4 * step)
            h = h + shifted
        return _mixed(h)

    def cuts(self, window: int) -> np.ndarray:
        """Ends of the positions whose gear hash is least in some window. Windows that reach over a text's end only
        add cuts; of equal hashes each is a cut."""
        h = self._gear_hashes()
        if len(h) < window:
            return np.zeros(0, np.int64)
        pad = np.zeros(window - 1, np.uint64)
        least = np.concatenate([pad, _sliding(h, window, np.minimum), pad])  # of each window, by its first position
        return np.flatnonzero(_sliding(least, window, np.maximum) == h) + 1

    def cut_of(self, window: int) -> np.ndarray:
        """A cut of each window, by the window's first position."""
        low = np.uint64((1 << max(7, window.bit_length())) - 1)  # the low bits hold any place of a window
        place = np.arange(len(self.gear), dtype=np.uint64) & low
        least = _sliding((self._gear_hashes() & ~low) | place, window, np.minimum) & low
        first = np.arange(len(least))
        return first + ((least.astype(np.int64) - first) & int(low)) + 1


def _sliding(x: np.ndarray, window: int, op: np.ufunc) -> np.ndarray:
    """``op`` over x[i : i + window] for each i, by doubling."""
    done, y = 1, x
    while done < window:
        step = min(done, window - done)
        y = op(y[:-step], y[step:])
        done += step
    return y


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Indexes of texts, so that a group's code points stay under HASHED_AT_ONCE unless one text alone is longer."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if t:
            if some and size + len(t) > HASHED_AT_ONCE:
                yield some
                some, size = [], 0
            some.append(i)
            size += len(t)
    if some:
        yield some


def _sorted(digest: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (digest, check), stable, and where in it a new one begins."""
    order = np.argsort(digest, kind="stable")
    for again in (True, False):
        d, c = digest[order], check[order]
        same, other = d[1:] == d[:-1], c[1:] != c[:-1]
        if again and (same & other).any():
            order = np.lexsort((check, digest))
            continue
        break
    return order, np.concatenate([[True], ~same | other])[: len(order)]


def _resolved(digest: np.ndarray, check: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows whose keys come together: which ones' (digest, check) another key has beside them, and the first and last
    row of each such group."""
    order, new = _sorted(digest, check)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    many = key[order[first]] != key[order[last]]
    known = np.zeros(len(order), bool)
    known[order] = np.repeat(many, last - first + 1)
    return known, order[np.concatenate([first[many], last[many]])]


def _shared(rows: DataFrame, size: float) -> DataFrame:
    """The rows (digest, chk, k, at, own) whose digest occurs under two keys.

    A worker has marked (own = k) the rows whose digest it met under two keys itself; of those only the first and last
    also stand for their digest (without ``at``) in the shuffle, as all rows met once do. So a digest of a third of all
    records costs its group a few rows a worker's portion, and its other rows are scattered.
    """
    group = Window.partitionBy("digest", "chk", "own")
    rows = rows.repartition(partitions_for(rows.sparkSession, size), "digest", "chk", "own")
    met = rows.withColumn("lo", F.min("k").over(group)).withColumn("hi", F.max("k").over(group))
    return met.where(F.col("at").isNotNull() & (F.col("own").isNotNull() | (F.col("lo") != F.col("hi")))).select("digest", "k", "at")


def shared_stretches(df: DataFrame, key: str, text: str, span: int = SPAN, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """key, first, length of each maximal stretch of a record whose every ``span`` code points occur in other records.

    Stretches of one record neither overlap nor touch. Positions count code points from 0. Repetition within a record
    alone is no sharing; null and short texts have none; copies of a text share all of it. ``key`` must be unique and
    integer; rows of a null key are dropped; an empty table gives no rows.
    """
    if window + anchor + GEAR > span + 1:
        raise ValueError("a shared stretch might hold no chunk cut in both records")
    source = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("text")).where(F.col(key).isNotNull() & (F.length("text") >= span))

    kind = "digest bigint, chk int, k bigint, at int, own bigint"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Portion()
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for some in _groups(texts):
                hashed = Hashed([texts[i] for i in some])
                cut = hashed.cuts(window)
                own = np.searchsorted(hashed.starts, cut, side="right") - 1
                inside = cut + anchor <= hashed.starts[own] + hashed.sizes[own]
                cut, own = cut[inside], own[inside]
                digest = hashed.digests(cut, anchor)
                first = _first_of(own, digest)
                none = np.zeros(len(first), np.int32)
                yield from out.add(digest[first], none, keys[np.array(some)[own[first]]], none)
        yield from out.end()

    spark = df.sparkSession
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    common = written(_shared(spread(source).mapInArrow(chunks, kind), _ROW_BYTES * size / ((window + 1) / 2)).select("digest", "k"), "chunks")
    flagged = common.groupBy("k").agg(F.collect_set("digest").alias("digests"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Portion()
        for batch in batches:
            keys, texts, held = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            for some in _groups(texts):
                hashed = Hashed([texts[i] for i in some])
                chunk = hashed.cut_of(window)
                for j, i in enumerate(some):
                    at = np.arange(hashed.starts[j], hashed.starts[j] + hashed.sizes[j] - span + 1)
                    # The first window wholly within the span has its cut there in both records, and the chunk fits.
                    at = at[np.isin(hashed.digests(chunk[at + GEAR - 1], anchor), held[i].values.to_numpy())]
                    if len(at):
                        yield from out.add(hashed.digests(at, span), hashed.checks(at, span), np.full(len(at), keys[i]), at - hashed.starts[j])
        yield from out.end()

    # Around a shared chunk lie about as many windows as there are positions from cut to cut.
    fine = _shared(source.join(flagged, "k").mapInArrow(windows, kind), _ROW_BYTES * common.count() * (window + 1) / 2)
    # The places of a record's shared digests, whose number its own length bounds, run together to stretches.
    order = Window.partitionBy("k").orderBy("at")
    run = F.when(F.col("at") <= F.lag("at").over(order) + span, 0).otherwise(1)
    runs = fine.select("k", "at").withColumn("new", run).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("k", "run").agg(F.min("at").alias("first"), (F.max("at") - F.min("at") + span).alias("length")).select(F.col("k").alias(key), "first", "length")


class _Portion:
    """Rows of a worker, gathered until there are enough to look for digests of two keys among them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, digest: np.ndarray, check: np.ndarray, key: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((digest, check, key, at))
        self.size += len(at)
        if self.size >= RESOLVED_AT_ONCE:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        digest, check, key, at = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        known, stand = _resolved(digest, check, key)
        own = pa.array(key, pa.int64(), mask=~known)
        yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(check), pa.array(key), pa.array(at.astype(np.int32)), own], names=_COLUMNS)
        if len(stand):
            none = [pa.nulls(len(stand), pa.int32()), pa.nulls(len(stand), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(digest[stand]), pa.array(check[stand]), pa.array(key[stand]), *none], names=_COLUMNS)


_COLUMNS = ["digest", "chk", "k", "at", "own"]


def _first_of(own: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Index of the first of each (own, digest), in order."""
    order = np.lexsort((digest, own))
    new = np.ones(len(order), bool)
    new[1:] = (own[order][1:] != own[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    return np.sort(order[new])
