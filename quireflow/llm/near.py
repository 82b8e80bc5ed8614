"""Near-duplicate records: a prefix-tree join of globally ordered n-gram sets.

Sets are ordered rarest class first. Records whose ordered sets can overlap enough share enough adjacent pairs of that
order, the two-step paths of a prefix tree of the sets; the rarest of them are the keys under which records meet.
What meets often enough is joined exactly: for each record its partners' ordered sets form a prefix tree, which is
walked once, with partial overlaps shared along common prefixes and subtrees cut by the length that remains.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.plans.workspace import partitions_for, spread, summed, written

#: Counters of the frequency sketch: of fixed size, so its broadcast and its collection are bounded by a megabyte.
SKETCH_BITS = 20
_SKETCH_PARTS = 64
#: Tokens are 48-bit hashes of n-grams.
_TOKEN = np.uint64((1 << 48) - 1)
#: Sets smaller than this also meet under their single tokens; at low similarity, larger ones too.
SMALL = 8
#: Meetings of a pair that are asked for where its sets guarantee as many.
MEETINGS = 4
#: Up to so many records to be fetched are broadcast (8 bytes each); beyond, they are joined by a shuffle.
FETCHED_BY_BROADCAST = 200_000
#: A meeting key is split where its tokens' counters reach this class (2^13 sets) and eight times the mean counter, which
#: one in a fixed share of all sets does at any size.
HOT_CLASS = 13
#: Bytes of a meeting that the join reads, on both of its sides.
_MEETING_BYTES = 40

_WORD = re.compile(r"[^\W_]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words, kept for a worker's common words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[word] = value
        return value


_hashes = _WordHashes()


def ngram_set(text: str, words: int, least_words: int, space: str = "") -> np.ndarray | None:
    """Sorted distinct tokens of a text's runs of so many consecutive words; None if it has fewer than ``least_words``.
    Texts of different spaces have no token in common."""
    found = _WORD.findall(text.lower())
    if len(found) < max(words, least_words):
        return None
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = len(h) - words + 1
    out = h[:size]
    for i in range(1, words):
        out = _mixed(out) + h[i : size + i]
    return np.unique(_mixed(out + np.uint64(zlib.crc32(space.encode()))) & _TOKEN)


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def ngram_sets(df: DataFrame, words: int, least_words: int) -> DataFrame:
    """(space, id, set_id, n, tokens) of each row (space, id, text) with enough words. Equal sets have equal set_id, a
    64-bit hash of the tokens, which differ from space to space, so that sets of different spaces never meet."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[tuple] = []
            for space, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = ngram_set(text, words, least_words, space)
                if tokens is not None:
                    packed = _pack(tokens)
                    set_id = np.int64(np.uint64(xxhash.xxh64_intdigest(packed)))
                    rows.append((space, key, int(set_id), len(tokens), packed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()))],
                names=["space", "id", "set_id", "n", "tokens"],
            )

    held = df.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("space", "id", "text")
    return spread(held).mapInArrow(build, "space string, id string, set_id bigint, n int, tokens binary")


def _frequency_classes(sets: DataFrame) -> tuple[np.ndarray, int]:
    """log2 of each sketch counter, over all sets, one byte each; and the class from which a token is hot. Map tasks'
    counters are summed in steps."""
    size = 1 << SKETCH_BITS
    part = size // _SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(size, np.int64)
        for batch in batches:
            tokens = _unpack(b"".join(batch.column(0).to_pylist()))
            counts += np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if counts.any():
            blobs = [zlib.compress(counts[i * part : (i + 1) * part].tobytes(), 1) for i in range(_SKETCH_PARTS)]
            task = np.full(_SKETCH_PARTS, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_PARTS), pa.int32()), pa.array(task, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "source", "blob"])

    out = np.zeros(size, np.uint8)
    sums = summed(sets.select("tokens").mapInArrow(count, "part int, source int, blob binary"), "int64", sets.rdd.getNumPartitions())
    for i, total in sums.items():  # 64 arrays of 128 KB
        out[i * part : (i + 1) * part] = np.log2(total + 1)
    mean = sum(int(t.sum()) for t in sums.values()) / size
    return out, max(HOT_CLASS, math.ceil(math.log2(mean + 1)) + 3)


def _ordered(tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in global order, rarest class first, and its classes."""
    cls = classes[(tokens & np.uint64(len(classes) - 1)).astype(np.int64)]
    order = np.argsort(cls, kind="stable")  # tokens come sorted
    return tokens[order], cls[order]


def _lost(n: np.ndarray | int, similarity: float):
    """Most adjacent pairs of an ordered set of size n that are missing from a partner's: each own token the partner
    lacks breaks two, each token only the partner has breaks one; worst for the smallest partner."""
    return np.floor(2 * (1 - similarity) * n + 1e-9).astype(np.int64)


def _small(similarity: float) -> float:
    """Sets smaller than this also meet under their single tokens, for their pairs do not guarantee a meeting: similar
    sets of up to n tokens share n - 1 - 2(1 - t)n adjacent pairs or more, at least one from 2/(2t - 1) tokens on."""
    return max(SMALL, math.ceil(2 / (2 * similarity - 1))) if similarity > 0.5 else math.inf


def _kept(n: int, similarity: float) -> int:
    """How many of its rarest tokens the keys of a set of size n start from, at most."""
    return n if n < _small(similarity) / similarity + 1 else min(n, int(_lost(n, similarity)) + MEETINGS)


def _keys(tokens: np.ndarray, cls: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Meeting keys of an ordered set, each one's place in it, and the class of its rarer token."""
    n = len(tokens)
    keys, places, rarer = [], [], []
    if n >= _small(similarity):
        pairs = _mixed(_mixed(tokens[:-1]) + tokens[1:])
        keep = int(_lost(n, similarity)) + MEETINGS
        order = np.lexsort((pairs, cls[1:]))[:keep]
        keys.append(pairs[order])
        places.append(order)
        rarer.append(cls[order])
    if n < _small(similarity) / similarity + 1:
        keys.append(_mixed(tokens + np.uint64(1)))
        places.append(np.arange(n))
        rarer.append(cls)
    return np.concatenate(keys), np.concatenate(places), np.concatenate(rarer)


def _meetings(sets: DataFrame, classes: np.ndarray, similarity: float, hot_class: int, hot: bool) -> DataFrame:
    """(meet, set_id, n, place, shares): the keys under which a set meets others, either the hot ones or the rest.

    A key is hot where the tokens it is made of are: it cannot be in more sets than its rarer token. ``shares`` is into how
    many parts its sets are to be split."""
    shared, mask = sets.sparkSession.sparkContext.broadcast(classes), np.uint64(len(classes) - 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, sizes, places, shares = [], [], [], [], []
            for set_id, packed in zip(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                tokens = _unpack(packed)
                if hot and np.count_nonzero(shared.value[(tokens & mask).astype(np.int64)] >= hot_class) <= len(tokens) - _kept(len(tokens), similarity):
                    continue  # the keys it keeps are of rarer tokens
                tokens, cls = _ordered(tokens, shared.value)
                k, p, c = _keys(tokens, cls, similarity)
                chosen = (c >= hot_class) == hot
                k, p, c = k[chosen], p[chosen], c[chosen]
                keys.append(k)
                places.append(p)
                ids.append(np.full(len(k), set_id))
                sizes.append(np.full(len(k), len(tokens)))
                shares.append(1 << np.clip(c.astype(np.int32) - hot_class + 1, 0, 20))
            if keys:
                cat = np.concatenate
                columns = [pa.array(cat(keys).view(np.int64)), pa.array(cat(ids)), *(pa.array(cat(x).astype(np.int32)) for x in (sizes, places, shares))]
                yield pa.RecordBatch.from_arrays(columns if hot else columns[:4], names=["meet", "set_id", "n", "place", "shares"][: len(columns) if hot else 4])

    return sets.select("set_id", "tokens").mapInArrow(emit, "meet bigint, set_id bigint, n int, place int" + (", shares int" if hot else ""))


def walk(probe: np.ndarray, partners: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(partner, overlap) of the partners similar to the probe; all sets in the same global order.

    The partners form a prefix tree. An overlap counted down to a node holds for all sets below it; a subtree is cut
    when even a match of all that remains, of the probe or of the longest set below, cannot reach the overlap needed.
    """
    root: dict = {}
    for i, tokens in enumerate(partners):
        node = root
        for t in tokens.tolist():
            node = node.setdefault(t, {})
        node.setdefault(None, []).append(i)
    place = {t: i for i, t in enumerate(probe.tolist())}
    n = len(place)
    sizes = [len(p) for p in partners]
    least = min(sizes, default=0)
    # Fewest tokens a partner of the smallest size here must share.
    need = similarity / (1 + similarity) * (n + least) - 1e-9
    deepest = max(sizes, default=0)
    found: list[tuple[int, int]] = []
    stack = [(root, 0, 0, 0)]  # node, depth, overlap, first place of the probe that remains
    while stack:
        node, depth, overlap, at = stack.pop()
        for token, child in node.items():
            if token is None:
                for i in child:
                    if overlap >= similarity * (n + sizes[i] - overlap) - 1e-9:
                        found.append((i, overlap))
                continue
            match = place.get(token)
            now, rest = (overlap, at) if match is None else (overlap + 1, match + 1)
            if now + min(n - rest, deepest - depth - 1) >= need:
                stack.append((child, depth + 1, now, rest))
    return found


def _met(left: DataFrame, right: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """(a, b, n, m): a row for each key under which two sets meet whose sizes and places allow the similarity."""
    a, b = left.alias("a"), right.alias("b")
    n, m, i, j = F.col("a.n"), F.col("b.n"), F.col("a.place"), F.col("b.place")
    share = similarity / (1 + similarity)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    near = a.join(
        b,
        same
        & (F.col("a.set_id") < F.col("b.set_id"))
        & (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9)
        & (F.least(i, j) + F.least(n - i, m - j) >= share * (n + m) - 1e-9),
    )
    return near.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"), n.alias("n"), m.alias("m"))


def similar_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) with a < b: the pairs of distinct sets whose overlap is at least ``similarity`` of their union."""
    if similarity <= 0:
        raise ValueError("similarity must be above 0, as sets that share nothing do not meet")
    spark = sets.sparkSession
    classes, hot_class = _frequency_classes(sets)
    one = sets.groupBy("set_id").agg(F.first("tokens").alias("tokens"))  # copies collapse before the shuffle
    kept = F.when(F.col("n") >= _small(similarity), F.least(F.col("n") - 1, F.floor(2 * (1 - similarity) * F.col("n")) + MEETINGS)).otherwise(F.col("n"))
    size = _MEETING_BYTES * (sets.agg(F.sum(kept)).first()[0] or 0)
    meet = _meetings(one, classes, similarity, hot_class, False).repartition(partitions_for(spark, size), "meet")
    near = _met(meet, meet, ["meet"], similarity)
    if int(classes.max()) >= hot_class:
        # One side of a hot key's sets is parted, the other goes to each part, so its square is spread.
        hot = written(_meetings(sets, classes, similarity, hot_class, True).distinct(), "hot")
        parted = hot.withColumn("share", F.pmod(F.xxhash64("set_id"), F.col("shares")).cast("int"))
        copied = hot.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        near = near.unionByName(_met(parted, copied, ["meet", "share"], similarity))
    n, m = F.col("n"), F.col("m")
    size = F.greatest(n, m)
    sure = F.least(F.lit(MEETINGS), F.greatest(F.lit(1), size - 1 - F.floor(2 * (1 - similarity) * size + 1e-9).cast("int")))
    sure = F.when(F.least(n, m) < _small(similarity), 1).otherwise(sure)
    met = (
        near.select("a", "b", sure.alias("sure"))
        .groupBy("a", "b", "sure")
        .agg(F.count(F.lit(1)).alias("meetings"))
        .where(F.col("meetings") >= F.col("sure"))
        .select("a", "b")
    )
    pairs = written(met, "met")
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    if 2 * pairs.count() <= FETCHED_BY_BROADCAST:
        wanted = F.broadcast(wanted)
    fetched = sets.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    side = fetched.select(F.col("set_id").alias("b"), F.col("tokens"))
    partners = pairs.join(side, "b").select("a", "b", "tokens")
    probes = fetched.join(pairs.select(F.col("a").alias("set_id")).distinct(), "set_id", "left_semi").select(F.col("set_id").alias("a"), F.lit(None).cast("bigint").alias("b"), "tokens")
    shared = spark.sparkContext.broadcast(classes)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        own, probe, held = None, None, []

        def end() -> None:
            if held:
                out.extend((own, held[k][0]) for k, _ in walk(probe, [t for _, t in held], similarity))
                held.clear()

        for batch in batches:
            for a, b, packed in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = _ordered(_unpack(packed), shared.value)[0]
                if b is None:
                    end()
                    own, probe = a, tokens
                else:
                    held.append((b, tokens))
                    if len(held) >= 1_000:  # a tree of so many; the rest get another
                        end()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
            out.clear()
        end()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    together = probes.unionByName(partners).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return together.mapInArrow(join, "a bigint, b bigint")


def classes_of(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, class) of each node of ``pairs`` (a, b): the least node it is linked to over any number of links.

    Every round links each node's larger neighbours, and itself, to its least neighbour, alternately over all and over
    smaller neighbours only, until nothing changes; each round is a written table. Rounds grow with the logarithm of a
    class's length, and a node's neighbours are only aggregated, never collected.
    """
    edges = written(pairs.where("a <> b").select("a", "b").distinct(), "links")
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        edges = written(large.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "links")
        least = edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("m"))
        small = edges.join(least, edges["b"] == least["x"]).select(F.col("a").alias("x"), "m")
        edges = written(small.unionByName(least).where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("the classes did not settle")
    roots = edges.select(F.col("a").alias("node")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("class")).unionByName(roots.select("node", F.col("node").alias("class")))


def _sets(df: DataFrame, words: int, least_words: int) -> DataFrame:
    return written(ngram_sets(df, words, least_words), "sets")


def near_pairs(df: DataFrame, words: int, similarity: float, least_words: int) -> DataFrame:
    """space, id_a, id_b (id_a < id_b) of all similar records of one space, from rows space, id, text.

    The similarity of two records is the share of their sets' union that both hold, of the sets of their runs of
    ``words`` consecutive words. Records under ``least_words`` words, null texts and null ids have no pairs; a row given
    twice counts once, but an id with several texts has the pairs of each; other columns are not read.
    """
    sets = _sets(df, words, least_words)
    members = sets.select("space", "id", "set_id").distinct()
    links = written(similar_sets(sets, similarity), "pairs")
    # Only sets of several members or with a partner are joined on.
    inner = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))
    left = members.select("space", F.col("set_id").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("set_id").alias("b"), F.col("id").alias("y"))
    pairs = links.unionByName(inner).join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    return pairs.select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_classes(df: DataFrame, words: int = 5, similarity: float = 0.8, least_words: int = 5) -> DataFrame:
    """space, id, class_id, n_links of every record with enough words, from rows space, id, text.

    Records of one class say nearly the same over any number of steps; class_id is the least id of the class. n_links
    counts the distinct other sets a record's set is similar to: copies are members of one set, not links.
    """
    sets = _sets(df, words, least_words)
    members = written(sets.select("space", "id", "set_id").distinct(), "members")
    links = written(similar_sets(sets, similarity), "pairs")
    labels = classes_of(links).select(F.col("node").alias("set_id"), F.col("class").alias("label"))
    ends = links.select(F.col("a").alias("set_id")).unionAll(links.select("b"))
    degree = ends.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    found = members.join(labels, "set_id", "left").join(degree, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    names = found.groupBy("label").agg(F.min("id").alias("class_id"))
    return found.join(names, "label").select("space", "id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
