"""The records that match queries best by summed term values, many queries at once: pairs of query and record never leave their task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.plans.workspace import shuffle_partitions

#: Postings of a block and queries of a share that meet in one task, at most about; small inputs go to up to ``LEAST`` blocks.
POSTINGS, QUERIES = 1 << 22, 1 << 17
LEAST, SMALL = 8, 1 << 18


def blocks_of(postings: int) -> int:
    return max(-(-postings // POSTINGS), min(LEAST, -(-postings // SMALL)), 1)


def best_matches(queries: DataFrame, postings: DataFrame, key: str, limit: int, sizes: int | DataFrame, within: str | None = None, pruned: bool = False) -> DataFrame:
    """query_id, key, _s: at least the ``limit`` records of greatest sum of each query, ties to the smaller key.

    queries: query_id, terms (distinct), ``within``; postings: key, term, value (bigint, not negative), ``within``, a row a record and
    term. ``sizes``: how many postings there are about, or of each value of ``within``. Records lie in blocks by the hash of
    their key, queries in shares; a share meets a block in one task, which adds up values record by record and gives on the
    best only. So what is shuffled are postings, queries and results, never the pairs, which grow as their product.
    ``pruned`` leaves records out that only common terms lead to and that cannot be among the best.
    """
    number = F.lit(blocks_of(sizes)) if within is None else F.greatest(F.ceil(F.col("n") / POSTINGS), F.lit(1)).cast("int")
    if within is None:
        by = ["_block", "_share"]
        shares = F.lit(max(1, -(-queries.count() // QUERIES)))
        left, right = queries.withColumns({"_blocks": number, "_shares": shares}), postings.withColumns({"_blocks": number, "_shares": shares})
    else:
        by = [within, "_block", "_share"]
        share = F.greatest(F.ceil(F.col("_q") / QUERIES), F.lit(1)).cast("int")
        counted = queries.groupBy(within).agg(F.count(F.lit(1)).alias("_q"))
        lay = F.broadcast(sizes.join(counted, within).select(within, number.alias("_blocks"), share.alias("_shares")))  # a row a manual
        left, right = queries.join(lay, within), postings.join(lay, within)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = left.withColumn("_share", of("query_id", "_shares")).select("query_id", "terms", *by[:-2], "_share", spread("_blocks").alias("_block"))
    right = right.withColumn("_block", of(key, "_blocks")).select(key, "term", "value", *by[:-2], "_block", spread("_shares").alias("_share"))
    kinds = [queries.schema["query_id"].dataType.simpleString(), postings.schema[key].dataType.simpleString()]

    def meet(asked: pa.Table, posted: pa.Table) -> pa.Table:
        return _best(asked, posted, key, limit, pruned)

    n = shuffle_partitions(queries.sparkSession)
    n = n if within else max(n, 2 * blocks_of(sizes))
    sides = [df.repartition(n, *by).groupBy(*by) for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(meet, f"query_id {kinds[0]}, `{key}` {kinds[1]}, _s bigint")


def _best(asked: pa.Table, posted: pa.Table, key: str, limit: int, pruned: bool) -> pa.Table:
    """``best_matches`` of one share and block."""
    kinds = [asked.schema.field("query_id").type, posted.schema.field(key).type]
    empty = pa.table([pa.array([], kinds[0]), pa.array([], kinds[1]), pa.array([], pa.int64())], names=["query_id", key, "_s"])
    if not asked.num_rows or not posted.num_rows:
        return empty
    coded = lambda c: (d := c.combine_chunks().dictionary_encode(), d.indices.to_numpy(zero_copy_only=False), d.dictionary)[1:]
    at, keys = coded(posted[key])
    held = keys.to_numpy(zero_copy_only=False)
    order = np.argsort(held, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    keys = keys.take(pa.array(order))  # ascending, so the lower place is the smaller key
    term, words = coded(posted["term"])
    by_term = np.argsort(term, kind="stable")
    at, value = place[at[by_term]], posted["value"].combine_chunks().to_numpy(zero_copy_only=False)[by_term]
    cuts = np.searchsorted(term[by_term], np.arange(len(words) + 1))
    tops = np.maximum.reduceat(value, cuts[:-1])
    known = {w: i for i, w in enumerate(words.to_pylist())}
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, terms in enumerate(asked["terms"].to_pylist()):  # the same terms are scored once
        if own := [known[t] for t in terms if t in known]:
            groups.setdefault(tuple(sorted(own, key=lambda t: (-tops[t], t))), []).append(i)
    sums = np.zeros(len(order), np.int64)
    rows, places, found = [], [], []
    for terms, askers in groups.items():
        best, score = _scored(sums, [(at[cuts[t] : cuts[t + 1]], value[cuts[t] : cuts[t + 1]], int(tops[t])) for t in terms], limit, pruned)
        rows.append(np.repeat(askers, len(best)))
        places.append(np.tile(best, len(askers)))
        found.append(np.tile(score, len(askers)))
    if not rows:
        return empty
    return pa.table([asked["query_id"].take(pa.array(np.concatenate(rows))), keys.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(found))], names=["query_id", key, "_s"])


def _scored(sums: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray, int]], limit: int, pruned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of the best records of one query: terms (places, values, greatest value), the strongest first. ``sums`` is
    all zero before and after."""
    floor, rest = 0, sum(t[2] for t in terms)
    for i, (at, value, top) in enumerate(terms):
        sums[at] += value
        rest -= top
        if len(at) >= limit and (pruned or i == 0):  # so many have at least this, whatever the other terms add
            floor = max(floor, int(np.partition(sums[at], -limit)[-limit]))
        if pruned and rest < floor and i + 1 < len(terms):  # the other terms cannot lift a record by themselves
            seen = np.flatnonzero(sums >= floor - rest)
            more = sums[seen]
            for places, values, _ in terms[i + 1 :]:
                where, there = _common(seen, places)
                more[where] += values[there]
            for places, _, _ in terms[: i + 1]:
                sums[places] = 0
            return _top(seen, more, limit)
    if floor <= 0:
        for at, _, _ in terms:
            if len(at) >= limit:
                floor = max(floor, int(np.partition(sums[at], -limit)[-limit]))
    seen = np.flatnonzero(sums >= floor) if floor > 0 else np.unique(np.concatenate([t[0] for t in terms]))
    score = sums[seen]
    sums[:] = 0
    return _top(seen, score, limit)


def _common(seen: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values of ``seen``, ascending, are in ``places``, in any order: their indexes in both."""
    _, a, b = np.intersect1d(seen, places, assume_unique=True, return_indices=True)
    return a, b


def _top(places: np.ndarray, score: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    if len(places) > limit:
        fine = score >= np.partition(score, -limit)[-limit]
        places, score = places[fine], score[fine]
    order = np.argsort(-score, kind="stable")[:limit]
    return places[order].astype(np.int64), score[order]
