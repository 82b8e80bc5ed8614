"""Splitting oversized texts at natural boundaries by lexical cohesion.

Between the words before and after each line or sentence boundary the cosine similarity is taken; how deep it lies
below the peaks on either side is the boundary's depth. Each piece ends at the deepest boundary within its size
window and the next one starts 80 to 160 characters earlier.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.plans.workspace import spread, written
from quireflow.sources.tables import first_arrivals

LIMIT = 1_200
OVERLAP = (80, 160)
#: Words on either side of a boundary that are compared.
BLOCK = 40
#: A piece is cut no earlier than at this share of the limit, unless no boundary lies later.
FILL = 0.5
#: Up to so many element ids are broadcast (below 100 bytes each); beyond, they are joined by a shuffle.
IDS_BY_BROADCAST = 50_000

BLANK = " \t\r\n"
_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"[.!?…]+[)\]\"'»”’]*\s+|[。！？]+[」』”]*\s*")
_SPACE = re.compile(r"\s+")


def _similarity(left: list[str], right: list[str]) -> float:
    a, b = Counter(left), Counter(right)
    dot = sum(n * b[w] for w, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def depths(text: str, boundaries: list[int]) -> list[float]:
    """How deep a valley of block similarity each boundary is."""
    found = [(m.start(), m[0]) for m in _WORD.finditer(text.lower())] if len(text.lower()) == len(text) else [(m.start(), m[0].lower()) for m in _WORD.finditer(text)]
    starts, words = [s for s, _ in found], [w for _, w in found]
    sims = []
    for b in boundaries:
        i = bisect.bisect_left(starts, b)
        sims.append(_similarity(words[max(0, i - BLOCK) : i], words[i : i + BLOCK]))
    left, right = sims[:], sims[:]  # the peak one climbs to without going down
    for i in range(1, len(sims)):
        if left[i - 1] >= sims[i]:
            left[i] = left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if right[i + 1] >= sims[i]:
            right[i] = right[i + 1]
    return [a + c - 2 * s for a, s, c in zip(left, sims, right)]


def _within(places: list[int], low: int, high: int) -> range:
    return range(bisect.bisect_left(places, low), bisect.bisect_right(places, high))


def split(text: str, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, cut, end) of the pieces of a text: a piece is text[start:end], and text[start:cut] repeats the one before.

    What follows the cuts, end to end, is the text without blanks at its ends. A text within the limit is one piece, a
    blank one none.
    """
    if limit <= overlap[1]:
        raise ValueError("limit must exceed the overlap")
    first = len(text) - len(text.lstrip(BLANK))
    last = len(text.rstrip(BLANK))
    if first >= last:
        return []
    if last - first <= limit:
        return [(first, first, last)]
    natural = sorted({m.end() for p in (_LINE, _SENTENCE) for m in p.finditer(text, first, last)})
    depth = depths(text, natural)
    spaces = [m.end() for m in _SPACE.finditer(text, first, last)]
    out, start, cut = [], first, first
    while last - start > limit:
        # No cut lies nearer to the start than the overlap, so the next piece never starts before this one.
        least, high = max(cut + 1, start + overlap[1]), start + limit
        some = _within(natural, max(least, start + int(limit * FILL)), high) or _within(natural, least, high)
        if some:
            end = natural[max(some, key=lambda i: (depth[i], i))]
        else:
            words = _within(spaces, least, high)
            end = spaces[words[-1]] if words else high
        out.append((start, cut, end))
        cut = end
        places = next((p for p in (natural, spaces) if _within(p, cut - overlap[1], cut - overlap[0])), None)
        start = places[_within(places, cut - overlap[1], cut - overlap[0])[0]] if places else cut - overlap[1]
    out.append((start, cut, last))
    return out


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """key, piece_no (from 1), first, cut, last, piece of every row whose text is not blank; positions are code points.

    Only texts that may exceed the limit leave the JVM. Rows of one key must hold one text; rows with a null key or
    text, and blank texts, give no piece; an empty table gives none.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece_no int, first int, cut int, last int, piece string"
    bare = F.btrim(F.col(text), F.lit(BLANK))
    held = df.where(F.col(key).isNotNull() & (F.length(bare) > 0))
    # Where the trimmed text starts: code points of the blanks taken off the left.
    at = F.length(text) - F.length(F.ltrim(F.col(text), F.lit(BLANK)))
    end = at + F.length(bare)
    small = held.where(F.length(bare) <= limit).select(
        key, F.lit(1).alias("piece_no"), at.alias("first"), at.alias("cut"), end.alias("last"), bare.alias("piece")
    )

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, (a, c, z) in enumerate(split(t, limit), 1):
                    keys.append(i)
                    rows.append((n, a, c, z, t[a:z]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            arrays = [pa.array(c, pa.int32()) for c in columns[:4]] + [pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *arrays], names=[key, "piece_no", "first", "cut", "last", "piece"])

    large = held.where(F.length(bare) > limit).select(key, text).mapInArrow(cut_all, schema)
    return small.unionByName(large)


def locate(text: str, parts: list[tuple[str, str | None]]) -> list[tuple[int, int]]:
    """Where each part (id, content) lies in the text: found in order; one that is not there as it stands, for it was
    edited or its record is missing, takes the gap that the found ones around it leave."""
    spans: list[tuple[int, int] | None] = []
    at = 0
    for _, content in parts:
        content = (content or "").strip()
        i = text.find(content, at) if content else -1
        spans.append((i, i + len(content)) if i >= 0 else None)
        at = i + len(content) if i >= 0 else at
    out, before = [], 0
    for i, span in enumerate(spans):
        if span is None:
            after = next((s[0] for s in spans[i + 1 :] if s), len(text))
            out.append((before, after))
        else:
            out.append(span)
            before = span[1]
    return out


def pieces_with_sources(chunks: DataFrame, elements: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_id, piece_no, first, cut, last, piece, element_ids, page_nos of every chunk's pieces.

    A piece has the ids of the elements whose text it holds, in the chunk's order, and their pages. A null list is an
    empty one; blank and repeated ids are dropped, ids of missing elements stay with the text no other element explains; a piece
    none of whose elements has a page takes the chunk's pages.
    """
    one = first_arrivals(chunks, "chunk_id", ["content", "element_ids", "page_nos"])
    bare = F.length(F.btrim("content", F.lit(BLANK)))
    ids = F.array_distinct(F.filter(F.coalesce("element_ids", F.array().cast("array<string>")), lambda i: F.length(F.trim(i)) > 0))
    one = one.withColumn("element_ids", ids).withColumn("page_nos", F.coalesce("page_nos", F.array().cast("array<int>")))
    small = pieces(one.where(bare <= limit), "chunk_id", "content", limit).join(one.select("chunk_id", "element_ids", "page_nos"), "chunk_id")
    large = written(spread(one.where(bare > limit)), "large")
    wanted = large.select(F.explode("element_ids").alias("element_id")).distinct()
    narrow = elements.select("element_id", "content", "page_no", "ingested_at")
    few = large.agg(F.coalesce(F.sum(F.size("element_ids")), F.lit(0))).first()[0] <= IDS_BY_BROADCAST
    sources = first_arrivals(narrow.join(F.broadcast(wanted) if few else wanted, "element_id", "left_semi"), "element_id", ["content", "page_no"])
    placed = large.select("chunk_id", F.posexplode("element_ids").alias("place", "element_id")).join(sources, "element_id", "left")
    gathered = placed.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("place", "element_id", "content", "page_no"))).alias("parts"))
    rows = large.select("chunk_id", "content", "page_nos").join(gathered, "chunk_id", "left")

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk_id", "piece_no", "first", "cut", "last", "piece", "element_ids", "page_nos"]
        kinds = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
        for batch in batches:
            out = []
            for key, text, pages, parts in zip(*(c.to_pylist() for c in batch.columns)):
                parts = parts or []
                spans = locate(text, [(p["element_id"], p["content"]) for p in parts])
                for n, (a, c, z) in enumerate(split(text, limit), 1):
                    own = [p for p, (x, y) in zip(parts, spans) if x < z and y > a]
                    known = sorted({p["page_no"] for p in own if p["page_no"] is not None})
                    out.append((key, n, a, c, z, text[a:z], [p["element_id"] for p in own], known or pages))
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    cut = rows.mapInArrow(cut_all, "chunk_id string, piece_no int, first int, cut int, last int, piece string, element_ids array<string>, page_nos array<int>")
    return small.select(*cut.columns).unionByName(cut)
