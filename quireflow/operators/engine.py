"""One object that answers single questions: filters resolved to one manual, search, answers, agentic workflow, health."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import agentic, answering, bm25, fusion, generation, graph, presenters, visual
from quireflow.operators import graph_queries as GQ
from quireflow.operators import ingest_queries as IQ
from quireflow.operators import retrieval_queries as R
from quireflow.plans.workspace import checkpoint_root, fingerprint, kept
from quireflow.sources.tables import table

FILTER_FIELDS = frozenset({*R.META, "chunk_type"})
# Largest results, evidence and image.
MAX_LIMIT, MAX_GRAPH_LIMIT, MAX_EVIDENCE, MAX_IMAGE = 100, 50, 10, 12 * 1024 * 1024
#: Manuals an engine holds to resolve filters by; beyond, it asks the table.
MANUALS = 10_000
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp")


def checked_limit(value: Any, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"limit must be an integer from 1 to {most}")
    return value


def checked_filters(filters: Mapping[str, str] | None) -> dict[str, str]:
    """Filters without blank ones, trimmed; unknown fields are an error."""
    unknown = set(filters or {}) - FILTER_FIELDS
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    return {k: v.strip() for k, v in (filters or {}).items() if v and v.strip()}


def decode_image(payload: str) -> tuple[str, bytes]:
    """Suffix and bytes of an image sent as base64, bare or as a data URL; malformed, empty or too large is an error."""
    m = re.fullmatch(r"data:image/([a-z]+);base64,(.*)", payload.strip(), re.S)
    suffix, body = (m[1], m[2]) if m else ("png", payload.strip())
    if suffix not in IMAGE_SUFFIXES:
        raise ValueError(f"images of type {suffix} are not read")
    try:
        data = base64.b64decode(body, validate=True)
    except binascii.Error as e:
        raise ValueError("the image is no base64 text") from e
    if not data or len(data) > MAX_IMAGE:
        raise ValueError("the image is empty or too large")
    return suffix, data


def filtered(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Rows whose fields equal all filters, letter case aside."""
    for k, v in filters.items():
        df = df.where(F.lower(k) == v.lower())
    return df


class Engine:
    """Searches and answers over one folder of manual tables: indexes are opened once, made before if they are missing.

    ``root`` is where indexes are kept, the work folder's by default. DataFrames in, small lists out; a question writes
    nothing. ``images`` (element_id, vector and the manual's fields, page_no, section_path, asset_path) makes image questions
    possible, ``generator`` rewrites answers.
    """

    def __init__(self, spark: SparkSession, folder: str, root: str | None = None, images: DataFrame | None = None, generator: generation.Generator | None = None, defaults: Mapping[str, str] | None = None):
        self.spark, self.folder, self.generator, self.images = spark, folder, generator, images
        self.defaults = dict(defaults or {})
        self.text, self.tables, self.rows = R.text_index(spark, folder, root), R.table_index(spark, folder, root), IQ.row_index(spark, folder, root)
        self.entities = R.node_index(spark, folder, root)
        self.nodes, self.steps = GQ.graph_index(spark, folder, root)
        mark = fingerprint(spark, [f"{folder}/{n}.parquet" for n in ("chunks", "table_elements", "graph_edges")])
        base = root or f"{checkpoint_root(spark)}/indexes"
        kept_as = lambda name, df, *by: spark.read.parquet(kept(spark, f"{name}-{mark}", lambda p: df().repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(p), base))
        self.chunks = kept_as("chunks", lambda: R.chunks(spark, folder), "chunk_id")
        self.table_rows = kept_as("table_rows", lambda: IQ.table_rows(spark, folder), "row_id")
        self.crops = kept_as("crops", lambda: R._tables(spark, folder), "element_id")
        self.edges = kept_as("edges", lambda: GQ._edges(spark, folder), "edge_id")
        self.manuals = [r.asDict() for r in table(spark, folder, "manifest").select(*R.META).distinct().limit(MANUALS + 1).collect()]
        if len(self.manuals) > MANUALS:  # beyond the bound they stay a table
            self.manuals = None

    def health(self) -> dict[str, int]:
        return {name: table(self.spark, self.folder, name).count() for name in ("manifest", "chunks", "table_elements", "graph_nodes", "graph_edges")}

    def resolve(self, filters: Mapping[str, str]) -> dict[str, str]:
        """The one manual the filters, completed by the defaults, select; none or several are an error."""
        known = self.defaults | {k: v for k, v in checked_filters(filters).items() if k != "chunk_type"}
        if self.manuals is None:
            found = [r.asDict() for r in filtered(table(self.spark, self.folder, "manifest").select(*R.META).distinct(), known).take(2)]
        else:
            found = [m for m in self.manuals if all(str(m[k] or "").lower() == v.lower() for k, v in known.items())]
        if len(found) != 1:
            raise ValueError("the filters select no manual" if not found else "the filters select several manuals")
        return {k: v for k, v in found[0].items() if v}

    def _terms(self, query: str, stopwords=T.TEXT_STOPWORDS) -> list[str]:
        return T.query_words(query, stopwords)

    def _best(self, index: bm25.Index, records: DataFrame, query: str, filters: Mapping[str, str], limit: int, stopwords=T.TEXT_STOPWORDS) -> DataFrame:
        """Best records with their columns, score and rank: filtered before they are ranked, statistics of the whole index."""
        terms = self._terms(query, stopwords)
        asked = self.spark.createDataFrame([("q", t) for t in terms], "query_id string, term string")
        own = bm25.Index(index.postings.where(F.col("term").isin(*terms)), index.terms.where(F.col("term").isin(*terms)), index.stats, index.key)
        if "doc_id" in filters:  # the index lies by term and carries the manual, so this reaches its files
            own = bm25.Index(own.postings.where(F.lower("doc_id") == filters["doc_id"].lower()), own.terms, own.stats, own.key)
        scored = bm25.search(own, F.broadcast(asked), None).drop("rank")
        kept_rows = scored.join(filtered(records, filters), index.key).orderBy(F.desc("score"), index.key).limit(limit)
        return kept_rows.withColumn("rank", F.row_number().over(R.Window.partitionBy("query_id").orderBy(F.desc("score"), index.key)))

    def hits(self, query: str, filters: Mapping[str, str] | None = None, limit: int = 10) -> DataFrame:
        """Best chunks of a question."""
        checked_limit(limit, MAX_LIMIT)
        return self._best(self.text, self.chunks, query, checked_filters(filters), limit)

    def answer(self, query: str, filters: Mapping[str, str], max_evidence: int = 3) -> dict[str, Any]:
        """Status, reason, answer and evidence of a text question."""
        checked_limit(max_evidence, MAX_EVIDENCE)
        chosen = checked_filters(filters)
        context = chosen.get("doc_id") or (chosen.get("model") and chosen.get("year")) or ""
        if not context:
            return {"status": "needs_context", "reason": "needs_vehicle_context", "answer": answering.REFUSAL, "evidence": []}
        q = self.spark.createDataFrame([("q", query, context)], "query_id string, question string, doc_id string")
        found = self.hits(query, chosen).collect()  # at most ten rows
        if not found:
            return {"status": "refused", "reason": "no_retrieval_results", "answer": answering.REFUSAL, "evidence": []}
        hits = self.spark.createDataFrame(found, self.hits(query, chosen).schema)
        packs = answering.evidence_packs(hits.select("query_id", "chunk_id", "score", "rank"), hits.drop("query_id", "score", "rank"), q, max_evidence)
        evidence = [r.asDict(recursive=True) for r in packs.orderBy("citation_id").collect()]
        row = answering.answers(q, self.spark.createDataFrame(evidence, packs.schema)).first()
        base = {"status": row["status"], "reason": row["reason"], "answer": row["answer"], "evidence": evidence}
        return generation.generate_or_fallback(base, query, self.generator)

    def answer_table(self, query: str, filters: Mapping[str, str], limit: int = 5) -> dict[str, Any]:
        """An exact value from a table row, or a refusal, with the rows considered."""
        manual = self.resolve(filters)
        best = self._best(self.rows, self.table_rows, query, {"doc_id": manual["doc_id"]}, checked_limit(limit, MAX_LIMIT), T.TABLE_STOPWORDS)
        q = self.spark.createDataFrame([("q", query)], "query_id string, question string")
        rows = answering.row_decisions(q.join(best.withColumn("section", F.col("section_text")), "query_id", "left")).orderBy(F.desc_nulls_last("score"), "row_id").collect()
        row, evidence = rows[0], [dict(r.asDict(recursive=True), citation_id=i) for i, r in enumerate(rows, 1) if r["row_id"]]
        return {"status": row["status"], "reason": row["reason"], "answer": row["row_text"] if row["status"] == "answered" else answering.REFUSAL, "evidence": evidence}

    def search_tables(self, query: str, filters: Mapping[str, str]) -> dict[str, Any]:
        """A table answer with crops to check it by: those of verified rows first, then the topic's."""
        if not query.strip():
            return {"answer": "", "crops": [], "rows": [], "message": "enter a topic"}
        manual, answer = self.resolve(filters), self.answer_table(query, filters)
        assets = {r["element_id"]: r["asset_path"] for r in self.crops.where(F.col("element_id").isin(*[e["element_id"] for e in answer["evidence"]])).select("element_id", "asset_path").collect()}
        verified = [dict(e, asset_path=assets.get(e["element_id"])) for e in answer["evidence"]]
        topic = [r.asDict(recursive=True) for r in self._best(self.tables, self.crops, query, {"doc_id": manual["doc_id"]}, 5, T.TABLE_STOPWORDS).orderBy("rank").collect()]
        return {"answer": answer["answer"], "crops": presenters.table_crops(verified, topic), "rows": presenters.evidence_rows({"evidence": verified}), "message": answer["status"]}

    def answer_image(self, payload: str, filters: Mapping[str, str], question: str = "", limit: int = 5) -> dict[str, Any]:
        """Figures like an uploaded one (base64), of one manual; with a question, fused with the text hits of their pages.
        The image is decoded by the JVM's reader."""
        checked_limit(limit, MAX_LIMIT)
        if self.images is None:
            raise ValueError("this engine has no image index")
        _, data = decode_image(payload)
        manual = self.resolve(filters)
        own = filtered(self.images, {"doc_id": manual["doc_id"]})
        asked = visual.features_of(visual.decoded(self.spark, data))
        query = self.spark.createDataFrame([("query", [float(x) for x in asked])], "element_id string, vector array<double>")
        depth = fusion.CANDIDATES if question.strip() else limit
        hits = fusion.vector_search(own.select("element_id", F.col("vector").cast("array<double>").alias("vector")), query, "element_id", "vector", depth).join(own.drop("vector"), "element_id")
        if question.strip():
            text = self.hits(question, {"doc_id": manual["doc_id"]}, fusion.CANDIDATES).select(F.lit("query").alias("query_id"), "doc_id", "page_nos", "rank")
            hits = fusion.page_fusion(hits, text, "element_id", limit)
        found = [dict(r.asDict(recursive=True), citation_id=r["rank"]) for r in hits.orderBy("rank").collect()]
        backend = "visual_text_rrf" if question.strip() else "visual_only"
        if not found:
            return {"status": "refused", "reason": "no_visual_results", "answer": answering.REFUSAL, "evidence": [], "retrieval": backend}
        for e in found:
            e["source"] = f"{e['brand']} {e['model']} Owner's Manual ({e['year']}), {' > '.join(e['section_path'] or [])}, physical PDF p.{e['page_no']}"
        base = {"status": "answered", "reason": "visual_evidence_retrieved", "answer": "\n".join(["Figures of the manual that match:", *(f"[{e['citation_id']}] {e['source']}" for e in found)]), "evidence": found}
        shown = [e["asset_path"] for e in found[:3] if e.get("asset_path")]
        return generation.generate_or_fallback(base, question or "What does the image show?", self.generator) | {"retrieval": backend, "images": shown}

    def paths(self, query: str, filters: Mapping[str, str], limit: int = graph.PATHS, hops: int = 2) -> list[dict[str, Any]]:
        """The graph's best paths with what a citation of them says."""
        checked_limit(limit, MAX_GRAPH_LIMIT)
        manual = self.resolve(filters)
        one = {"doc_id": manual["doc_id"]}
        own = filtered(self.nodes, one)
        entities = self._best(self.entities, own, query, one, graph.ENTITIES, T.GRAPH_STOPWORDS).select("query_id", "node_id", "score")
        q = self.spark.createDataFrame([("q", query, manual["doc_id"])], "query_id string, question string, doc_id string")
        found = graph.paths(graph.entity_scores(entities, own, q), filtered(self.steps, one), limit, hops=checked_limit(hops, 2)).collect()  # at most ``limit`` rows
        if not found:
            return []
        few = self.spark.createDataFrame(found, "query_id string, doc_id string, path array<string>, edges array<string>, hops int, score double, path_id string, rank int")
        return [r.asDict(recursive=True) for r in graph.path_records(few, own, self.edges).orderBy("rank").collect()]

    def agentic(self, query: str, filters: Mapping[str, str], image: str | None = None) -> dict[str, Any]:
        """The workflow over this engine's searches."""
        manual = self.resolve(filters)
        one = {"doc_id": manual["doc_id"]}

        def text(q: str, _: Mapping[str, str]) -> list[dict[str, Any]]:
            found = self.answer(q, one)
            return [dict(e, **{k: e.get(k, manual.get(k)) for k in R.META}, identity=e["chunk_id"], score=e["retrieval_score"]) for e in found["evidence"]] if found["status"] == "answered" else []

        def rows(q: str, _: Mapping[str, str]) -> list[dict[str, Any]]:
            found = self.answer_table(q, one)
            return [dict(e, identity=e["row_id"], content=e["row_text"], page_nos=[e["page_no"]] if e["page_no"] is not None else []) for e in found["evidence"]]

        def paths(q: str, _: Mapping[str, str]) -> list[dict[str, Any]]:
            return [dict(p, identity=",".join(sorted(p["evidence_ids"]))) for p in self.paths(q, one, 6)]

        retrievers = {"text": text, "graph": paths, "table": rows}
        if image is not None and self.images is not None:
            retrievers["visual"] = lambda q, _: [dict(e, identity=e["element_id"], page_nos=[e["page_no"]], content=e.get("content") or "") for e in self.answer_image(image, one, q)["evidence"]]
        return agentic.Workflow(retrievers, self.generator).run(query, {"doc_id": manual["doc_id"]}, image is not None)
