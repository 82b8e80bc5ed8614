"""Planner, parallel retrieval, critic, evidence merge and guard: one question at a time, over lazy retrievers.

The state machine runs on the driver, as it holds a question's few rows; each retriever is a Spark plan of its own and
they run side by side. The critic, merge and guard also exist as plans over many questions.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import generation
from quireflow.operators.answering import REFUSAL

# How many pieces of each source evidence takes, its cap, and the graph score that supports an answer.
HEADS = (("graph", 3), ("text", 3), ("table", 2), ("visual", 2))
EVIDENCE_CAP = 8
GRAPH_SUPPORT = 1.0
ATTEMPTS = 2

Retriever = Callable[[str, Mapping[str, str]], list[dict[str, Any]]]


def merge_evidence(evidence: DataFrame, cap: int = EVIDENCE_CAP) -> DataFrame:
    """query_id, citation_id and the columns of evidence (query_id, source, rank, doc_id, pages, identity, ...): the first
    of each source, sources in fixed order, one a document, pages and identity, at most ``cap``."""
    order = F.lit(len(HEADS))
    limit = F.lit(0)
    for i, (name, n) in enumerate(HEADS):
        order = F.when(F.col("source") == name, i).otherwise(order)
        limit = F.when(F.col("source") == name, n).otherwise(limit)
    df = evidence.withColumn("_o", order).where(F.col("rank") <= limit)
    once = Window.partitionBy("query_id", "doc_id", "pages", "identity").orderBy("_o", "rank")
    df = df.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    place = Window.partitionBy("query_id").orderBy("_o", "rank", "identity")
    return df.withColumn("citation_id", F.row_number().over(place)).where(F.col("citation_id") <= cap).drop("_o", "_n")


def critic(plans: DataFrame) -> DataFrame:
    """The plan's rows with decision accept, replan or refuse: text is always required, a graph or image where planned;
    evidence of another manual refuses at once. Rows: use_graph, use_visual, text_ok, graph_score, visual_ok, violations,
    attempt."""
    graph_ok = F.coalesce(F.col("graph_score") >= GRAPH_SUPPORT, F.lit(False))
    met = F.col("text_ok") & (graph_ok | ~F.col("use_graph")) & (F.col("visual_ok") | ~F.col("use_visual"))
    decision = F.when(F.col("violations") > 0, "refuse").when(met, "accept").when(F.col("attempt") < ATTEMPTS, "replan").otherwise("refuse")
    return plans.withColumn("decision", decision)


def guard(answers: DataFrame) -> DataFrame:
    """Rows answer, n_evidence, foreign (pieces of another manual) with passed: citations are valid, none is foreign."""
    return answers.withColumn("passed", T.citations_valid(F.col("answer"), F.col("n_evidence"), REFUSAL) & (F.col("foreign") == 0))


@dataclass
class Workflow:
    """At most two attempts: the second one broadened, after which the question is refused."""

    retrievers: Mapping[str, Retriever]
    synthesize: Callable[[str, list[dict[str, Any]]], str] | None = None
    trace: list[dict[str, Any]] = field(default_factory=list)

    def _event(self, node: str, began: float, status: str = "ok", **details: Any) -> None:
        self.trace.append({"sequence": len(self.trace) + 1, "node": node, "status": status, "latency_ms": round((time.perf_counter() - began) * 1000, 3), "details": {k: str(v) for k, v in details.items()}})

    def plan(self, query: str, image: bool, broaden: bool) -> dict[str, Any]:
        has = lambda name: name in self.retrievers
        find = lambda pattern: bool(re.search(pattern, query))
        multi = find(T.ROUTE_GRAPH) or find(T.ROUTE_PROCEDURE) or find(T.ROUTE_CLAUSES)
        table = has("table") and (find(T.ROUTE_TABLE) or broaden)
        visual = has("visual") and image
        intent = "visual" if visual else "exact_value" if table else "procedure" if find(T.ROUTE_PROCEDURE) else "fact"
        return {"text": has("text"), "graph": has("graph") and (multi or broaden), "table": table, "visual": visual, "intent": intent, "multi_hop": multi}

    def _retrieve(self, names: list[str], query: str, filters: Mapping[str, str]) -> dict[str, list[dict[str, Any]]]:
        """One thread a retriever; one that fails gives nothing and is traced."""

        def one(name: str) -> list[dict[str, Any]]:
            began = time.perf_counter()
            try:
                found = self.retrievers[name](query, filters)
                self._event(f"retrieve_{name}", began, results=len(found))
                return found
            except (OSError, RuntimeError, ValueError) as e:
                self._event(f"retrieve_{name}", began, "error", error=e)
                return []

        with ThreadPoolExecutor(max(1, len(names))) as pool:
            return dict(zip(names, pool.map(one, names)))

    def _merged(self, found: Mapping[str, list[dict[str, Any]]]) -> list[dict[str, Any]]:
        out, seen = [], set()
        for name, n in HEADS:
            for item in found.get(name, [])[:n]:
                identity = (item.get("doc_id"), tuple(item.get("page_nos", ())), str(item.get("identity", "")))
                if identity not in seen and len(out) < EVIDENCE_CAP:
                    seen.add(identity)
                    out.append(dict(item, source_kind=name, citation_id=len(out) + 1))
        return out

    def run(self, query: str, filters: Mapping[str, str], image: bool = False) -> dict[str, Any]:
        """Answer or refusal with evidence, route and trace. Items are dicts with score, content and the manual's fields."""
        filters = {k: v.strip() for k, v in filters.items() if v and v.strip()}
        if not (filters.get("doc_id") or (filters.get("model") and filters.get("year"))):
            return {"status": "needs_context", "answer": REFUSAL, "evidence": [], "trace": self.trace}
        evidence: list[dict[str, Any]] = []
        for attempt in range(1, ATTEMPTS + 1):
            began = time.perf_counter()
            route = self.plan(query, image, attempt > 1)
            self._event("planner", began, intent=route["intent"], attempt=attempt)
            found = self._retrieve([n for n in ("text", "graph", "table", "visual") if route[n]], query, filters)
            began = time.perf_counter()
            evidence = self._merged(found)
            foreign = [e for e in evidence if any(str(e.get(k, v)).lower() != v.lower() for k, v in filters.items())]
            graph_ok = any(p.get("score", 0) >= GRAPH_SUPPORT for p in found.get("graph", []))
            met = bool(found.get("text")) and (graph_ok or not route["graph"]) and (bool(found.get("visual")) or not route["visual"])
            decision = "refuse" if foreign else "accept" if met else "replan" if attempt < ATTEMPTS else "refuse"
            self._event("critic", began, decision=decision)
            if decision == "replan":
                continue
            if decision == "refuse":
                break
            began = time.perf_counter()
            base = {"status": "answered", "answer": generation.extractive(evidence), "evidence": evidence}
            result = generation.generate_or_fallback(base, query, self.synthesize)
            answer = result["answer"]
            self._event("synthesis", began, generation=result["generation"]["status"])
            began = time.perf_counter()
            passed = not generation.grounding_errors(answer, len(evidence))
            self._event("guard", began, "ok" if passed else "failed")
            if passed:
                return {"status": "answered" if answer.strip() != REFUSAL else "refused", "answer": answer, "evidence": evidence, "route": route, "generation": result["generation"], "retry_count": attempt - 1, "trace": self.trace}
        return {"status": "refused", "answer": REFUSAL, "evidence": evidence, "trace": self.trace}
