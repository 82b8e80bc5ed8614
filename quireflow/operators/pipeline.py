"""The stages from tables to indexes and reports, run in order over a range of them, with a report."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Collection, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quireflow.operators import decision_queries as D
from quireflow.operators import graph_queries as Q
from quireflow.operators import ingest_queries as I
from quireflow.operators import retrieval_queries as R
from quireflow.plans.workspace import released

STAGES = ("import", "chunks", "indexes", "graph", "evaluate", "audit")


class ImportRefused(RuntimeError):
    """Contracts are broken and the import is strict."""


def write_json(value: Mapping[str, Any], path: str) -> None:
    """A small summary as one JSON file of sorted keys, put in place at once."""
    aside = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(aside, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=2, default=str)
        f.write("\n")
    os.replace(aside, path)


def write_summary(df: DataFrame, path: str, most: int = 1_000) -> None:
    """The rows of a small result as JSON; more than ``most`` are an error, as it is a table then."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a summary holds at most {most} rows")
    write_json({"rows": [r.asDict(recursive=True) for r in rows]}, path)


def stage_range(first: str, last: str, skip: Collection[str] = ()) -> list[str]:
    """Stages from ``first`` to ``last``, both included, without those skipped. Unknown names and an empty range are errors."""
    unknown = {first, last, *skip} - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    a, b = STAGES.index(first), STAGES.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    chosen = [s for s in STAGES[a : b + 1] if s not in skip]
    if not chosen:
        raise ValueError("every stage is skipped")
    return chosen


def gate(violations: DataFrame, allowed: Collection[str] = ()) -> dict[str, int]:
    """Counts of broken contracts (record_table, code, records) by name; any beyond ``allowed`` refuses the import."""
    found = {f"{r['record_table']}.{r['code']}": r["records"] for r in violations.collect()}  # one row a rule
    broken = {k: n for k, n in found.items() if n and k not in allowed}
    if broken:
        raise ImportRefused(", ".join(f"{k}: {n}" for k, n in sorted(broken.items())))
    return found


def run(spark: SparkSession, folder: str, out: str, first: str = STAGES[0], last: str = STAGES[-1], skip: Collection[str] = (), strict: bool = False) -> dict[str, Any]:
    """Runs the stages over a folder of tables; results go to ``out``, indexes to ``out``/indexes. The report has status,
    seconds and results of each stage; a stage that fails ends the run, and the report says so."""
    indexes = f"{out.rstrip('/')}/indexes"

    def do_import() -> dict[str, Any]:
        broken = I.contract_violations(spark, folder)
        found = gate(broken) if strict else {f"{r['record_table']}.{r['code']}": r["records"] for r in broken.collect()}
        I.anomaly_report(spark, folder).write.mode("overwrite").parquet(f"{out}/anomalies")
        return {"violations": found}

    def do_chunks() -> dict[str, Any]:
        I.chunk_build(spark, folder).write.mode("overwrite").parquet(f"{out}/chunks")
        return {"chunks": spark.read.parquet(f"{out}/chunks").count()}

    def do_indexes() -> dict[str, Any]:
        made = {"text": R.text_index, "tables": R.table_index, "nodes": R.node_index, "rows": I.row_index, "images": R.image_index}
        return {name: make(spark, folder, indexes).stats.first()["n"] for name, make in made.items()}

    def do_graph() -> dict[str, Any]:
        Q.built_nodes(spark, folder).write.mode("overwrite").parquet(f"{out}/graph_nodes")
        Q.graph_build_edges(spark, folder).write.mode("overwrite").parquet(f"{out}/graph_edges")
        Q.graph_index(spark, folder, indexes)
        return {n: spark.read.parquet(f"{out}/{n}").count() for n in ("graph_nodes", "graph_edges")}

    def do_evaluate() -> dict[str, Any]:
        return {n: [r.asDict() for r in q(spark, folder).collect()] for n, q in (("recall", R.recall_mrr), ("answers", R.answer_metrics), ("routes", D.route_accuracy))}

    def do_audit() -> dict[str, Any]:
        return {n: [r.asDict() for r in q(spark, folder).collect()] for n, q in (("ranks", I.rank_audit), ("vectors", I.vector_audit))}

    work: dict[str, Callable[[], dict[str, Any]]] = dict(zip(STAGES, (do_import, do_chunks, do_indexes, do_graph, do_evaluate, do_audit)))
    report: dict[str, Any] = {"folder": folder, "status": "passed", "stages": []}
    began = time.perf_counter()
    for name in stage_range(first, last, skip):
        at = time.perf_counter()
        try:
            with released():
                results, status = work[name](), "passed"
        except Exception as e:  # the report is what a run leaves behind
            results, status = {"error": f"{type(e).__name__}: {str(e)[:500]}"}, "failed"
        report["stages"].append({"stage": name, "status": status, "seconds": round(time.perf_counter() - at, 3), "results": results})
        if status == "failed":
            report["status"] = "failed"
            break
    report["seconds"] = round(time.perf_counter() - began, 3)
    return report
