"""Evaluation of searches, answers, paths and routes, for many questions in one plan; and question files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import text as T

META = ("doc_id", "brand", "model", "year", "region", "language", "manual_type")
#: Fields a question file's records must have, by kind.
REQUIRED = {
    "retrieval": ("question_id", "question", "filters", "category", "answerable", "gold_element_ids"),
    "visual": ("query_id", "image_path", "filters", "split", "gold_element_id"),
    "table": ("question_id", "question", "filters", "gold_element_ids"),
    "rows": ("question_id", "question", "filters", "answerable", "gold_row_ids", "expected_values"),
    "agentic": ("question_id", "question", "filters", "answerable", "gold_evidence", "gold_path", "expected_route"),
}


def load_questions(spark: SparkSession, path: str, kind: str) -> list[dict[str, Any]]:
    """Records of a small JSON lines file of questions, in order. Blank lines are skipped. A line that is no object, lacks a
    field, has filters that are no object or an answerable that is no boolean, a repeated id and an empty file are errors
    that name the line."""
    out: list[dict[str, Any]] = []
    seen: set[str] = set()
    for no, line in enumerate(spark.sparkContext.wholeTextFiles(path).values().first().split("\n"), 1):
        if not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError as e:
            raise ValueError(f"{path}:{no} is no JSON") from e
        if not isinstance(value, dict):
            raise ValueError(f"{path}:{no} is no object")
        missing = [f for f in REQUIRED[kind] if f not in value]
        if missing:
            raise ValueError(f"{path}:{no} lacks {', '.join(sorted(missing))}")
        if not isinstance(value["filters"], dict):
            raise ValueError(f"{path}:{no} filters is no object")
        if "answerable" in value and not isinstance(value["answerable"], bool):
            raise ValueError(f"{path}:{no} answerable is no boolean")
        ident = str(value[REQUIRED[kind][0]])
        if ident in seen:
            raise ValueError(f"{path}:{no} repeats {ident}")
        seen.add(ident)
        out.append(value)
    if not out:
        raise ValueError(f"{path} holds no question")
    return out


def mean_of(flag: Column) -> Column:
    """Mean of booleans, nulls aside, to 6 digits; null if there is none."""
    return F.round(F.avg(flag.cast("int")), 6)


def recall(df: DataFrame, *by: str, at: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """questions, recall_k, mrr_10 of rows first_rank (null where nothing was found), by groups."""
    shares = [F.round(F.avg(F.when(F.col("first_rank") <= k, 1).otherwise(0)), 6).alias(f"recall_{k}") for k in at]
    mrr = F.round(F.avg(F.coalesce(F.when(F.col("first_rank") <= 10, 1 / F.col("first_rank")), F.lit(0.0))), 6)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), *shares, mrr.alias("mrr_10"))


def compare(ranks: Mapping[str, DataFrame], *by: str) -> DataFrame:
    """``recall`` of several systems (query_id, first_rank each) in one table, named by ``system``."""
    out = None
    for name, df in ranks.items():
        one = df.withColumn("system", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return recall(out, "system", *by)


def verified_gold(gold: DataFrame, membership: DataFrame) -> DataFrame:
    """gold (query_id, element_id, doc_id, page_no) with problem: unknown where no index record holds the element, document or
    page where the record's differ, null where all agrees. membership: element_id, doc_id, page_nos, one row an element."""
    m = membership.select("element_id", F.col("doc_id").alias("_doc"), F.col("page_nos").alias("_pages"))
    problem = (
        F.when(F.col("_doc").isNull(), "unknown").when(F.col("_doc") != F.col("doc_id"), "document")
        .when(F.col("page_no").isNotNull() & ~F.coalesce(F.array_contains("_pages", F.col("page_no")), F.lit(False)), "page")
    )
    return gold.join(m, "element_id", "left").withColumn("problem", problem).drop("_doc", "_pages")


def violates(evidence: str, wanted: str, fields: Iterable[str] = META) -> Column:
    """Whether a struct of the manual's fields differs from a struct of filters in a field the filter names, case aside.
    A blank or null filter asks nothing; a null field differs from any."""
    out = F.lit(False)
    for f in fields:
        want = F.lower(F.btrim(F.coalesce(F.col(f"{wanted}.{f}"), F.lit(""))))
        out = out | ((want != "") & (F.lower(F.coalesce(F.col(f"{evidence}.{f}"), F.lit(""))) != want))
    return out


def violations(hits: DataFrame, *by: str) -> DataFrame:
    """results, violations, violation_rate (0 without results) of rows with a boolean ``is_foreign``."""
    n, bad = F.count(F.lit(1)), F.count_if(F.coalesce("is_foreign", F.lit(False)))
    return hits.groupBy(*by).agg(n.alias("results"), bad.alias("violations"), F.round(F.coalesce(F.try_divide(bad, n), F.lit(0.0)), 6).alias("violation_rate"))


def answer_metrics(df: DataFrame, *by: str) -> DataFrame:
    """Decision accuracy, response rate, citation recall, no-answer accuracy of rows answerable, answered, hit. Each is of the
    questions it speaks of, null without any; a refusal of what has no answer is right, whatever its reason."""
    a, d = F.col("answerable"), F.col("answered")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), mean_of(a == d).alias("decision_accuracy"), mean_of(F.when(a, d)).alias("response_rate"),
        mean_of(F.when(a, d & F.col("hit"))).alias("citation_recall"), mean_of(F.when(~a, ~d)).alias("no_answer_accuracy"),
    )


def holds_all(answer: Column, expected: Column) -> Column:
    """Whether an answer holds every expected string, case aside; none expected is held."""
    return F.forall(expected, lambda x: F.contains(F.lower(answer), F.lower(x)))


def row_metrics(df: DataFrame) -> DataFrame:
    """Row recall at 1 and 5, answer rate, decision, no-answer and exact-value accuracy of rows answerable, answered,
    first_rank, answer, expected (array)."""
    a, d, r = F.col("answerable"), F.col("answered"), F.col("first_rank")
    return df.agg(
        F.count(F.lit(1)).alias("questions"), mean_of(F.when(a, F.coalesce(r <= 1, F.lit(False)))).alias("row_recall_1"), mean_of(F.when(a, F.coalesce(r <= 5, F.lit(False)))).alias("row_recall_5"),
        mean_of(d).alias("answer_rate"), mean_of(a == d).alias("decision_accuracy"), mean_of(F.when(~a, ~d)).alias("no_answer_accuracy"),
        mean_of(F.when(a, d & holds_all(F.col("answer"), F.col("expected")))).alias("exact_value_accuracy"),
    )


def evidence_hits(gold_ids: Column, gold_pages: Column, ids: Column, pages: Column) -> Column:
    """How many gold pieces (ids and pages of equal places) the evidence names by id or, else, by page."""
    hit = F.zip_with(gold_ids, gold_pages, lambda i, p: F.coalesce(F.array_contains(ids, i), F.lit(False)) | F.coalesce(F.array_contains(pages, p), F.lit(False)))
    return F.size(F.filter(hit, lambda x: x))


def path_correct(paths: Column, types: Column, relations: Column, pages: Column) -> Column:
    """Whether one path (struct of node_types, relations, page_nos) has all required types, relations and pages; null where
    nothing is required."""
    none = (F.size(types) == 0) & (F.size(relations) == 0) & (F.size(pages) == 0)
    has = lambda want, have: F.size(F.array_except(want, have)) == 0
    one = F.exists(paths, lambda p: has(types, p["node_types"]) & has(relations, p["relations"]) & has(pages, p["page_nos"]))
    return F.when(~none, F.coalesce(one, F.lit(False)))


def route_correct(route: str, expected: str, fields: Iterable[str]) -> Column:
    """Whether every expected search (struct of booleans; null asks nothing) is what the route says; null without a route."""
    out = F.lit(True)
    for f in fields:
        out = out & F.coalesce(F.coalesce(F.col(f"{route}.{f}"), F.lit(False)) == F.col(f"{expected}.{f}"), F.lit(True))
    return F.when(F.col(route).isNotNull(), out)


def records(df: DataFrame) -> DataFrame:
    """Rows system, query_id, answerable, status, evidence_hits, evidence_total, path_ok, cited_well, route_ok, violations,
    retries with decision_ok, refusal_ok and failure: null, or what was wrong, where the decision, path or route was.

    A path speaks only where the route was to use the graph: path_ok is null before that; cited_well is null unless answered.
    """
    answered = F.col("status") == "answered"
    out = df.withColumn("decision_ok", answered == F.col("answerable")).withColumn("refusal_ok", F.when(~F.col("answerable"), ~answered))
    out = out.withColumn("cited_well", F.when(answered, F.col("cited_well")))
    fine = F.col("decision_ok") & F.coalesce("path_ok", F.lit(True)) & F.coalesce("route_ok", F.lit(True))
    return out.withColumn("failure", F.when(~fine, F.struct(F.col("decision_ok").alias("decision"), F.col("path_ok").alias("path"), F.col("route_ok").alias("route"))))


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Metrics of ``records``, by groups. A mean of nothing is null."""
    hits, total = F.sum("evidence_hits"), F.sum("evidence_total")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.try_divide(hits, total), 6).alias("evidence_recall"), mean_of(F.col("path_ok")).alias("path_accuracy"),
        mean_of(F.col("cited_well")).alias("citation_faithfulness"), mean_of(F.col("route_ok")).alias("route_accuracy"), mean_of(F.col("decision_ok")).alias("decision_accuracy"),
        mean_of(F.col("refusal_ok")).alias("refusal_accuracy"), F.sum("violations").alias("metadata_violations"), mean_of(F.col("retries") > 0).alias("retry_rate"),
        F.count("failure").alias("failures"),
    )


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median and nearest-rank 95th percentile of non-null values."""
    p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.expr(f"percentile({value}, 0.5)"), 6).alias("median"), F.round(p95, 6).alias("p95"))


def markdown_report(summaries: DataFrame, failures: DataFrame | None = None, title: str = "Comparison", most: int = 50) -> str:
    """A Markdown report: a table of a few systems' metrics, and the first ``most`` failures by system and question."""
    rows = summaries.orderBy(summaries.columns[0]).limit(100).collect()
    show = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    out = [f"# {title}", "", "| Metric | " + " | ".join(str(r[0]) for r in rows) + " |", "|---|" + "---:|" * len(rows)]
    out += [f"| {c} | " + " | ".join(show(r[c]) for r in rows) + " |" for c in summaries.columns[1:]]
    if failures is not None:
        out += ["", "## Failures", ""]
        found = failures.where("failure IS NOT NULL").orderBy("system", "query_id").limit(most).collect()
        out += [f"- {r['system']} {r['query_id']}: " + ", ".join(f"{k} {show(v)}" for k, v in r["failure"].asDict().items()) for r in found] or ["None."]
    return "\n".join(out) + "\n"


def cited_well(answer: Column, n_evidence: Column, refusal: str) -> Column:
    return T.citations_valid(answer, n_evidence, refusal)
