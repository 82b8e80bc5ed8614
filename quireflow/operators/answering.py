"""Evidence packs, answer-or-refuse decisions, rendered answers and routes, for many questions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.functions import text as T

# Thresholds and weights of the text answer.
MIN_SCORE, MIN_CONFIDENCE = 12.0, 0.55
SCORE_SCALE = 20.0
W_SCORE, W_CONTENT, W_SECTION, BONUS_PROCEDURE = 0.55, 0.35, 0.10, 0.08
CONTENT_LIMIT = 900
# Thresholds of the table answer.
ROW_MIN_SCORE, ROW_MIN_COVERAGE = 3.0, 0.6

HEADER = "From the manual's evidence:"
SAFETY_NOTE = "Safety: heed the warning or caution cited above."
REFUSAL = "The manual's evidence does not support an answer."


def evidence_packs(hits: DataFrame, chunks: DataFrame, questions: DataFrame, max_evidence: int = 3, score_scale: float = SCORE_SCALE) -> DataFrame:
    """The best pieces of evidence of each question, reranked, one a chunk, with citation ids from 1.

    hits: query_id, chunk_id, score, rank; chunks and questions with their columns. Terms are taken once a chunk and once
    a question, before they meet, and where the chunk lies: what goes on to be ranked are numbers, and only the pieces kept get
    their texts. Coverage of a question without terms is 0; equal rerank scores keep the retrieval order.
    """
    section = T.section_text(F.col("section_path"))
    termed = chunks.select(
        "chunk_id", T.answer_terms(F.concat_ws("\n", section, F.col("content"))).alias("_had"), T.answer_terms(section).alias("_had_section"),
        T.supports_procedure(F.col("chunk_type"), F.col("section_path"), F.col("content")).alias("procedure_support"),
    )
    texts = chunks.select("chunk_id", "brand", "model", "year", "section_path", "page_nos", "chunk_type", "element_ids", T.compact(F.col("content"), CONTENT_LIMIT, "…", collapse=False).alias("content"))
    asked = questions.select("query_id", T.answer_terms(F.col("question")).alias("_wanted"), T.is_procedural(F.col("question")).alias("_procedural"))
    df = hits.select("query_id", "chunk_id", "score", "rank").join(asked, "query_id").join(termed, "chunk_id")
    df = df.withColumn("_cover", T.coverage(F.col("_wanted"), F.col("_had")))
    bonus = F.when(F.col("_procedural") & F.col("procedure_support"), BONUS_PROCEDURE).otherwise(0.0)
    raw = F.least(W_SCORE * F.least(F.col("score") / score_scale, F.lit(1.0)) + W_CONTENT * F.col("_cover") + W_SECTION * T.coverage(F.col("_wanted"), F.col("_had_section")) + bonus, F.lit(1.0))
    df = df.withColumn("_raw", raw).drop("_wanted", "_had", "_had_section", "_procedural")
    order = [F.desc(F.round("_raw", 9)), F.asc("rank")]
    once = df.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).where("_n = 1")
    ranked = once.withColumn("citation_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("citation_id") <= max_evidence)
    return (
        ranked.join(texts, "chunk_id")
        .withColumn("rerank_score", F.round("_raw", 6))
        .withColumn("query_term_coverage", F.round("_cover", 6))
        .withColumn("source", T.source_label(F.col("section_path"), F.col("page_nos")))
        .withColumnRenamed("rank", "retrieval_rank")
        .withColumnRenamed("score", "retrieval_score")
        .drop("_raw", "_cover", "_n")
    )


def has_vehicle_context() -> Column:
    return F.btrim(F.coalesce("doc_id", F.lit(""))) != ""


def _lines(column: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("citation_id", column)))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["citation_id"].cast("string"), F.lit("] "), r[column])), "\n")


def _decided(questions: DataFrame, packs: DataFrame, min_score: float, min_confidence: float) -> DataFrame:
    """questions' columns, the decision, and what an answer is made of: one pass over the packs."""
    top = F.min(F.struct("citation_id", "retrieval_score", "rerank_score", "procedure_support")).alias("_top")
    body = [_lines("content").alias("_lines"), _lines("source").alias("_sources"), F.max(F.col("chunk_type").isin("warning", "caution")).alias("_safety")]
    held = packs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"), top, *body, F.flatten(F.collect_list("element_ids")).alias("cited"), F.collect_list("chunk_id").alias("cited_chunks"))
    df = questions.join(held, "query_id", "left")
    reason = (
        F.when(~has_vehicle_context(), "needs_vehicle_context")
        .when(F.col("n_evidence").isNull(), "no_retrieval_results")
        .when(T.is_procedural(F.col("question")) & ~F.col("_top.procedure_support"), "procedure_not_supported")
        .when((F.col("_top.retrieval_score") < min_score) | (F.col("_top.rerank_score") < min_confidence), "evidence_below_threshold")
        .otherwise("answered")
    )
    status = F.when(F.col("reason") == "answered", "answered").when(F.col("reason") == "needs_vehicle_context", "needs_context").otherwise("refused")
    return (
        df.withColumn("reason", reason)
        .withColumn("status", status)
        .withColumn("confidence", F.coalesce("_top.rerank_score", F.lit(0.0)))
        .withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)).cast("bigint"))
    )


def decisions(questions: DataFrame, packs: DataFrame, min_score: float = MIN_SCORE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """questions' columns with n_evidence, cited (element ids), cited_chunks, confidence, reason, status; the first reason that holds
    counts."""
    return _decided(questions, packs, min_score, min_confidence).drop("_top", "_lines", "_sources", "_safety")


def answers(questions: DataFrame, packs: DataFrame, min_score: float = MIN_SCORE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """decisions() with the extractive answer, or the refusal."""
    text = F.concat_ws("\n", F.lit(HEADER), "_lines", F.when(F.col("_safety"), SAFETY_NOTE), F.lit("Sources:"), "_sources")
    done = _decided(questions, packs, min_score, min_confidence)
    return done.withColumn("answer", F.when(F.col("status") == "answered", text).otherwise(F.lit(REFUSAL))).drop("_top", "_lines", "_sources", "_safety")


def row_decisions(rows: DataFrame, min_score: float = ROW_MIN_SCORE, min_coverage: float = ROW_MIN_COVERAGE) -> DataFrame:
    """Decision on the best curated row of each question: query_id, question, score (null without a row), section, row_text.

    Ladder: no row, score, conflict of applicability, coverage of the question's terms by section and row, answered.
    """
    wanted = T.plain_terms(F.col("question"), T.TABLE_ANSWER_STOPWORDS)
    had = T.plain_terms(F.concat_ws(" ", "section", "row_text"), T.TABLE_ANSWER_STOPWORDS)
    df = rows.withColumn("query_coverage", F.round(T.coverage(wanted, had), 6))
    reason = (
        F.when(F.col("score").isNull(), "no_curated_row")
        .when(F.col("score") < min_score, "row_below_threshold")
        .when(T.hybrid_conflict(F.col("section"), F.col("question")), "applicability_conflict")
        .when(F.col("query_coverage") < min_coverage, "row_semantic_coverage_too_low")
        .otherwise("answered")
    )
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "answered", "answered").otherwise("refused"))


def routes(questions: DataFrame, text: str, available: dict[str, bool] | None = None, image: Column | None = None, broaden: bool = False) -> DataFrame:
    """Which searches a question goes to, and its intent; broadening turns tables and graph on."""
    has = {"text": True, "table": True, "graph": True, "visual": True} | (available or {})
    q = F.col(text)
    visual = F.lit(False) if image is None else F.lit(has["visual"]) & image.isNotNull()
    table = F.lit(has["table"]) & (q.rlike(T.ROUTE_TABLE) | F.lit(broaden))
    multi = q.rlike(T.ROUTE_GRAPH) | q.rlike(T.ROUTE_PROCEDURE) | q.rlike(T.ROUTE_CLAUSES)
    graph = F.lit(has["graph"]) & (multi | F.lit(broaden))
    intent = F.when(visual, "visual").when(table, "exact_value").when(q.rlike(T.ROUTE_PROCEDURE), "procedure").otherwise("fact")
    return questions.select("*", intent.alias("intent"), multi.alias("multi_hop"), F.lit(has["text"]).alias("use_text"), table.alias("use_table"), graph.alias("use_graph"), visual.alias("use_visual"))
