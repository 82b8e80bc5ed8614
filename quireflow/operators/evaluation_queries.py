"""Queries that evaluate searches: backends, tables, rows and images, gold against the index; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import oracle as O
from quireflow.functions import text as T
from quireflow.operators import answering as A
from quireflow.operators import bm25, dense, fusion
from quireflow.operators import evaluation as E
from quireflow.operators import ingest_queries as I
from quireflow.operators import retrieval_queries as R
from quireflow.plans.workspace import release, tidy, written, written_so_far
from quireflow.sources.tables import first_arrivals, table


def _kept_hits(hits: DataFrame) -> DataFrame:
    """Hits written once for all that reads them; what finding them left on disk goes."""
    held = written(hits.select("query_id", "chunk_id", "rank"), "hits")
    tidy(hits.sparkSession)
    return held


def backend_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The same questions by text search, by term coverage, and by both fused."""
    text, cover = _kept_hits(R.text_hits(spark, folder, fusion.CANDIDATES)), _kept_hits(R._second_ranker(spark, folder))
    hits = {"text": text.where("rank <= 10"), "cover": cover.where("rank <= 10"), "fused": _kept_hits(R._fused(text, cover))}
    return E.compare({name: R._gold_ranks(spark, folder, h.select("query_id", "chunk_id", "rank")) for name, h in hits.items()})


def _table_questions(spark: SparkSession, folder: str) -> DataFrame:
    """For each table the name of its section and the first cell of its second row, asked within its manual."""
    rows = I.table_rows(spark, folder).where("place = 2")
    return rows.select(F.concat(F.lit("t:"), "element_id").alias("query_id"), F.concat_ws(" ", "section_text", F.col("cells")[0]["value"]).alias("question"), "doc_id", F.col("element_id").alias("gold"))


def table_recall(spark: SparkSession, folder: str) -> DataFrame:
    q = _table_questions(spark, folder)
    asked = bm25.query_terms(q, "question", T.TABLE_STOPWORDS).select("query_id", "term", "doc_id")
    hits = bm25.search(R.table_index(spark, folder), asked, 10, within="doc_id")
    found = hits.join(q.select("query_id", F.col("gold").alias("element_id")), ["query_id", "element_id"]).select("query_id", F.col("rank").alias("first_rank"))
    return E.recall(q.select("query_id").join(found, "query_id", "left"), at=(1, 5, 10))


#: Every so many-th row is asked for by a name no row has.
NO_ROW = 5


def _row_questions(spark: SparkSession, folder: str) -> DataFrame:
    """For each table row of two cells or more its first cell, asked for its second; some ask for what no row has."""
    rows = I.table_rows(spark, folder).where("size(cells) >= 2")
    known = F.col("place") % NO_ROW != 0
    name = F.when(known, F.col("cells")[0]["value"]).otherwise("qwyzzix vrombel")
    expected = F.when(known, F.array(F.coalesce(F.col("cells")[1]["value"], F.lit("")))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.concat(F.lit("r:"), "row_id").alias("query_id"), F.concat(F.lit("What is the value of "), F.coalesce(name, F.lit("")), F.lit("?")).alias("question"), "doc_id", F.col("row_id").alias("gold"), known.alias("answerable"), expected.alias("expected"))


def row_records(spark: SparkSession, folder: str) -> DataFrame:
    q = _row_questions(spark, folder)
    asked = bm25.query_terms(q, "question", T.TABLE_STOPWORDS).select("query_id", "term", "doc_id")
    hits = bm25.search(I.row_index(spark, folder), asked, 5, within="doc_id")
    rows = I.table_rows(spark, folder).select("row_id", F.col("section_text").alias("section"), "row_text")
    best = hits.where("rank = 1").join(rows, "row_id").select("query_id", "score", "section", "row_text")
    done = A.row_decisions(q.join(best, "query_id", "left"))
    found = hits.join(q.select("query_id", F.col("gold").alias("row_id")), ["query_id", "row_id"]).select("query_id", F.col("rank").alias("first_rank"))
    return done.join(found, "query_id", "left").select("query_id", "answerable", (F.col("status") == "answered").alias("answered"), "first_rank", F.coalesce("row_text", F.lit("")).alias("answer"), "expected", "reason")


def row_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return E.row_metrics(row_records(spark, folder))


def visual_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Images on the component's own page: by image labels alone and with the text hits of their pages, by split."""
    images = R.graph_nodes(spark, folder).where("node_type = 'Image' AND page_no IS NOT NULL").select("node_id", "doc_id", "page_no")
    q = R.questions(spark, folder).where("doc_id <> ''").join(images.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")
    split = q.select("query_id", F.when(F.col("template") % 2 == 0, "dev").otherwise("test").alias("split"))
    gold = q.select("query_id", "doc_id", "page_no").join(images, ["doc_id", "page_no"]).select("query_id", "node_id")
    alone = bm25.search(R.image_index(spark, folder), R.asked_terms(spark, folder), 10, within="doc_id").select("query_id", "node_id", "rank")
    fused = R.page_fusion(spark, folder).select("query_id", "node_id", "rank")
    first = lambda h: split.join(h.join(gold, ["query_id", "node_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank")), "query_id", "left")
    return E.compare({"images": first(alone), "images and text": first(fused)}, "split")


def gold_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that nodes name, looked up among the chunks' elements and the chunks: what is known of it, by node type."""
    nodes = first_arrivals(table(spark, folder, "graph_nodes"), "node_id", ["node_type", "doc_id", "page_no", "evidence_ids"])
    gold = nodes.select("node_type", "node_id", "doc_id", "page_no", F.explode("evidence_ids").alias("element_id")).where("element_id <> ''").distinct()
    c = R.chunks(spark, folder).select("chunk_id", "doc_id", "page_nos", "element_ids")
    none = F.array().cast("array<string>")
    named = c.select(F.explode(F.array_distinct(F.concat(F.array("chunk_id"), F.coalesce("element_ids", none)))).alias("element_id"), "doc_id", "page_nos").where("element_id <> ''")
    member = named.groupBy("element_id").agg(F.min("doc_id").alias("doc_id"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("page_nos", F.array().cast("array<int>"))))).alias("page_nos"))
    return E.verified_gold(gold, member).groupBy("node_type", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def lsa_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The text search's questions by latent semantic vectors, and by both fused by rank."""
    mark = written_so_far()
    texts = R.chunks(spark, folder).select(F.concat(F.lit("c:"), "chunk_id").alias("id"), F.concat_ws("\n", "metadata", "section_text", "content").alias("t"), "doc_id")
    q = R.questions(spark, folder)
    both = texts.unionByName(q.select(F.concat(F.lit("q:"), "query_id").alias("id"), F.col("question").alias("t"), "doc_id"))
    v = dense.lsa_of(both, "id", "t").join(both.select("id", "doc_id"), "id")
    hits = fusion.vector_search(v.where("id LIKE 'c:%'"), v.where("id LIKE 'q:%' AND doc_id <> ''"), "id", "vector", fusion.CANDIDATES, within="doc_id")
    dense_hits = _kept_hits(hits.select(F.substring("query_id", 3, 1_000_000).alias("query_id"), F.substring("id", 3, 1_000_000).alias("chunk_id"), "rank"))
    release(mark, keep=1)  # vectors
    text = _kept_hits(R.text_hits(spark, folder, fusion.CANDIDATES))
    fused = _kept_hits(fusion.reciprocal_rank_fusion(text, dense_hits, "chunk_id", 10, ("text", "dense")))
    systems = {"text": text.where("rank <= 10"), "dense": dense_hits.where("rank <= 10"), "hybrid": fused}
    return E.compare({n: R._gold_ranks(spark, folder, h.select("query_id", "chunk_id", "rank")) for n, h in systems.items()})


QUERIES = {f.__name__: f for f in (backend_comparison, table_recall, row_evaluation, visual_recall, gold_membership, lsa_recall)}

# --- SQL -----------------------------------------------------------------------------------------------------------


def _ranked(name: str, hits: str) -> str:
    return f"SELECT '{name}' AS system, query_id, first_rank FROM gold LEFT JOIN (SELECT h.query_id, min(h.rank) AS first_rank FROM ({hits}) h JOIN proof p USING (chunk_id) JOIN gold g USING (query_id) WHERE list_contains(g.gold, p.evidence) GROUP BY ALL) USING (query_id)"


_TABLE_Q = "questions AS (SELECT 't:' || element_id AS query_id, concat_ws(' ', section_text, cells[1].value) AS question, doc_id, element_id AS gold FROM trow WHERE place = 2)"
_ROW_Q = f"""questions AS (SELECT 'r:' || row_id AS query_id, 'What is the value of ' || coalesce(CASE WHEN place % {NO_ROW} <> 0 THEN cells[1].value ELSE 'qwyzzix vrombel' END, '') || '?' AS question, doc_id, row_id AS gold, place % {NO_ROW} <> 0 AS answerable,
  CASE WHEN place % {NO_ROW} <> 0 THEN coalesce(cells[2].value, '') END AS expected FROM trow WHERE len(cells) >= 2)"""
_CONFLICT = "contains(lower(section), 'excluding') AND contains(lower(section), 'hybrid') AND contains(lower(question), 'hybrid') AND NOT regexp_matches(lower(question), '\\b(?:non[- ]hybrid|excluding\\s+(?:the\\s+)?hybrid)\\b')"

SQL = {
    "backend_comparison": f"""WITH {R._QUESTIONS}, {R._CHUNKS}, gold AS (SELECT query_id, gold FROM questions WHERE len(gold) > 0), proof AS ({R._PROOF}),
every AS ({_ranked('text', R.SQL['bm25_search'])} UNION ALL {_ranked('cover', f"WITH {R._QUESTIONS}, {R._CHUNKS}, {R._COVER} SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= 10")} UNION ALL {_ranked('fused', R.SQL['rrf_hybrid'])})
SELECT system, {R._METRICS} FROM every GROUP BY system""",
    "table_recall": f"""WITH {R._TABLES}, {I._ROWS}, {_TABLE_Q}, {R._search('thits', 'tab', 'element_id', bm25.TABLE_WEIGHTS, 10, stopwords=T.TABLE_STOPWORDS)},
ranks AS (SELECT q.query_id, h.rank AS first_rank FROM questions q LEFT JOIN thits h ON h.query_id = q.query_id AND h.element_id = q.gold) SELECT {R._METRICS} FROM ranks""",
    "row_evaluation": f"""WITH {R._TABLES}, {I._ROWS}, {_ROW_Q}, {R._search('rhits', 'rown', 'row_id', bm25.ROW_WEIGHTS, 5, stopwords=T.TABLE_STOPWORDS)},
best AS (SELECT q.*, h.score, t.section_text AS section, coalesce(t.row_text, '') AS answer, g.rank AS first_rank FROM questions q LEFT JOIN (SELECT * FROM rhits WHERE rank = 1) h USING (query_id) LEFT JOIN trow t ON t.row_id = h.row_id LEFT JOIN rhits g ON g.query_id = q.query_id AND g.row_id = q.gold),
cov AS (SELECT *, round({O.coverage(O.plain_terms('question', T.TABLE_ANSWER_STOPWORDS), O.plain_terms("concat_ws(' ', section, answer)", T.TABLE_ANSWER_STOPWORDS))}, 6) AS c FROM best),
dec AS (SELECT *, coalesce(score >= {A.ROW_MIN_SCORE} AND NOT coalesce({_CONFLICT}, false) AND c >= {A.ROW_MIN_COVERAGE}, false) AS answered FROM cov)
SELECT count(*) AS questions, round(avg(CASE WHEN answerable THEN coalesce(first_rank <= 1, false)::INT END), 6) AS row_recall_1, round(avg(CASE WHEN answerable THEN coalesce(first_rank <= 5, false)::INT END), 6) AS row_recall_5, round(avg(answered::INT), 6) AS answer_rate,
 round(avg((answerable = answered)::INT), 6) AS decision_accuracy, round(avg(CASE WHEN NOT answerable THEN (NOT answered)::INT END), 6) AS no_answer_accuracy, round(avg(CASE WHEN answerable THEN (answered AND contains(lower(answer), lower(expected)))::INT END), 6) AS exact_value_accuracy FROM dec""",
    "visual_recall": f"""WITH {R._QUESTIONS}, {R._NODE}, image AS (SELECT * FROM node WHERE node_type = 'Image'), {R._search('seen', 'image', 'node_id', bm25.NODE_WEIGHTS, 10)}, fused AS (SELECT query_id, node_id, rank FROM ({R.SQL['page_fusion']})),
gold AS (SELECT q.query_id, CASE WHEN q.template % 2 = 0 THEN 'dev' ELSE 'test' END AS split, i.node_id FROM questions q JOIN image i ON i.doc_id = q.doc_id AND i.page_no = q.page_no WHERE q.doc_id <> ''),
every AS ({" UNION ALL ".join(f"SELECT '{n}' AS system, g.query_id, g.split, min(h.rank) AS first_rank FROM gold g LEFT JOIN {t} h ON h.query_id = g.query_id AND h.node_id = g.node_id GROUP BY ALL" for n, t in (('images', 'seen'), ('images and text', 'fused')))})
SELECT system, split, {R._METRICS} FROM every GROUP BY system, split""",
    "gold_membership": f"""WITH {R._CHUNKS}, gold AS (SELECT DISTINCT node_type, node_id, doc_id, page_no, element_id FROM (SELECT node_type, node_id, doc_id, page_no, unnest(evidence_ids) AS element_id FROM {O.first('graph_nodes', 'node_id', '*')}) WHERE element_id <> ''),
named AS (SELECT unnest(list_distinct(list_concat([chunk_id], coalesce(element_ids, [])))) AS element_id, doc_id, coalesce(page_nos, []) AS page_nos FROM chunk),
member AS (SELECT element_id, min(doc_id) AS m_doc, flatten(list(page_nos)) AS m_pages FROM named WHERE element_id <> '' GROUP BY element_id)
SELECT node_type, CASE WHEN m_doc IS NULL THEN 'unknown' WHEN m_doc <> doc_id THEN 'document' WHEN page_no IS NOT NULL AND NOT coalesce(list_contains(m_pages, page_no), false) THEN 'page' ELSE 'none' END AS problem, count(*) AS n FROM gold LEFT JOIN member USING (element_id) GROUP BY ALL""",
}
