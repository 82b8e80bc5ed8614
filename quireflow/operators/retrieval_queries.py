"""Queries of search, ranking, fusion and answering over the manual tables, with their SQL.

Questions are made of the labels of a manual's components, by several templates: procedures, facts, values, warnings, and
some without a manual, without a word of the corpus, or without an answer. What answers one is the evidence its node names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.functions import oracle as O
from quireflow.functions import text as T
from quireflow.operators import bm25
from quireflow.operators import answering as A
from quireflow.operators import evaluation as E
from quireflow.operators import fusion
from quireflow.operators.matches import best_matches
from quireflow.plans.workspace import fingerprint, in_turns, kept, tidy, written
from quireflow.sources.tables import first_arrivals, table

META = ["doc_id", "brand", "model", "year", "region", "language", "manual_type"]
_CHUNK_COLUMNS = [*META, "page_nos", "section_path", "section_text", "chunk_type", "content", "element_ids"]


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    one = first_arrivals(table(spark, folder, "chunks"), "chunk_id", _CHUNK_COLUMNS)
    return one.withColumn("section_text", T.section_text(F.col("section_path"))).withColumn("metadata", T.metadata_text())


#: Question templates by the last character of a node's id; ``{}`` is the component's label.
TEMPLATES = (
    "How do I use the {}?", "What is the {}?", "Which warning applies to the {}?", "Where is the {} shown?", "What is the torque or capacity of the {}?",
    "What does the {} indicate and what happens then?", "Qwyzzix vrombel?", "How do I calibrate the {} flux interlock?",
)
#: The template no manual answers, and the place of ids at which questions name no manual.
UNANSWERED, WITHOUT_MANUAL = (6, 7), 9


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, question, doc_id ('' where none is named), gold (evidence ids; none where no answer is expected), template, of
    every component node. Kept, as all searches begin at them."""
    mark = fingerprint(spark, [f"{folder}/graph_nodes.parquet"], TEMPLATES, UNANSWERED, WITHOUT_MANUAL)

    def make(path: str) -> None:
        _questions(spark, folder).write.parquet(path)
        tidy(spark)

    return spark.read.parquet(kept(spark, f"questions-{mark}", make))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    nodes = first_arrivals(table(spark, folder, "graph_nodes"), "node_id", ["node_type", "label", "doc_id", "evidence_ids", "page_no", "section_path"])
    last = F.ascii(F.right("node_id", F.lit(1)))
    t = (last % len(TEMPLATES)).alias("template")
    nodes = nodes.where("node_type = 'Component'").select("node_id", "label", "doc_id", "evidence_ids", "page_no", t, (last % 16 == WITHOUT_MANUAL).alias("bare"))
    asked = F.lit(TEMPLATES[0])
    for i, text in enumerate(TEMPLATES):
        asked = F.when(F.col("template") == i, F.lit(text)).otherwise(asked)
    gold = F.when(F.col("template").isin(*UNANSWERED), F.array().cast("array<string>")).otherwise(F.filter("evidence_ids", lambda e: e != ""))
    return nodes.select(
        F.col("node_id").alias("query_id"), F.replace(asked, F.lit("{}"), "label").alias("question"), F.when(F.col("bare"), "").otherwise(F.col("doc_id")).alias("doc_id"),
        gold.alias("gold"), "template", "page_no",
    )


def asked_terms(spark: SparkSession, folder: str, stopwords=T.TEXT_STOPWORDS, template: int | None = None) -> DataFrame:
    q = questions(spark, folder)
    return bm25.query_terms(q if template is None else q.where(F.col("template") == template), "question", stopwords).select("query_id", "term", "doc_id")


def _index(spark: SparkSession, folder: str, name: str, records, key: str, weights: dict[str, float], source: str, analyze=None, root: str | None = None) -> bm25.Index:
    mark = fingerprint(spark, [f"{folder}/{source}.parquet"], key, weights)
    return bm25.index_of(spark, name, records(spark, folder), key, weights, mark, within="doc_id", analyze=analyze, root=root)


def text_index(spark: SparkSession, folder: str, root: str | None = None) -> bm25.Index:
    return _index(spark, folder, "text", chunks, "chunk_id", bm25.TEXT_WEIGHTS, "chunks", root=root)


def table_index(spark: SparkSession, folder: str, root: str | None = None) -> bm25.Index:
    return _index(spark, folder, "tables", _tables, "element_id", bm25.TABLE_WEIGHTS, "table_elements", root=root)


def node_index(spark: SparkSession, folder: str, root: str | None = None) -> bm25.Index:
    return _index(spark, folder, "nodes", graph_nodes, "node_id", bm25.NODE_WEIGHTS, "graph_nodes", root=root)


def image_index(spark: SparkSession, folder: str, root: str | None = None) -> bm25.Index:
    return _index(spark, folder, "images", lambda s, f: graph_nodes(s, f).where("node_type = 'Image'"), "node_id", bm25.NODE_WEIGHTS, "graph_nodes", root=root)


def text_hits(spark: SparkSession, folder: str, limit: int | None = 10) -> DataFrame:
    return bm25.search(text_index(spark, folder), asked_terms(spark, folder), limit, within="doc_id")


def fts_query_terms(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder)
    return q.select("query_id", T.match_expression(F.col("question")).alias("expression"), F.array_join(T.search_terms(F.col("question"), T.TABLE_STOPWORDS), " ").alias("table_terms"), F.array_join(T.dense_terms(F.col("question")), " ").alias("dense_terms"))


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    return text_hits(spark, folder).select("query_id", "chunk_id", "score", "rank")


def bm25_unfiltered(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.search(text_index(spark, folder), asked_terms(spark, folder).drop("doc_id"), 10).select("query_id", "chunk_id", "score", "rank")


def bm25_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """The same, by bounds that leave common terms out where nothing can come of them."""
    return bm25.pruned_search(text_index(spark, folder), asked_terms(spark, folder).drop("doc_id"), 10).select("query_id", "chunk_id", "score", "rank")


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    one = first_arrivals(table(spark, folder, "table_elements"), "element_id", [*META, "page_no", "section_path", "content", "asset_path"])
    return one.withColumn("section_text", T.section_text(F.col("section_path"))).withColumn("metadata", T.metadata_text())


def bm25_tables(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.search(table_index(spark, folder), asked_terms(spark, folder, T.TABLE_STOPWORDS), 10, within="doc_id").select("query_id", "element_id", "score", "rank")


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    one = first_arrivals(table(spark, folder, "graph_nodes"), "node_id", [*META, "node_type", "label", "text", "section_path", "evidence_ids", "page_no", "asset_path"])
    return one.withColumn("section_json", F.concat(F.lit("["), F.array_join("section_path", ", "), F.lit("]")))


def bm25_entities(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.search(node_index(spark, folder), asked_terms(spark, folder, T.GRAPH_STOPWORDS), 8, within="doc_id").select("query_id", "node_id", "score", "rank")


def bm25_index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What the kept text index holds."""
    index = text_index(spark, folder)
    posted = index.postings.agg(F.countDistinct("chunk_id").alias("n_rows"), F.countDistinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"), F.round(F.sum("tf"), 3).alias("weight"))
    documents = index.postings.agg(F.countDistinct("doc_id").alias("documents"))
    return posted.withColumn("documents", F.lit(documents.first()[0])).withColumn("records", F.lit(index.stats.first()["n"]))


#: Distinct terms of a chunk, about.
TERMS_A_CHUNK = 64


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once for all that reads it; what finding it left on disk goes."""
    df = written(df, name)
    tidy(df.sparkSession)
    return df


def _second_ranker(spark: SparkSession, folder: str) -> DataFrame:
    """Another ranking of the same chunks: how much of the question's terms the section covers, then the content."""
    q = questions(spark, folder).select("query_id", "doc_id", T.answer_terms(F.col("question")).alias("terms"))
    c = chunks(spark, folder).select("chunk_id", "doc_id", F.explode(T.answer_terms(F.concat_ws("\n", "section_text", "content"))).alias("term"), F.lit(1).cast("bigint").alias("value"))
    asked = F.broadcast(q.select(F.explode("terms").alias("term")).distinct())
    sizes = table(spark, folder, "chunks").groupBy("doc_id").agg((F.count(F.lit(1)) * TERMS_A_CHUNK).alias("n"))
    scored = best_matches(q, c.join(asked, "term"), "chunk_id", fusion.CANDIDATES, sizes, "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "chunk_id"))).where(F.col("rank") <= fusion.CANDIDATES)
    return ranked.select("query_id", "chunk_id", "rank")


def _fused(text: DataFrame, cover: DataFrame) -> DataFrame:
    return fusion.reciprocal_rank_fusion(text, cover, "chunk_id", limit=10, names=("text", "cover"))


def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    sides = [held(hits.select("query_id", "chunk_id", "rank"), "hits") for hits in (text_hits(spark, folder, fusion.CANDIDATES), _second_ranker(spark, folder))]
    fused = in_turns(sides, "query_id", _fused, "fused")
    return fused.select("query_id", "chunk_id", "text_rank", "cover_rank", "rrf_score", "rank")


def page_fusion(spark: SparkSession, folder: str, template: int | None = None) -> DataFrame:
    """Image hits of each question, or of those of one template, joined with the best text hit of their page."""
    asked = asked_terms(spark, folder, template=template)
    hits = bm25.search(text_index(spark, folder), asked, 50, within="doc_id").join(chunks(spark, folder).select("chunk_id", "doc_id", "page_nos"), "chunk_id")
    images = graph_nodes(spark, folder).where("node_type = 'Image'").select("node_id", "doc_id", "page_no")
    visual = bm25.search(image_index(spark, folder), asked, 50, within="doc_id").join(images, "node_id")
    return fusion.page_fusion(visual, hits, "node_id", limit=10).select("query_id", "node_id", "visual_rank", "text_rank", "rrf_score", "rank")


def dense_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return fusion.vector_search(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", limit=10)


def dense_filtered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return fusion.vector_search(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", limit=10, within="label")


def _packs(spark: SparkSession, folder: str, limit: int = 3) -> DataFrame:
    return A.evidence_packs(text_hits(spark, folder), chunks(spark, folder), questions(spark, folder), limit)


def held_packs(spark: SparkSession, folder: str) -> DataFrame:
    return held(_packs(spark, folder), "packs")


def evidence_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _packs(spark, folder).select("query_id", "citation_id", "chunk_id", "retrieval_rank", "retrieval_score", "query_term_coverage", "procedure_support", "rerank_score", "content", "source")


def answer_decision(spark: SparkSession, folder: str, packs: DataFrame | None = None) -> DataFrame:
    return A.decisions(questions(spark, folder), _packs(spark, folder) if packs is None else packs).select("query_id", "status", "reason", "confidence", "n_evidence")


def answer_text(spark: SparkSession, folder: str) -> DataFrame:
    return A.answers(questions(spark, folder), _packs(spark, folder)).select("query_id", "status", "answer")


def answer_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each question's decision, whether it was to be answered, and whether a cited piece is or holds its evidence."""
    done = A.decisions(questions(spark, folder), _packs(spark, folder))
    cited = F.coalesce(F.arrays_overlap(F.concat("cited", "cited_chunks"), "gold"), F.lit(False))
    return done.select("query_id", "status", "reason", (F.size("gold") > 0).alias("answerable"), (F.col("status") == "answered").alias("answered"), cited.alias("hit"))


def answer_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return E.answer_metrics(answer_records(spark, folder))


def _gold_ranks(spark: SparkSession, folder: str, hits: DataFrame) -> DataFrame:
    """query_id, category, first_rank: the best rank of a chunk that is a question's evidence or holds it."""
    q = questions(spark, folder).where(F.size("gold") > 0)
    proofs = F.explode(F.array_distinct(F.concat(F.array("chunk_id"), F.coalesce("element_ids", F.array().cast("array<string>"))))).alias("evidence")
    gold = q.select("query_id", F.explode("gold").alias("evidence"))
    sought = gold.join(chunks(spark, folder).select("chunk_id", proofs), "evidence").select("query_id", "chunk_id").distinct()  # fewer rows than what hits hold
    first = hits.select("query_id", "chunk_id", "rank").join(sought, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return q.select("query_id", F.concat(F.lit("template "), F.col("template").cast("string")).alias("category")).join(first, "query_id", "left")


def _first_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return _gold_ranks(spark, folder, text_hits(spark, folder))


def recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    return E.recall(_first_ranks(spark, folder))


def recall_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return E.recall(_first_ranks(spark, folder), "category")


def route_plan(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder).unionByName(table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("question"), F.lit("").alias("doc_id"), F.array().cast("array<string>").alias("gold"), F.lit(0).alias("template"), F.lit(None).cast("int").alias("page_no")))
    return A.routes(q, "question").select("query_id", "intent", "multi_hop", "use_text", "use_table", "use_graph", "use_visual")


QUERIES = {f.__name__: f for f in (fts_query_terms, bm25_search, bm25_unfiltered, bm25_pruned, bm25_tables, bm25_entities, bm25_index_stats, rrf_hybrid, page_fusion, dense_search, dense_filtered, evidence_pack, answer_decision, answer_text, answer_metrics, recall_mrr, recall_by_category, route_plan)}

# --- SQL -----------------------------------------------------------------------------------------------------------

_NODES = O.first("graph_nodes", "node_id", "*")
_LAST = "ascii(right(node_id, 1))"
_ASKED = f"replace(CASE {_LAST} % {len(TEMPLATES)} " + " ".join(f"WHEN {i} THEN {O.lit(t)}" for i, t in enumerate(TEMPLATES)) + " END, '{}', label)"
_QUESTIONS = f"""questions AS (SELECT node_id AS query_id, {_ASKED} AS question, CASE WHEN {_LAST} % 16 = {WITHOUT_MANUAL} THEN '' ELSE doc_id END AS doc_id,
  CASE WHEN {_LAST} % {len(TEMPLATES)} IN {UNANSWERED} THEN []::VARCHAR[] ELSE list_filter(evidence_ids, lambda e: e <> '') END AS gold, {_LAST} % {len(TEMPLATES)} AS template, page_no FROM {_NODES} WHERE node_type = 'Component')"""
_CHUNKS = f"chunk AS (SELECT * REPLACE (array_to_string(section_path, ' > ') AS section_text), {O.metadata_text()} AS metadata FROM {O.first('chunks', 'chunk_id', '*')})"
_TABLES = f"tab AS (SELECT * REPLACE (array_to_string(section_path, ' > ') AS section_text), {O.metadata_text()} AS metadata FROM {O.first('table_elements', 'element_id', '*')})"
_NODE = f"node AS (SELECT *, '[' || array_to_string(section_path, ', ') || ']' AS section_json FROM {_NODES})"


def _search(name: str, source: str, key: str, weights: dict[str, float], limit: int | None, within: bool = True, stopwords=T.TEXT_STOPWORDS) -> str:
    parts = " UNION ALL ".join(f"SELECT {key} AS k, doc_id, unnest({O.tokens(c)}) AS term, {i} AS c FROM {source}" for i, c in enumerate(weights))
    tf = " + ".join(f"count(CASE WHEN c = {i} THEN 1 END) * {w}::DOUBLE" for i, w in enumerate(weights.values()))
    return f"""
{name}_t AS MATERIALIZED ({parts}),
{name}_p AS MATERIALIZED (SELECT k, doc_id, term, {tf} AS tf FROM {name}_t GROUP BY ALL),
{name}_l AS (SELECT k, count(*) AS length FROM {name}_t GROUP BY k),
{name}_s AS (SELECT (SELECT count(*) FROM {source}) AS n, (SELECT sum(length) FROM {name}_l) / (SELECT count(*) FROM {source}) AS mean),
{name}_d AS (SELECT term, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM {name}_p, {name}_s GROUP BY term, n),
{name}_q AS (SELECT query_id, doc_id, unnest({O.search_terms('question', stopwords)}) AS term FROM questions),
{name}_r AS (SELECT query_id, k, sum(round(idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) * 1e12::DOUBLE)::BIGINT) AS s
  FROM {name}_q q JOIN {name}_p p ON p.term = q.term {'AND p.doc_id = q.doc_id' if within else ''} JOIN {name}_d d ON d.term = p.term JOIN {name}_l USING (k), {name}_s GROUP BY ALL),
{name} AS MATERIALIZED (SELECT query_id, k AS {key}, round(s / 1e12::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, k)::INT AS rank FROM {name}_r {f'QUALIFY rank <= {limit}' if limit else ''})"""


def _hits(limit: int) -> str:
    return f"WITH {_QUESTIONS}, {_CHUNKS}, {_search('hits', 'chunk', 'chunk_id', bm25.TEXT_WEIGHTS, limit)}"


_COVER = f"""cover_w AS (SELECT query_id, doc_id, {O.answer_terms('question')} AS wanted FROM questions),
cover_c AS (SELECT chunk_id, doc_id, unnest({O.answer_terms("concat_ws(chr(10), section_text, content)")}) AS term FROM chunk),
cover_q AS (SELECT query_id, doc_id, len(wanted) AS n, unnest(wanted) AS term FROM cover_w),
cover AS (SELECT query_id, chunk_id, round(count(*) / n, 6) AS score FROM cover_q JOIN cover_c USING (doc_id, term) GROUP BY query_id, chunk_id, n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM cover QUALIFY rank <= 50)"""

_PACK = f"""joined AS (SELECT h.query_id, h.score, h.rank, c.*, q.question, q.gold FROM hits h JOIN chunk c USING (chunk_id) JOIN questions q USING (query_id)),
termed AS (SELECT *, {O.answer_terms('question')} AS wanted, {O.answer_terms("section_text || chr(10) || content")} AS had, {O.answer_terms('section_text')} AS had_section,
  (chunk_type = 'steps' OR regexp_matches(content, {O.lit(T.PROCEDURE_CONTENT)}) OR regexp_matches(array_to_string(section_path, ' '), {O.lit(T.PROCEDURE_SECTION)})) AS procedure_support FROM joined),
covered AS (SELECT *, {O.coverage('wanted', 'had')} AS cover, {O.coverage('wanted', 'had_section')} AS cover_section FROM termed),
scored AS (SELECT *, least(0.55 * least(score / 20, 1) + 0.35 * cover + 0.10 * cover_section + CASE WHEN regexp_matches(question, {O.lit(T.PROCEDURE_QUERY)}) AND procedure_support THEN 0.08 ELSE 0 END, 1.0) AS raw FROM covered),
pack AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, rank)::INT AS citation_id, chunk_id, rank AS retrieval_rank, score AS retrieval_score,
  round(cover, 6) AS query_term_coverage, procedure_support, round(raw, 6) AS rerank_score, {O.compact('content', 900, '…', False)} AS content, {O.source_label('section_path', 'page_nos')} AS source, chunk_type, element_ids, gold, question
  FROM scored QUALIFY citation_id <= 3)"""
_DECIDE = f"""top AS (SELECT * FROM pack WHERE citation_id = 1), counted AS (SELECT query_id, count(*) AS n_evidence, bool_or(procedure_support) AS any_support FROM pack GROUP BY query_id),
decided AS (SELECT q.query_id, q.gold, coalesce(n_evidence, 0) AS n_evidence, coalesce(rerank_score, 0.0) AS confidence,
  CASE WHEN trim(coalesce(q.doc_id, '')) = '' THEN 'needs_vehicle_context' WHEN n_evidence IS NULL THEN 'no_retrieval_results'
       WHEN regexp_matches(q.question, {O.lit(T.PROCEDURE_QUERY)}) AND NOT t.procedure_support THEN 'procedure_not_supported'
       WHEN t.retrieval_score < 12.0 OR t.rerank_score < 0.55 THEN 'evidence_below_threshold' ELSE 'answered' END AS reason
  FROM questions q LEFT JOIN top t USING (query_id) LEFT JOIN counted USING (query_id)),
final AS (SELECT *, CASE reason WHEN 'answered' THEN 'answered' WHEN 'needs_vehicle_context' THEN 'needs_context' ELSE 'refused' END AS status FROM decided)"""
_PROOF = "SELECT chunk_id, unnest(list_distinct(list_concat([chunk_id], coalesce(element_ids, [])))) AS evidence FROM chunk"


def _ranks(hits: str = "hits") -> str:
    return f"""gold AS (SELECT query_id, template, gold FROM questions WHERE len(gold) > 0), proof AS ({_PROOF}),
found AS (SELECT h.query_id, min(h.rank) AS first_rank FROM {hits} h JOIN proof p USING (chunk_id) JOIN gold g USING (query_id) WHERE list_contains(g.gold, p.evidence) GROUP BY ALL),
ranks AS (SELECT query_id, 'template ' || template AS category, first_rank FROM gold LEFT JOIN found USING (query_id))"""


_METRICS = "count(*) AS questions, round(avg(CASE WHEN first_rank <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first_rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN first_rank <= 10 THEN 1 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(CASE WHEN first_rank <= 10 THEN 1 / first_rank END, 0)), 6) AS mrr_10"
_DENSE_KEPT = f"list_filter({O.tokens('question')}, lambda t: NOT list_contains({O.words(T.TEXT_STOPWORDS)}, t) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$')))"


def _vectors(within: bool) -> str:
    return f"""
WITH pairs AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))) AS s
  FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id {'AND q.label = r.label' if within else ''})
SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id)::INT AS rank FROM pairs QUALIFY rank <= 10"""


SQL = {
    "fts_query_terms": f"""WITH {_QUESTIONS}, k AS (SELECT query_id, question, {_DENSE_KEPT} AS kept FROM questions)
SELECT query_id, array_to_string(list_transform({O.search_terms('question')}, lambda t: '"' || t || '"'), ' OR ') AS expression, array_to_string({O.search_terms('question', T.TABLE_STOPWORDS)}, ' ') AS table_terms,
  array_to_string(list_concat(kept, list_transform(range(1, len(kept)), lambda i: kept[i] || '_' || kept[i + 1])), ' ') AS dense_terms FROM k""",
    "bm25_search": _hits(10) + " SELECT * FROM hits",
    "bm25_unfiltered": f"WITH {_QUESTIONS}, {_CHUNKS}, {_search('hits', 'chunk', 'chunk_id', bm25.TEXT_WEIGHTS, 10, within=False)} SELECT * FROM hits",
    "bm25_pruned": f"WITH {_QUESTIONS}, {_CHUNKS}, {_search('hits', 'chunk', 'chunk_id', bm25.TEXT_WEIGHTS, 10, within=False)} SELECT * FROM hits",
    "bm25_tables": f"WITH {_QUESTIONS}, {_TABLES}, {_search('hits', 'tab', 'element_id', bm25.TABLE_WEIGHTS, 10, stopwords=T.TABLE_STOPWORDS)} SELECT * FROM hits",
    "bm25_entities": f"WITH {_QUESTIONS}, {_NODE}, {_search('hits', 'node', 'node_id', bm25.NODE_WEIGHTS, 8, stopwords=T.GRAPH_STOPWORDS)} SELECT * FROM hits",
    "bm25_index_stats": _hits(10) + " SELECT count(DISTINCT k) AS n_rows, count(DISTINCT term) AS n_terms, count(*) AS n_postings, round(sum(tf), 3)::DOUBLE AS weight, count(DISTINCT doc_id) AS documents, (SELECT n FROM hits_s) AS records FROM hits_p",
    "rrf_hybrid": _hits(50)
    + f""", {_COVER}, fused AS (SELECT coalesce(h.query_id, r.query_id) AS query_id, coalesce(h.chunk_id, r.chunk_id) AS chunk_id, h.rank AS text_rank, r.rank AS cover_rank,
  round(coalesce(1.0 / (60 + h.rank), 0) + coalesce(1.0 / (60 + r.rank), 0), 15) AS rrf_score FROM hits h FULL JOIN ranked r ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id)::INT AS rank FROM fused QUALIFY rank <= 10""",
    "page_fusion": _hits(50)
    + f""", {_NODE}, image AS (SELECT * FROM node WHERE node_type = 'Image'), {_search('seen', 'image', 'node_id', bm25.NODE_WEIGHTS, 50)},
pages AS (SELECT query_id, doc_id, page_no, min(rank) AS rank FROM (SELECT h.query_id, c.doc_id, unnest(c.page_nos) AS page_no, h.rank FROM hits h JOIN chunk c USING (chunk_id)) GROUP BY ALL),
fused AS (SELECT s.query_id, s.node_id, s.rank AS visual_rank, p.rank AS text_rank, round(1.0 / (60 + s.rank) + coalesce(1.0 / (60 + p.rank), 0), 15) AS rrf_score
  FROM seen s JOIN image i USING (node_id) LEFT JOIN pages p ON p.query_id = s.query_id AND p.doc_id = i.doc_id AND p.page_no = i.page_no)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, node_id)::INT AS rank FROM fused QUALIFY rank <= 10""",
    "dense_search": _vectors(False),
    "dense_filtered": _vectors(True),
    "evidence_pack": _hits(10) + f", {_PACK} SELECT query_id, citation_id, chunk_id, retrieval_rank, retrieval_score, query_term_coverage, procedure_support, rerank_score, content, source FROM pack",
    "answer_decision": _hits(10) + f", {_PACK}, {_DECIDE} SELECT query_id, status, reason, confidence, n_evidence FROM final",
    "answer_text": _hits(10)
    + f""", {_PACK}, {_DECIDE}, body AS (SELECT query_id, string_agg('[' || citation_id || '] ' || content, chr(10) ORDER BY citation_id) AS lines, string_agg('[' || citation_id || '] ' || source, chr(10) ORDER BY citation_id) AS sources, bool_or(chunk_type IN ('warning', 'caution')) AS safety FROM pack GROUP BY query_id)
SELECT query_id, status, CASE WHEN status = 'answered' THEN {O.lit(A.HEADER)} || chr(10) || lines || CASE WHEN safety THEN chr(10) || {O.lit(A.SAFETY_NOTE)} ELSE '' END || chr(10) || 'Sources:' || chr(10) || sources ELSE {O.lit(A.REFUSAL)} END AS answer FROM final LEFT JOIN body USING (query_id)""",
    "answer_metrics": _hits(10)
    + f""", {_PACK}, {_DECIDE}, cited AS (SELECT query_id, list_concat(flatten(list(coalesce(element_ids, []))), list(chunk_id)) AS cited FROM pack GROUP BY query_id), e AS (SELECT *, len(gold) > 0 AS known, coalesce(list_has_any(cited, gold), false) AS hit FROM final LEFT JOIN cited USING (query_id))
SELECT count(*) AS questions, round(avg(((status = 'answered') = known)::INT), 6) AS decision_accuracy, round(avg(CASE WHEN known THEN (status = 'answered')::INT END), 6) AS response_rate, round(avg(CASE WHEN known THEN (status = 'answered' AND hit)::INT END), 6) AS citation_recall, round(avg(CASE WHEN NOT known THEN (status = 'refused')::INT END), 6) AS no_answer_accuracy FROM e""",
    "recall_mrr": _hits(10) + f", {_ranks()} SELECT {_METRICS} FROM ranks",
    "recall_by_category": _hits(10) + f", {_ranks()} SELECT category, {_METRICS} FROM ranks GROUP BY category",
    "route_plan": f"""WITH {_QUESTIONS}, q AS (SELECT query_id, question FROM questions UNION ALL SELECT doc_id::VARCHAR, text FROM documents WHERE text IS NOT NULL),
r AS (SELECT query_id, regexp_matches(question, {O.lit(T.ROUTE_TABLE)}) AS t, regexp_matches(question, {O.lit(T.ROUTE_PROCEDURE)}) AS p, regexp_matches(question, {O.lit(T.ROUTE_GRAPH)}) OR regexp_matches(question, {O.lit(T.ROUTE_PROCEDURE)}) OR regexp_matches(question, {O.lit(T.ROUTE_CLAUSES)}) AS m FROM q)
SELECT query_id, CASE WHEN t THEN 'exact_value' WHEN p THEN 'procedure' ELSE 'fact' END AS intent, m AS multi_hop, true AS use_text, t AS use_table, m AS use_graph, false AS use_visual FROM r""",
}
