"""Queries of evidence merging, critic, guard and evaluation; and of vectors, stems and images, which SQL cannot make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import oracle as O
from quireflow.functions import porter
from quireflow.operators import agentic as G
from quireflow.operators import bm25, dense, fusion
from quireflow.operators import evaluation as E
from quireflow.operators import graph_queries as Q
from quireflow.operators import ingest_queries as I
from quireflow.operators import retrieval_queries as R
from quireflow.operators import answering as A
from quireflow.operators.answering import REFUSAL
from quireflow.plans.workspace import written
from quireflow.sources.tables import table

META = R.META


#: Questions of this template come with an image, the figure they ask for.
WITH_IMAGE = 3


def manuals(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and m, the manual's fields as the manifest has them."""
    m = table(spark, folder, "manifest").groupBy("doc_id").agg(F.min(F.struct(*META)).alias("m"))
    return m.where(F.col("doc_id").isNotNull())


def planned(spark: SparkSession, folder: str, broaden: bool = False) -> DataFrame:
    q = R.questions(spark, folder)
    image = F.when(F.col("template") == WITH_IMAGE, F.lit("image"))
    return A.routes(q, "question", image=image, broaden=broaden)


def image_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Images of questions that come with one, by page fusion."""
    return R.page_fusion(spark, folder, WITH_IMAGE).select("query_id", "node_id", "rank", F.col("rrf_score").alias("score"))


#: Columns of evidence, and those that only its comparison with gold evidence needs.
_EVIDENCE_COLUMNS, _DETAILS = ("query_id", "source", "rank", "score", "doc_id", "pages", "identity"), ("element_ids", "page_nos", "content")


def common_evidence(spark: SparkSession, folder: str, details: bool = True, packs: DataFrame | None = None, found: DataFrame | None = None, sources: tuple[str, ...] = ("text", "table", "graph", "visual")) -> DataFrame:
    """Pieces of text, tables, images and graph of each question in one form: query_id, source, rank, score, doc_id, pages,
    identity, element_ids, page_nos, content (these with ``details``), is_foreign (another manual than the question's, in any of
    its fields). Each source is found and written by itself; what finding it left on disk goes before the next. ``packs`` and
    ``found``: the text's packs and the graph's paths, where they are written already."""
    none = F.array().cast("array<string>")
    ints = lambda c: F.coalesce(c, F.array().cast("array<int>"))

    def text() -> DataFrame:
        held = R._packs(spark, folder) if packs is None else packs
        df = held.select("query_id", "chunk_id", F.col("citation_id").alias("rank"), F.col("rerank_score").alias("score")).join(R.chunks(spark, folder), "chunk_id")
        return df.select("query_id", F.lit("text").alias("source"), "rank", "score", F.struct(*META).alias("e"), ints(F.col("page_nos")).alias("page_nos"), F.col("chunk_id").alias("identity"), F.array_union(F.coalesce("element_ids", none), F.array("chunk_id")).alias("element_ids"), "content")

    def rows() -> DataFrame:
        df = I.table_row_search(spark, folder).join(I.table_rows(spark, folder), "row_id")
        return df.select("query_id", F.lit("table").alias("source"), "rank", "score", F.struct(*META).alias("e"), F.array_compact(F.array("page_no")).alias("page_nos"), F.col("row_id").alias("identity"), F.array("element_id").alias("element_ids"), F.col("row_text").alias("content"))

    def paths() -> DataFrame:
        df = Q.records(spark, folder, found, content=details)
        df = df if details else df.withColumn("content", F.lit(None).cast("string"))
        return df.select("query_id", F.lit("graph").alias("source"), "rank", "score", F.struct(*META).alias("e"), "page_nos", F.array_join(F.array_sort("evidence_ids"), ",").alias("identity"), F.col("evidence_ids").alias("element_ids"), "content")

    def images() -> DataFrame:
        df = image_hits(spark, folder).join(R.graph_nodes(spark, folder), "node_id")
        return df.select("query_id", F.lit("visual").alias("source"), "rank", "score", F.struct(*META).alias("e"), F.array_compact(F.array("page_no")).alias("page_nos"), F.col("node_id").alias("identity"), F.coalesce("evidence_ids", none).alias("element_ids"), F.coalesce("text", F.lit("")).alias("content"))

    wanted = R.questions(spark, folder).select("query_id", "doc_id").join(manuals(spark, folder), "doc_id", "left").select("query_id", "m")
    pages = F.array_join(F.transform(F.array_sort("page_nos"), lambda p: p.cast("string")), ",")
    parts = []
    for name, pieces in (("text", text), ("table", rows), ("graph", paths), ("visual", images)):
        if name in sources:
            one = pieces().join(wanted, "query_id").withColumn("doc_id", F.col("e.doc_id")).withColumn("pages", pages).withColumn("is_foreign", E.violates("e", "m"))
            parts.append(R.held(one.select(*_EVIDENCE_COLUMNS, *_DETAILS * details, "is_foreign"), "evidence"))
    return I.I.union_all(parts)


def evidence_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = G.merge_evidence(common_evidence(spark, folder, details=False))
    return merged.select("query_id", "citation_id", "source", "identity", "doc_id", "is_foreign")


def metadata_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of evidence whose manual's fields differ from what was asked for, by source."""
    return E.violations(common_evidence(spark, folder, details=False), "source")


def _support(spark: SparkSession, folder: str, evidence: DataFrame, packs: DataFrame) -> DataFrame:
    e = evidence.groupBy("query_id").agg(F.max(F.when((F.col("source") == "graph") & (F.col("rank") == 1), F.col("score"))).alias("graph_score"), (F.count_if(F.col("source") == "visual") > 0).alias("visual_ok"), F.count_if("is_foreign").cast("int").alias("violations"))
    text = R.answer_decision(spark, folder, packs).select("query_id", (F.col("status") == "answered").alias("text_ok"))
    rows = R.held(I.table_answer(spark, folder).select("query_id", (F.col("status") == "answered").alias("table_ok")), "rows")
    df = text.join(rows, "query_id", "left").join(e, "query_id", "left")
    return df.withColumn("visual_ok", F.coalesce("visual_ok", F.lit(False))).withColumn("violations", F.coalesce("violations", F.lit(0)))


def critic_decisions(spark: SparkSession, folder: str, evidence: DataFrame | None = None, packs: DataFrame | None = None) -> DataFrame:
    """The critic's decision on the first plan, and on the broadened one for questions that were to be planned anew."""
    packs = R.held_packs(spark, folder) if packs is None else packs
    evidence = common_evidence(spark, folder, details=False, packs=packs) if evidence is None else evidence
    support = R.held(_support(spark, folder, evidence, packs), "support")
    plan = lambda broaden: planned(spark, folder, broaden).select("query_id", "use_graph", "use_visual")
    first = G.critic(support.join(plan(False), "query_id").withColumn("attempt", F.lit(1)))
    second = G.critic(support.join(plan(True), "query_id").withColumn("attempt", F.lit(2))).select("query_id", F.col("decision").alias("again"))
    return first.join(second, "query_id").withColumn("final", F.when(F.col("decision") == "replan", F.col("again")).otherwise(F.col("decision"))).drop("again", "attempt")


def critic_decision(spark: SparkSession, folder: str) -> DataFrame:
    return critic_decisions(spark, folder).select("query_id", "text_ok", "table_ok", "visual_ok", "graph_score", "violations", "decision", "final")


def guard_check(spark: SparkSession, folder: str) -> DataFrame:
    """Citations valid, and no cited piece of another manual."""
    packs = R.held_packs(spark, folder)
    done = A.answers(R.questions(spark, folder), packs)
    foreign = common_evidence(spark, folder, details=False, packs=packs, sources=("text",)).groupBy("query_id").agg(F.count_if("is_foreign").alias("foreign"))
    return G.guard(done.join(foreign, "query_id", "left").withColumn("foreign", F.coalesce("foreign", F.lit(0)))).select("query_id", "status", F.col("foreign").alias("n_foreign"), "passed")


def path_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Questions one of whose paths alone has the node types, relations and pages their template asks of it."""
    return path_checks(spark, folder).agg(F.count(F.lit(1)).alias("questions"), E.mean_of(F.col("path_ok")).alias("path_accuracy"), F.count("path_ok").alias("scored"))


#: What a path must have, by template: node types, relations, and whether the component's own page.
GOLD_PATHS = {0: (["Procedure"], ["EXPLAINED_BY"], True), 2: (["Warning"], ["HAS_WARNING"], False), 3: (["Section", "Image"], ["ILLUSTRATED_BY"], False), 5: (["Symbol"], ["SYMBOL_MEANS"], False)}


def path_checks(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    held = Q.records(spark, folder, found, content=False).groupBy("query_id").agg(F.collect_list(F.struct("node_types", "relations", "page_nos")).alias("paths"))
    q = R.questions(spark, folder).select("query_id", "template", "page_no").join(held, "query_id", "left")
    none = F.array().cast("array<string>")
    types, relations, paged = none, none, F.lit(False)
    for t, (kinds, links, page) in GOLD_PATHS.items():
        here = F.col("template") == t
        types, relations = F.when(here, F.array(*map(F.lit, kinds))).otherwise(types), F.when(here, F.array(*map(F.lit, links))).otherwise(relations)
        paged = F.when(here, F.lit(page)).otherwise(paged)
    pages = F.when(paged & F.col("page_no").isNotNull(), F.array("page_no")).otherwise(F.array().cast("array<int>"))
    return q.withColumn("path_ok", E.path_correct(F.col("paths"), types, relations, pages)).select("query_id", "template", "path_ok")


#: Searches a question of a template is expected to go to: table, graph.
EXPECTED_ROUTES = {0: (False, True), 1: (False, False), 2: (False, True), 3: (False, True), 4: (True, False), 5: (False, True), 6: (False, False), 7: (False, True)}


def route_checks(spark: SparkSession, folder: str) -> DataFrame:
    wants = F.create_map(*[x for t, (a, b) in EXPECTED_ROUTES.items() for x in (F.lit(t), F.struct(F.lit(a).alias("table"), F.lit(b).alias("graph")))])
    df = planned(spark, folder).withColumn("route", F.struct(F.col("use_table").alias("table"), F.col("use_graph").alias("graph"))).withColumn("expected", F.element_at(wants, F.col("template")))
    return df.select("query_id", "template", E.route_correct("route", "expected", ("table", "graph")).alias("route_ok"), F.col("expected.graph").alias("graph_expected"))


def route_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return route_checks(spark, folder).groupBy("template").agg(F.count(F.lit(1)).alias("questions"), E.mean_of(F.col("route_ok")).alias("route_accuracy"))


def system_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record a question and system: text answers alone, the graph alone, and both under planner, critic and merge."""
    packs, entities = R.held_packs(spark, folder), Q._entities(spark, folder)
    found = Q.found_paths(spark, folder, entities)
    evidence = common_evidence(spark, folder, packs=packs, found=found)
    merged = G.merge_evidence(evidence)
    decided = critic_decisions(spark, folder, evidence, packs).select("query_id", (F.col("final") == "accept").alias("accepted"), (F.col("decision") == "replan").cast("int").alias("retries"))
    q = R.questions(spark, folder).select("query_id", "gold", "page_no", (F.size("gold") > 0).alias("answerable"))
    checks = R.held(path_checks(spark, folder, found).select("query_id", "path_ok").join(route_checks(spark, folder).select("query_id", "route_ok", "graph_expected"), "query_id"), "checks")
    parts = []
    for name, pieces in (("text", evidence.where("source = 'text'")), ("graph", evidence.where("source = 'graph'")), ("agentic", merged)):
        held = pieces.groupBy("query_id").agg(F.flatten(F.collect_list("element_ids")).alias("ids"), F.flatten(F.collect_list("page_nos")).alias("pages"), F.count_if("is_foreign").alias("violations"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("content") == "", 1).otherwise(0)).alias("empty"))
        status = {
            "text": R.answer_decision(spark, folder, packs).select("query_id", "status"),
            "graph": Q.graph_answer(spark, folder, entities, found).select("query_id", "status"),
            "agentic": decided.select("query_id", F.when(F.col("accepted"), "answered").otherwise("refused").alias("status"), "retries"),
        }[name]
        df = q.join(status, "query_id").join(held, "query_id", "left").join(checks, "query_id")
        pages = F.transform("gold", lambda _: F.col("page_no"))
        one = (
            df.select(
                F.lit(name).alias("system"), "query_id", "answerable", "status", E.evidence_hits(F.col("gold"), pages, F.coalesce("ids", F.array().cast("array<string>")), F.coalesce("pages", F.array().cast("array<int>"))).alias("evidence_hits"),
                F.size("gold").alias("evidence_total"), (F.lit(None).cast("boolean") if name == "text" else F.when(F.col("graph_expected") | F.lit(name == "graph"), F.col("path_ok"))).alias("path_ok"),
                (F.coalesce("n", F.lit(0)) > F.coalesce("empty", F.lit(0))).alias("cited_well"), (F.col("route_ok") if name == "agentic" else F.lit(None).cast("boolean")).alias("route_ok"),
                F.coalesce("violations", F.lit(0)).alias("violations"), (F.col("retries") if name == "agentic" else F.lit(0)).alias("retries"),
            )
        )
        parts.append(R.held(one, "system"))
    return E.records(I.I.union_all(parts))


def system_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return E.summary(written(system_records(spark, folder), "records"), "system")


def failure_records(spark: SparkSession, folder: str) -> DataFrame:
    f = system_records(spark, folder).where("failure IS NOT NULL")
    return f.select("system", "query_id", F.col("failure.decision").alias("decision"), F.col("failure.path").alias("path"), F.col("failure.route").alias("route"))


def porter_search(spark: SparkSession, folder: str) -> DataFrame:
    """Text search over stemmed tokens without diacritics."""
    q = R.questions(spark, folder).withColumn("terms", porter.stemmed(F.array_join(R.T.search_terms(F.col("question")), " ")))
    asked = q.select("query_id", "doc_id", F.explode(F.array_distinct("terms")).alias("term"))
    index = R._index(spark, folder, "porter", R.chunks, "chunk_id", bm25.TEXT_WEIGHTS, "chunks", analyze=porter.stemmed)
    return bm25.search(index, asked, 10, within="doc_id").select("query_id", "chunk_id", "score", "rank")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return R.chunks(spark, folder).select("chunk_id", F.concat_ws("\n", "metadata", "section_text", "content").alias("t"))


def hashed_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return dense.tfidf(_texts(spark, folder), "chunk_id", "t").withColumn("weight", F.round("weight", 6))


def lsa_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return dense.lsa(dense.weights(_texts(spark, folder), "chunk_id", "t"), "chunk_id").select("chunk_id", F.size("vector").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def lsa_search(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest other chunks of each chunk."""
    v = dense.lsa_of(_texts(spark, folder), "chunk_id", "t")
    return fusion.vector_search(v, v, "chunk_id", "vector", limit=5)


QUERIES = {f.__name__: f for f in (evidence_merge, metadata_violations, critic_decision, guard_check, path_accuracy, route_accuracy, system_comparison, porter_search, hashed_tfidf, lsa_vectors, lsa_search)}

_FIELDS = ", ".join(META)
_WANTED = f"""{R._QUESTIONS}, manual AS (SELECT doc_id, unnest(min({{{", ".join(f"'w_{c}': {c}" for c in META if c != "doc_id")}}})) FROM manifest GROUP BY doc_id), wanted AS (SELECT q.query_id, q.doc_id AS w_doc_id, m.* EXCLUDE (doc_id) FROM questions q LEFT JOIN manual m USING (doc_id))"""
_FOREIGN = " OR ".join(f"(trim(coalesce(w_{c}, '')) <> '' AND lower(coalesce({c}, '')) <> lower(trim(w_{c})))" for c in META)
_PIECES = f"""text_e AS (SELECT h.query_id, 'text' AS source, h.citation_id AS rank, h.rerank_score AS score, {_FIELDS}, coalesce(page_nos, []) AS page_nos, h.chunk_id AS identity, list_concat(coalesce(element_ids, []), [h.chunk_id]) AS element_ids, c.content
  FROM ({R.SQL['evidence_pack']}) h JOIN {O.first('chunks', 'chunk_id', '*')} c USING (chunk_id)),
table_e AS (SELECT h.query_id, 'table' AS source, h.rank, h.score, {_FIELDS}, CASE WHEN page_no IS NULL THEN [] ELSE [page_no] END AS page_nos, h.row_id AS identity, [t.element_id] AS element_ids, r.row_text AS content
  FROM ({I.SQL['table_row_search']}) h JOIN (WITH {R._TABLES}, {I._ROWS} SELECT row_id, element_id AS e, row_text FROM trow) r USING (row_id) JOIN {O.first('table_elements', 'element_id', '*')} t ON t.element_id = r.e),
graph_e AS (SELECT query_id, 'graph' AS source, rank, score, f.doc_id, f.brand, f.model, f.year, f.region, f.language, f.manual_type, pages AS page_nos, ids, content FROM ({Q._PLACES} SELECT fr.query_id, fr.rank, fr.score, fr.pages, fr.content, fr.evidence_ids AS ids, n.{", n.".join(META)} FROM full_rec fr JOIN ways w USING (query_id, path_id) JOIN node n ON n.node_id = w.nodes[1]) f),
graph_f AS (SELECT * EXCLUDE (ids, content), array_to_string(list_sort(ev), ',') AS identity, ev AS element_ids, content FROM (SELECT *, CASE WHEN ids = '' THEN [] ELSE string_split(ids, ',') END AS ev FROM graph_e)),
visual_e AS (SELECT h.query_id, 'visual' AS source, h.rank, h.rrf_score AS score, {_FIELDS}, CASE WHEN n.page_no IS NULL THEN [] ELSE [n.page_no] END AS page_nos, h.node_id AS identity, coalesce(n.evidence_ids, []) AS element_ids, coalesce(n.text, '') AS content
  FROM ({R.SQL['page_fusion']}) h JOIN (WITH {R._QUESTIONS} SELECT query_id FROM questions WHERE template = {WITH_IMAGE}) q USING (query_id) JOIN {O.first('graph_nodes', 'node_id', '*')} n USING (node_id))"""
_EVIDENCE = f"""{_WANTED}, {_PIECES},
ev AS MATERIALIZED (SELECT query_id, source, rank, score, doc_id, array_to_string(list_sort(page_nos), ',') AS pages, page_nos, identity, element_ids, content, ({_FOREIGN}) AS is_foreign
  FROM (SELECT * FROM text_e UNION ALL BY NAME SELECT * FROM table_e UNION ALL BY NAME SELECT * FROM graph_f UNION ALL BY NAME SELECT * FROM visual_e) JOIN wanted USING (query_id))"""
_MERGED = f"""ordered AS (SELECT *, CASE source WHEN 'graph' THEN 0 WHEN 'text' THEN 1 WHEN 'table' THEN 2 ELSE 3 END AS o FROM ev WHERE rank <= CASE source WHEN 'graph' THEN 3 WHEN 'text' THEN 3 ELSE 2 END),
once AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, pages, identity ORDER BY o, rank) = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, rank, identity)::INT AS citation_id FROM once QUALIFY citation_id <= {G.EVIDENCE_CAP})"""
_CRITIC = f"""agg AS (SELECT query_id, max(CASE WHEN source = 'graph' AND rank = 1 THEN score END) AS graph_score, count(CASE WHEN source = 'visual' THEN 1 END) > 0 AS visual_ok, count(CASE WHEN is_foreign THEN 1 END)::INT AS violations FROM ev GROUP BY query_id),
support AS (SELECT t.query_id, t.status = 'answered' AS text_ok, r.status = 'answered' AS table_ok, graph_score, coalesce(visual_ok, false) AS visual_ok, coalesce(violations, 0) AS violations
  FROM ({R.SQL['answer_decision']}) t LEFT JOIN ({I.SQL['table_answer']}) r USING (query_id) LEFT JOIN agg USING (query_id)),
judged AS (SELECT s.*, p.multi_hop, text_ok AND (visual_ok OR q.template <> {WITH_IMAGE}) AND (NOT p.multi_hop OR coalesce(graph_score >= {G.GRAPH_SUPPORT}, false)) AS met1,
  text_ok AND (visual_ok OR q.template <> {WITH_IMAGE}) AND coalesce(graph_score >= {G.GRAPH_SUPPORT}, false) AS met2 FROM support s JOIN questions q USING (query_id) JOIN ({R.SQL['route_plan']}) p USING (query_id)),
critic AS (SELECT *, CASE WHEN violations > 0 THEN 'refuse' WHEN met1 THEN 'accept' ELSE 'replan' END AS decision, CASE WHEN violations > 0 THEN 'refuse' WHEN met1 OR met2 THEN 'accept' ELSE 'refuse' END AS final FROM judged)"""


def _wants(at: int) -> str:
    parts = " ".join(f"WHEN {t} THEN {O.words(v[at])}" for t, v in GOLD_PATHS.items())
    return f"(CASE template {parts} ELSE []::VARCHAR[] END)"


_PAGED = ", ".join(str(t) for t, v in GOLD_PATHS.items() if v[2])
_CHECKS = f"""rec_path AS (SELECT query_id, node_types, relations, page_nos FROM ({Q.SQL['path_records']})),
asked_path AS (SELECT query_id, template, {_wants(0)} AS t, {_wants(1)} AS r, CASE WHEN template IN ({_PAGED}) AND page_no IS NOT NULL THEN [page_no::VARCHAR] ELSE [] END AS g FROM questions),
checked AS (SELECT a.query_id, a.template, CASE WHEN len(any_value(t)) = 0 AND len(any_value(r)) = 0 AND len(any_value(g)) = 0 THEN NULL ELSE coalesce(bool_or(list_has_all(string_split(node_types, ','), t) AND list_has_all(string_split(relations, ','), r) AND list_has_all(string_split(page_nos, ','), g)), false) END AS path_ok
  FROM asked_path a LEFT JOIN rec_path p USING (query_id) GROUP BY a.query_id, a.template)"""
_EXPECT = " ".join(f"WHEN {t} THEN {{'t': {str(a).lower()}, 'g': {str(b).lower()}}}" for t, (a, b) in EXPECTED_ROUTES.items())
_ROUTES = f"routed AS (SELECT q.query_id, q.template, e.g AS graph_expected, p.use_table = e.t AND p.use_graph = e.g AS route_ok FROM (SELECT *, CASE template {_EXPECT} END AS e FROM questions) q JOIN ({R.SQL['route_plan']}) p USING (query_id))"


def _record(name: str, pieces: str, status: str, path: str, route: str = "NULL::BOOLEAN", retries: str = "0") -> str:
    return f"""SELECT '{name}' AS system, q.query_id, len(q.gold) > 0 AS answerable, s.status, len(list_filter(q.gold, lambda g: list_contains(coalesce(h.ids, []), g) OR coalesce(list_contains(coalesce(h.pages, []), q.page_no), false))) AS evidence_hits, len(q.gold) AS evidence_total,
 {path} AS path_ok, coalesce(h.n, 0) > coalesce(h.empty, 0) AS cited_well, {route} AS route_ok, coalesce(h.violations, 0) AS violations, {retries} AS retries
FROM questions q JOIN ({status}) s USING (query_id) LEFT JOIN (SELECT query_id, flatten(list(element_ids)) AS ids, flatten(list(page_nos)) AS pages, count(CASE WHEN is_foreign THEN 1 END) AS violations, count(*) AS n, count(CASE WHEN content = '' THEN 1 END) AS empty FROM {pieces} GROUP BY query_id) h USING (query_id) JOIN checked c USING (query_id) JOIN routed r USING (query_id)"""


_RECORDS = f"""WITH {_EVIDENCE}, {_MERGED}, {_CRITIC}, {_CHECKS}, {_ROUTES}, recs AS (
{_record('text', "(SELECT * FROM ev WHERE source = 'text')", R.SQL['answer_decision'], 'NULL::BOOLEAN')} UNION ALL
{_record('graph', "(SELECT * FROM ev WHERE source = 'graph')", Q.SQL['graph_answer'], 'c.path_ok')} UNION ALL
{_record('agentic', 'merged', "SELECT query_id, CASE WHEN final = 'accept' THEN 'answered' ELSE 'refused' END AS status, CASE WHEN decision = 'replan' THEN 1 ELSE 0 END AS retries FROM critic", 'CASE WHEN r.graph_expected THEN c.path_ok END', 'r.route_ok', 's.retries')}),
final_recs AS (SELECT *, status = 'answered' AS answered, (status = 'answered') = answerable AS decision_ok FROM recs)"""
SQL = {
    "evidence_merge": f"WITH {_EVIDENCE}, {_MERGED} SELECT query_id, citation_id, source, identity, doc_id, is_foreign FROM merged",
    "metadata_violations": f"WITH {_EVIDENCE} SELECT source, count(*) AS results, count(CASE WHEN is_foreign THEN 1 END) AS violations, round(avg(is_foreign::INT), 6) AS violation_rate FROM ev GROUP BY source",
    "critic_decision": f"WITH {_EVIDENCE}, {_CRITIC} SELECT query_id, text_ok, table_ok, visual_ok, graph_score, violations, decision, final FROM critic",
    "guard_check": f"""WITH {_EVIDENCE} SELECT a.query_id, a.status, coalesce(f.foreign_n, 0) AS n_foreign, ((trim(answer) = {O.lit(REFUSAL)}) OR (len(cited) > 0 AND len(list_filter(cited, lambda c: c::INT < 1 OR c::INT > n_evidence)) = 0)) AND coalesce(f.foreign_n, 0) = 0 AS passed
FROM (SELECT *, regexp_extract_all(answer, '\\[(\\d+)\\]', 1) AS cited FROM ({R.SQL['answer_text']})) a JOIN ({R.SQL['answer_decision']}) d USING (query_id) LEFT JOIN (SELECT query_id, count(CASE WHEN is_foreign THEN 1 END) AS foreign_n FROM ev WHERE source = 'text' GROUP BY query_id) f USING (query_id)""",
    "path_accuracy": f"WITH {R._QUESTIONS}, {_CHECKS} SELECT count(*) AS questions, round(avg(path_ok::INT), 6) AS path_accuracy, count(path_ok) AS scored FROM checked",
    "route_accuracy": f"WITH {R._QUESTIONS}, {_ROUTES} SELECT template, count(*) AS questions, round(avg(route_ok::INT), 6) AS route_accuracy FROM routed GROUP BY template",
    "system_comparison": f"""{_RECORDS} SELECT system, count(*) AS questions, round(sum(evidence_hits) / sum(evidence_total), 6) AS evidence_recall, round(avg(path_ok::INT), 6) AS path_accuracy, round(avg(CASE WHEN answered THEN cited_well::INT END), 6) AS citation_faithfulness,
 round(avg(route_ok::INT), 6) AS route_accuracy, round(avg(decision_ok::INT), 6) AS decision_accuracy, round(avg(CASE WHEN NOT answerable THEN (NOT answered)::INT END), 6) AS refusal_accuracy, sum(violations)::BIGINT AS metadata_violations, round(avg((retries > 0)::INT), 6) AS retry_rate,
 count(CASE WHEN NOT (decision_ok AND coalesce(path_ok, true) AND coalesce(route_ok, true)) THEN 1 END) AS failures FROM final_recs GROUP BY system""",
}
