"""Queries of the graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import oracle as O
from quireflow.functions import text as T
from quireflow.operators import graph as G
from quireflow.operators import retrieval_queries as R
from quireflow.plans.workspace import checkpoint_root, fingerprint, in_turns, kept, tidy, written
from quireflow.sources.tables import first_arrivals, table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    cols = [*G.META, "page_start", "section_path", "chunk_type", "content", "element_ids"]
    one = first_arrivals(table(spark, folder, "chunks").withColumn("seen_at", F.col("ingested_at")), "chunk_id", [*cols, "seen_at"])
    return one.withColumnRenamed("seen_at", "ingested_at")


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    cols = [*G.META, "page_no", "section_path", "element_type", "content", "asset_path"]
    one = first_arrivals(table(spark, folder, "elements").withColumn("seen_at", F.col("ingested_at")), "element_id", [*cols, "seen_at"])
    return one.withColumnRenamed("seen_at", "ingested_at")


def built_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return G.build_nodes(table(spark, folder, "manifest"), _chunks(spark, folder), _elements(spark, folder))


def graph_build_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = built_nodes(spark, folder)
    return nodes.select("node_id", "node_type", "label", "text", "doc_id", "brand", "page_no", F.array_join("section_path", " > ").alias("section"), F.array_join("evidence", ",").alias("evidence"), "asset_path", "properties")


def graph_build_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = G.build_edges(_chunks(spark, folder), _elements(spark, folder))
    return edges.select("edge_id", "edge_type", "source_id", "target_id", "doc_id", "page_no", F.array_join("evidence", ",").alias("evidence"), "confidence")


def graph_build_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges by type, every type listed."""
    made = graph_build_nodes(spark, folder).select(F.col("node_type").alias("kind")).unionAll(graph_build_edges(spark, folder).select("edge_type"))
    every = spark.createDataFrame([(k,) for k in (*G.NODE_WEIGHTS, *G.RELATION_WEIGHTS)], "kind string")
    return every.join(made.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return first_arrivals(table(spark, folder, "graph_edges"), "edge_id", ["edge_type", "source_id", "target_id", "doc_id", "confidence"])


def graph_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return G.adjacency(_edges(spark, folder))


def graph_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of edges that are no nodes: anti joins."""
    nodes, e = table(spark, folder, "graph_nodes").select(F.col("node_id").alias("end")), _edges(spark, folder)
    ends = e.select("edge_id", F.lit("source").alias("side"), F.col("source_id").alias("end")).unionAll(e.select("edge_id", F.lit("target"), "target_id"))
    return ends.where("end IS NOT NULL AND end <> ''").join(nodes, "end", "left_anti").select("edge_id", "side", "end")


def graph_index(spark: SparkSession, folder: str, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and steps of the kept index of the given graph."""
    mark = fingerprint(spark, [f"{folder}/graph_nodes.parquet", f"{folder}/graph_edges.parquet"], G.FAN_OUT)
    path = kept(spark, f"graph-{mark}", lambda p: G.write(R.graph_nodes(spark, folder), _edges(spark, folder), p), root or f"{checkpoint_root(spark)}/indexes")
    return G.opened(spark, path)


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    """Written, as paths, records and answers all begin at them."""
    found = written(G.entity_scores(R.bm25_entities(spark, folder), graph_index(spark, folder)[0], R.questions(spark, folder)), "entities")
    tidy(spark)
    return found


def entity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(spark, folder).select("query_id", "node_id", F.round("score", 6).alias("score"))


def found_paths(spark: SparkSession, folder: str, entities: DataFrame | None = None) -> DataFrame:
    """Paths written once for all that reads them. A path stays in its manual, so manuals are searched in turns."""
    entities, steps = _entities(spark, folder) if entities is None else entities, graph_index(spark, folder)[1]
    return in_turns([entities, steps], "doc_id", G.paths, "paths")


def graph_paths(spark: SparkSession, folder: str) -> DataFrame:
    return found_paths(spark, folder).select("query_id", "path_id", F.array_join("path", ">").alias("path"), F.array_join("edges", ">").alias("edges"), "hops", "score", "rank")


def records(spark: SparkSession, folder: str, found: DataFrame | None = None, content: bool = True) -> DataFrame:
    return G.path_records(found_paths(spark, folder) if found is None else found, graph_index(spark, folder)[0], _edges(spark, folder), content)


def path_records(spark: SparkSession, folder: str) -> DataFrame:
    """What a citation of each best path says."""
    r = records(spark, folder)
    joined = lambda c, by=",": F.array_join(F.transform(c, lambda x: x.cast("string")), by).alias(c)
    return r.select("query_id", "rank", "path_id", "doc_id", joined("page_nos"), joined("section_path", " > "), joined("node_types"), joined("node_labels", "|"), joined("relations"), joined("evidence_ids"), "content", "source")


def graph_answer(spark: SparkSession, folder: str, entities: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Answered by the graph alone where the best path and the best entity score enough."""
    entities = _entities(spark, folder) if entities is None else entities
    top = (found_paths(spark, folder, entities) if found is None else found).where("rank = 1").select("query_id", F.col("score").alias("path_score"))
    best = entities.groupBy("query_id").agg(F.max(F.round("score", 6)).alias("entity_score"))
    df = R.questions(spark, folder).select("query_id").join(top, "query_id", "left").join(best, "query_id", "left")
    return df.withColumn("status", F.when((F.col("path_score") >= 1.2) & (F.col("entity_score") >= 0.45), "answered").otherwise("refused"))


def procedure_steps(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder).select("chunk_id", T.steps_of(F.col("content"), F.col("chunk_type") == "steps").alias("steps"))
    rows = c.select("chunk_id", F.posexplode("steps").alias("place", "step"), "steps")
    return rows.select("chunk_id", (F.col("place") + 1).alias("position"), "step", F.get("steps", F.col("place") + 1).alias("next_step"))


QUERIES = {f.__name__: f for f in (graph_build_nodes, graph_build_edges, graph_build_counts, graph_adjacency, graph_endpoints, entity_scores, graph_paths, path_records, graph_answer, procedure_steps)}

# --- SQL -----------------------------------------------------------------------------------------------------------


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}:' || left(sha256('[' || " + " || ',' || ".join(parts) + " || ']'), 20)"


def _s(x: str) -> str:
    return f"to_json({x})::VARCHAR"


def _node(kind: str, *parts: str) -> str:
    return _id("node", _s("doc_id"), _s(f"'{kind}'"), *parts)


def _page(x: str = "page_no") -> str:
    return f"coalesce({x}::VARCHAR, 'null')"


_IDS = f"""list_filter(list_transform(section_path, lambda s: trim(s)), lambda s: s <> '') AS stripped"""
_MORE = f"""{_node('Vehicle')} AS vehicle, CASE WHEN page_no IS NOT NULL THEN {_node('EvidencePage', _page())} END AS page,
  {_node('Section', _s('stripped'))} AS section, {_node('Component', _s('section_path'), _s(O.component_label('section_path')))} AS component"""
_LINES = "string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
_NUM = f"list_filter(list_transform({_LINES}, lambda s, i: {{'n': TRY_CAST(regexp_extract(s, {O.lit(T.STEP_LINE)}, 1) AS BIGINT), 'i': i, 's': trim(regexp_extract(s, {O.lit(T.STEP_LINE)}, 2))}}), lambda x: x.n IS NOT NULL)"
_BARE = f"list_transform(list_filter({_LINES}, lambda s: trim(s, ' ' || chr(9)) <> ''), lambda s: trim(regexp_replace(s, '^\\s*[-*•]\\s*', '')))"
_STEPS = f"""CASE WHEN len({_NUM}) > 0 THEN list_filter(list_transform(list_sort({_NUM})[1:20], lambda x: x.s), lambda s: s <> '')
  WHEN chunk_type = 'steps' THEN CASE WHEN len({_BARE}) BETWEEN 1 AND 20 THEN {_BARE} WHEN trim(content) <> '' THEN [{O.compact('content', 500)}] ELSE [] END ELSE []::VARCHAR[] END"""
_BASE = f"""
WITH c0 AS (SELECT *, page_start AS page_no, {_IDS} FROM {O.first('chunks', 'chunk_id', '*')}),
c1 AS MATERIALIZED (SELECT *, {_MORE}, {O.component_label('section_path')} AS label, {_STEPS} AS steps, list_filter(coalesce(element_ids, []), lambda e: e <> '') AS evidence FROM c0),
c AS MATERIALIZED (SELECT *, chunk_type IN ('warning', 'caution') AS is_safety, chunk_type = 'steps' OR len(steps) > 0 OR regexp_matches(label, {O.lit(T.ACTION)}) AS is_procedure,
  regexp_matches(label || ' ' || content, {O.lit(T.SPECIFICATION)}) AS is_specification, regexp_matches(array_to_string(section_path, ' ') || ' ' || content, {O.lit(T.SYMBOL)}) AS is_symbol,
  CASE chunk_type WHEN 'warning' THEN {_node('Warning', _s('chunk_id'))} WHEN 'caution' THEN {_node('Caution', _s('chunk_id'))} END AS safety,
  {_node('Procedure', _s('chunk_id'))} AS procedure, {_node('Specification', _s('chunk_id'))} AS specification, {_node('Symbol', _s('chunk_id'))} AS symbol FROM c1),
e0 AS (SELECT *, {_IDS} FROM {O.first('elements', 'element_id', '*')} WHERE element_type IN ('image', 'table')),
e AS MATERIALIZED (SELECT *, {_MORE}, CASE element_type WHEN 'image' THEN {_node('Image', _s('element_id'))} ELSE {_node('Table', _s('element_id'))} END AS visual, [element_id] AS evidence FROM e0),
seen AS (SELECT 0 AS src, ingested_at AS t, chunk_id AS id, doc_id, brand, page_no, section_path, stripped, vehicle, page, section, component, evidence[1:1] AS evidence FROM c
  UNION ALL SELECT 1, ingested_at, element_id, doc_id, brand, page_no, section_path, stripped, vehicle, page, section, component, evidence FROM e),
prefixes AS (SELECT *, {_node('Section', _s('prefix'))} AS own, CASE WHEN depth > 1 THEN {_node('Section', _s('prefix[1:depth - 1]'))} END AS parent
  FROM (SELECT *, stripped[1:depth] AS prefix FROM (SELECT *, unnest(range(1, greatest(len(stripped), 1) + 1)) AS depth FROM seen))),
f_page AS (SELECT * FROM seen WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY src, t, id) = 1),
f_section AS (SELECT * FROM prefixes QUALIFY row_number() OVER (PARTITION BY own ORDER BY src, t, id) = 1),
f_component AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY component ORDER BY src, t, id) = 1),
steps AS (SELECT *, {_node('Step', _s('chunk_id'), 'position::VARCHAR')} AS step, CASE WHEN position > 1 THEN {_node('Step', _s('chunk_id'), '(position - 1)::VARCHAR')} END AS before
  FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS position FROM c WHERE is_procedure))"""


def _title(x: str) -> str:
    return f"upper(left({x}, 1)) || substr({x}, 2)"


def _text(x: str) -> str:
    return O.compact(f"coalesce({x}, '')", G.NODE_TEXT_LIMIT)


def _row(ident: str, kind: str, label: str, text: str, source: str, path: str = "section_path", page: str = "page_no", asset: str = "NULL::VARCHAR", properties: str = "'{}'", proof: str = "evidence", where: str = "") -> str:
    return f"SELECT {ident} AS node_id, {kind} AS node_type, {O.compact(label, G.LABEL_LIMIT)} AS label, {_text(text)} AS text, doc_id, brand, {page} AS page_no, array_to_string({path}, ' > ') AS section, array_to_string({proof}, ',') AS evidence, {asset} AS asset_path, {properties} AS properties FROM {source} {where}"


def _own(flag: str, node: str, kind: str, label: str = "label") -> str:
    return _row(node, kind, label, "content", "c", where=f"WHERE is_{flag}")


_NAME = "concat_ws(' ', brand, model, year)"
_VEHICLES = "(SELECT doc_id, unnest(min({'brand': brand, 'model': model, 'year': year, 'region': region, 'language': language, 'manual_type': manual_type})) FROM manifest GROUP BY doc_id)"
_PATH_TEXT = "array_to_string(section_path, ' > ')"
_NODES = f"""{_BASE}, made AS (
{_row(_node('Vehicle'), "'Vehicle'", _NAME, _NAME, _VEHICLES, "[]::VARCHAR[]", "NULL::INT", proof="[]::VARCHAR[]")}
UNION ALL {_row("page", "'EvidencePage'", "'Physical PDF page ' || page_no", _PATH_TEXT, "f_page")}
UNION ALL {_row("own", "'Section'", O.section_label('prefix'), "array_to_string(prefix, ' > ')", "f_section", "prefix")}
UNION ALL {_row("component", "'Component'", O.component_label('section_path'), _PATH_TEXT, "f_component")}
UNION ALL {_own('safety', 'safety', _title('chunk_type'), _title('chunk_type') + " || ': ' || label")}
UNION ALL {_own('procedure', 'procedure', "'Procedure'")} UNION ALL {_own('specification', 'specification', "'Specification'")} UNION ALL {_own('symbol', 'symbol', "'Symbol'")}
UNION ALL {_row("step", "'Step'", "'Step ' || position", "steps[position]", "steps", properties="'{' || chr(34) || 'position' || chr(34) || ':' || position || '}'")}
UNION ALL {_row("visual", _title('element_type'), _title('element_type') + " || ': ' || " + O.section_label('section_path'), "content", "e", asset="asset_path")})
SELECT * FROM made"""


def _e(source: str, relation: str, s: str, t: str, where: str = "true", confidence: float = 1.0, page: str = "page_no", proof: str = "evidence") -> str:
    return f"SELECT doc_id, '{relation}' AS edge_type, {s} AS source_id, {t} AS target_id, {proof} AS evidence, {page} AS page_no, {confidence}::DOUBLE AS confidence FROM {source} WHERE {where}"


_ALL_EDGES = " UNION ALL ".join(
    [_e("c", r, s, t, f"is_{k}") for k, r, s, t in G.CHUNK_EDGES]
    + [_e("steps", r, s, t) for r, s, t in (("REQUIRES_STEP", "procedure", "step"), ("APPLIES_TO", "step", "vehicle"), ("REFERENCES", "step", "page"), ("NEXT_STEP", "before", "step"))]
    + [_e("f_component", r, s, t) for r, s, t in G.FIRST_EDGES]
    + [_e("f_page", "APPLIES_TO", "page", "vehicle")]
    + [_e("f_section", r, "own", t) for r, t in (("APPLIES_TO", "vehicle"), ("LOCATED_IN", "parent"), ("REFERENCES", "page"))]
    + [_e("seen", "REFERENCES", "section", "page")]
    + [_e("e", r, s, t, "true" if k == "any" else f"element_type = '{k}'", w) for k, r, s, t, w in G.ELEMENT_EDGES]
    + [_e("(SELECT e.*, c.symbol FROM e JOIN c ON c.doc_id = e.doc_id AND c.section_path = e.section_path AND c.is_symbol AND e.element_type = 'image')", "ILLUSTRATED_BY", "symbol", "visual")]
    + [_e("(SELECT p.doc_id, p.procedure, s.safety AS safe, s.evidence AS proof FROM c p JOIN c s ON p.doc_id = s.doc_id AND p.section_path = s.section_path AND p.is_procedure AND s.is_safety)", "HAS_WARNING", "procedure", "safe", page="NULL::INT", proof="proof")]
)
_EDGE_ID = _id("edge", _s("doc_id"), _s("edge_type"), _s("source_id"), _s("target_id"), _s("evidence"), _page())
_EDGES = f"""{_BASE}, made AS ({_ALL_EDGES}),
named AS (SELECT *, {_EDGE_ID} AS edge_id FROM made WHERE source_id IS NOT NULL AND target_id IS NOT NULL)
SELECT edge_id, min(edge_type) AS edge_type, min(source_id) AS source_id, min(target_id) AS target_id, min(doc_id) AS doc_id, min(page_no) AS page_no, array_to_string(min(evidence), ',') AS evidence, min(confidence) AS confidence FROM named GROUP BY edge_id"""

_EDGE_ROWS = O.first("graph_edges", "edge_id", "*")
_ADJ = f"""held AS (SELECT * REPLACE (coalesce(confidence, 1.0) AS confidence) FROM {_EDGE_ROWS} WHERE edge_type NOT IN {G.NOT_FOLLOWED} AND source_id <> target_id),
sides AS (SELECT doc_id, source_id AS node, target_id AS other, edge_id, edge_type, confidence FROM held UNION ALL SELECT doc_id, target_id, source_id, edge_id, edge_type, confidence FROM held),
adj AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY doc_id, node ORDER BY edge_type, edge_id) <= {G.FAN_OUT})"""


def _case(table: dict[str, float], column: str) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END)"


_SCORED = f"""WITH {R._QUESTIONS}, {R._NODE}, {R._search('hits', 'node', 'node_id', R.bm25.NODE_WEIGHTS, 8, stopwords=T.GRAPH_STOPWORDS)},
terms AS MATERIALIZED (SELECT node_id, doc_id, node_type, {O.plain_terms("label || ' ' || text", T.GRAPH_STOPWORDS, T.JOINED_TOKEN)} AS terms FROM node),
asked AS (SELECT query_id, {O.plain_terms('question', T.GRAPH_STOPWORDS, T.JOINED_TOKEN)} AS wanted FROM questions),
ent AS (SELECT h.query_id, h.node_id, t.doc_id, a.wanted, round(0.48 * least(h.score / 12.0, 1.0) + 0.37 * {O.coverage('a.wanted', 't.terms')} + 0.15 * {_case(G.NODE_WEIGHTS, 't.node_type')}, 9) AS score
  FROM hits h JOIN terms t USING (node_id) JOIN asked a USING (query_id))"""


def _hop(n: int, front: str) -> str:
    return f"""g{n} AS MATERIALIZED (SELECT f.query_id, f.doc_id, f.wanted, f.anchor, a.other AS node, list_append(f.path, a.other) AS path, list_append(f.edges, a.edge_id) AS edges,
  round(f.score + {_case(G.RELATION_WEIGHTS, 'a.edge_type')} * a.confidence / {n + 0.5} + 0.20 * {O.coverage('f.wanted', 't.terms')} + 0.08 * {_case(G.NODE_WEIGHTS, 't.node_type')}, 9) AS score
  FROM {front} f JOIN adj a ON a.doc_id = f.doc_id AND a.node = f.node JOIN terms t ON t.node_id = a.other AND t.doc_id = a.doc_id WHERE NOT list_contains(f.path, a.other))"""


_PATHS = f"""{_SCORED}, {_ADJ}, f0 AS (SELECT query_id, doc_id, wanted, node_id AS anchor, node_id AS node, [node_id] AS path, []::VARCHAR[] AS edges, score FROM ent), {_hop(1, 'f0')},
f1 AS (SELECT * FROM g1 QUALIFY row_number() OVER (PARTITION BY query_id, anchor ORDER BY score DESC, node, array_to_string(edges, '>')) <= {G.BEAM}), {_hop(2, 'f1')},
every AS (SELECT query_id, doc_id, path AS nodes, edges AS steps, 1 AS hops, score FROM g1 UNION ALL SELECT query_id, doc_id, path, edges, 2, score FROM g2),
best AS (SELECT *, {_id("path", _s("doc_id"), _s("nodes"), _s("steps"))} AS path_id FROM (SELECT query_id, doc_id, nodes, steps, hops, round(max(score), 6) AS score FROM every GROUP BY ALL)),
ways AS (SELECT * EXCLUDE (nodes, steps), nodes, steps, array_to_string(nodes, '>') AS path, array_to_string(steps, '>') AS edges, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path_id)::INT AS rank FROM best QUALIFY rank <= {G.PATHS})"""
_PLACES = f"""{_PATHS}, place AS (SELECT query_id, path_id, unnest(range(1, len(nodes) + 1)) AS pos, nodes FROM ways),
walked AS (SELECT p.query_id, p.path_id, p.pos, n.* FROM place p JOIN node n ON n.node_id = p.nodes[p.pos]),
step AS (SELECT query_id, path_id, string_agg(e.edge_type, ',' ORDER BY pos) AS relations FROM (SELECT query_id, path_id, steps, unnest(range(1, len(steps) + 1)) AS pos FROM ways) s JOIN {_EDGE_ROWS} e ON e.edge_id = s.steps[s.pos] GROUP BY ALL),
rec AS (SELECT query_id, path_id, min_by(brand, pos) AS brand, min_by(model, pos) AS model, min_by(year, pos) AS year, list_sort(list_distinct(list_filter(list(page_no), lambda p: p IS NOT NULL))) AS pages, max_by(section_path, len(section_path) * 100 - pos) AS section_path,
  string_agg(node_type, ',' ORDER BY pos) AS node_types, string_agg(label, '|' ORDER BY pos) AS node_labels, flatten(list(coalesce(evidence_ids, []) ORDER BY pos)) AS ev,
  string_agg(CASE WHEN node_type NOT IN {G.NOT_QUOTED} THEN node_type || ' ' || label || ': ' || coalesce(text, '') END, ' | ' ORDER BY pos) AS body FROM walked GROUP BY ALL),
full_rec AS (SELECT w.query_id, w.rank, w.path_id, w.doc_id, array_to_string(pages, ',') AS page_nos, array_to_string(section_path, ' > ') AS section_path, node_types, node_labels, relations, pages, w.score, w.hops,
  array_to_string({O.distinct("list_filter(ev, lambda e: e <> '')")}, ',') AS evidence_ids, {O.compact("coalesce(body, '')", G.PATH_CONTENT)} AS content,
  brand || ' ' || model || ' Owner''s Manual (' || year || '), ' || array_to_string(section_path, ' > ') || CASE WHEN len(pages) > 0 THEN ', physical PDF p.' || array_to_string(pages, ',') ELSE '' END AS source
  FROM ways w JOIN rec USING (query_id, path_id) JOIN step USING (query_id, path_id))"""

SQL = {
    "graph_build_nodes": _NODES,
    "graph_build_edges": _EDGES,
    "graph_build_counts": f"""SELECT k.kind, coalesce(count(m.kind), 0) AS n FROM (SELECT unnest({O.words([*G.NODE_WEIGHTS, *G.RELATION_WEIGHTS])}) AS kind) k
LEFT JOIN (SELECT node_type AS kind FROM ({_NODES}) UNION ALL SELECT edge_type FROM ({_EDGES})) m USING (kind) GROUP BY k.kind""",
    "graph_adjacency": f"WITH {_ADJ} SELECT * FROM adj",
    "graph_endpoints": f"""WITH e AS (SELECT * FROM {_EDGE_ROWS}), ends AS (SELECT edge_id, 'source' AS side, source_id AS "end" FROM e UNION ALL SELECT edge_id, 'target', target_id FROM e)
SELECT * FROM ends WHERE "end" <> '' AND "end" NOT IN (SELECT node_id FROM graph_nodes)""",
    "entity_scores": f"{_SCORED} SELECT query_id, node_id, round(score, 6) AS score FROM ent",
    "graph_paths": f"{_PATHS} SELECT query_id, path_id, path, edges, hops, score, rank FROM ways",
    "path_records": f"{_PLACES} SELECT query_id, rank, path_id, doc_id, page_nos, section_path, node_types, node_labels, relations, evidence_ids, content, source FROM full_rec",
    "graph_answer": f"""{_PATHS}, best_e AS (SELECT query_id, max(round(score, 6)) AS entity_score FROM ent GROUP BY ALL)
SELECT q.query_id, w.score AS path_score, entity_score, CASE WHEN w.score >= 1.2 AND entity_score >= 0.45 THEN 'answered' ELSE 'refused' END AS status
FROM questions q LEFT JOIN ways w ON w.query_id = q.query_id AND w.rank = 1 LEFT JOIN best_e b ON b.query_id = q.query_id""",
    "procedure_steps": f"""WITH c AS (SELECT chunk_id, {_STEPS} AS steps FROM {O.first('chunks', 'chunk_id', '*')})
SELECT chunk_id, i::INT AS position, steps[i] AS step, steps[i + 1] AS next_step FROM (SELECT chunk_id, steps, unnest(range(1, len(steps) + 1)) AS i FROM c)""",
}
