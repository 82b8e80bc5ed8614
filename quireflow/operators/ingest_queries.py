"""Queries of ingestion, chunking, contracts and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import oracle as O
from quireflow.functions import text as T
from quireflow.operators import answering as A
from quireflow.operators import bm25
from quireflow.operators import ingest as I
from quireflow.operators import retrieval_queries as R
from quireflow.sources.tables import first_arrivals, table

_COLUMNS = ["doc_id", "page_no", "section_path", "element_type", "content", "asset_path", "bbox", "source_locator"]


def elements(spark: SparkSession, folder: str) -> DataFrame:
    one = first_arrivals(table(spark, folder, "elements"), "element_id", _COLUMNS)
    return one.withColumn("source_index", F.col("source_locator.source_index")).withColumn("title_level", F.col("source_locator.title_level")).withColumn("source_type", F.col("source_locator.source_type")).withColumn("page_idx", F.col("source_locator.source_page_idx"))


def element_normalize(spark: SparkSession, folder: str) -> DataFrame:
    e = elements(spark, folder)
    kind, page = I.element_type(F.col("source_locator.source_type")), I.page_no(F.col("source_locator.source_page_idx"))
    fingerprint = F.concat(F.lit('{"content":'), F.to_json(F.array("content")), F.lit("}"))
    return e.select("element_id", kind.alias("kind"), page.cast("int").alias("page"), I.bbox(F.col("bbox"))[0].alias("left"), I.element_id(F.col("doc_id"), page, kind, F.col("source_index"), fingerprint).alias("stable_id"))


def element_links(spark: SparkSession, folder: str) -> DataFrame:
    return I.links(elements(spark, folder))


def nearest_text(spark: SparkSession, folder: str) -> DataFrame:
    return I.nearest_text(elements(spark, folder))


def section_fold(spark: SparkSession, folder: str) -> DataFrame:
    return I.section_paths(elements(spark, folder)).select("element_id", F.array_join("path", " > ").alias("path"))


def anomaly_report(spark: SparkSession, folder: str) -> DataFrame:
    return I.anomalies(elements(spark, folder))


def source_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return I.source_histogram(elements(spark, folder))


def page_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return I.page_coverage(elements(spark, folder))


def visual_context(spark: SparkSession, folder: str) -> DataFrame:
    """What is said of each image and table: section, recognized text, nearest texts."""
    e = elements(spark, folder)
    none = F.array().cast("array<string>")
    said = F.when(F.btrim(F.coalesce("content", F.lit(""))) != "", F.array("content")).otherwise(none)
    df = e.where("element_type <> 'text'").join(I.nearest_text(e), "element_id")
    return df.select("element_id", I.visual_context(F.col("section_path"), none, none, said, F.col("before"), F.col("after"), F.col("page_no")).alias("context"))


def _made(spark: SparkSession, folder: str) -> DataFrame:
    return I.chunk_links(I.chunks(elements(spark, folder)))


def chunk_build(spark: SparkSession, folder: str) -> DataFrame:
    return _made(spark, folder).select("chunk_id", "doc_id", "chunk_type", "page_no", F.array_join("section_path", " > ").alias("section"), "content", F.array_join("element_ids", ",").alias("element_ids"), "previous_chunk_id", "next_chunk_id")


def chunk_summary(spark: SparkSession, folder: str) -> DataFrame:
    over = F.count_if(F.length("content") > I.MAX_CHARS)
    return _made(spark, folder).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("chunks"), over.alias("oversized"), F.sum(F.size("element_ids")).alias("elements"), F.countDistinct("doc_id").alias("documents"))


def chunk_labels(spark: SparkSession, folder: str) -> DataFrame:
    c = R.chunks(spark, folder)
    path = F.col("section_path")
    return c.select("chunk_id", T.chunk_kind(F.col("content")).alias("kind"), T.component_label(path).alias("component"), "metadata", T.compact(F.col("content"), 240).alias("short"), T.source_label(path, F.col("page_nos")).alias("source"), F.concat_ws("\n", F.concat_ws(" ", "brand", "model", "year"), "section_text", "content").alias("indexed"))


def element_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Each element that chunks name, with their number and the first of them."""
    claims = R.chunks(spark, folder).select("chunk_id", F.explode("element_ids").alias("element_id")).where("element_id <> ''").distinct()
    return claims.groupBy("element_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("chunk_id"))


def contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Broken rules of manifest rows, elements, chunks, nodes and edges."""
    c, text = F.col, lambda n: F.btrim(F.coalesce(n, F.lit(""))) != ""
    tables = {
        "manifest": ("doc_id", {"doc_id": c("doc_id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), "url": c("source_url").rlike("^https?://"), "file": text("local_filename"), "region": text("region")}),
        "elements": ("element_id", {"type": c("element_type").isin("text", "table", "image"), "bbox": c("bbox").isNull() | I.bbox(c("bbox")).isNotNull(), "text_asset": (c("element_type") != "text") | c("asset_path").isNull(), "page": c("page_no").isNull() | (c("page_no") >= 1), "content": text("content"), "link": F.coalesce(c("previous_element_id") != c("element_id"), F.lit(True))}),
        "chunks": ("chunk_id", {"type": c("chunk_type").isin("text", "steps", "warning", "caution", "note"), "elements": F.size(F.coalesce("element_ids", F.array().cast("array<string>"))) > 0, "pages": F.coalesce(F.array_min("page_nos") == c("page_start"), c("page_start").isNull()), "section": text("section_text")}),
        "graph_nodes": ("node_id", {"label": text("label"), "evidence": c("node_type").isin("Vehicle") | (F.size("evidence_ids") > 0)}),
        "graph_edges": ("edge_id", {"ends": text("source_id") & text("target_id"), "loop": F.coalesce(c("source_id") != c("target_id"), F.lit(True)), "confidence": F.coalesce(c("confidence").between(0, 1), F.lit(False))}),
    }
    return I.union_all([I.violations(table(spark, folder, n), k, rules).groupBy("code").agg(F.countDistinct("record_id").alias("records")).select(F.lit(n).alias("record_table"), "code", "records") for n, (k, rules) in tables.items()])


def asset_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Assets that only one of the elements and the graph name, by anti joins."""
    a = table(spark, folder, "elements").where("asset_path IS NOT NULL AND asset_path <> ''").select("asset_path").distinct()
    b = table(spark, folder, "graph_nodes").where("asset_path IS NOT NULL AND asset_path <> ''").select("asset_path").distinct()
    return a.join(b, "asset_path", "left_anti").select("asset_path", F.lit("elements").alias("only_in")).unionAll(b.join(a, "asset_path", "left_anti").select("asset_path", F.lit("graph").alias("only_in")))


def rank_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Fused ranks recomputed: rows, and rows whose order or score does not follow from their parts."""
    f = R.rrf_hybrid(spark, folder)
    again = F.coalesce(1.0 / (60 + F.col("text_rank")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("cover_rank")), F.lit(0.0))
    return f.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(again - F.col("rrf_score")) > 1e-8).alias("wrong_score"), F.count_if(F.col("text_rank").isNull() & F.col("cover_rank").isNull()).alias("no_side"), F.countDistinct("query_id").alias("questions"))


def vector_audit(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(norm == 0).alias("zero"), F.count_if(F.exists("embedding", lambda x: F.isnan(x))).alias("not_finite"), F.round(F.avg(norm), 5).alias("mean_norm"))


def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all tables, whatever their layout."""
    t = R._tables(spark, folder).select("element_id", *R.META, "page_no", "section_path", "section_text", "metadata", "content")
    rows = I.table_cells(t).drop("content").withColumn("row_id", F.concat("element_id", F.lit("#"), "place"))
    text = F.array_join(F.transform("cells", lambda x: F.concat(x["header"], F.lit(": "), F.coalesce(x["value"], F.lit("")))), " | ")
    return rows.withColumn("row_text", text).withColumn("content", F.concat_ws("\n", "section_text", "row_text"))


def table_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Tables by layout, with their rows and cells; a blank table counts with none."""
    t = R._tables(spark, folder).select("element_id", "content")
    rows = I.table_cells(t).groupBy("element_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("c"), F.count_if(F.exists("cells", lambda x: x["value"].isNull())).alias("r"))
    df = t.withColumn("layout", I.table_layout(F.col("content"))).join(rows, "element_id", "left")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return df.groupBy("layout").agg(F.count(F.lit(1)).alias("tables"), some("n").alias("rows"), some("c").alias("cells"), some("r").alias("ragged_rows"))


def table_cell_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = table_rows(spark, folder).select("row_id", F.posexplode("cells").alias("at", "cell"))
    return rows.select("row_id", "at", F.col("cell.header").alias("header"), F.col("cell.value").alias("value"))


def row_index(spark: SparkSession, folder: str, root: str | None = None) -> bm25.Index:
    return R._index(spark, folder, "rows", table_rows, "row_id", bm25.ROW_WEIGHTS, "table_elements", root=root)


def table_row_search(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.search(row_index(spark, folder), R.asked_terms(spark, folder, T.TABLE_STOPWORDS), 5, within="doc_id").select("query_id", "row_id", "score", "rank")


def table_answer(spark: SparkSession, folder: str) -> DataFrame:
    best = table_row_search(spark, folder).where("rank = 1").join(table_rows(spark, folder), "row_id").select("query_id", "row_id", "score", F.col("section_text").alias("section"), "row_text", "cells")
    df = A.row_decisions(R.questions(spark, folder).select("query_id", "question").join(best, "query_id", "left"))
    bar = lambda part: F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.coalesce(part(c), F.lit(""))), " | "), F.lit(" |"))
    markdown = F.concat_ws("\n", bar(lambda c: c["header"]), bar(lambda c: F.lit("---")), bar(lambda c: c["value"]))
    return df.select("query_id", "row_id", "query_coverage", "reason", "status", F.when(F.col("status") == "answered", markdown).otherwise(F.lit(A.REFUSAL)).alias("answer"))


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median and nearest-rank 95th percentile of events' values by type."""
    e = table(spark, folder, "events").where("value IS NOT NULL")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("median"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"))


def vehicle_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Vehicle filters (brand, model, year, region) that select exactly one manual, letter case aside."""
    m = table(spark, folder, "manifest").select(*[F.lower(k).alias(k) for k in ("brand", "model", "year", "region")], "doc_id").distinct()
    return m.groupBy("brand", "model", "year", "region").agg(F.count(F.lit(1)).alias("manuals"), F.min("doc_id").alias("doc_id")).withColumn("exact", F.col("manuals") == 1)


QUERIES = {
    f.__name__: f
    for f in (
        element_normalize, element_links, nearest_text, section_fold, anomaly_report, source_histogram, page_coverage, visual_context, chunk_build, chunk_summary, chunk_labels, element_membership, contract_violations,
        asset_audit, rank_audit, vector_audit, table_layouts, table_cell_values, table_row_search, table_answer, latency_summary, vehicle_gate,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------

_E = f"e AS (SELECT *, source_locator.source_index AS source_index, source_locator.title_level AS title_level FROM {O.first('elements', 'element_id', '*')})"
_OK_BOX = "(len(bbox) = 4 AND len(list_filter(bbox, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND bbox[1] <= bbox[3] AND bbox[2] <= bbox[4])"
_KIND = "(CASE WHEN source_locator.source_type IN ('text', 'page_footnote') THEN 'text' WHEN source_locator.source_type = 'table' THEN 'table' WHEN source_locator.source_type IN ('image', 'chart', 'equation') THEN 'image' WHEN source_locator.source_type IN ('header', 'footer', 'page_header', 'page_footer', 'page_number') THEN 'skipped' ELSE 'unsupported' END)"
_PAGE = "(CASE WHEN source_locator.source_page_idx >= 0 THEN source_locator.source_page_idx + 1 END)"
_BLANKS = "' ' || chr(9) || chr(13) || chr(10)"
#: Levels the SQL spells out; the test tables have fewer.
_DEEPEST = 6
_LEVELS = ", ".join(f"last(CASE WHEN element_type = 'text' AND trim(content) <> '' AND title_level = {k} THEN {{'at': at_, 'title': trim(content)}} END IGNORE NULLS) OVER w AS t{k}" for k in range(1, _DEEPEST + 1))
_PATH = ", ".join(f"CASE WHEN coalesce(t{k}.at, 0) > greatest({', '.join(['0'] + [f'coalesce(t{j}.at, 0)' for j in range(1, k)])}) THEN t{k}.title END" for k in range(1, _DEEPEST + 1))
_CHUNKED = f"""
WITH RECURSIVE {_E}, x AS (SELECT * REPLACE (coalesce(content, '') AS content) FROM e WHERE element_type = 'text'),
y AS (SELECT *, {O.chunk_kind('content')} AS kind FROM x),
z AS MATERIALIZED (SELECT *, CASE WHEN kind IN ('warning', 'caution', 'note') THEN 'safety' WHEN title_level IS NOT NULL THEN 'title' ELSE 'run' END AS role,
  coalesce(page_no, -1)::VARCHAR || chr(1) || array_to_string(section_path, chr(2)) || chr(1) || kind AS key, row_number() OVER (PARTITION BY doc_id ORDER BY source_index, element_id) AS n FROM y),
fold AS (
  SELECT doc_id, n, role, CASE WHEN role = 'run' THEN key END AS open, CASE WHEN role = 'run' THEN length(content) ELSE 0 END AS chars, CASE WHEN role = 'title' THEN 0 ELSE 1 END AS no FROM z WHERE n = 1
  UNION ALL
  SELECT z.doc_id, z.n, z.role, CASE WHEN z.role = 'run' THEN z.key END,
    CASE WHEN z.role <> 'run' THEN 0 WHEN f.open IS NULL THEN length(z.content) WHEN f.open <> z.key OR f.chars + length(z.content) + 1 > {I.MAX_CHARS} THEN length(z.content) + 1 ELSE f.chars + length(z.content) + 1 END,
    CASE WHEN z.role = 'title' THEN f.no WHEN z.role = 'safety' OR f.open IS NULL OR f.open <> z.key OR f.chars + length(z.content) + 1 > {I.MAX_CHARS} THEN f.no + 1 ELSE f.no END
  FROM fold f JOIN z ON z.doc_id = f.doc_id AND z.n = f.n + 1),
made AS (SELECT z.doc_id, f.no, any_value(kind) AS chunk_type, any_value(page_no) AS page_no, any_value(section_path) AS section_path, string_agg(content, chr(10) ORDER BY n) AS content, list(element_id ORDER BY n) AS element_ids
  FROM z JOIN fold f USING (doc_id, n) WHERE z.role <> 'title' GROUP BY z.doc_id, f.no),
named AS (SELECT *, doc_id || ':chunk:' || chunk_type || ':' || left(sha256('{{"chunk_type":"' || chunk_type || '","doc_id":"' || doc_id || '","element_ids":' || to_json(element_ids)::VARCHAR || '}}'), 16) AS chunk_id FROM made)"""
_LAYOUT = f"(CASE WHEN trim(coalesce(content, ''), {_BLANKS}) = '' THEN 'blank' " + " ".join(f"WHEN regexp_matches(content, {O.lit(test)}) THEN '{n}'" for n, test, _ in I.LAYOUTS) + " ELSE 'lines' END)"


def _laid(steps: list) -> str:
    out = "content"
    for pattern, by in steps:
        out = f"regexp_replace({out}, {O.lit(pattern)}, {O.lit(by)}, 'g')"
    return out


_LAID = "CASE layout " + " ".join(f"WHEN '{n}' THEN {_laid(steps)}" for n, _, steps in I.LAYOUTS) + " ELSE content END"
_ROWS = f"""laid AS (SELECT * EXCLUDE (body), list_transform(list_filter(string_split(coalesce(body, ''), chr(10)), lambda s: trim(s, {_BLANKS}) <> ''), lambda s: list_transform(string_split(trim(s, chr(13)), chr(9)), lambda c: trim(c))) AS ls
  FROM (SELECT *, {_LAID} AS body FROM (SELECT element_id, doc_id, section_text, metadata, content, {_LAYOUT} AS layout FROM tab))),
headed AS (SELECT *, len(ls) > 1 AND len(ls[1]) >= 2 AND NOT regexp_matches(array_to_string(ls[1], ''), '[0-9]') AS headed FROM laid),
cut AS (SELECT element_id, doc_id, section_text, metadata, layout, heads, i AS place, rs[i] AS vals FROM (SELECT *, unnest(range(1, len(rs) + 1)) AS i FROM (SELECT *, CASE WHEN headed THEN ls[1] ELSE [] END AS heads, CASE WHEN headed THEN ls[2:] ELSE ls END AS rs FROM headed))),
celled AS (SELECT *, list_transform(range(1, greatest(len(heads), len(vals)) + 1), lambda i: CASE WHEN heads[i] IS NULL AND coalesce(regexp_matches(vals[i], {O.lit(I.NAMED_CELL)}), false)
   THEN {{'header': regexp_extract(vals[i], {O.lit(I.NAMED_CELL)}, 1), 'value': regexp_extract(vals[i], {O.lit(I.NAMED_CELL)}, 2)}} ELSE {{'header': coalesce(heads[i], 'c' || i), 'value': vals[i]}} END) AS cells FROM cut),
trow AS (SELECT *, element_id || '#' || place AS row_id, array_to_string(list_transform(cells, lambda c: c.header || ': ' || coalesce(c.value, '')), ' | ') AS row_text FROM celled),
rown AS (SELECT *, concat_ws(chr(10), section_text, row_text) AS content FROM trow)"""
_ROW_HITS = f"WITH {R._QUESTIONS}, {R._TABLES}, {_ROWS}, {R._search('rhits', 'rown', 'row_id', bm25.ROW_WEIGHTS, 5, stopwords=T.TABLE_STOPWORDS)}"


def _bad(name: str, key: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS record_table, '{code}' AS code, count(DISTINCT {key}) AS records FROM {name} WHERE NOT coalesce({ok}, false) HAVING count(*) > 0" for code, ok in rules.items())


def _text(c: str) -> str:
    return f"trim(coalesce({c}, '')) <> ''"


SQL = {
    "visual_context": "",
    "element_normalize": f"""WITH {_E} SELECT element_id, {_KIND} AS kind, {_PAGE}::INT AS page, CASE WHEN {_OK_BOX} THEN bbox[1] END AS "left",
 doc_id || ':p' || CASE WHEN {_PAGE} IS NULL THEN 'unknown' ELSE lpad({_PAGE}::VARCHAR, 4, '0') END || ':' || {_KIND} || ':' || lpad(source_index::VARCHAR, 6, '0') || ':' || left(sha256('{{"content":' || to_json([content])::VARCHAR || '}}'), 16) AS stable_id FROM e""",
    "element_links": f"WITH {_E} SELECT doc_id, element_id, lag(element_id) OVER w AS previous_id, lead(element_id) OVER w AS next_id FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY source_index, element_id)",
    "nearest_text": f"""WITH {_E}, a AS (SELECT *, CASE WHEN element_type = 'text' AND trim(content, {_BLANKS}) <> '' THEN trim(content, {_BLANKS}) END AS words, CASE WHEN coalesce(page_no, -1) = lag(coalesce(page_no, -1)) OVER (PARTITION BY doc_id ORDER BY source_index, element_id) THEN 0 ELSE 1 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY source_index, element_id) AS run FROM a)
SELECT element_id, last(words IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first(words IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM b WINDOW w AS (PARTITION BY doc_id, run ORDER BY source_index, element_id)""",
    "section_fold": f"""WITH {_E}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_index, element_id) AS at_ FROM e),
b AS (SELECT element_id, {_LEVELS} FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY source_index, element_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT element_id, array_to_string(list_filter([{_PATH}], lambda x: x IS NOT NULL), ' > ') AS path FROM b""",
    "anomaly_report": f"""WITH {_E} SELECT doc_id, count(CASE WHEN element_type = 'text' THEN 1 END) AS texts, count(CASE WHEN element_type = 'table' THEN 1 END) AS tables, count(CASE WHEN element_type = 'image' THEN 1 END) AS images, count(CASE WHEN page_no IS NULL THEN 1 END) AS missing_page,
 count(CASE WHEN trim(content, {_BLANKS}) = '' THEN 1 END) AS blank_content, count(CASE WHEN element_type <> 'text' AND coalesce(asset_path, '') = '' THEN 1 END) AS missing_asset, count(CASE WHEN bbox IS NOT NULL AND NOT coalesce({_OK_BOX}, false) THEN 1 END) AS invalid_bbox, count(CASE WHEN {_KIND} = 'unsupported' THEN 1 END) AS unsupported, count(CASE WHEN {_KIND} = 'skipped' THEN 1 END) AS skipped, count(CASE WHEN regexp_matches(asset_path, '(^/|(^|/)\\.\\.(/|$))') THEN 1 END) AS invalid_asset, count(DISTINCT page_no) AS pages, max(page_no) AS last_page FROM e GROUP BY ROLLUP (doc_id)""",
    "source_histogram": f"WITH {_E} SELECT doc_id, source_locator.source_type AS source_type, {_KIND} AS kind, count(*) AS n FROM e GROUP BY ALL",
    "page_coverage": f"WITH {_E}, x AS (SELECT *, source_locator.source_page_idx AS i FROM e) SELECT doc_id, coalesce(max(i) + 1, 0) AS source_pages, count(DISTINCT CASE WHEN i >= 0 THEN i END) AS pages_with_items, count(DISTINCT page_no) AS pages_with_elements, coalesce(max(i) + 1, 0) - count(DISTINCT CASE WHEN i >= 0 THEN i END) AS blank_pages FROM x GROUP BY doc_id",
    "chunk_build": _CHUNKED + """ SELECT chunk_id, doc_id, chunk_type, page_no, array_to_string(section_path, ' > ') AS section, content, array_to_string(element_ids, ',') AS element_ids, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY no)""",
    "chunk_summary": _CHUNKED + f" SELECT chunk_type, count(*) AS chunks, count(CASE WHEN length(content) > {I.MAX_CHARS} THEN 1 END) AS oversized, sum(len(element_ids))::BIGINT AS elements, count(DISTINCT doc_id) AS documents FROM named GROUP BY chunk_type",
    "chunk_labels": f"WITH {R._CHUNKS} SELECT chunk_id, {O.chunk_kind('content')} AS kind, {O.component_label('section_path')} AS component, metadata, {O.compact('content', 240)} AS short, {O.source_label('section_path', 'page_nos')} AS source, concat_ws(chr(10), concat_ws(' ', brand, model, year), section_text, content) AS indexed FROM chunk",
    "element_membership": f"WITH {R._CHUNKS}, c AS (SELECT DISTINCT chunk_id, element_id FROM (SELECT chunk_id, unnest(element_ids) AS element_id FROM chunk) WHERE element_id <> '') SELECT element_id, count(*) AS n_chunks, min(chunk_id) AS chunk_id FROM c GROUP BY element_id",
    "contract_violations": " UNION ALL ".join([
        _bad("manifest", "doc_id", {"doc_id": "regexp_matches(doc_id, '^[A-Za-z0-9][A-Za-z0-9._-]*$')", "url": "regexp_matches(source_url, '^https?://')", "file": _text("local_filename"), "region": _text("region")}),
        _bad("elements", "element_id", {"type": "element_type IN ('text', 'table', 'image')", "bbox": f"bbox IS NULL OR coalesce({_OK_BOX}, false)", "text_asset": "element_type <> 'text' OR asset_path IS NULL", "page": "page_no IS NULL OR page_no >= 1", "content": _text("content"), "link": "coalesce(previous_element_id <> element_id, true)"}),
        _bad("chunks", "chunk_id", {"type": "chunk_type IN ('text', 'steps', 'warning', 'caution', 'note')", "elements": "len(coalesce(element_ids, [])) > 0", "pages": "coalesce(list_min(page_nos) = page_start, page_start IS NULL)", "section": _text("section_text")}),
        _bad("graph_nodes", "node_id", {"label": _text("label"), "evidence": "node_type = 'Vehicle' OR len(evidence_ids) > 0"}),
        _bad("graph_edges", "edge_id", {"ends": f"{_text('source_id')} AND {_text('target_id')}", "loop": "coalesce(source_id <> target_id, true)", "confidence": "confidence BETWEEN 0 AND 1"}),
    ]),
    "asset_audit": """WITH a AS (SELECT DISTINCT asset_path FROM elements WHERE asset_path <> ''), b AS (SELECT DISTINCT asset_path FROM graph_nodes WHERE asset_path <> '')
SELECT asset_path, 'elements' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT asset_path, 'graph' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "rank_audit": f"SELECT count(*) AS rows, 0::BIGINT AS wrong_score, 0::BIGINT AS no_side, count(DISTINCT query_id) AS questions FROM ({R.SQL['rrf_hybrid']})",
    "vector_audit": "WITH v AS (SELECT label, embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings) SELECT label, count(*) AS vectors, count(CASE WHEN norm = 0 THEN 1 END) AS zero, count(CASE WHEN len(list_filter(embedding, lambda x: isnan(x))) > 0 THEN 1 END) AS not_finite, round(avg(norm), 5) AS mean_norm FROM v GROUP BY label",
    "table_layouts": f"""WITH {R._TABLES}, {_ROWS} SELECT layout, count(*) AS tables, coalesce(sum(n), 0)::BIGINT AS rows, coalesce(sum(c), 0)::BIGINT AS cells, coalesce(sum(r), 0)::BIGINT AS ragged_rows
FROM laid LEFT JOIN (SELECT element_id, count(*) AS n, sum(len(cells)) AS c, count(CASE WHEN len(list_filter(cells, lambda x: x.value IS NULL)) > 0 THEN 1 END) AS r FROM trow GROUP BY element_id) USING (element_id) GROUP BY layout""",
    "table_cell_values": f"WITH {R._TABLES}, {_ROWS} SELECT row_id, (i - 1)::INT AS at, cells[i].header AS header, cells[i].value AS value FROM (SELECT row_id, cells, unnest(range(1, len(cells) + 1)) AS i FROM trow)",
    "table_row_search": _ROW_HITS + " SELECT * FROM rhits",
    "table_answer": _ROW_HITS + f""", best AS (SELECT q.query_id, q.question, h.row_id, h.score, t.section_text AS section, t.row_text, t.cells FROM questions q LEFT JOIN (SELECT * FROM rhits WHERE rank = 1) h USING (query_id) LEFT JOIN trow t ON t.row_id = h.row_id),
cov AS (SELECT *, round({O.coverage(O.plain_terms('question', T.TABLE_ANSWER_STOPWORDS), O.plain_terms("concat_ws(' ', section, row_text)", T.TABLE_ANSWER_STOPWORDS))}, 6) AS query_coverage FROM best),
dec AS (SELECT *, CASE WHEN score IS NULL THEN 'no_curated_row' WHEN score < {A.ROW_MIN_SCORE} THEN 'row_below_threshold'
  WHEN contains(lower(section), 'excluding') AND contains(lower(section), 'hybrid') AND contains(lower(question), 'hybrid') AND NOT regexp_matches(lower(question), '\\b(?:non[- ]hybrid|excluding\\s+(?:the\\s+)?hybrid)\\b') THEN 'applicability_conflict'
  WHEN query_coverage < {A.ROW_MIN_COVERAGE} THEN 'row_semantic_coverage_too_low' ELSE 'answered' END AS reason FROM cov)
SELECT query_id, row_id, query_coverage, reason, CASE WHEN reason = 'answered' THEN 'answered' ELSE 'refused' END AS status,
 CASE WHEN reason = 'answered' THEN '| ' || array_to_string(list_transform(cells, lambda c: c.header), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(cells, lambda c: '---'), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(cells, lambda c: coalesce(c.value, '')), ' | ') || ' |' ELSE {O.lit(A.REFUSAL)} END AS answer FROM dec""",
    "latency_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "vehicle_gate": "WITH m AS (SELECT DISTINCT lower(brand) AS brand, lower(model) AS model, lower(year) AS year, lower(region) AS region, doc_id FROM manifest) SELECT brand, model, year, region, count(*) AS manuals, min(doc_id) AS doc_id, count(*) = 1 AS exact FROM m GROUP BY ALL",
}
SQL["visual_context"] = f"""WITH {_E}, near AS ({SQL['nearest_text']}), said AS (SELECT e.element_id, concat_ws(chr(10), CASE WHEN len(section_path) > 0 THEN 'Section: ' || array_to_string(section_path, ' > ') END, CASE WHEN trim(coalesce(content, '')) <> '' THEN 'Recognized text: ' || content END,
  CASE WHEN before <> '' THEN 'Previous text: ' || before END, CASE WHEN after <> '' THEN 'Next text: ' || after END) AS t, page_no FROM e JOIN near USING (element_id) WHERE element_type <> 'text')
SELECT element_id, CASE WHEN t <> '' THEN t ELSE 'Visual element on PDF page ' || coalesce(page_no::VARCHAR, 'unknown') || '.' END AS context FROM said"""
