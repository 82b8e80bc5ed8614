"""Typed property graph of manuals: building it from chunks and elements, and bounded path search in it.

What a chunk or an element adds is a list of templates (relation, source kind, target kind): every row builds its own
ids, so nodes and edges come out of projections; only what depends on first sightings or shared sections is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.plans.workspace import remove, tidy, written
from quireflow.sources.files import open_index, write_index

META = ["doc_id", "brand", "model", "year", "region", "language", "manual_type"]

# Weights of relations and node types.
RELATION_WEIGHTS = {
    "SYMBOL_MEANS": 1.00, "REQUIRES_STEP": 0.98, "NEXT_STEP": 0.96, "HAS_WARNING": 0.95, "HAS_SPECIFICATION": 0.93,
    "EXPLAINED_BY": 0.90, "ILLUSTRATED_BY": 0.88, "LOCATED_IN": 0.82, "REFERENCES": 0.78, "APPLIES_TO": 0.55,
}
NODE_WEIGHTS = {
    "Symbol": 1.00, "Component": 0.98, "Procedure": 0.97, "Specification": 0.96, "Warning": 0.95, "Caution": 0.95,
    "Step": 0.92, "Section": 0.88, "Table": 0.84, "Image": 0.82, "EvidencePage": 0.55, "Vehicle": 0.45,
}
# Relations not followed, and limits of a search.
NOT_FOLLOWED = ("APPLIES_TO", "REFERENCES")
FAN_OUT, BEAM, ENTITIES, PATHS = 40, 30, 8, 5
SCORE_SCALE = 12.0

#: What a chunk of a kind adds. Sources and targets name ids a chunk row has; a page edge needs a page.
CHUNK_EDGES = [
    ("safety", "LOCATED_IN", "safety", "section"), ("safety", "HAS_WARNING", "section", "safety"),
    ("safety", "HAS_WARNING", "component", "safety"), ("safety", "APPLIES_TO", "safety", "vehicle"), ("safety", "REFERENCES", "safety", "page"),
    ("procedure", "LOCATED_IN", "procedure", "section"), ("procedure", "EXPLAINED_BY", "component", "procedure"),
    ("procedure", "APPLIES_TO", "procedure", "vehicle"), ("procedure", "REFERENCES", "procedure", "page"),
    ("specification", "LOCATED_IN", "specification", "section"), ("specification", "HAS_SPECIFICATION", "section", "specification"),
    ("specification", "HAS_SPECIFICATION", "component", "specification"), ("specification", "APPLIES_TO", "specification", "vehicle"),
    ("specification", "REFERENCES", "specification", "page"),
    ("symbol", "LOCATED_IN", "symbol", "section"), ("symbol", "SYMBOL_MEANS", "symbol", "component"),
    ("symbol", "APPLIES_TO", "symbol", "vehicle"), ("symbol", "REFERENCES", "symbol", "page"),
]
ELEMENT_EDGES = [
    ("any", "LOCATED_IN", "visual", "section", 1.0), ("any", "APPLIES_TO", "visual", "vehicle", 1.0), ("any", "REFERENCES", "visual", "page", 1.0),
    ("image", "ILLUSTRATED_BY", "section", "visual", 1.0), ("table", "HAS_SPECIFICATION", "component", "visual", 0.75),
]
FIRST_EDGES = [("LOCATED_IN", "component", "section"), ("EXPLAINED_BY", "component", "section"), ("APPLIES_TO", "component", "vehicle"), ("REFERENCES", "component", "page")]


def json_list(*parts: Column | tuple[Column, str]) -> Column:
    """A JSON list; a part is a text column, or (column, 'raw') for numbers and arrays."""
    out = []
    for p in parts:
        if isinstance(p, tuple):
            out.append(F.coalesce(p[0], F.lit("null")))
        else:
            one = F.to_json(F.array(p))
            out.append(one.substr(F.lit(2), F.length(one) - 2))
    return F.concat(F.lit("["), F.concat_ws(",", *out), F.lit("]"))


def graph_id(prefix: str, *parts: Column | tuple[Column, str]) -> Column:
    return F.concat(F.lit(prefix + ":"), F.left(F.sha2(json_list(*parts), 256), F.lit(20)))


def _raw(array: Column) -> tuple[Column, str]:
    return (F.to_json(array), "raw")


def _node_id(kind: str, *parts) -> Column:
    return graph_id("node", F.col("doc_id"), F.lit(kind), *parts)


def with_ids(records: DataFrame) -> DataFrame:
    """Records (doc_id, page_no, section_path) with the ids of their vehicle, page, section and component."""
    stripped = F.filter(F.transform("section_path", lambda s: F.btrim(s)), lambda s: s != "")
    return (
        records.withColumn("stripped", stripped)
        .withColumn("vehicle", _node_id("Vehicle"))
        .withColumn("page", F.when(F.col("page_no").isNotNull(), _node_id("EvidencePage", (F.col("page_no").cast("string"), "raw"))))
        .withColumn("section", _node_id("Section", _raw(F.col("stripped"))))
        .withColumn("component", _node_id("Component", _raw(F.col("section_path")), T.component_label(F.col("section_path"))))
    )


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunks with ids of all they may add, their steps, and flags of what they are."""
    df = with_ids(chunks.withColumn("page_no", F.col("page_start")))
    label, steps = T.component_label(F.col("section_path")), T.steps_of(F.col("content"), F.col("chunk_type") == "steps")
    df = df.withColumn("label", label).withColumn("steps", steps).withColumn("evidence", F.filter(F.coalesce("element_ids", F.array().cast("array<string>")), lambda e: e != ""))
    named = lambda kind: _node_id(kind, F.col("chunk_id"))
    return (
        df.withColumn("is_safety", F.col("chunk_type").isin("warning", "caution"))
        .withColumn("is_procedure", (F.col("chunk_type") == "steps") | (F.size("steps") > 0) | F.col("label").rlike(T.ACTION))
        .withColumn("is_specification", F.concat_ws(" ", "label", "content").rlike(T.SPECIFICATION))
        .withColumn("is_symbol", F.concat_ws(" ", F.array_join("section_path", " "), "content").rlike(T.SYMBOL))
        .withColumn("safety", F.when(F.col("chunk_type") == "warning", named("Warning")).when(F.col("chunk_type") == "caution", named("Caution")))
        .withColumn("procedure", named("Procedure"))
        .withColumn("specification", named("Specification"))
        .withColumn("symbol", named("Symbol"))
    )


def element_records(elements: DataFrame) -> DataFrame:
    """Images and tables with the ids they add."""
    df = with_ids(elements.where(F.col("element_type").isin("image", "table")))
    visual = F.when(F.col("element_type") == "image", _node_id("Image", F.col("element_id"))).otherwise(_node_id("Table", F.col("element_id")))
    return df.withColumn("visual", visual).withColumn("evidence", F.array("element_id"))


def _edge(relation: str, source: str, target: str, evidence: Column | None = None, page: Column | None = None, confidence: float = 1.0) -> Column:
    return F.struct(
        F.lit(relation).alias("edge_type"), F.col(source).alias("source_id"), F.col(target).alias("target_id"),
        (F.col("evidence") if evidence is None else evidence).alias("evidence"), (F.col("page_no") if page is None else page).cast("int").alias("page_no"), F.lit(confidence).alias("confidence"),
    )


def _first_sightings(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Chunks, then elements, in order of arrival: seen, doc ids, path, page and the first evidence of each."""
    cols = [*META, "page_no", "section_path", "stripped", "vehicle", "page", "section", "component"]
    first = F.slice("evidence", 1, 1).alias("evidence")
    a = chunks.select(F.struct(F.lit(0).alias("src"), F.col("ingested_at").alias("at"), F.col("chunk_id").alias("id")).alias("seen"), *cols, first)
    b = elements.select(F.struct(F.lit(1).alias("src"), F.col("ingested_at").alias("at"), F.col("element_id").alias("id")).alias("seen"), *cols, first)
    return a.unionByName(b)


def _first_by(df: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "seen")]
    one = df.groupBy(*keys).agg(F.min(F.struct("seen", *rest)).alias("f"))
    return one.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest])


def _prefixes(seen: DataFrame) -> DataFrame:
    """Every sighting of a section: the section itself and its parents, each with its own id and its parent's."""
    n = F.greatest(F.size("stripped"), F.lit(1))
    df = seen.withColumn("depth", F.explode(F.sequence(F.lit(1), n))).withColumn("prefix", F.slice("stripped", 1, F.col("depth")))
    own = _node_id("Section", _raw(F.col("prefix")))
    parent = F.when(F.col("depth") > 1, _node_id("Section", _raw(F.slice("stripped", 1, F.col("depth") - 1))))
    return df.withColumn("own", own).withColumn("parent", parent)


#: Most characters of a node's label and text.
LABEL_LIMIT, NODE_TEXT_LIMIT = 240, 1200


def node_row(kind: Column, ident: Column, label: Column, text: Column, page: Column, path: Column, evidence: Column, asset: Column | None = None, properties: Column | None = None, cut: bool = False) -> list[Column]:
    """Columns of a node record from a row that has the manual's fields: label and text compacted (unless the text is ``cut``
    already), blank evidence dropped."""
    return [
        ident.alias("node_id"), kind.alias("node_type"), T.compact(label, LABEL_LIMIT).alias("label"), (F.coalesce(text, F.lit("")) if cut else T.compact(F.coalesce(text, F.lit("")), NODE_TEXT_LIMIT)).alias("text"), *[F.col(c) for c in META],
        page.cast("int").alias("page_no"), path.alias("section_path"), F.filter(evidence, lambda e: e.isNotNull() & (e != "")).alias("evidence"),
        (F.lit(None).cast("string") if asset is None else asset).alias("asset_path"), F.coalesce(F.to_json(properties) if properties is not None else F.lit("{}"), F.lit("{}")).alias("properties"),
    ]


def build_nodes(manifest: DataFrame, chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """node_id, node_type, label, text, the manual's fields, page_no, section_path, evidence, asset_path, properties (JSON):
    one row per node, as first seen.

    A chunk without a page has no page node; an empty section path is the section "Unsectioned evidence". Elements may
    lack asset_path.
    """
    if "asset_path" not in elements.columns:
        elements = elements.withColumn("asset_path", F.lit(None).cast("string"))
    c, e = written(chunk_records(chunks).withColumn("content", T.compact(F.col("content"), NODE_TEXT_LIMIT)), "graph_chunks"), element_records(elements)
    seen = _first_sightings(c, e)
    none, col = F.array().cast("array<string>"), F.col
    vehicles = manifest.groupBy("doc_id").agg(F.min(F.struct(*META[1:])).alias("m")).select("doc_id", "m.*")
    name = F.concat_ws(" ", "brand", "model", "year")
    section_of = lambda path: T.section_text(path)
    kind = F.initcap("chunk_type")
    own = lambda flag, node, kind, label: c.where(flag).select(*node_row(kind, col(node), label, col("content"), col("page_no"), col("section_path"), col("evidence"), cut=True))
    visual = F.initcap("element_type")
    parts = [
        vehicles.select(*node_row(F.lit("Vehicle"), _node_id("Vehicle"), name, name, F.lit(None), none, none)),
        _first_by(seen.where("page IS NOT NULL"), "page").select(*node_row(F.lit("EvidencePage"), col("page"), F.concat(F.lit("Physical PDF page "), "page_no"), section_of(col("section_path")), col("page_no"), col("section_path"), col("evidence"))),
        _first_by(_prefixes(seen), "own").select(*node_row(F.lit("Section"), col("own"), T.section_label(col("prefix")), section_of(col("prefix")), col("page_no"), col("prefix"), col("evidence"))),
        _first_by(seen, "component").select(*node_row(F.lit("Component"), col("component"), T.component_label(col("section_path")), section_of(col("section_path")), col("page_no"), col("section_path"), col("evidence"))),
        own("is_safety", "safety", kind, F.concat(kind, F.lit(": "), "label")),
        own("is_procedure", "procedure", F.lit("Procedure"), col("label")),
        own("is_specification", "specification", F.lit("Specification"), col("label")),
        own("is_symbol", "symbol", F.lit("Symbol"), col("label")),
        _steps(c).select(*node_row(F.lit("Step"), col("step"), F.concat(F.lit("Step "), "position"), col("text"), col("page_no"), col("section_path"), col("evidence"), properties=F.struct("position"))),
        e.select(*node_row(visual, col("visual"), F.concat(visual, F.lit(": "), T.section_label(col("section_path"))), col("content"), col("page_no"), col("section_path"), col("evidence"), col("asset_path"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _steps(c: DataFrame) -> DataFrame:
    """One row per step, with its id and the one before's; a chunk's own list gives both, without a join."""
    df = c.where("is_procedure").select(*META, "chunk_id", "page_no", "section_path", "evidence", "vehicle", "page", "procedure", F.posexplode("steps").alias("place", "text"))
    at = lambda place: _node_id("Step", F.col("chunk_id"), (place.cast("string"), "raw"))
    return df.withColumn("position", F.col("place") + 1).withColumn("step", at(F.col("place") + 1)).withColumn("before", F.when(F.col("place") > 0, at(F.col("place"))))


def build_edges(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """edge_id, edge_type, source_id, target_id, doc_id, page_no, evidence, confidence: one row per edge id.

    An id covers evidence and page, so parallel edges of other evidence stay.
    """
    c, e = written(chunk_records(chunks).drop("content"), "graph_chunks"), written(element_records(elements).drop("content"), "graph_elements")
    seen = written(_first_sightings(c, e), "graph_seen")

    def edges(df: DataFrame, made: list[Column]) -> DataFrame:
        rows = df.select("doc_id", F.explode(F.filter(F.array(*made), lambda x: x["source_id"].isNotNull() & x["target_id"].isNotNull())).alias("e"))
        return rows.select("doc_id", "e.*")

    of = lambda flag, edge: F.when(F.col(f"is_{flag}"), edge)
    parts = [
        edges(c, [F.coalesce(of(kind, _edge(r, s, t)), _edge(r, s, t).withField("source_id", F.lit(None).cast("string"))) for kind, r, s, t in CHUNK_EDGES]),
        edges(_steps(c), [_edge("REQUIRES_STEP", "procedure", "step"), _edge("APPLIES_TO", "step", "vehicle"), _edge("REFERENCES", "step", "page"), _edge("NEXT_STEP", "before", "step")]),
        edges(_first_by(seen, "component"), [_edge(r, s, t) for r, s, t in FIRST_EDGES]),
        edges(_first_by(seen.where("page IS NOT NULL"), "page"), [_edge("APPLIES_TO", "page", "vehicle")]),
        edges(_first_by(_prefixes(seen), "own"), [_edge("APPLIES_TO", "own", "vehicle"), _edge("LOCATED_IN", "own", "parent"), _edge("REFERENCES", "own", "page")]),
        edges(seen, [_edge("REFERENCES", "section", "page")]),
    ]
    for kind, r, s, t, confidence in ELEMENT_EDGES:
        own = e if kind == "any" else e.where(F.col("element_type") == kind)
        parts.append(edges(own, [_edge(r, s, t, confidence=confidence)]))
    same = ["doc_id", "section_path"]
    symbols = c.where("is_symbol").select(*same, "symbol")
    parts.append(edges(e.where("element_type = 'image'").join(symbols, same), [_edge("ILLUSTRATED_BY", "symbol", "visual")]))
    safety = c.where("is_safety").select(*same, F.col("safety").alias("safe"), F.col("evidence").alias("proof"))
    parts.append(edges(c.where("is_procedure").join(safety, same), [_edge("HAS_WARNING", "procedure", "safe", F.col("proof"), F.lit(None))]))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ident = graph_id("edge", F.col("doc_id"), F.col("edge_type"), F.col("source_id"), F.col("target_id"), _raw(F.col("evidence")), (F.col("page_no").cast("string"), "raw"))
    return every.withColumn("edge_id", ident).groupBy("edge_id").agg(*[F.min(k).alias(k) for k in ("edge_type", "source_id", "target_id", "doc_id", "page_no", "evidence", "confidence")])


def adjacency(edges: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, node, other, edge_id, edge_type, confidence: both directions of followed edges, the first ``fan_out`` of
    each node by relation and id. Null ends and loops are left out; a null confidence counts as 1."""
    held = edges.where(~F.col("edge_type").isin(*NOT_FOLLOWED) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & (F.col("source_id") != F.col("target_id")))
    held = held.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    rest = ["doc_id", "edge_id", "edge_type", "confidence"]
    both = held.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), *rest).unionByName(held.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), *rest))
    order = Window.partitionBy("doc_id", "node").orderBy("edge_type", "edge_id")
    return both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fan_out).drop("n")


def _weight(table: dict[str, float], column: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(column))


def node_terms(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("terms", T.plain_terms(F.concat_ws(" ", "label", "text"), T.GRAPH_STOPWORDS, T.JOINED_TOKEN))


KIND = "graph"


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a graph index: nodes with their terms, and steps, the adjacency with type and terms of where each leads.
    Repeated node ids are an error. Both are parted by ranges of manual and node, so a large manual takes several files."""
    spark, posted = nodes.sparkSession, f"{path}/_made"
    node_terms(nodes).write.parquet(posted)
    termed = spark.read.parquet(posted)
    twice = termed.groupBy("node_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"node {twice['node_id']} is indexed {twice['count']} times")
    tidy(spark)
    ends = termed.select(F.col("node_id").alias("other"), "doc_id", "node_type", "terms")
    adjacency(edges).write.parquet(f"{path}/_near")
    tidy(spark)
    lay = lambda df, *by: df.repartitionByRange(*by).sortWithinPartitions(*by)

    def steps() -> DataFrame:
        tidy(spark)
        return lay(spark.read.parquet(f"{path}/_near").join(ends, ["doc_id", "other"]), "doc_id", "node")

    write_index({"nodes": lay(termed, "doc_id", "node_id"), "steps": steps}, path, KIND)
    for made in (posted, f"{path}/_near"):
        remove(spark, made)
    tidy(spark)


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and steps of a written graph index."""
    t = open_index(spark, path, KIND)
    return t["nodes"], t["steps"]


def entity_scores(hits: DataFrame, nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, node_id, doc_id, wanted, score of each entity hit (query_id, node_id, score); nodes with their terms."""
    wanted = questions.select("query_id", T.plain_terms(F.col("question"), T.GRAPH_STOPWORDS, T.JOINED_TOKEN).alias("wanted"))
    df = hits.select("query_id", "node_id", F.col("score").alias("raw")).join(wanted, "query_id").join(nodes.select("node_id", "doc_id", "node_type", "terms"), "node_id")
    score = 0.48 * F.least(F.col("raw") / SCORE_SCALE, F.lit(1.0)) + 0.37 * T.coverage(F.col("wanted"), F.col("terms")) + 0.15 * _weight(NODE_WEIGHTS, "node_type")
    return df.select("query_id", "node_id", "doc_id", "wanted", F.round(score, 9).alias("score"))


def paths(entities: DataFrame, steps: DataFrame, limit: int = PATHS, beam: int = BEAM, hops: int = 2) -> DataFrame:
    """query_id, doc_id, path_id, path, edges, hops, score, rank: the best paths of up to ``hops`` hops from the entities of
    each question, over the steps of a graph index. path and edges are lists of ids.

    Each hop adds relation weight times confidence over hop + 0.5, a fifth of the new node's share of the question's
    terms, and 0.08 of its type's weight. All of a hop's paths count; only the ``beam`` best of an anchor go on. A path
    repeats no node, and begins at its anchor; an entity given twice counts with its best score. Ranks go by the score of 6 digits, then the path's id.
    """
    if hops not in (1, 2):
        raise ValueError("hops must be 1 or 2")
    once = ["query_id", "doc_id", "wanted", "node_id"]
    entities = entities.groupBy(*once).agg(F.max("score").alias("score"))
    front = entities.select("query_id", "doc_id", "wanted", F.col("node_id").alias("anchor"), F.col("node_id").alias("node"), F.array("node_id").alias("path"), F.array().cast("array<string>").alias("edges"), "score")
    found = None
    for hop in range(1, hops + 1):
        gain = _weight(RELATION_WEIGHTS, "edge_type") * F.col("confidence") / (hop + 0.5) + 0.20 * T.coverage(F.col("wanted"), F.col("terms")) + 0.08 * _weight(NODE_WEIGHTS, "node_type")
        grown = front.join(steps, ["doc_id", "node"]).where(~F.array_contains("path", F.col("other")))
        grown = grown.select(
            "query_id", "doc_id", "wanted", "anchor", F.col("node").alias("left"), F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"), F.concat("edges", F.array("edge_id")).alias("edges"), F.round(F.col("score") + gain, 9).alias("score")
        )
        made = grown.select("query_id", "doc_id", "path", "edges", F.lit(hop).alias("hops"), "score")
        found = made if found is None else found.unionByName(made)
        # The first hop leaves from anchors, so the join has put an anchor's rows together.
        order = Window.partitionBy("query_id", *(["doc_id", "left"] if hop == 1 else ["anchor"])).orderBy(F.desc("score"), "node", F.array_join("edges", ">"))
        front = grown.withColumn("n", F.row_number().over(order)).where(F.col("n") <= beam).drop("n", "left")
    # The best go before they are shuffled: a path begins at its anchor, so only entities given twice find it again.
    held = found.withColumn("score", F.round("score", 6)).withColumn("path_id", graph_id("path", F.col("doc_id"), _raw(F.col("path")), _raw(F.col("edges"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path_id")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: Node types a path's content leaves out, and the most characters of it.
NOT_QUOTED, PATH_CONTENT = ("Vehicle", "EvidencePage"), 1800


def path_records(found: DataFrame, nodes: DataFrame, edges: DataFrame, content: bool = True) -> DataFrame:
    """``paths`` with what a citation needs: the anchor's manual, page_nos (distinct, ascending), section_path (the longest,
    the first of equals), node_types, node_labels, relations (in order), evidence_ids (first seen first), content, source.

    Nodes are joined once for all places of all paths, which ``paths`` has cut to a few a question. Without ``content`` their texts
    stay where they are.
    """
    nodes = nodes if content else nodes.withColumn("text", F.lit(""))
    keys = ["query_id", "path_id"]
    at = found.select(*keys, F.posexplode("path").alias("at", "node_id"))
    held = at.join(nodes.select("node_id", *META[1:], "node_type", "label", "text", "page_no", "section_path", "evidence_ids"), "node_id")
    rows = F.array_sort(F.collect_list(F.struct("at", *META[1:], "node_type", "label", "text", "page_no", "section_path", "evidence_ids")))
    gathered = held.groupBy(*keys).agg(rows.alias("ns"))
    quoted = F.transform(F.filter("ns", lambda n: ~n["node_type"].isin(*NOT_QUOTED)), lambda n: F.concat(n["node_type"], F.lit(" "), n["label"], F.lit(": "), F.coalesce(n["text"], F.lit(""))))
    longest = F.array_max(F.transform("ns", lambda n: F.struct(F.size(n["section_path"]).alias("n"), (-n["at"]).alias("at"), n["section_path"].alias("p"))))
    of = lambda field: F.transform("ns", lambda n: n[field])
    made = gathered.select(
        *keys, *[F.col("ns")[0][c].alias(c) for c in META[1:]], F.array_sort(F.array_distinct(F.array_compact(of("page_no")))).alias("page_nos"), longest["p"].alias("section_path"),
        of("node_type").alias("node_types"), of("label").alias("node_labels"), F.array_distinct(F.filter(F.flatten(F.filter(of("evidence_ids"), lambda e: e.isNotNull())), lambda e: e != "")).alias("evidence_ids"),
        T.compact(F.array_join(quoted, " | "), PATH_CONTENT).alias("content"),
    )
    steps = found.select(*keys, F.posexplode("edges").alias("at", "edge_id")).join(edges.select("edge_id", "edge_type"), "edge_id")
    relations = steps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "edge_type"))), lambda x: x["edge_type"]).alias("relations"))
    out = found.join(made, keys).join(relations, keys)
    out = out if content else out.drop("content")
    return out.withColumn("source", T.graph_source_label(F.col("section_path"), F.col("page_nos")))
