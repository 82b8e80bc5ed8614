import json

import pytest
from pyspark.sql import functions as F

from quireflow.operators import bm25
from quireflow.operators import evaluation as E
from quireflow.operators import ingest as I
from quireflow.sources import files


def test_question_files(spark, tmp_path):
    def put(*lines):
        path = tmp_path / "q.jsonl"
        path.write_text("\n".join(lines))
        return str(path)

    good = {"question_id": "1", "question": "q", "filters": {}, "category": "c", "answerable": True, "gold_element_ids": []}
    assert E.load_questions(spark, put(json.dumps(good), "", json.dumps(good | {"question_id": "2"})), "retrieval")[1]["question_id"] == "2"
    for bad, line in (("x", 1), ("[]", 1), (json.dumps({"question_id": "1"}), 1), (json.dumps(good | {"filters": []}), 1), (json.dumps(good | {"answerable": 1}), 1)):
        with pytest.raises(ValueError, match=f":{line} "):
            E.load_questions(spark, put(bad), "retrieval")
    with pytest.raises(ValueError, match=":2 repeats"):
        E.load_questions(spark, put(json.dumps(good), json.dumps(good)), "retrieval")
    with pytest.raises(ValueError):
        E.load_questions(spark, put("", " "), "retrieval")


def test_metrics_take_several_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 6), ("b", None), ("b", 2)], "g string, first_rank int")
    got = {r["g"]: r.asDict() for r in E.recall(df, "g").collect()}
    assert got["a"]["recall_1"] == 0.5 and got["a"]["recall_10"] == 1.0 and got["b"]["mrr_10"] == 0.25
    assert E.recall(df.limit(0)).first()["recall_1"] is None
    rows = [(True, True, True), (True, False, False), (False, False, False), (False, True, False)]
    m = E.answer_metrics(spark.createDataFrame(rows, "answerable boolean, answered boolean, hit boolean")).first()
    assert (m["decision_accuracy"], m["response_rate"], m["citation_recall"], m["no_answer_accuracy"]) == (0.5, 0.5, 0.5, 0.5)
    assert E.violations(spark.createDataFrame([], "is_foreign boolean")).first()["violation_rate"] == 0.0
    r = [(True, True, 1, "x: 5 mm", ["5 MM"]), (True, True, 3, "x: 6", ["7"]), (False, False, None, "", [])]
    m = E.row_metrics(spark.createDataFrame(r, "answerable boolean, answered boolean, first_rank int, answer string, expected array<string>")).first()
    assert (m["row_recall_1"], m["row_recall_5"], m["exact_value_accuracy"], m["no_answer_accuracy"]) == (0.5, 1.0, 0.5, 1.0)


def test_paths_routes_and_records(spark):
    paths = [([{"node_types": ["A", "B"], "relations": ["r"], "page_nos": [1]}], ["A"], ["r"], [1]), ([{"node_types": ["A"], "relations": ["r"], "page_nos": []}, {"node_types": ["B"], "relations": [], "page_nos": []}], ["A", "B"], [], []), ([], [], [], [])]
    df = spark.createDataFrame(paths, "p array<struct<node_types:array<string>,relations:array<string>,page_nos:array<int>>>, t array<string>, r array<string>, g array<int>")
    assert [x[0] for x in df.select(E.path_correct(F.col("p"), F.col("t"), F.col("r"), F.col("g"))).collect()] == [True, False, None]
    routes = spark.sql("SELECT struct(true AS g, false AS t) AS route, struct(true AS g, CAST(NULL AS boolean) AS t) AS want UNION ALL SELECT struct(false, true), struct(true, true) UNION ALL SELECT NULL, struct(true, true)")
    assert [x[0] for x in routes.select(E.route_correct("route", "want", ("g", "t"))).collect()] == [True, False, None]
    hits = spark.sql("SELECT array('a', 'b', 'c') AS g, array(1, 2, NULL) AS p, array('a') AS ids, array(2) AS pages")
    assert hits.select(E.evidence_hits(F.col("g"), F.col("p"), F.col("ids"), F.col("pages"))).first()[0] == 2
    rec = [("s", "1", True, "answered", 1, 1, True, True, None, 0, 0), ("s", "2", True, "refused", 0, 1, None, True, None, 0, 1), ("s", "3", False, "refused", 0, 0, False, True, True, 2, 0)]
    df = E.records(spark.createDataFrame(rec, "system string, query_id string, answerable boolean, status string, evidence_hits int, evidence_total int, path_ok boolean, cited_well boolean, route_ok boolean, violations int, retries int"))
    failed = {r["query_id"]: r["failure"] for r in df.collect()}
    assert failed["1"] is None and failed["2"]["decision"] is False and failed["3"]["path"] is False
    m = E.summary(df, "system").first()
    assert m["evidence_recall"] == 0.5 and m["path_accuracy"] == 0.5 and m["citation_faithfulness"] == 1.0 and m["refusal_accuracy"] == 1.0 and m["failures"] == 2
    text = E.markdown_report(E.summary(df, "system"), df)
    assert "| questions | 3 |" in text and "- s 2: decision False" in text
    gold = spark.createDataFrame([("q", "e", "d", 1), ("q", "f", "d", 1), ("q", "g", "x", None), ("q", "h", "d", 9)], "query_id string, element_id string, doc_id string, page_no int")
    held = spark.createDataFrame([("e", "d", [1]), ("g", "d", [1]), ("h", "d", [1])], "element_id string, doc_id string, page_nos array<int>")
    assert {r["element_id"]: r["problem"] for r in E.verified_gold(gold, held).collect()} == {"e": None, "f": "unknown", "g": "document", "h": "page"}


def test_index_is_kept_and_pruning_loses_nothing(spark, tmp_path):
    import random

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"k{i:03d}", " ".join(rnd.choice(words[: rnd.choice((3, 12))]) for _ in range(rnd.randrange(0, 12)))) for i in range(300)]
    records = spark.createDataFrame(rows, "k string, content string")
    path = str(tmp_path / "i")
    bm25.write(records, "k", {"content": 1.0}, path)
    index = bm25.opened(spark, path)
    asked = spark.createDataFrame([(f"q{i}", t) for i in range(40) for t in rnd.sample(words, rnd.randrange(1, 5))], "query_id string, term string")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    for limit in (1, 5, 400):
        assert rows_of(bm25.search(index, asked, limit)) == rows_of(bm25.pruned_search(index, asked, limit))
    with pytest.raises(ValueError, match="2 times"):
        bm25.write(records.unionAll(records.limit(1)), "k", {"content": 1.0}, str(tmp_path / "j"))
    with pytest.raises(ValueError):
        files.open_index(spark, path, "graph")
    bm25.write(records.limit(0), "k", {"content": 1.0}, str(tmp_path / "none"))
    assert bm25.search(bm25.opened(spark, str(tmp_path / "none")), asked, 5).count() == 0


def _elements(rows):
    return [(d, f"{d}-{i:04d}", i, p, t, c, n) for i, (d, p, t, c, n) in enumerate(rows)]


_KIND = "doc_id string, element_id string, source_index int, page_no int, element_type string, content string, title_level int"


def test_section_paths_with_headings_and_any_level(spark):
    rows = [("m", 1, "text", "Doors", 1), ("m", 1, "text", "x", None), ("m", 1, "text", "Deep", 9), ("m", 2, "text", "y", None), ("m", 2, "text", "Care", 1), ("m", 2, "text", "Use", 2), ("m", 3, "text", "z", None)]
    df = spark.createDataFrame(_elements(rows), _KIND)
    path = lambda headers=None: [r["path"] for r in I.section_paths(df, headers).orderBy("element_id").collect()]
    assert path() == [["Doors"], ["Doors"], ["Doors", "Deep"], ["Doors", "Deep"], ["Care"], ["Care", "Use"], ["Care", "Use"]]
    headers = spark.createDataFrame([("m", 1, "DOORS"), ("m", 2, "Basics")], "doc_id string, page_no int, text string")
    assert path(headers) == [["Doors"], ["Doors"], ["Doors", "Deep"], ["Basics"], ["Basics", "Care"], ["Basics", "Use"], ["Basics", "Use"]]
    items = spark.createDataFrame([("m", 1, 2, "header", "B"), ("m", 1, 1, "header", " A "), ("m", 1, 0, "header", " "), ("m", None, 3, "header", "C")], "doc_id string, page_no int, source_index int, source_type string, content string")
    assert [r["text"] for r in I.first_on_page(items, I.HEADER_TYPES).collect()] == ["A"]


def test_one_manual_of_most_rows_gives_the_same_by_blocks(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    rows = [("big" if i % 10 else f"d{i % 3}", None if rnd.random() < 0.05 else i // 7, rnd.choice(["text", "text", "text", "image"]), rnd.choice(["", "a b", "1. Do it", "WARNING: hot", "note this", "x" * 400]), rnd.choice([None, None, None, 1, 2, 4])) for i in range(400)]
    df = spark.createDataFrame(_elements(rows), _KIND).withColumn("section_path", F.array(F.lit("s"))).repartition(3)
    made = lambda: [sorted(map(str, x.collect())) for x in (I.links(df), I.nearest_text(df), I.section_paths(df), I.chunk_links(I.chunks(df)))]
    whole = made()
    monkeypatch.setattr(I, "BLOCK", 5)
    assert made() == whole and all(whole)


def test_assets_context_and_tables(spark):
    df = spark.createDataFrame([("1", "img/a.png", "p/q"), ("2", "../b.png", "p"), ("3", "../../c", "p"), ("4", "/abs", "p"), ("5", " ", "p"), ("6", None, "p"), ("7", "x\\y.png", "")], "element_id string, native_path string, folder string")
    got = {r["element_id"]: (r["path"], r["code"]) for r in I.resolved_assets(df, spark.createDataFrame([("p/q/img/a.png",), ("b.png",)], "path string")).collect()}
    assert got == {"1": ("p/q/img/a.png", None), "2": ("b.png", None), "3": (None, "unsafe_asset_path"), "4": (None, "absolute_asset_path"), "5": (None, "missing_asset_path"), "6": (None, "missing_asset_path"), "7": ("x/y.png", "asset_not_found")}
    c = spark.sql("SELECT array('A') AS p, array('c1', 'c2') AS c, CAST(array() AS array<string>) AS e, CAST(NULL AS string) AS n, 3 AS page")
    said = c.select(I.visual_context(F.col("p"), F.col("c"), F.col("e"), F.col("e"), F.col("n"), F.lit("t"), F.col("page")), I.visual_context(F.col("e"), F.col("e"), F.col("e"), F.col("e"), F.col("n"), F.col("n"), F.col("page"))).first()
    assert said[0] == "Section: A\nCaption: c1 c2\nNext text: t" and said[1] == "Visual element on PDF page 3."
    t = spark.createDataFrame([("r", "A\tB\nx\t1\ny\nz\t2\t3"), ("n", None), ("b", " \n"), ("l", "one line 5")], "id string, content string")
    cells = {(r["id"], r["place"]): [(c["header"], c["value"]) for c in r["cells"]] for r in I.table_cells(t).collect()}
    assert cells == {("r", 1): [("A", "x"), ("B", "1")], ("r", 2): [("A", "y"), ("B", None)], ("r", 3): [("A", "z"), ("B", "2"), ("c3", "3")], ("l", 1): [("c1", "one line 5")]}


def test_sources(spark, tmp_path):
    for d in ("m1", "m10"):
        (tmp_path / d / "auto").mkdir(parents=True)
        (tmp_path / d / "auto" / f"{d}_content_list.json").write_text("[]")
    assert files.only_content_list(spark, str(tmp_path), "m1").endswith("/m1/auto/m1_content_list.json")
    with pytest.raises(ValueError, match="no content list"):
        files.only_content_list(spark, str(tmp_path), "m")
    (tmp_path / "m1" / "_SUCCESS.json").write_text('{"v": " 2.1 "}')
    (tmp_path / "m10" / "_SUCCESS.json").write_text("broken")
    assert {r["doc_id"]: r["version"] for r in files.parser_versions(spark, str(tmp_path), "v").collect()} == {"m1": "2.1", "m10": None}
    bad = tmp_path / "x.jsonl"
    bad.write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(ValueError, match="x.jsonl:3"):
        files.read_jsonl(spark, str(bad), "a int")
    assert files.relative_paths({"a": ["/r/b", "/x"], "c": 1}, "/r/") == {"a": ["b", "/x"], "c": 1}
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    assert files.payload_digest(df, ["k"]) == files.payload_digest(df.repartition(2), ["k"]) != files.payload_digest(df.limit(1), ["k"])


def test_evidence_leaves_no_shuffles(spark, monkeypatch):
    """Each source is written by itself and read once; what does not ask for a source or for texts does not find them."""
    from quireflow.operators import decision_queries as D
    from quireflow.operators import retrieval_queries as R

    folder, names = "/root/testdata/sf0.001", []
    held = R.held
    monkeypatch.setattr(R, "held", lambda df, name: (names.append((name, df.columns)), held(df, name))[1])
    for q, sources in ((D.evidence_merge, 4), (D.metadata_violations, 4), (D.critic_decision, 4), (D.guard_check, 1)):
        names.clear()
        made = q(spark, folder)
        evidence = [c for n, c in names if n == "evidence"]
        assert len(evidence) == sources and not any("content" in c for c in evidence)
        assert [n for n, _ in names].count("packs") <= 1
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "chunks.parquet" not in plan and "graph_edges.parquet" not in plan
    names.clear()
    D.system_comparison(spark, folder)
    assert [n for n, _ in names].count("packs") == 1 and [n for n, _ in names].count("evidence") == 4


def test_rank_audit_fuses_held_ranks(spark):
    from quireflow.operators import ingest_queries as I

    plan = I.rank_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "MapInArrow" not in plan
