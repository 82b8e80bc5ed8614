import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.functions import porter
from quireflow.functions import text as T
from quireflow.operators import agentic, answering, bm25, dense, fusion, ingest, visual
from quireflow.sources import files


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_terms(spark):
    assert one(spark, "How do I use the 5 Hybrid-MODE x?", T.search_terms) == ["use", "5", "hybrid", "mode"]
    assert one(spark, "How to", T.search_terms) == ["how", "to"]
    assert one(spark, "", T.match_expression) is None
    assert one(spark, "İstanbul K", T.search_terms) == ["stanbul"]
    assert one(spark, "open the rear door", T.dense_terms) == ["open", "rear", "door", "open_rear", "rear_door"]
    assert one(spark, "opening doors, boxes and Ford's plated 9", T.answer_terms) == ["open", "door", "box", "ford'", "plat"]


def test_labels(spark):
    assert one(spark, ["A", "Adjusting the seat - vehicles with X"], T.component_label, "array<string>") == "the seat"
    assert one(spark, [], T.section_label, "array<string>") == "Unsectioned evidence"
    assert one(spark, "aa bb  cc dd", lambda c: T.compact(c, 8)) == "aa bb..."
    assert [one(spark, t, T.chunk_kind) for t in ("warning : x", "STEP 2) do", "3. do", "Notes")] == ["warning", "steps", "steps", "text"]


def test_steps(spark):
    run = lambda s, force: one(spark, s, lambda c: T.steps_of(c, F.lit(force)))
    assert run("2. b\n1) a\nx\n2. c", False) == ["a", "b", "c"]
    assert run("- a\n\n• b", True) == ["a", "b"] and run("- a", False) == [] and run("", True) == []


def test_citations(spark):
    run = lambda s, n: one(spark, s, lambda c: T.citations_valid(c, F.lit(n), "no"))
    assert run("a [1] b [2]", 2) and not run("a [3]", 2) and not run("a", 2) and run("no", 0)


@pytest.mark.parametrize("weights", [bm25.TEXT_WEIGHTS, bm25.TABLE_WEIGHTS])
def test_bm25_is_that_of_sqlite(spark, weights, tmp_path):
    docs = [("a", "red door handle", "doors", "ford"), ("b", "door door lock", "locks", "ford"), ("c", "wheel nut", "wheels", "vw"), ("d", "", "", ""), ("e", "nut red red", "doors", "vw"), ("f", "oil pan", "engine", "vw")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(k UNINDEXED, content, section_text, metadata, tokenize='unicode61')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", docs)
    w = ", ".join(str(x) for x in (0.0, *weights.values()))
    want = {k: round(-s, 6) for k, s in con.execute(f"SELECT k, bm25(t, {w}) FROM t WHERE t MATCH '\"door\" OR \"red\" OR \"wheel\"'")}
    records = spark.createDataFrame(docs, "k string, content string, section_text string, metadata string")
    asked = spark.createDataFrame([("q", t) for t in ("door", "red", "wheel")], "query_id string, term string")
    bm25.write(records, "k", weights, str(tmp_path / "index"))
    got = bm25.search(bm25.opened(spark, str(tmp_path / "index")), asked, 10).collect()
    assert {r["k"]: r["score"] for r in got} == pytest.approx(want, abs=2e-6)
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r["score"], r["k"]))] == list(range(1, len(want) + 1))


def test_porter_is_that_of_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional valenci digitizer operator feudalism decisiveness hopefulness formaliti triplicate formative formalize electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate effective bowdlerize probate rate cease controll roll Éclairage señales".split()
    for i, w in enumerate(words):
        con.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i + 1, w))
    want = {d: t for t, d in con.execute("SELECT term, doc FROM v")}
    assert [porter.index_tokens(w) for w in words] == [[want[i + 1]] for i in range(len(words))]


def test_chunks_of_reference_fixture(spark):
    rows = [("Title", 1), ("One.", None), ("WARNING: hot", 2), ("1. a", None), ("2. b", None), ("NOTE: c", None), ("Two.", None)]
    data = [("d", i, f"e{i}", "text", t, 1, ["S"], lv) for i, (t, lv) in enumerate(rows)]
    e = spark.createDataFrame(data, "doc_id string, source_index int, element_id string, element_type string, content string, page_no int, section_path array<string>, title_level int")
    got = ingest.chunk_links(ingest.chunks(e)).orderBy("place").collect()
    assert [r.chunk_type for r in got] == ["text", "warning", "steps", "note", "text"]
    assert got[2].element_ids == ["e3", "e4"] and got[2].content == "1. a\n2. b"
    assert [r.previous_chunk_id for r in got] == [None, *[r.chunk_id for r in got[:-1]]]
    with pytest.raises(ValueError):
        ingest.chunks(e, 99)
    assert ingest.chunks(e.limit(0)).count() == 0


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 5)], "id bigint, v array<double>")
    got = fusion.vector_search(df, df.where("id % 20 = 0"), "id", "v", 3).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = np.round(u @ u[q], 6)
        want = [int(i) for i in sorted(range(60), key=lambda i: (-s[i], i)) if i != q][:3]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert fusion.vector_search(df, df.limit(0), "id", "v", 3).count() == 0


def test_lsa_is_that_of_full_decomposition(spark):
    texts = [(i, f"door handle {['red', 'blue'][i % 2]} number {i}") for i in range(12)] + [(99, "")]
    w = dense.tfidf(spark.createDataFrame(texts, "id bigint, t string"), "id", "t", 64)
    a = np.zeros((12, 64))
    for r in w.collect():
        a[r["id"], r["bucket"]] = r["weight"]
    assert np.allclose(np.linalg.norm(a, axis=1), 1)
    e = {r["id"]: np.array(r["vector"]) for r in dense.lsa(dense.weights(spark.createDataFrame(texts, "id bigint, t string"), "id", "t", 64), "id", 64, dimensions=12, oversample=8).collect()}
    assert np.allclose([[e[i] @ e[j] for j in range(12)] for i in range(12)], a @ a.T, atol=1e-6)


def test_visual_features(spark):
    img = np.full((60, 40, 3), 255, np.uint8)
    img[10:30, 5:25] = (200, 30, 30)
    f = visual.features(img)
    other = np.full((60, 40, 3), 255, np.uint8)
    other[10:12, 5:35] = 0
    assert f.shape == (visual.DIMENSIONS,) and np.isclose(np.linalg.norm(f), 1, atol=1e-5)
    moved = np.roll(img, 8, axis=0)
    assert f @ visual.features(moved) > 0.999 > 0.9 > f @ visual.features(other)
    df = spark.createDataFrame([("a", 60, 40, bytearray(img.tobytes())), ("b", 1, 1, bytearray(b"x")), ("c", None, None, None)], "key string, height int, width int, data binary")
    got = {r.key: r.vector for r in visual.image_features(df).collect()}
    assert len(got["a"]) == visual.DIMENSIONS and got["b"] is None and got["c"] is None


def test_row_ladder(spark):
    rows = [("a", "what is the torque", None, None, None), ("b", "wheel torque", 2.0, "Wheels", "torque: 5"), ("c", "hybrid torque", 9.0, "Wheels excluding hybrid", "torque: 5"), ("d", "wheel nut torque size", 9.0, "X", "torque: 5"), ("e", "wheel torque", 9.0, "Wheel", "torque: 5")]
    df = spark.createDataFrame(rows, "query_id string, question string, score double, section string, row_text string")
    got = {r.query_id: r.reason for r in answering.row_decisions(df).collect()}
    assert got == {"a": "no_curated_row", "b": "row_below_threshold", "c": "applicability_conflict", "d": "row_semantic_coverage_too_low", "e": "answered"}


def test_workflow():
    item = {"doc_id": "m", "content": "Turn the key.", "score": 20.0, "page_nos": [1], "identity": "c1"}
    flow = agentic.Workflow({"text": lambda q, f: [item, item], "graph": lambda q, f: [dict(item, score=2.0, identity="p")]})
    got = flow.run("How do I start?", {"doc_id": "m"})
    assert got["status"] == "answered" and got["answer"].startswith("[1]") and len(got["evidence"]) == 2

    def broken(q, f):
        raise OSError("gone")

    flow = agentic.Workflow({"text": lambda q, f: [item], "graph": broken})
    assert flow.run("How do I start?", {"doc_id": "m"})["status"] == "refused"
    assert [e["node"] for e in flow.trace].count("planner") == 2
    assert agentic.Workflow({"text": lambda q, f: [item]}).run("key", {"doc_id": "other"})["status"] == "refused"
    assert agentic.Workflow({}).run("key", {})["status"] == "needs_context"


def test_manifest(spark, tmp_path):
    head = ",".join(files.MANIFEST.names)
    row = "d1,B,M,2020,R,en,owner_manual,https://x/y.pdf,2025-01-01T00:00:00Z,y.pdf"

    def read(*rows, name="m.csv"):
        (tmp_path / name).write_text("﻿" + "\n".join((head, *rows)))
        return files.read_manifest(spark, str(tmp_path / name))

    assert read(row).first().doc_id == "d1"
    for i, bad in enumerate([(), (row, row), (row.replace("d1", "-d"),), (row.replace("https", "ftp"),), (row.replace("2025-01", "soon"),)]):
        with pytest.raises(ValueError):
            read(*bad, name=f"b{i}.csv")


def test_json_files(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "d1_content_list.json").write_text(json.dumps([{"type": "text", "text": "x", "page_idx": 0}, 5, {"type": "table", "content": {"text": ["a", {"caption": "b"}]}}]))
    items = files.native_items(files.read_content_lists(spark, str(tmp_path)))
    assert [(r.source_index, r.type) for r in items.orderBy("source_index").collect()] == [(0, "text"), (1, None), (2, "table")]
    assert files.only_content_list(spark, str(tmp_path), "d1").endswith("d1_content_list.json")
    with pytest.raises(ValueError):
        files.only_content_list(spark, str(tmp_path), "d2")
    flat = spark.createDataFrame([('{"text": ["a", {"caption": "b"}], "z": "no"}',), ("plain",), (None,)], "v string").select(files.flatten_text("v")).collect()
    assert [r[0] for r in flat] == [["a", "b"], ["plain"], []]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "r.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a"\n')
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int")
    df = spark.createDataFrame([(1, None)], "b int, a string")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":null,"b":1}'


def test_curated_rows(spark, tmp_path):
    import hashlib

    (tmp_path / "assets").mkdir()
    (tmp_path / "assets" / "a.png").write_bytes(b"x")
    row = {"row_id": "r", "element_id": "e", "page_no": 1, "section_path": ["S"], "cells": {"Size": "5", "Alpha": "x"}, "aliases": [], "asset_path": "assets/a.png", "asset_sha256": hashlib.sha256(b"x").hexdigest()}
    path = tmp_path / "rows.jsonl"
    path.write_text(json.dumps(row))
    got = files.read_curated_rows(spark, str(path), str(tmp_path)).first()
    assert [(c.header, c.value) for c in got.cells] == [("Size", "5"), ("Alpha", "x")]
    for i, change in enumerate(({"asset_sha256": "0" * 64}, {"cells": {"a": "b"}}, {"asset_path": "../a.png"})):
        (tmp_path / f"b{i}.jsonl").write_text(json.dumps(row | change))
        with pytest.raises(ValueError):
            files.read_curated_rows(spark, str(tmp_path / f"b{i}.jsonl"), str(tmp_path))


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_index({"t": df}, str(tmp_path / "ix"), "bm25")
    assert files.open_index(spark, str(tmp_path / "ix"), "bm25", verify=True)["t"].count() == 2
    with pytest.raises(ValueError):
        files.open_index(spark, str(tmp_path / "ix"), "dense")
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "ix" / "t"))
    with pytest.raises(ValueError):
        files.open_index(spark, str(tmp_path / "ix"), "bm25", verify=True)
