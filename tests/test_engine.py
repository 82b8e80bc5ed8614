import base64

import pytest
from conftest import SF

from quireflow.operators import engine as E


@pytest.fixture(scope="module")
def engine(spark):
    return E.Engine(spark, SF)


def test_guards():
    for bad in (0, 101, True, 1.5, None):
        with pytest.raises(ValueError):
            E.checked_limit(bad, 100)
    with pytest.raises(ValueError):
        E.checked_filters({"color": "red"})
    assert E.checked_filters({"brand": " Ford ", "model": " ", "year": None}) == {"brand": "Ford"}
    good = base64.b64encode(b"x").decode()
    assert E.decode_image("data:image/jpeg;base64," + good) == ("jpeg", b"x") and E.decode_image(good) == ("png", b"x")
    for bad in ("", "***", "data:image/svg;base64," + good):
        with pytest.raises(ValueError):
            E.decode_image(bad)


def test_answers_within_one_manual(engine):
    doc = engine.chunks.where("language = 'en' AND length(content) > 200").orderBy("chunk_id").first()
    question = " ".join(doc["content"].split()[:12])
    with pytest.raises(ValueError):
        engine.hits("!?", {"color": "x"})
    hits = engine.hits(question, {"doc_id": doc["doc_id"].upper()}, 3).collect()
    assert hits and hits[0]["chunk_id"] == doc["chunk_id"] and len(hits) <= 3
    got = engine.answer(question, {"doc_id": doc["doc_id"]})
    assert got["status"] in ("answered", "refused") and got["evidence"][0]["chunk_id"] == doc["chunk_id"]
    assert engine.answer(question, {})["status"] == "needs_context"
    with pytest.raises(ValueError):
        engine.resolve({"language": "en"})
    flow = engine.agentic(question, {"doc_id": doc["doc_id"]})
    assert flow["status"] in ("answered", "refused") and [e["node"] for e in flow["trace"]][0] == "planner"
    assert engine.answer_table("What is the torque?", {"doc_id": doc["doc_id"]})["status"] in ("answered", "refused")
    assert engine.health()["chunks"] > 0


def _png(rgb):
    import struct
    import zlib

    h, w, _ = rgb.shape
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_second_question_writes_nothing(spark, engine):
    import time

    from quireflow.plans import workspace

    doc = engine.manuals[0]["doc_id"]
    engine.hits("door handle", {"doc_id": doc}).collect()
    before = workspace.written_so_far()
    began = time.perf_counter()
    engine.hits("door lamp", {"doc_id": doc}).collect()
    assert workspace.written_so_far() == before and time.perf_counter() - began < 5
    again = E.Engine(spark, SF)
    assert again.text.postings.inputFiles() == engine.text.postings.inputFiles()


def test_image_questions(spark):
    import numpy as np

    from quireflow.operators import visual

    rng = np.random.default_rng(0)
    shapes = {}
    for i in range(4):
        img = np.full((60, 80, 3), 255, np.uint8)
        img[10 + 5 * i : 30 + 5 * i, 5 * i : 40] = rng.integers(0, 200, 3)
        img[40:42, : 20 * (i + 1)] = 0
        shapes[f"e{i}"] = img
    engine = E.Engine(spark, SF)
    m = engine.manuals[0]
    rows = [(k, visual.features(v).astype(float).tolist(), *[m[c] for c in E.R.META], 1, ["A"], f"{k}.png") for k, v in shapes.items()]
    engine.images = spark.createDataFrame(rows, "element_id string, vector array<double>, " + ", ".join(f"{c} string" for c in E.R.META) + ", page_no int, section_path array<string>, asset_path string")
    sent = base64.b64encode(_png(shapes["e2"])).decode()
    got = engine.answer_image(sent, {"doc_id": m["doc_id"]}, limit=3)
    assert got["status"] == "answered" and got["evidence"][0]["element_id"] == "e2" and got["retrieval"] == "visual_only" and got["images"][0] == "e2.png"
    both = engine.answer_image(sent, {"doc_id": m["doc_id"]}, "door handle", 3)
    assert both["retrieval"] == "visual_text_rrf" and both["evidence"][0]["element_id"] == "e2"
    with pytest.raises(ValueError):
        engine.answer_image(base64.b64encode(b"no image").decode(), {"doc_id": m["doc_id"]})
    assert visual.upright(shapes["e0"], 6).shape == (80, 60, 3) and visual.orientation(b"xx") == 1


def test_generation_falls_back():
    from quireflow.operators import generation as G

    base = {"status": "answered", "answer": "[1] a", "evidence": [{"citation_id": 1, "content": "a"}]}

    def broken(q, e):
        raise OSError("down")

    assert G.generate_or_fallback(base, "q", None)["generation"]["status"] == "not_used"
    for bad in (broken, lambda q, e: "", lambda q, e: "no citation", lambda q, e: "see [2]"):
        got = G.generate_or_fallback(base, "q", bad)
        assert got["answer"] == "[1] a" and got["generation"]["status"] == "fallback"
    assert G.generate_or_fallback(base, "q", lambda q, e: " new [1] ")["answer"] == "new [1]"
    assert G.generate_or_fallback(base, "q", lambda q, e: G.REFUSAL)["status"] == "refused"
    assert G.safe_endpoint("https://a.b/c") and G.safe_endpoint("http://localhost:1/")
    for bad in ("http://a.b", "ftp://x", ""):
        with pytest.raises(ValueError):
            G.safe_endpoint(bad)
    assert '"vehicle": "A B"' in G.evidence_json([{"brand": "A", "model": "B", "year": None}])


def test_presenters():
    from quireflow.operators import presenters as P

    rows = [{"asset_path": f"v{i}", "citation_id": i, "page_no": 1} for i in range(6)]
    crops = [{"asset_path": a, "rank": i, "page_no": 2} for i, a in enumerate(["v0", "t1", "t2"], 1)]
    assert [a for a, _ in P.table_crops(rows, crops)] == [*[f"v{i}" for i in range(6)], "t1"]
    assert [a for a, _ in P.table_crops([], crops)] == ["v0", "t1", "t2"]
    assert P.pages({"page_nos": [3, 1]}) == "1–3" and P.vehicle({"brand": "A", "year": "1"}) == "A 1"
    trace = [{"sequence": 1, "node": "planner", "status": "ok", "latency_ms": 1.0, "details": {"a": "x|y"}}]
    assert "x\\|y" in P.trace_markdown(trace)
    assert P.gallery({"evidence": [{"asset_path": "a", "citation_id": 1}, {"asset_path": "a"}, {}]})[0][0] == "a"
    assert P.text_answer({"status": "refused", "reason": "r", "answer": "no"}).startswith("**refused** (r)")


def test_pipeline(spark, tmp_path):
    from quireflow.operators import pipeline

    assert pipeline.stage_range("chunks", "graph", ["indexes"]) == ["chunks", "graph"]
    for bad in (("x", "graph"), ("graph", "chunks"), ("chunks", "chunks", ["chunks"])):
        with pytest.raises(ValueError):
            pipeline.stage_range(*bad)
    got = pipeline.run(spark, SF, str(tmp_path / "out"), "import", "chunks")
    assert got["status"] == "passed" and got["stages"][1]["results"]["chunks"] > 0
    strict = pipeline.run(spark, SF, str(tmp_path / "out"), "import", "chunks", strict=True)
    assert strict["status"] == "failed" and "ImportRefused" in strict["stages"][0]["results"]["error"] and len(strict["stages"]) == 1
    pipeline.write_json(got, str(tmp_path / "report.json"))
    pipeline.write_summary(spark.range(3).toDF("n"), str(tmp_path / "s.json"))
    with pytest.raises(ValueError):
        pipeline.write_summary(spark.range(3).toDF("n"), str(tmp_path / "s.json"), most=2)
