from datetime import datetime

from quireflow.operators.references import MANUAL_KEYS, MANUAL_REFERENCES, orphan_counts, orphan_references

DAY = lambda m, d: datetime(2025, m, d)


def tables(spark, elements=(), chunks=(), nodes=(), edges=()):
    return {
        "elements": spark.createDataFrame(list(elements), "element_id string, ingested_at timestamp"),
        "chunks": spark.createDataFrame(list(chunks), "chunk_id string, element_ids array<string>, key string, ingested_at timestamp"),
        "graph_nodes": spark.createDataFrame(list(nodes), "node_id string, evidence_ids array<string>, ingested_at timestamp"),
        "graph_edges": spark.createDataFrame(list(edges), "edge_id string, source_id string, target_id string, ingested_at timestamp"),
    }


def found(spark, tombs=(), **given):
    dead = spark.createDataFrame(list(tombs), "record_table string, record_id string, deleted_at timestamp")
    out = orphan_references(tables(spark, **given), MANUAL_KEYS, MANUAL_REFERENCES, dead)
    return sorted((r.ref_table, r.ref_field, r.record_id, r.ref_id, r.period) for r in out.collect())


def test_missing_late_deleted(spark):
    got = found(
        spark,
        tombs=[("elements", "e2", DAY(1, 31)), ("elements", "e2", DAY(5, 1)), ("elements", "e3", DAY(2, 1)), ("chunks", "e1", DAY(1, 1)), ("elements", "nobody", DAY(1, 1))],
        elements=[("e1", DAY(1, 31)), ("e2", DAY(1, 1)), ("e3", DAY(1, 1)), ("late", DAY(2, 1)), ("late", DAY(3, 1))],
        chunks=[("c1", ["e1", "e2", "e3", "late", "gone", "", None, "gone", "E1"], "clash", DAY(1, 10)), ("c1", ["e1", "e2", "e3", "late", "gone", "", None, "gone", "E1"], "clash", DAY(4, 10)), ("c2", None, None, DAY(1, 1))],
    )
    assert got == [("chunks", "element_ids", "c1", k, "2025-01") for k in ("E1", "e2", "gone", "late")]


def test_evidence_in_either_table_and_both_ends(spark):
    got = found(
        spark,
        elements=[("x", DAY(2, 1))], chunks=[("x", [], None, DAY(1, 1))],
        nodes=[("n", ["x"], DAY(1, 5)), ("m", ["y"], DAY(1, 5))],
        edges=[("e", "n", None, DAY(1, 6)), ("f", "", "zz", DAY(1, 6)), ("g", "n", "n", DAY(1, 6)), (None, "q", "q", DAY(1, 6)), ("h", "q", "q", None)],
    )
    assert got == [("graph_edges", "target_id", "f", "zz", "2025-01"), ("graph_nodes", "evidence_ids", "m", "y", "2025-01")]


def test_empty_and_hot(spark):
    assert found(spark) == []
    hot = [(f"e{i}", "hub", "hub", DAY(1, 2)) for i in range(300)]
    assert len(found(spark, edges=hot)) == 600
    assert found(spark, edges=hot, nodes=[("hub", [], DAY(1, 30))]) == []


def test_counts(spark):
    df = spark.createDataFrame([("a", "f", "1", "x", "2025-01"), ("a", "f", "2", "x", "2025-01")], "ref_table string, ref_field string, record_id string, ref_id string, period string")
    assert [tuple(r) for r in orphan_counts(df).collect()] == [("a", "f", "2025-01", 2)]


def test_totals_are_the_counts_of_the_cases_also_of_hot_ones(spark, monkeypatch):
    from quireflow.operators import references as R

    monkeypatch.setattr(R, "HOT_REFERENCES", 3)
    edges = [(f"x{i}", "gone", "n1" if i % 2 else "also gone", DAY(1 + i % 3, 5)) for i in range(30)]
    t = tables(spark, nodes=[("n1", [], DAY(1, 1))], edges=edges)
    dead = spark.createDataFrame([], "record_table string, record_id string, deleted_at timestamp")
    cases = orphan_references(t, MANUAL_KEYS, MANUAL_REFERENCES, dead)
    want = sorted(map(tuple, orphan_counts(cases).collect()))
    assert want == sorted(map(tuple, R.orphan_totals(t, MANUAL_KEYS, MANUAL_REFERENCES, dead).collect())) and sum(r[3] for r in want) == 45
