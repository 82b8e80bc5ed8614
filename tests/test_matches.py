"""What searches of many questions shuffle: postings, questions and results, never the pairs of a question and a record."""

import random

from pyspark.sql import functions as F

from quireflow.operators import bm25, fusion, matches


def shuffled(spark, run):
    """Rows written to shuffles by what ``run`` does."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def corpus(spark, n=600, asks=300):
    rand = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"k{i:04}", " ".join(rand.choices(words, k=8)), "", "", f"m{i % 2}") for i in range(n)]
    asked = [(f"q{i:03}", t, f"m{i % 2}") for i in range(asks) for t in rand.sample(words, 4)]
    return spark.createDataFrame(docs, "k string, content string, section_text string, metadata string, doc_id string"), spark.createDataFrame(asked, "query_id string, term string, doc_id string")


def by_hand(index, queries, limit, within):
    """As sums over the join of all pairs."""
    asked = queries.join(index.terms.select("term", "idf"), "term")
    hits = index.postings.join(asked, ["term", within] if within else ["term"]).groupBy("query_id", "k").agg(F.sum(bm25._units()).alias("_s"))
    return sorted(map(tuple, bm25._ranked(hits, "k", limit).collect()))


def test_search_shuffles_no_pairs(spark, tmp_path):
    docs, asked = corpus(spark)
    bm25.write(docs, "k", bm25.TEXT_WEIGHTS, str(tmp_path / "i"), "doc_id")
    index = bm25.opened(spark, str(tmp_path / "i"))
    assert not (tmp_path / "i" / "_made").exists()
    for search in (bm25.search, bm25.pruned_search):
        for within in (None, "doc_id"):
            q = asked if within else asked.drop("doc_id")
            found = []
            rows = shuffled(spark, lambda: found.extend(map(tuple, search(index, q, 5, within).collect())))
            assert sorted(found) == by_hand(index, q, 5, within)
            assert rows < 20_000  # pairs: 180,000, or 90,000 within manuals


def test_blocks_and_shares_change_nothing(spark, tmp_path, monkeypatch):
    docs, asked = corpus(spark, 90, 40)
    bm25.write(docs, "k", bm25.TEXT_WEIGHTS, str(tmp_path / "i"), "doc_id")
    index = bm25.opened(spark, str(tmp_path / "i"))
    monkeypatch.setattr(matches, "POSTINGS", 100)
    monkeypatch.setattr(matches, "QUERIES", 7)
    for limit in (1, 5, 200):
        for search in (bm25.search, bm25.pruned_search):
            for within in (None, "doc_id"):
                q = asked if within else asked.drop("doc_id")
                assert sorted(map(tuple, search(index, q, limit, within).collect())) == by_hand(index, q, limit, within)


def test_vector_search_copies_no_vectors(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(fusion, "BLOCK", 16)
    monkeypatch.setattr(fusion, "ROWS", 64)
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.standard_normal((299, 8)), np.zeros((1, 8))])
    m[7] = m[11] = m[5]  # ties go to the smaller key
    df = spark.createDataFrame([(f"k{i:03}", f"g{i % 3}", m[i].tolist()) for i in range(300)], "id string, g string, v array<double>")
    with np.errstate(invalid="ignore"):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = np.round(u @ u.T, 12)
    for within in (None, "g"):
        want = []
        for i in range(299):
            near = sorted((-cosine[i, j], f"k{j:03}") for j in range(299) if j != i and (within is None or i % 3 == j % 3))[:4]
            want += [(f"k{i:03}", k, n) for n, (_, k) in enumerate(near, 1)]
        found = []
        rows = shuffled(spark, lambda: found.extend((r["query_id"], r["id"], r["rank"]) for r in fusion.vector_search(df, df, "id", "v", 4, within).collect()))
        assert sorted(found) == sorted(want)
        assert rows < 2_500  # results and each vector once; blocks and parts of this size would copy it 24 times


def test_index_shuffles_no_postings(spark, tmp_path):
    """Postings stay in the task that made them, and keys many rows repeat are kept once a file."""
    rand = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(f"a_long_manual:chunk:text:{rand.getrandbits(64):016x}", " ".join(rand.choices(words, k=30)), "", "") for _ in range(4_000)]
    docs = spark.createDataFrame(rows, "k string, content string, section_text string, metadata string").repartition(2, "k")
    path = tmp_path / "i"
    assert shuffled(spark, lambda: bm25.write(docs, "k", bm25.TEXT_WEIGHTS, str(path))) < 20_000  # postings: 114,000
    posted = bm25.opened(spark, str(path)).postings
    assert sum(f.stat().st_size for f in (path / "postings").glob("*.parquet")) < 10 * posted.count()  # keys alone have 39 bytes
    assert posted.columns == ["k", "length", "term", "tf", "part"]


def test_turns_change_nothing(spark, monkeypatch):
    from quireflow.plans import workspace

    folder = "/root/testdata/sf0.001"
    from quireflow.operators import graph_queries, retrieval_queries

    rows = lambda q: sorted(map(str, q(spark, folder).collect()))
    queries = (graph_queries.graph_paths, retrieval_queries.rrf_hybrid)
    once = [rows(q) for q in queries]
    monkeypatch.setattr(workspace, "MANY_ROWS", 1)
    assert [rows(q) for q in queries] == once
