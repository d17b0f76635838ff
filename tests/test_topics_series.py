import math
from datetime import date
from types import SimpleNamespace

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from trendloom.catalog import topics_queries
from trendloom.operators import series as S
from trendloom.operators import topics as E
from trendloom.operators import vectors as V

KEYS = ["topic"]
PTS = "topic long, period string, doc_count long"


def points(table, series):
    return table([(t, p, n) for t, ps in series.items() for p, n in ps.items()], PTS)


def quarters(n, value=1, year=2020):
    return {f"{year + i // 4}-Q{i % 4 + 1}": (value[i] if isinstance(value, list) else value) for i in range(n)}


def test_dense_quarters(table):
    df = points(table, {1: {"2024-Q1": 2, "2024-Q3": 1}, 2: {"1977-Q1": 1, "2024-Q4": 2, "2025-Q2": 3}})
    got = rows_of(S.dense_quarters(df, KEYS, 4), "topic", "period", "doc_count")
    assert got[:3] == [(1, "2024-Q1", 2), (1, "2024-Q2", 0), (1, "2024-Q3", 1)]
    assert got[3:] == [(2, "2024-Q3", 0), (2, "2024-Q4", 2), (2, "2025-Q1", 0), (2, "2025-Q2", 3)]
    with pytest.raises(ValueError):
        S.dense_quarters(df, KEYS, 0)


def test_prevalence(table):
    dense = table([(1, "2024-Q1", 2), (1, "2024-Q2", 0), (1, "2024-Q3", 1)], "run_id long, period string, doc_count long")
    corpus = table([(1, "2024-Q1", 4), (1, "2024-Q3", 2)], "run_id long, period string, doc_count long")
    assert rows_of(S.with_prevalence(dense, corpus), "period", "prevalence") == [("2024-Q1", 0.5), ("2024-Q2", 0.0), ("2024-Q3", 0.5)]


def test_maturity(table):
    df = points(table, {1: quarters(1, 2), 2: quarters(4, [1, 2, 8, 10]), 3: quarters(16, 5), 4: quarters(4, 5)})
    novelty = table([(4, 0.8)], "topic long, emergence double")
    got = dict(rows_of(S.topic_maturity(df, keys=KEYS), "topic", "maturity"))
    assert got == {1: "weak_signal", 2: "emerging", 3: "megatrend", 4: "established"}
    assert dict(rows_of(S.topic_maturity(df, novelty, KEYS), "topic", "maturity"))[4] == "emerging"


def test_stable_maturity(table):
    rows = [("weak_signal", "megatrend", 3), ("weak_signal", "megatrend", 8), (None, "megatrend", 1), ("megatrend", "weak_signal", 2)]
    df = table(rows, "p string, n string, e int")
    got = [r[0] for r in df.select(S.stabilize_maturity(F.col("p"), F.col("n"), F.col("e"))).collect()]
    assert got == ["emerging", "megatrend", "megatrend", "established"]


def test_hashed_embedding(table):
    df = table([(1, "facade Facade x glass"), (2, "")], "id int, text string")
    rows = {r["id"]: r["e"] for r in df.select("id", V.hashed_counts(F.col("text")).alias("e")).collect()}
    weights = sorted(x["weight"] for x in rows[1])
    assert weights == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)]) and rows[2] == []
    assert 85 in [x["bucket"] for x in rows[1]]
    dense = df.select(V.hashing_embedder(16)(F.col("text")).alias("v")).collect()
    assert [len(r["v"]) for r in dense] == [16, 16]


def test_embedding_cache(table):
    docs = table([(1, "t", "a", "h1"), (2, "t", "b", "h2"), (3, "t", "b", "h2")], "doc_id long, title string, text string, content_hash string")
    cache = table([("h1", "m", "r", [9.0]), ("h2", "m", "old", [8.0])], "content_hash string, model_name string, model_revision string, embedding array<float>")
    vectors, additions = V.cached_embeddings(docs, cache, lambda t: F.array(F.length(t).cast("float")), "m", "r")
    assert rows_of(vectors, "doc_id", "from_cache") == [(1, True), (2, False), (3, False)]
    assert rows_of(additions, "content_hash", "model_revision") == [("h2", "r")]


def test_centroids_and_evidence(table):
    members = table([(1, 1, 0, [2.0, 0.0]), (1, 2, 0, [0.0, 2.0]), (1, 3, 1, [0.0, 1.0]), (1, 4, -1, [1.0, 0.0])], "run_id long, doc_id long, topic_index int, embedding array<float>")
    cen = V.topic_centroids(members)
    got = {r["topic_index"]: r["centroid"] for r in cen.collect()}
    assert got[0] == pytest.approx([math.sqrt(0.5)] * 2) and set(got) == {0, 1}
    top = rows_of(V.top_evidence(members, cen, k=2), "topic_index", "rank", "doc_id")
    assert top == [(0, 1, 1), (0, 2, 2), (1, 1, 2), (1, 2, 3)]
    own = rows_of(V.top_evidence(members, cen, k=2, scope="topic"), "topic_index", "rank", "doc_id")
    assert own == [(0, 1, 1), (0, 2, 2), (1, 1, 3)]


def test_emergence(table):
    cen = table([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0])], "run_id long, topic_index int, centroid array<double>")
    prev = table([(1, None), (2, 1)], "run_id long, previous_run_id long")
    assert rows_of(V.emergence(cen, prev).na.fill(-1.0), "run_id", "topic_index", "emergence") == [(1, 0, -1.0), (2, 0, 0.0), (2, 1, 1.0)]


def test_dimension_guard(table):
    df = table([([1.0, 2.0],), ([1.0],)], "embedding array<float>")
    with pytest.raises(Exception, match="expected 2 dimensions"):
        V.require_dimension(df, 2).collect()


def test_cluster_count(table):
    df = table([(5,), (35,), (500,)], "n long")
    assert [r[0] for r in df.select(E.cluster_count(F.col("n"))).collect()] == [1, 3, 12]
    assert [r[0] for r in df.select(E.cluster_count(F.col("n"), 8)).collect()] == [5, 8, 8]


def test_kmeans_labels(table):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.normal(0, 0.05, 2) + (np.array([5, 0]) if i % 3 == 0 else np.array([0, 5]))]) for i in range(60)]
    labels = dict(rows_of(E.kmeans_labels(table(rows, "doc_id long, embedding array<double>"), 2, restarts=3), "doc_id", "label"))
    assert all(labels[i] == (1 if i % 3 == 0 else 0) for i in range(60))


def test_kmeans_is_the_same_for_any_partitioning(spark, table):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.normal(0, 1, 4)]) for i in range(300)] + [(900 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)] + [(999, None)]
    df = table(rows, "doc_id long, embedding array<double>")
    found = []
    for n in (3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        found.append(rows_of(E.kmeans_labels(df.repartition(n, "doc_id"), 7, restarts=2, iterations=8), "doc_id", "label"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) == 330 and len({x[1] for x in found[0]}) == 7


def test_lloyd_steps_match_plain_python(table):
    rnd = np.random.default_rng(2)
    df = table([(i, [float(x) for x in rnd.normal(0, 1, 3)]) for i in range(80)], "doc_id long, embedding array<double>")
    points = E.scaled_points(df)
    v = {r["doc_id"]: np.array(r["v"], dtype=object) for r in points.collect()}
    centres = [v[i].tolist() for i in range(4)]
    got, _ = E.lloyd(points, [[list(c) for c in centres]], 3)
    for _ in range(3):
        near = {i: min(range(4), key=lambda c: (((x - np.array(centres[c], dtype=object)) ** 2).sum(), c)) for i, x in v.items()}
        groups = [[v[i] for i in v if near[i] == c] for c in range(4)]
        centres = [[(2 * int(s) + len(g)) // (2 * len(g)) for s in sum(g)] if g else c for g, c in zip(groups, centres)]
    assert got == centres


def test_keywords_and_labels(table):
    docs = table([(1, 1, 0, "facade facade glass the"), (1, 2, 0, "glass facade"), (1, 3, 1, "robot robot arm")], "run_id long, doc_id long, topic_index int, text string")
    ranked = E.keywords(E.class_terms(docs))
    assert rows_of(ranked.where("rank = 1"), "topic_index", "term") == [(0, "facade"), (1, "robot")]
    counts = {0: {"facade": 3, "glass": 2}, 1: {"robot": 2, "arm": 1}}
    avg = sum(sum(c.values()) for c in counts.values()) / 2
    score = {r["term"]: r["score"] for r in ranked.collect()}
    assert score["facade"] == pytest.approx(3 * math.log(1 + avg / 3))
    assert rows_of(E.topic_table(docs, ranked), "topic_index", "label", "size") == [(0, "facade, glass", 2), (1, "robot, arm", 1)]
    assert "facade glass" in [r[1] for r in rows_of(E.class_terms(docs, bigrams=True), "topic_index", "term")]


def test_coherence_against_plain_python(table):
    texts = ["aa bb cc", "aa bb", "aa cc", "bb cc dd", "aa bb cc dd", "zz"]
    docs = table([(1, i, t) for i, t in enumerate(texts)], "run_id long, doc_id long, text string")
    ranked = table([(1, 0, w, i + 1) for i, w in enumerate(["aa", "bb", "cc"])], "run_id long, topic_index int, term string, rank int")
    pairs = E.document_terms(docs, min_df=1, max_df=1.0)
    sets = [set(t.split()) for t in texts]
    df = {w: sum(w in s for s in sets) for w in ("aa", "bb", "cc")}
    words, total = ["aa", "bb", "cc"], []
    for i in range(1, 3):
        for j in range(i):
            co = sum(words[i] in s and words[j] in s for s in sets)
            total.append(math.log((co + 1) / (df[words[j]] + 1e-12)))
    assert E.umass_coherence(ranked, pairs).first()["coherence"] == pytest.approx(sum(total) / len(total))
    assert E.topic_diversity(ranked).first()["diversity"] == 1.0


def test_series_over_dates(table):
    members = table([(1, 0, date(2024, 2, 1)), (1, 0, date(2024, 8, 1)), (1, -1, date(2024, 8, 2)), (1, 0, None)], "run_id long, topic_index int, published_at date")
    got = rows_of(S.run_series(members), "period", "doc_count", "prevalence")
    assert got == [("2024-Q1", 1, 1.0), ("2024-Q2", 0, 0.0), ("2024-Q3", 1, 0.5)]


def test_lda_reads_documents_without_vectors(table):
    """The terms of the documents without a vector reach the LDA topics of both queries, and their coherence vocabulary."""
    texts = [(i, "meadow river forest" if i < 8 else "copper alloy furnace") for i in range(16)]
    vectors = [(i, 0, [float(i % 3), 1.0]) for i in range(8)]
    m = SimpleNamespace(docs=table(texts, "doc_id long, text string"), doc_topic=table(vectors, "doc_id long, topic_index int, embedding array<float>"))
    assert {"copper", "meadow"} <= {r["term"] for r in topics_queries.e9(m).collect()}
    read = []
    lda, report = E.lda_keywords, E.comparison_report
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(E, "kmeans_labels", lambda *a, **b: m.doc_topic.select("doc_id", F.col("topic_index").alias("label")))
        patch.setattr(E, "lda_keywords", lambda docs, *a: read.append(docs.count()) or lda(docs, *a))
        patch.setattr(E, "comparison_report", lambda ranked, pairs, count: read.append({r["term"] for r in pairs.collect()}) or report(ranked, pairs, count))
        topics_queries.e13(m)
    assert read == [16, {"meadow", "river", "forest", "copper", "alloy", "furnace"}]


def test_terms_are_counted_in_bounded_pieces_and_ranked_over_all_tasks(spark, table):
    """One run's terms stay spread: neither its text nor its ranking lies in one task."""
    from trendloom.functions.joins import in_pieces

    docs = table([(1, i % 3, f"word{i % 50} word{i % 7} common") for i in range(600)], "run_id long, topic_index int, text string")
    assert in_pieces(docs, "text", 500).rdd.getNumPartitions() >= 20
    ranked = E.keywords(E.class_terms(docs, bigrams=True))
    assert "BroadcastHashJoin [run_id" in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.count() == 24


def test_lda_steps_equal_a_loop_over_documents():
    """Blocks of documents settle as single documents do, and digamma and the random starts are right."""
    from trendloom.operators import lda as L

    assert L.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-10)
    assert L.trigamma(np.array([1.0, 0.5])) == pytest.approx([math.pi**2 / 6, math.pi**2 / 2], abs=1e-9)
    draws = L.gamma_draws(np.arange(20000) - 10000, 3)
    assert draws.mean() == pytest.approx(1, abs=0.005) and draws.std() == pytest.approx(0.1, abs=0.005)
    rng = np.random.default_rng(1)
    beta, alpha, gamma = rng.random((9, 3)) + 0.01, np.array([0.2, 0.3, 0.5]), L.gamma_draws(np.arange(40), 3)
    docs = [sorted(rng.choice(9, rng.integers(1, 6), replace=False)) for _ in range(40)]
    word, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    count = rng.integers(1, 5, len(word)).astype(float)
    wanted, sums = [], np.zeros_like(beta)
    for i, d in enumerate(docs):
        b, c, g, change = beta[d], count[first[i]:first[i + 1]], gamma[i], 1.0
        while change > 1e-3:
            theta = np.exp(L.expectation(g))
            after = theta * (b.T @ (c / (b @ theta))) + alpha
            g, change = after, np.abs(after - g).mean()
        theta = np.exp(L.expectation(g))
        sums[d] += np.outer(c / (b @ theta), theta) * b
        wanted.append(g)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L, "CHUNK", 16)
        got, learnt = L.infer(beta, first, word, count, gamma, alpha)
    assert np.allclose(got, np.array(wanted)) and np.allclose(learnt, sums)


def test_lda_keeps_its_vocabulary_off_the_driver(spark, table):
    """Topics part two kinds of texts, and no step returns more to the driver than two numbers per topic, however many words there are."""
    rows = [(i, [f"{'ab'[i % 2]}{(i * 7 + j) % 400}" for j in range(30)]) for i in range(600)]
    got = []
    with pytest.MonkeyPatch.context() as patch:
        for name in ("collect", "first", "toPandas"):
            kept = getattr(spark.range(0).__class__, name)
            patch.setattr(spark.range(0).__class__, name, lambda df, kept=kept: got.append(out := kept(df)) or out)
        top = E.topic_words(table(rows, "doc_id long, terms array<string>"), 2, 42, 12, 1, 0.5, 10)
    assert sum(len(x) for x in got if x) < 1000 and len({(r["topic_index"], r["rank"]) for r in top.collect()}) == 20


def test_comparison_tokenises_once_and_reads_documents_once_for_all_models(spark, table):
    """All models of the report share the tokens, and one pass over the documents counts the co-occurrences of their words."""
    texts = [(i, "meadow river forest" if i < 8 else "copper alloy furnace") for i in range(16)]
    vectors = [(i, i % 2, [float(i % 3), 1.0]) for i in range(8)]
    m = SimpleNamespace(docs=table(texts, "doc_id long, text string"), doc_topic=table(vectors, "doc_id long, topic_index int, embedding array<float>"))
    calls, terms = [], E.terms
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(E, "kmeans_labels", lambda *a, **b: m.doc_topic.select("doc_id", F.col("topic_index").alias("label")))
        patch.setattr(E, "lda_keywords", lambda docs, *a: calls.append("terms" in docs.columns) or table([(0, "river", 0.5, 1), (0, "forest", 0.4, 2)], "topic_index int, term string, score double, rank int"))
        patch.setattr(E, "terms", lambda *a: calls.append(1) or terms(*a))
        report = {r["model"]: r for r in topics_queries.e13(m).collect()}
    assert calls == [1, True] and set(report) == {"kmeans_ctfidf", "distance_outliers", "lda"}
    assert report["kmeans_ctfidf"]["n_topics"] == 2 and report["kmeans_ctfidf"]["diversity"] == 0.5
    assert report["kmeans_ctfidf"]["coherence_umass"] == pytest.approx(math.log(9 / 8))
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x, "long")
    docs = table([(1, i, 0, t) for i, t in texts], "run_id long, doc_id long, topic_index int, text string")
    pairs = E.document_terms(docs).withColumn("doc_id", seen("doc_id"))
    ranked = E.uniform_keywords(docs)
    got = E.comparison_report({"a": ranked, "b": ranked}, pairs, {}).collect()
    apart = E.umass_coherence(ranked, E.document_terms(docs)).agg(F.avg("coherence")).first()[0]
    assert [(r["model"], r["n_outliers"]) for r in sorted(got)] == [("a", 0), ("b", 0)]
    assert {r["coherence_umass"] for r in got} == {apart} and read.value == 48


def test_term_counts_in_pieces(spark, table, monkeypatch):
    """Pieces of any size, null groups and empty documents give the counts of a loop."""
    from trendloom.functions import counts as K

    rows = [(i % 3 or None, i % 2, " ".join(f"w{(i * j) % 7}" for j in range(i % 5))) for i in range(40)]
    want = {}
    for a, b, t in rows:
        for w in t.split():
            tf, docs = want.get((a, b, w), (0, set()))
            want[(a, b, w)] = (tf + 1, docs)
        for w in set(t.split()):
            want[(a, b, w)] = (want[(a, b, w)][0], want[(a, b, w)][1] | {len(want[(a, b, w)][1])})
    tokens = table(rows, "a int, b int, terms string").repartition(2)
    for size in (8 << 20, 0):
        monkeypatch.setattr(K, "PIECE_BYTES", size)
        got = {(r["a"], r["b"], r["term"]): (r["tf"], r["df"]) for r in K.counted_terms(tokens, ["a", "b"]).collect()}
        assert got == {k: (tf, len(docs)) for k, (tf, docs) in want.items()}
