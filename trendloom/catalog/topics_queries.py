"""Registered queries D1-D8 and E1-E14."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.catalog.documents_queries import HASH_SQL
from trendloom.catalog.model import Catalog
from trendloom.constants import EMBEDDING_DIM, STOP_WORDS
from trendloom.functions.counts import counted_terms
from trendloom.functions.tables import written
from trendloom.functions.vectors import as_doubles, l2_normalize
from trendloom.operators import corpus as C
from trendloom.operators import topics as E
from trendloom.operators import vectors as V

catalog = Catalog()
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
BUCKET_SQL = f"CAST(('0x' || md5(t)[1:8])::BIGINT % {EMBEDDING_DIM} AS INT)"


def rounded_vector(df, keys, column="centroid"):
    return df.select(*keys, F.posexplode(column).alias("pos", "x")).select(*keys, "pos", F.round(F.col("x") + 0.0, 5).alias("x"))


@catalog.add(
    "d1_hashed_embedding",
    f"""WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS t FROM {{documents}}),
        c AS (SELECT doc_id, {BUCKET_SQL} AS bucket, count(*) AS n FROM t GROUP BY ALL)
        SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
)
def d1(m):
    rows = m.documents.select("doc_id", F.explode(V.hashed_counts(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.bucket", F.round("e.weight", 6).alias("weight"))


UNIT_SQL = """u AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)
    / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS unit FROM {run_docs})"""
CENTROID_SQL = """e AS (SELECT run_id, topic_index, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
        FROM {run_docs} WHERE topic_index >= 0),
    a AS (SELECT run_id, topic_index, pos, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL),
    cl AS (SELECT run_id, topic_index, list(x ORDER BY pos) AS m, sqrt(sum(x * x)) AS len FROM a GROUP BY ALL),
    cen AS (SELECT run_id, topic_index, list_transform(m, lambda x: x / len) AS centroid FROM cl)"""


@catalog.add(
    "d2_l2_normalize",
    """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos FROM {embeddings})
        SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 0.0, 5) AS x FROM e""",
)
def d2(m):
    unit = m.embeddings.select("vec_id", l2_normalize(as_doubles(F.col("embedding"))).alias("centroid"))
    return rounded_vector(unit, ["vec_id"])


def demo_cache(m):
    """Vectors computed by earlier jobs: two model revisions over parts of the documents."""
    known = m.docs.where("content_hash IS NOT NULL AND doc_id % 3 < 2").groupBy("content_hash").agg(F.min("doc_id").alias("d"))
    return known.select(
        "content_hash", F.lit("hashing").alias("model_name"), F.when(F.col("d") % 3 == 0, "default").otherwise("old").alias("model_revision"),
        F.array(F.col("d").cast("float")).alias("embedding"),
    )


@catalog.add(
    "d3_embedding_cache",
    f"""WITH cache AS (SELECT content_hash, min(doc_id) AS d FROM {{docs}} WHERE content_hash IS NOT NULL AND doc_id % 3 < 2 GROUP BY 1),
        h AS (SELECT doc_id, coalesce(content_hash, {HASH_SQL}) AS content_hash, text FROM {{docs}}),
        j AS (SELECT h.*, c.d FROM h LEFT JOIN cache c ON c.content_hash = h.content_hash AND c.d % 3 = 0),
        f AS (SELECT content_hash, arg_min(text, doc_id) AS text FROM j WHERE d IS NULL GROUP BY 1),
        n AS (SELECT content_hash, len(list_distinct(list_transform({TOKENS_SQL}, lambda t: {BUCKET_SQL}))) AS n FROM f)
        SELECT doc_id, d IS NOT NULL AS from_cache, coalesce(n, CASE WHEN d = 0 THEN 0 ELSE 1 END) AS non_zero
        FROM j LEFT JOIN n ON n.content_hash = j.content_hash AND d IS NULL""",
)
def d3(m):
    vectors, _ = V.cached_embeddings(m.docs, demo_cache(m), V.hashing_embedder(), "hashing")
    return vectors.select("doc_id", "from_cache", F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("non_zero"))


@catalog.add(
    "d4_topic_centroids",
    f"""WITH {CENTROID_SQL} SELECT run_id, topic_index, CAST(generate_subscripts(centroid, 1) - 1 AS INT) AS pos,
        round(unnest(centroid) + 0.0, 5) AS x FROM cen""",
)
def d4(m):
    return rounded_vector(V.topic_centroids(m.run_docs), ["run_id", "topic_index"])


EVIDENCE_SQL = f"""{CENTROID_SQL}, {UNIT_SQL},
    sc AS (SELECT u.run_id, cen.topic_index, doc_id, round(list_sum(list_transform(list_zip(unit, centroid), lambda z: z[1] * z[2])), 6) AS score
        FROM u JOIN cen ON cen.run_id = u.run_id),
    ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, topic_index ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc
        QUALIFY rank <= 6)"""


@catalog.add("d5_top_evidence", f"WITH {EVIDENCE_SQL} SELECT * FROM ev")
def d5(m):
    return V.top_evidence(m.run_docs, V.topic_centroids(m.run_docs))


@catalog.add(
    "d6_evidence_fallback",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY published_at NULLS LAST, doc_id) AS position FROM {run_docs}),
        ev AS (SELECT run_id, topic_index, doc_id, 1 AS rank FROM t WHERE topic_index >= 0 AND topic_index % 2 = 0
            QUALIFY row_number() OVER (PARTITION BY run_id, topic_index ORDER BY doc_id) = 1),
        fb AS (SELECT run_id, topic_index, doc_id, CAST(row_number() OVER (PARTITION BY run_id, topic_index ORDER BY position) AS INT) AS rank
            FROM t WHERE topic_index >= 0 AND topic_index % 2 = 1 QUALIFY rank <= 6)
        SELECT * FROM ev UNION ALL SELECT * FROM fb""",
)
def d6(m):
    inside = m.run_docs.where("topic_index >= 0")
    found = inside.where("topic_index % 2 = 0").groupBy("run_id", "topic_index").agg(F.min("doc_id").alias("doc_id"))
    found = found.withColumn("rank", F.lit(1))
    position = F.struct(F.col("published_at").isNull(), "published_at", "doc_id")
    topics = inside.select("run_id", "topic_index").distinct()
    return V.with_fallback_evidence(found, topics, inside.withColumn("position", position))


@catalog.add(
    "d7_emergence",
    f"""WITH {CENTROID_SQL},
        pr AS (SELECT r.run_id, (SELECT max(p.run_id) FROM {{corpus_runs}} p WHERE p.status = 'completed' AND p.run_id < r.run_id) AS prev FROM {{corpus_runs}} r),
        sim AS (SELECT c.run_id, c.topic_index, max(list_sum(list_transform(list_zip(c.centroid, o.centroid), lambda z: z[1] * z[2]))) AS best
            FROM cen c JOIN pr ON pr.run_id = c.run_id JOIN cen o ON o.run_id = pr.prev GROUP BY 1, 2)
        SELECT c.run_id, c.topic_index, round(CASE WHEN best IS NOT NULL THEN greatest(0.0, least(1.0, 1 - best)) END, 6) AS emergence
        FROM cen c LEFT JOIN sim ON sim.run_id = c.run_id AND sim.topic_index = c.topic_index""",
)
def d7(m):
    rows = V.emergence(V.topic_centroids(m.run_docs), C.previous_completed(m.corpus_runs))
    return rows.select("run_id", "topic_index", F.round("emergence", 6).alias("emergence"))


@catalog.add(
    "d8_dimension_check",
    "SELECT CAST(len(embedding) AS INT) AS dim, count(*) AS n, len(embedding) = 64 AS matches FROM {embeddings} GROUP BY ALL",
)
def d8(m):
    return V.dimension_report(V.require_dimension(m.embeddings, 64), 64)


# ---------------------------------------------------------------- topics


@catalog.add(
    "e1_cluster_count",
    """SELECT run_id, n, greatest(1, least(12, CASE WHEN n // 10 = 0 THEN 1 ELSE n // 10 END)) AS k, greatest(1, least(8, n)) AS k_fixed
        FROM (SELECT run_id, count(*) AS n FROM {trends} GROUP BY 1)""",
)
def e1(m):
    sizes = m.trends.groupBy("run_id").agg(F.count("*").alias("n"))
    return sizes.select("run_id", "n", E.cluster_count(F.col("n")).alias("k"), E.cluster_count(F.col("n"), 8).alias("k_fixed"))


@catalog.add("e2_kmeans")
def e2(m):
    labels = E.kmeans_labels(m.doc_topic, 10)
    return labels.groupBy("label").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_doc"))


def steps_sql(k: int, steps: int) -> str:
    """Lloyd steps in whole numbers from the k smallest ids: nearest centre, the smaller on ties, then the rounded mean."""
    sql = f"""mx AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS m FROM {{doc_topic}}),
        pt AS (SELECT doc_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE / m * 1048576) AS BIGINT)) AS v FROM {{doc_topic}}, mx),
        c0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS c, v FROM pt QUALIFY c < {k})"""
    for i in range(steps + 1):
        sql += f""", a{i} AS (SELECT doc_id, arg_min(c, (d, c)) AS c FROM (SELECT doc_id, c.c, list_sum(list_transform(list_zip(pt.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                FROM pt CROSS JOIN c{i} c) GROUP BY doc_id),
            s{i} AS (SELECT c, i, count(*) AS n, sum(x)::BIGINT AS s FROM (SELECT a{i}.c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN pt USING (doc_id)) GROUP BY ALL),
            c{i + 1} AS (SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(CAST(floor((2 * s + n) / (2.0::DOUBLE * n)) AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c) m ON m.c = c{i}.c)"""
    return sql


@catalog.add("e2_kmeans_steps", f"WITH {steps_sql(10, 3)} SELECT doc_id, CAST(c AS INT) AS raw FROM a3")
def e2_steps(m):
    """Assignment after three steps from fixed starting points."""
    points = E.scaled_points(m.doc_topic)
    start = [r["v"] for r in points.orderBy("doc_id").limit(10).collect()]
    centres, _ = E.lloyd(points, [start], 3)
    return E.nearest(points, centres).select("doc_id", "raw")


def clustered(m):
    """Documents of one run with their delivered label."""
    joined = m.docs.join(m.doc_topic.select("doc_id", "topic_index"), "doc_id")
    return joined.select(F.lit(1).cast("bigint").alias("run_id"), "doc_id", "topic_index", "text")


def all_texts(m):
    """Every document of one run, with or without a vector, for what needs no label."""
    return m.docs.select(F.lit(1).cast("bigint").alias("run_id"), "doc_id", F.lit(None).cast("int").alias("topic_index"), "text")


DOCS_SQL = "dt AS (SELECT 1::BIGINT AS run_id, d.doc_id, t.topic_index, text FROM {docs} d JOIN {doc_topic} t ON t.doc_id = d.doc_id)"
TERMS_SQL = f"tk AS (SELECT run_id, doc_id, topic_index, list_filter({TOKENS_SQL}, lambda t: t NOT IN {STOP_SQL}) AS terms FROM dt)"


def keyword_sql(topn: int, min_df: int = 1, bigrams: bool = False, classes: str = "true") -> str:
    listed = "terms" if not bigrams else (
        "terms || CASE WHEN len(terms) > 1 THEN list_transform(list_zip(terms[:-2], terms[2:]), lambda z: z[1] || ' ' || z[2]) ELSE [] END")
    return f"""{DOCS_SQL}, {TERMS_SQL}, tw AS (SELECT run_id, doc_id, topic_index, unnest({listed}) AS term FROM tk),
        fr AS (SELECT run_id, term FROM tw GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {min_df}),
        ct AS (SELECT tw.run_id, topic_index, tw.term, count(*) AS tf FROM tw SEMI JOIN fr ON fr.term = tw.term AND fr.run_id = tw.run_id WHERE {classes} GROUP BY ALL),
        av AS (SELECT run_id, CAST(sum(tf) AS DOUBLE) / count(DISTINCT topic_index) AS a FROM ct GROUP BY 1),
        ks AS (SELECT ct.*, tf * ln(1 + a / sum(tf) OVER (PARTITION BY ct.run_id, term)) AS score FROM ct JOIN av ON av.run_id = ct.run_id),
        kw AS (SELECT run_id, topic_index, term, tf, round(score, 6) AS score,
            CAST(row_number() OVER (PARTITION BY run_id, topic_index ORDER BY round(score, 9) DESC, term) AS INT) AS rank FROM ks QUALIFY rank <= {topn})"""


def shown(ranked):
    return ranked.select("run_id", "topic_index", "term", "tf", F.round("score", 6).alias("score"), "rank")


@catalog.add("e3_keywords", f"WITH {keyword_sql(8)} SELECT * FROM kw")
def e3(m):
    return shown(E.keywords(E.class_terms(clustered(m))))


@catalog.add("e4_keywords_bigrams", f"WITH {keyword_sql(8, bigrams=True)} SELECT * FROM kw")
def e4(m):
    return shown(E.keywords(E.class_terms(clustered(m), bigrams=True)))


UNIFORM_SQL = keyword_sql(10, 2, classes="topic_index >= 0")


@catalog.add("e5_uniform_keywords", f"WITH {UNIFORM_SQL} SELECT * FROM kw")
def e5(m):
    return shown(E.uniform_keywords(clustered(m)))


@catalog.add(
    "e6_topic_table",
    f"""WITH {keyword_sql(8)} SELECT s.run_id, s.topic_index, size, coalesce(k.label, 'topic ' || CAST(s.topic_index AS STRING)) AS label, k.kws AS keywords
        FROM (SELECT run_id, topic_index, count(*) AS size FROM dt GROUP BY ALL) s LEFT JOIN (SELECT run_id, topic_index,
            string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 3) AS label, string_agg(term, ',' ORDER BY rank) AS kws FROM kw GROUP BY ALL) k
        ON k.run_id = s.run_id AND k.topic_index = s.topic_index""",
)
def e6(m):
    docs = clustered(m)
    table = E.topic_table(docs, E.keywords(E.class_terms(docs)))
    return table.select("run_id", "topic_index", "size", "label", F.array_join("keywords", ",").alias("keywords"))


@catalog.add(
    "e7_degeneracy_guard",
    """WITH s AS (SELECT run_id, count(*) AS n, count(DISTINCT topic_index) % 5 AS found FROM {trends} GROUP BY 1),
        t AS (SELECT *, least(12, greatest(2, CAST(round_even(sqrt(n / 2.0), 0) AS BIGINT))) AS target FROM s),
        u AS (SELECT *, least(target, greatest(3, target // 2)) AS useful FROM t)
        SELECT run_id, n, found, target, useful, CASE WHEN n < 4 THEN 'single' WHEN n >= target AND found < useful THEN 'recluster' ELSE 'keep' END AS action FROM u""",
)
def e7(m):
    sizes = m.trends.groupBy("run_id").agg(F.count("*").alias("n"), (F.count_distinct("topic_index") % 5).alias("found"))
    ruled = sizes.withColumn("rule", E.degeneracy(F.col("n"), F.col("found")))
    return ruled.select("run_id", "n", "found", "rule.target", "rule.useful", "rule.action")


@catalog.add(
    "e8_outliers",
    f"""WITH {CENTROID_SQL}, {UNIT_SQL},
        sm AS (SELECT u.run_id, doc_id, u.topic_index AS own, cen.topic_index, list_sum(list_transform(list_zip(unit, centroid), lambda z: z[1] * z[2])) AS sim
            FROM u JOIN cen ON cen.run_id = u.run_id WHERE u.topic_index >= 0),
        pd AS (SELECT run_id, doc_id, own AS topic_index, round(1 - max(sim) FILTER (topic_index = own), 6) AS distance,
            round(exp(max(sim) FILTER (topic_index = own)) / sum(exp(sim)), 6) AS probability FROM sm GROUP BY run_id, doc_id, own),
        lm AS (SELECT run_id, topic_index, list_sort(list(distance))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS lim FROM pd GROUP BY ALL)
        SELECT pd.run_id, doc_id, pd.topic_index, distance, probability, CASE WHEN distance > lim THEN -1 ELSE pd.topic_index END AS label
        FROM pd JOIN lm ON lm.run_id = pd.run_id AND lm.topic_index = pd.topic_index""",
)
def e8(m):
    rows = E.outliers(m.run_docs, V.topic_centroids(m.run_docs))
    return rows.select("run_id", "doc_id", "topic_index", "distance", F.round("probability", 6).alias("probability"), "label")


@catalog.add("e9_lda_keywords")
def e9(m):
    return E.lda_keywords(all_texts(m), 10)


VOCAB_SQL = """pw AS (SELECT run_id, doc_id, unnest(list_distinct(terms)) AS term FROM tk),
    vo AS (SELECT run_id, term, count(*) AS df FROM pw GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM dt)),
    dw AS (SELECT pw.run_id, doc_id, pw.term, df FROM pw JOIN vo ON vo.run_id = pw.run_id AND vo.term = pw.term)"""


@catalog.add("e10_document_terms", f"WITH {DOCS_SQL}, {TERMS_SQL}, {VOCAB_SQL} SELECT run_id, doc_id, term, df FROM dw")
def e10(m):
    return E.document_terms(clustered(m)).select("run_id", "doc_id", "term", "df")


UMASS_SQL = f"""{UNIFORM_SQL}, {VOCAB_SQL},
    pk AS (SELECT kw.run_id, kw.topic_index, kw.term, kw.rank, vo.df FROM kw JOIN vo ON vo.run_id = kw.run_id AND vo.term = kw.term),
    pp AS (SELECT a.topic_index, a.run_id, a.term AS ti, b.term AS tj, b.df FROM pk a JOIN pk b ON a.topic_index = b.topic_index AND a.run_id = b.run_id AND a.rank > b.rank),
    pc AS (SELECT pp.*, (SELECT count(*) FROM dw x JOIN dw y ON y.doc_id = x.doc_id AND y.term = pp.tj WHERE x.term = pp.ti) AS co FROM pp),
    um AS (SELECT run_id, topic_index, avg(ln((co + 1) / (df + 1e-12))) AS coherence FROM pc GROUP BY 1, 2)"""


@catalog.add("e11_umass_coherence", f"WITH {UMASS_SQL} SELECT run_id, topic_index, round(coherence, 6) AS coherence FROM um")
def e11(m):
    docs = clustered(m)
    rows = E.umass_coherence(E.uniform_keywords(docs), E.document_terms(docs))
    return rows.select("run_id", "topic_index", F.round("coherence", 6).alias("coherence"))


@catalog.add(
    "e12_topic_diversity",
    f"WITH {UNIFORM_SQL} SELECT run_id, round(CAST(count(DISTINCT term) AS DOUBLE) / count(*), 6) AS diversity FROM kw GROUP BY 1",
)
def e12(m):
    return E.topic_diversity(E.uniform_keywords(clustered(m))).select("run_id", F.round("diversity", 6).alias("diversity"))


@catalog.add("e13_model_comparison")
def e13(m):
    docs = E.tokenised(all_texts(m).drop("topic_index"))
    labels = E.kmeans_labels(m.doc_topic, 10, restarts=3)
    vectors = m.doc_topic.select("doc_id", "embedding").join(labels, "doc_id").select(
        F.lit(1).cast("bigint").alias("run_id"), "doc_id", F.col("label").alias("topic_index"), "embedding"
    )
    marked = written(E.outliers(vectors, V.topic_centroids(vectors)).select("doc_id", F.col("label").alias("marked")), "marked")
    frequency = written(counted_terms(docs, ["run_id"]), "frequency")
    # one count of the labelled documents' words serves both models
    grouped = docs.join(labels.join(marked, "doc_id", "left"), "doc_id").select("run_id", "label", "marked", "terms")
    counts = written(counted_terms(grouped, ["run_id", "label", "marked"]), "counts")
    lda = E.lda_keywords(docs, 10, frequency).withColumn("run_id", F.lit(1).cast("bigint"))
    count = marked.where("marked < 0").agg(F.count("*").alias("n_outliers")).withColumn("run_id", F.lit(1).cast("bigint"))
    return E.comparison_report(
        {
            "kmeans_ctfidf": E.counted_keywords(counts.withColumnRenamed("label", "topic_index")),
            "distance_outliers": E.counted_keywords(counts.where("marked IS NOT NULL").withColumnRenamed("marked", "topic_index")),
            "lda": lda,
        },
        E.document_terms(docs, frequency=frequency), {"distance_outliers": count},
    )


@catalog.add(
    "e14_dominant_geo",
    """WITH r AS (SELECT run_id, topic_index, region, count(*) AS n, min(doc_id) AS f FROM {run_docs} WHERE region IS NOT NULL GROUP BY ALL),
        c AS (SELECT run_id, topic_index, country, count(*) AS n, min(doc_id) AS f FROM {run_docs} WHERE country IS NOT NULL GROUP BY ALL)
        SELECT run_id, topic_index, (SELECT arg_max(region, (n, -f)) FROM r WHERE r.run_id = t.run_id AND r.topic_index = t.topic_index) AS region,
            (SELECT arg_max(country, (n, -f)) FROM c WHERE c.run_id = t.run_id AND c.topic_index = t.topic_index) AS country
        FROM (SELECT DISTINCT run_id, topic_index FROM {run_docs}) t""",
)
def e14(m):
    return E.dominant_geo(m.run_docs)
