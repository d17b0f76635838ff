"""Embeddings, centroids, evidence retrieval and novelty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.constants import EMBEDDING_DIM, EVIDENCE_K
from trendloom.functions.joins import salted_join
from trendloom.functions.text import content_fingerprint, let, words
from trendloom.functions.vectors import as_doubles, cosine, dot, l2_normalize, mean_vector

SCORE_DIGITS = 6  # scores equal to this many digits are ties, broken by document id


def token_bucket(token: Column, dim: int = EMBEDDING_DIM) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hashed_counts(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Sparse bag of words as array<struct<bucket, weight>> with unit length.

    Buckets are sorted inside the row, so run lengths give the counts: no explode and no shuffle.
    """
    def run_lengths(buckets: Column) -> Column:
        starts = F.transform(F.array_distinct(buckets), lambda b: F.struct(b.alias("b"), F.array_position(buckets, b).alias("p")))
        end = (F.size(buckets) + 1).cast("bigint")
        return let(starts, lambda s: F.transform(s, lambda x, i: F.struct(
            x["b"].alias("bucket"), (F.coalesce(F.get(s, i + 1)["p"], end) - x["p"]).cast("double").alias("n")
        )))

    def unit(counted: Column) -> Column:
        length = F.sqrt(F.aggregate(counted, F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))
        return let(length, lambda n: F.transform(counted, lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] / n).alias("weight"))))

    return let(let(F.array_sort(F.transform(words(text), lambda t: token_bucket(t, dim))), run_lengths), unit)


def densify(sparse: Column, dim: int = EMBEDDING_DIM) -> Column:
    return let(F.map_from_entries(sparse), lambda weights: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(weights, i), F.lit(0.0)).cast("float")
    ))


def hashing_embedder(dim: int = EMBEDDING_DIM) -> Callable[[Column], Column]:
    """Offline embedder: text column to array<float>."""
    return lambda text: densify(hashed_counts(text, dim), dim)


def cached_embeddings(
    docs: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], model: str, revision: str = "default"
) -> tuple[DataFrame, DataFrame]:
    """Vectors of all documents plus the rows to append to the cache.

    The cache is keyed by content hash, model and revision; only contents without an entry are
    embedded, each once. Missing hashes are filled in first.
    """
    hashed = docs.withColumn(
        "content_hash", F.coalesce("content_hash", content_fingerprint(F.col("title"), F.col("text")))
    )
    usable = cache.where((F.col("model_name") == model) & (F.col("model_revision") == revision))
    usable = usable.select("content_hash", "embedding")
    absent = hashed.join(usable.select("content_hash"), "content_hash", "left_anti")
    first = Window.partitionBy("content_hash").orderBy("doc_id")
    absent = absent.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1)
    created = absent.select("content_hash", embed(F.col("text")).alias("embedding"))
    known = usable.withColumn("from_cache", F.lit(True)).unionByName(created.withColumn("from_cache", F.lit(False)))
    vectors = hashed.select("doc_id", "content_hash").join(known, "content_hash")
    additions = created.select("content_hash", F.lit(model).alias("model_name"), F.lit(revision).alias("model_revision"), "embedding")
    return vectors, additions


def topic_centroids(members: DataFrame) -> DataFrame:
    """Unit-length mean vector per (run, topic); outliers excluded. Means combine map-side."""
    inside = members.where(F.col("topic_index") >= 0)
    mean = mean_vector(as_doubles(F.col("embedding")))
    return inside.groupBy("run_id", "topic_index").agg(mean.alias("m")).select(
        "run_id", "topic_index", l2_normalize(F.col("m")).alias("centroid")
    )


def top_evidence(
    members: DataFrame, centroids: DataFrame, k: int = EVIDENCE_K, scope: str = "run", digits: int = SCORE_DIGITS
) -> DataFrame:
    """The k documents of a run closest to each topic centroid (`scope='topic'` keeps to the own topic)."""
    docs = members.select(
        "run_id", "doc_id", F.col("topic_index").alias("own_topic"), l2_normalize(as_doubles(F.col("embedding"))).alias("unit")
    )
    scored = salted_join(docs, centroids, ["run_id"], "doc_id")
    if scope == "topic":
        scored = scored.where(F.col("own_topic") == F.col("topic_index"))
    scored = scored.select(
        "run_id", "topic_index", "doc_id", F.round(dot(F.col("unit"), F.col("centroid")), digits).alias("score")
    )
    best = Window.partitionBy("run_id", "topic_index").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_fallback_evidence(evidence: DataFrame, topics: DataFrame, members: DataFrame, k: int = EVIDENCE_K) -> DataFrame:
    """Topics without retrieved evidence take their first k documents in corpus order."""
    empty = topics.select("run_id", "topic_index").join(evidence, ["run_id", "topic_index"], "left_anti")
    own = members.join(empty, ["run_id", "topic_index"], "left_semi")
    first = Window.partitionBy("run_id", "topic_index").orderBy("position")
    fallback = own.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return evidence.select("run_id", "topic_index", "doc_id", "rank").unionByName(
        fallback.select("run_id", "topic_index", "doc_id", "rank")
    )


def emergence(centroids: DataFrame, previous_runs: DataFrame) -> DataFrame:
    """Novelty against the topics of the previous completed run; null without a baseline."""
    earlier = centroids.select(F.col("run_id").alias("previous_run_id"), F.col("centroid").alias("old"))
    current = centroids.join(previous_runs.where("previous_run_id IS NOT NULL"), "run_id")
    nearest = current.join(earlier, "previous_run_id").groupBy("run_id", "topic_index").agg(
        F.max(cosine(F.col("centroid"), F.col("old"))).alias("nearest")
    )
    novelty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("nearest")))
    return centroids.select("run_id", "topic_index").join(nearest, ["run_id", "topic_index"], "left").select(
        "run_id", "topic_index", F.when(F.col("nearest").isNotNull(), novelty).alias("emergence")
    )


def dimension_report(vectors: DataFrame, expected: int) -> DataFrame:
    size = F.size("embedding")
    return vectors.groupBy(size.alias("dim")).agg(F.count("*").alias("n")).withColumn("matches", F.col("dim") == expected)


def require_dimension(vectors: DataFrame, expected: int) -> DataFrame:
    """Fail the job on the first vector of another size."""
    size = F.size("embedding")
    message = F.concat(F.lit(f"expected {expected} dimensions, found "), size.cast("string"))
    return vectors.withColumn("embedding", F.when(size == expected, F.col("embedding")).otherwise(F.raise_error(message)))
