"""One analysis run over the cumulative corpus, from raw documents to portfolio occurrences.

Every output table is stored once, as a run that ends in table writes would do, so later steps and
later runs read results instead of repeating the plan behind them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.tables import written
from trendloom.functions.text import fold_case, signal_tokens
from trendloom.operators import assess as G
from trendloom.operators import corpus as C
from trendloom.operators import dedup as D
from trendloom.operators import match as M
from trendloom.operators import series as S
from trendloom.operators import topics as E
from trendloom.operators import vectors as V
from trendloom.plans.stages import RunOptions, pick, pick_embedder, translated
from trendloom.session import ensure_checkpoint_dir
from trendloom.sources.dumps import commit, committed_versions, new_version

TOPIC = ["run_id", "topic_index"]
ID_SPACE = 1_000_000  # topic and trend ids are run * ID_SPACE + topic index

SCHEMAS = {
    "documents": (
        "doc_id bigint, external_id string, title string, text string, url string, published_at timestamp, language string, region string, "
        "country string, source_name string, source_type string, doi string, canonical_url string, content_hash string, "
        "normalized_identity string, near_duplicate_of_id bigint, duplicate_of_id bigint, corpus_approved boolean, created_at date"
    ),
    "cache": "content_hash string, model_name string, model_revision string, embedding array<float>",
    "runs": "run_id bigint, status string, started_at date, finished_at date, cutoff date, n_documents bigint, n_topics bigint, corpus_hash string",
    "run_documents": (
        "run_id bigint, doc_id bigint, position bigint, provenance string, topic_index int, is_outlier boolean, "
        "membership_probability double, topic_id bigint"
    ),
    "topics": (
        "run_id bigint, topic_index int, topic_id bigint, label string, keywords array<string>, size bigint, region string, "
        "country string, centroid array<double>"
    ),
    "timepoints": "topic_id bigint, period string, doc_count bigint, prevalence double",
    "trends": (
        "trend_id bigint, topic_id bigint, run_id bigint, topic_index int, title string, summary string, maturity string, "
        "emergence double, keywords array<string>, size bigint, region string, country string"
    ),
    "evidence": "trend_id bigint, ord int, doc_id bigint, title string, url string",
    "assessments": (
        "trend_id bigint, pestel array<string>, category string, impact double, urgency double, uncertainty double, "
        "radar_stage string, rationale string"
    ),
    "translations": "trend_id bigint, language string, title string, summary string, rationale string",
    "canonicals": (
        "canonical_id string, status string, title string, summary string, maturity string, pestel array<string>, category string, "
        "impact double, urgency double, uncertainty double, radar_stage string, position double, first_run_id bigint, "
        "last_run_id bigint, merged_into_id string, updated_at date"
    ),
    "occurrences": (
        "occurrence_id bigint, trend_id bigint, topic_id bigint, run_id bigint, canonical_id string, change_type string, score double, "
        "margin double, changed_fields array<string>, review_status string, review_reason string, "
        "review_reasons array<struct<code:string,kind:string,field:string,before:string,after:string>>, evidence_added bigint, "
        "evidence_removed bigint, prevalence double"
    ),
}


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def _shaped(df: DataFrame, name: str) -> DataFrame:
    return df.to(df.sparkSession.createDataFrame([], SCHEMAS[name]).schema)


def save_state(state: dict[str, DataFrame], path: str) -> str:
    """Write all tables as a new version below `path`; the commit mark comes last, so readers never see half a state. Gives the version."""
    version = new_version()
    for name in SCHEMAS:
        _shaped(state[name], name).write.parquet(f"{path}/versions/{version}/{name}")
    commit(next(iter(state.values())).sparkSession, path, version)
    return version


def load_state(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The newest committed state below `path`, or a given version; an empty state where there is none yet."""
    versions = committed_versions(spark, path)
    if version is not None and version not in versions:
        raise ValueError(f"state {version} was not committed")
    if not versions:
        return empty_state(spark)
    return {name: spark.read.schema(schema).parquet(f"{path}/versions/{version or versions[-1]}/{name}") for name, schema in SCHEMAS.items()}


def execute_run(raw: DataFrame, state: dict[str, DataFrame], run_id: int, day: date, options: RunOptions = RunOptions()) -> dict[str, DataFrame]:
    """State after the run. raw: seq plus the reader columns; the given state is left untouched."""
    spark = raw.sparkSession
    ensure_checkpoint_dir(spark)
    out = dict(state)

    def add(name: str, rows: DataFrame) -> None:
        out[name] = state[name].unionByName(_shaped(rows, name).checkpoint())

    # Accepted documents and the cumulative corpus.
    accepted = D.ingest(raw, state["documents"]).withColumns({
        "corpus_approved": F.lit(True), "duplicate_of_id": F.lit(None).cast("bigint"), "created_at": F.lit(day),
    })
    accepted = _shaped(accepted, "documents").checkpoint()
    out["documents"] = state["documents"].unionByName(accepted)
    this_run = spark.createDataFrame([(run_id, day)], "run_id bigint, cutoff date")
    fresh = accepted.select(F.lit(run_id).cast("bigint").alias("run_id"), "doc_id")
    members = C.materialize_corpus(out["documents"], this_run, fresh).checkpoint()
    docs = out["documents"].join(members.select("doc_id", "position"), "doc_id")
    n_docs = members.count()

    def finish(n_topics: int) -> dict[str, DataFrame]:
        row = [(run_id, "completed", day, day, day, n_docs, n_topics)]
        done = spark.createDataFrame(row, "run_id bigint, status string, started_at date, finished_at date, cutoff date, n_documents bigint, n_topics bigint")
        add("runs", done.join(C.corpus_digest(members).select("run_id", "corpus_hash"), "run_id", "left"))
        return out

    if n_docs == 0:
        return finish(0)

    # Vectors and topic assignment.
    model, embed = pick_embedder(options.embedder)
    vectors, additions = V.cached_embeddings(docs, state["cache"], embed, model, options.revision)
    vectors = vectors.select("doc_id", "embedding").checkpoint()
    add("cache", additions)
    k = max(1, min(options.max_topics, n_docs // 10 or 1))
    labels = pick("modeler", options.modeler)(vectors, k, seed=options.seed, restarts=options.restarts)
    labels = labels.select(F.lit(run_id).cast("bigint").alias("run_id"), "doc_id", "label", F.lit(1.0).alias("probability")).checkpoint()
    topic_id = (F.col("run_id") * ID_SPACE + F.col("topic_index")).alias("topic_id")
    membership = C.write_back_topics(members, labels).select("*", topic_id)
    membership = membership.checkpoint()
    add("run_documents", membership)
    full = membership.select(*TOPIC, "topic_id", "doc_id", "position", "is_outlier").join(out["documents"], "doc_id").join(vectors, "doc_id")
    inside = full.where("NOT is_outlier")

    # Topics, time series, novelty and evidence.
    centroids = V.topic_centroids(inside).checkpoint()
    earlier = C.previous_completed(state["runs"].select("run_id", "status").unionByName(this_run.select("run_id", F.lit("running").alias("status"))))
    known = state["topics"].select(*TOPIC, "centroid").unionByName(centroids)
    novelty = V.emergence(known, earlier).where(F.col("run_id") == run_id)
    ranked = E.keywords(E.class_terms(inside))
    table = E.topic_table(inside, ranked).join(E.dominant_geo(inside, "position"), TOPIC).join(centroids, TOPIC)
    table = table.select("*", topic_id).checkpoint()
    add("topics", table)
    points = S.run_series(full.withColumn("topic_index", F.coalesce("topic_index", F.lit(-1))), options.quarters).select("*", topic_id).checkpoint()
    add("timepoints", points)
    levels = S.topic_maturity(points, novelty).select(*TOPIC, "growth", F.col("span").alias("periods"), "maturity")
    found = V.top_evidence(full.withColumn("topic_index", F.coalesce("topic_index", F.lit(-1))), centroids)
    found = V.with_fallback_evidence(found, table, inside)
    found = written(found.select(*TOPIC, "doc_id", "rank"), "evidence")
    shown = found.join(out["documents"].select("doc_id", "title", "url"), "doc_id")
    add("evidence", shown.select((F.col("run_id") * ID_SPACE + F.col("topic_index")).alias("trend_id"), F.col("rank").cast("int").alias("ord"), "doc_id", "title", "url"))
    cited = shown.where(F.coalesce("title", F.lit("")) != "")
    cited = cited.groupBy(*TOPIC).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"))

    # Description and assessment.
    sources = inside.groupBy(*TOPIC).agg(F.count_distinct("source_name", "source_type").alias("n_sources"))
    rows = table.join(cited, TOPIC, "left").join(levels, TOPIC, "left").join(novelty, TOPIC, "left").join(sources, TOPIC)
    rows = rows.withColumn("trend_id", F.col("topic_id")).withColumns({
        "titles": F.coalesce("titles", F.array().cast("array<string>")),
        "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
        "maturity": F.coalesce("maturity", F.lit("weak_signal")), "growth": F.coalesce("growth", F.lit(0.0)), "periods": F.coalesce("periods", F.lit(0)),
    })
    title, summary = pick("describer", options.describer)(F.col("keywords"), F.col("titles"))
    rows = rows.withColumns({"title": title, "summary": summary})
    rows = rows.withColumn("tokens", signal_tokens(F.col("keywords"), F.col("title"), F.col("summary"), F.col("titles")))
    assessed = pick("classifier", options.classifier)(rows).checkpoint()
    add("trends", assessed)
    add("assessments", assessed)
    add("translations", translated(assessed, options.translator, options.language))

    # Matching against the portfolio.
    candidates = M.match_candidates(state["canonicals"], state["occurrences"], state["trends"])
    shown = candidates.select(F.lit(run_id).cast("bigint").alias("run_id"), F.col("canonical_id").alias("known"), "status", "topic_id", "keywords")
    offered = shown.join(state["topics"].select("topic_id", "centroid"), "topic_id")
    past_docs = state["run_documents"].where("NOT is_outlier").select("topic_id", "doc_id")
    pairs = M.strongest_pairs(
        assessed.select("run_id", F.col("trend_id").alias("cur"), "centroid", F.transform("keywords", fold_case).alias("keywords")), offered,
        inside.select("run_id", F.col("topic_id").alias("cur"), "doc_id"), shown.join(past_docs, "topic_id").select("run_id", "known", "doc_id"),
    )
    found = M.match_run(pairs).select(
        F.col("cur").alias("trend_id"), F.col("known").alias("canonical_id"), "score", "margin", "reason"
    ).checkpoint()
    proposed = M.with_proposed(_shaped(assessed, "trends"), _shaped(assessed, "assessments"))
    topic_docs = out["run_documents"].select("topic_id", "doc_id", "is_outlier")
    occurrences = M.reconcile(
        proposed, found, state["canonicals"], state["occurrences"], topic_docs, S.latest_prevalence(points), options.max_new_trends
    ).withColumn("occurrence_id", F.col("trend_id")).checkpoint()
    add("occurrences", occurrences)
    out = finish(assessed.count())
    out["canonicals"] = M.auto_apply(state["canonicals"], proposed, occurrences, out["runs"]).checkpoint()
    return out
