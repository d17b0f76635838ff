"""Structured Streaming jobs over the append-only logs and incoming documents.

Jobs drain what has arrived (`availableNow`) and may be called again for later arrivals. Results are
files below a given folder, never the driver: append sinks, or an update log whose newest version per
key is the current state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.functions.joins import spread
from trendloom.functions.tables import written
from trendloom.operators.dedup import exact_dedupe, identity_keys, with_identity
from trendloom.operators.portfolio import first_per_key
from trendloom.operators.vectors import cached_embeddings
from trendloom.streaming.stores import KeyedStore

FETCH_EVENTS = ("source_searched", "source_failed")


def log_stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of a Parquet table, a folder or one file; the schema is taken from the files."""
    path = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drain_append(stream: DataFrame, out: str) -> None:
    """Append rows to Parquet until everything that arrived is processed."""
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drain_updates(stream: DataFrame, out: str) -> None:
    """Write every changed aggregate row with its batch number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
    query.outputMode("update").trigger(availableNow=True).start().awaitTermination()


def drain_batches(stream: DataFrame, out: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{out}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()


def current_state(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest version per key of an update log."""
    rows = spark.read.parquet(f"{out}/data")
    values = [c for c in rows.columns if c not in (*keys, "version", "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("s"))
    return newest.select(*keys, "s.*")


# ---------------------------------------------------------------- progress log


def clamped_progress(events: DataFrame) -> DataFrame:
    return events.withColumn("progress", F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))))


def latest_progress(events: DataFrame) -> DataFrame:
    """Phase, progress and message of the newest event per run; batch and stream alike."""
    newest = events.groupBy("run_id").agg(F.max_by(F.struct("event_id", "phase", "progress", "message"), "event_id").alias("s"))
    return newest.select("run_id", "s.*")


def run_progress(runs: DataFrame, latest: DataFrame) -> DataFrame:
    """Progress of every run; without events the run status decides."""
    rows = runs.select("run_id", "status").join(latest, "run_id", "left")
    return rows.select(
        "run_id", "status", F.coalesce("phase", "status").alias("phase"),
        F.coalesce("progress", F.when(F.col("status") != "running", 100).otherwise(0)).alias("progress"),
        F.coalesce("message", F.lit("Run is waiting to start")).alias("message"),
    )


# Event codes that get a feed line each.
FEED_CODES = (
    "search_started", "round_started", "source_searched", "source_failed", "queries_expanded", "round_completed", "search_completed",
)


def feed_lines(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events shown one by one, and the rest of which only the first per run and phase is shown."""
    single = F.coalesce(F.col("code").isin(*FEED_CODES), F.lit(False)) | (F.col("phase") == "corpus")
    return events.where(single), events.where(~single)


def first_per_phase(events: DataFrame) -> DataFrame:
    """Smallest event per run and phase; works on a stream in update mode."""
    return events.groupBy("run_id", "phase").agg(F.min("event_id").alias("event_id"))


def activity_feed(events: DataFrame) -> DataFrame:
    single, rest = feed_lines(events)
    return single.select("run_id", "phase", "event_id", F.lit("each").alias("shown")).unionByName(
        first_per_phase(rest).select("run_id", "phase", "event_id", F.lit("once").alias("shown"))
    )


def fetch_percentage(seen: Column, estimate: Column) -> Column:
    """Share of the research phase, from 8 to 24 percent."""
    return (8 + F.least(F.lit(16.0), F.bround(seen / F.greatest(estimate, F.lit(1)) * 16, 0))).cast("int")


def fetch_progress(events: DataFrame, estimate: int) -> DataFrame:
    """Percentage after every search event of a run."""
    so_far = Window.partitionBy("run_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("seen", F.count(F.when(F.col("code").isin(*FETCH_EVENTS), 1)).over(so_far))
    return rows.where("code IS NOT NULL").select("run_id", "event_id", "code", fetch_percentage(F.col("seen"), F.lit(estimate)).alias("percent"))


def fetch_progress_state(events: DataFrame, estimate: int) -> DataFrame:
    """Newest percentage per run; works on a stream in update mode."""
    seen = events.groupBy("run_id").agg(F.count(F.when(F.col("code").isin(*FETCH_EVENTS), 1)).alias("seen"))
    return seen.select("run_id", fetch_percentage(F.col("seen"), F.lit(estimate)).alias("percent"))


def run_outcomes(runs: DataFrame, latest: DataFrame, error_chars: int | None = None) -> DataFrame:
    """Status, duration, error (its first `error_chars` characters if given) and latest phase of every run."""
    rows = runs.join(latest.select("run_id", "phase"), "run_id", "left")
    error = F.col("error") if error_chars is None else F.substring("error", 1, error_chars)
    return rows.select(
        "run_id", "status", F.datediff("finished_at", "started_at").alias("days"), error.alias("error"), "phase"
    )


# ---------------------------------------------------------------- incremental stores


CACHE = "content_hash string, model_name string, model_revision string, embedding array<float>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def ingest_documents(stream: DataFrame, out: str) -> None:
    """Incoming raw documents against the identities of the accepted ones, batch by batch; accepted documents are under data."""
    spark = stream.sparkSession
    identities = KeyedStore(spark, f"{out}/identities", ["key"], empty(spark, "key string").schema)

    def handle(batch: DataFrame, batch_id: int) -> None:
        docs = with_identity(spread(batch))
        path = f"{out}/data/batch={batch_id}"
        exact_dedupe(docs, taken=lambda keys: identities.lookup(keys, batch_id)).write.mode("overwrite").parquet(path)
        accepted = spark.read.schema(docs.schema).parquet(path)
        identities.put(written(identity_keys(accepted).select("key").distinct(), "keys"), batch_id)

    drain_batches(stream, out, handle)


def embedding_cache(spark: SparkSession, out: str) -> KeyedStore:
    return KeyedStore(spark, f"{out}/cache", ["content_hash"], empty(spark, CACHE).schema)


def embed_incoming(stream: DataFrame, out: str, embed: Callable[[Column], Column], model: str, revision: str = "default") -> None:
    """Only contents without a vector of the model are embedded and appended to the cache."""
    cache = embedding_cache(stream.sparkSession, out)

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = cache.lookup(batch.select("content_hash"), batch_id)
        _, additions = cached_embeddings(batch, known, embed, model, revision)
        cache.put(written(additions, "vectors"), batch_id)

    drain_batches(stream, out, handle)


def decision_store(spark: SparkSession, out: str, schema) -> KeyedStore:
    return KeyedStore(spark, f"{out}/decisions", ["idempotency_key"], schema)


def log_decisions(stream: DataFrame, out: str, order: list[str]) -> None:
    """Idempotent decision log: the first decision per key is stored, repeats are dropped."""
    log = decision_store(stream.sparkSession, out, stream.schema)

    def handle(batch: DataFrame, batch_id: int) -> None:
        first = written(first_per_key(batch, order), "first")
        fresh = first
        if log.segments(batch_id):  # an empty log drops nothing, and the join would move all rows to find that out
            known = log.lookup(first, batch_id).select("idempotency_key")
            fresh = first.join(known, "idempotency_key", "left_anti").select(stream.columns)
        log.put(fresh, batch_id, first.count())

    drain_batches(stream, out, handle)


def daily_counts(members: DataFrame) -> DataFrame:
    """Documents per topic and publication day, however late they arrive: the state holds a row per topic and day."""
    dated = members.where("topic_index >= 0 AND published_at IS NOT NULL")
    counts = dated.groupBy("run_id", "topic_index", F.window("published_at", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counts.select("run_id", "topic_index", F.col("w.start").cast("date").alias("day"), "n")


def quarters_of_days(days: DataFrame) -> DataFrame:
    period = F.concat(F.year("day").cast("string"), F.lit("-Q"), F.quarter("day").cast("string"))
    return days.groupBy("run_id", "topic_index", period.alias("period")).agg(F.sum("n").alias("doc_count"))
