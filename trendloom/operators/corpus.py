"""Cumulative corpus snapshots per run, their digests, exports and run lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.constants import CHANGE_TYPES
from trendloom.functions.joins import salted_join
from trendloom.functions.ordering import dense_positions

CHUNK = 4096


def eligible(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("corpus_approved") & F.col("duplicate_of_id").isNull())


def runs_by_day(days: DataFrame, runs: DataFrame) -> DataFrame:
    """(day, runs): for every day of `days` (day) the (run_id, cutoff) of the runs whose cutoff is that day or later.

    Days and cutoffs are laid on one line and walked backwards; both tables have a row per day or run, not per document.
    """
    marks = days.select("day", F.lit(None).cast(runs.select(F.struct("run_id", "cutoff")).schema[0].dataType).alias("run")).union(
        runs.where("cutoff IS NOT NULL").select(F.col("cutoff").alias("day"), F.struct("run_id", "cutoff").alias("run"))
    )
    later = Window.orderBy(F.desc("day"), F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("runs", F.collect_list("run").over(later)).where("run IS NULL").select("day", "runs")


def run_members(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """`docs` once for every run (run_id, cutoff) whose cutoff is not before their `created_at`.

    Documents meet the runs of their day by an equi-join on the day and are copied per run, so a further run costs its own rows only.
    """
    days = docs.where("created_at IS NOT NULL").select(F.col("created_at").alias("day")).distinct()
    spread = salted_join(docs.withColumn("day", F.col("created_at")), runs_by_day(days, runs), ["day"], "doc_id")
    return spread.select("*", F.explode("runs").alias("r")).select(*docs.columns, "r.run_id", "r.cutoff")


def materialize_corpus(docs: DataFrame, runs: DataFrame, new_docs: DataFrame | None = None) -> DataFrame:
    """Membership of every run: approved originals created up to the cutoff, densely numbered.

    `new_docs` holds (run_id, doc_id) of documents a run ingested itself.
    """
    narrow = eligible(docs).select("doc_id", "published_at", "content_hash", "created_at")
    members = run_members(narrow, runs.select("run_id", "cutoff"))
    if new_docs is not None:
        fresh = new_docs.select("run_id", "doc_id", F.lit(True).alias("is_new"))
        members = members.join(fresh, ["run_id", "doc_id"], "left")
    else:
        members = members.withColumn("is_new", F.lit(False))
    order = [F.col("published_at").asc_nulls_last(), F.col("content_hash").asc_nulls_last(), F.col("doc_id")]
    numbered = dense_positions(members, ["run_id"], order)
    return numbered.select(
        "run_id", "doc_id", "position", "content_hash",
        F.when(F.col("is_new"), "new").otherwise("carried_forward").alias("provenance"),
    )


def _stable_hash():
    return F.coalesce("content_hash", F.concat(F.lit("legacy-document:"), F.col("doc_id").cast("string")))


def _joined(df: DataFrame, keys: list[str], order: str, value: str, alias: str) -> DataFrame:
    """Concatenate `value` + newline in order; groups are bounded by the caller."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return df.groupBy(*keys).agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias(alias))


def corpus_digest(membership: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Digest of the ordered content hashes of every run, by one algorithm for all sizes.

    SHA-256 over one stream cannot be split, so blocks of `chunk` hashes are digested and their digests in turn.
    """
    lines = membership.select("run_id", "position", F.floor(F.col("position") / chunk).alias("part"), _stable_hash().alias("line"))
    return _chunked(_joined(lines, ["run_id", "part"], "position", "line", "block"), chunk)


def _chunked(parts: DataFrame, chunk: int) -> DataFrame:
    """Two more levels of at most `chunk` entries each cover chunk cubed documents per run."""
    leaf = parts.select("run_id", "part", F.floor(F.col("part") / chunk).alias("group"), F.sha2("block", 256).alias("line"))
    middle = _joined(leaf, ["run_id", "group"], "part", "line", "block").withColumn("line", F.sha2("block", 256))
    top = _joined(middle.select("run_id", "group", "line"), ["run_id"], "group", "line", "block")
    return top.select("run_id", F.sha2("block", 256).alias("corpus_hash"), F.lit("sha256-chunked").alias("algorithm"))


def write_back_topics(membership: DataFrame, labels: DataFrame) -> DataFrame:
    """Membership with topic, outlier flag and probability; joined on the document, not on the position."""
    joined = membership.join(labels.select("run_id", "doc_id", "label", "probability"), ["run_id", "doc_id"], "left")
    return joined.select(
        *membership.columns, F.when(F.col("label") >= 0, F.col("label")).alias("topic_index"),
        F.coalesce(F.col("label") < 0, F.lit(False)).alias("is_outlier"),
        F.col("probability").alias("membership_probability"),
    )


def export_corpus(membership: DataFrame, docs: DataFrame) -> DataFrame:
    """Corpus rows of every run in position order; documents without title and text are left out."""
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    full = docs.where(text != "").drop("content_hash", "topic_index")
    return membership.join(full, "doc_id")


def manifest(runs: DataFrame, corpus: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Corpus size by provenance, documents per source and change funnel, one row per run."""
    counts = corpus.groupBy("run_id").agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("provenance") == "new").alias("n_new_documents"),
        F.count_if(F.col("provenance") == "carried_forward").alias("n_carried_forward"),
    )
    per_source = corpus.where(F.col("source_name").isNotNull()).groupBy("run_id", "source_name").agg(F.count("*").alias("n"))
    sources = per_source.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_name", "n")))).alias("source_distribution")
    )
    funnel = occurrences.groupBy("run_id").agg(
        *[F.count_if(F.col("change_type") == c).alias(f"funnel_{c}") for c in CHANGE_TYPES]
    )
    joined = runs.join(counts, "run_id").join(sources, "run_id", "left").join(funnel, "run_id", "left")
    return joined.na.fill(0, [f"funnel_{c}" for c in CHANGE_TYPES])


def evaluable_runs(runs: DataFrame, membership: DataFrame) -> DataFrame:
    """Completed runs whose corpus was materialised."""
    return runs.where(F.col("status") == "completed").join(membership.select("run_id").distinct(), "run_id", "left_semi")


def resolve_run(runs: DataFrame, membership: DataFrame, requested: int | None = None) -> int:
    """The requested run when it has a corpus, else the newest completed one; errors otherwise."""
    available = membership.select("run_id").distinct()
    if requested is not None:
        if available.where(F.col("run_id") == requested).isEmpty():
            raise ValueError(f"run {requested} has no materialised corpus")
        return requested
    newest = evaluable_runs(runs, membership).agg(F.max("run_id")).first()[0]
    if newest is None:
        raise ValueError("no completed run has a materialised corpus")
    return newest


def latest_completed(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "completed").agg(F.max("run_id").alias("run_id"))


def previous_completed(runs: DataFrame) -> DataFrame:
    """For every run the newest completed run before it; the input holds one row per run."""
    before = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.when(F.col("status") == "completed", F.col("run_id"))
    return runs.select("run_id", F.max(done).over(before).alias("previous_run_id"))
