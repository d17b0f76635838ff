"""Portfolio state: decisions folded into snapshots, run diffs, rollback, retention and read models.

State lives in immutable snapshots plus append-only logs: every function takes tables and returns new
ones. Folds use max_by/min_by aggregates, which combine map-side, so one busy entry is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.constants import (
    CHANGE_TYPES,
    DECISION_ACTIONS,
    MATURITY_LEVELS,
    MAX_QUARTERS,
    PROPOSED_FIELDS,
    SUPPORTED_LANGUAGES,
)
from trendloom.functions.joins import join_spreading_nulls
from trendloom.operators.match import previous_occurrences, sanitize
from trendloom.operators.series import last_points
from trendloom.session import ensure_checkpoint_dir

REVIEWED = ("approved", "not_required")


# ---------------------------------------------------------------- run views


def run_diff(occurrences: DataFrame, proposed: DataFrame) -> DataFrame:
    """Occurrences next to the snapshot of their predecessor, with noise removed from the stored change."""
    before = proposed.select(F.col("trend_id").alias("prev_trend_id"), F.lit(True).alias("has_before"), *[F.col(f).alias(f"b_{f}") for f in PROPOSED_FIELDS])
    prev = previous_occurrences(occurrences).select("occurrence_id", "prev_trend_id")
    rows = occurrences.join(proposed.drop("run_id"), "trend_id").join(prev, "occurrence_id", "left")
    rows = join_spreading_nulls(rows, before, "prev_trend_id", "occurrence_id").withColumns({
        "has_before": F.coalesce("has_before", F.lit(False)),
        "evidence_changed": (F.col("evidence_added") > 0) | (F.col("evidence_removed") > 0),
    })
    return sanitize(rows)


def diff_counts(diff: DataFrame, runs: DataFrame) -> DataFrame:
    counts = diff.groupBy("run_id").agg(*[F.count_if(F.col("change_type") == c).alias(f"n_{c}") for c in CHANGE_TYPES])
    return runs.select("run_id").join(counts, "run_id", "left").na.fill(0)


def list_runs(runs: DataFrame, occurrences: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs with counters per change type and review status."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    newest = runs.orderBy(F.desc("run_id")).limit(limit)
    recent = occurrences.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")  # of at most 200 runs

    def counters(column: str, name: str) -> DataFrame:
        counted = recent.groupBy("run_id", column).agg(F.count("*").alias("n"))
        return counted.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    rows = newest.join(counters("change_type", "change_counts"), "run_id", "left")
    return rows.join(counters("review_status", "review_counts"), "run_id", "left").orderBy(F.desc("run_id"))


def run_trends(
    trends: DataFrame, assessments: DataFrame, translations: DataFrame, language: str | None = None,
    run_id: int | None = None, maturity: str | None = None, region: str | None = None,
) -> DataFrame:
    """Trends of a run (all runs without `run_id`) with assessment, filters pushed to the scan."""
    rows = trends
    for column, value in (("run_id", run_id), ("maturity", maturity), ("region", region)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.join(assessments, "trend_id", "left")
    return localized(rows, translations, language)


def localized(rows: DataFrame, translations: DataFrame, language: str | None) -> DataFrame:
    """Swap title and summary (and a translated rationale, where one exists) for the stored translation."""
    if not language:
        return rows
    stored = translations.where(F.col("language") == language).select(
        "trend_id", F.lit(True).alias("t_found"), F.col("title").alias("t_title"), F.col("summary").alias("t_summary"), F.col("rationale").alias("t_rationale")
    )
    rows = rows.join(stored, "trend_id", "left")
    found = F.coalesce("t_found", F.lit(False))
    swaps = {c: F.when(found, F.col(f"t_{c}")).otherwise(F.col(c)) for c in ("title", "summary")}
    if "rationale" in rows.columns:
        swaps["rationale"] = F.coalesce(F.when(F.col("t_rationale") != "", F.col("t_rationale")), "rationale")
    return rows.withColumns(swaps).drop("t_found", "t_title", "t_summary", "t_rationale")


def series_strings(timepoints: DataFrame, n: int = MAX_QUARTERS) -> DataFrame:
    """Last n points per topic as one ordered array (bounded by n)."""
    return last_points(timepoints, "topic_id", n).groupBy("topic_id").agg(
        F.array_sort(F.collect_list(F.struct("period", "doc_count"))).alias("timeseries")
    )


def evidence_arrays(evidence: DataFrame) -> DataFrame:
    """Titled evidence per trend in order."""
    kept = evidence.where(F.trim(F.coalesce("title", F.lit(""))) != "")
    return kept.groupBy("trend_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "url"))).alias("evidence"))


def trend_detail(view: DataFrame, timepoints: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = view.join(series_strings(timepoints), "topic_id", "left")
    return rows.join(evidence_arrays(evidence), "trend_id", "left")


# ---------------------------------------------------------------- portfolio views


def latest_occurrences(occurrences: DataFrame) -> DataFrame:
    """Per portfolio entry its newest reviewed occurrence, else the newest of any state, and the count."""
    order = F.struct(F.col("review_status").isin(*REVIEWED), "run_id", "occurrence_id")
    return occurrences.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(
        F.max_by(F.struct("occurrence_id", "run_id", "trend_id"), order).alias("o"), F.count("*").alias("occurrence_count")
    ).select("canonical_id", "o.*", "occurrence_count")


def portfolio(canonicals: DataFrame, occurrences: DataFrame, trends: DataFrame, status: str | None = "active") -> DataFrame:
    """Entries with the snapshot of their latest occurrence, manual order first, then newest update."""
    rows = canonicals if status is None else canonicals.where(F.col("status") == status)
    snapshot = trends.select("trend_id", "topic_id", "emergence", "keywords", "size", "region", "country")
    return rows.join(latest_occurrences(occurrences), "canonical_id").join(snapshot, "trend_id")


def listing_order() -> list[Column]:
    return [F.col("position").asc_nulls_last(), F.col("updated_at").desc(), F.col("canonical_id")]


def pending_overlay(listed: DataFrame, occurrences: DataFrame, proposed: DataFrame) -> DataFrame:
    """Listing plus unreviewed results: new trends as provisional entries ahead, changes as flags."""
    pending = occurrences.where(F.col("review_status") == "pending")
    newest = pending.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(
        F.max(F.struct("run_id", "occurrence_id", "change_type")).alias("p")
    )
    flagged = listed.join(newest, "canonical_id", "left").select(
        F.lit(1).alias("sort_group"), F.col("canonical_id").alias("id"), "run_id", "trend_id", "title", "status", "size", "maturity",
        "pestel", "radar_stage", "summary", "keywords", "region", "category", "position", "updated_at",
        F.col("p").isNotNull().alias("pending_review"), F.col("p.change_type").alias("pending_change_type"),
        F.col("p.occurrence_id").alias("pending_occurrence_id"), F.col("p.run_id").alias("pending_run_id"),
    )
    fresh = pending.where("canonical_id IS NULL").select("occurrence_id", "trend_id", "change_type").join(proposed, "trend_id").select(
        F.lit(0).alias("sort_group"), F.concat(F.lit("pending-"), F.col("occurrence_id").cast("string")).alias("id"), "run_id",
        "trend_id", "title", F.lit("review").alias("status"), "size", "maturity", "pestel", "radar_stage", "summary", "keywords",
        "region", "category", F.lit(None).cast("double").alias("position"), F.lit(None).cast("date").alias("updated_at"),
        F.lit(True).alias("pending_review"), F.col("change_type").alias("pending_change_type"),
        F.col("occurrence_id").alias("pending_occurrence_id"), F.col("run_id").alias("pending_run_id"),
    )
    return fresh.unionByName(flagged)


def trend_history(occurrences: DataFrame, proposed: DataFrame, evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Points, evidence and decisions of every portfolio entry as ordered long rows."""
    linked = occurrences.where("canonical_id IS NOT NULL").select("canonical_id", "run_id", "occurrence_id", "trend_id", "change_type")
    facts = proposed.select("trend_id", "maturity", "size", F.col("impact").cast("string").alias("impact"))
    points = linked.join(facts, "trend_id").select(
        "canonical_id", F.lit("point").alias("kind"), "run_id", F.col("occurrence_id").alias("ref"), F.lit(0).cast("bigint").alias("ord"),
        F.concat_ws("|", "change_type", "maturity", F.col("size").cast("string"), "impact").alias("detail"),
    )
    cited = linked.join(evidence.where(F.coalesce("title", F.lit("")) != ""), "trend_id").select(
        "canonical_id", F.lit("evidence").alias("kind"), "run_id", F.col("occurrence_id").alias("ref"), F.col("ord").cast("bigint").alias("ord"), F.col("title").alias("detail"),
    )
    made = decisions.select(
        "canonical_id", F.lit("decision").alias("kind"), F.lit(None).cast("bigint").alias("run_id"), F.col("decision_key").alias("ref"),
        F.lit(0).cast("bigint").alias("ord"), F.col("action").alias("detail"),
    )
    return points.unionByName(cited).unionByName(made)


def review_queue(occurrences: DataFrame, trends: DataFrame, canonicals: DataFrame, translations: DataFrame, language: str | None = None, run_id: int | None = None) -> DataFrame:
    """Pending occurrences with their texts and the suggested portfolio entry, newest first."""
    pending = occurrences.where(F.col("review_status") == "pending")
    if run_id is not None:
        pending = pending.where(F.col("run_id") == run_id)
    texts = localized(trends.select("trend_id", "title", "summary", "maturity"), translations, language)
    suggested = canonicals.select("canonical_id", F.col("title").alias("suggested_title"), F.col("status").alias("suggested_status"))
    rows = pending.join(texts, "trend_id").join(suggested, "canonical_id", "left")
    return rows.orderBy(F.desc("run_id"), F.desc("occurrence_id"))


def localize_reasons(reasons: Column, before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Title and summary values in review reasons replaced by their localised text, where both exist."""
    def swap(r: Column) -> Column:
        b, a = r["before"], r["after"]
        for field in ("title", "summary"):
            hit = r["field"] == field
            b = F.when(hit & r["before"].isNotNull() & before[field].isNotNull(), before[field]).otherwise(b)
            a = F.when(hit & r["after"].isNotNull() & after[field].isNotNull(), after[field]).otherwise(a)
        return F.struct(r["code"].alias("code"), r["kind"].alias("kind"), r["field"].alias("field"), b.alias("before"), a.alias("after"))

    return F.transform(reasons, swap)


# ---------------------------------------------------------------- decisions


def first_per_key(decisions: DataFrame, order: list[str]) -> DataFrame:
    """Idempotent log: the first decision per key counts."""
    w = Window.partitionBy("idempotency_key").orderBy(*order)
    return decisions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")


def checked_decisions(decisions: DataFrame, canonicals: DataFrame, occurrences: DataFrame | None = None) -> DataFrame:
    """Add `problem` to decisions on portfolio entries; null means valid.

    With `occurrences`, a recorded occurrence that is decided on must belong to the entry.
    """
    known = canonicals.select("canonical_id", F.lit(True).alias("exists"))
    target = canonicals.select(F.col("canonical_id").alias("target_id"), F.lit(True).alias("target_exists"))
    rows = join_spreading_nulls(decisions.join(known, "canonical_id", "left"), target, "target_id", "canonical_id")
    foreign = F.lit(False)
    if occurrences is not None:
        owner = occurrences.select("occurrence_id", F.col("canonical_id").alias("owner_id"), F.lit(True).alias("recorded"))
        rows = rows.join(owner, "occurrence_id", "left")
        foreign = F.col("recorded").isNotNull() & ~F.col("owner_id").eqNullSafe(F.col("canonical_id"))
    merge = F.col("action") == "merge"
    problem = (
        F.when(~F.col("action").isin(*DECISION_ACTIONS), "unsupported_action")
        .when(F.col("exists").isNull(), "unknown_trend")
        .when(foreign, "foreign_occurrence")
        .when(merge & (F.col("target_id") == F.col("canonical_id")), "self_merge")
        .when(merge & F.col("target_exists").isNull(), "unknown_target")
    )
    return rows.withColumn("problem", problem).drop("exists", "target_exists", "owner_id", "recorded")


def edited_fields(decisions: DataFrame) -> list[str]:
    return [f for f in PROPOSED_FIELDS if f"new_{f}" in decisions.columns]


def status_after(action: Column, on_occurrence: Column) -> Column:
    """Status a decision sets; null leaves it unchanged."""
    return (
        F.when((action == "reject") & ~on_occurrence, "rejected")
        .when(action == "merge", "merged")
        .when(action.isin("restore", "confirm", "correct", "link", "create"), "active")
    )


def record_decisions(decisions: DataFrame, canonicals: DataFrame, order: list[str], on_occurrence: bool = False, occurrences: DataFrame | None = None) -> DataFrame:
    """Audit rows: valid decisions in order with the values before and after each of them."""
    valid = first_per_key(checked_decisions(decisions, canonicals, occurrences).where("problem IS NULL"), order)
    fields = edited_fields(decisions)
    start = canonicals.select("canonical_id", F.col("status").alias("c_status"), *[F.col(f).alias(f"c_{f}") for f in fields])
    rows = valid.join(start, "canonical_id").withColumn("new_status", status_after(F.col("action"), F.lit(on_occurrence)))
    before = Window.partitionBy("canonical_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for f in ["status", *fields]:
        rows = rows.withColumn(f"before_{f}", F.coalesce(F.last(f"new_{f}", ignorenulls=True).over(before), F.col(f"c_{f}")))
    return rows.withColumns({f"after_{f}": F.coalesce(f"new_{f}", f"before_{f}") for f in ["status", *fields]})


def fold_decisions(decisions: DataFrame, canonicals: DataFrame, order: list[str], on_occurrence: bool = False, occurrences: DataFrame | None = None) -> DataFrame:
    """Portfolio snapshot after all valid decisions: per field the last value set."""
    valid = first_per_key(checked_decisions(decisions, canonicals, occurrences).where("problem IS NULL"), order)
    valid = valid.withColumn("new_status", status_after(F.col("action"), F.lit(on_occurrence)))
    valid = valid.withColumn("new_merged_into_id", F.when(F.col("action") == "merge", F.col("target_id")))
    names = ["status", "merged_into_id", *edited_fields(decisions)]
    seq = F.struct(*order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), seq))
    state = valid.groupBy("canonical_id").agg(*[last(f"new_{n}").alias(f"new_{n}") for n in names])
    rows = canonicals.join(state, "canonical_id", "left")
    return rows.withColumns({n: F.coalesce(f"new_{n}", n) for n in names}).select(*canonicals.columns)


def review_outcomes(decisions: DataFrame, occurrences: DataFrame, canonicals: DataFrame, order: list[str]) -> DataFrame:
    """Every submitted review decision with its outcome: applied, duplicate, or the reason it was refused.

    A key belongs to its first valid request, later ones with it are duplicates whatever occurrence they name.
    Of the rest the first resolves an occurrence; applied rows carry the review status and the portfolio id
    the occurrence ends up with.
    """
    state = occurrences.select("occurrence_id", "run_id", F.col("trend_id").alias("o_trend_id"), F.col("canonical_id").alias("own_id"), "review_status")
    target = canonicals.select(F.col("canonical_id").alias("target_id"), F.lit(True).alias("target_exists"))
    rows = join_spreading_nulls(decisions.drop("canonical_id").join(state, "occurrence_id", "left"), target, "target_id", "occurrence_id")
    linking = F.col("action").isin("link", "merge")
    problem = (
        F.when(F.col("review_status").isNull(), "unknown_occurrence")
        .when(F.col("review_status") != "pending", "already_resolved")
        .when(~F.col("action").isin("confirm", "correct", "link", "create", "merge", "reject"), "invalid_action")
        .when((F.col("action") == "merge") & F.col("own_id").isNull(), "no_trend_to_merge")
        .when(linking & F.col("target_id").isNull(), "target_required")
        .when((F.col("action") == "merge") & (F.col("target_id") == F.col("own_id")), "self_merge")
        .when(linking & F.col("target_exists").isNull(), "unknown_target")
    )
    rows = rows.withColumn("problem", problem)
    seq = F.struct(*order)
    opened = rows.where("problem IS NULL").groupBy("idempotency_key").agg(F.min(seq).alias("opening"))
    rows = rows.join(opened, "idempotency_key", "left")
    winner = rows.where(F.col("problem").isNull() & (seq == F.col("opening"))).groupBy("occurrence_id").agg(F.min(seq).alias("w"))
    rows = rows.join(winner, "occurrence_id", "left")
    outcome = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(seq != F.col("opening"), "duplicate")
        .when(seq == F.col("w"), "applied")
        .otherwise("already_resolved")
    )
    fresh_id = F.sha2(F.concat(F.lit("occurrence-"), F.col("occurrence_id").cast("string")), 256)
    creates = (F.col("action") == "create") | (F.col("action").isin("confirm", "correct") & F.col("own_id").isNull())
    decided = F.when(creates, fresh_id).when(F.col("action") == "link", F.col("target_id")).otherwise(F.col("own_id"))
    rows = rows.withColumns({"outcome": outcome, "creates": creates, "decided_id": decided})
    applied = F.col("outcome") == "applied"
    return rows.withColumns({
        "new_review_status": F.when(applied, F.when(F.col("action") == "reject", "rejected").otherwise("approved")),
        "new_canonical_id": F.when(applied, F.when(F.col("action") == "merge", F.col("target_id")).otherwise(decided)),
    }).drop("w", "opening", "target_exists", "review_status")


def apply_reviews(outcomes: DataFrame, canonicals: DataFrame, proposed: DataFrame, order: list[str]) -> DataFrame:
    """Portfolio snapshot after applied reviews: new entries, accepted values, merges and last runs."""
    applied = outcomes.where("outcome = 'applied' AND decided_id IS NOT NULL")
    values = proposed.select(F.col("trend_id").alias("o_trend_id"), *[F.col(f).alias(f"p_{f}") for f in PROPOSED_FIELDS])
    rows = applied.join(values, "o_trend_id")
    accepts = F.col("action").isin("confirm", "correct", "create")
    edits = set(edited_fields(outcomes))
    corrected = F.col("action") == "correct"
    accepted = F.struct(*[
        (F.when(corrected & F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}")).otherwise(F.col(f"p_{f}")) if f in edits else F.col(f"p_{f}")).alias(f)
        for f in PROPOSED_FIELDS
    ])
    rows = rows.withColumns({"accepted": accepted, "accepts": accepts, "set_status": status_after(F.col("action"), F.lit(True))})
    seq = F.struct(*order)
    state = rows.groupBy("decided_id").agg(
        F.max_by("accepted", F.when(F.col("accepts"), seq)).alias("v"),
        F.max_by("set_status", F.when(F.col("set_status").isNotNull(), seq)).alias("s"),
        F.max_by("target_id", F.when(F.col("action") == "merge", seq)).alias("m"),
        F.max_by("run_id", F.when(F.col("action") != "reject", seq)).alias("r"),
        F.bool_or("creates").alias("created"), F.min("run_id").alias("first_run"),
    ).withColumnRenamed("decided_id", "canonical_id")
    touched = canonicals.join(state.where("NOT created"), "canonical_id", "left")
    hit = F.col("v").isNotNull()
    columns = {f: F.when(hit, F.col(f"v.{f}")).otherwise(F.col(f)) for f in PROPOSED_FIELDS}
    columns |= {"status": F.coalesce("s", "status"), "merged_into_id": F.coalesce("m", "merged_into_id"), "last_run_id": F.coalesce("r", "last_run_id")}
    kept = touched.withColumns(columns).select("canonical_id", "status", *PROPOSED_FIELDS, "merged_into_id", "first_run_id", "last_run_id")
    fresh = state.where("created").select(
        "canonical_id", F.col("s").alias("status"), "v.*", F.lit(None).cast("string").alias("merged_into_id"),
        F.col("first_run").alias("first_run_id"), F.col("r").alias("last_run_id"),
    )
    return kept.unionByName(fresh)


def follow_merges(canonicals: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Final target of every merged entry; paths double per round, cycles are left out."""
    ensure_checkpoint_dir(canonicals.sparkSession)
    links = canonicals.where(F.col("merged_into_id").isNotNull()).select("canonical_id", F.col("merged_into_id").alias("target"))
    links = links.checkpoint()
    for _ in range(max_rounds):
        onward = links.select(F.col("canonical_id").alias("target"), F.col("target").alias("onward"))
        jumped = links.join(onward, "target", "left").select(
            "canonical_id", F.coalesce("onward", "target").alias("target"), F.col("onward").isNotNull().alias("moved")
        ).checkpoint()
        links = jumped.select("canonical_id", "target")
        if jumped.where("moved").isEmpty():
            return links
    unresolved = links.select(F.col("canonical_id").alias("target"))
    return links.join(unresolved, "target", "left_anti").select("canonical_id", "target")


def redirect_occurrences(occurrences: DataFrame, targets: DataFrame) -> DataFrame:
    rows = occurrences.join(targets, "canonical_id", "left")
    return rows.withColumn("canonical_id", F.coalesce("target", "canonical_id")).drop("target")


def corrected_maturity(trends: DataFrame, feedback: DataFrame, order: list[str]) -> DataFrame:
    """Last valid maturity correction over the machine value, which stays available."""
    valid = feedback.where((F.col("action") == "correct") & (F.col("field") == "maturity") & F.col("new_value").isin(*MATURITY_LEVELS))
    last = valid.groupBy("trend_id").agg(F.max_by("new_value", F.struct(*order)).alias("corrected"))
    rows = trends.join(last, "trend_id", "left").withColumn("machine_maturity", F.col("maturity"))
    return rows.withColumn("maturity", F.coalesce("corrected", "maturity")).drop("corrected")


def reorder(canonicals: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual positions applied, and the items naming unknown entries."""
    wanted = items.select("canonical_id", F.col("position").alias("wanted"))
    moved = canonicals.join(wanted, "canonical_id", "left").withColumn("position", F.coalesce("wanted", "position")).drop("wanted")
    return moved.select(*canonicals.columns), wanted.join(canonicals, "canonical_id", "left_anti")


def sync_translations(outcomes: DataFrame, canonical_texts: DataFrame, trend_texts: DataFrame, supplied: DataFrame, language: str = "en", order: tuple[str, ...] = ("decision_key",)) -> DataFrame:
    """Bilingual texts of entries after accepted reviews; the newest accepted review of an entry counts.

    Base is the accepted trend's text per language. A correction's new title and summary (`new_summary`, where the outcomes have it) overwrite
    the reviewer's language (`edit_language`, where the outcomes have it, else `language`); the other language then takes the translation of
    the whole edited text that `supplied` holds for the decision, field by field the same text without one.
    canonical_texts and trend_texts: id, language, title, summary, rationale; supplied: the columns of `order`, title, summary, rationale.
    order: columns that order and tell apart the decisions.
    """
    correct = F.col("action") == "correct"
    edit = lambda c: F.when(correct & (F.col(c) != ""), F.col(c)) if c in outcomes.columns else F.lit(None).cast("string")
    accepted = outcomes.where("outcome = 'applied' AND action IN ('confirm', 'correct', 'create')").select(
        F.col("decided_id").alias("canonical_id"), F.col("o_trend_id").alias("trend_id"), *order, edit("new_title").alias("e_title"), edit("new_summary").alias("e_summary"),
        (F.coalesce("edit_language", F.lit(language)) if "edit_language" in outcomes.columns else F.lit(language)).alias("e_language"),
    )
    newest = F.max_by(F.struct("trend_id", *order, "e_title", "e_summary", "e_language"), F.struct(*order))
    latest = accepted.groupBy("canonical_id").agg(newest.alias("a")).select("canonical_id", "a.*")
    rows = latest.join(trend_texts, "trend_id").withColumns({"title": F.coalesce(F.when(F.col("language") == F.col("e_language"), F.col("e_title")), "title"), "summary": F.coalesce(F.when(F.col("language") == F.col("e_language"), F.col("e_summary")), "summary")})
    texts = ("title", "summary", "rationale")
    own = F.max(F.when(F.col("language") == F.col("e_language"), F.struct(*texts))).over(Window.partitionBy("canonical_id"))  # one row per language
    translated = supplied.select(*order, *[F.col(c).alias(f"t_{c}") for c in texts])
    rows = rows.withColumn("own", own).join(translated, list(order), "left")
    other = F.coalesce("e_title", "e_summary").isNotNull() & (F.col("language") != F.col("e_language"))
    rows = rows.select("canonical_id", "language", *[F.when(other, F.coalesce(f"t_{c}", f"own.{c}")).otherwise(F.col(c)).alias(c) for c in texts])
    return rows.unionByName(canonical_texts.join(latest, "canonical_id", "left_anti").select("canonical_id", "language", *texts))


def base_texts(canonicals: DataFrame) -> DataFrame:
    return canonicals.select(
        "canonical_id", F.explode(F.array(*[F.lit(x) for x in SUPPORTED_LANGUAGES])).alias("language"), "title", "summary", F.lit(None).cast("string").alias("rationale")
    )


def sync_portfolio(canonicals: DataFrame, occurrences: DataFrame, proposed: DataFrame) -> DataFrame:
    """Portfolio values overwritten by the newest occurrence of any review state."""
    newest = occurrences.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.max_by("trend_id", F.struct("run_id", "occurrence_id")).alias("trend_id"))
    values = newest.join(proposed.select("trend_id", "assessed", *[F.col(f).alias(f"n_{f}") for f in PROPOSED_FIELDS]), "trend_id")
    rows = canonicals.join(values.drop("trend_id"), "canonical_id", "left")
    columns = {}
    for f in PROPOSED_FIELDS:
        known = F.col("assessed").isNotNull() if f in PROPOSED_FIELDS[:3] else F.col("assessed")
        columns[f] = F.when(known, F.col(f"n_{f}")).otherwise(F.col(f))
    return rows.withColumns(columns).select(*canonicals.columns)


# ---------------------------------------------------------------- rollback and retention


def deletable(runs: DataFrame, trends: DataFrame, occurrences: DataFrame, baselines: DataFrame) -> DataFrame:
    """Whether each run may be rolled back, with the reason when not."""
    topics = trends.select("run_id").distinct().withColumn("has_topics", F.lit(True))
    observed = occurrences.groupBy("run_id").agg(F.count("*").alias("n_occ"))
    source = baselines.select(F.col("source_run_id").alias("run_id"), F.lit(True).alias("is_baseline")).distinct()
    top = observed.agg(F.max("run_id").alias("newest"))
    rows = runs.join(topics, "run_id", "left").join(observed, "run_id", "left").join(source, "run_id", "left").join(top)
    content = F.col("has_topics").isNotNull() | F.col("n_occ").isNotNull()
    reason = (
        F.when(F.col("status") == "running", "running")
        .when(F.col("is_baseline"), "baseline_source")
        .when(content & (F.col("newest") > F.col("run_id")), "newer_run_exists")
    )
    return rows.select("run_id", reason.isNull().alias("deletable"), reason.alias("reason"))


def rollback_canonicals(run_id: int, canonicals: DataFrame, occurrences: DataFrame, recorded: DataFrame, order: list[str]) -> DataFrame:
    """Portfolio without a run: its decisions undone, its new entries gone, last runs pointing back.

    recorded: record_decisions() rows on the run's occurrences. Undoing newest first ends at the
    before-value of the oldest decision that touched a field.
    """
    fields = [f for f in PROPOSED_FIELDS if f"before_{f}" in recorded.columns]
    seq = F.struct(*order)
    mine = recorded.join(occurrences.where(F.col("run_id") == run_id).select("occurrence_id"), "occurrence_id", "left_semi")
    undone = mine.groupBy("canonical_id").agg(
        F.min_by("before_status", seq).alias("u_status"), F.bool_or(F.col("action") == "merge").alias("u_merge"),
        *[F.min_by(f"before_{f}", F.when(F.col(f"new_{f}").isNotNull(), seq)).alias(f"u_{f}") for f in fields],
        *[F.bool_or(F.col(f"new_{f}").isNotNull()).alias(f"has_{f}") for f in fields],
    )
    rows = canonicals.join(undone, "canonical_id", "left")
    columns = {f: F.when(F.col(f"has_{f}"), F.col(f"u_{f}")).otherwise(F.col(f)) for f in fields}
    columns["status"] = F.coalesce("u_status", "status")
    columns["merged_into_id"] = F.when(F.coalesce("u_merge", F.lit(False)), None).otherwise(F.col("merged_into_id"))
    rows = rows.withColumns(columns)
    created = canonicals.where(F.col("first_run_id") == run_id).select(F.col("canonical_id").alias("merged_into_id"), F.lit(True).alias("dangling"))
    rows = rows.where(F.coalesce(F.col("first_run_id") != run_id, F.lit(True))).join(created, "merged_into_id", "left")
    rows = rows.withColumn("merged_into_id", F.when(F.col("dangling"), None).otherwise(F.col("merged_into_id")))
    earlier = occurrences.where((F.col("run_id") < run_id) & F.col("canonical_id").isNotNull()).groupBy("canonical_id").agg(F.max("run_id").alias("earlier"))
    rows = rows.join(earlier, "canonical_id", "left")
    last = F.when(F.col("last_run_id") == run_id, F.coalesce("earlier", "first_run_id")).otherwise(F.col("last_run_id"))
    return rows.withColumn("last_run_id", last).select(*canonicals.columns)


def orphan_documents(run_id: int, membership: DataFrame) -> DataFrame:
    """Documents no other run refers to."""
    return membership.groupBy("doc_id").agg(
        F.bool_or(F.col("run_id") == run_id).alias("mine"), F.bool_or(F.col("run_id") != run_id).alias("others")
    ).where("mine AND NOT others").select("doc_id")


def remove_documents(docs: DataFrame, gone: DataFrame, links=("duplicate_of_id", "near_duplicate_of_id")) -> DataFrame:
    """Documents without `gone`; links to removed documents become null."""
    rows = docs.join(gone, "doc_id", "left_anti")
    for link in (c for c in links if c in docs.columns):
        dead = gone.select(F.col("doc_id").alias(link), F.lit(True).alias("_dead"))
        rows = rows.join(dead, link, "left").withColumn(link, F.when(F.col("_dead"), None).otherwise(F.col(link))).drop("_dead")
    return rows.select(*docs.columns)


def rollback_report(run_id: int, canonicals: DataFrame, occurrences: DataFrame, recorded: DataFrame, membership: DataFrame) -> DataFrame:
    """Counts a rollback reports, as one row."""
    mine = recorded.join(occurrences.where(F.col("run_id") == run_id), "occurrence_id", "left_semi").agg(F.count("*").alias("reverted_decisions"))
    entries = canonicals.agg(
        F.count_if(F.col("first_run_id") == run_id).alias("removed_canonicals"),
        F.count_if((F.col("last_run_id") == run_id) & (F.col("first_run_id") != run_id)).alias("restored_canonicals"),
    )
    gone = orphan_documents(run_id, membership).agg(F.count("*").alias("removed_documents"))
    return mine.join(entries).join(gone).withColumn("run_id", F.lit(run_id).cast("bigint"))


def without_run(tables: dict[str, DataFrame], run_id: int) -> dict[str, DataFrame]:
    """Run tables without one run; children hang on trend, topic or occurrence ids.

    Entries that the run created go with all their decisions; occurrences of other runs lose their link to them.
    """
    keep = tables["runs"].where(F.col("run_id") != run_id)
    out = retain_runs(tables, keep.select("run_id"))
    if "canonicals" not in tables:
        return out
    created = tables["canonicals"].where(F.col("first_run_id") == run_id).select("canonical_id")
    for name in ("canonicals", "decisions"):
        if name in out:
            out[name] = out[name].join(created, "canonical_id", "left_anti").select(*out[name].columns)
    if "occurrences" in out:
        linked = out["occurrences"].join(created.withColumn("_gone", F.lit(True)), "canonical_id", "left")
        linked = linked.withColumn("canonical_id", F.when(F.col("_gone").isNull(), F.col("canonical_id")))
        out["occurrences"] = linked.select(*out["occurrences"].columns)
    return out


def retain_runs(tables: dict[str, DataFrame], kept: DataFrame) -> dict[str, DataFrame]:
    """Every table reduced to the kept runs: by run_id where present, else through trends, topics or occurrences."""
    trends = tables["trends"].join(kept, "run_id", "left_semi")
    occurrences = tables["occurrences"].join(kept, "run_id", "left_semi")
    parents = {"trend_id": trends, "topic_id": trends, "occurrence_id": occurrences}
    out = {}
    for name, df in tables.items():
        if "run_id" in df.columns:
            out[name] = df.join(kept, "run_id", "left_semi")
            continue
        key = next((k for k in parents if k in df.columns), None)
        if key is None:
            out[name] = df
        else:  # rows without the key belong to no run and stay
            mine = df.join(parents[key].select(key).distinct(), key, "left_semi")
            out[name] = mine.unionByName(df.where(F.col(key).isNull()))
    return out


def shift_runs(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """Retained runs moved to new start days with their duration unchanged."""
    rows = runs.join(starts, "run_id")
    finished = F.expr("date_add(new_start, datediff(finished_at, started_at))")
    return rows.withColumn("finished_at", finished).withColumn("started_at", F.col("new_start")).drop("new_start")


def rederive_spans(canonicals: DataFrame, occurrences: DataFrame, runs: DataFrame) -> DataFrame:
    """First and last run and the time stamps of entries from the retained occurrences."""
    span = occurrences.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.min("run_id").alias("first_run_id"), F.max("run_id").alias("last_run_id"))
    day = runs.select("run_id", F.coalesce("finished_at", "started_at").alias("day"))
    rows = canonicals.drop("first_run_id", "last_run_id", "updated_at").join(span, "canonical_id", "left")
    rows = rows.join(day.select(F.col("run_id").alias("first_run_id"), F.col("day").alias("created_at")), "first_run_id", "left")
    return rows.join(day.select(F.col("run_id").alias("last_run_id"), F.col("day").alias("updated_at")), "last_run_id", "left")


def seed_baseline(spec: DataFrame, proposed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Baseline rows for an ordered list of trends with their machine values; present ones are left alone.

    spec: position, trend_id, title, relevance, novelty, traceability.
    """
    machine = proposed.select(
        "trend_id", F.to_json(F.struct(F.col("title").alias("machine_title"), "summary", "maturity", "category", "impact", "radar_stage")).alias("payload")
    )
    rows = spec.join(machine, "trend_id").withColumn("snapshot_key", F.lit(key))
    return rows.join(existing.select("snapshot_key", "trend_id"), ["snapshot_key", "trend_id"], "left_anti")


def write_baseline(rows: DataFrame, path: str) -> None:
    """Write-once table."""
    rows.write.mode("errorifexists").parquet(path)


def backfill_legacy(occurrences: DataFrame) -> DataFrame:
    """Old change types `review` and `updated` mapped to today's type, status and first reason code."""
    kind = F.col("change_type")
    status = F.when(kind == "review", "pending").when(kind == "new", "approved").otherwise("not_required")
    reason = F.when(kind == "review", F.coalesce("review_reason", F.lit("legacy_review")))
    typed = (
        F.when(kind == "review", "classification_changed")
        .when((kind == "updated") & (F.col("changed_fields") == "summary"), "content_changed")
        .when(kind == "updated", "classification_changed")
        .otherwise(kind)
    )
    return occurrences.withColumns({"review_status": status, "review_reason": reason, "change_type": typed})


def reopen_undecided(occurrences: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved new trends nobody decided on return to the queue."""
    decided = decisions.select("occurrence_id", F.lit(True).alias("decided")).distinct()
    rows = occurrences.join(decided, "occurrence_id", "left")
    undecided = (F.col("change_type") == "new") & (F.col("review_status") == "approved") & F.col("decided").isNull()
    return rows.withColumns({
        "review_status": F.when(undecided, "pending").otherwise(F.col("review_status")),
        "review_reason": F.when(undecided, "new_trend").otherwise(F.col("review_reason")),
    }).drop("decided")
