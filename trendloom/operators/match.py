"""Matching run topics to the portfolio and typing what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.constants import (
    ALWAYS_MATERIAL,
    MATCH_MARGIN,
    MATCH_THRESHOLD,
    MATERIAL_SCORE_DELTA,
    NUMERIC_NOISE,
    PROPOSED_FIELDS,
    REVIEW_THRESHOLD,
    SCORE_FIELDS,
)
from trendloom.functions.tables import written
from trendloom.functions.text import fold_case
from trendloom.operators.assignment import auction
from trendloom.operators.pairs import PAIR, scored


# ---------------------------------------------------------------- candidates and scores


def match_candidates(canonicals: DataFrame, occurrences: DataFrame, trends: DataFrame) -> DataFrame:
    """Portfolio entries open for matching with the topic of their latest occurrence."""
    latest = occurrences.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(
        F.max_by(F.struct("trend_id", "run_id"), F.struct("run_id", "occurrence_id")).alias("latest")
    )
    is_open = canonicals.where(~F.col("status").isin("merged", "review")).select("canonical_id", "status")
    found = is_open.join(latest, "canonical_id").select("canonical_id", "status", "latest.*")
    topics = trends.select("trend_id", "topic_id", F.transform("keywords", fold_case).alias("keywords"))
    return found.join(topics, "trend_id")


def pair_scores(current: DataFrame, known: DataFrame, current_docs: DataFrame, known_docs: DataFrame) -> DataFrame:
    """Similarity of every topic of a run with every candidate offered to that run; see `pairs.scored`."""
    return scored(current, known, current_docs, known_docs)


def strongest_pairs(current: DataFrame, known: DataFrame, current_docs: DataFrame, known_docs: DataFrame) -> DataFrame:
    """Of every topic its strongest candidates, as many as its run has topics and two at least: all that matching needs.

    Some best assignment gives each of a run's R topics one of its R strongest candidates: if a topic used a weaker one, at least one of
    its R strongest would be free and could replace it. Two give the margin.
    """
    return scored(current, known, current_docs, known_docs, strongest=True)


def with_row_statistics(scores: DataFrame) -> DataFrame:
    """Add rank of the pair in its row and the margin over the best other candidate."""
    row = Window.partitionBy("run_id", "cur")
    ranked = scores.withColumn("rank", F.row_number().over(row.orderBy(F.desc("score"), "known")))
    top = ranked.withColumns({
        "first": F.max(F.when(F.col("rank") == 1, F.col("score"))).over(row),
        "second": F.max(F.when(F.col("rank") == 2, F.col("score"))).over(row),
    })
    other = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    return top.withColumn("margin", F.col("score") - F.coalesce(other, F.lit(0.0))).drop("first", "second")


def one_to_one(scores: DataFrame) -> DataFrame:
    """Pairs of the assignment with the highest total score of every run; `scores` may hold the strongest pairs only.

    Where a run has more topics than candidates the candidates choose, so the fewer always get a partner each.
    """
    ranked = with_row_statistics(scores)
    sides = scores.groupBy("run_id").agg(F.count_distinct("cur").alias("n_cur"), F.count_distinct("known").alias("n_known"))
    strong = ranked.join(sides, "run_id").where("rank <= n_cur")
    turned = F.col("n_cur") > F.col("n_known")
    side = lambda a, b: F.when(turned, F.col(a).cast("string")).otherwise(F.col(b).cast("string"))
    chosen = auction(strong.select("run_id", side("known", "cur").alias("topic"), side("cur", "known").alias("entry"), "score")).join(sides, "run_id")
    pairs = chosen.select(
        "run_id", side("entry", "topic").cast(scores.schema["cur"].dataType).alias("cur"), side("topic", "entry").cast(scores.schema["known"].dataType).alias("known")
    )
    return ranked.join(pairs, PAIR, "left_semi")


def mutual_best(scores: DataFrame) -> DataFrame:
    """Pairs that are each other's best choice: one parallel greedy round of partial aggregates, without windows."""
    order = F.struct((-F.col("score")).alias("less"), F.col("known"), F.col("status"))
    rows = scores.groupBy("run_id", "cur").agg(F.min(order).alias("best"))
    columns = scores.groupBy("run_id", "known").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("cur"))).alias("choice"))
    rest = scores.join(rows.select("run_id", "cur", F.col("best.known").alias("best_known")), ["run_id", "cur"]).where("known <> best_known")
    second = rest.groupBy("run_id", "cur").agg(F.max("score").alias("second"))
    best = rows.select("run_id", "cur", "best.known", "best.status", (-F.col("best.less")).alias("score")).join(second, ["run_id", "cur"], "left")
    mutual = best.join(columns, ["run_id", "known"]).where("choice.cur = cur")
    return mutual.select(*PAIR, "status", "score", F.lit(1).alias("rank"), (F.col("score") - F.coalesce("second", F.lit(0.0))).alias("margin"))


def match_reasons(
    pairs: DataFrame, threshold: float = MATCH_THRESHOLD, review_threshold: float = REVIEW_THRESHOLD,
    margin_threshold: float = MATCH_MARGIN,
) -> DataFrame:
    """Accepted pairs with the first reason that calls for a review."""
    reason = (
        F.when(F.col("status") == "rejected", "matched_rejected")
        .when(F.col("score") < threshold, "below_match_threshold")
        .when(F.col("margin") < margin_threshold, "ambiguous_margin")
    )
    kept = pairs.where(F.col("score") >= review_threshold)
    return kept.select(*PAIR, "score", "margin", reason.alias("reason"))


def split_candidates(scores: DataFrame, assigned: DataFrame, review_threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Topics left without a partner that still resemble one strongly."""
    left = scores.join(assigned.select("run_id", "cur"), ["run_id", "cur"], "left_anti")
    best = with_row_statistics(left).where(F.col("rank") == 1)
    return best.where(F.col("score") >= review_threshold).select(
        *PAIR, "score", F.lit(0.0).alias("margin"), F.lit("split_candidate").alias("reason")
    )


def match_run(scores: DataFrame) -> DataFrame:
    """All matches of all runs; the score table is stored once because four steps read it."""
    scores = written(scores, "scores")
    assigned = written(one_to_one(scores), "assigned")
    return match_reasons(assigned).unionByName(split_candidates(scores, assigned))


# ---------------------------------------------------------------- differences


def lists_differ(a: Column, b: Column) -> Column:
    return ~F.array_sort(a).eqNullSafe(F.array_sort(b))


def numbers_differ(a: Column, b: Column) -> Column:
    """Recomputed scores drift; null against a number differs."""
    return F.coalesce(F.abs(a - b) > NUMERIC_NOISE, ~a.eqNullSafe(b))


def values_differ(field: str, a: Column, b: Column) -> Column:
    if field == "pestel":
        return lists_differ(a, b)
    if field in SCORE_FIELDS:
        return numbers_differ(a, b)
    return ~a.eqNullSafe(b)


def material_change(field: str, a: Column, b: Column) -> Column:
    if field in SCORE_FIELDS:
        return F.coalesce(F.abs(a - b) >= MATERIAL_SCORE_DELTA, ~a.eqNullSafe(b))
    return F.lit(field in ALWAYS_MATERIAL)


DIFF = "struct<field:string,material:boolean,before:string,after:string>"


def field_diffs(before: str = "c_", assessed: Column | None = None) -> Column:
    """Proposed fields that differ from the `before` columns, with weight and both values.

    One array per row feeds change type, changed fields and review reasons, so every comparison is
    made once. Labels and scores need an assessment.
    """
    assessed = F.lit(True) if assessed is None else assessed
    text = ("title", "summary", "maturity")

    def diff(f: str) -> Column:
        a, b = F.col(before + f), F.col(f)
        changed = values_differ(f, a, b) if f in text else values_differ(f, a, b) & assessed
        return F.when(changed, F.struct(
            F.lit(f).alias("field"), material_change(f, a, b).alias("material"), _as_text(f, a).alias("before"), _as_text(f, b).alias("after"),
        ).cast(DIFF))

    return F.array_compact(F.array(*[diff(f) for f in PROPOSED_FIELDS]))


def _as_text(field: str, value: Column) -> Column:
    return F.array_join(value, ",") if field == "pestel" else value.cast("string")


def field_names(diffs: Column) -> Column:
    return F.transform(diffs, lambda d: d["field"])


def material_names(diffs: Column) -> Column:
    return field_names(F.filter(diffs, lambda d: d["material"]))


def change_type(diffs: Column, evidence_changed: Column) -> Column:
    return (
        F.when(F.exists(diffs, lambda d: d["material"]), "classification_changed")
        .when(F.size(diffs) > 0, "content_changed")
        .when(evidence_changed, "evidence_only")
        .otherwise("unchanged")
    )


REASON = "struct<code:string,kind:string,field:string,before:string,after:string>"


def review_reasons(diffs: Column, identity_reason: Column) -> Column:
    """Identity reason first, then one reason per changed field with its values before and after."""
    null = F.lit(None).cast("string")
    identity = F.struct(identity_reason.alias("code"), F.lit("identity").alias("kind"), null.alias("field"), null.alias("before"), null.alias("after"))
    fields = F.transform(diffs, lambda d: F.struct(
        F.when(d["material"], "material_change").otherwise("content_change").alias("code"), F.lit("classification").alias("kind"),
        d["field"].alias("field"), d["before"].alias("before"), d["after"].alias("after"),
    ).cast(REASON))
    return F.concat(F.array_compact(F.array(F.when(identity_reason.isNotNull(), identity.cast(REASON)))), fields)


def with_proposed(trends: DataFrame, assessments: DataFrame) -> DataFrame:
    """Trends with the nine comparable fields and a flag for an existing assessment."""
    return trends.join(assessments.withColumn("assessed", F.lit(True)), "trend_id", "left").withColumn(
        "assessed", F.coalesce("assessed", F.lit(False))
    )


def against_portfolio(proposed: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Proposed rows (with canonical_id) next to the portfolio values, differences in `diffs`."""
    before = canonicals.select("canonical_id", *[F.col(f).alias(f"c_{f}") for f in PROPOSED_FIELDS])
    return proposed.join(before, "canonical_id").withColumn("diffs", field_diffs(assessed=F.col("assessed")))


# ---------------------------------------------------------------- history


def previous_occurrences(occurrences: DataFrame) -> DataFrame:
    """Every occurrence with the latest one of its portfolio entry from a strictly earlier run."""
    earlier = Window.partitionBy("canonical_id").orderBy("run_id").rangeBetween(Window.unboundedPreceding, -1)
    linked = occurrences.where("canonical_id IS NOT NULL")
    prev = F.max(F.struct("run_id", "occurrence_id", "trend_id")).over(earlier)
    return linked.withColumn("p", prev).select(
        "occurrence_id", "canonical_id", "run_id", "trend_id", F.col("p.run_id").alias("prev_run_id"),
        F.col("p.occurrence_id").alias("prev_occurrence_id"), F.col("p.trend_id").alias("prev_trend_id"),
    )


def evidence_delta(links: DataFrame, topic_docs: DataFrame) -> DataFrame:
    """Documents gained and lost against the previous occurrence.

    links: occurrence_id, topic_id, prev_topic_id; topic_docs: topic_id, doc_id, is_outlier.
    """
    links = written(links, "links")
    side = lambda topic, now: F.struct(F.col(topic).alias("topic_id"), F.lit(now).alias("now"), F.lit(1 - now).alias("before"))
    sides = links.select("occurrence_id", F.explode(F.array(side("topic_id", 1), side("prev_topic_id", 0))).alias("s")).select("occurrence_id", "s.*")
    docs = topic_docs.where("NOT is_outlier").select("topic_id", "doc_id")  # met once, where they lie; the grouping below takes copies out
    met = docs.join(sides.where("topic_id IS NOT NULL"), "topic_id")
    per_doc = met.groupBy("occurrence_id", "doc_id").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    counts = per_doc.groupBy("occurrence_id").agg(
        F.count_if(F.col("now") > F.col("before")).alias("evidence_added"),
        F.count_if(F.col("before") > F.col("now")).alias("evidence_removed"),
    )
    return links.select("occurrence_id").join(counts, "occurrence_id", "left").na.fill(0, ["evidence_added", "evidence_removed"])


def admit_new(unmatched: DataFrame, cap: int) -> DataFrame:
    """Largest new topics of every run; the surplus stays in the run without an occurrence."""
    order = Window.partitionBy("run_id").orderBy(F.desc("size"), "trend_id")
    return unmatched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def reconcile(
    proposed: DataFrame, matches: DataFrame, canonicals: DataFrame, history: DataFrame, topic_docs: DataFrame,
    prevalence: DataFrame | None, max_new: int | None = None,
) -> DataFrame:
    """Occurrence rows of runs from given matches.

    proposed: with_proposed() rows; matches: trend_id, canonical_id, score, margin, reason;
    history: earlier occurrences with their topic_id; prevalence: topic_id, prevalence, None where nobody reads it. Only the history of the
    matched entries is read on, and the documents of the topics that are compared. `max_new`: new trends per run, all if None.
    """
    rows, matches = written(proposed.join(matches, "trend_id", "left"), "proposed"), written(matches, "matches")
    fresh = rows.where("canonical_id IS NULL")
    if max_new is not None:
        fresh = admit_new(fresh, max_new).drop("rank")
    matched = rows.where("canonical_id IS NOT NULL")
    keys = ["occurrence_id", "canonical_id", "run_id", "trend_id", "topic_id"]
    current = matched.withColumn("occurrence_id", F.col("trend_id")).select(*keys)
    past = history.select(*keys).join(matches.select("canonical_id").distinct(), "canonical_id", "left_semi")
    everything = past.join(current, "occurrence_id", "left_anti").select(*keys).unionByName(current)
    topic_of = everything.select("trend_id", "topic_id")
    links = previous_occurrences(everything).join(current.select("occurrence_id"), "occurrence_id", "left_semi").join(topic_of, "trend_id").join(
        topic_of.select(F.col("trend_id").alias("prev_trend_id"), F.col("topic_id").alias("prev_topic_id")), "prev_trend_id", "left"
    ).select("occurrence_id", "topic_id", "prev_topic_id")
    delta = evidence_delta(links, topic_docs).withColumnRenamed("occurrence_id", "trend_id")
    # what a trend's values do not decide meets the trends before the differences make their rows wide
    if prevalence is None:  # a reader of few columns takes the differences first
        unread = F.lit(None).cast("double").alias("prevalence")
        known, fresh = against_portfolio(matched, canonicals).join(delta, "trend_id").select("*", unread), fresh.select("*", unread)
    else:
        shown = rows.where("canonical_id IS NOT NULL").select("trend_id", "topic_id").join(prevalence, "topic_id", "left").groupBy("trend_id").agg(F.first("prevalence").alias("prevalence"))
        known, fresh = against_portfolio(matched.join(delta, "trend_id").join(shown, "trend_id"), canonicals), fresh.join(prevalence, "topic_id", "left")
    moved = (F.col("evidence_added") > 0) | (F.col("evidence_removed") > 0)
    known = known.select(
        "trend_id", "run_id", "topic_id", "canonical_id", "score", "margin", "evidence_added", "evidence_removed",
        change_type(F.col("diffs"), moved).alias("change_type"), field_names(F.col("diffs")).alias("changed_fields"),
        review_reasons(F.col("diffs"), F.col("reason")).alias("review_reasons"), "prevalence",
    )
    own = topic_docs.where("NOT is_outlier").join(fresh.select("topic_id").distinct(), "topic_id", "left_semi").groupBy("topic_id").agg(F.count_distinct("doc_id").alias("evidence_added"))
    text, labels = PROPOSED_FIELDS[:3], PROPOSED_FIELDS
    null = F.lit(None).cast("string")
    start = F.struct(F.lit("new_trend").alias("code"), F.lit("classification").alias("kind"), null.alias("field"), null.alias("before"), null.alias("after"))
    fresh = fresh.join(own, "topic_id", "left").select(
        "trend_id", "run_id", "topic_id", "canonical_id", "score", "margin", F.coalesce("evidence_added", F.lit(0)).alias("evidence_added"),
        F.lit(0).cast("bigint").alias("evidence_removed"), F.lit("new").alias("change_type"),
        F.when(F.col("assessed"), F.array(*[F.lit(f) for f in labels])).otherwise(F.array(*[F.lit(f) for f in text])).alias("changed_fields"),
        F.array(start.cast(REASON)).alias("review_reasons"), "prevalence",
    )
    return known.unionByName(fresh).withColumns({
        "review_status": F.when(F.size("review_reasons") > 0, "pending").otherwise("not_required"),
        "review_reason": F.get("review_reasons", F.lit(0))["code"],
    })


def newest_silent(occurrences: DataFrame) -> DataFrame:
    """canonical_id, run_id, trend_id of the newest occurrence of every entry that needs no review."""
    silent = occurrences.where((F.size("review_reasons") == 0) & F.col("canonical_id").isNotNull())
    return silent.groupBy("canonical_id").agg(F.max(F.struct("run_id", "trend_id")).alias("a")).select("canonical_id", "a.*")


def auto_apply(canonicals: DataFrame, proposed: DataFrame, occurrences: DataFrame, runs: DataFrame) -> DataFrame:
    """New portfolio snapshot: occurrences without a review reason overwrite values and mark the run.

    When several runs are applied at once the newest wins; the update time is the end of the run.
    """
    newest = newest_silent(occurrences)
    values = proposed.select("trend_id", "assessed", *[F.col(f).alias(f"n_{f}") for f in PROPOSED_FIELDS])
    ended = runs.select("run_id", F.coalesce("finished_at", "started_at").alias("n_updated_at"))
    updates = newest.join(values, "trend_id").join(ended, "run_id", "left").drop("trend_id").withColumnRenamed("run_id", "n_last_run_id")
    rows = canonicals.join(updates, "canonical_id", "left")
    hit = F.col("n_last_run_id").isNotNull()
    columns = {f: F.when(hit & (F.col("assessed") if f not in PROPOSED_FIELDS[:3] else F.lit(True)), F.col(f"n_{f}")).otherwise(F.col(f)) for f in PROPOSED_FIELDS}
    columns["last_run_id"] = F.coalesce("n_last_run_id", "last_run_id")
    columns["updated_at"] = F.coalesce("n_updated_at", "updated_at")
    return rows.withColumns(columns).select(*canonicals.columns)


def auto_apply_texts(canonical_texts: DataFrame, occurrences: DataFrame, trend_texts: DataFrame) -> DataFrame:
    """Texts per language after `auto_apply`: all languages of an entry that a run updates silently come from that run's trend.

    canonical_texts: canonical_id and trend_texts: trend_id, each with language, title, summary, rationale.
    """
    newest = newest_silent(occurrences).select("canonical_id", "trend_id")
    fresh = newest.join(trend_texts, "trend_id").select("canonical_id", "language", "title", "summary", "rationale")
    return fresh.unionByName(canonical_texts.join(newest, "canonical_id", "left_anti").select(*fresh.columns))


def sanitize(rows: DataFrame, before: str = "b_") -> DataFrame:
    """Drop stored differences that are noise and type the change again.

    rows: change_type, changed_fields, evidence flag `evidence_changed`, `has_before`, current fields and `before` fields.
    """
    redo = F.col("has_before") & F.col("change_type").isin("classification_changed", "content_changed")
    stored = F.filter(field_diffs(before), lambda d: F.array_contains("changed_fields", d["field"]))
    rows = rows.withColumn("kept", stored)
    return rows.withColumns({
        "change_type": F.when(redo, change_type(F.col("kept"), F.col("evidence_changed"))).otherwise(F.col("change_type")),
        "changed_fields": F.when(redo, field_names(F.col("kept"))).otherwise(F.col("changed_fields")),
    }).drop("kept")
