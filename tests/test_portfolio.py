from datetime import date

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from trendloom.catalog import portfolio_queries as queries
from trendloom.catalog.model import Model
from trendloom.constants import PROPOSED_FIELDS
from trendloom.functions.joins import join_in_groups, join_spreading_nulls
from trendloom.operators import assess as G
from trendloom.operators import match as M
from trendloom.operators import portfolio as P
from trendloom.operators import views as W

SIGNAL = "tokens array<string>, maturity string, emergence double, size int, n_sources int, growth double, periods int"
PAIRS = "run_id long, cur string, known string, status string, score double"


def test_classifier(table):
    rows = [(["carbon", "circular"], "emerging", None, 5, 1, 0.0, 0), (["ai", "software"], "megatrend", 1.0, 50, 5, 2.0, 4), ([], None, None, 0, 1, 0.125, 3)]
    got = G.assess(table(rows, SIGNAL)).collect()
    assert (got[0]["category"], got[0]["pestel"]) == ("climate", ["environmental"])
    assert (got[1]["category"], got[1]["pestel"]) == ("digital", ["technological"])
    assert (got[1]["impact"], got[1]["urgency"], got[1]["uncertainty"]) == (10.0, 10.0, 6.0)
    assert (got[2]["category"], got[2]["pestel"], got[2]["impact"]) == ("technology", ["technological"], 5.0)
    assert got[2]["rationale"] == "Heuristic: maturity=None, size=0, sources=1, growth=0.12."


def test_radar_stage(table):
    df = table([(9.0, 8.0), (6.0, 3.0), (3.0, 7.0), (2.0, 2.0)], "i double, u double")
    assert [r[0] for r in df.select(G.radar_stage(F.col("i"), F.col("u"))).collect()] == ["act", "prepare", "prepare", "watch"]


def test_template_text(table):
    df = table([(["smart FACADE", "glass", "ai", "x"], ["T1", "", "T3", "T4"]), ([], [])], "k array<string>, t array<string>")
    got = df.select(G.template_title(F.col("k")).alias("a"), G.template_summary(F.col("k"), F.col("t")).alias("b")).collect()
    assert got[0]["a"] == "Smart facade, Glass, Ai"
    assert got[0]["b"] == "This trend centers on smart FACADE, glass, ai, x. Representative sources: T1; T3."
    assert (got[1]["a"], got[1]["b"]) == ("Unlabeled trend", "This trend centers on the clustered documents.")


def test_calibration_leaves_single_rows(table):
    schema = "trend_id long, impact double, urgency double, uncertainty double, radar_stage string, size int, emergence double"
    one = table([(1, 4.0, 4.0, None, "watch", 1, None)], schema)
    assert rows_of(G.calibrate(one), "impact", "radar_stage") == [(4.0, "watch")]
    many = table([(i, float(i), 5.0, 2.0, "watch", 1, None) for i in range(1, 4)], schema)
    assert rows_of(G.calibrate(many), "trend_id", "impact", "urgency") == [(1, 3.2, 3.2), (2, 6.4, 6.4), (3, 9.5, 9.5)]


def test_match_reasons(table):
    scores = table([
        (1, "a", "x", "active", 0.9), (1, "a", "y", "active", 0.2), (1, "b", "x", "active", 0.1), (1, "b", "y", "active", 0.95),
        (2, "p", "only", "active", 0.8), (2, "q", "only", "active", 0.79),
        (3, "r", "bad", "rejected", 0.9), (4, "s", "u", "active", 0.7), (4, "s", "v", "active", 0.65), (5, "t", "w", "active", 0.55), (6, "z", "w", "active", 0.4),
    ], PAIRS)
    got = {(r["run_id"], r["cur"]): (r["known"], r["reason"]) for r in M.match_run(scores).collect()}
    assert got == {
        (1, "a"): ("x", None), (1, "b"): ("y", None), (2, "p"): ("only", None), (2, "q"): ("only", "split_candidate"),
        (3, "r"): ("bad", "matched_rejected"), (4, "s"): ("u", "ambiguous_margin"), (5, "t"): ("w", "below_match_threshold"),
    }


def test_value_differences(table):
    df = table([(8.0, 8.00035, ["a", "b"], ["b", "a"]), (8.0, 8.4, ["a"], None), (None, 1.0, None, None)], "a double, b double, x array<string>, y array<string>")
    got = df.select(M.numbers_differ(F.col("a"), F.col("b")), M.lists_differ(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True), (True, False)]


VALUES = "title string, summary string, maturity string, pestel array<string>, category string, impact double, urgency double, uncertainty double, radar_stage string"


def snapshot(**over):
    base = dict(title="T", summary="S", maturity="emerging", pestel=["legal"], category="digital", impact=8.0, urgency=5.0, uncertainty=3.0, radar_stage="act")
    return tuple({**base, **over}[f] for f in PROPOSED_FIELDS)


def test_sanitised_changes(table):
    cases = [
        ("classification_changed", ["impact"], snapshot(impact=8.00035), False), ("classification_changed", ["impact", "title"], snapshot(impact=8.4, title="U"), False),
        ("content_changed", ["impact"], snapshot(impact=9.0), False), ("content_changed", ["summary"], snapshot(), True),
    ]
    cols = "change_type string, changed_fields array<string>, has_before boolean, evidence_changed boolean, " + VALUES + ", " + ", ".join(f"b_{c.strip()}" for c in VALUES.split(","))
    df = table([(t, f, True, e, *after, *snapshot()) for t, f, after, e in cases], cols)
    got = [(r["change_type"], r["changed_fields"]) for r in M.sanitize(df).collect()]
    assert got == [("unchanged", []), ("classification_changed", ["title", "impact"]), ("content_changed", ["impact"]), ("evidence_only", [])]


CANON = "canonical_id string, status string, " + VALUES + ", position double, first_run_id long, last_run_id long, merged_into_id string, updated_at date"
DECISIONS = "decision_key long, tie long, occurrence_id long, canonical_id string, action string, idempotency_key string, target_id string, new_title string"


def canon(table, *rows):
    """rows: (id, status, first run, last run, merged into)."""
    return table([(i, s, *snapshot(), None, a, b, m, date(2024, 1, 1)) for i, s, a, b, m in rows], CANON)


def test_decision_fold_and_audit(table):
    canonicals = canon(table, ("a", "active", 1, 1, None), ("b", "active", 1, 1, None))
    log = table([
        (1, 0, None, "a", "correct", "k1", None, "New"), (2, 0, None, "a", "reject", "k2", None, None), (3, 0, None, "a", "correct", "k1", None, "Ignored"),
        (4, 0, None, "a", "restore", "k4", None, None), (5, 0, None, "b", "merge", "k5", "a", None), (6, 0, None, "b", "merge", "k6", "zz", None), (7, 0, None, "a", "fly", "k7", None, None),
    ], DECISIONS)
    order = ["decision_key", "tie"]
    assert rows_of(P.fold_decisions(log, canonicals, order).na.fill("-"), "canonical_id", "status", "title", "merged_into_id") == [("a", "active", "New", "-"), ("b", "merged", "T", "a")]
    audit = rows_of(P.record_decisions(log, canonicals, order), "decision_key", "before_status", "after_status", "before_title", "after_title")
    assert audit == [(1, "active", "active", "T", "New"), (2, "active", "rejected", "New", "New"), (4, "rejected", "active", "New", "New"), (5, "active", "merged", "T", "T")]


def test_rollback_restores_previous_state(table):
    canonicals = canon(table, ("a", "active", 1, 1, None), ("b", "active", 1, 1, None))
    log = table([(1, 0, 20, "a", "correct", "k1", None, "New"), (2, 0, 21, "b", "merge", "k2", "a", None)], DECISIONS)
    order = ["decision_key", "tie"]
    occurrences = table([(10, "a", 1, 10), (11, "b", 1, 11), (20, "a", 2, 20), (21, "b", 2, 21)], "occurrence_id long, canonical_id string, run_id long, trend_id long")
    after = P.fold_decisions(log, canonicals, order, on_occurrence=True).withColumn("last_run_id", F.lit(2).cast("bigint"))
    after = after.unionByName(canon(table, ("new", "active", 2, 2, None)))
    recorded = P.record_decisions(log, canonicals, order, on_occurrence=True)
    back = P.rollback_canonicals(2, after, occurrences, recorded, order)
    cols = ["canonical_id", "status", "title", "last_run_id"]
    assert rows_of(back, *cols) == rows_of(canonicals, *cols)
    assert back.where("merged_into_id IS NOT NULL").count() == 0


def test_merge_chains(table):
    links = [("a", "merged", "b"), ("b", "merged", "c"), ("c", "merged", "d"), ("d", "active", None), ("x", "merged", "y"), ("y", "merged", "x")]
    df = canon(table, *[(i, s, 1, 1, m) for i, s, m in links])
    assert rows_of(P.follow_merges(df, max_rounds=6), "canonical_id", "target") == [("a", "d"), ("b", "d"), ("c", "d")]


def test_deletable(table):
    runs = table([(1, "completed"), (2, "running"), (3, "completed"), (4, "completed")], "run_id long, status string")
    trends, occ = table([(1,), (3,)], "run_id long"), table([(3,)], "run_id long")
    got = rows_of(P.deletable(runs, trends, occ, table([(4,)], "source_run_id long")).na.fill("-"), "run_id", "deletable", "reason")
    assert got == [(1, False, "newer_run_exists"), (2, False, "running"), (3, True, "-"), (4, False, "baseline_source")]


def test_latest_occurrence_prefers_reviewed(table):
    occ = table([(1, "a", 1, 1, "approved"), (2, "a", 2, 2, "pending"), (3, "b", 2, 3, "pending")], "occurrence_id long, canonical_id string, run_id long, trend_id long, review_status string")
    assert rows_of(P.latest_occurrences(occ), "canonical_id", "occurrence_id", "occurrence_count") == [("a", 1, 2), ("b", 3, 1)]


def test_baseline_is_write_once(table, tmp_path):
    rows = table([("k", 1)], "snapshot_key string, trend_id long")
    P.write_baseline(rows, str(tmp_path / "b"))
    with pytest.raises(Exception, match="already exists"):
        P.write_baseline(rows, str(tmp_path / "b"))


def test_radar_layout(table):
    df = table([("a", 4, ["legal"], "act"), ("b", 8, ["legal"], "act"), ("c", 2, ["odd"], None)], "id string, size int, pestel array<string>, radar_stage string")
    got = {r["id"]: r for r in W.radar_layout(df).collect()}
    assert (got["c"]["sector"], got["c"]["ring"]) == (1, "watch")
    assert got["b"]["r"] == 18.0 and got["a"]["sector"] == 3
    centre = lambda r: ((r["x"] - 360) ** 2 + (r["y"] - 360) ** 2) ** 0.5 / 330
    assert 0.14 <= centre(got["a"]) < centre(got["b"]) <= 0.36


def test_list_runs_limit(table):
    with pytest.raises(ValueError):
        P.list_runs(table([(1,)], "run_id long"), table([(1,)], "run_id long"), 201)


def test_retention_keeps_portfolio_level_rows(table):
    tables = {
        "trends": table([(1, 10), (2, 20)], "run_id long, trend_id long"), "occurrences": table([(1, 100), (2, 200)], "run_id long, occurrence_id long"),
        "decisions": table([(1, 100), (2, 200), (3, None)], "decision_id long, occurrence_id long"),
    }
    kept = P.retain_runs(tables, table([(2,)], "run_id long"))
    assert sorted(r["decision_id"] for r in kept["decisions"].collect()) == [2, 3]


def test_decisions_on_foreign_occurrences_are_refused(table):
    """An occurrence must belong to the entry decided on; one that is not recorded counts as none."""
    canonicals = canon(table, ("a", "active", 1, 1, None), ("b", "active", 1, 1, None))
    occurrences = table([(10, "a"), (11, "b"), (12, None)], "occurrence_id long, canonical_id string")
    log = table([
        (1, 0, 10, "a", "correct", "k1", None, "Own"), (2, 0, 11, "a", "correct", "k2", None, "Foreign"), (3, 0, 12, "a", "correct", "k3", None, "Unlinked"),
        (4, 0, 99, "b", "correct", "k4", None, "Unknown"), (5, 0, None, "b", "restore", "k5", None, None), (6, 0, 10, "b", "correct", "k6", None, "Refused"), (7, 0, 11, "b", "correct", "k6", None, "Second"),
    ], DECISIONS)
    checked = P.checked_decisions(log, canonicals, occurrences)
    assert [r[0] for r in rows_of(checked.where("problem = 'foreign_occurrence'"), "decision_key")] == [2, 3, 6]
    order = ["decision_key", "tie"]
    assert rows_of(P.record_decisions(log, canonicals, order, occurrences=occurrences), "decision_key") == [(1,), (4,), (5,), (7,)]
    assert rows_of(P.fold_decisions(log, canonicals, order, occurrences=occurrences), "canonical_id", "title") == [("a", "Own"), ("b", "Second")]


def test_a_review_key_decides_once(table):
    """The first valid request of a key decides; on another occurrence it is a repeat and leaves that one pending."""
    canonicals = canon(table, ("a", "active", 1, 1, None))
    occurrences = table([(i, "a", 1, i, "pending") for i in (10, 11, 12)], "occurrence_id long, canonical_id string, run_id long, trend_id long, review_status string")
    log = table([
        (1, 0, 10, "a", "confirm", "k1", None, None), (2, 0, 11, "a", "confirm", "k1", None, None), (3, 0, 11, "a", "reject", "k2", None, None), (4, 0, 10, "a", "reject", "k3", None, None),
        (5, 0, 12, "a", "confirm", "k1", None, None), (6, 0, 12, "a", "restore", "k4", None, None), (7, 0, 12, "a", "confirm", "k4", None, None), (8, 0, 12, "a", "confirm", "k4", None, None),
    ], DECISIONS)
    got = P.review_outcomes(log, occurrences, canonicals, ["decision_key", "tie"])
    assert rows_of(got, "decision_key", "outcome") == [
        (1, "applied"), (2, "duplicate"), (3, "applied"), (4, "already_resolved"), (5, "duplicate"), (6, "invalid_action"), (7, "applied"), (8, "duplicate"),
    ]


def test_rollback_leaves_no_links_to_removed_entries(table):
    tables = {
        "runs": table([(1,), (2,)], "run_id long"), "trends": table([(1, 10), (2, 20)], "run_id long, trend_id long"),
        "occurrences": table([(1, 100, "old"), (1, 101, "new"), (2, 200, "new")], "run_id long, occurrence_id long, canonical_id string"),
        "decisions": table([(1, 100, "old"), (2, 101, "new"), (3, 200, "old"), (4, None, "old"), (5, None, "new")], "decision_id long, occurrence_id long, canonical_id string"),
        "canonicals": table([("old", 1), ("new", 2), ("seeded", None)], "canonical_id string, first_run_id long"),
    }
    left = P.without_run(tables, 2)
    assert [tuple(r) for r in left["occurrences"].orderBy("occurrence_id").collect()] == [(1, 100, "old"), (1, 101, None)]
    assert rows_of(left["decisions"], "decision_id") == [(1,), (4,)]
    assert rows_of(left["canonicals"], "canonical_id") == [("old",), ("seeded",)]


TEXTS = "language string, title string, summary string, rationale string"


def test_edits_reach_both_languages(table):
    rows = [
        ("applied", "correct", 1, 10, 100, "New", None, "de"), ("applied", "confirm", 2, 20, 101, "ignored", None, "en"),
        ("applied", "correct", 3, 30, 102, None, "Long", "en"), ("applied", "correct", 3, 30, 90, "older", None, "en"), ("refused", "correct", 4, 40, 103, "x", None, "en"),
    ]
    outcomes = table(rows, "outcome string, action string, decided_id long, o_trend_id long, decision_key long, new_title string, new_summary string, edit_language string")
    texts = table([(t, lang, f"T{t}{lang}", f"S{t}{lang}", f"R{t}{lang}") for t in (10, 20, 30, 40) for lang in ("de", "en")], "trend_id long, " + TEXTS)
    before = table([(c, lang, f"old{c}", "s", None) for c in (1, 4) for lang in ("de", "en")], "canonical_id long, " + TEXTS)
    supplied = table([(102, "Titel", "Lang", None), (90, "wrong", "wrong", "wrong")], "decision_key long, title string, summary string, rationale string")
    got = {(r[0], r[1]): tuple(r[2:]) for r in P.sync_translations(outcomes, before, texts, supplied).collect()}
    assert got == {
        (1, "de"): ("New", "S10de", "R10de"), (1, "en"): ("New", "S10de", "R10de"), (2, "de"): ("T20de", "S20de", "R20de"), (2, "en"): ("T20en", "S20en", "R20en"),
        (3, "en"): ("T30en", "Long", "R30en"), (3, "de"): ("Titel", "Lang", "R30en"), (4, "de"): ("old4", "s", None), (4, "en"): ("old4", "s", None),
    }


def test_supplied_translations_belong_to_one_decision(table):
    """Two decisions of one key: the newer one counts, with its own translation or none."""
    rows = [("applied", "correct", 1, 10, 100, 2, "Roof"), ("applied", "correct", 2, 20, 101, 1, "Glass"), ("applied", "correct", 2, 20, 101, 3, "Wall")]
    outcomes = table(rows, "outcome string, action string, decided_id long, o_trend_id long, decision_key long, tie long, new_title string")
    texts = table([(t, lang, f"T{t}{lang}", "s", None) for t in (10, 20) for lang in ("de", "en")], "trend_id long, " + TEXTS)
    supplied = table([(100, 1, "Glas", None, None), (101, 1, "Glas", None, None), (101, 3, "Wand", None, None)], "decision_key long, tie long, title string, summary string, rationale string")
    before = table([(9, "en", "old", "s", None)], "canonical_id long, " + TEXTS)
    got = P.sync_translations(outcomes, before, texts, supplied, order=("decision_key", "tie"))
    assert rows_of(got.where("canonical_id < 9"), "canonical_id", "language", "title") == [(1, "de", "Roof"), (1, "en", "Roof"), (2, "de", "Wand"), (2, "en", "Wall")]


def test_silent_updates_bring_their_texts(table):
    occurrences = table([(1, 5, 10, []), (1, 6, 11, []), (2, 6, 12, ["moved"]), (None, 6, 13, [])], "canonical_id long, run_id long, trend_id long, review_reasons array<string>")
    texts = table([(t, "en", f"T{t}", "s", None) for t in (10, 11, 12, 13)], "trend_id long, " + TEXTS)
    before = table([(c, "en", f"old{c}", "s", None) for c in (1, 2)], "canonical_id long, " + TEXTS)
    assert rows_of(M.auto_apply_texts(before, occurrences, texts), "canonical_id", "title") == [(1, "T11"), (2, "old2")]


def test_topics_without_documents_are_judged_by_evidence(table):
    trends = table([(1, 1), (2, 2), (3, 3)], "trend_id long, topic_id long")
    members = table([(1, 7, "own", date(2024, 1, 1), False, 0), (1, 8, "newer", date(2025, 1, 1), False, 0), (2, 9, "outlier", None, True, 0)], "topic_id long, doc_id long, title string, published_at date, is_outlier boolean, tie int")
    evidence = table([(1, 1, "unused"), (2, 2, "second"), (2, 1, "first"), (2, 3, "")], "trend_id long, ord int, title string")
    got = {r[0]: tuple(r[1:]) for r in G.representative_titles(trends, members, evidence).collect()}
    assert got == {1: (["newer", "own"], False), 2: (["first", "second"], True), 3: ([], False)}


def test_rows_without_a_key_spread_over_the_tasks(table):
    big = table([(i, f"t{i}" if i % 10 == 0 else None) for i in range(400)], "id long, target string")
    small = table([("t10", True), ("t11", True), (None, True)], "target string, known boolean")
    got = join_spreading_nulls(big.repartition(3), small.hint("merge"), "target", "id").withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert sorted(r["id"] for r in rows) == list(range(400)) and [r["id"] for r in rows if r["known"]] == [10]
    spark = big.sparkSession
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({r["task"] for r in got.where("target IS NULL").collect()}) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_distinct_evidence_is_not_numbered_and_joins_in_groups(spark, table):
    got = queries.h43(Model(spark, "/root/testdata/sf0.001"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression [trend_id") == 2
    big, small = table([(i % 40, i) for i in range(400)], "trend_id long, n long"), table([(i, -i) for i in range(0, 60, 2)], "trend_id long, m long")
    joined = join_in_groups(big, small, "trend_id", rows=20)
    assert joined.rdd.getNumPartitions() == 20
    assert rows_of(joined, "trend_id", "n", "m") == sorted((i % 40, i, -(i % 40)) for i in range(400) if i % 2 == 0)
