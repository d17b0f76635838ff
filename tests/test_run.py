from datetime import date, datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from trendloom.operators import portfolio as P
from trendloom.plans.run import empty_state, execute_run, load_state, save_state
from trendloom.plans.stages import EMBEDDERS, RunOptions, pick, pick_embedder

SCHEMA = "seq long, external_id string, title string, text string, url string, published_at timestamp, language string, region string, country string, source_name string, source_type string"


def raw(spark, start, texts):
    rows = [
        (start + i, f"e{start + i}", t.title(), t, None, datetime(2022 + i % 3, 1 + 3 * (i % 4), 1), "en", "Europe", "DE", "S", "science")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = [f"vacuum insulation panel thermal envelope sample {w}" for w in ("one", "two", "three", "four")] + [
    f"digital twin building software data model {w}" for w in ("five", "six", "seven", "eight")
]


def test_two_runs_build_history(spark, tmp_path):
    options = RunOptions(restarts=2)
    first = execute_run(raw(spark, 0, TEXTS), empty_state(spark), 1, date(2024, 1, 1), options)
    assert rows_of(first["runs"], "run_id", "status", "n_documents", "n_topics") == [(1, "completed", 8, 1)]
    assert first["cache"].count() == 8 and first["run_documents"].where("provenance = 'new'").count() == 8
    assert rows_of(first["occurrences"], "change_type", "review_status", "review_reason") == [("new", "pending", "new_trend")]
    assert first["trends"].where("emergence IS NOT NULL").count() == 0
    assert first["translations"].count() == 2

    # Approve the new trend, then run again with one new document and repeats of the old ones.
    review = spark.createDataFrame(
        [(1, 0, r["occurrence_id"], "create", "k1", None) for r in first["occurrences"].collect()],
        "decision_key long, tie long, occurrence_id long, action string, idempotency_key string, target_id string",
    ).withColumn("canonical_id", F.lit(None).cast("string"))
    order = ["decision_key", "tie"]
    from trendloom.operators.match import with_proposed

    outcomes = P.review_outcomes(review, first["occurrences"], first["canonicals"], order)
    entries = P.apply_reviews(outcomes, first["canonicals"], with_proposed(first["trends"], first["assessments"]), order)
    assert rows_of(entries, "status", "first_run_id", "last_run_id") == [("active", 1, 1)]
    state = dict(first)
    state["canonicals"] = entries.withColumns({"position": F.lit(None).cast("double"), "updated_at": F.lit(date(2024, 1, 1))}).select(*first["canonicals"].columns).checkpoint()
    moved = outcomes.select("occurrence_id", F.col("new_canonical_id").alias("nc"), F.col("new_review_status").alias("ns"))
    state["occurrences"] = first["occurrences"].join(moved, "occurrence_id", "left").withColumns(
        {"canonical_id": F.coalesce("nc", "canonical_id"), "review_status": F.coalesce("ns", "review_status")}
    ).select(*first["occurrences"].columns).checkpoint()

    again = raw(spark, 100, [*TEXTS, "vacuum insulation panel thermal envelope sample nine"]).withColumn("external_id", F.concat(F.lit("n"), "seq"))
    second = execute_run(again, state, 2, date(2024, 2, 1), options)
    assert rows_of(second["runs"].where("run_id = 2"), "n_documents") == [(9,)]
    got = rows_of(second["run_documents"].where("run_id = 2").groupBy("provenance").count(), "provenance", "count")
    assert got == [("carried_forward", 8), ("new", 1)] and second["cache"].count() == 9
    link = second["occurrences"].where("run_id = 2").collect()
    assert len(link) == 1 and link[0]["canonical_id"] is not None and link[0]["evidence_added"] == 1
    assert second["trends"].where("run_id = 2").first()["emergence"] < 0.1
    assert second["documents"].where("near_duplicate_of_id IS NOT NULL").count() > 0
    assert P.run_diff(second["occurrences"], with_proposed(second["trends"], second["assessments"])).count() == 2

    # The state is written and read back, and serves the views.
    path = str(tmp_path / "state")
    assert load_state(spark, path)["runs"].count() == 0
    save_state(second, path)
    kept = load_state(spark, path)
    assert {name: df.count() for name, df in kept.items()} == {name: second[name].count() for name in kept}
    listed = P.portfolio(kept["canonicals"], kept["occurrences"], kept["trends"])
    assert rows_of(listed, "status", "region", "country") == [("active", "Europe", "DE")]
    detail = P.trend_detail(P.run_trends(kept["trends"], kept["assessments"], kept["translations"], "de", run_id=2), kept["timepoints"], kept["evidence"]).first()
    assert detail["region"] == "Europe" and 0 < len(detail["evidence"]) == len({e["ord"] for e in detail["evidence"]}) and detail["timeseries"]
    queue = P.review_queue(kept["occurrences"], kept["trends"], kept["canonicals"], kept["translations"]).collect()
    assert all(q["review_reasons"][0]["code"] == q["review_reason"] for q in queue)
    assert rows_of(P.list_runs(kept["runs"], kept["occurrences"]), "run_id") == [(1,), (2,)]
    decisions = spark.createDataFrame([], "canonical_id string, decision_key long, action string")
    history = P.trend_history(kept["occurrences"], with_proposed(kept["trends"], kept["assessments"]), kept["evidence"], decisions)
    assert rows_of(history.where("kind = 'point'"), "run_id") == [(1,), (2,)]


def test_stage_registry():
    with pytest.raises(ValueError):
        pick("embedder", "nope")
    EMBEDDERS["broken"] = lambda: 1 / 0
    try:
        assert pick_embedder("broken")[0] == "hashing"
    finally:
        del EMBEDDERS["broken"]
