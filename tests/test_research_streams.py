import random
from types import SimpleNamespace

from conftest import rows_of
from pyspark.sql import functions as F

from trendloom.catalog import research_queries
from trendloom.operators import dedup as D
from trendloom.operators import evaluate as I  # noqa: E741
from trendloom.operators import research as J
from trendloom.streaming import streams as K

DOCS = "doc_id long, title string, text string, source_name string, external_id string, url string"


def test_overlap(table):
    trends = table([(1, 1, "Circular economy materials", ["reuse"]), (1, 2, "Drone inspection", ["uav"])], "run_id long, trend_id long, title string, keywords array<string>")
    refs = table([(10, "Circular materials economy", []), (11, "Timber skyscraper", [])], "reference_id long, title string, keywords array<string>")
    trends, refs = I.with_tokens(trends), I.with_tokens(refs)
    matches = I.best_matches(I.similar_pairs(trends, refs))
    assert rows_of(matches, "reference_id", "trend_id", "score") == [(10, 1, 0.75)]
    runs = table([(1,), (2,)], "run_id long")
    assert rows_of(I.overlap_metrics(runs, trends, refs, matches), "run_id", "recall", "precision") == [(1, 0.5, 0.5), (2, 0.0, 0.0)]
    assert rows_of(I.missed_references(runs.where("run_id = 1"), refs, matches), "reference_id") == [(11,)]
    assert rows_of(I.novel_trends(trends, matches), "trend_id") == [(2,)]


def test_similar_pairs_equal_brute_force(table):
    rnd = random.Random(4)
    some = lambda: sorted({"hot", *rnd.sample([f"w{i}" for i in range(14)], rnd.randrange(0, 6))}) if rnd.random() < 0.9 else []
    trends, refs = [(i % 3, i, some()) for i in range(150)], [(i, some()) for i in range(25)]
    got = I.similar_pairs(table(trends, "run_id long, trend_id long, tokens array<string>"), table(refs, "reference_id long, tokens array<string>"), 0.6)
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
    assert rows_of(got, "run_id", "trend_id", "reference_id") == sorted((r, t, k) for r, t, a in trends for k, b in refs if like(a, b) >= 0.6)


def test_low_thresholds_equal_brute_force_and_no_set_is_joined_back(table, monkeypatch):
    rnd, names, plain = random.Random(9), [], I.written
    monkeypatch.setattr(I, "written", lambda df, name: names.append(name) or plain(df, name))
    some = lambda words, most: sorted(rnd.sample([f"w{i}" for i in range(words)], rnd.randrange(0, most)))
    trends, refs = [(i % 3, i, some(40, 25)) for i in range(120)], [(i, some(25, 14)) for i in range(20)]  # w25 to w39 are in no reference
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
    for threshold in (0.18, 0.25, 0.5):
        got = I.similar_pairs(table(trends, "run_id long, trend_id long, tokens array<string>"), table(refs, "reference_id long, tokens array<string>"), threshold)
        wanted = sorted((r, t, k, like(a, b)) for r, t, a in trends for k, b in refs if like(a, b) >= threshold)
        assert wanted and rows_of(got, "run_id", "trend_id", "reference_id", "score") == wanted
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "least" in plan and not any("trend_id" in line for line in plan.splitlines() if "Join Inner" in line)
    assert "trends" not in names


def test_gate(table):
    docs = table([(1, "Facade panels", "glass"), (2, "Cooking pasta", "kitchen"), (3, "Facade cooking", "kitchen recipes")], "doc_id long, title string, text string")
    assert rows_of(J.relevant(docs, ["facade design"], ["cooking kitchen"]), "doc_id") == [(1,)]
    assert J.relevant(docs, []).count() == 3
    assert J.choose_gate("off", ["x"]) == "keyword" and J.choose_gate("off", []) == "off"


def test_expansion(table):
    titles = table([("Vacuum glazing for facades",), ("New vacuum glazing",), ("vacuum glazing again",), ("timber timber",)], "title string")
    assert rows_of(J.expand_queries(titles, []), "query", "n") == [("vacuum glazing", 3)]
    assert J.expand_queries(titles, ["vacuum glazing"]).count() == 0


def test_plan(table):
    df = table([("facades", "dach", ["bipv", " facades Germany Austria Switzerland DACH", ""], False), ("x", "global", [], True)], "q string, r string, k array<string>, h boolean")
    got = [r[0] for r in df.select(J.planned_queries(F.col("q"), F.col("r"), F.col("k"), F.col("h"))).collect()]
    assert got[0] == ["facades Germany Austria Switzerland DACH", "bipv"]
    assert len(got[1]) == 7 and got[1][0] == "x"


def test_merge_seeds(table):
    df = table([(0, 0, " A "), (0, 1, ""), (1, 0, "a"), (1, 1, "b")], "grp int, ord int, term string")
    assert [r["term"] for r in J.merge_seeds(df).collect()] == ["A", "b"]
    assert J.merge_seeds(df, limit=1).count() == 1


def test_verdicts(table):
    docs = table([(0, 1), (0, 2), (1, 3)], "batch_id long, doc_id long")
    assert rows_of(J.keep_by_verdict(docs, table([(0, 2)], "batch_id long, doc_id long")), "doc_id") == [(2,), (3,)]


def test_snowball_expands_and_respects_budget(table):
    rows = [(i, f"solar facade vacuum glazing {i}", "text", "s1", f"e{i}", None) for i in range(12)]
    rows += [(100 + i, f"vacuum glazing panel {i}", "none", "s2", f"f{i}", None) for i in range(5)]
    docs = table(rows, DOCS)
    sample, report, used = J.snowball(docs, ["solar"], "standard")
    assert used[0] == "solar" and "vacuum glazing" in used
    got = rows_of(sample, "doc_id", "round")
    assert len(got) == 17 and {r for _, r in got} == {1, 2}
    assert ("solar", "s2", 0, 1) in rows_of(report, "query", "source_name", "findings", "round")
    small, _, _ = J.snowball(docs, ["solar", "SOLAR"], "quick")
    assert small.count() == 10


EVENTS = "event_id long, run_id long, phase string, progress int, message string, code string"


def write_parts(df, path, parts):
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(path)


def test_tables_stream_from_one_file_and_from_a_folder_of_files(spark, table, tmp_path):
    docs = table([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    write_parts(docs, str(tmp_path / "many.parquet"), ["doc_id < 7", "doc_id >= 7"])
    single = next((tmp_path / "many.parquet").glob("part-*.parquet"))
    single.rename(tmp_path / "one.parquet")
    for name in ("many", "one"):
        stream = K.log_stream(spark, str(tmp_path), f"{name}.parquet")
        K.drain_append(stream, str(tmp_path / f"out-{name}"))
    kept = [set(r[0] for r in spark.read.parquet(str(tmp_path / f"out-{name}/data")).collect()) for name in ("many", "one")]
    assert all(kept) and kept[0] | kept[1] == set(range(20)) and not kept[0] & kept[1]


def test_streamed_progress_equals_batch(spark, table, tmp_path):
    rows = [(i, i % 4, ["ingest", "embed", "match"][i % 3], i * 9 - 20, f"m{i}", "source_searched" if i % 5 == 0 else None) for i in range(30)]
    events = table(rows, EVENTS)
    path = str(tmp_path / "events")
    write_parts(events, path, ["event_id < 11", "event_id >= 11"])
    K.drain_updates(K.latest_progress(K.log_stream(spark, str(tmp_path), "events", 1)), str(tmp_path / "o1"))
    cols = ["run_id", "phase", "progress", "message"]
    assert rows_of(K.current_state(spark, str(tmp_path / "o1"), ["run_id"]), *cols) == rows_of(K.latest_progress(events), *cols)
    K.drain_updates(K.first_per_phase(K.feed_lines(K.log_stream(spark, str(tmp_path), "events", 1))[1]), str(tmp_path / "o2"))
    batch = K.activity_feed(events).where("shown = 'once'")
    assert rows_of(K.current_state(spark, str(tmp_path / "o2"), ["run_id", "phase"]), "run_id", "phase", "event_id") == rows_of(batch, "run_id", "phase", "event_id")
    K.drain_append(K.clamped_progress(K.log_stream(spark, str(tmp_path), "events")), str(tmp_path / "o3"))
    assert rows_of(spark.read.parquet(str(tmp_path / "o3" / "data")).agg(F.min("progress").alias("a"), F.max("progress").alias("b")), "a", "b") == [(0, 100)]


def test_run_progress_defaults(table):
    runs = table([(1, "running"), (2, "failed")], "run_id long, status string")
    latest = table([], "run_id long, event_id long, phase string, progress int, message string")
    assert rows_of(K.run_progress(runs, latest), "run_id", "phase", "progress") == [(1, "running", 0), (2, "failed", 100)]


def test_streamed_ingest_equals_batch(spark, table, tmp_path):
    schema = "seq long, external_id string, title string, text string, url string, source_name string, source_type string"
    rows = [(i, f"e{i % 17}" if i % 2 else None, f"t{i % 13}", f"x{i % 29}", f"http://h/{i % 23}" if i % 3 else None, "s", "t") for i in range(90)]
    docs = table(rows, schema)
    path = str(tmp_path / "docs")
    write_parts(docs, path, ["seq < 30", "seq >= 30 AND seq < 60", "seq >= 60"])
    for _ in range(2):
        K.ingest_documents(K.log_stream(spark, str(tmp_path), "docs", 1), str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store" / "data"))
    assert stored.select("batch").distinct().count() >= 2
    assert rows_of(stored, "seq") == rows_of(D.exact_dedupe(D.with_identity(docs)), "seq")


def test_streamed_decisions_and_embeddings(spark, table, tmp_path):
    log = table([(i, f"k{i % 4}") for i in range(12)], "decision_key long, idempotency_key string")
    write_parts(log, str(tmp_path / "log"), ["decision_key < 2", "decision_key >= 2"])
    K.log_decisions(K.log_stream(spark, str(tmp_path), "log", 1), str(tmp_path / "d"), ["decision_key"])
    assert rows_of(K.decision_store(spark, str(tmp_path / "d"), log.schema).content(), "decision_key") == [(0,), (1,), (2,), (3,)]
    docs = table([(i, "t", f"x{i % 3}", f"h{i % 3}") for i in range(9)], "doc_id long, title string, text string, content_hash string")
    write_parts(docs, str(tmp_path / "docs"), ["doc_id < 2", "doc_id >= 2"])
    K.embed_incoming(K.log_stream(spark, str(tmp_path), "docs", 1), str(tmp_path / "e"), lambda t: F.array(F.lit(1.0).cast("float")), "m")
    assert rows_of(K.embedding_cache(spark, str(tmp_path / "e")).content(), "content_hash") == [("h0",), ("h1",), ("h2",)]


def test_documents_count_however_late(spark, table, tmp_path):
    days = ["2024-01-05", "2024-03-01", "2024-02-20", "2023-06-01"]
    rows = [(1, 0, d, i) for i, d in enumerate(days)]
    df = table(rows, "run_id long, topic_index int, d string, i int").withColumn("published_at", F.to_timestamp("d")).drop("d")
    write_parts(df, str(tmp_path / "m"), ["i < 2", "i = 2", "i = 3"])
    K.drain_updates(K.daily_counts(K.log_stream(spark, str(tmp_path), "m", 1)), str(tmp_path / "o"))
    got = rows_of(K.quarters_of_days(K.current_state(spark, str(tmp_path / "o"), ["run_id", "topic_index", "day"])), "period", "doc_count")
    assert got == [("2023-Q2", 1), ("2024-Q1", 3)]


def test_missed_and_novel_match_once(spark, table):
    docs = table([(1, "Circular economy materials\nDrone inspection"), (2, "Timber skyscraper")], "doc_id long, text string")
    refs = table([(10, "Circular materials economy"), (11, "Green roof")], "reference_id long, title string")
    got = research_queries.i4(SimpleNamespace(spark=spark, documents=docs, references=refs))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # nothing of the matching is left in the plan
    want = [(1, "missed", 11), (1, "novel", 100002), (2, "missed", 10), (2, "missed", 11), (2, "novel", 200001)]
    assert rows_of(got, "run_id", "kind", "id") == want


def test_decisions_are_written_once_before_the_log(spark, table, tmp_path, monkeypatch):
    names, plain = [], K.written
    monkeypatch.setattr(K, "written", lambda df, name: names.append(name) or plain(df, name))
    log = table([(i, f"k{i % 4}" if i % 5 else None) for i in range(12)], "decision_key long, idempotency_key string")
    write_parts(log, str(tmp_path / "log"), ["decision_key < 4", "decision_key >= 4 AND decision_key < 9", "decision_key >= 9"])
    K.log_decisions(K.log_stream(spark, str(tmp_path), "log", 1), str(tmp_path / "d"), ["decision_key"])
    assert set(names) == {"first"} and len(names) == 3
    assert rows_of(K.decision_store(spark, str(tmp_path / "d"), log.schema).content().where("idempotency_key IS NOT NULL"), "decision_key") == [(1,), (2,), (3,), (4,)]
