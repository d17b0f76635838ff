"""Registered queries I1-I5, J1-J10 and K1-K9."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trendloom.catalog.documents_queries import HASH_SQL
from trendloom.catalog.model import Catalog, spark_sql
from trendloom.constants import EXPANSION_STOP, OVERLAP_STOP, PESTEL_LENSES, REGION_CONTEXT
from trendloom.functions.python_hooks import batch_embedder
from trendloom.functions.tables import written
from trendloom.operators import evaluate as I  # noqa: E741
from trendloom.operators import research as J
from trendloom.operators import vectors as V
from trendloom.session import scratch_dir
from trendloom.streaming import streams as K

catalog = Catalog()


def no_keywords():
    return F.array().cast("array<string>").alias("keywords")


# ---------------------------------------------------------------- evaluation

OVERLAP_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in OVERLAP_STOP) + ")"


def overlap_sql(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]{{3,}}')), lambda t: t NOT IN {OVERLAP_STOP_SQL})"


# Passages of the reference list sit in documents: every line of a document is a candidate title.
TRENDS_SQL = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS title, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {{documents}}),
    tr AS (SELECT doc_id % 4 AS run_id, doc_id * 100000 + no AS trend_id, title, {overlap_sql('title')} AS toks FROM lines WHERE trim(title) <> ''),
    rf AS (SELECT reference_id, title, {overlap_sql('title')} AS toks FROM {{references}})"""
SIMILAR_SQL = f"""{TRENDS_SQL}, tt AS (SELECT run_id, trend_id, len(toks) AS n, unnest(toks) AS t FROM tr), rt AS (SELECT reference_id, len(toks) AS n, unnest(toks) AS t FROM rf),
    sp AS (SELECT run_id, trend_id, reference_id, CAST(count(*) AS DOUBLE) / (any_value(tt.n) + any_value(rt.n) - count(*)) AS score FROM tt JOIN rt ON rt.t = tt.t GROUP BY ALL),
    bm AS (SELECT run_id, reference_id, arg_max(trend_id, (score, -trend_id)) AS trend_id, max(score) AS score FROM sp WHERE score >= 0.18 GROUP BY 1, 2)"""


def overlap_inputs(m):
    lines = m.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "title")).where(F.trim("title") != "")
    trends = lines.select(
        (F.col("doc_id") % 4).alias("run_id"), (F.col("doc_id") * 100000 + F.col("no") + 1).alias("trend_id"), "title", no_keywords()
    )
    references = m.references.withColumn("keywords", no_keywords())
    return I.with_tokens(trends), I.with_tokens(references)


def overlap_runs(m):
    return m.documents.select((F.col("doc_id") % 4).alias("run_id")).distinct()


def overlap_matches(m):
    return I.best_matches(I.similar_pairs(*overlap_inputs(m)))


@catalog.add("i1_overlap_tokens", f"SELECT doc_id, array_to_string(list_sort({overlap_sql('text')}), ' ') AS tokens FROM {{documents}}")
def i1(m):
    rows = I.with_tokens(m.documents.select("doc_id", F.col("text").alias("title"), no_keywords()))
    return rows.select("doc_id", F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


@catalog.add("i2_reference_matches", f"WITH {SIMILAR_SQL} SELECT run_id, reference_id, trend_id, round_even(score, 3) AS score FROM bm")
def i2(m):
    return overlap_matches(m)


METRICS_SQL = f"""{SIMILAR_SQL}, rn AS (SELECT DISTINCT doc_id % 4 AS run_id FROM {{documents}})
    SELECT rn.run_id, (SELECT count(*) FROM rf) AS n_references, (SELECT count(*) FROM tr WHERE tr.run_id = rn.run_id) AS n_trends, count(DISTINCT reference_id) AS n_matched,
        round(CAST(count(DISTINCT reference_id) AS DOUBLE) / (SELECT count(*) FROM rf), 6) AS recall, round(CAST(count(DISTINCT trend_id) AS DOUBLE) / (SELECT count(*) FROM tr WHERE tr.run_id = rn.run_id), 6) AS precision
    FROM rn LEFT JOIN bm ON bm.run_id = rn.run_id GROUP BY 1"""


@catalog.add("i3_recall_precision", f"WITH {METRICS_SQL}")
def i3(m):
    trends, references = overlap_inputs(m)
    rows = I.overlap_metrics(overlap_runs(m), trends, references, I.best_matches(I.similar_pairs(trends, references)))
    return rows.withColumns({c: F.round(c, 6) for c in ("recall", "precision")})


@catalog.add(
    "i4_missed_and_novel",
    f"""WITH {SIMILAR_SQL}, rn AS (SELECT DISTINCT doc_id % 4 AS run_id FROM {{documents}})
        SELECT rn.run_id, 'missed' AS kind, reference_id AS id, title FROM rn CROSS JOIN rf WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.run_id = rn.run_id AND bm.reference_id = rf.reference_id)
        UNION ALL SELECT run_id, 'novel', trend_id, title FROM tr WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.run_id = tr.run_id AND bm.trend_id = tr.trend_id)""",
)
def i4(m):
    trends, references = overlap_inputs(m)
    matches = written(I.best_matches(I.similar_pairs(trends, references)), "matches")  # read twice
    missed = I.missed_references(overlap_runs(m), references, matches).select("run_id", F.lit("missed").alias("kind"), F.col("reference_id").alias("id"), "title")
    novel = I.novel_trends(trends, matches).select("run_id", F.lit("novel").alias("kind"), F.col("trend_id").alias("id"), "title")
    return missed.unionByName(novel)


@catalog.add(
    "i5_evaluation_view",
    f"WITH {SIMILAR_SQL} SELECT bm.run_id, bm.reference_id, rf.title AS reference_title, bm.trend_id, tr.title AS trend_title, round_even(score, 3) AS score FROM bm JOIN rf ON rf.reference_id = bm.reference_id JOIN tr ON tr.trend_id = bm.trend_id",
)
def i5(m):
    trends, references = overlap_inputs(m)
    rows = I.best_matches(I.similar_pairs(trends, references))
    rows = rows.join(references.select("reference_id", F.col("title").alias("reference_title")), "reference_id")
    return rows.join(trends.select("run_id", "trend_id", F.col("title").alias("trend_title")), ["run_id", "trend_id"]).select(
        "run_id", "reference_id", "reference_title", "trend_id", "trend_title", "score"
    )


# ---------------------------------------------------------------- research


@catalog.add(
    "j1_merged_seeds",
    """WITH t AS (SELECT 0 AS grp, canonical_id AS ord, ' ' || title || ' ' AS term FROM {canonicals} UNION ALL SELECT 1, CAST(trend_id AS STRING), upper(title) FROM {trends} UNION ALL SELECT 1, '', '  ' FROM {trends}),
        f AS (SELECT lower(trim(term)) AS k, arg_min(trim(term), (grp, ord)) AS term, min((grp, ord)) AS o FROM t WHERE trim(term) <> '' GROUP BY 1)
        SELECT term, o[1] AS grp, o[2] AS ord FROM f ORDER BY o LIMIT 12""",
)
def j1(m):
    own = m.canonicals.select(F.lit(0).alias("grp"), F.col("canonical_id").alias("ord"), F.concat(F.lit(" "), "title", F.lit(" ")).alias("term"))
    more = m.trends.select(F.lit(1).alias("grp"), F.col("trend_id").cast("string").alias("ord"), F.upper("title").alias("term"))
    blank = m.trends.select(F.lit(1).alias("grp"), F.lit("").alias("ord"), F.lit("  ").alias("term"))
    return J.merge_seeds(own.unionByName(more).unionByName(blank))


REGION_SQL = "CASE " + " ".join(f"WHEN run_id % 6 = {i} THEN '{c}'" for i, c in enumerate(REGION_CONTEXT.values())) + " END"


@catalog.add(
    "j2_query_plan",
    f"""WITH q AS (SELECT trend_id, trim(title || ' ' || {REGION_SQL}) AS f, string_split(keywords, ',') AS kw, size % 2 = 0 AS h FROM {{trends}})
        SELECT trend_id, array_to_string(list_concat([f], list_filter([x for x in kw if x <> f], lambda x: true), CASE WHEN h THEN [{', '.join(f"f || ' {lens}'" for lens in PESTEL_LENSES)}] ELSE [] END), '|') AS plan
        FROM (SELECT trend_id, f, h, list_transform(list_sort(list_transform(list_distinct(kw), lambda x: list_position(kw, x))), lambda i: kw[i]) AS kw FROM q)""",
)
def j2(m):
    region = F.element_at(F.array(*[F.lit(r) for r in REGION_CONTEXT]), (F.col("run_id") % 6 + 1).cast("int"))
    plan = J.planned_queries(F.col("title"), region, F.split("keywords", ","), F.col("size") % 2 == 0)
    return m.trends.select("trend_id", F.array_join(plan, "|").alias("plan"))


def split_keywords(m):
    return m.trends.withColumn("keywords", F.split("keywords", ","))


FB_ORDER = ["feedback_key", "tie"]
FIRST_SQL = "f AS (SELECT arg_min(trim(term), o) AS term, min(o) AS o FROM t WHERE trim(term) <> '' GROUP BY lower(trim(term)))"


@catalog.add(
    "j3_feedback_seeds",
    f"""WITH u AS (SELECT fb.*, t.title, string_split(keywords, ',') AS kw FROM {{feedback}} fb JOIN {{trends}} t ON t.trend_id = fb.trend_id WHERE action IN ('confirm', 'correct')),
        t AS (SELECT CASE WHEN action = 'correct' AND field = 'title' THEN new_value ELSE title END AS term, (feedback_key, tie, -1) AS o FROM u
            UNION ALL SELECT unnest(kw[1:3]), (feedback_key, tie, unnest([0, 1, 2])) FROM u), {FIRST_SQL} SELECT term FROM f ORDER BY o LIMIT 20""",
)
def j3(m):
    return J.seeds_from_feedback(m.feedback, split_keywords(m), FB_ORDER).select("term")


@catalog.add("j4_portfolio_seeds", "SELECT canonical_id, trim(title) AS term FROM {canonicals} WHERE status = 'active' ORDER BY updated_at DESC, canonical_id LIMIT 12")
def j4(m):
    return J.seeds_from_portfolio(m.canonicals)


@catalog.add(
    "j5_negative_terms",
    f"""WITH lt AS (SELECT canonical_id, arg_max(trend_id, (run_id, occurrence_id)) AS trend_id FROM {{occurrences}} WHERE canonical_id IS NOT NULL GROUP BY 1),
        t AS (SELECT unnest(string_split(keywords, ',')[1:5]) AS term, (0, feedback_key, tie, '', unnest([0, 1, 2, 3])) AS o FROM {{feedback}} fb JOIN {{trends}} t ON t.trend_id = fb.trend_id WHERE action = 'reject'
            UNION ALL SELECT unnest(string_split(keywords, ',')[1:5]), (1, 0, 0, c.canonical_id, unnest([0, 1, 2, 3])) FROM {{canonicals}} c JOIN lt ON lt.canonical_id = c.canonical_id JOIN {{trends}} t ON t.trend_id = lt.trend_id WHERE c.status = 'rejected'),
        {FIRST_SQL} SELECT term FROM f ORDER BY o LIMIT 20""",
)
def j5(m):
    return J.negative_terms(m.feedback, split_keywords(m), m.canonicals, m.occurrences, FB_ORDER).select("term")


INCLUDE, EXCLUDE = ["that with", "dans pour nicht"], ["they have", "avec sont"]
GATE_SQL = "list_distinct(regexp_extract_all(lower(title || ' ' || text), '[a-z]{4,}'))"


@catalog.add(
    "j6_relevance_gate",
    f"""WITH g AS (SELECT doc_id, {GATE_SQL} AS t FROM {{docs}}) SELECT doc_id FROM g WHERE len(list_intersect(t, ['they', 'have', 'avec', 'sont'])) < 2
        AND len(list_intersect(t, ['that', 'with', 'dans', 'pour', 'nicht'])) > 0""",
)
def j6(m):
    return J.relevant(m.docs, INCLUDE, EXCLUDE).select("doc_id")


@catalog.add(
    "j7_verdict_gate",
    """WITH b AS (SELECT doc_id, CAST(floor(doc_id / 20e0) AS BIGINT) AS batch_id FROM {docs}), v AS (SELECT CAST(floor(doc_id / 20e0) AS BIGINT) AS batch_id, doc_id FROM {labels} WHERE quality = 1)
        SELECT batch_id, doc_id FROM b WHERE batch_id NOT IN (SELECT batch_id FROM v) OR doc_id IN (SELECT doc_id FROM v)""",
)
def j7(m):
    batch = F.floor(F.col("doc_id") / 20)
    docs = m.docs.select("doc_id", batch.alias("batch_id"))
    return J.keep_by_verdict(docs, m.labels.where("quality = 1").select("doc_id", batch.alias("batch_id"))).select("batch_id", "doc_id")


EXPANSION_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in EXPANSION_STOP) + ")"


@catalog.add(
    "j8_expanded_queries",
    f"""WITH w AS (SELECT list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z-]{{3,}}'), lambda x: lower(x)), lambda x: x NOT IN {EXPANSION_STOP_SQL}) AS ws FROM {{documents}}),
        p AS (SELECT unnest(list_zip(ws[:-2], ws[2:])) AS z FROM w WHERE len(ws) > 1)
        SELECT z[1] || ' ' || z[2] AS query, count(*) AS n FROM p WHERE z[1] <> z[2] AND NOT (z[1] IN ('nicht', 'dans', 'pour') AND z[2] IN ('nicht', 'dans', 'pour')) GROUP BY z[1], z[2] HAVING count(*) >= 2
        ORDER BY n DESC, z[1], z[2] LIMIT 40""",
)
def j8(m):
    return J.expand_queries(m.documents.select(F.col("text").alias("title")), ["Nicht dans", "pour la"], 40)


ROUND = ["that with they", "dans pour avec", "nicht oder"]


@catalog.add(
    "j9_search_round",
    f"""WITH g AS (SELECT doc_id, source_name, {GATE_SQL} AS t FROM {{docs}}), q(query_no, query, w) AS (VALUES (0, 'that with they', ['that', 'with', 'they']), (1, 'dans pour avec', ['dans', 'pour', 'avec']), (2, 'nicht oder', ['nicht', 'oder'])),
        s AS (SELECT doc_id, source_name, query_no, query, CAST(len(list_intersect(t, w)) AS INT) AS hits FROM g CROSS JOIN q)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_no, source_name ORDER BY hits DESC, doc_id) AS INT) AS rank FROM s WHERE hits > 0 QUALIFY rank <= 15""",
)
def j9_round(m):
    return J.lake_search(m.docs, ROUND, 15)


def lake(m):
    keys = m.raw_docs.select("doc_id", "external_id", "url")
    return m.docs.join(keys, "doc_id").select("doc_id", "title", "text", "source_name", "external_id", "url")


def sampling_sql(seeds: list[str], include: list[str], exclude: list[str]) -> str:
    """Two rounds of the standard profile: search, one document per key, gate, budget of 100, expansion by title pairs, and again."""
    tokens = lambda text: f"list_distinct(regexp_extract_all(lower({text}), '[a-z]{{{{4,}}}}'))"
    listed = ", ".join(f"({i}, '{q}')" for i, q in enumerate(seeds))
    words = lambda terms: f"list_distinct(regexp_extract_all('{' '.join(terms).lower()}', '[a-z]{{{{4,}}}}'))"
    gate = f"len(list_intersect(t, {words(include)})) > 0 AND len(list_intersect(t, {words(exclude)})) < 2" if include else "true"

    def round_sql(n: int, seen: str, budget: str) -> str:
        return f"""f{n} AS (SELECT doc_id, source_name, query_no, row_number() OVER (PARTITION BY query_no, source_name ORDER BY len(list_intersect(t, w)) DESC, doc_id) AS rank
                FROM lk CROSS JOIN q{n} WHERE len(list_intersect(t, w)) > 0 QUALIFY rank <= 15),
            h{n} AS (SELECT doc_id, min(row(query_no, source_name, rank)) AS turn FROM f{n} GROUP BY 1),
            b{n} AS (SELECT lk.*, turn FROM lk JOIN h{n} USING (doc_id) WHERE doc_key <> '' QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY turn, doc_id) = 1),
            t{n} AS (SELECT doc_id, doc_key, title, {n} AS round FROM b{n} WHERE {seen} AND {gate} QUALIFY row_number() OVER (ORDER BY turn, doc_id) <= {budget})"""

    return f"""WITH lk AS (SELECT d.doc_id, d.title, source_name, {tokens("d.title || ' ' || d.text")} AS t, lower(trim(coalesce(nullif(external_id, ''), nullif(url, ''), d.title))) AS doc_key
            FROM {{docs}} d JOIN (SELECT doc_id, external_id, url FROM {{raw_docs}}) USING (doc_id)),
        q1 AS (SELECT query_no, {tokens('query')} AS w FROM (VALUES {listed}) q(query_no, query)), {round_sql(1, 'true', '100')},
        ws AS (SELECT list_filter(list_transform(regexp_extract_all(title, '[a-zA-Z][a-zA-Z-]{{{{3,}}}}'), lambda x: lower(x)), lambda x: x NOT IN {EXPANSION_STOP_SQL}) AS ws FROM t1),
        pr AS (SELECT unnest(list_zip(ws[:-2], ws[2:])) AS z FROM ws WHERE len(ws) > 1),
        kn AS (SELECT regexp_extract_all('{' '.join(seeds).lower()}', '[a-zA-Z][a-zA-Z-]{{{{3,}}}}') AS known),
        ex AS (SELECT z[1] AS w1, z[2] AS w2, count(*) AS n FROM pr, kn WHERE z[1] <> z[2] AND NOT (list_contains(known, z[1]) AND list_contains(known, z[2])) GROUP BY 1, 2 HAVING count(*) >= 2),
        q2 AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, w1, w2) - 1 AS INT) AS query_no, {tokens("w1 || ' ' || w2")} AS w FROM ex WHERE (SELECT count(*) FROM t1) < 100 QUALIFY query_no < 4),
        {round_sql(2, 'doc_key NOT IN (SELECT doc_key FROM t1)', '100 - (SELECT count(*) FROM t1)')}
        SELECT doc_id, doc_key, round FROM t1 UNION ALL SELECT doc_id, doc_key, round FROM t2""".replace("{{", "{").replace("}}", "}")


@catalog.add("j9_snowball_sample", sampling_sql(ROUND, INCLUDE, EXCLUDE))
def j9(m):
    sample, _, _ = J.snowball(lake(m), ROUND, "standard", INCLUDE, EXCLUDE)
    return sample.select("doc_id", "doc_key", "round")


@catalog.add("j9_snowball_two_rounds", sampling_sql(["sobre entre cuando"], [], []))
def j9_two(m):
    """A sample that the first round does not fill, so that queries from its titles fill the rest."""
    sample, _, _ = J.snowball(J.LakeIndex(lake(m)), ["sobre entre cuando"], "standard")
    return sample.select("doc_id", "doc_key", "round")


@catalog.add(
    "j10_harvest_report",
    f"""WITH g AS (SELECT doc_id, source_name, {GATE_SQL} AS t FROM {{docs}}), q(query_no, query, w) AS (VALUES (0, 'that with they', ['that', 'with', 'they']), (1, 'dans pour avec', ['dans', 'pour', 'avec']), (2, 'nicht oder', ['nicht', 'oder'])),
        s AS (SELECT source_name, query_no, query, count(*) FILTER (len(list_intersect(t, w)) > 0) AS n FROM g CROSS JOIN q GROUP BY ALL)
        SELECT query_no, source_name, query, least(n, 15) AS findings, 1 AS round FROM s""",
)
def j10(m):
    _, report, _ = J.snowball(lake(m), ROUND, "standard", INCLUDE, EXCLUDE, expand=0)
    return report


# ---------------------------------------------------------------- streams


def stream_view(m, view: str, table: str, **others):
    """A model view over the streamed table."""
    stream = K.log_stream(m.spark, m.sf_dir, f"{table}.parquet")
    return m.spark.sql(spark_sql(view), **{table: stream}, **others)


@catalog.add(
    "k1_progress_log",
    "SELECT event_id, run_id, phase, greatest(0, least(100, progress)) AS progress, message FROM {run_events}",
)
def k1(m):
    out = scratch_dir(m.spark, "k1")
    K.drain_append(K.clamped_progress(stream_view(m, "run_events", "events")), out)
    return m.spark.read.parquet(f"{out}/data").select("event_id", "run_id", "phase", "progress", "message")


PROGRESS_SQL = "lt AS (SELECT run_id, arg_max(phase, event_id) AS phase, arg_max(progress, event_id) AS progress, arg_max(message, event_id) AS message, max(event_id) AS event_id FROM {run_events} GROUP BY 1)"


@catalog.add(
    "k2_run_progress",
    f"""WITH {PROGRESS_SQL} SELECT r.run_id, r.status, coalesce(phase, status) AS phase, coalesce(progress, CASE WHEN status <> 'running' THEN 100 ELSE 0 END) AS progress,
        coalesce(message, 'Run is waiting to start') AS message FROM (SELECT * FROM {{runs}} WHERE run_id > 0 UNION ALL SELECT run_id + 1000000, status, started_at, finished_at, n_topics, query, error FROM {{runs}}) r LEFT JOIN lt ON lt.run_id = r.run_id""",
)
def k2(m):
    out = scratch_dir(m.spark, "k2")
    K.drain_updates(K.latest_progress(stream_view(m, "run_events", "events")), out)
    runs = m.runs.unionByName(m.runs.withColumn("run_id", F.col("run_id") + 1000000))
    return K.run_progress(runs, K.current_state(m.spark, out, ["run_id"]))


CODES_SQL = "('search_started', 'round_started', 'source_searched', 'source_failed', 'queries_expanded', 'round_completed', 'search_completed')"


@catalog.add(
    "k3_activity_feed",
    f"""SELECT run_id, phase, event_id, 'each' AS shown FROM {{run_events}} WHERE coalesce(code IN {CODES_SQL}, false) OR phase = 'corpus'
        UNION ALL SELECT run_id, phase, min(event_id), 'once' FROM {{run_events}} WHERE NOT coalesce(code IN {CODES_SQL}, false) AND phase <> 'corpus' GROUP BY 1, 2""",
)
def k3(m):
    out = scratch_dir(m.spark, "k3")
    single, rest = K.feed_lines(stream_view(m, "run_events", "events"))
    K.drain_append(single.select("run_id", "phase", "event_id"), f"{out}/each")
    K.drain_updates(K.first_per_phase(rest), f"{out}/once")
    each = m.spark.read.parquet(f"{out}/each/data").withColumn("shown", F.lit("each"))
    once = K.current_state(m.spark, f"{out}/once", ["run_id", "phase"]).withColumn("shown", F.lit("once"))
    return each.unionByName(once)


FETCH_SQL = "(8 + least(16.0, round_even(CAST(count(*) FILTER (code IN ('source_searched', 'source_failed')) {over} AS DOUBLE) / 12 * 16, 0)))"


@catalog.add(
    "k4_fetch_progress",
    f"""WITH x AS (SELECT run_id, event_id, code, CAST({FETCH_SQL.format(over="OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS INT) AS percent FROM {{run_events}})
        SELECT * FROM x WHERE code IS NOT NULL""",
)
def k4(m):
    return K.fetch_progress(m.run_events, 12)


@catalog.add("k4_fetch_progress_state", f"SELECT run_id, CAST({FETCH_SQL.format(over='')} AS INT) AS percent FROM {{run_events}} GROUP BY run_id")
def k4_state(m):
    out = scratch_dir(m.spark, "k4")
    K.drain_updates(K.fetch_progress_state(stream_view(m, "run_events", "events"), 12), out)
    return K.current_state(m.spark, out, ["run_id"])


@catalog.add("k5_streamed_ingest", f"SELECT min(doc_id) AS doc_id, 'sha256:' || {HASH_SQL} AS normalized_identity FROM {{raw_docs}} GROUP BY 2")
def k5(m):
    out = scratch_dir(m.spark, "k5")
    null = F.lit(None).cast("string")
    K.ingest_documents(stream_view(m, "raw_docs", "documents").withColumns({"external_id": null, "url": null}), out)
    return m.spark.read.parquet(f"{out}/data").select("doc_id", "normalized_identity")


@catalog.add(
    "k6_streamed_embeddings",
    "SELECT sha256(text) AS content_hash, 'hashing' AS model_name, CAST(384 AS INT) AS dim FROM {documents} GROUP BY text",
)
def k6(m):
    out = scratch_dir(m.spark, "k6")
    docs = K.log_stream(m.spark, m.sf_dir, "documents.parquet").select("doc_id", F.lit("").alias("title"), "text", F.sha2("text", 256).alias("content_hash"))
    K.embed_incoming(docs, out, V.hashing_embedder(), "hashing")
    return K.embedding_cache(m.spark, out).content().select("content_hash", "model_name", F.size("embedding").alias("dim"))


@catalog.add(
    "k7_decision_log",
    "SELECT idempotency_key, decision_key, tie, action FROM {decisions} QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY decision_key, tie) = 1",
)
def k7(m):
    out = scratch_dir(m.spark, "k7")
    stream = stream_view(m, "decisions", "lineitem", orders=m.orders)
    K.log_decisions(stream, out, ["decision_key", "tie"])
    return K.decision_store(m.spark, out, stream.schema).content().select("idempotency_key", "decision_key", "tie", "action")


@catalog.add(
    "k8_live_quarters",
    """SELECT run_id, topic_index, CAST(year(published_at) AS STRING) || '-Q' || CAST(quarter(published_at) AS STRING) AS period, count(*) AS doc_count FROM {series}
        WHERE topic_index >= 0 AND published_at IS NOT NULL GROUP BY ALL""",
)
def k8(m):
    out = scratch_dir(m.spark, "k8")
    members = stream_view(m, "series", "orders").withColumn("published_at", F.col("published_at").cast("timestamp"))
    K.drain_updates(K.daily_counts(members), out)
    return K.quarters_of_days(K.current_state(m.spark, out, ["run_id", "topic_index", "day"]))


@catalog.add(
    "k9_run_outcomes",
    f"WITH {PROGRESS_SQL} SELECT r.run_id, status, CAST(finished_at - started_at AS INT) AS days, error, phase FROM {{runs}} r LEFT JOIN lt ON lt.run_id = r.run_id",
)
def k9(m):
    out = scratch_dir(m.spark, "k9")
    K.drain_updates(K.latest_progress(stream_view(m, "run_events", "events")), out)
    return K.run_outcomes(m.runs, K.current_state(m.spark, out, ["run_id"]))


@catalog.add("m1_custom_embedder", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars FROM {documents}")
def m1(m):
    """Hook for a per-batch Python model, shown with a length embedder."""
    embed = batch_embedder(_length_model)
    return m.documents.select("doc_id", embed(F.col("text")).alias("embedding")).select("doc_id", F.element_at("embedding", 1).cast("double").alias("chars"))


def _length_model():
    return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], dtype="float32")
