"""Registered queries H1-H44."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.catalog.model import Catalog, word
from trendloom.catalog.topics_queries import CENTROID_SQL
from trendloom.constants import MAX_NEW_TRENDS, PROPOSED_FIELDS
from trendloom.functions.joins import join_in_groups
from trendloom.operators import assess as G
from trendloom.operators import corpus as C
from trendloom.operators import match as M
from trendloom.operators import portfolio as P
from trendloom.operators import series as S
from trendloom.operators import vectors as V
from trendloom.operators import views as W

catalog = Catalog()
SCORED = ("impact", "urgency", "uncertainty")
ORDER = ["decision_key", "tie"]


def listed(df, column="pestel"):
    return df.withColumn(column, F.split(column, ","))


def proposed(m):
    return M.with_proposed(m.trends, listed(m.assessments)).withColumn("keywords", F.split("keywords", ","))


def canon(m):
    return listed(m.canonicals)


def occ(m):
    return listed(m.occurrences, "changed_fields")


def joined(column):
    return F.array_join(column, ",").alias(column)


# ---------------------------------------------------------------- matching


@catalog.add(
    "h1_match_candidates",
    """WITH l AS (SELECT canonical_id, arg_max(trend_id, (run_id, occurrence_id)) AS trend_id FROM {occurrences} WHERE canonical_id IS NOT NULL GROUP BY 1)
        SELECT c.canonical_id, c.status, l.trend_id, t.run_id, t.topic_id, lower(t.keywords) AS keywords FROM {canonicals} c
        JOIN l ON l.canonical_id = c.canonical_id JOIN {trends} t ON t.trend_id = l.trend_id WHERE c.status NOT IN ('merged', 'review')""",
)
def h1(m):
    rows = M.match_candidates(m.canonicals, m.occurrences, m.trends.withColumn("keywords", F.split("keywords", ",")))
    return rows.select("canonical_id", "status", "trend_id", "run_id", "topic_id", joined("keywords"))


KEYWORDS_SQL = "list_distinct([{0}, {1}, {2}])".format(word("topic_index"), word("topic_index * 3"), word("topic_index + run_id"))
PAIRS_SQL = f"""{CENTROID_SQL},
    pr AS (SELECT r.run_id, (SELECT max(p.run_id) FROM {{corpus_runs}} p WHERE p.status = 'completed' AND p.run_id < r.run_id) AS prev FROM {{corpus_runs}} r),
    md AS (SELECT run_id, topic_index, doc_id FROM {{run_docs}} WHERE topic_index >= 0),
    sz AS (SELECT run_id, topic_index, count(*) AS n FROM md GROUP BY ALL),
    ov AS (SELECT c.run_id, c.topic_index AS cur, k.topic_index AS known, count(*) AS n FROM md c JOIN pr ON pr.run_id = c.run_id JOIN md k ON k.run_id = pr.prev AND k.doc_id = c.doc_id GROUP BY ALL),
    tk AS (SELECT run_id, topic_index, centroid, n, {KEYWORDS_SQL} AS kws FROM cen JOIN sz USING (run_id, topic_index)),
    raw AS (SELECT c.run_id, c.topic_index AS cur, k.topic_index AS known, CASE WHEN k.topic_index % 4 = 3 THEN 'rejected' ELSE 'active' END AS status,
        greatest(0.0, list_sum(list_transform(list_zip(c.centroid, k.centroid), lambda z: z[1] * z[2]))) AS cos, coalesce(ov.n, 0) AS nb, c.n AS na, k.n AS nk,
        len(list_intersect(c.kws, k.kws)) AS wb, len(c.kws) AS wa, len(k.kws) AS wk
        FROM tk c JOIN pr ON pr.run_id = c.run_id JOIN tk k ON k.run_id = pr.prev LEFT JOIN ov ON ov.run_id = c.run_id AND ov.cur = c.topic_index AND ov.known = k.topic_index),
    s AS (SELECT run_id, cur, known, status, 0.65e0 * cos + 0.20e0 * nb / (na + nk - nb) + 0.15e0 * wb / (wa + wk - wb) AS score FROM raw),
    st AS (SELECT *, row_number() OVER (PARTITION BY run_id, cur ORDER BY score DESC, known) AS rk, row_number() OVER (PARTITION BY run_id, known ORDER BY score DESC, cur) AS ck FROM s),
    mg AS (SELECT *, score - coalesce((SELECT max(o.score) FROM st o WHERE o.run_id = st.run_id AND o.cur = st.cur AND o.known <> st.known), 0.0) AS margin FROM st)"""


def scores(m, strongest=False):
    cen = V.topic_centroids(m.run_docs)
    keywords = F.array(*[F.expr(word(x)) for x in ("topic_index", "topic_index * 3", "topic_index + run_id")])
    topics = cen.withColumn("keywords", keywords)
    docs = m.run_docs.where("topic_index >= 0").select("run_id", "topic_index", "doc_id")
    runs = C.previous_completed(m.corpus_runs).where("previous_run_id IS NOT NULL")

    def offered(df):
        return df.withColumnRenamed("run_id", "previous_run_id").join(runs, "previous_run_id").drop("previous_run_id").withColumnRenamed("topic_index", "known")

    known = offered(topics).withColumn("status", F.when(F.col("known") % 4 == 3, "rejected").otherwise("active"))
    pairs = M.strongest_pairs if strongest else M.pair_scores
    return pairs(topics.withColumnRenamed("topic_index", "cur"), known, docs.withColumnRenamed("topic_index", "cur"), offered(docs))


@catalog.add("h2_pair_scores", f"WITH {PAIRS_SQL} SELECT run_id, cur, known, status, round(score, 6) AS score FROM s")
def h2(m):
    return scores(m).withColumn("score", F.round("score", 6))


# Best assignments of a run by dynamic programming over the set of entries taken, one topic after the other; nine topics at most.
STEPS = 9
BEST_SQL = "b0 AS (SELECT DISTINCT run_id, 0 AS taken, 0e0 AS total, CAST([] AS STRUCT(cur BIGINT, known BIGINT)[]) AS pairs FROM s), " + ", ".join(
    f"""b{k + 1} AS (SELECT run_id, taken, max(total) AS total, arg_max(pairs, total) AS pairs FROM (SELECT run_id, taken, total, pairs FROM b{k}
        UNION ALL SELECT b.run_id, b.taken | (1 << s.known::INT), b.total + s.score, list_append(b.pairs, {{'cur': s.cur::BIGINT, 'known': s.known::BIGINT}})
            FROM b{k} b JOIN s ON s.run_id = b.run_id AND s.cur = {k} AND (b.taken >> s.known::INT) & 1 = 0) GROUP BY run_id, taken)"""
    for k in range(STEPS)
)
BEST_SQL += f", best AS (SELECT run_id, max(total) AS total, arg_max(pairs, total) AS pairs FROM b{STEPS} GROUP BY run_id), won AS (SELECT run_id, unnest(pairs) AS p FROM best)"


@catalog.add(
    "h3_one_to_one",
    f"""WITH {PAIRS_SQL}, {BEST_SQL}, given AS (SELECT run_id, p.cur AS cur, p.known AS known FROM won),
        typed AS (SELECT mg.run_id, mg.cur, mg.known, score, margin, CASE WHEN status = 'rejected' THEN 'matched_rejected' WHEN score < 0.62 THEN 'below_match_threshold'
            WHEN margin < 0.08 THEN 'ambiguous_margin' END AS reason FROM mg JOIN given g ON g.run_id = mg.run_id AND g.cur = mg.cur AND g.known = mg.known WHERE score >= 0.5
        UNION ALL SELECT run_id, cur, known, score, 0e0, 'split_candidate' FROM mg
            WHERE rk = 1 AND score >= 0.5 AND NOT EXISTS (SELECT 1 FROM given g WHERE g.run_id = mg.run_id AND g.cur = mg.cur))
        SELECT run_id, cur, known, round(score, 6) AS score, round(margin, 6) AS margin, reason FROM typed""",
)
def h3(m):
    return M.match_run(scores(m, strongest=True)).withColumns({c: F.round(c, 6) for c in ("score", "margin")})


@catalog.add(
    "h3_assignment_total",
    f"WITH {PAIRS_SQL}, {BEST_SQL} SELECT run_id, CAST(len(pairs) AS BIGINT) AS n_pairs, CAST(len(pairs) AS BIGINT) AS n_topics, CAST(len(pairs) AS BIGINT) AS n_entries, round(total, 5) AS total FROM best",
)
def h3_total(m):
    """One-to-one pairs per run: as many different topics and entries as pairs, and the highest total score."""
    return M.one_to_one(scores(m, strongest=True)).groupBy("run_id").agg(
        F.count("*").alias("n_pairs"), F.count_distinct("cur").alias("n_topics"), F.count_distinct("known").alias("n_entries"), F.round(F.sum("score"), 5).alias("total")
    )


@catalog.add(
    "h3_mutual_best",
    f"WITH {PAIRS_SQL} SELECT run_id, cur, known, round(score, 6) AS score, round(margin, 6) AS margin FROM mg WHERE rk = 1 AND ck = 1",
)
def h3_mutual(m):
    rows = M.mutual_best(scores(m))
    return rows.select("run_id", "cur", "known", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@catalog.add(
    "h4_match_reasons",
    f"""WITH {PAIRS_SQL} SELECT run_id, cur, known, round(score, 6) AS score, CASE WHEN status = 'rejected' THEN 'matched_rejected'
        WHEN score < 0.62 THEN 'below_match_threshold' WHEN margin < 0.08 THEN 'ambiguous_margin' END AS reason FROM mg WHERE rk = 1 AND ck = 1 AND score >= 0.5""",
)
def h4(m):
    rows = M.match_reasons(M.mutual_best(scores(m)))
    return rows.select("run_id", "cur", "known", F.round("score", 6).alias("score"), "reason")


@catalog.add(
    "h5_split_candidates",
    f"""WITH {PAIRS_SQL}, taken AS (SELECT run_id, cur FROM mg WHERE rk = 1 AND ck = 1 AND cur % 2 = 0)
        SELECT run_id, cur, known, round(score, 6) AS score, 'split_candidate' AS reason FROM st WHERE rk = 1 AND score >= 0.5
            AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.run_id = st.run_id AND t.cur = st.cur)""",
)
def h5(m):
    pairs = scores(m)
    taken = M.mutual_best(pairs).where("cur % 2 = 0")
    return M.split_candidates(pairs, taken).select("run_id", "cur", "known", F.round("score", 6).alias("score"), "reason")


# ---------------------------------------------------------------- differences

PROP_SQL = """prop AS (SELECT t.*, a.trend_id IS NOT NULL AS assessed, a.pestel, a.category, a.impact, a.urgency, a.uncertainty, a.radar_stage, a.rationale
    FROM {trends} t LEFT JOIN {assessments} a ON a.trend_id = t.trend_id)"""


def differ_sql(f: str, a: str, b: str) -> str:
    if f == "pestel":
        return f"list_sort(string_split({a}.pestel, ',')) IS DISTINCT FROM list_sort(string_split({b}.pestel, ','))"
    if f in SCORED:
        return f"coalesce(abs({a}.{f} - {b}.{f}) > 0.05, {a}.{f} IS DISTINCT FROM {b}.{f})"
    return f"{a}.{f} IS DISTINCT FROM {b}.{f}"


def material_sql(f: str, a: str, b: str) -> str:
    if f in SCORED:
        return f"coalesce(abs({a}.{f} - {b}.{f}) >= 2, {a}.{f} IS DISTINCT FROM {b}.{f})"
    return "false" if f == "summary" else "true"


DIFF_COLUMNS = ", ".join(
    f"({differ_sql(f, 'c', 'p')}){'' if f in PROPOSED_FIELDS[:3] else ' AND p.assessed'} AS d_{f}, {material_sql(f, 'c', 'p')} AS m_{f}, "
    f"c.{f} AS b_{f}, p.{f} AS a_{f}" for f in PROPOSED_FIELDS
)
CHANGED = "concat_ws(',', " + ", ".join(f"CASE WHEN d_{f} THEN '{f}' END" for f in PROPOSED_FIELDS) + ")"
MATERIAL = "concat_ws(',', " + ", ".join(f"CASE WHEN d_{f} AND m_{f} THEN '{f}' END" for f in PROPOSED_FIELDS) + ")"
DIFF_SQL = f"""{PROP_SQL}, dd AS (SELECT p.trend_id, p.run_id, p.topic_id, o.canonical_id, o.match_score, o.match_margin, o.review_reason, {DIFF_COLUMNS}
        FROM prop p JOIN {{occurrences}} o ON o.trend_id = p.trend_id JOIN {{canonicals}} c ON c.canonical_id = o.canonical_id),
    df AS (SELECT *, {CHANGED} AS changed, {MATERIAL} AS material FROM dd)"""
REASONS = "concat_ws(';', CASE WHEN review_reason IS NOT NULL THEN review_reason || ':identity' END, " + ", ".join(
    f"CASE WHEN d_{f} THEN concat_ws(':', CASE WHEN m_{f} THEN 'material_change' ELSE 'content_change' END, 'classification', '{f}', "
    f"CAST(b_{f} AS STRING), CAST(a_{f} AS STRING)) END" for f in PROPOSED_FIELDS
) + ")"


def differences(m):
    links = m.occurrences.where("canonical_id IS NOT NULL").select("trend_id", "canonical_id", "review_reason")
    return M.against_portfolio(proposed(m).join(links, "trend_id"), canon(m))


def reason_text(reasons):
    return F.array_join(F.transform(reasons, lambda r: F.concat_ws(":", r["code"], r["kind"], r["field"], r["before"], r["after"])), ";")


@catalog.add("h6_value_differences", f"WITH {DIFF_SQL} SELECT trend_id, canonical_id, changed FROM df")
def h6(m):
    return differences(m).select("trend_id", "canonical_id", F.array_join(M.field_names(F.col("diffs")), ",").alias("changed"))


@catalog.add(
    "h7_change_types",
    f"""WITH {DIFF_SQL} SELECT trend_id, material, CASE WHEN material <> '' THEN 'classification_changed' WHEN changed <> '' THEN 'content_changed'
        WHEN trend_id % 2 = 0 THEN 'evidence_only' ELSE 'unchanged' END AS change_type FROM df""",
)
def h7(m):
    typed = M.change_type(F.col("diffs"), F.col("trend_id") % 2 == 0)
    return differences(m).select("trend_id", F.array_join(M.material_names(F.col("diffs")), ",").alias("material"), typed.alias("change_type"))


@catalog.add("h8_review_reasons", f"WITH {DIFF_SQL}, r AS (SELECT trend_id, {REASONS} AS reasons FROM df) SELECT *, CASE WHEN reasons <> '' THEN 'pending' ELSE 'not_required' END AS review_status FROM r")
def h8(m):
    reasons = M.review_reasons(F.col("diffs"), F.col("review_reason"))
    rows = differences(m).select("trend_id", reasons.alias("r"))
    return rows.select("trend_id", reason_text("r").alias("reasons"), F.when(F.size("r") > 0, "pending").otherwise("not_required").alias("review_status"))


PREV_SQL = """pv AS (SELECT o.occurrence_id, o.canonical_id, o.run_id, o.trend_id, max({'r': run_id, 'o': occurrence_id, 't': trend_id}) OVER (PARTITION BY canonical_id
        ORDER BY run_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {occurrences} o WHERE canonical_id IS NOT NULL)"""
DELTA_SQL = f"""{PREV_SQL}, td AS (SELECT DISTINCT topic_id, doc_id FROM {{topic_docs}} WHERE NOT is_outlier),
    nw AS (SELECT occurrence_id, doc_id FROM pv JOIN td ON td.topic_id = pv.trend_id), od AS (SELECT occurrence_id, doc_id FROM pv JOIN td ON td.topic_id = pv.p.t),
    dl AS (SELECT occurrence_id, (SELECT count(*) FROM nw WHERE nw.occurrence_id = pv.occurrence_id AND NOT EXISTS (SELECT 1 FROM od WHERE od.occurrence_id = nw.occurrence_id AND od.doc_id = nw.doc_id)) AS evidence_added,
        (SELECT count(*) FROM od WHERE od.occurrence_id = pv.occurrence_id AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.occurrence_id = od.occurrence_id AND nw.doc_id = od.doc_id)) AS evidence_removed FROM pv)"""


def occurrence_links(m):
    prev = M.previous_occurrences(m.occurrences)
    return prev.select("occurrence_id", F.col("trend_id").alias("topic_id"), F.col("prev_trend_id").alias("prev_topic_id"))


@catalog.add("h9_evidence_delta", f"WITH {DELTA_SQL} SELECT * FROM dl")
def h9(m):
    return M.evidence_delta(occurrence_links(m), m.topic_docs)


@catalog.add(
    "h10_previous_occurrence",
    f"WITH {PREV_SQL} SELECT occurrence_id, canonical_id, run_id, trend_id, p.r AS prev_run_id, p.o AS prev_occurrence_id, p.t AS prev_trend_id FROM pv",
)
def h10(m):
    return M.previous_occurrences(m.occurrences)


@catalog.add(
    "h11_admitted_new_trends",
    """SELECT t.run_id, t.trend_id, size FROM {trends} t JOIN {occurrences} o ON o.trend_id = t.trend_id WHERE canonical_id IS NULL
        QUALIFY row_number() OVER (PARTITION BY t.run_id ORDER BY size DESC, t.trend_id) <= 5""",
)
def h11(m):
    fresh = m.trends.join(m.occurrences.where("canonical_id IS NULL").select("trend_id"), "trend_id", "left_semi")
    return M.admit_new(fresh, MAX_NEW_TRENDS).select("run_id", "trend_id", "size")


def matches(m):
    return m.occurrences.where("canonical_id IS NOT NULL").select(
        "trend_id", "canonical_id", F.col("match_score").alias("score"), F.col("match_margin").alias("margin"), F.col("review_reason").alias("reason")
    )


def reconciled(m, with_prevalence=True):
    prevalence = S.latest_prevalence(m.timepoints) if with_prevalence else None
    return M.reconcile(proposed(m), matches(m), canon(m), m.occurrences.withColumn("topic_id", F.col("trend_id")), m.topic_docs, prevalence)


RECONCILE_SQL = f"""{DIFF_SQL}, {DELTA_SQL},
    pvl AS (SELECT topic_id, arg_max(prevalence, period) AS prevalence FROM {{timepoints}} GROUP BY 1),
    kn AS (SELECT df.trend_id, run_id, topic_id, canonical_id, match_score AS score, match_margin AS margin, evidence_added, evidence_removed,
        CASE WHEN material <> '' THEN 'classification_changed' WHEN changed <> '' THEN 'content_changed' WHEN evidence_added + evidence_removed > 0 THEN 'evidence_only' ELSE 'unchanged' END AS change_type,
        changed AS changed_fields, {REASONS} AS reasons FROM df JOIN dl ON dl.occurrence_id = df.trend_id),
    fr AS (SELECT p.trend_id, p.run_id, p.topic_id, CAST(NULL AS STRING) AS canonical_id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS margin,
        (SELECT count(*) FROM td WHERE td.topic_id = p.topic_id) AS evidence_added, 0 AS evidence_removed, 'new' AS change_type,
        CASE WHEN assessed THEN '{",".join(PROPOSED_FIELDS)}' ELSE '{",".join(PROPOSED_FIELDS[:3])}' END AS changed_fields, 'new_trend:classification' AS reasons
        FROM prop p JOIN {{occurrences}} o ON o.trend_id = p.trend_id WHERE o.canonical_id IS NULL),
    oc AS (SELECT u.*, prevalence, CASE WHEN reasons <> '' THEN 'pending' ELSE 'not_required' END AS review_status FROM (SELECT * FROM kn UNION ALL SELECT * FROM fr) u LEFT JOIN pvl ON pvl.topic_id = u.topic_id)"""


@catalog.add("h12_reconcile", f"WITH {RECONCILE_SQL} SELECT * FROM oc")
def h12(m):
    rows = reconciled(m).withColumn("reasons", reason_text("review_reasons"))
    return rows.select(
        "trend_id", "run_id", "topic_id", "canonical_id", "score", "margin", "evidence_added", "evidence_removed", "change_type",
        joined("changed_fields"), "reasons", "prevalence", "review_status",
    )


@catalog.add(
    "h13_auto_apply",
    f"""WITH {RECONCILE_SQL}, si AS (SELECT canonical_id, arg_max(trend_id, (run_id, trend_id)) AS trend_id, max(run_id) AS run_id FROM oc WHERE reasons = '' AND canonical_id IS NOT NULL GROUP BY 1)
        SELECT c.canonical_id, coalesce(p.title, c.title) AS title, CASE WHEN p.assessed THEN p.uncertainty ELSE c.uncertainty END AS uncertainty,
            coalesce(si.run_id, c.last_run_id) AS last_run_id, coalesce(r.finished_at, r.started_at, c.updated_at) AS updated_at
        FROM {{canonicals}} c LEFT JOIN si ON si.canonical_id = c.canonical_id LEFT JOIN prop p ON p.trend_id = si.trend_id LEFT JOIN {{runs}} r ON r.run_id = si.run_id""",
)
def h13(m):
    rows = M.auto_apply(canon(m), proposed(m), reconciled(m, False), m.runs)
    return rows.select("canonical_id", "title", "uncertainty", "last_run_id", "updated_at")


@catalog.add(
    "h13_auto_applied_texts",
    f"""WITH {RECONCILE_SQL}, si AS (SELECT canonical_id, arg_max(trend_id, (run_id, trend_id)) AS trend_id FROM oc WHERE reasons = '' AND canonical_id IS NOT NULL GROUP BY 1)
        SELECT c.canonical_id, l.language, CASE WHEN si.trend_id IS NULL THEN c.title WHEN x.trend_id IS NOT NULL THEN x.title ELSE p.title END AS title,
            CASE WHEN si.trend_id IS NULL THEN c.summary WHEN x.trend_id IS NOT NULL THEN x.summary ELSE p.summary END AS summary,
            CASE WHEN si.trend_id IS NOT NULL THEN coalesce(nullif(x.rationale, ''), a.rationale) END AS rationale
        FROM {{canonicals}} c CROSS JOIN (VALUES ('de'), ('en')) l(language) LEFT JOIN si ON si.canonical_id = c.canonical_id LEFT JOIN {{trends}} p ON p.trend_id = si.trend_id
        LEFT JOIN {{assessments}} a ON a.trend_id = si.trend_id LEFT JOIN {{translations}} x ON x.trend_id = si.trend_id AND x.language = l.language""",
)
def h13_texts(m):
    return M.auto_apply_texts(P.base_texts(m.canonicals), reconciled(m, False), review_texts(m))


# ---------------------------------------------------------------- run diff

SNAP_COLUMNS = ", ".join(
    f"(list_contains(string_split(o.changed_fields, ','), '{f}') AND {differ_sql(f, 'c', 'p')}) AS d_{f}, {material_sql(f, 'c', 'p')} AS m_{f}" for f in PROPOSED_FIELDS
)
RUN_DIFF_SQL = f"""{PROP_SQL}, {PREV_SQL},
    sn AS (SELECT o.occurrence_id, o.run_id, o.canonical_id, o.review_status, o.change_type AS stored, o.changed_fields AS stored_fields, p.title, evidence_added + evidence_removed > 0 AS ev, c.trend_id IS NOT NULL AS has_before, {SNAP_COLUMNS}
        FROM {{occurrences}} o JOIN prop p ON p.trend_id = o.trend_id LEFT JOIN pv ON pv.occurrence_id = o.occurrence_id LEFT JOIN prop c ON c.trend_id = pv.p.t),
    sf AS (SELECT *, {CHANGED} AS kept, {MATERIAL} AS kept_material, has_before AND stored IN ('classification_changed', 'content_changed') AS redo FROM sn),
    rd AS (SELECT occurrence_id, run_id, canonical_id, review_status, title, CASE WHEN NOT redo THEN stored WHEN kept_material <> '' THEN 'classification_changed' WHEN kept <> '' THEN 'content_changed'
        WHEN ev THEN 'evidence_only' ELSE 'unchanged' END AS change_type, CASE WHEN redo THEN kept ELSE stored_fields END AS changed_fields FROM sf)"""


@catalog.add("h14_sanitized_changes", f"WITH {RUN_DIFF_SQL} SELECT occurrence_id, change_type, changed_fields FROM rd")
def h14(m):
    return P.run_diff(occ(m), proposed(m)).select("occurrence_id", "change_type", joined("changed_fields"))


@catalog.add("h15_run_diff", f"WITH {RUN_DIFF_SQL} SELECT * FROM rd")
def h15(m):
    rows = P.run_diff(occ(m), proposed(m))
    return rows.select("occurrence_id", "run_id", "canonical_id", "review_status", "title", "change_type", joined("changed_fields"))


COUNT_TYPES = ", ".join(f"count(*) FILTER (change_type = '{c}') AS n_{c}" for c in ("new", "classification_changed", "content_changed", "evidence_only", "unchanged"))


@catalog.add("h15_run_diff_counts", f"WITH {RUN_DIFF_SQL} SELECT r.run_id, {COUNT_TYPES} FROM {{runs}} r LEFT JOIN rd ON rd.run_id = r.run_id GROUP BY 1")
def h15_counts(m):
    return P.diff_counts(P.run_diff(occ(m), proposed(m)), m.runs)


def counter_sql(column: str) -> str:
    return f"(SELECT string_agg({column} || '=' || CAST(n AS STRING), ',' ORDER BY {column}) FROM (SELECT {column}, count(*) AS n FROM {{occurrences}} o WHERE o.run_id = r.run_id GROUP BY 1))"


@catalog.add(
    "h16_run_list",
    f"""SELECT run_id, status, n_topics, error, {counter_sql('change_type')} AS changes, {counter_sql('review_status')} AS reviews
        FROM (SELECT * FROM {{runs}} ORDER BY run_id DESC LIMIT 20) r""",
)
def h16(m):
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return P.list_runs(m.runs, m.occurrences).select("run_id", "status", "n_topics", "error", flat("change_counts").alias("changes"), flat("review_counts").alias("reviews"))


# ---------------------------------------------------------------- portfolio views

LATEST_SQL = """lo AS (SELECT canonical_id, arg_max(occurrence_id, (CASE WHEN review_status IN ('approved', 'not_required') THEN 1 ELSE 0 END, run_id, occurrence_id)) AS occurrence_id,
    count(*) AS occurrence_count FROM {occurrences} WHERE canonical_id IS NOT NULL GROUP BY 1)"""


@catalog.add("h17_latest_occurrences", f"WITH {LATEST_SQL} SELECT lo.canonical_id, lo.occurrence_id, o.run_id, o.trend_id, occurrence_count FROM lo JOIN {{occurrences}} o ON o.occurrence_id = lo.occurrence_id")
def h17(m):
    return P.latest_occurrences(m.occurrences)


PORTFOLIO_SQL = f"""{LATEST_SQL}, pf AS (SELECT c.*, o.run_id, o.trend_id, o.occurrence_id, occurrence_count, t.topic_id, t.emergence, t.keywords, t.size, t.region, t.country
    FROM {{canonicals}} c JOIN lo ON lo.canonical_id = c.canonical_id JOIN {{occurrences}} o ON o.occurrence_id = lo.occurrence_id JOIN {{trends}} t ON t.trend_id = o.trend_id WHERE c.status = 'active')"""


def listing(m):
    return P.portfolio(canon(m), m.occurrences, m.trends.withColumn("keywords", F.split("keywords", ",")))


@catalog.add("h18_portfolio_list", f"WITH {PORTFOLIO_SQL} SELECT canonical_id, run_id, title, status, size, keywords, region, position, updated_at, occurrence_count FROM pf")
def h18(m):
    rows = listing(m).orderBy(*P.listing_order())
    return rows.select("canonical_id", "run_id", "title", "status", "size", joined("keywords"), "region", "position", "updated_at", "occurrence_count")


OVERLAY_SQL = f"""{PORTFOLIO_SQL}, {PROP_SQL}, pn AS (SELECT * FROM {{occurrences}} WHERE review_status = 'pending'),
    pl AS (SELECT canonical_id, arg_max(occurrence_id, (run_id, occurrence_id)) AS occurrence_id FROM pn WHERE canonical_id IS NOT NULL GROUP BY 1),
    ol AS (SELECT 0 AS sort_group, 'pending-' || CAST(pn.occurrence_id AS STRING) AS id, p.title, 'review' AS status, p.size, p.maturity, p.pestel, p.radar_stage, p.summary, p.keywords, p.region, true AS pending_review,
            pn.change_type AS pending_change_type, pn.occurrence_id AS pending_occurrence_id, pn.run_id AS pending_run_id FROM pn JOIN prop p ON p.trend_id = pn.trend_id WHERE pn.canonical_id IS NULL
        UNION ALL SELECT 1, pf.canonical_id, pf.title, pf.status, pf.size, pf.maturity, pf.pestel, pf.radar_stage, pf.summary, pf.keywords, pf.region, pn.occurrence_id IS NOT NULL, pn.change_type, pn.occurrence_id, pn.run_id
        FROM pf LEFT JOIN pl ON pl.canonical_id = pf.canonical_id LEFT JOIN pn ON pn.occurrence_id = pl.occurrence_id)"""


def overlay(m):
    return P.pending_overlay(listing(m), m.occurrences, proposed(m))


@catalog.add("h19_pending_overlay", f"WITH {OVERLAY_SQL} SELECT sort_group, id, title, status, size, pestel, pending_review, pending_change_type, pending_occurrence_id, pending_run_id FROM ol")
def h19(m):
    return overlay(m).select(
        "sort_group", "id", "title", "status", "size", joined("pestel"), "pending_review", "pending_change_type", "pending_occurrence_id", "pending_run_id"
    )


POINTS_SQL = """tl AS (SELECT topic_id, period, doc_count FROM {timepoints} QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY period DESC) <= 24),
    ts AS (SELECT topic_id, string_agg(period || ':' || CAST(doc_count AS STRING), ',' ORDER BY period) AS series FROM tl GROUP BY 1),
    ea AS (SELECT trend_id, string_agg(title || '|' || coalesce(url, '-'), ';' ORDER BY ord) AS evidence FROM {evidence} WHERE trim(title) <> '' GROUP BY 1)"""


def detail_columns():
    points = F.array_join(F.transform("timeseries", lambda p: F.concat(p["period"], F.lit(":"), p["doc_count"].cast("string"))), ",")
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat(e["title"], F.lit("|"), F.coalesce(e["url"], F.lit("-")))), ";")
    return points.alias("series"), evidence.alias("evidence")


@catalog.add(
    "h20_portfolio_detail",
    f"""WITH {PORTFOLIO_SQL}, {POINTS_SQL} SELECT pf.canonical_id, pf.title, a.rationale, series, evidence FROM pf LEFT JOIN {{assessments}} a ON a.trend_id = pf.trend_id
        LEFT JOIN ts ON ts.topic_id = pf.topic_id LEFT JOIN ea ON ea.trend_id = pf.trend_id""",
)
def h20(m):
    rows = listing(m).join(m.assessments.select("trend_id", "rationale"), "trend_id", "left")
    return P.trend_detail(rows, m.timepoints, m.evidence).select("canonical_id", "title", "rationale", *detail_columns())


@catalog.add(
    "h21_trend_history",
    f"""WITH {PROP_SQL} SELECT o.canonical_id, 'point' AS kind, o.run_id, o.occurrence_id AS ref, 0::BIGINT AS ord, concat_ws('|', change_type, maturity, CAST(size AS STRING), CAST(impact AS STRING)) AS detail
            FROM {{occurrences}} o JOIN prop p ON p.trend_id = o.trend_id WHERE canonical_id IS NOT NULL
        UNION ALL SELECT o.canonical_id, 'evidence', o.run_id, o.occurrence_id, e.ord, e.title FROM {{occurrences}} o JOIN {{evidence}} e ON e.trend_id = o.trend_id WHERE canonical_id IS NOT NULL AND e.title <> ''
        UNION ALL SELECT canonical_id, 'decision', NULL, decision_key, 0, action FROM {{decisions}}""",
)
def h21(m):
    return P.trend_history(m.occurrences, proposed(m), m.evidence, m.decisions)


LOCAL_SQL = """SELECT p.*, CASE WHEN x.trend_id IS NOT NULL THEN x.title ELSE p.title END AS l_title, CASE WHEN x.trend_id IS NOT NULL THEN x.summary ELSE p.summary END AS l_summary,
    coalesce(nullif(x.rationale, ''), p.rationale) AS l_rationale FROM prop p LEFT JOIN {translations} x ON x.trend_id = p.trend_id AND x.language = 'de'"""


def trend_view(m, **filters):
    return P.run_trends(m.trends, listed(m.assessments), m.translations, "de", **filters)


@catalog.add(
    "h22_run_trends",
    f"WITH {PROP_SQL}, v AS ({LOCAL_SQL}) SELECT trend_id, run_id, l_title AS title, l_summary AS summary, maturity, region, pestel, impact, radar_stage FROM v",
)
def h22(m):
    return trend_view(m).select("trend_id", "run_id", "title", "summary", "maturity", "region", joined("pestel"), "impact", "radar_stage")


@catalog.add(
    "h22_latest_run_trends",
    f"""WITH {PROP_SQL}, v AS ({LOCAL_SQL}) SELECT trend_id, run_id, l_title AS title, maturity, region FROM v
        WHERE run_id = (SELECT max(run_id) FROM {{runs}} WHERE status = 'completed')""",
)
def h22_latest(m):
    latest = C.latest_completed(m.runs).first()[0]
    return trend_view(m, run_id=latest).select("trend_id", "run_id", "title", "maturity", "region")


@catalog.add(
    "h23_trend_detail",
    f"""WITH {PROP_SQL}, v AS ({LOCAL_SQL}), {POINTS_SQL} SELECT v.trend_id, l_title AS title, l_rationale AS rationale, series, evidence FROM v
        LEFT JOIN ts ON ts.topic_id = v.topic_id LEFT JOIN ea ON ea.trend_id = v.trend_id""",
)
def h23(m):
    return P.trend_detail(trend_view(m), m.timepoints, m.evidence).select("trend_id", "title", "rationale", *detail_columns())


@catalog.add(
    "h24_review_queue",
    """SELECT o.occurrence_id, o.run_id, o.canonical_id, coalesce(x.title, t.title) AS title, coalesce(x.summary, t.summary) AS summary, t.maturity, o.change_type, o.review_reason,
            c.title AS suggested_title, c.status AS suggested_status
        FROM {occurrences} o JOIN {trends} t ON t.trend_id = o.trend_id LEFT JOIN {canonicals} c ON c.canonical_id = o.canonical_id
        LEFT JOIN {translations} x ON x.trend_id = o.trend_id AND x.language = 'de' WHERE review_status = 'pending'""",
)
def h24(m):
    rows = P.review_queue(m.occurrences, m.trends, m.canonicals, m.translations, "de")
    return rows.select("occurrence_id", "run_id", "canonical_id", "title", "summary", "maturity", "change_type", "review_reason", "suggested_title", "suggested_status")


LOCAL_REASONS = "concat_ws(';', CASE WHEN review_reason IS NOT NULL THEN review_reason || ':identity' END, " + ", ".join(
    f"CASE WHEN d_{f} THEN concat_ws(':', CASE WHEN m_{f} THEN 'material_change' ELSE 'content_change' END, 'classification', '{f}', "
    + (f"'DE ' || b_{f}, coalesce(x.{f}, a_{f})" if f in ("title", "summary") else f"CAST(b_{f} AS STRING), CAST(a_{f} AS STRING)") + ") END" for f in PROPOSED_FIELDS
) + ")"


@catalog.add(
    "h25_localized_reasons",
    f"WITH {DIFF_SQL} SELECT df.trend_id, {LOCAL_REASONS} AS reasons FROM df LEFT JOIN {{translations}} x ON x.trend_id = df.trend_id AND x.language = 'de'",
)
def h25(m):
    de = m.translations.where("language = 'de'").select("trend_id", F.col("title").alias("de_title"), F.col("summary").alias("de_summary"))
    rows = differences(m).join(de, "trend_id", "left")
    reasons = M.review_reasons(F.col("diffs"), F.col("review_reason"))
    before = {f: F.concat(F.lit("DE "), F.col(f"c_{f}")) for f in ("title", "summary")}
    after = {f: F.col(f"de_{f}") for f in ("title", "summary")}
    return rows.select("trend_id", reason_text(P.localize_reasons(reasons, before, after)).alias("reasons"))


# ---------------------------------------------------------------- decisions

VALID_SQL = """ck AS (SELECT d.*, CASE WHEN c.canonical_id IS NULL THEN 'unknown_trend'
        WHEN o.occurrence_id IS NOT NULL AND o.canonical_id IS DISTINCT FROM d.canonical_id THEN 'foreign_occurrence' WHEN action = 'merge' AND target_id = d.canonical_id THEN 'self_merge'
        WHEN action = 'merge' AND g.canonical_id IS NULL THEN 'unknown_target' END AS problem
        FROM {decisions} d LEFT JOIN {canonicals} c ON c.canonical_id = d.canonical_id LEFT JOIN {canonicals} g ON g.canonical_id = d.target_id
        LEFT JOIN {occurrences} o ON o.occurrence_id = d.occurrence_id),
    vd AS (SELECT *, CASE action WHEN 'reject' THEN 'rejected' WHEN 'merge' THEN 'merged' ELSE 'active' END AS new_status FROM ck WHERE problem IS NULL
        QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY decision_key, tie) = 1)"""


def running_sql(f: str) -> str:
    return (f"coalesce(last_value(new_{f} IGNORE NULLS) OVER (PARTITION BY vd.canonical_id ORDER BY decision_key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c.{f}) AS before_{f}")


RECORD_SQL = f"{VALID_SQL}, rc AS (SELECT vd.*, {running_sql('status')}, {running_sql('title')}, {running_sql('maturity')}, {running_sql('impact')} FROM vd JOIN {{canonicals}} c ON c.canonical_id = vd.canonical_id)"


@catalog.add(
    "h26_decision_audit",
    f"""WITH {RECORD_SQL} SELECT decision_key, canonical_id, action, before_status, new_status AS after_status, before_title, coalesce(new_title, before_title) AS after_title,
        before_maturity, coalesce(new_maturity, before_maturity) AS after_maturity FROM rc""",
)
def h26(m):
    rows = P.record_decisions(m.decisions, canon(m), ORDER, occurrences=m.occurrences)
    return rows.select("decision_key", "canonical_id", "action", "before_status", "after_status", "before_title", "after_title", "before_maturity", "after_maturity")


def last_sql(f: str) -> str:
    return f"coalesce((SELECT arg_max(new_{f}, (decision_key, tie)) FROM vd WHERE vd.canonical_id = c.canonical_id AND new_{f} IS NOT NULL), c.{f}) AS {f}"


@catalog.add(
    "h26_decision_state",
    f"""WITH {VALID_SQL} SELECT c.canonical_id, {last_sql('status')}, {last_sql('title')}, {last_sql('maturity')}, {last_sql('impact')},
        coalesce((SELECT arg_max(target_id, (decision_key, tie)) FROM vd WHERE vd.canonical_id = c.canonical_id AND action = 'merge'), c.merged_into_id) AS merged_into_id FROM {{canonicals}} c""",
)
def h26_state(m):
    rows = P.fold_decisions(m.decisions, canon(m), ORDER, occurrences=m.occurrences)
    return rows.select("canonical_id", "status", "title", "maturity", "impact", "merged_into_id")


REVIEW_SQL = """rv AS (SELECT d.* EXCLUDE (canonical_id), o.run_id, o.trend_id AS o_trend_id, o.canonical_id AS own_id, CASE WHEN o.occurrence_id IS NULL THEN 'unknown_occurrence' WHEN o.review_status <> 'pending' THEN 'already_resolved'
        WHEN action = 'restore' THEN 'invalid_action' WHEN action = 'merge' AND o.canonical_id IS NULL THEN 'no_trend_to_merge' WHEN action IN ('link', 'merge') AND target_id IS NULL THEN 'target_required'
        WHEN action = 'merge' AND target_id = o.canonical_id THEN 'self_merge' WHEN action IN ('link', 'merge') AND g.canonical_id IS NULL THEN 'unknown_target' END AS problem
        FROM {decisions} d LEFT JOIN {occurrences} o ON o.occurrence_id = d.occurrence_id LEFT JOIN {canonicals} g ON g.canonical_id = d.target_id),
    ky AS (SELECT idempotency_key, min((decision_key, tie)) AS k FROM rv WHERE problem IS NULL GROUP BY 1),
    wn AS (SELECT occurrence_id, min((decision_key, tie)) AS w FROM rv JOIN ky ON ky.idempotency_key = rv.idempotency_key WHERE problem IS NULL AND (decision_key, tie) = k GROUP BY 1),
    ro AS (SELECT rv.*, CASE WHEN problem IS NOT NULL THEN problem WHEN (decision_key, tie) <> k THEN 'duplicate' WHEN (decision_key, tie) = w THEN 'applied' ELSE 'already_resolved' END AS outcome,
        (action = 'create' OR (action IN ('confirm', 'correct') AND own_id IS NULL)) AS creates
        FROM rv LEFT JOIN ky ON ky.idempotency_key = rv.idempotency_key LEFT JOIN wn ON wn.occurrence_id = rv.occurrence_id),
    rr AS (SELECT *, CASE WHEN creates THEN sha256('occurrence-' || CAST(occurrence_id AS STRING)) WHEN action = 'link' THEN target_id ELSE own_id END AS decided_id FROM ro)"""


def outcomes(m):
    return P.review_outcomes(m.decisions, m.occurrences, m.canonicals, ORDER)


@catalog.add(
    "h27_review_outcomes",
    f"""WITH {REVIEW_SQL} SELECT decision_key, tie, occurrence_id, action, outcome, CASE WHEN outcome = 'applied' THEN CASE WHEN action = 'reject' THEN 'rejected' ELSE 'approved' END END AS new_review_status,
        CASE WHEN outcome = 'applied' THEN CASE WHEN action = 'merge' THEN target_id ELSE decided_id END END AS new_canonical_id FROM rr""",
)
def h27(m):
    return outcomes(m).select("decision_key", "tie", "occurrence_id", "action", "outcome", "new_review_status", "new_canonical_id")


@catalog.add(
    "h27_review_state",
    f"""WITH {REVIEW_SQL}, {PROP_SQL}, ap AS (SELECT rr.*, p.title AS p_title, p.impact AS p_impact, p.category AS p_category, CASE WHEN action = 'merge' THEN 'merged' WHEN action <> 'reject' THEN 'active' END AS ss,
            CASE WHEN action = 'correct' AND new_title IS NOT NULL THEN new_title ELSE p.title END AS v_title, CASE WHEN action = 'correct' AND new_impact IS NOT NULL THEN new_impact ELSE p.impact END AS v_impact
            FROM rr JOIN prop p ON p.trend_id = rr.o_trend_id WHERE outcome = 'applied' AND decided_id IS NOT NULL),
        ag AS (SELECT decided_id, arg_max({{'t': v_title, 'i': v_impact, 'c': p_category}}, (decision_key, tie)) FILTER (action IN ('confirm', 'correct', 'create')) AS v, arg_max(ss, (decision_key, tie)) FILTER (ss IS NOT NULL) AS s,
            arg_max(target_id, (decision_key, tie)) FILTER (action = 'merge') AS mg, arg_max(run_id, (decision_key, tie)) FILTER (action <> 'reject') AS r, bool_or(creates) AS created FROM ap GROUP BY 1)
        SELECT c.canonical_id, coalesce(s, c.status) AS status, CASE WHEN v IS NOT NULL THEN v.t ELSE c.title END AS title, CASE WHEN v IS NOT NULL THEN v.i ELSE c.impact END AS impact,
            CASE WHEN v IS NOT NULL THEN v.c ELSE c.category END AS category, coalesce(mg, c.merged_into_id) AS merged_into_id, coalesce(r, c.last_run_id) AS last_run_id
        FROM {{canonicals}} c LEFT JOIN ag ON ag.decided_id = c.canonical_id
        UNION ALL SELECT decided_id, s, v.t, v.i, v.c, NULL, r FROM ag WHERE created""",
)
def h27_state(m):
    rows = P.apply_reviews(outcomes(m), canon(m), proposed(m), ORDER)
    return rows.select("canonical_id", "status", "title", "impact", "category", "merged_into_id", "last_run_id")


MERGES_SQL = """WITH RECURSIVE w AS (SELECT canonical_id, merged_into_id AS target, 1 AS depth FROM {canonicals} WHERE merged_into_id IS NOT NULL
        UNION ALL SELECT w.canonical_id, c.merged_into_id, depth + 1 FROM w JOIN {canonicals} c ON c.canonical_id = w.target WHERE c.merged_into_id IS NOT NULL AND depth < 50),
    f AS (SELECT canonical_id, arg_max(target, depth) AS target FROM w GROUP BY 1)"""


@catalog.add("h28_merge_targets", f"{MERGES_SQL} SELECT canonical_id, target FROM f")
def h28(m):
    return P.follow_merges(m.canonicals).select("canonical_id", "target")


@catalog.add(
    "h28_redirected_occurrences",
    f"{MERGES_SQL} SELECT occurrence_id, coalesce(target, o.canonical_id) AS canonical_id FROM {{occurrences}} o LEFT JOIN f ON f.canonical_id = o.canonical_id",
)
def h28_occurrences(m):
    return P.redirect_occurrences(m.occurrences, P.follow_merges(m.canonicals)).select("occurrence_id", "canonical_id")


@catalog.add(
    "h29_corrected_maturity",
    """WITH f AS (SELECT trend_id, arg_max(new_value, (feedback_key, tie)) AS v FROM {feedback} WHERE action = 'correct' AND field = 'maturity'
            AND new_value IN ('weak_signal', 'emerging', 'established', 'megatrend') GROUP BY 1)
        SELECT t.trend_id, coalesce(v, maturity) AS maturity, maturity AS machine_maturity FROM {trends} t LEFT JOIN f ON f.trend_id = t.trend_id""",
)
def h29(m):
    return P.corrected_maturity(m.trends, m.feedback, ["feedback_key", "tie"]).select("trend_id", "maturity", "machine_maturity")


ITEMS_SQL = "SELECT 'ct-' || CAST(p_partkey AS STRING) AS canonical_id, CAST(p_size AS DOUBLE) / 2 AS position FROM {part}"


@catalog.add(
    "h30_manual_order",
    f"""WITH it AS ({ITEMS_SQL}) SELECT c.canonical_id, coalesce(it.position, c.position) AS position, true AS known FROM {{canonicals}} c LEFT JOIN it ON it.canonical_id = c.canonical_id
        UNION ALL SELECT canonical_id, position, false FROM it WHERE canonical_id NOT IN (SELECT canonical_id FROM {{canonicals}})""",
)
def h30(m):
    items = m.part.selectExpr("'ct-' || CAST(p_partkey AS STRING) AS canonical_id", "CAST(p_size AS DOUBLE) / 2 AS position")
    moved, rejected = P.reorder(m.canonicals, items)
    rejected = rejected.select("canonical_id", F.col("wanted").alias("position"), F.lit(False).alias("known"))
    return moved.select("canonical_id", "position", F.lit(True).alias("known")).unionByName(rejected)


# ---------------------------------------------------------------- rollback and retention

NEWEST = "(SELECT max(run_id) FROM {occurrences})"


def undo_sql(f: str) -> str:
    return f"CASE WHEN EXISTS (SELECT 1 FROM mine WHERE mine.canonical_id = c.canonical_id AND new_{f} IS NOT NULL) THEN (SELECT arg_min(before_{f}, (decision_key, tie)) FROM mine WHERE mine.canonical_id = c.canonical_id AND new_{f} IS NOT NULL) ELSE c.{f} END AS {f}"


@catalog.add(
    "h31_rollback",
    f"""WITH {RECORD_SQL}, mine AS (SELECT rc.* FROM rc JOIN {{occurrences}} o ON o.occurrence_id = rc.occurrence_id WHERE o.run_id = {NEWEST}),
        gone AS (SELECT canonical_id FROM {{canonicals}} WHERE first_run_id = {NEWEST})
        SELECT c.canonical_id, coalesce((SELECT arg_min(before_status, (decision_key, tie)) FROM mine WHERE mine.canonical_id = c.canonical_id), c.status) AS status, {undo_sql('title')}, {undo_sql('impact')},
            CASE WHEN EXISTS (SELECT 1 FROM mine WHERE mine.canonical_id = c.canonical_id AND action = 'merge') OR merged_into_id IN (SELECT canonical_id FROM gone) THEN NULL ELSE merged_into_id END AS merged_into_id,
            CASE WHEN last_run_id = {NEWEST} THEN coalesce((SELECT max(run_id) FROM {{occurrences}} o WHERE o.canonical_id = c.canonical_id AND o.run_id < {NEWEST}), first_run_id) ELSE last_run_id END AS last_run_id
        FROM {{canonicals}} c WHERE first_run_id <> {NEWEST}""",
)
def h31(m):
    newest = m.occurrences.agg(F.max("run_id")).first()[0]
    recorded = P.record_decisions(m.decisions, canon(m), ORDER, occurrences=m.occurrences)
    rows = P.rollback_canonicals(newest, canon(m), m.occurrences, recorded, ORDER)
    return rows.select("canonical_id", "status", "title", "impact", "merged_into_id", "last_run_id")


@catalog.add(
    "h31_rollback_report",
    f"""WITH {RECORD_SQL} SELECT {NEWEST} AS run_id, (SELECT count(*) FROM rc JOIN {{occurrences}} o ON o.occurrence_id = rc.occurrence_id WHERE o.run_id = {NEWEST}) AS reverted_decisions,
        (SELECT count(*) FROM {{canonicals}} WHERE first_run_id = {NEWEST}) AS removed_canonicals, (SELECT count(*) FROM {{canonicals}} WHERE last_run_id = {NEWEST} AND first_run_id <> {NEWEST}) AS restored_canonicals,
        (SELECT count(*) FROM (SELECT doc_id FROM {{topic_docs}} GROUP BY 1 HAVING min(run_id) = {NEWEST})) AS removed_documents""",
)
def h31_report(m):
    newest = m.occurrences.agg(F.max("run_id")).first()[0]
    recorded = P.record_decisions(m.decisions, canon(m), ORDER, occurrences=m.occurrences)
    return P.rollback_report(newest, m.canonicals, m.occurrences, recorded, m.topic_docs)


@catalog.add(
    "h31_tables_without_run",
    f"""WITH kp AS (SELECT run_id FROM {{runs}} WHERE run_id <> {NEWEST}), kt AS (SELECT * FROM {{trends}} WHERE run_id IN (SELECT run_id FROM kp)),
        gone AS (SELECT canonical_id FROM {{canonicals}} WHERE first_run_id = {NEWEST})
        SELECT 'runs' AS table_name, (SELECT count(*) FROM kp) AS n UNION ALL SELECT 'trends', (SELECT count(*) FROM kt)
        UNION ALL SELECT 'occurrences', (SELECT count(*) FROM {{occurrences}} WHERE run_id IN (SELECT run_id FROM kp))
        UNION ALL SELECT 'linked_occurrences', (SELECT count(*) FROM {{occurrences}} WHERE run_id IN (SELECT run_id FROM kp) AND canonical_id NOT IN (SELECT canonical_id FROM gone))
        UNION ALL SELECT 'canonicals', (SELECT count(*) FROM {{canonicals}} WHERE canonical_id NOT IN (SELECT canonical_id FROM gone))
        UNION ALL SELECT 'decisions', (SELECT count(*) FROM {{decisions}} WHERE canonical_id NOT IN (SELECT canonical_id FROM gone)
            AND (occurrence_id IS NULL OR occurrence_id IN (SELECT occurrence_id FROM {{occurrences}} WHERE run_id IN (SELECT run_id FROM kp))))
        UNION ALL SELECT 'assessments', (SELECT count(*) FROM {{assessments}} WHERE trend_id IN (SELECT trend_id FROM kt))
        UNION ALL SELECT 'timepoints', (SELECT count(*) FROM {{timepoints}} WHERE topic_id IN (SELECT topic_id FROM kt))""",
)
def h31_tables(m):
    newest = m.occurrences.agg(F.max("run_id")).first()[0]
    names = ("runs", "trends", "occurrences", "assessments", "timepoints", "canonicals", "decisions")
    left = P.without_run({n: getattr(m, n) for n in names}, newest)
    left["linked_occurrences"] = left["occurrences"].where("canonical_id IS NOT NULL")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


BASELINES_SQL = "SELECT run_id AS source_run_id FROM {runs} WHERE run_id % 13 = 0"


@catalog.add(
    "h32_deletable_runs",
    f"""WITH b AS ({BASELINES_SQL}), x AS (SELECT r.run_id, CASE WHEN status = 'running' THEN 'running' WHEN r.run_id IN (SELECT source_run_id FROM b) THEN 'baseline_source'
        WHEN (r.run_id IN (SELECT run_id FROM {{trends}}) OR r.run_id IN (SELECT run_id FROM {{occurrences}})) AND {NEWEST} > r.run_id THEN 'newer_run_exists' END AS reason FROM {{runs}} r)
        SELECT run_id, reason IS NULL AS deletable, reason FROM x""",
)
def h32(m):
    baselines = m.runs.where("run_id % 13 = 0").select(F.col("run_id").alias("source_run_id"))
    return P.deletable(m.runs, m.trends, m.occurrences, baselines)


@catalog.add(
    "h33_orphan_documents",
    """WITH o AS (SELECT doc_id FROM {run_docs} GROUP BY 1 HAVING min(run_id) = (SELECT max(run_id) FROM {corpus_runs}))
        SELECT doc_id, CASE WHEN duplicate_of_id IN (SELECT doc_id FROM o) THEN NULL ELSE duplicate_of_id END AS duplicate_of_id FROM {docs} WHERE doc_id NOT IN (SELECT doc_id FROM o)""",
)
def h33(m):
    newest = m.corpus_runs.agg(F.max("run_id")).first()[0]
    gone = P.orphan_documents(newest, m.run_docs)
    return P.remove_documents(m.docs, gone).select("doc_id", "duplicate_of_id")


@catalog.add(
    "h34_retained_history",
    """WITH kr AS (SELECT run_id, CAST('2026-01-01' AS DATE) + CAST(run_id * 2 AS INT) AS s, finished_at - started_at AS dur FROM {runs} WHERE run_id % 7 IN (1, 3)),
        nr AS (SELECT run_id, coalesce(s + CAST(dur AS INT), s) AS day FROM kr),
        sp AS (SELECT canonical_id, min(run_id) AS f, max(run_id) AS l FROM {occurrences} WHERE canonical_id IS NOT NULL AND run_id IN (SELECT run_id FROM kr) GROUP BY 1)
        SELECT c.canonical_id, f AS first_run_id, l AS last_run_id, a.day AS created_at, b.day AS updated_at FROM {canonicals} c LEFT JOIN sp ON sp.canonical_id = c.canonical_id
        LEFT JOIN nr a ON a.run_id = f LEFT JOIN nr b ON b.run_id = l""",
)
def h34(m):
    kept = m.runs.where("run_id % 7 IN (1, 3)").selectExpr("run_id", "date_add(DATE'2026-01-01', CAST(run_id * 2 AS INT)) AS new_start")
    tables = P.retain_runs({"runs": m.runs, "trends": m.trends, "occurrences": m.occurrences}, kept.select("run_id"))
    runs = P.shift_runs(tables["runs"], kept)
    return P.rederive_spans(m.canonicals, tables["occurrences"], runs).select("canonical_id", "first_run_id", "last_run_id", "created_at", "updated_at")


@catalog.add(
    "h35_portfolio_sync",
    f"""WITH {PROP_SQL}, l AS (SELECT canonical_id, arg_max(trend_id, (run_id, occurrence_id)) AS trend_id FROM {{occurrences}} WHERE canonical_id IS NOT NULL GROUP BY 1)
        SELECT c.canonical_id, coalesce(p.title, c.title) AS title, coalesce(p.maturity, c.maturity) AS maturity, CASE WHEN p.assessed THEN p.pestel ELSE c.pestel END AS pestel,
            CASE WHEN p.assessed THEN p.impact ELSE c.impact END AS impact FROM {{canonicals}} c LEFT JOIN l ON l.canonical_id = c.canonical_id LEFT JOIN prop p ON p.trend_id = l.trend_id""",
)
def h35(m):
    return P.sync_portfolio(canon(m), m.occurrences, proposed(m)).select("canonical_id", "title", "maturity", joined("pestel"), "impact")


@catalog.add(
    "h36_baseline_seed",
    f"""WITH {PROP_SQL}, sp AS (SELECT trend_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY impact DESC NULLS LAST, trend_id) AS position FROM prop)
        SELECT 'baseline-1' AS snapshot_key, sp.position, sp.trend_id, 'Accepted ' || p.title AS title, p.title AS machine_title, p.impact AS machine_impact
        FROM sp JOIN prop p ON p.trend_id = sp.trend_id WHERE p.trend_id % 9 <> 0""",
)
def h36(m):
    from pyspark.sql import Window

    rows = proposed(m)
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc_nulls_last("impact"), "trend_id")).cast("bigint")
    spec = rows.select("trend_id", rank.alias("position"), F.concat(F.lit("Accepted "), F.col("title")).alias("title"),
                       F.lit(5.0).alias("relevance"), F.lit("known").alias("novelty"), F.lit(4.0).alias("traceability"))
    existing = rows.where("trend_id % 9 = 0").select(F.lit("baseline-1").alias("snapshot_key"), "trend_id")
    seeded = P.seed_baseline(spec, rows, existing, "baseline-1")
    return seeded.select(
        "snapshot_key", "position", "trend_id", "title", F.get_json_object("payload", "$.machine_title").alias("machine_title"),
        F.get_json_object("payload", "$.impact").cast("double").alias("machine_impact"),
    )


LEGACY_SQL = """CASE WHEN occurrence_id % 5 = 0 THEN 'review' WHEN occurrence_id % 5 = 1 THEN 'updated' WHEN occurrence_id % 5 = 2 THEN 'new' ELSE 'unchanged' END"""
LEGACY_FIELDS = "CASE WHEN occurrence_id % 2 = 0 THEN 'summary' ELSE 'title' END"


@catalog.add(
    "h37_legacy_backfill",
    f"""WITH o AS (SELECT occurrence_id, {LEGACY_SQL} AS k, {LEGACY_FIELDS} AS f, review_reason FROM {{occurrences}}),
        b AS (SELECT occurrence_id, k, CASE k WHEN 'review' THEN 'pending' WHEN 'new' THEN 'approved' ELSE 'not_required' END AS s, CASE WHEN k = 'review' THEN coalesce(review_reason, 'legacy_review') END AS r,
            CASE WHEN k = 'review' THEN 'classification_changed' WHEN k = 'updated' AND f = 'summary' THEN 'content_changed' WHEN k = 'updated' THEN 'classification_changed' ELSE k END AS t FROM o),
        u AS (SELECT *, t = 'new' AND s = 'approved' AND occurrence_id NOT IN (SELECT occurrence_id FROM {{decisions}} WHERE action = 'merge') AS reopen FROM b)
        SELECT occurrence_id, t AS change_type, CASE WHEN reopen THEN 'pending' ELSE s END AS review_status, CASE WHEN reopen THEN 'new_trend' ELSE r END AS review_reason FROM u""",
)
def h37(m):
    legacy = m.occurrences.withColumns({"change_type": F.expr(LEGACY_SQL), "changed_fields": F.expr(LEGACY_FIELDS)})
    rows = P.reopen_undecided(P.backfill_legacy(legacy), m.decisions.where("action = 'merge'"))
    return rows.select("occurrence_id", "change_type", "review_status", "review_reason")


# ---------------------------------------------------------------- dashboard views

SECTOR_SQL = "coalesce(list_position(['environmental', 'technological', 'social', 'legal', 'political', 'economic'], split_part(pestel, ',', 1)) - 1, 1)"


@catalog.add(
    "h38_radar_layout",
    f"""WITH {OVERLAY_SQL}, s AS (SELECT id, size, CAST(CASE WHEN {SECTOR_SQL} < 0 THEN 1 ELSE {SECTOR_SQL} END AS INT) AS sector, coalesce(radar_stage, 'watch') AS ring,
            list_reduce(list_transform(string_split(id, ''), lambda ch: CAST(unicode(ch) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296, 7) AS seed FROM ol),
        i AS (SELECT *, row_number() OVER (PARTITION BY sector, ring ORDER BY size, seed, id) - 1 AS ix, count(*) OVER (PARTITION BY sector, ring) AS n, max(size) OVER () AS mx FROM s),
        a AS (SELECT *, radians(sector * 60 + (0.06e0 + 0.88e0 * ((ix + 1) / (n + 1))) * 60 - 90) AS turn, (CASE ring WHEN 'act' THEN 0.14e0 WHEN 'prepare' THEN 0.4e0 ELSE 0.7e0 END
            + CASE ring WHEN 'act' THEN 0.22e0 WHEN 'prepare' THEN 0.26e0 ELSE 0.28e0 END * CASE WHEN n = 1 THEN 0.5e0 ELSE 0.12e0 + 0.76e0 * ((ix + 0.5e0) / n) END) * 330 AS rad FROM i)
        SELECT id, sector, ring, round(360 + rad * cos(turn), 4) AS x, round(360 + rad * sin(turn), 4) AS y, round(6 + size / mx * 12, 4) AS r FROM a""",
)
def h38(m):
    rows = W.radar_layout(overlay(m))
    return rows.select("id", "sector", "ring", *[F.round(c, 4).alias(c) for c in ("x", "y", "r")])


@catalog.add(
    "h39_faceted_filter",
    f"""WITH {PROP_SQL} SELECT trend_id, maturity, pestel, region FROM prop WHERE maturity IN ('emerging', 'megatrend') AND region = 'Asia'
        AND list_has_any(string_split(coalesce(pestel, ''), ','), ['legal', 'social'])""",
)
def h39(m):
    rows = W.faceted(proposed(m), ("emerging", "megatrend"), ("legal", "social"), "Asia")
    return rows.select("trend_id", "maturity", joined("pestel"), "region")


@catalog.add("h39_region_facet", "SELECT DISTINCT region FROM {trends} WHERE region <> ''")
def h39_regions(m):
    return W.region_facet(m.trends)


@catalog.add(
    "h40_text_search",
    "SELECT trend_id FROM {trends} WHERE contains(lower(title), 'solar') OR contains(lower(summary), 'solar') OR contains(lower(keywords), 'solar')",
)
def h40(m):
    return W.search(proposed(m), " Solar ").select("trend_id")


@catalog.add(
    "h40_kanban",
    f"WITH {OVERLAY_SQL} SELECT maturity, count(*) AS n, CAST(list_position(['megatrend', 'established', 'emerging', 'weak_signal'], maturity) AS INT) AS col FROM ol GROUP BY 1",
)
def h40_kanban(m):
    return W.kanban(overlay(m))


@catalog.add(
    "h41_dashboard",
    f"""WITH {OVERLAY_SQL}, d AS (SELECT *, pending_review AND status = 'review' AS prov FROM ol), e AS (SELECT 'active' AS metric, 'all' AS value FROM d WHERE NOT prov
            UNION ALL SELECT 'pending', 'all' FROM d WHERE pending_review UNION ALL SELECT 'pending_new', 'all' FROM d WHERE prov
            UNION ALL SELECT 'act', CASE WHEN prov THEN 'pending' ELSE 'active' END FROM d WHERE radar_stage = 'act' UNION ALL SELECT 'maturity', maturity FROM d WHERE NOT prov AND maturity IS NOT NULL
            UNION ALL SELECT 'pestel', unnest(string_split(pestel, ',')) FROM d WHERE NOT prov)
        SELECT metric, value, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'pending_run', 'newest', max(pending_run_id) FROM d""",
)
def h41(m):
    return W.dashboard(overlay(m))


@catalog.add(
    "h42_run_page_groups",
    f"""WITH {RUN_DIFF_SQL} SELECT run_id, CASE change_type WHEN 'new' THEN 'new' WHEN 'evidence_only' THEN 'evidence' ELSE 'reclassified' END AS page_group, count(*) AS n FROM rd
        WHERE review_status <> 'pending' AND change_type <> 'unchanged' GROUP BY ALL""",
)
def h42(m):
    return W.run_page_groups(P.run_diff(occ(m), proposed(m)))


@catalog.add(
    "h43_distinct_evidence",
    """SELECT canonical_id, e.title, e.url, min((o.run_id, o.occurrence_id, e.ord))[1] AS run_id, min((o.run_id, o.occurrence_id, e.ord))[2] AS occurrence_id
        FROM {occurrences} o JOIN {evidence} e ON e.trend_id = o.trend_id WHERE canonical_id IS NOT NULL AND e.title <> '' GROUP BY 1, 2, 3""",
)
def h43(m):
    entries = m.occurrences.where("canonical_id IS NOT NULL").select("canonical_id", "run_id", "occurrence_id", "trend_id")
    titled = m.evidence.where("title <> ''").select("trend_id", "title", "url")
    # The place within the occurrence breaks ties that no returned column shows, so evidence need not be numbered for it.
    return W.distinct_evidence(join_in_groups(titled, entries, "trend_id"), "canonical_id", ["run_id", "occurrence_id"])


@catalog.add(
    "h44_translation_sync",
    f"""WITH {REVIEW_SQL}, {PROP_SQL}, ac AS (SELECT decided_id AS canonical_id, arg_max({{'t': o_trend_id, 'e': CASE WHEN action = 'correct' THEN new_title END}}, decision_key) AS a FROM rr
            WHERE outcome = 'applied' AND action IN ('confirm', 'correct', 'create') GROUP BY 1),
        b AS (SELECT ac.canonical_id, l.language, coalesce(a.e, '') <> '' AS ed, a.e AS e, CASE WHEN x.trend_id IS NOT NULL THEN x.title ELSE p.title END AS title, CASE WHEN x.trend_id IS NOT NULL THEN x.summary ELSE p.summary END AS summary,
            coalesce(nullif(x.rationale, ''), p.rationale) AS rationale FROM ac JOIN prop p ON p.trend_id = a.t CROSS JOIN (VALUES ('de'), ('en')) l(language) LEFT JOIN {{translations}} x ON x.trend_id = p.trend_id AND x.language = l.language),
        sup AS (SELECT DISTINCT new_title AS text, 'Bearbeitet: ' || new_title AS translated FROM {{decisions}} WHERE new_title LIKE '%solar%' OR new_title LIKE '%glass%')
        SELECT b.canonical_id, b.language, CASE WHEN NOT b.ed THEN b.title WHEN b.language = 'en' THEN b.e ELSE coalesce(sup.translated, b.e) END AS title,
            CASE WHEN b.ed THEN en.summary ELSE b.summary END AS summary, CASE WHEN b.ed THEN en.rationale ELSE b.rationale END AS rationale
        FROM b JOIN b en ON en.canonical_id = b.canonical_id AND en.language = 'en' LEFT JOIN sup ON sup.text = b.e
        UNION ALL SELECT c.canonical_id, l.language, c.title, c.summary, NULL FROM {{canonicals}} c CROSS JOIN (VALUES ('de'), ('en')) l(language) WHERE c.canonical_id NOT IN (SELECT canonical_id FROM ac)""",
)
def h44(m):
    return P.sync_translations(outcomes(m), P.base_texts(m.canonicals), review_texts(m), supplied_titles(m.decisions), order=tuple(ORDER))


def review_texts(m):
    return G.resolve_texts(m.trends.join(m.assessments.select("trend_id", "rationale"), "trend_id", "left"), m.translations)


def supplied_titles(decisions):
    """Translations of the edited titles about solar or glass."""
    none = F.lit(None).cast("string")
    known = decisions.where("new_title LIKE '%solar%' OR new_title LIKE '%glass%'")
    return known.groupBy(*ORDER).agg(F.concat(F.lit("Bearbeitet: "), F.min("new_title")).alias("title")).withColumns({"summary": none, "rationale": none})


EDITS = {
    "edit_language": "CASE WHEN decision_key % 2 = 0 THEN 'de' ELSE 'en' END",
    "new_summary": "CASE WHEN decision_key % 5 < 2 THEN 'Summary of ' || new_title END",
}


@catalog.add(
    "h44_translation_edits",
    f"""WITH {REVIEW_SQL}, {PROP_SQL}, ac AS (SELECT decided_id AS canonical_id, max(decision_key) AS k, arg_max({{'t': o_trend_id, 'e': CASE WHEN action = 'correct' THEN nullif(new_title, '') END}}, decision_key) AS a FROM rr
            WHERE outcome = 'applied' AND action IN ('confirm', 'correct', 'create') GROUP BY 1),
        ed AS (SELECT canonical_id, a.t AS trend_id, a.e AS e, CASE WHEN k % 5 < 2 THEN 'Summary of ' || a.e END AS s, CASE WHEN k % 2 = 0 THEN 'de' ELSE 'en' END AS lang FROM ac),
        b AS (SELECT ed.*, l.language, CASE WHEN x.trend_id IS NOT NULL THEN x.title ELSE p.title END AS title, CASE WHEN x.trend_id IS NOT NULL THEN x.summary ELSE p.summary END AS summary,
            coalesce(nullif(x.rationale, ''), p.rationale) AS rationale FROM ed JOIN prop p ON p.trend_id = ed.trend_id CROSS JOIN (VALUES ('de'), ('en')) l(language)
            LEFT JOIN {{translations}} x ON x.trend_id = p.trend_id AND x.language = l.language)
        SELECT b.canonical_id, b.language, CASE WHEN b.e IS NULL THEN b.title WHEN b.language = b.lang THEN b.e WHEN b.e LIKE '%solar%' OR b.e LIKE '%glass%' THEN 'Bearbeitet: ' || b.e ELSE b.e END AS title,
            CASE WHEN b.e IS NULL THEN b.summary ELSE coalesce(b.s, o.summary) END AS summary, CASE WHEN b.e IS NULL THEN b.rationale ELSE o.rationale END AS rationale
        FROM b JOIN b o ON o.canonical_id = b.canonical_id AND o.language = b.lang
        UNION ALL SELECT c.canonical_id, l.language, c.title, c.summary, NULL FROM {{canonicals}} c CROSS JOIN (VALUES ('de'), ('en')) l(language) WHERE c.canonical_id NOT IN (SELECT canonical_id FROM ac)""",
)
def h44_edits(m):
    """Reviewers of both languages, some also with a new summary."""
    rows = outcomes(m).withColumns({c: F.expr(e) for c, e in EDITS.items()})
    return P.sync_translations(rows, P.base_texts(m.canonicals), review_texts(m), supplied_titles(m.decisions), order=tuple(ORDER))
