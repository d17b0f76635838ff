"""Registered queries G1-G21."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.catalog.model import Catalog, word
from trendloom.constants import CATEGORY_LEXICON, PESTEL_LEXICON
from trendloom.functions.text import signal_tokens
from trendloom.operators import assess as G
from trendloom.operators import series as S

catalog = Catalog()

# Frequent words of the test texts stand in for indicator terms.
TEST_LEXICON = {
    "political": ("the", "and", "with", "this"), "economic": ("les", "des", "dans", "pour"),
    "social": ("der", "die", "und", "nicht"), "technological": ("que", "los", "una", "para"),
    "environmental": ("here", "her", "sur"), "legal": ("paragraph",),
}
LABELS = (("the", "Artikel"), ("der", "Artikel"), ("die", "Artikel"), ("les", "Artikel"), ("and", "Bindewort"), ("und", "Bindewort"))


def table_sql(lexicon, name: str) -> str:
    rows = ", ".join(f"('{k}', '{t}', {i})" for i, (k, ts) in enumerate(lexicon.items()) for t in ts)
    return f"{name} AS (SELECT * FROM (VALUES {rows}) x(k, t, o))"


EVIDENCE_TITLES = "ev AS (SELECT trend_id, list(title ORDER BY ord) AS titles FROM {evidence} WHERE title <> '' GROUP BY 1)"
BASE_SQL = f"""{EVIDENCE_TITLES}, b AS (SELECT t.*, string_split(keywords, ',') AS kw, coalesce(titles, []) AS titles
    FROM {{trends}} t LEFT JOIN ev ON ev.trend_id = t.trend_id)"""
TOKENS_SQL = """tok AS (SELECT b.*, list_distinct(regexp_extract_all(lower(concat_ws(' ', array_to_string(kw, ' '), title,
    coalesce(summary, ''), array_to_string(titles, ' '))), '[a-z0-9äöüß-]+')) AS tokens FROM b)"""
CATEGORY_SQL = f"""{table_sql(CATEGORY_LEXICON, 'clx')}, tt AS (SELECT trend_id, unnest(tokens) AS t FROM tok),
    ch AS (SELECT trend_id, k, o, count(*) AS n FROM tt JOIN clx ON clx.t = tt.t GROUP BY ALL),
    ca AS (SELECT trend_id, arg_max(k, (n, -o)) AS category FROM ch GROUP BY 1),
    cat AS (SELECT tok.*, coalesce(category, 'technology') AS category FROM tok LEFT JOIN ca ON ca.trend_id = tok.trend_id)"""
PESTEL_SQL = f"""{table_sql(PESTEL_LEXICON, 'plx')},
    ph AS (SELECT trend_id, k, count(*) AS n FROM tt JOIN plx ON plx.t = tt.t GROUP BY ALL),
    pm AS (SELECT *, max(n) OVER (PARTITION BY trend_id) AS top FROM ph),
    pr AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY n DESC, k) AS rn FROM pm WHERE n >= greatest(1, round_even(CAST(top * 0.45 AS DOUBLE), 0))),
    pl AS (SELECT trend_id, string_agg(k, ',' ORDER BY rn) AS pestel FROM pr WHERE rn <= 3 GROUP BY 1),
    lab AS (SELECT cat.*, coalesce(pestel, CASE category WHEN 'climate' THEN 'environmental' WHEN 'markets' THEN 'economic' ELSE 'technological' END) AS pestel
        FROM cat LEFT JOIN pl ON pl.trend_id = cat.trend_id)"""
SOURCES_SQL = "src AS (SELECT topic_id, greatest(count(DISTINCT source_id), 1) AS n_sources FROM {topic_docs} WHERE NOT is_outlier GROUP BY 1)"
POINTS_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY period) AS rn, count(*) OVER (PARTITION BY topic_id) AS n FROM {timepoints}),
    h AS (SELECT topic_id, count(*) AS periods, coalesce(sum(doc_count) FILTER (rn <= n // 2), 0) AS older, coalesce(sum(doc_count) FILTER (rn > n // 2), 0) AS recent FROM r GROUP BY 1),
    gr AS (SELECT topic_id, periods, CASE WHEN periods >= 2 THEN greatest(0.0, CAST(recent - CASE WHEN older = 0 THEN 1 ELSE older END AS DOUBLE)
        / CASE WHEN older = 0 THEN 1 ELSE older END) ELSE 0.0 END AS g FROM h)"""
SCORES_SQL = """sc AS (SELECT b.trend_id, b.maturity, b.size, coalesce(n_sources, 1) AS n_sources, coalesce(g, 0.0) AS g,
        greatest(1.0, least(10.0, CASE b.maturity WHEN 'weak_signal' THEN 3e0 WHEN 'emerging' THEN 5.5e0 WHEN 'established' THEN 7e0 ELSE 9e0 END + least(2e0, b.size / 10.0))) AS impact,
        greatest(1.0, least(10.0, 4e0 + least(4e0, coalesce(g, 0.0) * 4) + coalesce(emergence * 2, 0.0))) AS urgency,
        greatest(1.0, least(10.0, 6e0 - least(3, coalesce(n_sources, 1)) + coalesce(emergence * 3, 0.0))) AS uncertainty
    FROM b LEFT JOIN src ON src.topic_id = b.topic_id LEFT JOIN gr ON gr.topic_id = b.topic_id)"""


def stage_sql(i: str, u: str) -> str:
    return f"CASE WHEN {i} >= 7 AND {u} >= 6 THEN 'act' WHEN {i} >= 5.5 OR {u} >= 6.5 THEN 'prepare' ELSE 'watch' END"


def base(m):
    """Trends with keyword array and ordered evidence titles."""
    titles = m.evidence.where("title <> ''").groupBy("trend_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("titles")
    )
    rows = m.trends.withColumn("keywords", F.split("keywords", ",")).join(titles, "trend_id", "left")
    return rows.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def tokenised(m):
    return base(m).withColumn("tokens", signal_tokens(F.col("keywords"), F.col("title"), F.col("summary"), F.col("titles")))


def signals(m):
    sources = G.source_counts(m.topic_docs).select("topic_id", "n_sources")
    grown = S.growth(m.timepoints, ["topic_id"]).select("topic_id", "growth", F.col("span").alias("periods"))
    rows = tokenised(m).join(sources, "topic_id", "left").join(grown, "topic_id", "left")
    return rows.na.fill({"n_sources": 1, "growth": 0.0, "periods": 0})


@catalog.add(
    "g1_template_text",
    f"""WITH {BASE_SQL} SELECT trend_id, array_to_string(list_transform(kw[1:3], lambda k: upper(k[1:1]) || lower(k[2:])), ', ') AS title,
        'This trend centers on ' || array_to_string(kw[1:5], ', ') || '.' || CASE WHEN len(titles) > 0
            THEN ' Representative sources: ' || array_to_string(titles[1:3], '; ') || '.' ELSE '' END AS summary FROM b""",
)
def g1(m):
    rows = base(m)
    return rows.select(
        "trend_id", G.template_title(F.col("keywords")).alias("title"), G.template_summary(F.col("keywords"), F.col("titles")).alias("summary")
    )


@catalog.add(
    "g2_evidence_list",
    """SELECT trend_id, string_agg(title || '|' || coalesce(url, '-'), ';' ORDER BY ord) AS evidence FROM {evidence} WHERE title <> '' GROUP BY 1""",
)
def g2(m):
    items = m.evidence.groupBy("trend_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "url"))).alias("items"))
    kept = items.select("trend_id", G.titled(F.col("items")).alias("evidence")).where(F.size("evidence") > 0)
    return kept.select(
        "trend_id",
        F.array_join(F.transform("evidence", lambda e: F.concat(e["title"], F.lit("|"), F.coalesce(e["url"], F.lit("-")))), ";").alias("evidence"),
    )


@catalog.add(
    "g3_signal_tokens",
    f"WITH {BASE_SQL}, {TOKENS_SQL} SELECT trend_id, array_to_string(list_sort(tokens), ' ') AS tokens FROM tok",
)
def g3(m):
    return tokenised(m).select("trend_id", F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


@catalog.add("g4_category", f"WITH {BASE_SQL}, {TOKENS_SQL}, {CATEGORY_SQL} SELECT trend_id, category FROM cat")
def g4(m):
    return tokenised(m).select("trend_id", G.category(F.col("tokens")).alias("category"))


@catalog.add("g5_pestel", f"WITH {BASE_SQL}, {TOKENS_SQL}, {CATEGORY_SQL}, {PESTEL_SQL} SELECT trend_id, category, pestel FROM lab")
def g5(m):
    rows = tokenised(m).withColumn("category", G.category(F.col("tokens")))
    return rows.select("trend_id", "category", F.array_join(G.pestel(F.col("tokens"), F.col("category")), ",").alias("pestel"))


@catalog.add(
    "g6_scores",
    f"""WITH {BASE_SQL}, {SOURCES_SQL}, {POINTS_SQL}, {SCORES_SQL}
        SELECT trend_id, round(impact, 6) AS impact, round(urgency, 6) AS urgency, round(uncertainty, 6) AS uncertainty FROM sc""",
)
def g6(m):
    rows = G.assess(signals(m))
    return rows.select("trend_id", *[F.round(c, 6).alias(c) for c in ("impact", "urgency", "uncertainty")])


@catalog.add("g7_radar_stage", f"SELECT trend_id, {stage_sql('impact', 'urgency')} AS stage FROM {{assessments}}")
def g7(m):
    return m.assessments.select("trend_id", G.radar_stage(F.col("impact"), F.col("urgency")).alias("stage"))


@catalog.add(
    "g8_rationale",
    f"""WITH {BASE_SQL}, {SOURCES_SQL}, {POINTS_SQL}, {SCORES_SQL} SELECT trend_id, 'Heuristic: maturity=' || maturity || ', size='
        || CAST(size AS STRING) || ', sources=' || CAST(n_sources AS STRING) || ', growth=' || printf('%.2f', g) || '.' AS rationale FROM sc""",
)
def g8(m):
    return G.assess(signals(m)).select("trend_id", "rationale")


JUDGED_SQL = f"""j AS (SELECT trend_id, CASE WHEN size % 2 = 0 THEN 'legal,unknown,social,economic,political' ELSE 'nothing' END AS jp,
        CASE WHEN size % 3 = 0 THEN 'markets' WHEN size % 3 = 1 THEN 'space' END AS jc, CASE WHEN size % 5 = 0 THEN 'high' WHEN size % 5 = 1 THEN NULL
        ELSE CAST(size AS STRING) END AS ji, CAST(size % 7 AS STRING) AS ju, '12.5' AS jn, ' because ' || {word('size')} || ' ' AS jr
    FROM {{trends}} WHERE size % 4 <> 0)"""


@catalog.add(
    "g9_blended_judgement",
    f"""WITH {JUDGED_SQL}, x AS (SELECT a.*, j.*, j.trend_id IS NOT NULL AND TRY_CAST(coalesce(ji, '5') AS DOUBLE) IS NOT NULL AS ok
            FROM {{assessments}} a LEFT JOIN j ON j.trend_id = a.trend_id)
        SELECT trend_id, CASE WHEN ok AND jp LIKE 'legal%' THEN 'legal,social,economic' ELSE pestel END AS pestel,
            CASE WHEN ok AND jc = 'markets' THEN jc ELSE category END AS category,
            round(CASE WHEN ok THEN greatest(1.0, least(10.0, 0.6e0 * greatest(1.0, least(10.0, TRY_CAST(coalesce(ji, '5') AS DOUBLE))) + 0.4e0 * impact)) ELSE impact END, 6) AS impact,
            round(CASE WHEN ok THEN 0.5e0 * greatest(1.0, least(10.0, CAST(ju AS DOUBLE))) + 0.5e0 * urgency ELSE urgency END, 6) AS urgency,
            round(CASE WHEN ok THEN least(10.0, 5e0 + 0.5e0 * uncertainty) ELSE uncertainty END, 6) AS uncertainty,
            CASE WHEN ok THEN trim(jr) ELSE rationale END AS rationale FROM x""",
)
def g9(m):
    judged = m.trends.where("size % 4 <> 0").select(
        "trend_id",
        F.split(F.when(F.col("size") % 2 == 0, "legal,unknown,social,economic,political").otherwise("nothing"), ",").alias("pestel"),
        F.when(F.col("size") % 3 == 0, "markets").when(F.col("size") % 3 == 1, "space").alias("category"),
        F.when(F.col("size") % 5 == 0, "high").when(F.col("size") % 5 == 1, None).otherwise(F.col("size").cast("string")).alias("impact"),
        (F.col("size") % 7).cast("string").alias("urgency"), F.lit("12.5").alias("uncertainty"),
        F.concat(F.lit(" because "), F.expr(word("size")), F.lit(" ")).alias("rationale"),
    )
    rows = G.blend(m.assessments.withColumn("pestel", F.split("pestel", ",")), judged)
    return rows.select(
        "trend_id", F.array_join("pestel", ",").alias("pestel"), "category",
        *[F.round(c, 6).alias(c) for c in ("impact", "urgency", "uncertainty")], "rationale",
    )


@catalog.add(
    "g10_budget_routing",
    """SELECT run_id, trend_id, step, CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY trend_id, step) <= 50
        THEN 'external' ELSE 'fallback' END AS route FROM {trends}, (VALUES (1), (2)) s(step)""",
)
def g10(m):
    return G.route_calls(m.trends, 50, "trend_id")


@catalog.add(
    "g11_source_counts",
    "SELECT run_id, topic_id, greatest(count(DISTINCT source_id), 1) AS n_sources FROM {topic_docs} WHERE NOT is_outlier GROUP BY ALL",
)
def g11(m):
    return G.source_counts(m.topic_docs)


HITS_SQL = f"""{table_sql(TEST_LEXICON, 'lx')},
    dk AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(title || ' ' || text, '[a-zA-Z][a-zA-Z-]{{2,}}'), lambda t: lower(t)))) AS t FROM {{docs}}),
    hit AS (SELECT doc_id, k AS dimension, dk.t AS term FROM dk JOIN lx ON lx.t = dk.t),
    mem AS (SELECT run_id, topic_index, doc_id, published_at FROM {{run_docs}} WHERE topic_index >= 0)"""


def pestel_inputs(m):
    members = m.run_docs.where("topic_index >= 0").select("run_id", "topic_index", "doc_id", "published_at")
    return members, G.lexicon_hits(m.docs, TEST_LEXICON)


@catalog.add(
    "g12_dimension_coverage",
    f"""WITH {HITS_SQL}, tot AS (SELECT run_id, topic_index, count(*) AS total FROM mem GROUP BY ALL),
        mt AS (SELECT run_id, topic_index, dimension, count(DISTINCT mem.doc_id) AS matched FROM mem JOIN hit ON hit.doc_id = mem.doc_id GROUP BY ALL)
        SELECT tot.run_id, tot.topic_index, d.k AS dimension, total, coalesce(matched, 0) AS matched,
            round_even(least(10.0, 10 * sqrt(CAST(coalesce(matched, 0) AS DOUBLE) / total)), 1) AS relevance
        FROM tot CROSS JOIN (SELECT DISTINCT k FROM lx) d LEFT JOIN mt ON mt.run_id = tot.run_id AND mt.topic_index = tot.topic_index AND mt.dimension = d.k""",
)
def g12(m):
    members, hits = pestel_inputs(m)
    return G.dimension_coverage(members, hits).select("run_id", "topic_index", "dimension", "total", "matched", "relevance")


TERMS_SQL = f"""{HITS_SQL}, tc AS (SELECT run_id, topic_index, dimension, term, count(*) AS n_docs FROM mem JOIN hit ON hit.doc_id = mem.doc_id GROUP BY ALL),
    st AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, topic_index, dimension ORDER BY n_docs DESC, term) AS INT) AS rank FROM tc QUALIFY rank <= 5)"""


@catalog.add("g13_signal_terms", f"WITH {TERMS_SQL} SELECT * FROM st")
def g13(m):
    return G.signal_terms(*pestel_inputs(m))


@catalog.add(
    "g14_dimension_evidence",
    f"""WITH {HITS_SQL}, n AS (SELECT doc_id, dimension, CAST(count(*) AS INT) AS n_terms FROM hit GROUP BY ALL)
        SELECT run_id, topic_index, dimension, mem.doc_id, n_terms, CAST(row_number() OVER (PARTITION BY run_id, topic_index, dimension
            ORDER BY n_terms DESC, published_at DESC NULLS LAST, mem.doc_id) AS INT) AS rank FROM mem JOIN n ON n.doc_id = mem.doc_id QUALIFY rank <= 3""",
)
def g14(m):
    return G.dimension_evidence(*pestel_inputs(m)).select("run_id", "topic_index", "dimension", "doc_id", "n_terms", "rank")


@catalog.add(
    "g15_analysis_corpus",
    f"""WITH own AS (SELECT t.topic_id AS trend_id, CAST(doc_id AS STRING) AS item, 'Paper ' || {word('doc_id')} AS title
            FROM {{topic_docs}} t WHERE NOT is_outlier AND topic_id % 3 > 0)
        SELECT * FROM own UNION ALL SELECT trend_id, 'e' || CAST(ord AS STRING), title FROM {{evidence}} e
        WHERE title <> '' AND trend_id IN (SELECT trend_id FROM {{trends}}) AND NOT EXISTS (SELECT 1 FROM own WHERE own.trend_id = e.trend_id)""",
)
def g15(m):
    title = F.concat(F.lit("Paper "), F.expr(word("doc_id")))
    own = m.topic_docs.where("NOT is_outlier AND topic_id % 3 > 0").select(
        F.col("topic_id").alias("trend_id"), "doc_id", title.alias("title"), title.alias("text"), "published_at"
    )
    return G.analysis_corpus(m.trends, own, m.evidence).select("trend_id", "item", "title")


@catalog.add(
    "g16_localized_terms",
    f"""WITH {TERMS_SQL}, lb(term, label) AS (VALUES {", ".join(str(x) for x in LABELS)})
        SELECT run_id, topic_index, dimension, coalesce(label, st.term) AS label, min(rank) AS rank FROM st LEFT JOIN lb ON lb.term = st.term GROUP BY ALL""",
)
def g16(m):
    labels = m.spark.createDataFrame(LABELS, "term string, label string")
    return G.localize_terms(G.signal_terms(*pestel_inputs(m)), labels, ["run_id", "topic_index", "dimension"])


def trend_texts(m):
    return m.trends.join(m.assessments.select("trend_id", "rationale"), "trend_id", "left")


@catalog.add(
    "g17_resolved_texts",
    """SELECT t.trend_id, l.language, CASE WHEN x.trend_id IS NOT NULL THEN x.title ELSE t.title END AS title,
        CASE WHEN x.trend_id IS NOT NULL THEN x.summary ELSE t.summary END AS summary, coalesce(nullif(x.rationale, ''), a.rationale) AS rationale
        FROM {trends} t CROSS JOIN (VALUES ('de'), ('en')) l(language) LEFT JOIN {assessments} a ON a.trend_id = t.trend_id
        LEFT JOIN {translations} x ON x.trend_id = t.trend_id AND x.language = l.language""",
)
def g17(m):
    maps = G.translation_maps(G.resolve_texts(trend_texts(m), m.translations))
    return maps.select("trend_id", F.explode("translations").alias("language", "x")).select("trend_id", "language", "x.*")


@catalog.add(
    "g18_calibrated_scores",
    f"""WITH p AS (SELECT a.trend_id, impact, urgency, uncertainty, size, emergence FROM {{assessments}} a JOIN {{trends}} t ON t.trend_id = a.trend_id),
        r AS (SELECT *, row_number() OVER (ORDER BY coalesce(impact, 0), size, trend_id) - 1 AS i, row_number() OVER (ORDER BY coalesce(urgency, 0), coalesce(emergence, 0), trend_id) - 1 AS u, count(*) OVER () AS n FROM p),
        v AS (SELECT trend_id, round_even(3.2e0 + 6.3e0 * i / (n - 1), 1) AS impact, round_even(3.2e0 + 6.3e0 * u / (n - 1), 1) AS urgency, round_even(uncertainty, 1) AS uncertainty FROM r)
        SELECT *, {stage_sql('impact', 'urgency')} AS radar_stage FROM v""",
)
def g18(m):
    rows = m.assessments.join(m.trends.select("trend_id", "size", "emergence"), "trend_id")
    return G.calibrate(rows).select("trend_id", "impact", "urgency", "uncertainty", "radar_stage")


@catalog.add(
    "g19_reassessment",
    f"""WITH td AS (SELECT d.*, 'Paper ' || {word('doc_id')} AS title FROM {{topic_docs}} d WHERE NOT is_outlier),
        o AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY published_at DESC, doc_id, source_id) AS rank FROM td),
        ev AS (SELECT topic_id, list(title ORDER BY rank) AS titles, count(DISTINCT source_id) AS n_sources FROM o WHERE rank <= 12 GROUP BY 1),
        src AS (SELECT topic_id, count(DISTINCT source_id) AS n_sources FROM o GROUP BY 1),
        b0 AS (SELECT t.trend_id, t.topic_id, maturity, emergence, size, string_split(keywords, ',') AS kw, coalesce(titles, []) AS titles FROM {{trends}} t LEFT JOIN ev ON ev.topic_id = t.topic_id),
        b AS (SELECT *, array_to_string(list_transform(kw[1:3], lambda k: upper(k[1:1]) || lower(k[2:])), ', ') AS title, 'This trend centers on ' || array_to_string(kw[1:5], ', ') || '.'
            || CASE WHEN len(titles) > 0 THEN ' Representative sources: ' || array_to_string(titles[1:3], '; ') || '.' ELSE '' END AS summary FROM b0),
        {TOKENS_SQL}, {CATEGORY_SQL}, {PESTEL_SQL}, {POINTS_SQL}, {SCORES_SQL}
        SELECT lab.trend_id, lab.title, category, pestel, round(impact, 6) AS impact, round(urgency, 6) AS urgency, round(uncertainty, 6) AS uncertainty,
            {stage_sql('impact', 'urgency')} AS radar_stage FROM lab JOIN sc ON sc.trend_id = lab.trend_id""",
)
def g19(m):
    docs = m.topic_docs.withColumn("title", F.concat(F.lit("Paper "), F.expr(word("doc_id")))).withColumn("tie", F.col("source_id"))
    newest = G.representative_documents(docs, 12).groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles")
    )
    rows = m.trends.drop("title", "summary").withColumn("keywords", F.split("keywords", ",")).join(newest, "topic_id", "left")
    rows = rows.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    rows = rows.withColumn("title", G.template_title(F.col("keywords"))).withColumn("summary", G.template_summary(F.col("keywords"), F.slice("titles", 1, 8)))
    rows = rows.withColumn("tokens", signal_tokens(F.col("keywords"), F.col("title"), F.col("summary"), F.col("titles")))
    grown = S.growth(m.timepoints, ["topic_id"]).select("topic_id", "growth", F.col("span").alias("periods"))
    rows = rows.join(G.source_counts(m.topic_docs).select("topic_id", "n_sources"), "topic_id", "left").join(grown, "topic_id", "left")
    scored = G.assess(rows.na.fill({"n_sources": 1, "growth": 0.0, "periods": 0}))
    return scored.select(
        "trend_id", "title", "category", F.array_join("pestel", ",").alias("pestel"),
        *[F.round(c, 6).alias(c) for c in ("impact", "urgency", "uncertainty")], "radar_stage",
    )


@catalog.add(
    "g19_evidence_fallback",
    f"""WITH o AS (SELECT topic_id, 'Paper ' || {word('doc_id')} AS title, row_number() OVER (PARTITION BY topic_id ORDER BY published_at DESC, doc_id, source_id) AS rank
            FROM {{topic_docs}} WHERE NOT is_outlier AND topic_id % 3 <> 0),
        own AS (SELECT topic_id, string_agg(title, '|' ORDER BY rank) AS titles FROM o WHERE rank <= 8 GROUP BY 1),
        ev AS (SELECT trend_id, string_agg(title, '|' ORDER BY ord) AS titles FROM {{evidence}} WHERE title <> '' GROUP BY 1)
        SELECT t.trend_id, coalesce(own.titles, ev.titles, '') AS titles, own.titles IS NULL AND ev.titles IS NOT NULL AS from_evidence
        FROM {{trends}} t LEFT JOIN own ON own.topic_id = t.topic_id LEFT JOIN ev ON ev.trend_id = t.trend_id""",
)
def g19_fallback(m):
    """Every third topic has lost its documents: its trends are judged by their stored evidence."""
    docs = m.topic_docs.where("topic_id % 3 <> 0").withColumn("title", F.concat(F.lit("Paper "), F.expr(word("doc_id")))).withColumn("tie", F.col("source_id"))
    return G.representative_titles(m.trends, docs, m.evidence).withColumn("titles", F.array_join("titles", "|"))


@catalog.add(
    "g20_chart_data",
    """WITH tp AS (SELECT topic_id, string_agg(period || ':' || CAST(doc_count AS STRING), ',' ORDER BY period) AS points FROM {timepoints} GROUP BY 1)
        SELECT t.run_id, t.trend_id, t.title, t.maturity, a.impact, a.uncertainty, a.radar_stage, points, CAST(row_number() OVER (PARTITION BY t.run_id
            ORDER BY coalesce(impact, 0) DESC, coalesce(uncertainty, 0) DESC, t.trend_id) AS INT) AS ord
        FROM {trends} t LEFT JOIN {assessments} a ON a.trend_id = t.trend_id LEFT JOIN tp ON tp.topic_id = t.topic_id""",
)
def g20(m):
    rows = G.chart_data(m.trends, m.assessments, m.timepoints)
    points = F.array_join(F.transform("timepoints", lambda p: F.concat(p["period"], F.lit(":"), p["doc_count"].cast("string"))), ",")
    return rows.select("run_id", "trend_id", "title", "maturity", "impact", "uncertainty", "radar_stage", points.alias("points"), "ord")


FACETS_SQL = """ta AS (SELECT t.run_id, t.maturity, a.radar_stage, a.category, a.pestel FROM {trends} t LEFT JOIN {assessments} a ON a.trend_id = t.trend_id),
    simple AS (SELECT run_id, unnest(['maturity', 'radar_stage', 'category']) AS facet, unnest([maturity, radar_stage, category]) AS value FROM ta)"""


def assessed(m):
    return m.trends.join(m.assessments.withColumn("pestel", F.split("pestel", ",")), "trend_id", "left")


@catalog.add(
    "g21_distributions",
    f"""WITH {FACETS_SQL} SELECT run_id, facet, value, count(*) AS n FROM (SELECT * FROM simple UNION ALL
        SELECT run_id, 'pestel', unnest(string_split(pestel, ',')) FROM ta) GROUP BY ALL""",
)
def g21(m):
    return G.distributions(assessed(m))


@catalog.add(
    "g21_sector_distribution",
    f"""WITH {FACETS_SQL} SELECT run_id, facet, value, count(*) AS n FROM (SELECT * FROM simple UNION ALL
        SELECT run_id, 'pestel', coalesce(split_part(pestel, ',', 1), '-') FROM ta) GROUP BY ALL""",
)
def g21_sectors(m):
    return G.distributions(assessed(m), first_label_only=True)
