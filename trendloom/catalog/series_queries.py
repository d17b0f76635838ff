"""Registered queries F1-F10."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.catalog.model import Catalog
from trendloom.constants import MAX_QUARTERS
from trendloom.operators import series as S

catalog = Catalog()

LABEL = "CAST(year(published_at) AS STRING) || '-Q' || CAST(quarter(published_at) AS STRING)"
COUNTS = f"""c AS (SELECT run_id, topic_index, {LABEL} AS period, count(*) AS doc_count FROM {{series}}
    WHERE topic_index >= 0 AND published_at IS NOT NULL GROUP BY ALL)"""
CORPUS = f"""k AS (SELECT run_id, {LABEL} AS period, count(*) AS corpus_count FROM {{series}}
    WHERE published_at IS NOT NULL GROUP BY ALL)"""


def dense_sql(max_periods: int | None) -> str:
    lo = "min(q)" if max_periods is None else f"greatest(min(q), max(q) - {max_periods - 1})"
    return f"""i AS (SELECT *, CAST(period[1:4] AS BIGINT) * 4 + CAST(period[7:7] AS BIGINT) - 1 AS q FROM c),
    g AS (SELECT run_id, topic_index, unnest(generate_series({lo}, max(q))) AS q FROM i GROUP BY 1, 2),
    d AS (SELECT g.run_id, g.topic_index, CAST(g.q // 4 AS STRING) || '-Q' || CAST(g.q % 4 + 1 AS STRING) AS period,
        coalesce(i.doc_count, 0) AS doc_count
        FROM g LEFT JOIN i ON i.run_id = g.run_id AND i.topic_index = g.topic_index AND i.q = g.q)"""


PREVALENCE = """p AS (SELECT d.*, CASE WHEN coalesce(corpus_count, 0) > 0
        THEN CAST(doc_count AS DOUBLE) / corpus_count ELSE 0.0 END AS prevalence
    FROM d LEFT JOIN k ON k.run_id = d.run_id AND k.period = d.period)"""
GROWTH = """r AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic_index ORDER BY period) AS rn,
        count(*) OVER (PARTITION BY run_id, topic_index) AS n FROM d),
    h AS (SELECT run_id, topic_index, CAST(sum(doc_count) AS BIGINT) AS total, count(*) AS span,
        CAST(coalesce(sum(doc_count) FILTER (rn <= n // 2), 0) AS BIGINT) AS older,
        CAST(coalesce(sum(doc_count) FILTER (rn > n // 2), 0) AS BIGINT) AS recent FROM r GROUP BY 1, 2),
    w AS (SELECT *, CAST(recent - CASE WHEN older = 0 THEN 1 ELSE older END AS DOUBLE)
        / CASE WHEN older = 0 THEN 1 ELSE older END AS growth FROM h)"""
MATURITY = """CASE WHEN total <= 4 THEN 'weak_signal' WHEN total >= 15 AND span >= 6 THEN 'megatrend'
    WHEN growth >= 0.5 OR emergence >= 0.6 THEN 'emerging' ELSE 'established' END"""


@catalog.add("f1_quarter_label", f"SELECT doc_id, {LABEL} AS period FROM {{raw_docs}}")
def f1(m):
    return m.raw_docs.select("doc_id", S.quarter_label(F.col("published_at")).alias("period"))


@catalog.add("f2_topic_quarters", f"WITH {COUNTS} SELECT * FROM c")
def f2(m):
    return S.topic_quarters(m.series)


@catalog.add("f3_corpus_quarters", f"WITH {CORPUS} SELECT run_id, period, corpus_count AS doc_count FROM k")
def f3(m):
    return S.corpus_quarters(m.series)


@catalog.add("f4_dense_quarters", f"WITH {COUNTS}, {dense_sql(MAX_QUARTERS)} SELECT * FROM d")
def f4(m):
    return S.dense_quarters(S.topic_quarters(m.series), max_periods=MAX_QUARTERS)


@catalog.add(
    "f5_topic_prevalence",
    f"WITH {COUNTS}, {CORPUS}, {dense_sql(None)}, {PREVALENCE} "
    "SELECT run_id, topic_index, period, doc_count, round(prevalence, 6) AS prevalence FROM p",
)
def f5(m):
    dense = S.with_prevalence(S.dense_quarters(S.topic_quarters(m.series)), S.corpus_quarters(m.series))
    return dense.select("run_id", "topic_index", "period", "doc_count", F.round("prevalence", 6).alias("prevalence"))


@catalog.add(
    "f6_growth_ratio",
    f"WITH {COUNTS}, {dense_sql(None)}, {GROWTH} "
    "SELECT run_id, topic_index, total, span, round(growth, 6) AS growth FROM w",
)
def f6(m):
    grown = S.growth(S.dense_quarters(S.topic_quarters(m.series)))
    return grown.select("run_id", "topic_index", "total", "span", F.round("growth", 6).alias("growth"))


@catalog.add(
    "f7_maturity",
    f"WITH {COUNTS}, {dense_sql(None)}, {GROWTH}, e AS (SELECT *, "
    "CASE WHEN topic_index % 3 <> 0 THEN CAST(topic_index % 10 AS DOUBLE) / 10 END AS emergence FROM w) "
    f"SELECT run_id, topic_index, total, span, emergence, {MATURITY} AS maturity FROM e",
)
def f7(m):
    dense = S.dense_quarters(S.topic_quarters(m.series))
    novelty = m.series.select("run_id", "topic_index").distinct().withColumn(
        "emergence", F.when(F.col("topic_index") % 3 != 0, (F.col("topic_index") % 10).cast("double") / 10)
    )
    return S.topic_maturity(dense, novelty).select("run_id", "topic_index", "total", "span", "emergence", "maturity")


@catalog.add(
    "f8_stable_maturity",
    """WITH s AS (SELECT trend_id, maturity, size, run_id, CAST(split_part(canonical_id, '-', 2) AS BIGINT) AS c
            FROM {trends} JOIN {occurrences} USING (trend_id, run_id) WHERE canonical_id IS NOT NULL),
        l AS (SELECT *, lag(maturity) OVER (PARTITION BY c ORDER BY run_id, trend_id) AS previous FROM s),
        n AS (SELECT *, list_position(['weak_signal', 'emerging', 'established', 'megatrend'], previous) AS o,
            list_position(['weak_signal', 'emerging', 'established', 'megatrend'], maturity) AS w FROM l)
        SELECT trend_id, previous, maturity AS proposed, CASE WHEN abs(w - o) > 1 AND size < 8
            THEN ['weak_signal', 'emerging', 'established', 'megatrend'][CASE WHEN w > o THEN o + 1 ELSE o - 1 END]
            ELSE maturity END AS stable FROM n""",
)
def f8(m):
    from pyspark.sql import Window

    observed = m.trends.join(m.occurrences.select("trend_id", "canonical_id"), "trend_id").where("canonical_id IS NOT NULL")
    order = Window.partitionBy("canonical_id").orderBy("run_id", "trend_id")
    observed = observed.withColumn("previous", F.lag("maturity").over(order))
    stable = S.stabilize_maturity(F.col("previous"), F.col("maturity"), F.col("size"))
    return observed.select("trend_id", "previous", F.col("maturity").alias("proposed"), stable.alias("stable"))


@catalog.add(
    "f9_last_points",
    """SELECT topic_id, period, doc_count FROM {long_timepoints}
        QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY period DESC) <= 24""",
)
def f9(m):
    return S.last_points(m.long_timepoints)


@catalog.add(
    "f10_latest_prevalence",
    "SELECT topic_id, arg_max(prevalence, period) AS prevalence FROM {timepoints} GROUP BY topic_id",
)
def f10(m):
    return S.latest_prevalence(m.timepoints)


def flagship(m):
    """Quarterly prevalence, growth and maturity per topic in one table."""
    return S.with_dynamics(S.run_series(m.series)).select(
        "run_id", "topic_index", "period", "doc_count", F.round("prevalence", 6).alias("prevalence"),
        F.round("growth", 6).alias("growth"), "maturity",
    )


catalog.add(
    "f_topic_dynamics",
    f"WITH {COUNTS}, {CORPUS}, {dense_sql(None)}, {PREVALENCE}, {GROWTH}, "
    f"e AS (SELECT *, CAST(NULL AS DOUBLE) AS emergence FROM w), l AS (SELECT *, {MATURITY} AS maturity FROM e) "
    "SELECT p.run_id, p.topic_index, p.period, p.doc_count, round(p.prevalence, 6) AS prevalence, "
    "round(l.growth, 6) AS growth, l.maturity FROM p JOIN l ON l.run_id = p.run_id AND l.topic_index = p.topic_index",
)(flagship)
