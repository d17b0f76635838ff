"""Driver tables mapped to the trend data model.

The only place that knows the test data. Every view is one SELECT in the dialect Spark SQL and DuckDB
share, so both sides of the correctness check start from the same rows. Braces name other views or tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from trendloom.functions.joins import spread
from trendloom.operators.corpus import eligible, run_members
from trendloom.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Wide text in a single file: one split would leave all but one core idle.
TEXT_TABLES = ("documents", "pages")

# Test vocabulary: lexicon words of every dimension so that derived trends hit the lexicons.
WORDS = (
    "policy,funding,trade,market,cost,demand,skills,health,housing,sensor,software,data,ai,twin,climate,carbon,"
    "energy,circular,solar,waste,law,standard,epbd,permit,facade,glass,insulation,retrofit,service,green,cloud,"
    "timber,window,roof,panel,bridge,frame,heat,noise,light"
)
N_WORDS = len(WORDS.split(","))
COUNTRY_CODES = "DE,CN,US,FR,JP,BR,ZA,AU,XX,IT,IN,CA,CL,EG,NZ,ES,KR,MX,AR,NG,AT,SG,GB,VN,KE"


def word(number: str) -> str:
    """SQL for the vocabulary word picked by an integer expression."""
    return f"split_part('{WORDS}', ',', CAST(1 + ({number}) % {N_WORDS} AS INT))"


VIEWS = {
    # Documents as ingested: title is the first line, identities repeat on purpose.
    "raw_docs": """
        SELECT doc_id AS seq, doc_id, split_part(text, chr(10), 1) AS title, text,
            CASE WHEN doc_id % 7 = 0 THEN 'doi:10.1000/Item.' || CAST(doc_id % 350 AS STRING) || '.'
                 WHEN doc_id % 7 = 1 THEN 'ext-' || CAST(doc_id % 450 AS STRING) END AS external_id,
            CASE WHEN doc_id % 5 < 3 THEN 'HTTPS://Example.org/Doc/' || CAST(doc_id % 800 AS STRING)
                 || '/?b=2&utm_source=x&a=' || CAST(doc_id % 3 AS STRING) || '#top' END AS url,
            CASE WHEN doc_id % 23 <> 0
                 THEN CAST('2019-01-01' AS DATE) + CAST((doc_id * 37) % 2190 AS INT) END AS published_at,
            source AS source_name, CASE WHEN doc_id % 2 = 0 THEN 'science' ELSE 'news' END AS source_type,
            lang AS language
        FROM {documents}""",
    # Accepted documents with metadata of the store.
    "docs": """
        SELECT doc_id, title, text, published_at, source_name, source_type, language,
            CASE WHEN doc_id % 31 <> 0 THEN sha256_hex(text) END AS content_hash,
            doc_id % 41 <> 0 AS corpus_approved,
            CASE WHEN doc_id % 53 = 0 THEN doc_id - 1 END AS duplicate_of_id,
            CAST('2024-01-01' AS DATE) + CAST(doc_id % 28 AS INT) AS created_at,
            CASE WHEN doc_id % 6 > 0 THEN split_part('Europe,Asia,Africa,Oceania,North America', ',',
                 CAST(doc_id % 6 AS INT)) END AS region,
            split_part('DE,CN,FR,JP,KE,AU,US,IT', ',', CAST(1 + doc_id % 8 AS INT)) AS country
        FROM {raw_docs}""",
    # Four finished corpus runs and one failed run.
    "corpus_runs": """
        SELECT CAST(c AS BIGINT) + 1 AS run_id,
            CASE WHEN c = 3 THEN 'failed' ELSE 'completed' END AS status,
            CAST('2024-01-01' AS DATE) + CAST(7 * c + 6 AS INT) AS cutoff
        FROM (SELECT DISTINCT CAST(doc_id % 5 AS INT) AS c FROM {documents}) r""",
    # Cluster labels as delivered by topic modelling; label 9 marks outliers.
    "doc_topic": """
        SELECT vec_id AS doc_id, embedding, CASE WHEN label = 9 THEN -1 ELSE label END AS topic_index
        FROM {embeddings}""",
    # Membership of every run: documents created up to the cutoff that have a vector.
    "run_docs": """
        SELECT r.run_id, d.doc_id, t.topic_index, t.embedding, d.title, d.text, d.published_at, d.source_name,
            d.region, d.country, d.content_hash, d.created_at
        FROM {docs} d JOIN {doc_topic} t ON t.doc_id = d.doc_id JOIN {corpus_runs} r ON d.created_at <= r.cutoff
        WHERE d.corpus_approved AND d.duplicate_of_id IS NULL""",
    # Dated observations of topics for time series.
    "series": """
        SELECT CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS run_id,
            CASE WHEN o_custkey % 13 = 0 THEN CAST(-1 AS BIGINT) ELSE o_custkey END AS topic_index,
            CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_orderdate AS DATE) END AS published_at
        FROM {orders}""",
    # Portfolio history: one run per month, one machine trend per order.
    "trends": """
        SELECT o_orderkey AS trend_id, o_orderkey AS topic_id,
            CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS run_id,
            o_custkey % 40 AS topic_index,
            'Trend ' || W(o_custkey) || ' ' || W(o_custkey * 7 + o_orderkey % 3) AS title,
            'Summary about ' || W(o_custkey * 3) || CASE WHEN o_orderkey % 4 = 0 THEN ' revised' ELSE '' END AS summary,
            split_part('weak_signal,emerging,established,megatrend', ',',
                CAST(1 + (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 4 AS INT)) AS maturity,
            CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 11 AS DOUBLE) / 10 END AS emergence,
            W(o_custkey) || ',' || W(o_custkey + 11) || ',' || W(o_orderkey) || ',' || W(o_custkey * 5) AS keywords,
            CAST(1 + o_orderkey % 37 AS INT) AS size,
            CASE WHEN o_orderkey % 7 > 0 THEN split_part('Europe,Asia,Africa,Oceania,North America,South America', ',',
                CAST(o_orderkey % 7 AS INT)) END AS region,
            split_part('COUNTRIES', ',', CAST(1 + o_orderkey % 25 AS INT)) AS country
        FROM {orders}""",
    "assessments": """
        SELECT o_orderkey AS trend_id,
            D(o_custkey) || CASE WHEN o_orderkey % 3 = 0 THEN ',' || D(o_custkey + 1 + o_orderkey % 2) ELSE '' END AS pestel,
            split_part('climate,technology,digital,markets', ',',
                CAST(1 + (o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) % 4 AS INT)) AS category,
            CAST(1 + (o_custkey + o_orderkey % 4) % 10 AS DOUBLE) AS impact,
            CAST(1 + (o_custkey * 3 + o_orderkey % 2) % 10 AS DOUBLE) AS urgency,
            CAST(1 + o_orderkey % 10 AS DOUBLE) + CAST(o_orderkey % 3 AS DOUBLE) / 100 AS uncertainty,
            split_part('act,prepare,watch', ',',
                CAST(1 + (o_custkey + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END) % 3 AS INT)) AS radar_stage,
            CASE WHEN o_orderkey % 5 <> 0 THEN 'Rationale ' || CAST(o_orderkey % 50 AS STRING) END AS rationale
        FROM {orders} WHERE o_orderkey % 17 <> 0""",
    "runs": """
        SELECT run_id,
            CASE WHEN run_id % 9 = 4 THEN 'failed' WHEN run_id % 20 = 7 THEN 'running' ELSE 'completed' END AS status,
            CAST('2024-01-01' AS DATE) + CAST(run_id AS INT) AS started_at,
            CASE WHEN run_id % 20 <> 7 THEN CAST('2024-01-01' AS DATE) + CAST(run_id + run_id % 3 AS INT) END AS finished_at,
            n_topics, 'query ' || CAST(run_id AS STRING) AS query,
            CASE WHEN run_id % 9 = 4 THEN 'ValueError: source ' || CAST(run_id AS STRING) END AS error
        FROM (SELECT run_id, count(*) AS n_topics FROM {trends} GROUP BY run_id) m""",
    # Evidence documents of a topic inside a run.
    "topic_docs": """
        SELECT t.run_id, t.topic_id, t.topic_index, l.l_partkey AS doc_id, l.l_suppkey AS source_id,
            CAST(l.l_shipdate AS DATE) AS published_at, l.l_linenumber = 7 AS is_outlier
        FROM {lineitem} l JOIN {trends} t ON t.trend_id = l.l_orderkey""",
    "timepoints": """
        SELECT l_orderkey AS topic_id,
            CAST(year(l_shipdate) AS STRING) || '-Q' || CAST(quarter(l_shipdate) AS STRING) AS period,
            CAST(count(*) AS BIGINT) AS doc_count, CAST(min(l_linenumber) AS DOUBLE) / 8 AS prevalence
        FROM {lineitem} GROUP BY 1, 2""",
    # Longer series, one topic per customer, for the read views.
    "long_timepoints": """
        SELECT o_custkey AS topic_id,
            CAST(year(l_shipdate) AS STRING) || '-Q' || CAST(quarter(l_shipdate) AS STRING) AS period,
            CAST(count(*) AS BIGINT) AS doc_count
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2""",
    "evidence": """
        SELECT l_orderkey AS trend_id, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
            CASE WHEN l_linenumber <> 4 THEN 'Paper ' || W(l_partkey) || ' ' || CAST(l_partkey % 60 AS STRING) END AS title,
            CASE WHEN l_linenumber <> 5 THEN 'https://example.org/' || CAST(l_partkey % 60 AS STRING) END AS url
        FROM {lineitem}""",
    "canonicals": """
        SELECT 'ct-' || CAST(c_custkey AS STRING) AS canonical_id,
            CASE WHEN c_custkey % 11 = 4 THEN 'merged' WHEN c_custkey % 11 = 5 THEN 'rejected'
                 WHEN c_custkey % 11 = 6 THEN 'dormant' WHEN c_custkey % 11 = 7 THEN 'review' ELSE 'active' END AS status,
            'Trend ' || W(c_custkey) || ' ' || W(c_custkey * 7) AS title,
            'Summary about ' || W(c_custkey * 3) AS summary,
            split_part('weak_signal,emerging,established,megatrend', ',', CAST(1 + c_custkey % 4 AS INT)) AS maturity,
            D(c_custkey) AS pestel,
            split_part('climate,technology,digital,markets', ',', CAST(1 + c_custkey % 4 AS INT)) AS category,
            CAST(1 + c_custkey % 10 AS DOUBLE) AS impact, CAST(1 + (c_custkey * 3) % 10 AS DOUBLE) AS urgency,
            CAST(1 + c_custkey % 10 AS DOUBLE) + CAST(c_custkey % 3 AS DOUBLE) / 100 AS uncertainty,
            split_part('act,prepare,watch', ',', CAST(1 + c_custkey % 3 AS INT)) AS radar_stage,
            CASE WHEN c_custkey % 6 = 0 THEN CAST((c_custkey * 13) % 101 AS DOUBLE) END AS position,
            CASE WHEN c_custkey % 50 = 0 THEN 60 + c_custkey % 24 ELSE 1 + c_custkey % 5 END AS first_run_id, 60 + c_custkey % 24 AS last_run_id,
            CASE WHEN c_custkey % 11 = 4 THEN 'ct-' || CAST(c_custkey - CASE WHEN c_custkey >= 11 AND c_custkey % 2 = 0
                THEN 11 ELSE 1 END AS STRING) END AS merged_into_id,
            CAST('2024-06-01' AS DATE) + CAST((c_custkey * 17) % 300 AS INT) AS updated_at
        FROM {customer}""",
    "occurrences": """
        SELECT o_orderkey AS occurrence_id, o_orderkey AS trend_id, t.run_id,
            CASE WHEN o_orderkey % 10 <> 9 THEN 'ct-' || CAST(o_custkey AS STRING) END AS canonical_id,
            CASE WHEN o_orderkey % 10 = 9 THEN 'new' ELSE split_part(
                'classification_changed,content_changed,evidence_only,unchanged', ',',
                CAST(1 + o_orderkey % 4 AS INT)) END AS change_type,
            CASE WHEN o_orderkey % 10 = 9 OR o_orderkey % 8 = 0 THEN 'pending' ELSE split_part(
                'approved,not_required,rejected', ',', CAST(1 + o_orderkey % 3 AS INT)) END AS review_status,
            split_part('title|title,maturity|impact|uncertainty,summary|pestel', '|', CAST(1 + o_orderkey % 5 AS INT)) AS changed_fields,
            CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 AS match_score, CAST(o_orderkey % 20 AS DOUBLE) / 100 AS match_margin,
            o_orderkey % 4 AS evidence_added, o_orderkey % 3 AS evidence_removed,
            CAST(o_orderkey % 9 AS DOUBLE) / 10 AS prevalence,
            CASE WHEN o_orderkey % 10 = 9 THEN 'new_trend' WHEN o_orderkey % 8 = 0 THEN 'ambiguous_margin' END AS review_reason
        FROM {orders} JOIN {trends} t ON t.trend_id = o_orderkey""",
    "translations": """
        SELECT o_orderkey AS trend_id, CASE WHEN o_orderkey % 2 = 0 THEN 'de' ELSE 'en' END AS language,
            'Titel ' || W(o_custkey) AS title, 'Text ' || W(o_custkey * 3) AS summary,
            CASE WHEN o_orderkey % 6 < 3 THEN 'Grund ' || CAST(o_orderkey % 50 AS STRING) END AS rationale
        FROM {orders} WHERE o_orderkey % 3 <> 0""",
    # Decisions on portfolio trends and on occurrences; idempotency keys repeat, some on two occurrences.
    "decisions": """
        SELECT l_orderkey * 10 + l_linenumber AS decision_key, l_orderkey AS occurrence_id,
            'ct-' || CAST(o_custkey AS STRING) AS canonical_id,
            split_part('confirm,correct,reject,restore,link,create,merge', ',', l_linenumber) AS action,
            'k' || CAST(CASE WHEN l_partkey % 11 = 0 THEN CAST(floor(l_orderkey / 2e0) AS BIGINT) ELSE l_orderkey END AS STRING) || '-' || CAST(l_linenumber AS STRING) AS idempotency_key,
            l_partkey * 10000 + l_suppkey AS tie,
            CASE WHEN l_partkey % 3 = 0 THEN 'Edited ' || W(l_partkey) END AS new_title,
            CASE WHEN l_partkey % 4 = 0 THEN split_part('weak_signal,emerging,established,megatrend', ',',
                CAST(1 + l_partkey % 4 AS INT)) END AS new_maturity,
            CASE WHEN l_partkey % 5 = 0 THEN CAST(1 + l_partkey % 10 AS DOUBLE) END AS new_impact,
            CASE WHEN l_linenumber IN (5, 7) THEN 'ct-' || CAST(CAST(floor(o_custkey / 2e0) AS BIGINT)
                + CASE WHEN l_partkey % 13 = 0 THEN 1000000000 ELSE 0 END AS STRING) END AS target_id
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "feedback": """
        SELECT l_orderkey * 10 + l_linenumber AS feedback_key, l_partkey * 10000 + l_suppkey AS tie, l_orderkey AS trend_id,
            CASE l_returnflag WHEN 'A' THEN 'confirm' WHEN 'N' THEN 'correct' ELSE 'reject' END AS action,
            CASE WHEN l_linestatus = 'O' THEN 'maturity' ELSE 'title' END AS field,
            CASE WHEN l_linestatus = 'O' THEN split_part('weak_signal,emerging,established,megatrend,unknown', ',',
                CAST(1 + l_partkey % 5 AS INT)) ELSE 'Corrected ' || W(l_partkey) || ' ' || W(l_suppkey) END AS new_value
        FROM {lineitem}""",
    # Progress log.
    "run_events": """
        SELECT event_id, user_id AS run_id, event_type AS phase, CAST(floor(value * 3) AS INT) - 5 AS progress,
            'Message ' || event_type AS message, props AS details, ts AS created_at,
            CASE WHEN event_id % 4 = 0 THEN split_part('round_started,source_searched,source_failed,round_completed', ',',
                CAST(1 + CAST(floor(event_id / 4e0) AS BIGINT) % 4 AS INT)) END AS code
        FROM {events}""",
    # Reference list and trends for the evaluation.
    "references": """SELECT item_id AS reference_id, text AS title FROM {benchmark}""",
}

_PICK_WORD = re.compile(r"\bW\(([^()]*(?:\([^()]*\)[^()]*)*)\)")
_PICK_DIMENSION = re.compile(r"\bD\(([^()]*)\)")
_PLACEHOLDER = re.compile(r"\{([a-z_]{3,})\}")


def _expand(sql: str) -> str:
    sql = _PICK_WORD.sub(lambda m: word(m.group(1)), sql)
    sql = _PICK_DIMENSION.sub(
        lambda m: "split_part('political,economic,social,technological,environmental,legal', ',', "
        f"CAST(1 + ({m.group(1)}) % 6 AS INT))",
        sql,
    )
    return sql.replace("COUNTRIES", COUNTRY_CODES)


def spark_sql(name: str) -> str:
    return _expand(VIEWS[name]).replace("sha256_hex(text)", "sha2(text, 256)")


def duckdb_sql(name: str) -> str:
    return _expand(VIEWS[name]).replace("sha256_hex(text)", "sha256(text)")


class Model:
    """Lazily built DataFrames of tables and model views under one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(table) if name in TEXT_TABLES else table
        if name not in VIEWS:
            raise AttributeError(name)
        if name == "run_docs":
            columns = "doc_id", "title", "text", "published_at", "source_name", "region", "country", "content_hash", "created_at"
            members = run_members(eligible(self.docs).select(*columns), self.corpus_runs)
            return members.join(self.doc_topic, "doc_id").select("run_id", "doc_id", "topic_index", "embedding", *columns[1:])
        sql = spark_sql(name)
        return self.spark.sql(sql, **{dep: getattr(self, dep) for dep in set(_PLACEHOLDER.findall(sql))})


def with_views(body: str) -> str:
    """Oracle SQL: prepend the CTEs of all views named in braces, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for dep in _PLACEHOLDER.findall(VIEWS[name]):
            visit(dep)
        order.append(name)

    for name in _PLACEHOLDER.findall(body):
        visit(name)
    resolve = lambda sql: _PLACEHOLDER.sub(lambda m: m.group(1) if m.group(1) in TABLES else f"v_{m.group(1)}", sql)
    ctes = [f"v_{n} AS ({resolve(duckdb_sql(n))})" for n in order]
    body = resolve(body).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


class Catalog:
    """Named queries with their oracle statements."""

    def __init__(self):
        self.builders, self.oracles = {}, {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            if name in self.builders:
                raise ValueError(f"query {name} is registered twice")
            self.builders[name] = fn
            if sql is not None:
                self.oracles[name] = with_views(sql)
            return fn

        return wrap

    def queries(self):
        def bind(fn):
            return lambda spark, sf_dir: fn(Model(spark, sf_dir))

        return {name: bind(fn) for name, fn in self.builders.items()}
