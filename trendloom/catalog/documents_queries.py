"""Registered queries A1-A12, B1-B9 and C1-C7."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.catalog.model import COUNTRY_CODES, Catalog, word
from trendloom.constants import REGION_COUNTRIES
from trendloom.functions import text as T
from trendloom.operators import corpus as C
from trendloom.operators import dedup as D
from trendloom.session import scratch_dir
from trendloom.sources import dumps, readers

catalog = Catalog()

WS = T.WHITESPACE
REGIONS_SQL = "(VALUES " + ", ".join(f"('{c}', '{r}')" for r, cs in REGION_COUNTRIES.items() for c in cs) + ") g(code, region)"


def norm_sql(col: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower({col}), 'ß', 'ss'), 'ς', 'σ'), '{WS}', ' ', 'g'))"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}|{WS}$', '', 'g')"


HASH_SQL = f"sha256({norm_sql('title')} || chr(10) || {norm_sql('text')})"
DOI_SQL = "lower(regexp_replace(coalesce(" + ", ".join(
    f"nullif(regexp_extract(coalesce({c}, ''), '{T.DOI}', 1), '')" for c in ("external_id", "url", "text")
) + "), '[.,;)]+$', ''))"


def url_sql(col: str) -> str:
    part = lambda i: f"regexp_extract({col}, '{T.URL_PARTS}', {i})"
    query = f"""array_to_string(list_transform(list_sort(list_transform(list_filter(string_split({part(4)}, '&'), lambda p:
        p <> '' AND NOT starts_with(lower(p), 'utm_')
        AND lower(string_split(p, '=')[1]) NOT IN ('fbclid', 'gclid', 'ref', 'source')),
        lambda p: {{'k': string_split(p, '=')[1], 'v': coalesce(string_split(p, '=')[2], '')}})),
        lambda s: s.k || '=' || s.v), '&')"""
    return f"""CASE WHEN {part(2)} <> '' THEN coalesce(nullif(lower({part(1)}), ''), 'https') || '://' || lower({part(2)})
        || coalesce(nullif(rtrim({part(3)}, '/'), ''), '/')
        || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"""


IDENTITY_SQL = f"""id AS (SELECT *, {DOI_SQL} AS doi, {url_sql('url')} AS canonical_url, {HASH_SQL} AS content_hash FROM {{raw_docs}}),
    ident AS (SELECT *, coalesce('doi:' || doi, 'url:' || canonical_url,
        'source:' || lower(source_name) || ':' || lower(external_id), 'sha256:' || content_hash) AS normalized_identity FROM id)"""

# ---------------------------------------------------------------- sources


@catalog.add(
    "a1_works_reader",
    f"""SELECT 'W' || CAST(doc_id AS STRING) AS external_id,
        CASE WHEN doc_id % 10 = 0 THEN CASE WHEN doc_id % 20 = 0 THEN '(untitled)' ELSE {word('doc_id')} END ELSE title END AS title,
        {strip_sql(f"CASE WHEN doc_id % 10 = 0 THEN CASE WHEN doc_id % 20 = 0 THEN '(untitled)' ELSE {word('doc_id')} END ELSE title END || '. ' || array_to_string(string_split(text, ' '), ' ')")} AS text,
        strftime(published_at, '%Y-%m-%d') AS published, language, region, country
        FROM (SELECT *, CASE WHEN doc_id % 4 > 0 THEN split_part('DE,CN,US', ',', CAST(doc_id % 4 AS INT)) END AS country,
            CASE WHEN doc_id % 4 > 0 THEN split_part('Europe,Asia,North America', ',', CAST(doc_id % 4 AS INT)) END AS region
        FROM {{raw_docs}} WHERE title <> '' OR doc_id % 10 = 0)""",
)
def a1(m):
    country = F.when(F.col("doc_id") % 4 > 0, F.expr("split_part('de,cn,us', ',', CAST(doc_id % 4 AS INT))"))
    work = F.struct(
        F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("doc_id") % 10 != 0, F.col("title")).alias("title"),
        F.when((F.col("doc_id") % 10 == 0) & (F.col("doc_id") % 20 != 0), F.expr(word("doc_id"))).alias("display_name"),
        F.col("published_at").cast("string").alias("publication_date"), F.col("language"),
        F.col("abstract_inverted_index"),
        F.array(F.struct(F.array(F.struct(country.alias("country_code")), F.struct(country.alias("country_code"))).alias("institutions"))).alias("authorships"),
    )
    raw = inverted_index(m).where((F.col("title") != "") | (F.col("doc_id") % 10 == 0))
    landed = scratch_dir(m.spark, "works")
    raw.select(F.to_json(work).alias("line")).write.text(landed)
    docs = readers.works_to_documents(m.spark.read.schema(readers.WORK_SCHEMA).json(landed))
    return docs.select(
        "external_id", "title", "text", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "language", "region", "country"
    )


def inverted_index(m):
    """raw_docs with the landed form of an abstract: word to positions, built from the document text within its row."""
    def by_word(placed):  # sorted (w, p): a word's positions lie side by side
        new = lambda i: (i == 0) | (F.get(placed, i)["w"] != F.get(placed, i - 1)["w"])
        return T.let(F.filter(F.transform(placed, lambda x, i: F.when(new(i), i)), lambda i: i.isNotNull()), lambda starts: F.transform(starts, lambda i, k: F.struct(
            F.get(placed, i)["w"].alias("w"),
            F.transform(F.slice(placed, i + 1, F.coalesce(F.get(starts, k + 1), F.size(placed)) - i), lambda x: x["p"]).alias("positions"))))

    placed = F.array_sort(F.transform(F.split("text", " "), lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    return m.raw_docs.where("text IS NOT NULL").withColumn("abstract_inverted_index", F.map_from_entries(T.let(placed, by_word)))


@catalog.add("a2_abstract_from_index", "SELECT doc_id, text AS abstract FROM {raw_docs}")
def a2(m):
    return inverted_index(m).select("doc_id", readers.reconstruct_abstract(F.col("abstract_inverted_index")).alias("abstract"))


AFFILIATION_SQL = f"split_part('{COUNTRY_CODES}', ',', CAST(1 + s_nationkey % 25 AS INT))"


@catalog.add(
    "a3_dominant_country",
    f"""WITH a AS (SELECT l_orderkey, {AFFILIATION_SQL} AS code, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
            FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey),
        c AS (SELECT l_orderkey, code, count(*) AS n, min(pos) AS first_pos FROM a GROUP BY 1, 2)
        SELECT l_orderkey AS work_id, arg_max(code, (n, -first_pos)) AS country FROM c GROUP BY 1""",
)
def a3(m):
    lines = m.lineitem.join(m.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.lower(F.expr(AFFILIATION_SQL)).alias("code"))
    works = lines.groupBy(F.col("l_orderkey").alias("work_id")).agg(F.array_sort(F.collect_list(entry)).alias("a"))
    return works.select("work_id", readers.dominant_country(F.transform("a", lambda x: x["code"])).alias("country"))


VALID_XML = r"[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


@catalog.add(
    "a4_feed_reader",
    f"""WITH c AS (SELECT doc_id, {strip_sql(f"regexp_replace(title, '{VALID_XML}', '', 'g')")} AS title,
            {strip_sql(f"regexp_replace(text, '{VALID_XML}', '', 'g')")} AS summary, published_at FROM {{raw_docs}} WHERE doc_id % 12 <> 0)
        SELECT 'http://example.org/abs/' || CAST(doc_id AS STRING) AS external_id, title,
            {strip_sql("title || '. ' || summary")} AS text, strftime(published_at, '%Y-%m-%d') AS published, 'preprint' AS source_type
        FROM c WHERE title <> ''""",
)
def a4(m):
    clean = lambda c: F.regexp_replace(c, VALID_XML, "")
    escape = lambda c: F.replace(F.replace(clean(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.when(F.col("doc_id") % 12 == 0, F.lit("  ")).otherwise(escape(F.col("title")))
    entry = F.concat(
        F.lit("<entry><id>http://example.org/abs/"), F.col("doc_id").cast("string"), F.lit("</id><title> "), title,
        F.lit(" </title><summary>"), escape(F.col("text")), F.lit("</summary><published>"),
        F.coalesce(F.concat(F.col("published_at").cast("string"), F.lit("T08:00:00Z")), F.lit("")), F.lit("</published></entry>"),
    )
    parsed = m.raw_docs.select(F.from_xml(entry, readers.ENTRY_SCHEMA).alias("e")).select("e.*")
    docs = readers.entries_to_documents(parsed)
    return docs.select("external_id", "title", "text", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "source_type")


PAGE_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
PAGE_BODY = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), "
    r"'(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
)


@catalog.add(
    "a5_web_reader",
    f"""WITH p AS (SELECT url, {PAGE_TITLE} AS t, {PAGE_BODY} AS body,
            regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS language FROM {{pages}})
        SELECT url AS external_id, coalesce(nullif(t, ''), url) AS title,
            ({strip_sql("coalesce(nullif(t, ''), url) || '. ' || body")}) AS text, nullif(language, '') AS language,
            'web' AS source_type FROM p WHERE t <> '' OR body <> ''""",
)
def a5(m):
    docs = readers.web_to_documents(readers.html_to_items(m.pages), "web")
    return docs.select("external_id", "title", "text", "language", "source_type")


@catalog.add(
    "a6_lenient_dates",
    """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN strftime(CASE WHEN event_id % 7 = 2
            THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S')
        WHEN event_id % 7 = 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed FROM {events}""",
)
def a6(m):
    kind, ts = F.col("event_id") % 7, F.col("ts")
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 4, F.lit("not-a-date")).when(kind == 5, F.lit(""))
    )
    return m.events.select("event_id", F.date_format(readers.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@catalog.add(
    "a7_source_union",
    """SELECT source_type, count(*) AS n FROM (
        SELECT 'web' AS source_type FROM {pages} UNION ALL
        SELECT 'preprint' FROM {raw_docs} WHERE regexp_matches(title, '\\S')) GROUP BY 1""",
)
def a7(m):
    entries = m.raw_docs.select(F.col("doc_id").cast("string").alias("id"), "title", F.col("text").alias("summary"), F.col("published_at").cast("string").alias("published"))
    registry = {
        "pages": readers.Source(lambda spark, path: readers.web_to_documents(readers.html_to_items(m.pages), "web")),
        "feed": readers.Source(lambda spark, path: readers.entries_to_documents(entries)),
        "unconfigured": readers.Source(readers.read_works),
    }
    union = readers.read_sources(m.spark, registry, {"pages": m.sf_dir, "feed": m.sf_dir}, registry)
    return union.groupBy("source_type").agg(F.count("*").alias("n"))


@catalog.add(
    "a8_region_lookup",
    f"SELECT trend_id, g.region AS macro_region FROM {{trends}} t LEFT JOIN {REGIONS_SQL} ON g.code = t.country",
)
def a8(m):
    return m.trends.select("trend_id", readers.region_for_country(F.concat(F.lit(" "), F.lower("country"))).alias("macro_region"))


def dump_lines(m):
    """Dump text of the portfolio: one block per table, a position per line."""
    pg = lambda c: F.coalesce(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\\N"))
    blocks = (
        (0, "canonical_trend", ["canonical_id", "status", "title", "merged_into_id"], m.canonicals, "canonical_id"),
        (1, "topic", ["trend_id", "keywords", "centroid"], m.trends.withColumn("centroid", F.lit("[0.1,0.2]")), "trend_id"),
        (2, "scratch", ["trend_id"], m.trends, "trend_id"),
    )
    frames = []
    for no, table, cols, df, key in blocks:
        pos = lambda stage, k="": F.struct(F.lit(no).alias("block"), F.lit(stage).alias("stage"), F.lit(k).cast("string").alias("k"))  # noqa: E731, B023
        head = m.spark.range(1).select(pos(0).alias("pos"), F.lit(f"COPY public.{table} ({', '.join(cols)}) FROM stdin;").alias("value"))
        tail = m.spark.range(1).select(pos(2).alias("pos"), F.lit("\\.").alias("value"))
        data = df.select(
            F.struct(F.lit(no).alias("block"), F.lit(1).alias("stage"), F.col(key).cast("string").alias("k")).alias("pos"),
            F.concat_ws("\t", *[pg(F.col(c)) for c in cols]).alias("value"),
        )
        frames += [head, data, tail]
    lines = frames[0]
    for f in frames[1:]:
        lines = lines.union(f)
    return lines.withColumn("file", F.lit("dump.sql"))


@catalog.add(
    "a9_dump_reader",
    """SELECT 'canonical_trend' AS table_name, canonical_id AS k, title AS v, merged_into_id AS w FROM {canonicals}
        UNION ALL SELECT 'topic', CAST(trend_id AS STRING), keywords, '[0.1,0.2]' FROM {trends}
        UNION ALL SELECT 'scratch', CAST(trend_id AS STRING), NULL, NULL FROM {trends}""",
)
def a9(m):
    return dump_view(dumps.copy_block_rows(dump_lines(m)))


def dump_view(rows):
    get = lambda *names: F.coalesce(*[F.try_element_at("row", F.lit(n)) for n in names])
    return rows.select("table_name", get("canonical_id", "trend_id").alias("k"), get("title", "keywords").alias("v"), get("merged_into_id", "centroid").alias("w"))


@catalog.add(
    "a10_slim_dump",
    """SELECT 'canonical_trend' AS table_name, canonical_id AS k, title AS v, merged_into_id AS w FROM {canonicals}
        UNION ALL SELECT 'topic', CAST(trend_id AS STRING), keywords, NULL FROM {trends}""",
)
def a10(m):
    return dump_view(dumps.slim_rows(dumps.copy_block_rows(dump_lines(m))))


@catalog.add(
    "a12_evaluation_corpus",
    f"""SELECT doc_id, {strip_sql(f"{strip_sql('title')} || '. ' || ({strip_sql('text')})")} AS combined FROM {{raw_docs}}""",
)
def a12(m):
    return dumps.evaluation_corpus(m.raw_docs).select("doc_id", "combined")


# ---------------------------------------------------------------- identity and deduplication


@catalog.add("b1_normalize_text", f"SELECT doc_id, {norm_sql('text')} AS norm_text FROM {{raw_docs}}")
def b1(m):
    return m.raw_docs.select("doc_id", T.normalize_text(F.col("text")).alias("norm_text"))


@catalog.add("b2_content_fingerprint", f"SELECT doc_id, {HASH_SQL} AS content_hash FROM {{raw_docs}}")
def b2(m):
    return m.raw_docs.select("doc_id", T.content_fingerprint(F.col("title"), F.col("text")).alias("content_hash"))


@catalog.add("b3_doi", f"SELECT doc_id, {DOI_SQL} AS doi FROM {{raw_docs}}")
def b3(m):
    return m.raw_docs.select("doc_id", T.extract_doi(F.col("external_id"), F.col("url"), F.col("text")).alias("doi"))


@catalog.add(
    "b4_canonical_url",
    f"SELECT page_id AS id, {url_sql('url')} AS canonical_url FROM {{pages}} UNION ALL SELECT -1 - doc_id, {url_sql('url')} FROM {{raw_docs}}",
)
def b4(m):
    urls = m.pages.select(F.col("page_id").alias("id"), "url").union(m.raw_docs.select(-1 - F.col("doc_id"), "url"))
    return urls.select("id", T.canonicalize_url(F.col("url")).alias("canonical_url"))


@catalog.add("b5_identity_key", f"WITH {IDENTITY_SQL} SELECT doc_id, normalized_identity FROM ident")
def b5(m):
    return D.with_identity(m.raw_docs).select("doc_id", "normalized_identity")


@catalog.add(
    "b6_batch_dedupe",
    """SELECT doc_id, k AS doc_key FROM (SELECT doc_id, lower(trim(coalesce(nullif(external_id, ''), nullif(url, ''), title))) AS k
        FROM {raw_docs}) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""",
)
def b6(m):
    return D.dedupe_batch(m.raw_docs).select("doc_id", "doc_key")


@catalog.add(
    "b7_exact_dedupe",
    f"""WITH RECURSIVE {IDENTITY_SQL}, k AS MATERIALIZED (SELECT doc_id, normalized_identity, row_number() OVER (ORDER BY doc_id) AS n, list_filter(['id:' || normalized_identity,
            'doi:' || doi, 'url:' || canonical_url, 'hash:' || content_hash, 'ext:' || source_name || '|' || source_type || '|' || nullif(trim(external_id), '')], lambda x: x IS NOT NULL) AS keys FROM ident),
        walk AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS taken, false AS kept
            UNION ALL SELECT k.n, CASE WHEN list_has_any(taken, keys) THEN taken ELSE taken || keys END, NOT list_has_any(taken, keys) FROM walk JOIN k ON k.n = walk.n + 1)
        SELECT doc_id, normalized_identity FROM walk JOIN k USING (n) WHERE kept""",
)
def b7(m):
    return D.exact_dedupe(D.with_identity(m.raw_docs)).select("doc_id", "normalized_identity")


@catalog.add("b7_exact_dedupe_by_content", f"SELECT min(doc_id) AS doc_id, {HASH_SQL} AS content_hash FROM {{raw_docs}} GROUP BY 2")
def b7_single(m):
    null = F.lit(None).cast("string")
    docs = m.raw_docs.withColumns({
        "content_hash": T.content_fingerprint(F.col("title"), F.col("text")), "doi": null, "canonical_url": null, "external_id": null,
    }).withColumn("normalized_identity", F.concat(F.lit("sha256:"), F.col("content_hash")))
    return D.exact_dedupe(docs).select("doc_id", "content_hash")


@catalog.add("b8_near_duplicate_titles")
def b8(m):
    return D.near_duplicates(m.raw_docs)


@catalog.add(
    "b8_near_duplicate_by_edits",
    f"""WITH t AS (SELECT doc_id AS seq, {norm_sql('title')} AS t, strlen({norm_sql('title')}) AS b FROM {{raw_docs}})
        SELECT x.seq, max(y.seq) AS near_duplicate_of FROM t x JOIN t y ON y.seq < x.seq AND y.seq >= x.seq - 200
            AND length(x.t) >= 20 AND CAST(least(x.b, y.b) AS DOUBLE) / greatest(x.b, y.b) >= 0.94
        WHERE CASE WHEN CAST(least(x.b, y.b) AS DOUBLE) / greatest(x.b, y.b) >= 0.94
            THEN 1 - CAST(levenshtein(x.t, y.t) AS DOUBLE) / greatest(x.b, y.b) >= 0.94 END GROUP BY 1""",
)
def b8_edits(m):
    return D.near_duplicates_by_edits(m.raw_docs)


@catalog.add(
    "b9_source_dimension",
    """WITH known AS (SELECT CAST(row_number() OVER (ORDER BY source_name) AS BIGINT) AS source_id, source_name, 'science' AS source_type
            FROM (SELECT DISTINCT source_name FROM {raw_docs} WHERE source_name < 'src15')),
        fresh AS (SELECT DISTINCT source_name, source_type FROM {raw_docs} r WHERE NOT EXISTS (
            SELECT 1 FROM known k WHERE k.source_name = r.source_name AND k.source_type = r.source_type))
        SELECT * FROM known UNION ALL SELECT (SELECT max(source_id) FROM known) + row_number() OVER (ORDER BY source_name, source_type),
            source_name, source_type FROM fresh""",
)
def b9(m):
    known = m.raw_docs.where("source_name < 'src15'").select("source_name").distinct()
    known = known.select(
        F.row_number().over(Window.orderBy("source_name")).cast("bigint").alias("source_id"), "source_name", F.lit("science").alias("source_type")
    )
    return D.extend_sources(m.raw_docs, known)


# ---------------------------------------------------------------- corpus snapshots

MEMBERS_SQL = """mem AS (SELECT r.run_id, d.doc_id, d.content_hash, CAST(row_number() OVER (PARTITION BY r.run_id
        ORDER BY published_at ASC NULLS LAST, content_hash ASC NULLS LAST, doc_id) - 1 AS BIGINT) AS position,
        CASE WHEN d.created_at > r.cutoff - 7 THEN 'new' ELSE 'carried_forward' END AS provenance
    FROM {docs} d JOIN {corpus_runs} r ON d.created_at <= r.cutoff WHERE corpus_approved AND duplicate_of_id IS NULL)"""


def membership(m):
    fresh = C.run_members(m.docs.select("doc_id", "created_at"), m.corpus_runs).where(F.col("created_at") > F.date_sub("cutoff", 7))
    return C.materialize_corpus(m.docs, m.corpus_runs, fresh.select("run_id", "doc_id"))


@catalog.add("c1_materialize_corpus", f"WITH {MEMBERS_SQL} SELECT run_id, doc_id, position, provenance FROM mem")
def c1(m):
    return membership(m).select("run_id", "doc_id", "position", "provenance")


LINES_SQL = "ln AS (SELECT run_id, position, coalesce(content_hash, 'legacy-document:' || CAST(doc_id AS STRING)) AS line FROM mem)"


def digest_sql(chunk: int) -> str:
    """Three levels of digests over blocks of `chunk` lines."""
    return f"""p AS (SELECT run_id, position // {chunk} AS part, sha256(string_agg(line, chr(10) ORDER BY position) || chr(10)) AS line FROM ln GROUP BY 1, 2),
        q AS (SELECT run_id, part // {chunk} AS grp, sha256(string_agg(line, chr(10) ORDER BY part) || chr(10)) AS line FROM p GROUP BY 1, 2)
        SELECT run_id, sha256(string_agg(line, chr(10) ORDER BY grp) || chr(10)) AS corpus_hash, 'sha256-chunked' AS algorithm FROM q GROUP BY 1"""


@catalog.add(
    "c2_corpus_hash",
    f"WITH {MEMBERS_SQL}, {LINES_SQL}, {digest_sql(4096)}",
)
def c2(m):
    return C.corpus_digest(membership(m))


@catalog.add(
    "c2_corpus_hash_chunked",
    f"WITH {MEMBERS_SQL}, {LINES_SQL}, {digest_sql(64)}",
)
def c2_chunked(m):
    return C.corpus_digest(membership(m), chunk=64)


LABELS_SQL = "SELECT run_id, doc_id, topic_index AS label, CAST(doc_id % 10 AS DOUBLE) / 10 AS probability FROM {run_docs}"


@catalog.add(
    "c3_topic_write_back",
    f"""WITH {MEMBERS_SQL}, lab AS ({LABELS_SQL}) SELECT mem.run_id, mem.doc_id, position,
        CASE WHEN label >= 0 THEN label END AS topic_index, coalesce(label < 0, false) AS is_outlier, probability AS membership_probability
        FROM mem LEFT JOIN lab ON lab.run_id = mem.run_id AND lab.doc_id = mem.doc_id""",
)
def c3(m):
    labels = m.run_docs.select("run_id", "doc_id", F.col("topic_index").alias("label"), ((F.col("doc_id") % 10).cast("double") / 10).alias("probability"))
    return C.write_back_topics(membership(m), labels).select(
        "run_id", "doc_id", "position", "topic_index", "is_outlier", "membership_probability"
    )


@catalog.add(
    "c4_corpus_export",
    f"""WITH {MEMBERS_SQL} SELECT mem.run_id, mem.doc_id, position, title, text, provenance, mem.content_hash FROM mem JOIN {{docs}} d
        ON d.doc_id = mem.doc_id WHERE trim(coalesce(title, '') || coalesce(text, '')) <> ''""",
)
def c4(m):
    return C.export_corpus(membership(m), m.docs).select("run_id", "doc_id", "position", "title", "text", "provenance", "content_hash")


MANIFEST_SQL = f"""{MEMBERS_SQL},
    c AS (SELECT mem.run_id, provenance, source_name FROM mem JOIN {{docs}} d ON d.doc_id = mem.doc_id
        WHERE trim(coalesce(title, '') || coalesce(text, '')) <> ''),
    n AS (SELECT run_id, count(*) AS n_documents, count(*) FILTER (provenance = 'new') AS n_new_documents,
        count(*) FILTER (provenance = 'carried_forward') AS n_carried_forward FROM c GROUP BY 1),
    s AS (SELECT run_id, string_agg(source_name || '=' || CAST(k AS STRING), ',' ORDER BY source_name) AS sources
        FROM (SELECT run_id, source_name, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1),
    f AS (SELECT run_id, count(*) FILTER (change_type = 'new') AS f_new,
        count(*) FILTER (change_type = 'classification_changed') AS f_class, count(*) FILTER (change_type = 'content_changed') AS f_content,
        count(*) FILTER (change_type = 'evidence_only') AS f_evidence, count(*) FILTER (change_type = 'unchanged') AS f_unchanged
        FROM {{occurrences}} GROUP BY 1)"""


def run_manifest(m):
    return C.manifest(m.corpus_runs, C.export_corpus(membership(m), m.docs), m.occurrences)


@catalog.add(
    "c5_run_manifest",
    f"""WITH {MANIFEST_SQL} SELECT r.run_id, n_documents, n_new_documents, n_carried_forward, sources,
        coalesce(f_new, 0) AS funnel_new, coalesce(f_class, 0) AS funnel_classification_changed,
        coalesce(f_content, 0) AS funnel_content_changed, coalesce(f_evidence, 0) AS funnel_evidence_only,
        coalesce(f_unchanged, 0) AS funnel_unchanged
        FROM {{corpus_runs}} r JOIN n USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN f USING (run_id)""",
)
def c5(m):
    flat = F.array_join(
        F.transform(F.map_entries("source_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    rows = run_manifest(m).withColumn("sources", flat)
    return rows.select("run_id", "n_documents", "n_new_documents", "n_carried_forward", "sources", *[c for c in rows.columns if c.startswith("funnel_")])


@catalog.add("c6_evaluable_runs", f"WITH {MEMBERS_SQL} SELECT run_id FROM {{corpus_runs}} r WHERE status = 'completed' AND run_id IN (SELECT run_id FROM mem)")
def c6(m):
    return C.evaluable_runs(m.corpus_runs, C.run_members(C.eligible(m.docs).select("doc_id", "created_at"), m.corpus_runs)).select("run_id")


@catalog.add(
    "c7_previous_completed_run",
    """SELECT r.run_id, (SELECT max(p.run_id) FROM {runs} p WHERE p.status = 'completed' AND p.run_id < r.run_id) AS previous_run_id
        FROM {runs} r""",
)
def c7(m):
    return C.previous_completed(m.runs)


@catalog.add("c7_latest_completed_run", "SELECT max(run_id) AS run_id FROM {runs} WHERE status = 'completed'")
def c7_latest(m):
    return C.latest_completed(m.runs)


@catalog.add(
    "a11_run_export",
    f"""WITH {MANIFEST_SQL} SELECT r.run_id, n_documents, n_new_documents, n_carried_forward, sources
        FROM {{corpus_runs}} r JOIN n USING (run_id) LEFT JOIN s USING (run_id)""",
)
def a11(m):
    """Manifest, corpus and chart data of every run as a committed export, and the manifest read back."""
    path = scratch_dir(m.spark, "a11")
    corpus = C.export_corpus(membership(m), m.docs).drop("created_at", "published_at")
    chart = membership(m).groupBy("run_id", "provenance").agg(F.count("*").alias("n"))
    dumps.write_run_export({"manifest": run_manifest(m), "corpus": corpus, "chart_data": chart}, path)
    schema = "run_id bigint, n_documents bigint, n_new_documents bigint, n_carried_forward bigint, source_distribution map<string,bigint>"
    back = dumps.read_run_export(m.spark, path, "manifest", schema)
    entries = F.array_sort(F.map_entries("source_distribution"))
    flat = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return back.select("run_id", "n_documents", "n_new_documents", "n_carried_forward", flat.alias("sources"))
