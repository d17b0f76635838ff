"""Readers: landed source files to raw documents, all projections on the JVM side.

Every reader ends in the same columns (RAW_COLUMNS), so sources are combined with a plain union.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.constants import REGION_COUNTRIES
from trendloom.functions.text import blank_to_null, let, strip

logger = logging.getLogger(__name__)

RAW_COLUMNS = (
    "external_id", "title", "text", "url", "published_at", "language", "region", "country", "source_name", "source_type",
)
WORK_SCHEMA = (
    "id string, title string, display_name string, publication_date string, language string, "
    "abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<institutions:array<struct<country_code:string>>>>"
)
ENTRY_SCHEMA = "id string, title string, summary string, published string"
WEB_SCHEMA = (
    "url string, title string, snippet string, description string, markdown string, "
    "metadata struct<sourceURL:string,url:string,title:string,description:string,publishedTime:string,"
    "published_time:string,date:string,language:string>"
)
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{4}-\d{2}-\d{2}.\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"


def parse_date(value: Column) -> Column:
    """Lenient ISO date or timestamp; text without an offset is UTC, anything else becomes null."""
    iso = F.regexp_replace(F.regexp_replace(value, r"^(\d{4}-\d{2}-\d{2}).(?=\d{2})", "$1T"), ",", ".")
    iso = F.regexp_replace(iso, r"T(\d{2})(?=$|[Z+-])", "T$1:00")
    iso = F.regexp_replace(iso, r"(T.*[+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.regexp_replace(iso, r"(T.*[+-]\d{2})$", "$1:00")
    return F.when(F.regexp_like(value, F.lit(_ISO)), F.try_to_timestamp(iso))


def region_for_country(code: Column) -> Column:
    pairs = [F.lit(x) for region, codes in REGION_COUNTRIES.items() for c in codes for x in (c, region)]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(code)))


def reconstruct_abstract(inverted: Column) -> Column:
    """Words of an inverted index back in position order."""
    placed = F.flatten(
        F.transform(
            F.map_entries(inverted),
            lambda e, arrival: F.transform(e["value"], lambda pos: F.struct(pos.alias("p"), arrival.alias("a"), e["key"].alias("w"))),
        )
    )
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def dominant_country(codes: Column) -> Column:
    """Most frequent code of an array; the first seen wins ties."""
    def ranked(upper: Column) -> Column:
        return F.transform(
            F.array_distinct(upper),
            lambda c: F.struct(
                F.size(F.filter(upper, lambda x: x == c)).alias("n"), (-F.array_position(upper, c)).alias("p"), c.alias("c")
            ),
        )

    known = F.transform(F.filter(codes, lambda c: c.isNotNull() & (c != "")), F.upper)
    return F.array_max(let(known, ranked))["c"]


def works_to_documents(works: DataFrame) -> DataFrame:
    """Scholarly works to raw documents; works without any content are skipped."""
    title, display = blank_to_null(F.col("title")), blank_to_null(F.col("display_name"))
    index = F.col("abstract_inverted_index")
    abstract = reconstruct_abstract(index)
    codes = F.flatten(
        F.transform("authorships", lambda a: F.transform(
            F.coalesce(a["institutions"], F.array().cast("array<struct<country_code:string>>")), lambda i: i["country_code"]))
    )
    usable = works.where(title.isNotNull() | display.isNotNull() | (F.size(index) > 0))
    shown = F.coalesce(title, display, F.lit("(untitled)"))
    country = dominant_country(codes)
    return usable.select(
        F.col("id").alias("external_id"), shown.alias("title"),
        strip(F.concat(shown, F.lit(". "), abstract)).alias("text"), F.col("id").alias("url"),
        parse_date(F.col("publication_date")).alias("published_at"), "language",
        region_for_country(country).alias("region"), country.alias("country"),
        F.lit("OpenAlex").alias("source_name"), F.lit("science").alias("source_type"),
    )  # no text is blank: each holds the stop behind its title


def entries_to_documents(entries: DataFrame) -> DataFrame:
    """Feed entries to raw documents; entries without a title are dropped."""
    clean = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    link = blank_to_null(clean("id"))
    return entries.where(clean("title") != "").select(
        link.alias("external_id"), clean("title").alias("title"),
        strip(F.concat(clean("title"), F.lit(". "), clean("summary"))).alias("text"), link.alias("url"),
        parse_date(F.col("published")).alias("published_at"), F.lit("en").alias("language"),
        F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("country"),
        F.lit("arXiv").alias("source_name"), F.lit("preprint").alias("source_type"),
    )


def web_to_documents(items: DataFrame, source_type: str = "news", max_chars: int | None = None) -> DataFrame:
    """Web search results to raw documents; results without title and body carry no signal."""
    first = lambda *names: F.coalesce(*[blank_to_null(F.col(n)) for n in names])
    url = first("url", "metadata.sourceURL", "metadata.url")
    raw_title = first("title", "metadata.title")
    body = F.coalesce(first("snippet", "description", "markdown", "metadata.description"), F.lit(""))
    title = F.coalesce(raw_title, url)
    text = strip(F.concat(title, F.lit(". "), body))
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    published = first("metadata.publishedTime", "metadata.published_time", "metadata.date")
    return items.where(raw_title.isNotNull() | (body != "")).select(
        url.alias("external_id"), title.alias("title"), text.alias("text"), url.alias("url"),
        parse_date(published).alias("published_at"), F.col("metadata.language").alias("language"),
        F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("country"),
        F.lit("Firecrawl").alias("source_name"), F.lit(source_type).alias("source_type"),
    ).where(strip(F.col("text")) != "")


def html_to_items(pages: DataFrame) -> DataFrame:
    """Raw pages (url, html) in the shape of web search results."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace("html", r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))
    language = blank_to_null(F.regexp_extract("html", r'(?i)<html[^>]*lang="([^"]*)"', 1))
    null = F.lit(None).cast("string")
    return pages.select(
        "url", title.alias("title"), body.alias("snippet"), null.alias("description"), null.alias("markdown"),
        F.struct(
            null.alias("sourceURL"), null.alias("url"), null.alias("title"), null.alias("description"),
            null.alias("publishedTime"), null.alias("published_time"), null.alias("date"), language.alias("language"),
        ).alias("metadata"),
    )


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Landed API envelopes `{results: [work, ...]}`, one JSON object per file."""
    envelopes = spark.read.schema(f"results array<struct<{_nested(WORK_SCHEMA)}>>").option("multiLine", True).json(path)
    return works_to_documents(envelopes.selectExpr("inline(results)"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Landed Atom feeds; every `entry` element is one row, so big feeds split across tasks."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY_SCHEMA).load(path)
    return entries_to_documents(entries)


def read_web_results(spark: SparkSession, path: str, source_type: str = "news") -> DataFrame:
    """Landed search responses `{data: {news: [...], web: [...]}}`."""
    bucket = "news" if source_type == "news" else "web"
    schema = f"data struct<{bucket}:array<struct<{_nested(WEB_SCHEMA)}>>>"
    responses = spark.read.schema(schema).option("multiLine", True).json(path)
    return web_to_documents(responses.selectExpr(f"inline(data.{bucket})"), source_type)


def _nested(ddl: str) -> str:
    """Top-level `name type` pairs as struct members `name:type`."""
    members, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            members.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(members)


@dataclass(frozen=True)
class Source:
    """A named reader; `needs_path` readers without a configured path are skipped."""

    read: Callable[[SparkSession, str], DataFrame]


DEFAULT_SOURCE = "openalex"
REGISTRY: dict[str, Source] = {
    "openalex": Source(read_works),
    "arxiv": Source(read_entries),
    "firecrawl": Source(lambda spark, path: read_web_results(spark, path, "news")),
    "firecrawl_web": Source(lambda spark, path: read_web_results(spark, path, "web")),
}


def pick_sources(names: Iterable[str], paths: dict[str, str], registry: dict[str, Source] | None = None) -> list[str]:
    """Usable source names: unknown names fail, unconfigured ones are skipped, none left means the default."""
    registry = REGISTRY if registry is None else registry
    picked = []
    for name in (n.strip().lower() for n in names):
        if not name:
            continue
        if name not in registry:
            raise ValueError(f"unknown source {name!r}")
        if paths.get(name):
            picked.append(name)
        else:
            logger.warning("skipping source %s: no landing path configured", name)
    return picked or [DEFAULT_SOURCE]


def read_sources(
    spark: SparkSession, names: Iterable[str], paths: dict[str, str], registry: dict[str, Source] | None = None
) -> DataFrame:
    """Union of all enabled sources; a source that cannot be opened fails the read, so a result is never short of one."""
    registry = REGISTRY if registry is None else registry
    frames = []
    for name in pick_sources(names, paths, registry):
        try:
            frames.append(registry[name].read(spark, paths[name]))
        except Exception as exc:
            raise ValueError(f"source {name} could not be read") from exc
    if not frames:
        raise ValueError("no source could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
