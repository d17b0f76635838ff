"""Database dump lines to rows, dump slimming, run exports and the evaluation corpus loader."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.functions.text import strip

# Tables kept in a slim dump.
KEEP_TABLES = (
    "source", "document", "run", "run_event", "run_document", "topic", "topic_timepoint", "trend", "trend_assessment",
    "expert_feedback", "reference_trend", "trend_translation", "canonical_trend", "trend_occurrence", "trend_decision",
    "baseline_snapshot", "baseline_trend",
)
HEADER = r"^COPY public\.(\S+) .*?\(([^)]*)\)"


def read_dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and a position that follows the file order across splits."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("file", F.struct("block", "row").alias("pos"), "value")


def unescape(value: Column) -> Column:
    for escaped, plain in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")):
        value = F.replace(value, F.lit(escaped), F.lit(plain))
    return value


def copy_sections(lines: DataFrame) -> DataFrame:
    """(file, split, since, until, table_name, names): every COPY section once for each split of its file that it reaches into.

    Only the borders (a header and an end mark per table) are ordered, and only splits and sections, not lines, meet by file.
    """
    opens = F.startswith(F.col("value"), F.lit("COPY public."))
    borders = lines.where(opens | (F.col("value") == "\\.")).withColumn("opens", opens)
    borders = borders.withColumn("until", F.lead("pos").over(Window.partitionBy("file").orderBy("pos"))).where("opens")
    names = F.transform(F.split(F.regexp_extract("value", HEADER, 2), ","), lambda c: F.trim(F.replace(F.trim(c), F.lit('"'))))
    sections = borders.select("file", F.col("pos").alias("since"), "until", F.regexp_extract("value", HEADER, 1).alias("table_name"), names.alias("names"))
    splits = lines.select("file", F.col("pos.block").alias("split")).distinct()
    reached = (F.col("split") >= F.col("since.block")) & (F.col("until").isNull() | (F.col("split") <= F.col("until.block")))
    return sections.join(splits, "file").where(reached)


def copy_block_rows(lines: DataFrame) -> DataFrame:
    """Rows of every `COPY public.<table> (...)` block as (table_name, row map).

    A line looks its section up among those of its own split, so the key is (file, split): one large dump file spreads over as many keys
    as it has splits. The sections, a few short rows per split, are broadcast, so that no line leaves its task.
    """
    inside = (F.col("pos") > F.col("since")) & (F.col("until").isNull() | (F.col("pos") < F.col("until")))
    rows = lines.withColumn("split", F.col("pos.block")).join(F.broadcast(copy_sections(lines)), ["file", "split"]).where(inside)
    values = F.transform(F.split("value", "\t"), lambda v: F.when(v != "\\N", unescape(v)))
    width = F.least(F.size("names"), F.size(values))
    return rows.select(
        "table_name", "pos", F.map_from_arrays(F.slice("names", F.lit(1), width), F.slice(values, F.lit(1), width)).alias("row")
    )


def _blank_key(column: str):
    return lambda k, v: F.when(k != column, v)


def slim_rows(rows: DataFrame, keep=KEEP_TABLES, blank: dict[str, str] | None = None) -> DataFrame:
    """Allow-listed tables only; the vector column of a table (default topic.centroid) becomes null."""
    blank = {"topic": "centroid"} if blank is None else blank
    kept = rows.where(F.col("table_name").isin(*keep))
    cleared = F.col("row")
    for table, column in blank.items():
        cleared = F.when(
            F.col("table_name") == table,
            F.transform_values(cleared, _blank_key(column)),
        ).otherwise(cleared)
    return kept.withColumn("row", cleared)


def table_from_rows(rows: DataFrame, table: str, schema: str) -> DataFrame:
    """One typed table out of parsed dump rows; `schema` is a DDL string."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    mine = rows.where(F.col("table_name") == table)
    return mine.select(*[
        (F.when(F.col("row")[n] == "t", True).when(F.col("row")[n] == "f", False) if t == "boolean"
         else F.col("row")[n].try_cast(t)).alias(n)
        for n, t in fields
    ])


def evaluation_corpus(rows: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Evaluation text: title plus the opening of the body, as the comparison defines it."""
    part = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    body = part("text") if max_chars is None else F.substring(part("text"), 1, max_chars)
    text = strip(F.concat(part("title"), F.lit(". "), body))
    return rows.withColumn("combined", text).where(F.col("combined") != "")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return evaluation_corpus(spark.read.schema("id bigint, title string, text string").json(path))


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def committed_versions(spark: SparkSession, path: str) -> list[str]:
    """Versions of an export that were written completely, oldest first."""
    fs, folder = _folder(spark, f"{path}/commits")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def new_version() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def commit(spark: SparkSession, path: str, version: str) -> None:
    fs, mark = _folder(spark, f"{path}/commits/{version}")
    fs.create(mark, False).close()


def write_run_export(tables: dict[str, DataFrame], path: str) -> str:
    """Tables with a run_id as JSON lines, one folder per run, under a version of their own; gives the version.

    The commit mark is written after all tables. An attempt that fails before leaves files that no reader looks at, and a retry writes a
    new version beside them.
    """
    spark = next(iter(tables.values())).sparkSession
    version = new_version()
    for name, frame in tables.items():
        frame.write.partitionBy("run_id").json(f"{path}/versions/{version}/{name}")
    commit(spark, path, version)
    return version


def read_run_export(spark: SparkSession, path: str, name: str, schema: str, version: str | None = None) -> DataFrame:
    """One table of the newest committed version, or of a given one; an uncommitted version is an error."""
    versions = committed_versions(spark, path)
    if not versions or (version is not None and version not in versions):
        raise ValueError(f"no committed export in {path}" if version is None else f"export {version} was not committed")
    return spark.read.schema(schema).json(f"{path}/versions/{version or versions[-1]}/{name}")
