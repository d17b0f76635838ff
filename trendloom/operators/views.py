"""Dashboard-side read models: radar placement, filters, search, counters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.constants import MATURITY_LEVELS, RADAR_SECTORS, RING_BANDS
from trendloom.functions.ordering import dense_positions

CENTER, RADIUS = 360.0, 330.0


def id_seed(identifier: Column) -> Column:
    """Rolling 32-bit hash of an id; breaks ties between dots of equal size."""
    return F.aggregate(
        F.split(identifier, ""), F.lit(7).cast("bigint"), lambda s, c: (s * 31 + F.ascii(c)) % F.lit(4294967296)
    )


def sector_index(pestel: Column) -> Column:
    """Position of the first label on the radar; unknown labels sit in sector 1."""
    found = F.array_position(F.array(*[F.lit(s) for s in RADAR_SECTORS]), F.get(pestel, F.lit(0)))
    return F.when(found > 0, found - 1).otherwise(1).cast("int")


def radar_layout(trends: DataFrame, key: str = "id") -> DataFrame:
    """x, y and dot radius; dots of a sector and ring are fanned out evenly in angle and radius.

    A cell may hold a large share of all dots, so positions come from range partitions.
    """
    stage = F.when(F.col("radar_stage").isin(*RING_BANDS), F.col("radar_stage")).otherwise("watch")
    rows = trends.select(key, "size", sector_index(F.col("pestel")).alias("sector"), stage.alias("ring"), id_seed(F.col(key)).alias("seed"))
    placed = dense_positions(rows, ["sector", "ring"], [F.col("size"), F.col("seed"), F.col(key)], "index")
    cells = rows.groupBy("sector", "ring").agg(F.count("*").alias("n"))
    largest = rows.agg(F.greatest(F.max("size"), F.lit(1)).alias("largest"))
    placed = placed.join(cells, ["sector", "ring"]).join(largest)
    width = 360.0 / len(RADAR_SECTORS)
    angle = F.col("sector") * width + (0.06 + 0.88 * ((F.col("index") + 1) / (F.col("n") + 1))) * width
    inner, outer = F.lit(0.0), F.lit(0.0)
    for name, (lo, hi) in RING_BANDS.items():
        inner = F.when(F.col("ring") == name, lo).otherwise(inner)
        outer = F.when(F.col("ring") == name, hi).otherwise(outer)
    share = F.when(F.col("n") == 1, 0.5).otherwise(0.12 + 0.76 * ((F.col("index") + 0.5) / F.col("n")))
    radius = (inner + (outer - inner) * share) * RADIUS
    turn = (angle - 90) * (math.pi / 180)
    return placed.select(
        key, "sector", "ring", (CENTER + radius * F.cos(turn)).alias("x"), (CENTER + radius * F.sin(turn)).alias("y"),
        (6 + F.col("size") / F.col("largest") * 12).alias("r"),
    )


def faceted(trends: DataFrame, maturities=(), pestel=(), region: str | None = None) -> DataFrame:
    """Radar filter: rows without maturity always pass, any shared dimension is enough."""
    rows = trends.where(F.col("maturity").isNull() | F.col("maturity").isin(*maturities)) if maturities else trends.where("maturity IS NULL")
    if pestel:
        rows = rows.where(F.arrays_overlap(F.coalesce("pestel", F.array().cast("array<string>")), F.array(*[F.lit(p) for p in pestel])))
    return rows.where(F.col("region") == region) if region else rows


def region_facet(trends: DataFrame) -> DataFrame:
    return trends.where(F.coalesce("region", F.lit("")) != "").select("region").distinct().orderBy("region")


def search(trends: DataFrame, needle: str, pestel=()) -> DataFrame:
    """Case-insensitive substring search over title, summary and keywords."""
    text = needle.strip().lower()
    rows = trends
    if pestel:
        rows = rows.where(F.arrays_overlap(F.coalesce("pestel", F.array().cast("array<string>")), F.array(*[F.lit(p) for p in pestel])))
    if not text:
        return rows
    within = lambda c: F.contains(F.lower(c), F.lit(text))
    return rows.where(within(F.col("title")) | within(F.col("summary")) | F.exists("keywords", within))


def kanban(trends: DataFrame) -> DataFrame:
    """Column sizes of the maturity board, most mature first."""
    order = F.array(*[F.lit(x) for x in reversed(MATURITY_LEVELS)])
    counts = trends.groupBy("maturity").agg(F.count("*").alias("n"))
    return counts.withColumn("col", F.array_position(order, F.col("maturity")).cast("int"))


def dashboard(listed: DataFrame) -> DataFrame:
    """All counters of the start page from one pass over the listing with pending entries."""
    provisional = F.col("pending_review") & (F.col("status") == "review")
    fact = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    active = ~provisional
    facts = F.array_compact(F.array(
        F.when(active, fact("active", F.lit("all"))), F.when(F.col("pending_review"), fact("pending", F.lit("all"))),
        F.when(provisional, fact("pending_new", F.lit("all"))),
        F.when(active & (F.col("radar_stage") == "act"), fact("act", F.lit("active"))),
        F.when(provisional & (F.col("radar_stage") == "act"), fact("act", F.lit("pending"))),
        F.when(active & F.col("maturity").isNotNull(), fact("maturity", F.col("maturity"))),
    ))
    labels = F.when(active, F.transform(F.coalesce("pestel", F.array().cast("array<string>")), lambda p: fact("pestel", p)))
    everything = F.concat(facts, F.coalesce(labels, F.array().cast("array<struct<metric:string,value:string>>")))
    counted = listed.select(F.explode(everything).alias("f")).groupBy("f.metric", "f.value").agg(F.count("*").alias("n"))
    newest = listed.agg(F.max("pending_run_id").alias("n")).select(F.lit("pending_run").alias("metric"), F.lit("newest").alias("value"), "n")
    return counted.unionByName(newest)


def run_page_groups(diff: DataFrame) -> DataFrame:
    """Resolved entries of a run as new, reclassified or evidence."""
    group = (
        F.when(F.col("change_type") == "new", "new")
        .when(F.col("change_type").isin("classification_changed", "content_changed"), "reclassified")
        .when(F.col("change_type") == "evidence_only", "evidence")
    )
    rows = diff.where(F.col("review_status") != "pending").withColumn("page_group", group).where("page_group IS NOT NULL")
    return rows.groupBy("run_id", "page_group").agg(F.count("*").alias("n"))


def distinct_evidence(evidence: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First evidence per title and url of an entry."""
    return evidence.groupBy(key, "title", "url").agg(F.min(F.struct(*order)).alias("first")).select(key, "title", "url", "first.*")
