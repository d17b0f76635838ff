"""Quarterly time series, growth and maturity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.constants import MATURITY_LEVELS, MAX_QUARTERS

TOPIC = ["run_id", "topic_index"]


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def quarter_index(period: Column) -> Column:
    """Running number of a `YYYY-Qn` label."""
    return F.substring(period, 1, 4).cast("int") * 4 + F.substring(period, 7, 1).cast("int") - 1


def label_of_index(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("string"), F.lit("-Q"), (index % 4 + 1).cast("string"))


def topic_quarters(members: DataFrame, keys: list[str] = TOPIC) -> DataFrame:
    """Documents per topic and quarter; outliers (negative topic) and undated documents do not count."""
    dated = members.where((F.col("topic_index") >= 0) & F.col("published_at").isNotNull())
    return dated.groupBy(*keys, quarter_label(F.col("published_at")).alias("period")).agg(
        F.count("*").alias("doc_count")
    )


def corpus_quarters(members: DataFrame) -> DataFrame:
    """Dated documents per run and quarter, outliers included."""
    dated = members.where(F.col("published_at").isNotNull())
    return dated.groupBy("run_id", quarter_label(F.col("published_at")).alias("period")).agg(
        F.count("*").alias("doc_count")
    )


def dense_quarters(counts: DataFrame, keys: list[str] = TOPIC, max_periods: int | None = None) -> DataFrame:
    """Every quarter between first and last observation, optionally only the trailing `max_periods`."""
    if max_periods is not None and max_periods < 1:
        raise ValueError("max_periods must be positive")
    indexed = counts.withColumn("q", quarter_index(F.col("period")))
    first = F.min("q")
    if max_periods is not None:
        first = F.greatest(first, F.max("q") - F.lit(max_periods - 1))
    grid = indexed.groupBy(*keys).agg(first.alias("lo"), F.max("q").alias("hi"))
    grid = grid.select(*keys, F.explode(F.sequence("lo", "hi")).alias("q"))
    filled = grid.join(indexed.select(*keys, "q", "doc_count"), [*keys, "q"], "left")
    return filled.select(
        *keys, label_of_index(F.col("q")).alias("period"), F.coalesce("doc_count", F.lit(0)).alias("doc_count")
    )


def with_prevalence(dense: DataFrame, corpus: DataFrame) -> DataFrame:
    """Share of the quarter's corpus; 0 where the corpus is empty."""
    total = corpus.select("run_id", "period", F.col("doc_count").alias("corpus_count"))
    return dense.join(total, ["run_id", "period"], "left").withColumn(
        "prevalence",
        F.when(F.coalesce("corpus_count", F.lit(0)) > 0, F.col("doc_count") / F.col("corpus_count")).otherwise(0.0),
    )


def growth(series: DataFrame, keys: list[str] = TOPIC) -> DataFrame:
    """Signed growth of the newer against the older half, with total and span, one row per series."""
    ordered = Window.partitionBy(*keys).orderBy("period")
    ranked = series.withColumn("rn", F.row_number().over(ordered)).withColumn(
        "n", F.count("*").over(Window.partitionBy(*keys))
    )
    older = F.col("rn") <= F.floor(F.col("n") / 2)
    sums = ranked.groupBy(*keys).agg(
        F.sum("doc_count").alias("total"),
        F.count("*").alias("span"),
        F.coalesce(F.sum(F.when(older, F.col("doc_count"))), F.lit(0)).alias("older"),
        F.coalesce(F.sum(F.when(~older, F.col("doc_count"))), F.lit(0)).alias("recent"),
    )
    base = F.when(F.col("older") == 0, F.lit(1)).otherwise(F.col("older"))
    return sums.withColumn("growth", (F.col("recent") - base) / base)


def maturity_level(
    total: Column, span: Column, growth_ratio: Column, emergence: Column, *, weak_max: int = 4,
    growth_threshold: float = 0.5, established_span: int = 6, megatrend_min: int = 15, novel_threshold: float = 0.6,
) -> Column:
    level = (
        F.when(total.isNull() | (total <= weak_max), "weak_signal")
        .when((total >= megatrend_min) & (span >= established_span), "megatrend")
        .when(growth_ratio >= growth_threshold, "emerging")
        .otherwise("established")
    )
    return F.when((level == "established") & (emergence >= novel_threshold), "emerging").otherwise(level)


def topic_maturity(series: DataFrame, emergence: DataFrame | None = None, keys: list[str] = TOPIC) -> DataFrame:
    grown = growth(series, keys)
    if emergence is None:
        grown = grown.withColumn("emergence", F.lit(None).cast("double"))
    else:
        grown = grown.join(emergence, keys, "left")
    return grown.withColumn(
        "maturity", maturity_level(F.col("total"), F.col("span"), F.col("growth"), F.col("emergence"))
    )


def with_dynamics(points: DataFrame, keys: list[str] = TOPIC) -> DataFrame:
    """Growth and maturity next to every point of a series, without a second pass over the counts."""
    series = Window.partitionBy(*keys)
    rows = points.withColumns({"rn": F.row_number().over(series.orderBy("period")), "span": F.count("*").over(series)})
    older = F.col("rn") <= F.floor(F.col("span") / 2)
    rows = rows.withColumns({
        "total": F.sum("doc_count").over(series),
        "older": F.sum(F.when(older, F.col("doc_count")).otherwise(0)).over(series),
        "recent": F.sum(F.when(older, 0).otherwise(F.col("doc_count"))).over(series),
    })
    base = F.when(F.col("older") == 0, F.lit(1)).otherwise(F.col("older"))
    rows = rows.withColumn("growth", (F.col("recent") - base) / base)
    level = maturity_level(F.col("total"), F.col("span"), F.col("growth"), F.lit(None).cast("double"))
    return rows.withColumn("maturity", level).drop("rn", "older", "recent")


def stabilize_maturity(previous: Column, proposed: Column, evidence_count: Column) -> Column:
    """A jump over more than one level needs eight pieces of evidence, otherwise it moves one level."""
    levels = F.array(*[F.lit(level) for level in MATURITY_LEVELS])
    old, new = F.array_position(levels, previous), F.array_position(levels, proposed)
    one_step = F.get(levels, (old + F.signum(new - old) - 1).cast("int"))
    jump = (old > 0) & (new > 0) & (F.abs(new - old) > 1) & (evidence_count < 8)
    return F.when(jump, one_step).otherwise(proposed)


def last_points(points: DataFrame, key: str = "topic_id", n: int = MAX_QUARTERS) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc("period"))
    return points.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n).drop("rn")


def latest_prevalence(points: DataFrame, key: str = "topic_id") -> DataFrame:
    return points.groupBy(key).agg(F.max_by("prevalence", "period").alias("prevalence"))


def run_series(members: DataFrame, max_periods: int | None = None) -> DataFrame:
    """Dense topic series of every run with prevalence."""
    dense = dense_quarters(topic_quarters(members), max_periods=max_periods)
    return with_prevalence(dense, corpus_quarters(members))
