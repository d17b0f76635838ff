"""Exact dense numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.session import ensure_checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index of a partition in the low 33 bits


def dense_positions(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "position") -> DataFrame:
    """Number rows 0..n-1 inside every group by `order_cols`, which must end in a unique key.

    A group may hold most of the data, so rows are range partitioned over (group, order): a hot group
    spreads over many tasks. The sorted rows are checkpointed once, then only per-partition counts
    (one row per partition) are summed up and joined back.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(c) for c in group_cols] + order_cols
    ranged = df.repartitionByRange(*keys) if keys else df
    sorted_rows = ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    sorted_rows = sorted_rows.checkpoint()
    pid = F.shiftright("_mid", _ROW_BITS)
    row = F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    spans = sorted_rows.groupBy(*group_cols, pid.alias("_pid")).agg(
        F.count("*").alias("_n"), F.min(row).alias("_first")
    )
    over = f"PARTITION BY {', '.join(group_cols)} ORDER BY _pid" if group_cols else "ORDER BY _pid"
    spans = spans.withColumn("_before", F.expr(f"coalesce(sum(_n) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    spans = spans.select(*group_cols, "_pid", (F.col("_before") - F.col("_first")).alias("_shift"))
    numbered = sorted_rows.withColumn("_pid", pid).join(spans, [*group_cols, "_pid"])
    return numbered.withColumn(name, row + F.col("_shift")).drop("_pid", "_shift", "_mid")
