"""Connected components of an edge table by minimum labels and pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import scratch_dir


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at a number of bytes, not only of rows, so that long texts do not make them large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder below the shared checkpoint folder and read back: cuts lineage and survives lost executors."""
    bounded_batches(df.sparkSession)
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, label) of every node of `edges` (a long, b long); the label is the smallest id of its component.

    A hot node is one key of a partial minimum, so its degree does not matter. Rounds grow with the logarithm of a component's diameter.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("onward"))
        fresh = stored(least.join(jump, least["least"] == jump["at"]).select("id", F.least("least", "onward").alias("fresh"), F.col("label").alias("was")), "labels")
        moved = fresh.where("fresh <> was").limit(1).count()
        labels = fresh.select("id", F.col("fresh").alias("label"))
        if not moved:
            return labels
