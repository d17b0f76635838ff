"""Operator 11, mixing sources to target weights by systematic sampling.

Every document of a source is expected to appear target / source size times. Documents stand in order of size within their source, expected
copies are summed up along that order, one random offset per source is added, and a document is emitted once per whole number its stretch
of the sum crosses. Neighbours are of like size, so a source's words miss its target by less than its longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions.joins import salted_join
from trendloom.functions.ordering import dense_positions
from trendloom.llm.graph import stored

WEIGHTS = (3, 1, 2)  # by position of the source in code-point order, repeating
SHARE = (3, 2)  # mix size over the size of all documents, as a fraction
MOST = 2  # times its size that a source gives at most
UNIT_BITS = 24  # expected copies are whole multiples of 2**-24, so sums are exact in any order
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """`sizes` (source, source_size) with weight and target.

    Targets share the mix by weight; one that would exceed `most` times its source stops there and the excess is shared by weight among the
    rest, until none is above. The loop holds sums only: a round counts what stopped targets take and the weight that is left.
    """
    numbered = dense_positions(sizes, [], [F.col("source").asc_nulls_last()], "place")
    of = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    table = stored(numbered.select("source", "source_size", of.alias("weight")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    mix, level = total * share[0] / share[1], 0.0
    while True:
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
        spent, weight = table.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        higher = (mix - spent) / weight if weight else level
        if higher <= level:
            return table.withColumn("target", F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")))
        level = higher


def running_sums(rows: DataFrame, group: str, value: str, order: list[str], name: str) -> DataFrame:
    """`rows` with the sum of `value` up to and including each row in `order` within its group, exact for long values.

    Rows are range partitioned by group and order, so a group of any size spreads over tasks; each task sums its sorted rows and only the
    totals per task and group are carried on. `order` must tell all rows apart.
    """
    part = T.StructField("__part", T.IntegerType())
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])

    def add_up(batches):
        last, total = None, 0
        for batch in batches:
            keys, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in (group, value))
            sums = np.cumsum(values)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            before = np.where(first > 0, sums[first - 1], 0) if len(first) else first
            if len(keys) and keys[0] == last:
                before[0] -= total
            sums = sums - np.repeat(before, np.diff(np.append(first, len(keys))))
            if len(keys):
                last, total = keys[-1], sums[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, name])

    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(add_up, schema)
    partial = stored(ranged.withColumn(part.name, F.spark_partition_id()), "sums")
    totals = partial.groupBy(group, part.name).agg(F.max(name).alias("__total"))
    before = F.expr(f"coalesce(sum(__total) OVER (PARTITION BY {group} ORDER BY {part.name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    shifts = totals.select(group, part.name, before.alias("__before"))
    return partial.join(shifts, [group, part.name]).withColumn(name, F.col(name) + F.col("__before")).drop(part.name, "__before")


def copies(documents: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", keep: tuple[str, ...] | None = None, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(row, mix) structs: the kept columns (all by default) and source, size, source_size, target, copies of each input row.

    A null source is a source of its own, last in order; null and empty texts have size 0 and take nothing; sources without words have
    target 0. Repeated rows count one by one. Equal sizes stand in the order of a digest of id and text, so reruns agree. An empty table
    gives an empty result. Columns may have any name: they travel in one struct.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    rows = documents.select(F.struct(*(keep or documents.columns)).alias("__kept"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), digest.alias("__digest"))
    rows = stored(rows, "mix").withColumn("__row", F.monotonically_increasing_id())
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, UNIT_BITS // 4), 16, 10).cast("long")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << UNIT_BITS))).otherwise(0).cast("long")
    rates = source_targets(sizes, weights, share, most).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("__source"), "source_size", "target", offset.alias("__offset"), expected.alias("__expected")
    )
    keyed = salted_join(rows.withColumn("__source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), rates, ["__source"], "__row")
    summed = running_sums(keyed, "__source", "__expected", ["size", "__digest", "__row"], "__sum")
    upto = F.col("__sum") + F.col("__offset")
    n = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("__expected"), UNIT_BITS)
    return summed.select(F.col("__kept").alias("row"), F.struct("source", "size", "source_size", "target", n.alias("copies")).alias("mix"))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of `documents`, all columns, each as often as it is taken."""
    taken = copies(documents, **options).where("mix.copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")


def taken_rows(documents: DataFrame) -> DataFrame:
    """The query's columns, with source and copies."""
    rows = copies(documents, keep=("doc_id",)).select("row.doc_id", "mix.*")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM rows GROUP BY source
), filled AS (
  SELECT *, (sum(source_size) OVER () * 3 / 2.0::DOUBLE - coalesce(sum(2 * source_size) OVER before, 0)) / sum(weight) OVER rest AS level
  FROM sources
  WINDOW before AS (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), rates AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM filled), CAST(2 * source_size AS DOUBLE)) AS target,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 6) AS BIGINT) AS shift
  FROM filled
), summed AS (
  SELECT doc_id, r.source, size, source_size, target, shift, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216) ELSE 0 END AS BIGINT) AS expected,
    CAST(sum(CAST(CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216) ELSE 0 END AS BIGINT)) OVER (PARTITION BY r.source ORDER BY size, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) + shift AS upto
  FROM rows r JOIN rates s ON r.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, source, size, source_size, target, size * ((upto >> 24) - ((upto - expected) >> 24)) AS taken, (upto >> 24) - ((upto - expected) >> 24) AS copies
FROM summed
"""
