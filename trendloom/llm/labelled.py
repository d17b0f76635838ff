"""Bounded samples of labelled rows and the hold-out folds of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.graph import stored

CELLS = 4096
SAMPLE_BYTES = 32 << 20  # of text that one label may bring to the driver


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def picked_ids(documents: DataFrame, labels: DataFrame, label: str, id_col: str, train: Column, per_label: tuple[int, int]) -> DataFrame:
    """(__id, __y, __h): ids of least hash whose rows number at most `per_label[y]` for label y; works on ids alone, no text is read.

    Cells of the hash range, twice as wide as the sample needs, are taken in order; a cell that would pass the bound is skipped, so an id
    that repeats more often than that is never learned from.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    copies = documents.where(train & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n"))
    known = stored(copies.join(marks, "__id").withColumn("__h", F.shiftrightunsigned(F.xxhash64("__id", F.lit(5)), 11)), "labelled")
    totals = {r[0]: r[1] for r in known.groupBy("__y").agg(F.sum("__n")).collect()}
    width = {y: max(1, min((1 << 53), int((1 << 53) * 2 * per_label[y] / totals.get(y, 1))) // CELLS + 1) for y in (0, 1)}
    cell = F.when(F.col("__y") == 0, F.floor(F.col("__h") / width[0])).otherwise(F.floor(F.col("__h") / width[1])).alias("__cell")
    near = known.select("*", cell).where(F.col("__cell") < CELLS)
    taken = []
    for y in (0, 1):
        rest = per_label[y]
        for r in near.where(F.col("__y") == y).groupBy("__cell").agg(F.sum("__n").alias("n")).orderBy("__cell").collect():
            if r["n"] <= rest:
                rest -= r["n"]
                taken.append((y, r["__cell"]))
    cells = documents.sparkSession.createDataFrame(taken, "__y int, __cell long")
    return near.join(F.broadcast(cells), ["__y", "__cell"]).select("__id", "__y", "__h")  # at most 2 * CELLS rows


def sample_per_label(documents: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, train: Column, per_label: tuple[int, int], most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most `per_label[y]` (text, label) rows of label y, 0 and 1, and at most `most_bytes` of whole texts each; all a classifier learns from.

    Rows come in the order of an id hash, so reruns agree. Ids with several labels take the largest; null labels and texts are left out.
    """
    picked = picked_ids(documents, labels, label, id_col, train, per_label)
    rows = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    texts = stored(rows.join(F.broadcast(picked), "__id"), "sample")  # the pick has at most sum(per_label) rows, whatever the input
    key = ["__y", "__h", "__id", F.md5("__t").alias("__m")]
    sizes = texts.select(*key, F.octet_length("__t").alias("__size")).collect()
    left, fits = [most_bytes, most_bytes], []
    for y, h, _, m, size in sorted(sizes):
        left[y] -= size
        if left[y] >= 0:
            fits.append((y, h, m))
    if len(fits) < len(sizes):
        whole = documents.sparkSession.createDataFrame(sorted(set(fits)), "__y int, __h long, __m string")
        texts = texts.withColumn("__m", F.md5("__t")).join(F.broadcast(whole), ["__y", "__h", "__m"]).drop("__m")
    return [(r["__t"], r["__y"]) for r in sorted(texts.select(*key, "__t").collect())]
