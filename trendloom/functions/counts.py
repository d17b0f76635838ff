"""Counts of the terms of tokenised documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 8 << 20


def _piece(by: list[str], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Occurrences and documents of every term and group of the rows."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    groups = rows.select(by).append_column("at", pa.array(np.arange(len(rows)))).group_by(by).aggregate([("at", "list")])
    members = groups["at_list"].combine_chunks()
    group = np.empty(len(rows), dtype=np.int64)
    group[members.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), np.diff(members.offsets.to_numpy()))
    words = pc.split_pattern(rows["terms"].combine_chunks(), " ")
    coded = words.flatten().dictionary_encode()
    n, doc = len(coded.dictionary), np.repeat(np.arange(len(rows)), np.diff(words.offsets.to_numpy()))
    pairs, times = np.unique(doc * n + coded.indices.to_numpy(), return_counts=True)
    keys, place = np.unique(group[pairs // n] * n + pairs % n, return_inverse=True)
    arrays = [groups[c].combine_chunks().take(pa.array(keys // n)) for c in by] + [coded.dictionary.take(pa.array(keys % n))]
    arrays += [pa.array(np.bincount(place, times, len(keys)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(keys)))]
    return pa.RecordBatch.from_arrays(arrays, names=[*by, "term", "tf", "df"])


def counted_terms(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by, term, tf, df): how often every term occurs in the documents of a group, and in how many. tokens: by, terms (joined by spaces).

    Tasks count pieces of bounded text and pass on a row per group and term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                held, size = [*held, part], size + part.column("terms").nbytes
                if size > PIECE_BYTES:
                    yield _piece(by, held)
                    held, size = [], 0
        if held:
            yield _piece(by, held)

    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in by)
    parts = tokens.where("terms <> ''").select(*by, "terms").mapInArrow(run, f"{kinds}, term string, tf long, df long")
    return parts.groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
