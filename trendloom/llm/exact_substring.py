"""Operator 4, suffix-array deduplication of byte passages by a depth-limited radix sort.

Suffixes are ordered only through the threshold length: every pass sorts the suffixes that still share a group by their next eight bytes,
most significant first, and suffixes alone in their group leave. Groups left after the last pass are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.arrays import slices
from trendloom.llm.repeats import KEY, covered_mask, earlier_windows, keyed, repeated_spans, runs_per_piece, with_covered


def equal_windows(text: np.ndarray, places: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit radix sort of the suffixes at `places` through `width` bytes.

    Returns the indexes of suffixes that share all `width` bytes and the first group with another one, and their group numbers.
    """
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    digits = np.ndarray(shape=(len(text) + 1,), dtype=">u8", buffer=padded, strides=(1,))
    alive = np.arange(len(places))
    depths = list(range(0, width - 7, 8)) + ([width - 8] if width % 8 and width > 8 else [])
    for depth in depths or [0]:
        digit = digits[places[alive] + depth].astype(np.uint64)
        if width < 8:
            digit >>= np.uint64(64 - 8 * width)
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]))) if len(g) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1 if len(number) else new
        alive, group = alive[order[keep]], number[keep]
    return alive, group


def match_bytes(window: int):
    def matcher(text, bounds, ids, starts, counts, anchors):
        piece = np.repeat(np.arange(len(ids)), counts)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        _, group = np.unique(anchors, return_inverse=True)
        alive, same = equal_windows(text, bounds[piece] + offset, group[piece], window)
        if not len(alive):
            return alive, alive, alive
        _, same = np.unique(same, return_inverse=True)
        late = alive[earlier_windows(same, ids[piece[alive]], starts[piece[alive]] + offset[alive], True)]
        late.sort()
        return runs_per_piece(piece[late], offset[late])

    return matcher


def remove_repeated_bytes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, anchor: int = 20) -> DataFrame:
    """Every input row with its columns plus kept binary, n_bytes, n_removed, n_spans (long).

    Bytes covered by a `window`-byte string that also starts earlier (smaller id, or same id and earlier start) are removed. Null text is
    empty; texts shorter than a window never change; of equal windows the first stays, whatever the ties. Rows without id neither match
    nor change. Different texts of one id are compared by (id, start) as well and cut each by its own spans; equal rows are treated
    alike. Input columns of the names above are replaced. An empty table gives an empty result.
    """
    documents = keyed(documents, id_col, text_col)
    spans = repeated_spans(documents.select(id_col, text_col, KEY), id_col, text_col, None, window, anchor, match_bytes(window), True)
    return apply_spans(documents, spans, id_col, text_col)


def apply_spans(documents: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    rest = documents.drop(*new)
    old = [c for c in rest.columns if c != KEY]
    joined = with_covered(rest, spans, id_col)
    schema = T.StructType([f for f in rest.schema.fields if f.name != KEY] + [T.StructField("kept", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in new[1:]])

    def strip(batches):
        for batch in batches:
            text = batch.column(text_col)
            covered = batch.column("__covered").fill_null([])
            for lo, hi, buf, offs in slices(text):
                gone = covered_mask(covered, offs, lo, hi)
                kept, sizes, removed, spans_n = [], np.diff(offs), [], []
                for i in range(hi - lo):
                    a, b = offs[i], offs[i + 1]
                    m = gone[a:b]
                    kept.append(buf[a:b][~m].tobytes())
                    removed.append(int(m.sum()))
                    spans_n.append(int((m[1:] & ~m[:-1]).sum() + (m[:1].sum())))
                part = batch.slice(lo, hi - lo)
                columns = [part.column(c) for c in old] + [pa.array(kept, pa.binary()), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans_n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*old, *new])

    return joined.mapInArrow(strip, schema)


def digest_rows(documents: DataFrame) -> DataFrame:
    """The query's columns; kept bytes as lower-case SHA-256."""
    done = remove_repeated_bytes(documents.select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], window: int) -> dict[int, tuple[int, int, int, str]]:
    """Small reference for tests: dictionary of windows in order of place."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            w = text[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out[doc] = (len(text), sum(gone), len([1 for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out
