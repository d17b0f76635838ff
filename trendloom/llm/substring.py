"""Operator 7, substring deduplication with a compressed FM-index per shard.

A shard is a bounded batch of candidate pieces. Its index keeps the Burrows-Wheeler transform of the pieces as a wavelet matrix of packed
bit planes with block counts. Documents' pieces stream through it by backward search, all at once: the interval of a growing match is
narrowed by two ranks a word, and once a match is `window` words long the interval is widened back to the block of suffixes that agree
on `window` words, so the matching statistic stays at the threshold. Intervals that reach it report the smallest document in their block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.arrays import NOT_SPACE, slices, word_spans
from trendloom.llm.repeats import KEY, covered_mask, keyed, repeated_spans, runs_per_piece, with_covered


class BitPlane:
    """Packed bits with a running count per 64-bit block."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros((-len(bits)) % 64 + 64, dtype=bool)
        self.words = np.packbits(np.concatenate((bits, pad)), bitorder="little").view(np.uint64)
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        inside = self.words[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.counts[block] + np.bitwise_count(inside)


class FMIndex:
    """Self-index of word sequences laid end to end; symbol 0 ends each sequence."""

    def __init__(self, sequence: np.ndarray, sigma: int, depth: int):
        n = len(sequence)
        self.n = n
        suffixes, self.block_start, self.block_end = self._order(sequence, depth)
        self.suffixes = suffixes
        bwt = sequence[suffixes - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=sigma)))).astype(np.int64)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.planes = []
        for level in range(self.levels - 1, -1, -1):
            bits = ((bwt >> level) & 1).astype(bool)
            self.planes.append(BitPlane(bits))
            bwt = np.concatenate((bwt[~bits], bwt[bits]))

    @staticmethod
    def _order(sequence: np.ndarray, depth: int):
        """Suffix order, and per position of it the block of suffixes that agree on at least `depth` symbols (by prefix doubling)."""
        n = len(sequence)
        _, rank = np.unique(sequence, return_inverse=True)
        rank = rank.astype(np.int64)
        have = 1
        blocks = None
        while True:
            step = min(have, depth - have) if have < depth else have
            nxt = np.concatenate((rank[step:], np.full(min(step, n), -1))) + 1
            order = np.argsort(rank * (n + 1) + nxt, kind="stable")
            key = (rank * (n + 1) + nxt)[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            fresh = np.empty(n, dtype=np.int64)
            fresh[order] = np.cumsum(new) - 1
            rank, have = fresh, have + step
            if have == depth and blocks is None:
                at = np.flatnonzero(new)
                number = np.cumsum(new) - 1
                blocks = at[number], np.concatenate((at[1:], [n]))[number]
                block_of = rank
            if new.all():
                break
        inverse = np.argsort(rank)
        if blocks is None:
            blocks = np.arange(n), np.arange(1, n + 1)
        else:  # the final order refines the blocks, so they stay contiguous
            number = block_of[inverse]
            new = np.concatenate(([True], number[1:] != number[:-1]))
            at = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            blocks = at[number], np.concatenate((at[1:], [n]))[number]
        return inverse, blocks[0], blocks[1]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i symbols of the transform."""
        lo = np.zeros(len(i), dtype=np.int64)
        hi = i.astype(np.int64)
        for plane, level in zip(self.planes, range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = plane.ones(lo), plane.ones(hi)
            lo = np.where(one, plane.zeros + a, lo - a)
            hi = np.where(one, plane.zeros + b, hi - b)
        return hi - lo

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """One backward step: intervals of symbol + match."""
        return self.first[symbol] + self.rank(symbol, lo), self.first[symbol] + self.rank(symbol, hi)


def match_words(window: int):
    def matcher(words, bounds, ids, starts, counts, anchors):
        """Pieces are indexed and streamed; every piece is in the index, so a backward step never runs empty."""
        sizes = np.diff(bounds)
        values, codes = np.unique(words, return_inverse=True)
        place = np.arange(len(words)) + np.repeat(np.arange(len(ids)), sizes)
        sequence = np.zeros(len(words) + len(ids), dtype=np.int64)
        sequence[place] = codes + 1
        index = FMIndex(sequence, len(values) + 1, window)
        owner = np.repeat(np.arange(len(ids)), sizes + 1)
        doc_at = ids[owner[index.suffixes]]
        heads = np.flatnonzero(np.concatenate(([True], index.block_start[1:] != index.block_start[:-1])))
        least = np.minimum.reduceat(doc_at, heads)
        block_no = np.zeros(index.n, dtype=np.int64)
        block_no[heads] = 1
        block_no = np.cumsum(block_no) - 1
        order = np.argsort(-sizes, kind="stable")
        lo, hi = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), index.n, dtype=np.int64)
        hits_piece, hits_offset = [], []
        for step in range(int(sizes.max())):
            live = order[: int(np.searchsorted(-sizes[order], -step, side="left"))]
            symbol = codes[bounds[live + 1] - 1 - step] + 1
            a, b = index.back(symbol, lo[live], hi[live])
            if step + 1 >= window:
                block = block_no[a]
                late = least[block] < ids[live]
                hits_piece.append(live[late])
                hits_offset.append((sizes[live] - 1 - step)[late])
                a, b = index.block_start[a], index.block_end[a]
            lo[live], hi[live] = a, b
        piece, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hits_piece, hits_offset))
        by = np.lexsort((offset, piece))
        return runs_per_piece(piece[by], offset[by])

    return matcher


def remove_repeated_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, anchor: int = 10) -> DataFrame:
    """Every input row with its columns plus kept string (words joined by one space), n_words, n_removed (long).

    Words are runs of bytes other than ASCII white space. A word covered by a `window`-word sequence that also starts in a row with a
    smaller id is removed. Null or blank text has no words and keeps the empty string. Repeats inside one row, and rows with equal ids,
    never remove each other; each text of a repeated id is cut by its own spans. Rows without id neither match nor change. Input columns of the names above are replaced. An empty table gives an empty result.
    """
    documents = keyed(documents, id_col, text_col)
    spans = repeated_spans(documents.select(id_col, text_col, KEY), id_col, text_col, NOT_SPACE, window, anchor, match_words(window), False)
    new = ["kept", "n_words", "n_removed"]
    rest = documents.drop(*new)
    old = [c for c in rest.columns if c != KEY]
    joined = with_covered(rest, spans, id_col)
    schema = T.StructType([f for f in rest.schema.fields if f.name != KEY] + [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def strip(batches):
        for batch in batches:
            text = batch.column(text_col)
            covered = batch.column("__covered").fill_null([])
            for lo, hi, buf, offs in slices(text):
                starts, ends, rows = word_spans(buf, offs, NOT_SPACE)
                keep = ~covered_mask(covered, rows, lo, hi)
                raw = buf.tobytes()
                kept = []
                for i in range(hi - lo):
                    a, b = rows[i], rows[i + 1]
                    if keep[a:b].all():
                        kept.append(b" ".join(raw[offs[i] : offs[i + 1]].split()))
                    else:
                        at = np.flatnonzero(keep[a:b]) + a
                        kept.append(b" ".join([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]))
                n = np.diff(rows)
                sums = np.concatenate(([0], np.cumsum(~keep)))
                part = batch.slice(lo, hi - lo)
                columns = [part.column(c) for c in old] + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n), pa.array(sums[rows[1:]] - sums[rows[:-1]])]
                yield pa.RecordBatch.from_arrays(columns, names=[*old, *new])

    return joined.mapInArrow(strip, schema)


def digest_rows(documents: DataFrame) -> DataFrame:
    done = remove_repeated_words(documents.select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], window: int) -> dict[int, tuple[int, int, str]]:
    """Small reference for tests: first document of every window."""
    import re

    words = {d: re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "") for d, t in rows}
    first: dict = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
