"""Repeated windows over a whole corpus: shared plan of the two passage deduplication operators.

1. Every row is cut into runs of windows that share an anchor (`arrays.segments`); equal windows meet at equal anchors.
2. Anchors seen once cannot hold a repeated window and leave. Anchors in very many runs (found by a counting pass, at most one per
   `1/HOT_SHARE` of all runs) are avoided by the other anchors of their windows, so no anchor gathers an unbounded group.
3. Runs of identical content are merged into one piece with its first place (partial aggregates, so thousands of copies cost nothing).
4. Pieces that share an anchor but differ go to a matcher, in batches of bounded size. It reports which windows of a piece also start
   earlier in another piece.
5. Spans return to the rows that hold the piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.graph import stored

from trendloom.llm.arrays import hash_spans, ids_of, mix, raw_text, segments, slices, stream, word_spans

HOT_SHARE = 2000
SALTS = 64
PIECE_TOKENS = 1 << 22
BATCH_TOKENS = 1 << 20
SPANS = "array<struct<a:int,b:int>>"
#: Tells apart the texts of one id; rows with equal id and text count as one.
KEY = "__key"
NO_HOT = np.zeros(0, dtype=np.uint64)


def tokens_of(buf, offs, table):
    """Token values, row boundaries in tokens, and byte spans: words of a byte table, or single bytes if it is None."""
    if table is None:
        return (stream(256, 3))[buf], offs, None
    starts, ends, rows = word_spans(buf, offs, table)
    return hash_spans(buf, starts, ends), rows, (starts, ends)


def runs_of(column: pa.Array, table, window: int, k: int, hot: np.ndarray):
    """(row, anchor, first window, windows, digest) arrays of a text column, slice by slice."""
    for lo, hi, buf, offs in slices(column):
        tokens, rows, _ = tokens_of(buf, offs, table)
        for at in range(0, max(1, len(tokens)), PIECE_TOKENS):
            part = tokens[at : at + PIECE_TOKENS + window - 1]
            bounds = np.clip(rows - at, 0, len(part))
            anchor, first, count, digest = segments(part, bounds, window, k, hot)
            first = first + at
            row = np.searchsorted(rows, first, side="right") - 1
            yield lo + row, anchor, first - rows[row], count, digest


def heavy_anchors(docs: DataFrame, table, window: int, k: int) -> np.ndarray:
    """Anchors in at least one of HOT_SHARE runs, and at least 256: an exact count per anchor after each task drops its light ones.

    An anchor of that share holds half of it in the tasks that report it, so the answer has at most 4 * HOT_SHARE values.
    """

    def count(batches):
        kept, total = [], 0

        def flush():
            if not total:
                return None
            value, n = np.unique(np.concatenate(kept), return_counts=True)
            heavy = n >= max(2, total // (2 * HOT_SHARE))
            if heavy.sum() > 4 * HOT_SHARE:  # a short task: every repeated value would pass
                heavy = n >= np.sort(n)[-4 * HOT_SHARE]
            out = [pa.array(value[heavy].view(np.int64)), pa.array(n[heavy].astype(np.int64)), pa.array(np.zeros(heavy.sum(), np.int64))]
            one = [pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(out, one)], names=["anchor", "n", "total"])

        for batch in batches:
            for _, anchor, _, _, _ in runs_of(batch.column(1), table, window, k, NO_HOT):
                kept.append(anchor)
                total += len(anchor)
                if total > 2_000_000:
                    yield flush()
                    kept, total = [], 0
        if total:
            yield flush()

    found = docs.mapInArrow(count, "anchor long, n long, total long")
    per = found.groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    total = per.agg(F.sum("total")).first()[0] or 0
    floor = max(256, total // HOT_SHARE)
    rows = per.where(F.col("n") >= floor).select("anchor").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def repeated_spans(texts: DataFrame, id_col: str, text_col: str, table, window: int, k: int, matcher, by_place: bool) -> DataFrame:
    """(id, key, covered) of the rows with tokens in windows that also start earlier; `covered` lists (start, spans) in token positions.

    `texts` has the KEY of `keyed`. Rows without id are left out. `by_place`: earlier means a smaller (id, start), else a smaller id. `matcher(words, bounds, ids,
    starts, counts, anchors)` gives per piece the windows that start earlier in another piece, as (piece, first window, windows).
    """
    docs = texts.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= (window if table is None else 2 * window - 1)))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(KEY).alias("key"))
    hot = heavy_anchors(docs, table, window, k)

    def salts(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """0 for most runs; those of heavy anchors are dealt over SALTS join keys by their row."""
        if not len(hot):
            return np.zeros(len(anchor), dtype=np.int8)
        heavy = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        return np.where(heavy, 1 + (mix(rows.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0).astype(np.int8)

    def cut(batches):
        for batch in batches:
            ids, keys = ids_of(batch.column(0)), ids_of(batch.column(2))
            for row, anchor, first, count, digest in runs_of(batch.column(1), table, window, k, hot):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(ids[row]), pa.array(keys[row]), pa.array((first << 24) | count), pa.array(salts(anchor, ids[row] ^ keys[row]))],
                    names=["anchor", "digest", "id", "key", "place", "salt"],
                )

    runs = docs.mapInArrow(cut, "anchor long, digest long, id long, key long, place long, salt byte")
    again = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.max("salt").alias("salt")).where("n > 1")
    shared = stored(runs.join(all_salts(again.select("anchor", "salt")), ["anchor", "salt"]), "runs")
    pieces = shared.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("id", "place", "key")).alias("first"), F.max("salt").alias("salt"))
    pieces = stored(pieces.select("anchor", "digest", "salt", "copies", F.col("first.id").alias("own"), F.col("first.place").alias("own_place"), F.col("first.key").alias("own_key")), "pieces")
    mixed = pieces.groupBy("anchor").count().where("count > 1").select("anchor")
    wanted = pieces.join(mixed, "anchor").groupBy("own", "own_key").agg(F.collect_list(F.struct("own_place", "anchor", "digest")).alias("wanted"))

    def fetch(batches):
        done = set()  # of rows with equal id and text the first gives the pieces
        for batch in batches:
            ids, keys = ids_of(batch.column("id")), ids_of(batch.column("key"))
            wants = batch.column("wanted").is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(wants).tolist():
                if (one := (int(ids[i]), int(keys[i]))) in done:
                    wants[i] = False
                done.add(one)
            batch = batch.filter(pa.array(wants))
            ids = ids[wants]
            want = batch.column("wanted")
            bounds, flat = want.offsets.to_numpy(), want.flatten()
            base = bounds[0]
            place, anchor, digest = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for lo, hi, buf, offs in slices(batch.column("text")):
                a, b = bounds[lo] - base, bounds[hi] - base
                if a == b:
                    continue
                tokens, rows, _ = tokens_of(buf, offs, table)
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                first, count = rows[row] + (place[a:b] >> 24), place[a:b] & 0xFFFFFF
                size = count + window - 1
                source = buf if table is None else tokens
                for c in range(0, len(row), 2000):
                    s, f = size[c : c + 2000], first[c : c + 2000]
                    at = np.arange(int(s.sum()), dtype=np.int64) - np.repeat(np.cumsum(s) - s, s) + np.repeat(f, s)
                    raw = np.ascontiguousarray(source[at])
                    ends = np.concatenate(([0], np.cumsum(s))) * raw.itemsize
                    content = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                    x = slice(a + c, min(a + c + 2000, b))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[x]), pa.array(digest[x]), pa.array(ids[lo:hi][row[c : c + 2000]]), pa.array(place[x]), content],
                        names=["anchor", "digest", "own", "own_place", "content"],
                    )

    # an outer join without filters: its exchange of the texts is the one the caller's last join uses again
    owners = texts.join(wanted, (texts[id_col] == wanted["own"]) & (texts[KEY] == wanted["own_key"]), "left").select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(KEY).alias("key"), "wanted"
    )
    content = owners.mapInArrow(fetch, "anchor long, digest long, own long, own_place long, content binary")

    def match(batches):
        kind = np.uint8 if table is None else np.uint64
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def solve():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            buf, offs = _binary(whole.column("content"))
            own, place = ids_of(whole.column("own")), ids_of(whole.column("own_place"))
            anchors, digests = ids_of(whole.column("anchor")), ids_of(whole.column("digest"))
            piece, first, count = matcher(buf.view(kind), offs // kind().itemsize, own, place >> 24, place & 0xFFFFFF, anchors)
            per = np.bincount(piece, minlength=len(own))
            some = np.flatnonzero(per)
            pairs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array((first + count + window - 1).astype(np.int32))], names=["a", "b"])
            offsets = np.concatenate(([0], np.cumsum(per[some]))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(anchors[some]), pa.array(digests[some]), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["anchor", "digest", "spans"]
            )

        for batch in batches:  # anchors come sorted: a batch may end only where the anchor changes
            anchors, done = ids_of(batch.column("anchor")), 0
            width = batch.column("content").nbytes // max(1, len(batch)) // kind().itemsize
            turn = np.flatnonzero(np.diff(anchors)) + 1
            if len(batch) and last is not None and anchors[0] != last and size >= BATCH_TOKENS:
                yield solve()
                held, size = [], 0
            for t in turn:
                if size + (t - done) * width >= BATCH_TOKENS:
                    held.append(batch.slice(done, t - done))
                    yield solve()
                    held, size, done = [], 0, int(t)
            if len(batch):
                held.append(batch.slice(done))
                size += (len(batch) - done) * width
                last = anchors[-1]
        if held:
            yield solve()

    by_anchor = content.repartition("anchor").sortWithinPartitions("anchor")
    found = by_anchor.mapInArrow(match, f"anchor long, digest long, spans {SPANS}").dropDuplicates(["anchor", "digest"])
    known = pieces.join(found, ["anchor", "digest"], "left").where("copies > 1 OR spans IS NOT NULL")
    place = shared.join(all_salts(known.drop("copies", "own_key")), ["anchor", "digest", "salt"])
    later = (F.col("id") > F.col("own")) | (F.lit(by_place) & (F.col("id") == F.col("own")) & (F.col("place") > F.col("own_place")))
    start, count = F.shiftright("place", 24).cast("int"), F.col("place").bitwiseAND(0xFFFFFF).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("a"), (count + (window - 1)).cast("int").alias("b")))
    place = place.select("id", "key", start.alias("start"), F.when(later, whole).otherwise(F.col("spans")).alias("spans")).where("spans IS NOT NULL")
    return place.groupBy("id", "key").agg(F.collect_set(F.struct("start", "spans")).alias("covered"))


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`documents` with ids as long and KEY, a digest of the text."""
    return documents.withColumn(id_col, F.col(id_col).cast("long")).withColumn(KEY, F.xxhash64(text_col))


def with_covered(rest: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """`rest` (with KEY) with the spans of each row as __covered."""
    found = spans.select(F.col("id").alias("__id"), F.col("key").alias("__of"), F.col("covered").alias("__covered"))
    return rest.join(found, (F.col(id_col) == F.col("__id")) & (F.col(KEY) == F.col("__of")), "left").drop("__id", "__of")


def _binary(column: pa.Array):
    buf, offs = raw_text(column)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def all_salts(df: DataFrame) -> DataFrame:
    """One row for each join key that the runs of a heavy anchor are dealt over."""
    keys = F.when(F.col("salt") > 0, F.sequence(F.lit(1), F.lit(SALTS)).cast("array<byte>")).otherwise(F.array(F.lit(0).cast("byte")))
    return df.withColumn("salt", F.explode(keys))


def earlier_windows(group: np.ndarray, ids: np.ndarray, starts: np.ndarray, by_place: bool) -> np.ndarray:
    """Per window, whether its group of equal windows has an earlier one: smaller (id, start), or smaller id."""
    n_groups = int(group.max()) + 1 if len(group) else 0
    if not by_place:
        least = np.full(n_groups, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        return ids > least[group]
    order = np.lexsort((starts, ids, group))
    g = group[order]
    lead = np.concatenate(([True], g[1:] != g[:-1]))
    head = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    out = np.empty(len(group), dtype=bool)
    out[order] = (ids[order] != ids[head]) | (starts[order] != starts[head])
    return out


def runs_per_piece(piece: np.ndarray, offset: np.ndarray):
    """Merge windows (sorted by piece, offset) into (piece, first window, number of windows)."""
    if not len(piece):
        return piece, offset, offset
    new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)))
    at = np.flatnonzero(new)
    return piece[at], offset[at], np.diff(np.concatenate((at, [len(piece)])))


def union_mask(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of n positions some [a, b) covers."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, np.minimum(a, n), 1)
    np.add.at(step, np.minimum(b, n), -1)
    return np.cumsum(step[:-1]) > 0


def covered_mask(covered, row_bounds: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Mask over the tokens of rows lo..hi from their `covered` column (list of (start, spans)); clipped to each row."""
    outer = covered.offsets.to_numpy()
    base = outer[0]
    items = covered.flatten()
    first, last = outer[lo] - base, outer[hi] - base
    item_row = np.repeat(np.arange(hi - lo), np.diff(outer[lo : hi + 1]))
    start = items.field(0).to_numpy(zero_copy_only=False)[first:last].astype(np.int64)
    spans = items.field(1)
    inner = spans.offsets.to_numpy()
    flat = spans.flatten()
    i0 = inner[0]
    a_all, b_all = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    per = np.diff(inner[first : last + 1])
    a, b = a_all[inner[first] - i0 : inner[last] - i0], b_all[inner[first] - i0 : inner[last] - i0]
    shift = np.repeat(start, per)
    row = np.repeat(item_row, per)
    low, high = row_bounds[row], row_bounds[row + 1]
    return union_mask(int(row_bounds[-1]), np.minimum(low + shift + a, high), np.minimum(low + shift + b, high))

