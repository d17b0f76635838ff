"""Operator 1, near-duplicate documents by ProbMinHash, banding and verification.

Every weighted 5-word shingle is a Poisson process of arrivals whose rate is its weight; each arrival goes to a random slot of the signature,
and a slot keeps the shingle that arrives first, so two slots agree with the probability Jaccard similarity of the texts. A shingle stops as
soon as its next arrival is later than every slot's first one. Bands of slots propose candidates; shingle sets verify them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.arrays import ALNUM, LOWER, Rolling, hash_spans, ids_of, mix, slices, stream, word_spans
from trendloom.llm.graph import components, stored

SHINGLE = 5
BANDS = 72
ROWS = 8
BLOCK = 1000
SKETCH_BYTES = 1 << 18  # of text a task draws arrivals for at once


def shingles_of(buf: np.ndarray, offs: np.ndarray):
    """Distinct shingles of rows laid end to end: (row, hash, count), sorted by row and hash; and words and sequence digest per row.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A row of one to four words has one shingle, all of it.
    """
    low = LOWER[buf]
    starts, ends, rows = word_spans(low, offs, ALNUM)
    tokens = hash_spans(low, starts, ends)
    roll = Rolling(tokens)
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64)))
    at = np.arange(len(row)) - np.searchsorted(row, row, side="left") + rows[row]
    value = roll.ranges(at, np.minimum(at + SHINGLE, rows[row + 1]), 11)
    digest = roll.ranges(rows[:-1], rows[1:], 13)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return row[first], value[first], np.diff(np.concatenate((first, [len(row)]))), n, digest


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """ProbMinHash with interleaved arrivals: (n_rows, slots) shingle hashes; rows without shingles hold zeros."""
    first = np.full(n_rows * slots, np.inf)
    winner = np.zeros(n_rows * slots, dtype=np.uint64)
    live, time, drawn, block = np.arange(len(row)), np.zeros(len(row)), 0, 1
    while len(live):
        salt = stream(drawn + block, 17)[drawn:]
        draw = mix(value[live, None] ^ salt[None, :])
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight[live, None]
        when = time[live, None] + np.cumsum(gap, axis=1)
        slot = row[live, None] * slots + (mix(draw) % np.uint64(slots)).astype(np.int64)
        who = np.broadcast_to(value[live, None], when.shape).ravel()
        w, s = when.ravel(), slot.ravel()
        better = w < first[s]
        w, s, who = w[better], s[better], who[better]
        np.minimum.at(first, s, w)
        won = first[s] == w
        winner[s[won]] = who[won]
        time[live] = when[:, -1]
        last = first.reshape(n_rows, slots).max(axis=1)
        live = live[time[live] < last[row[live]]]
        drawn += block
        block = min(64, 2 * block) if drawn > 1 else 1
    return winner.reshape(n_rows, slots)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted hashes, weights); with equal weights the plain Jaccard."""
    union = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(union)), np.zeros(len(union))
    wa[np.searchsorted(union, a[0])] = a[1]
    wb[np.searchsorted(union, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = wa / wb
    order = np.argsort(-ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    sum_a, rest_b = np.cumsum(wa), wb.sum() - np.cumsum(wb)
    end = len(ratio) - np.searchsorted(ratio[::-1], ratio, side="left") - 1  # last place of an equal ratio
    both = (wa > 0) & (wb > 0)
    return float((1 / (sum_a[end[both]] / wa[both] + rest_b[end[both]] / wb[both])).sum())


def sketches(docs: DataFrame, bands: int, rows: int, counts: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = ids_of(batch.column(0))
            for lo, hi, buf, offs in slices(batch.column(1), SKETCH_BYTES):
                row, value, count, words, digest = shingles_of(buf, offs)
                sig = signatures(row, value, count.astype(np.float64) if counts else np.ones(len(row)), hi - lo, bands * rows)
                second = np.zeros(hi - lo, dtype=np.uint64)
                np.add.at(second, row, mix(value) * count.astype(np.uint64))
                keys = np.zeros((hi - lo, bands), dtype=np.uint64)
                for r in range(rows):
                    keys = mix(keys ^ sig[:, r::rows] ^ stream(bands, 19)[None, :])
                offsets = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi]), pa.array(digest.view(np.int64)), pa.array(second.view(np.int64)), pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))],
                    names=["id", "d1", "d2", "words", "bands"],
                )

    return docs.mapInArrow(run, "id long, d1 long, d2 long, words long, bands array<long>")


def shingle_sets(docs: DataFrame, slots: int, counts: bool) -> DataFrame:
    """(id, set, sig): sorted shingle hashes and counts as packed 64-bit and 32-bit numbers; 16 bits of each signature slot."""

    def run(batches):
        for batch in batches:
            ids = ids_of(batch.column(0))
            for lo, hi, buf, offs in slices(batch.column(1), SKETCH_BYTES):
                row, value, count, _, _ = shingles_of(buf, offs)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                weight = count.astype(np.float64) if counts else np.ones(len(row))
                sig = signatures(row, value, weight, hi - lo, slots).astype(np.uint16)
                packed = [value[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(packed, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "set", "sig"])

    return docs.mapInArrow(run, "id long, set binary, sig binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float, counts: bool) -> DataFrame:
    """The pairs (a, b) with the similarity of their shingle sets; `near` says whether it is at least `least`."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            alike = [likeness(unpack(x.as_py(), counts), unpack(y.as_py(), counts), counts) for x, y in zip(batch.column(2), batch.column(3))]
            columns = [batch.column(0), batch.column(1), pa.array(alike, pa.float64()), pa.array([x >= least for x in alike], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "alike", "near"])

    return two.mapInArrow(run, "a long, b long, alike double, near boolean")


def unpack(raw: bytes, counts: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, dtype=np.uint64, count=n), np.frombuffer(raw, dtype=np.uint32, offset=8 * n) if counts else np.ones(n)


def likeness(p, q, counts: bool) -> float:
    if counts:
        return similarity(p, q)
    union = len(np.union1d(p[0], q[0]))
    return (len(p[0]) + len(q[0]) - union) / union


def compared_in_blocks(rest: DataFrame, sets: DataFrame, least: float, counts: bool, slots: int) -> DataFrame:
    """Links (a, b) between members of one lead that are still in different components.

    `rest`: (lead, id, alike, home, label, blocks). The members of a lead are dealt over blocks; those outside the lead's component are the
    queries, sent to every block of their lead and compared there. A pair is verified if the signatures agree within 0.1 of `least` (six
    standard errors) and the distances to the lead do not rule it out. Only links leave the task.
    """
    member = rest.select("lead", "id", "alike", "label", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("query"))
    query = rest.where("home <> label").select("lead", "id", "alike", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"))
    rows = member.union(query).join(sets, "id").select("lead", "block", "query", "id", "alike", "label", "set", "sig")
    rows = rows.repartition("lead", "block").sortWithinPartitions("lead", "block", "query")

    def run(batches):
        at, held = None, None

        def blocks():
            for batch in batches:
                plain = [batch.column(i).to_numpy() for i in range(6)]
                cut = np.flatnonzero(np.diff(plain[0]) | np.diff(plain[1]) | np.diff(plain[2])) + 1
                for lo, hi in zip([0, *cut], [*cut, len(batch)]):
                    for a in range(lo, hi, 32):
                        b = min(a + 32, hi)
                        sig = np.frombuffer(b"".join(batch.column(7).slice(a, b - a).to_pylist()), dtype=np.uint16).reshape(-1, slots)
                        yield (plain[0][a], plain[1][a]), plain[2][a], [x[a:b] for x in plain[3:]], batch.column(6).slice(a, b - a).to_pylist(), sig

        for key, is_query, (ids, alike, label), raw, sig in blocks():
            if key != at:
                at, held = key, ([], [], [], [], [])
            if not is_query:
                for part, x in zip(held, (ids, alike, label, raw, sig)):
                    part.append(x)
                continue
            if isinstance(held, tuple) and held[0]:  # the members of a block come before its queries
                held = [np.concatenate(held[0]), np.concatenate(held[1]), np.concatenate(held[2]), [r for part in held[3] for r in part], np.concatenate(held[4])]
            if len(held[0]):
                agree = np.stack([(held[4] == one).mean(axis=1) for one in sig])
                close = (agree >= least - 0.1) & (np.abs(alike[:, None] - held[1][None, :]) <= 1 - least + 1e-9) & (label[:, None] != held[2][None, :])
                found = [(i, j) for i, j in zip(*np.nonzero(close)) if likeness(unpack(raw[i], counts), unpack(held[3][j], counts), counts) >= least]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found]), pa.array([held[0][j] for _, j in found])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicate_classes(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bands: int = BANDS, rows: int = ROWS, counts: bool = False
) -> DataFrame:
    """(id, class_id): per distinct non-null id, the smallest id of its class; two texts are linked from `least` similarity on.

    Shingle weights are their presence (the probability Jaccard is then the plain one) or, with `counts`, their numbers of occurrences.
    Texts without words (null, empty, signs only) are alone in their class. Rows that repeat an id count with one text, the least in byte order.
    A pair at the threshold misses all bands with probability (1 - least^rows)^bands, 2e-6 by default.

    Texts of equal words are one representative. Within a bucket all are compared with its most central member. Members still in different
    components after that are compared with each other, unless the triangle inequality of the distance rules a link out, so no link inside
    a bucket is lost.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = stored(sketches(docs, bands, rows, counts), "sketch")
    per_id = sketch.groupBy("id").agg(F.min(F.struct("d1", "d2", "words")).alias("x")).select("id", "x.*")
    exact = per_id.where("words > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = stored(exact.select("d1", "d2", "rep"), "copies")  # written first, so the join below may split a digest with many copies
    member = stored(per_id.join(copies, ["d1", "d2"], "left").select("id", F.when(F.col("words") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep"), "d1", "d2"), "member")
    only = sketch.where("words > 0").join(member.where("id = rep").select("id", "d1", "d2"), ["id", "d1", "d2"]).dropDuplicates(["id"])
    slots = only.select("id", F.explode("bands").alias("key"))
    sizes = slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(slots.join(sizes, "key"), "shared")
    central = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    ranked = shared.join(central, "id")
    lead = ranked.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("x")).select("key", (-F.col("x.minus")).alias("a"))
    pairs = shared.join(lead, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    wanted = shared.select("id").distinct()
    texts = docs.join(wanted, "id").select("id", "text")
    sets = stored(shingle_sets(texts, bands * rows, counts), "sets")
    tried = stored(verified(pairs, sets, least, counts), "verified")
    edges = tried.where("near").select("a", "b")
    labels = components(spark, edges)
    of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}"))
    star = tried.select("a", "b", "alike").join(of("a"), "a", "left").join(of("b"), "b", "left")
    star = star.select(F.col("a").alias("lead"), F.col("b").alias("id"), "alike", F.coalesce("label_a", "a").alias("home"), F.coalesce("label_b", "b").alias("label"))
    sizes = star.groupBy("lead").agg(F.count("*").alias("n"), F.sum((F.col("home") != F.col("label")).cast("long")).alias("away")).where("away > 0 AND n > 1")
    rest = stored(star.join(sizes.select("lead", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lead"), "rest")
    more = stored(compared_in_blocks(rest, sets, least, counts, bands * rows), "verified")
    if more.limit(1).count():
        labels = components(spark, edges.union(more))
    classes = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return classes.select("id", F.coalesce("label", "rep").alias("class_id"))


def class_rows(documents: DataFrame) -> DataFrame:
    """The query's columns: doc_id, class_id and whether the document stays (the smallest id of its class)."""
    found = near_duplicate_classes(documents.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def brute_force(rows: list[tuple[int, str]], least: float = 0.8) -> dict[int, int]:
    """Small reference for tests: all pairs of exact shingle sets."""
    import re

    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else frozenset()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if common >= least * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
    return {d: find(d) for d in ids}
