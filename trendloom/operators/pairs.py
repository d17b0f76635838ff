"""Similarity of run topics and portfolio entries, computed where the entries lie.

Topics of the runs go to the tasks in blocks of bounded size; entries stay in their partitions, however many there are. A task scores a
block of entries against all topics of their run at once and passes on scores only, and of these, if asked, just the strongest of each topic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.tables import written

PAIR = ["run_id", "cur", "known"]
TOPICS_AT_ONCE = 4096  # topics of all runs that go to the tasks at once
CELLS_AT_ONCE = 1 << 20  # scores a task holds at once


def dense(vectors: list, dim: int) -> np.ndarray:
    """Rows of doubles; vectors that are missing or of another length count as zero."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = [np.nan if x is None else x for x in v]
    return np.nan_to_num(out)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of all rows, added up dimension by dimension, so equal vectors give equal values wherever they stand."""
    total = np.zeros((len(left), len(right)))
    for d in range(left.shape[1]):
        total += left[:, d, None] * right[None, :, d]
    return total


def lengths(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += rows[:, d] * rows[:, d]
    return np.sqrt(total)


def overlap(both: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    union = left + right - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


class RunTopics:
    """The topics of one run in a block, with their words turned into an index."""

    def __init__(self, rows: list):
        self.cur = [r["cur"] for r in rows]
        self.place = {c: k for k, c in enumerate(self.cur)}
        self.dim = max((len(r["v"]) for r in rows if r["v"] is not None), default=0)
        self.vectors = dense([r["v"] for r in rows], self.dim)
        self.norms = lengths(self.vectors)
        self.n_docs = np.array([r["n_cur"] for r in rows], dtype=float)
        self.n_words = np.array([len(r["kv"] or ()) for r in rows], dtype=float)
        self.keep = rows[0]["keep"]
        self.by_word: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            for w in r["kv"] or ():
                self.by_word.setdefault(w, []).append(k)

    def scores(self, entries: list[dict]) -> np.ndarray:
        """Entries x topics."""
        w = dense([e["w"] for e in entries], self.dim)
        both_norms = self.norms[None, :] * lengths(w)[:, None]
        cosine = np.divide(products(w, self.vectors), both_norms, out=np.zeros_like(both_norms), where=both_norms > 0)
        docs, words = np.zeros_like(cosine), np.zeros_like(cosine)
        for i, e in enumerate(entries):
            for pair in e["shared"] or ():
                k = self.place.get(pair["cur"])
                if k is not None:
                    docs[i, k] = pair["n"]
            for word in e["kw"] or ():
                for k in self.by_word.get(word, ()):
                    words[i, k] += 1
        n_docs = np.array([e["n_known"] for e in entries], dtype=float)[:, None]
        n_words = np.array([len(e["kw"] or ()) for e in entries], dtype=float)[:, None]
        return 0.65 * np.maximum(0.0, cosine) + 0.20 * overlap(docs, self.n_docs[None, :], n_docs) + 0.15 * overlap(words, self.n_words[None, :], n_words)


class Strongest:
    """The `keep` strongest entries of each topic among those seen, equal scores by entry."""

    def __init__(self, topics: RunTopics):
        self.topics, self.pool, self.size = topics, [], 0

    def add(self, scores: np.ndarray, entries: list[dict]) -> None:
        keep = self.topics.keep
        known, status = (np.array([e[c] for e in entries], dtype=object) for c in ("known", "status"))
        if len(entries) > keep:
            least = np.partition(scores, len(entries) - keep, axis=0)[len(entries) - keep]
            row, topic = np.nonzero(scores >= least[None, :])
        else:
            row, topic = (x.ravel() for x in np.indices(scores.shape))
        self.pool.append((topic, known[row], status[row], scores[row, topic]))
        self.size += len(row)
        if self.size > 4 * keep * len(self.topics.cur) + CELLS_AT_ONCE:
            self.cut()

    def cut(self) -> tuple:
        topic, known, status, score = (np.concatenate(c) for c in zip(*self.pool))
        order = np.lexsort((np.unique(known, return_inverse=True)[1], -score, topic))
        sorted_topic = topic[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_topic, sorted_topic)
        order = order[place < self.topics.keep]
        self.pool = [(topic[order], known[order], status[order], score[order])]
        self.size = len(order)
        return self.pool[0]


def _scorer(shared, strongest: bool, schema: pa.Schema):
    def batch_of(run, topics, topic, known, status, score):
        cur = [topics.cur[k] for k in topic]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([run] * len(cur), cur, list(known), list(status), list(score)), schema)], schema=schema)

    def run(batches):
        best: dict = {}
        for batch in batches:
            by_run: dict = {}
            for e in batch.to_pylist():
                if e["run_id"] in shared.value:
                    by_run.setdefault(e["run_id"], []).append(e)
            for run_id, entries in by_run.items():
                topics = shared.value[run_id]
                step = max(1, CELLS_AT_ONCE // len(topics.cur))
                for i in range(0, len(entries), step):
                    part = entries[i : i + step]
                    scores = topics.scores(part)
                    if strongest:
                        best.setdefault(run_id, Strongest(topics)).add(scores, part)
                    else:
                        row, topic = (x.ravel() for x in np.indices(scores.shape))
                        yield batch_of(run_id, topics, topic, [part[r]["known"] for r in row], [part[r]["status"] for r in row], scores.ravel())
        for run_id, pool in best.items():
            yield batch_of(run_id, pool.topics, *pool.cut())

    return run


def scored(current: DataFrame, known: DataFrame, current_docs: DataFrame, known_docs: DataFrame, strongest: bool = False, topics_at_once: int = TOPICS_AT_ONCE) -> DataFrame:
    """(run_id, cur, known, status, score) of every topic of a run with every entry offered to that run, or the strongest of each topic.

    current/known: run_id, cur or known, centroid, keywords (and status for known); docs: run_id, key, doc_id. `strongest` keeps, for each
    topic, as many entries as its run has topics, two at least. Document overlaps come from an equi-join on the document; an entry carries
    those it has. Topics are taken `topics_at_once` together.
    """
    spark = current.sparkSession
    sizes = lambda docs, key, name: docs.groupBy("run_id", key).agg(F.count("*").alias(name))
    both = current_docs.join(known_docs, ["run_id", "doc_id"]).groupBy(*PAIR).agg(F.count("*").alias("n"))
    shared = both.groupBy("run_id", "known").agg(F.collect_list(F.struct("cur", "n")).alias("shared"))
    entries = known.join(sizes(known_docs, "known", "n_known"), ["run_id", "known"], "left").join(shared, ["run_id", "known"], "left").select(
        "run_id", "known", "status", F.col("centroid").cast("array<double>").alias("w"), F.array_distinct("keywords").alias("kw"),
        F.coalesce("n_known", F.lit(0)).alias("n_known"), "shared",
    )
    keep = current.groupBy("run_id").agg(F.greatest(F.count("*"), F.lit(2)).alias("keep"))
    topics = written(current.join(sizes(current_docs, "cur", "n_cur"), ["run_id", "cur"], "left").join(keep, "run_id").select(
        "run_id", "cur", "keep", F.col("centroid").cast("array<double>").alias("v"), F.array_distinct("keywords").alias("kv"), F.coalesce("n_cur", F.lit(0)).alias("n_cur"),
    ), "topics")
    blocks = 1 + topics.count() // topics_at_once
    if blocks > 1:
        entries = written(entries, "entries")
    schema = current.sparkSession.createDataFrame([], "run_id bigint").schema
    for name, of in (("cur", current), ("known", known), ("status", known)):
        schema = schema.add(name, of.schema[name].dataType)
    schema = schema.add("score", "double")
    from pyspark.sql.pandas.types import to_arrow_schema

    found = None
    for block in range(blocks):
        rows = topics.where(F.pmod(F.xxhash64("run_id", "cur"), F.lit(blocks)) == block).orderBy("run_id", "cur").collect()
        by_run: dict = {}
        for r in rows:
            by_run.setdefault(r["run_id"], []).append(r)
        here = spark.sparkContext.broadcast({run: RunTopics(rs) for run, rs in by_run.items()})
        part = entries.mapInArrow(_scorer(here, strongest, to_arrow_schema(schema)), schema)
        found = part if found is None else found.union(part)
    if not strongest:
        return found
    order = Window.partitionBy("run_id", "cur").orderBy(F.desc("score"), "known")
    ranked = found.withColumn("place", F.row_number().over(order)).join(keep, "run_id").where("place <= keep")
    return ranked.select(*PAIR, "status", "score")
