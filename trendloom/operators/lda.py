"""Online variational LDA whose word weights are a table: nothing as long as the vocabulary passes through the driver or one task.

The steps are those of MLlib's online optimizer with its defaults; `LDA` there gathers a topics x vocabulary matrix on the driver at every
step. Here a step deals its documents to blocks of bounded text, brings each block the weights of its own words by a join, and sums what
the blocks learn per word. The driver keeps two numbers per topic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trendloom.functions.counts import counted_terms
from trendloom.functions.tables import written
from trendloom.session import scratch_dir

OFFSET, DECAY, SHARE, SHAPE = 1024.0, 0.51, 0.05, 100.0  # MLlib's learning offset and decay, share of a mini batch, shape of random starts
BLOCK_CHARS = 16 << 20
CHUNK = 1 << 15  # (document, word) pairs that are iterated at once


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln gamma for positive numbers: six steps of the recurrence, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    y, z = x + 6, x * (x + 5)
    r = 1 / (y * y)
    series = 0.5 / y + r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return np.log(y) - series - (2 * x + 5) * (1 / z + 1 / (z + 4) + 1 / (z + 6))  # 1 / (x + i) for i up to 5, in pairs


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, dtype=float), 0.0
    for _ in range(6):
        small = x < 6
        out = out + np.where(small, 1 / (x * x), 0.0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + 0.5 * r + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def expectation(x: np.ndarray) -> np.ndarray:
    """E[ln p] under Dirichlet(x), along the last axis."""
    both = digamma(np.concatenate([x, x.sum(axis=-1, keepdims=True)], axis=-1))
    return both[..., :-1] - both[..., -1:]


def gamma_draws(keys: np.ndarray, k: int) -> np.ndarray:
    """k numbers per 64-bit key, fixed by the key, as from Gamma(SHAPE, 1 / SHAPE) (Wilson and Hilferty's cube of a normal number)."""
    state = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, 2 * k + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((state ^ (state >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5
    u /= float(1 << 53)
    normal = np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * math.pi * u[:, k:])
    return (1 - 1 / (9 * SHAPE) + normal / (3 * math.sqrt(SHAPE))) ** 3


def infer(beta: np.ndarray, first: np.ndarray, word: np.ndarray, count: np.ndarray, gamma: np.ndarray, alpha: np.ndarray):
    """(gamma, sums): topic weights of documents after their iteration has settled, and what they add to exp(E[ln beta]) per word.

    Document i holds the pairs first[i] to first[i + 1] of (word, count), one at least; it stops once its mean change is 0.001.
    Documents iterate side by side, those of like length together, as rows filled up with pairs of count 0.
    """
    gamma, ends = gamma.copy(), np.asarray(first)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    at, active = 0, order[:0]
    while at < len(order) or len(active):
        longest = sizes[active if len(active) else order[at : at + 1]].max()
        fresh = order[at : at + max(int(not len(active)), CHUNK // longest - len(active))]  # they take the place of the settled
        active, at = np.concatenate([active, fresh]), at + len(fresh)
        places = np.arange(longest)
        pairs = np.minimum(ends[active][:, None] + places, len(word) - 1)
        b, c = beta[word[pairs]], np.where(places < sizes[active][:, None], count[pairs], 0.0)
        mine, moving = gamma[active], np.ones(len(active), dtype=bool)
        theta = np.exp(expectation(mine))
        while 4 * moving.sum() > 3 * len(active):  # the settled stay as they are, and leave in groups
            part = c / (np.matmul(b, theta[:, :, None])[:, :, 0] + 1e-100)
            after = np.where(moving[:, None], theta * np.matmul(part[:, None, :], b)[:, 0, :] + alpha, mine)
            moving, mine = np.abs(after - mine).mean(axis=1) > 1e-3, after
            theta = np.exp(expectation(mine))
        gamma[active] = mine
        active = active[moving]
    theta, sums = np.exp(expectation(gamma)), np.zeros((beta.shape[1], len(beta)))
    doc = np.repeat(np.arange(len(gamma)), sizes)
    for at in range(0, len(word), 16 * CHUNK):
        some = slice(at, at + 16 * CHUNK)
        mine = theta[doc[some]]
        share = count[some] / (np.einsum("pk,pk->p", beta[word[some]], mine) + 1e-100)
        for t in range(len(sums)):
            sums[t] += np.bincount(word[some], share * mine[:, t], len(beta))
    return gamma, sums.T * beta


def _weights(k: int) -> list[str]:
    return [f"t{i}" for i in range(k)]


def batches(tokens: DataFrame, seed: int, steps: int) -> DataFrame:
    """(step, block, words, first, word, count, keys): the documents of every step's mini batch as one row per block.

    tokens: doc_id, terms (joined by spaces). A document takes part in a step by a draw on its id; empty documents are left out.
    """
    chars = tokens.agg(F.sum(F.length("terms"))).first()[0] or 0
    wave = tokens.sparkSession.sparkContext.defaultParallelism
    blocks = wave * max(1, math.ceil(chars * SHARE / BLOCK_CHARS / wave))  # whole waves of tasks
    draw = lambda s: F.pmod(F.xxhash64("doc_id", F.lit(seed), s), F.lit(1 << 40)) < int(SHARE * (1 << 40))
    drawn = tokens.where("terms <> ''").select("doc_id", "terms", F.explode(F.filter(F.sequence(F.lit(1), F.lit(steps)), draw)).alias("step"))
    dealt = drawn.select(
        "step", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.xxhash64("doc_id", F.lit(seed), "step").alias("key"), "terms"
    )

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("terms", "ascending")])
        lists = pc.split_pattern(rows["terms"].combine_chunks(), " ")
        coded = lists.flatten().dictionary_encode()
        n, codes = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(lists.offsets.to_numpy()))
        pairs, count = np.unique(doc * n + codes, return_counts=True)
        first = np.searchsorted(pairs // n, np.arange(len(lists) + 1))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        return pa.table({
            "step": rows["step"].slice(0, 1), "block": rows["block"].slice(0, 1), "words": one(coded.dictionary, pa.string()), "first": one(first, pa.int32()),
            "word": one(pairs % n, pa.int32()), "count": one(count, pa.int32()), "keys": one(rows["key"].combine_chunks(), pa.int64()),
        })

    made = dealt.groupBy("step", "block").applyInArrow(build, "step int, block int, words array<string>, first array<int>, word array<int>, count array<int>, keys array<long>")
    path = scratch_dir(tokens.sparkSession, "batches")
    made.write.partitionBy("step").parquet(path)
    return tokens.sparkSession.read.schema(made.schema).parquet(path)


def vocabulary(tokens: DataFrame, n_docs: int, min_df: float, max_df: float, frequency: DataFrame | None = None) -> DataFrame:
    """Words of `min_df` documents at least and of a share of `max_df` at most. frequency: (term, df), if it has been counted before."""
    found = counted_terms(tokens.withColumn("run", F.lit(1)), ["run"]) if frequency is None else frequency.groupBy("term").agg(F.sum("df").alias("df"))
    return found.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).select("term")


def started(words: DataFrame, k: int, seed: int) -> DataFrame:
    """(term, t0, t1, ...): random weights, fixed by the word and the seed."""
    names = _weights(k)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            drawn = gamma_draws(part.column("key").to_numpy(), k)
            yield pa.RecordBatch.from_arrays([part.column("term"), *[pa.array(drawn[:, i]) for i in range(k)]], names=["term", *names])

    keyed = words.select("term", F.xxhash64("term", F.lit(seed)).alias("key"))
    return keyed.mapInArrow(run, "term string, " + ", ".join(f"{n} double" for n in names))


def learnt(batch: DataFrame, weights: DataFrame, totals: np.ndarray, alpha: np.ndarray, blocks: int) -> DataFrame:
    """(term, s0, s1, ..., docs): sums of a mini batch per word; of the null word the documents' E[ln theta] and their number."""
    k, names = len(alpha), _weights(len(alpha))
    sums = [f"s{i}" for i in range(k)]
    level = digamma(totals)

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        part = lambda name: block[name].combine_chunks().flatten()
        words, pos = part("words"), rows["pos"].to_numpy()
        place = np.full(len(words), -1, dtype=np.int64)
        place[pos] = np.arange(len(pos))
        word = place[part("word").to_numpy()]
        known = word >= 0  # words outside the vocabulary have no weights
        ends = np.concatenate([[0], np.cumsum(known)])[part("first").to_numpy()]
        full = np.flatnonzero(np.diff(ends))
        beta = np.stack([rows[n].to_numpy() for n in names], axis=1).astype(float)
        beta = np.exp(digamma(beta) - level)
        found, logs = np.zeros((len(pos), k)), np.zeros(k)
        if len(full):
            start = gamma_draws(part("keys").to_numpy()[full], k)
            gamma, found = infer(beta, np.append(ends[full], ends[-1]), word[known], part("count").to_numpy()[known].astype(float), start, alpha)
            logs = expectation(gamma).sum(axis=0)
        terms = pa.concat_arrays([words.take(pa.array(pos)).cast(pa.string()), pa.nulls(1, pa.string())])
        out = np.vstack([found, logs])
        return pa.table({"term": terms, **{s: pa.array(out[:, i], pa.float32()) for i, s in enumerate(sums)}, "docs": pa.array([0] * len(pos) + [len(full)], pa.int64())})

    asked = batch.select("block", F.posexplode("words").alias("pos", "term"))
    # weights and sums travel as floats; what they change is far below the 0.001 at which a document's iteration stops
    given = asked.join(weights, "term").select(F.col("block").alias("asking"), "pos", *[F.col(n).cast("float").alias(n) for n in names])
    schema = "term string, " + ", ".join(f"{s} float" for s in sums) + ", docs long"
    n = 4 * blocks  # few blocks share a task, and none are brought together
    parts = batch.repartition(n, "block").groupBy("block").cogroup(given.repartition(n, "asking").groupBy("asking")).applyInArrow(run, schema)
    return parts.groupBy("term").agg(*[F.sum(s).alias(s) for s in sums], F.sum("docs").alias("docs"))


def moved_alpha(alpha: np.ndarray, mean_log: np.ndarray, n: int, rate: float) -> np.ndarray:
    """A Newton step on the documents' prior, as far as it stays positive."""
    gradient = n * (mean_log - expectation(alpha))
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    moved = alpha - rate * (gradient - b) / q
    return moved if (moved > 0).all() else alpha


def topic_words(docs: DataFrame, k: int, seed: int, steps: int, min_df: float, max_df: float, topn: int, frequency: DataFrame | None = None) -> DataFrame:
    """(topic_index, term, score, rank): the `topn` words of largest share per topic. docs: doc_id, terms (array<string>, or a written table of strings).

    frequency: (term, df), in how many of the documents a word is, if it has been counted before.
    """
    if isinstance(docs.schema["terms"].dataType, StringType):
        tokens = docs.select("doc_id", "terms")
    else:
        tokens = written(docs.select("doc_id", F.coalesce(F.array_join("terms", " "), F.lit("")).alias("terms")), "tokens")
    n_docs = tokens.count()
    weights = written(started(vocabulary(tokens, n_docs, min_df, max_df, frequency), k, seed).withColumn("docs", F.lit(0).cast("long")), "weights")
    planned = batches(tokens, seed, steps)
    names, prior, alpha = _weights(k), 1.0 / k, np.full(k, 1.0 / k)

    def summed() -> tuple[np.ndarray, np.ndarray, int]:
        """Weights of all words, the documents' E[ln theta] and their number."""
        found = {r["words"]: r for r in weights.groupBy(F.col("term").isNotNull().alias("words")).agg(*[F.sum(n).alias(n) for n in names], F.sum("docs").alias("docs")).collect()}
        of = lambda words: np.array([found[words][n] for n in names]) if words in found else np.zeros(k)
        return of(True), of(False), found[False]["docs"] if False in found else 0

    done, (totals, _, _) = 0, summed()
    found = planned.groupBy("step").agg(F.max("block").alias("last")).collect()  # at most `steps` rows
    blocks = max((r["last"] for r in found), default=0) + 1
    for step in sorted(r["step"] for r in found):
        if not totals.all():
            break  # no vocabulary
        known = weights.where("term IS NOT NULL").select("term", *names)
        rate, scale = (OFFSET + done + 1) ** -DECAY, n_docs / math.ceil(SHARE * n_docs)
        sums = learnt(planned.where(F.col("step") == step), known, totals, alpha, blocks)
        new = [F.when(F.col("term").isNull(), F.col(f"s{i}")).otherwise((1 - rate) * F.col(n) + rate * (F.coalesce(f"s{i}", F.lit(0.0)) * scale + prior)).alias(n) for i, n in enumerate(names)]
        weights = written(known.join(sums, "term", "full").select("term", *new, "docs"), "weights")
        totals, logs, n = summed()
        if n:
            done += 1
            alpha = moved_alpha(alpha, logs / n, n, rate)
    known = weights.where("term IS NOT NULL").select("term", *names)
    each = known.select("term", F.posexplode(F.array(*names)).alias("topic_index", "weight"))
    best = Window.partitionBy("topic_index").orderBy(F.desc("weight"), "term")
    top = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= topn)
    totals = known.select(F.posexplode(F.array(*[F.sum(n) for n in names])).alias("topic_index", "total"))
    return top.join(totals, "topic_index").select("topic_index", "term", (F.col("weight") / F.col("total")).alias("score"), "rank")
