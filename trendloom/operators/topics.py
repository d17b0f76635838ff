"""Clustering, class-based keywords, coherence and topic comparison."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.constants import MAX_TOPICS, STOP_WORDS
from trendloom.functions.counts import counted_terms
from trendloom.functions.joins import in_pieces, salted_join
from trendloom.functions.tables import written
from trendloom.functions.text import let, words
from trendloom.functions.vectors import as_doubles, cosine
from trendloom.operators.lda import topic_words

TOP_TERMS = 10


def cluster_count(n_docs: Column, n_topics: int | None = None, max_topics: int = MAX_TOPICS) -> Column:
    """Fixed number of clusters or about one per ten documents."""
    if n_topics:
        return F.greatest(F.lit(1), F.least(F.lit(n_topics).cast("bigint"), n_docs))
    tenth = F.floor(n_docs / 10)
    return F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(max_topics).cast("bigint"), F.when(tenth == 0, 1).otherwise(tenth)))


SCALE_BITS = 20  # clustered vectors are whole numbers up to 2**20, so distances and sums are exact in any order
COST_BITS = 16  # costs are summed in whole multiples of 2**16


def scaled_points(members: DataFrame) -> DataFrame:
    """(doc_id, v): vectors as whole numbers; the largest element of all becomes 2**SCALE_BITS. Null vectors are left out."""
    rows = members.where("embedding IS NOT NULL").select("doc_id", as_doubles(F.col("embedding")).alias("v"))
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    return written(rows.select("doc_id", F.transform("v", lambda x: F.round(x / largest * (1 << SCALE_BITS)).cast("long")).alias("v")), "points")


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centres) of whole numbers, by dimension."""
    out = np.zeros((len(v), len(centres)), dtype=np.int64)
    for d in range(v.shape[1]):
        gap = v[:, d, None] - centres[None, :, d]
        out += gap * gap
    return out


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(len(batch), -1)


def nearest(points: DataFrame, centres: list[list[int]]) -> DataFrame:
    """(doc_id, raw, cost): number of the nearest centre, the smaller on ties, and its squared distance."""
    table = np.array(centres, dtype=np.int64)

    def run(batches):
        for batch in batches:
            if len(batch):
                gaps = _distances(_vectors(batch), table)
                raw = gaps.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.int32()), pa.array(gaps[np.arange(len(raw)), raw])], names=["doc_id", "raw", "cost"])

    return points.mapInArrow(run, f"doc_id {points.schema['doc_id'].dataType.simpleString()}, raw int, cost long")


def _step_sums(points: DataFrame, fits: list[list[list[int]]]) -> dict:
    """{(fit, centre): (n, cost, sums)} of all fits in one pass; tasks pass on sums, one row per fit, centre and dimension reaches the driver."""
    tables = [np.array(c, dtype=np.int64) for c in fits]

    def run(batches):
        total: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            v = _vectors(batch)
            for f, table in enumerate(tables):
                gaps = _distances(v, table)
                raw = gaps.argmin(axis=1)
                cost = gaps[np.arange(len(raw)), raw] >> COST_BITS
                for c in np.unique(raw):
                    mine = raw == c
                    n, spent, sums = total.get((f, c), (0, 0, 0))
                    total[(f, c)] = n + int(mine.sum()), spent + int(cost[mine].sum()), sums + v[mine].sum(axis=0)
        rows = [(f, int(c), n, spent, s.tolist()) for (f, c), (n, spent, s) in total.items()]
        names = ["fit", "raw", "n", "cost", "sums"]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    parts = points.mapInArrow(run, "fit int, raw int, n long, cost long, sums array<long>")
    spread = parts.select("fit", "raw", "n", "cost", F.posexplode("sums").alias("d", "s"))
    found: dict = {}
    for r in spread.groupBy("fit", "raw", "d").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "cost", "s")]).orderBy("d").collect():
        n, cost, sums = found.setdefault((r["fit"], r["raw"]), (int(r["n"]), int(r["cost"]), []))
        sums.append(int(r["s"]))
    return found


def seed_candidates(points: DataFrame, k: int, seed: int, rounds: int = 3) -> tuple[list[list[int]], list[int]]:
    """At most 4k * rounds + 1 different points and how many points are nearest to each, the same for any partitioning.

    Every round, each point gets a fixed random number from its id and the seed; those below their share of the cost, about 2k of all, become
    candidates, 4k at most.
    """
    draw = lambda r: (F.pmod(F.xxhash64("doc_id", F.lit(seed * 1000 + r)), F.lit(1 << 40)) + 1) / float(1 << 40)
    chosen = {tuple(points.select(F.min(F.struct(draw(0).alias("u"), "v")).alias("m")).first()["m"]["v"])}
    for r in range(1, rounds + 1):
        costs = nearest(points, [list(c) for c in sorted(chosen)]).withColumn("cost", F.shiftright("cost", COST_BITS))
        whole = int(costs.agg(F.sum(F.col("cost").cast("decimal(38,0)"))).first()[0])
        if not whole:
            break
        hit = costs.where(draw(r) < F.col("cost") * (2.0 * k / whole)).select("doc_id", draw(r).alias("u")).orderBy("u", "doc_id").limit(4 * k)
        chosen |= {tuple(x["v"]) for x in points.join(F.broadcast(hit), "doc_id").select("v").collect()}  # of 4k ids
    candidates = [list(c) for c in sorted(chosen)]
    near = {raw: n for (_, raw), (n, _, _) in _step_sums(points, [candidates]).items()}
    return candidates, [near.get(i, 0) for i in range(len(candidates))]


def drawn_centres(candidates: list[list[int]], weights: list[int], k: int, seed: int) -> list[list[int]]:
    """k of the candidates, one by one, each with a chance in proportion to its weight and its squared distance from those drawn."""
    rng, table, picked = random.Random(seed), np.array(candidates, dtype=float), []
    far = np.ones(len(candidates))
    while len(picked) < min(k, len(candidates)):
        mass = far * weights
        rest = [j for j in range(len(candidates)) if j not in picked]
        picked.append(rng.choices(range(len(candidates)), mass.tolist())[0] if mass.sum() > 0 else rest[0])
        gaps = ((table - table[picked[-1]]) ** 2).sum(axis=1)
        far = gaps if len(picked) == 1 else np.minimum(far, gaps)
    return [candidates[i] for i in picked]


def lloyd(points: DataFrame, fits: list[list[list[int]]], iterations: int) -> tuple[list[list[int]], int]:
    """(centres, cost) of the cheapest of several fits after at most `iterations` steps, all made in the same passes.

    A centre moves to the rounded mean of its points, taken from exact sums; one without points stays.
    """
    fits, cost = [list(f) for f in fits], [0] * len(fits)
    for step in range(iterations + 1):
        sums = _step_sums(points, fits)
        cost = [sum(c for (g, _), (_, c, _) in sums.items() if g == f) for f in range(len(fits))]
        moved = [list(f) for f in fits]
        for (f, raw), (n, _, s) in sums.items():
            moved[f][raw] = [(2 * x + n) // (2 * n) for x in s]
        if moved == fits or step == iterations:
            break
        fits = moved
    best = min(range(len(fits)), key=lambda f: (cost[f], f))
    return fits[best], cost[best]


def renumbered(assigned: DataFrame) -> DataFrame:
    """(doc_id, label): clusters numbered by falling size, then by smallest document id."""
    sizes = assigned.groupBy("raw").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    numbers = sizes.select("raw", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("label"))
    return assigned.join(numbers, "raw").select("doc_id", "label")


def kmeans_labels(members: DataFrame, k: int, seed: int = 42, restarts: int = 10, iterations: int = 50) -> DataFrame:
    """Best of several k-means runs; labels are renumbered by size, then by smallest document id.

    The result does not depend on partitions or order: vectors are whole numbers, so sums are exact, starting points come from hashes of
    the ids, and ties go to the smaller number. Documents with a null vector get no label.
    """
    if k == 1:
        return members.select("doc_id", F.lit(0).alias("label"))
    points = scaled_points(members)
    if points.isEmpty():
        return members.select("doc_id", F.lit(0).alias("label")).limit(0)
    candidates, weights = seed_candidates(points, k, seed)
    centres, _ = lloyd(points, [drawn_centres(candidates, weights, k, seed + i) for i in range(restarts)], iterations)
    return renumbered(written(nearest(points, centres).select("doc_id", "raw"), "assigned"))


def terms(text: Column, stop_words=STOP_WORDS, bigrams: bool = False) -> Column:
    """Lower-cased word tokens without stop words, optionally with adjacent pairs appended."""
    kept = F.filter(words(text), lambda t: ~t.isin(*stop_words)) if stop_words else words(text)
    if not bigrams:
        return kept

    def with_pairs(ts: Column) -> Column:
        following = F.slice(ts, F.lit(2), F.greatest(F.size(ts), F.lit(1)))
        pairs = F.zip_with(ts, following, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(ts, F.array_compact(pairs))

    return let(kept, with_pairs)


def tokenised(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """`docs` with `terms` (joined by spaces) for `text`, written: its readers tokenise nothing again."""
    return written(docs.withColumn("terms", F.coalesce(F.array_join(terms(F.col("text"), stop_words), " "), F.lit(""))).drop("text"), "tokens")


def class_terms(docs: DataFrame, bigrams: bool = False, stop_words=STOP_WORDS, min_df: int = 1) -> DataFrame:
    """Term counts per (run, topic). `min_df` counts documents of the whole run, outliers included.

    A task counts the terms of a bounded piece of the text, since its counts take many times the room of the text.
    """
    listed = in_pieces(docs, "text").select("run_id", "topic_index", terms(F.col("text"), stop_words, bigrams).alias("terms"))
    if min_df > 1:  # read twice, tokenised once
        listed = written(listed, "tokens")
    tokens = listed.select("run_id", "topic_index", F.explode("terms").alias("term"))
    counted = tokens.groupBy("run_id", "topic_index", "term").agg(F.count("*").alias("tf"))
    if min_df <= 1:
        return counted
    distinct = listed.select("run_id", F.explode(F.array_distinct("terms")).alias("term"))
    frequent = distinct.groupBy("run_id", "term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return counted.join(frequent.select("run_id", "term"), ["run_id", "term"])


def keywords(counts: DataFrame, topn: int = 8) -> DataFrame:
    """Class-based TF-IDF ranking: tf * ln(1 + words per class / term total), best `topn` per class.

    The counts are written, because three steps read them. A (run, term) has at most a row per topic.
    """
    counts = written(counts, "terms")
    classes = counts.groupBy("run_id").agg(
        (F.sum("tf") / F.count_distinct("topic_index")).alias("avg_words")
    )
    total = F.sum("tf").over(Window.partitionBy("run_id", "term"))
    scored = counts.withColumn("total", total).join(F.broadcast(classes), "run_id")  # a row per run
    scored = scored.withColumn("score", F.col("tf") * F.ln(1 + F.col("avg_words") / F.col("total"))).where("score > 0")
    best = Window.partitionBy("run_id", "topic_index").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= topn).select(
        "run_id", "topic_index", "term", "tf", "score", "rank"
    )


def uniform_keywords(docs: DataFrame, topn: int = TOP_TERMS, min_df: int = 2) -> DataFrame:
    """Keywords for given hard labels; outliers shape the vocabulary but form no class."""
    return keywords(class_terms(docs, min_df=min_df).where("topic_index >= 0"), topn)


def counted_keywords(counts: DataFrame, topn: int = TOP_TERMS, min_df: int = 2) -> DataFrame:
    """`uniform_keywords` from counts (run_id, topic_index, term, tf, df) that may have several rows per topic and term."""
    each = counts.groupBy("run_id", "topic_index", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    whole = each.withColumn("of_run", F.sum("df").over(Window.partitionBy("run_id", "term")))
    return keywords(whole.where((F.col("of_run") >= min_df) & (F.col("topic_index") >= 0)).select("run_id", "topic_index", "term", "tf"), topn)


def topic_table(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Label, size and keyword list per topic."""
    listed = ranked.groupBy("run_id", "topic_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords")
    )
    sizes = docs.groupBy("run_id", "topic_index").agg(F.count("*").alias("size"))
    label = F.coalesce(
        F.when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, 3), ", ")),
        F.concat(F.lit("topic "), F.col("topic_index").cast("string")),
    )
    return sizes.join(listed, ["run_id", "topic_index"], "left").withColumn("label", label)


def degeneracy(n_docs: Column, found: Column, n_topics: int | None = None, max_topics: int = MAX_TOPICS) -> Column:
    """What to do with a clustering: single topic, keep, or recluster with `target` clusters."""
    root = F.bround(F.sqrt(n_docs / 2), 0).cast("bigint")
    target = F.lit(n_topics).cast("bigint") if n_topics else F.least(F.lit(max_topics).cast("bigint"), F.greatest(F.lit(2).cast("bigint"), root))
    useful = F.least(target, F.greatest(F.lit(3).cast("bigint"), F.floor(target / 2)))
    action = (
        F.when(n_docs < 4, "single").when((n_docs >= target) & (found < useful), "recluster").otherwise("keep")
    )
    return F.struct(target.alias("target"), useful.alias("useful"), action.alias("action"))


def outliers(members: DataFrame, centroids: DataFrame, share: float = 0.95, digits: int = 6) -> DataFrame:
    """Label -1 for documents further from their centroid than `share` of their topic.

    The membership probability is the softmax of the similarities to all centroids of the run. The
    threshold is the exact percentile of the rounded distances, from counts per distance.
    """
    docs = members.where("topic_index >= 0").select("run_id", "doc_id", F.col("topic_index").alias("own"), as_doubles(F.col("embedding")).alias("v"))
    compared = salted_join(docs, centroids, ["run_id"], "doc_id").withColumn("sim", cosine(F.col("v"), F.col("centroid")))
    per_doc = compared.groupBy("run_id", "doc_id", "own").agg(
        F.max(F.when(F.col("topic_index") == F.col("own"), F.col("sim"))).alias("own_sim"), F.sum(F.exp("sim")).alias("total")
    ).select(
        "run_id", "doc_id", F.col("own").alias("topic_index"), F.round(1 - F.col("own_sim"), digits).alias("distance"),
        (F.exp("own_sim") / F.col("total")).alias("probability"),
    )
    # exact rank from counts per rounded distance: at most 10^digits rows per topic, whatever its size
    topic = Window.partitionBy("run_id", "topic_index")
    counts = per_doc.groupBy("run_id", "topic_index", "distance").agg(F.count("*").alias("n"))
    upto = counts.select("run_id", "topic_index", "distance", F.sum("n").over(topic.orderBy("distance")).alias("upto"), F.sum("n").over(topic).alias("total"))
    limits = upto.where(F.col("upto") >= F.ceil(share * F.col("total"))).groupBy("run_id", "topic_index").agg(F.min("distance").alias("limit"))
    flagged = per_doc.join(limits, ["run_id", "topic_index"])
    return flagged.withColumn("label", F.when(F.col("distance") > F.col("limit"), -1).otherwise(F.col("topic_index")))


def document_terms(docs: DataFrame, min_df: int = 5, max_df: float = 0.5, stop_words=STOP_WORDS, frequency: DataFrame | None = None) -> DataFrame:
    """Binary document-term pairs over the coherence vocabulary with document frequencies. docs: run_id, doc_id, text or `tokenised` terms.

    frequency: (run_id, term, df), if it has been counted before.
    """
    listed = docs if "terms" in docs.columns else tokenised(docs.select("run_id", "doc_id", "text"), stop_words)
    pairs = listed.select("run_id", "doc_id", F.explode(F.array_distinct(F.split("terms", " "))).alias("term")).where("term <> ''")
    sizes = listed.groupBy("run_id").agg(F.count("*").alias("n_docs"))
    frequency = counted_terms(listed, ["run_id"]) if frequency is None else frequency
    vocabulary = frequency.join(sizes, "run_id").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs")))
    return salted_join(pairs, vocabulary.select("run_id", "term", "df"), ["run_id", "term"], "doc_id")


def umass_coherence(ranked: DataFrame, doc_terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """UMass coherence per topic and, averaged, per run; topics with fewer than two known words are skipped.

    Co-occurrences are counted per document over the at most ten words of a topic it contains; these few words are broadcast, whatever the
    size of the files. Both inputs are written, because several steps read them. `by`: columns of `ranked` that tell topics of one index
    apart, as a model's name.
    """
    topic = ["run_id", *by, "topic_index"]
    doc_terms, ranked = written(doc_terms, "document_terms"), written(ranked, "ranked")
    shown = ranked.where(F.col("rank") <= TOP_TERMS).select(*topic, "term", "rank")
    vocabulary = doc_terms.select("run_id", "term", "df").distinct()
    present = written(vocabulary.join(F.broadcast(shown), ["run_id", "term"]).select(*topic, "term", "rank", "df"), "present")
    hits = doc_terms.select("run_id", "doc_id", "term").join(F.broadcast(present.drop("df")), ["run_id", "term"])
    times = {i: f"c{i}" for i in range(1, TOP_TERMS + 1)}  # how often a document has the word of rank i
    sets = hits.groupBy(*topic, "doc_id").agg(*[F.count_if(F.col("rank") == i).alias(c) for i, c in times.items()])
    kinds = sets.groupBy(*topic, *times.values()).agg(F.count("*").alias("n"))  # documents that show the same words are one row
    pair = F.array(*[F.struct(F.lit(i).alias("hi"), F.lit(j).alias("lo"), (F.col(times[i]) * F.col(times[j])).alias("times")) for i in times for j in times if j < i])
    together = kinds.select(*topic, "n", F.explode(pair).alias("p")).groupBy(*topic, "p.hi", "p.lo").agg(F.sum(F.col("n") * F.col("p.times")).alias("co"))
    a = present.select(*topic, F.col("rank").alias("hi"))
    b = present.select(*topic, F.col("rank").alias("lo"), "df")
    expected = a.join(b, topic).where("hi > lo")
    joined = expected.join(together, [*topic, "hi", "lo"], "left")
    score = F.ln((F.coalesce("co", F.lit(0)) + 1) / (F.col("df") + 1e-12))
    return joined.groupBy(*topic).agg(F.avg(score).alias("coherence"))


def topic_diversity(ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    top = ranked.where(F.col("rank") <= TOP_TERMS)
    return top.groupBy("run_id", *by).agg((F.count_distinct("term") / F.count("*")).alias("diversity"))


def lda_keywords(
    docs: DataFrame, n_topics: int, frequency: DataFrame | None = None, seed: int = 42, iterations: int = 25, min_df: float = 5, max_df: float = 0.5
) -> DataFrame:
    """Top terms per topic of an LDA baseline; see `lda`. docs: doc_id, text or `tokenised` terms; frequency: (term, df) of these, if counted before."""
    listed = docs if "terms" in docs.columns else docs.select("doc_id", terms(F.col("text")).alias("terms"))
    return topic_words(listed, n_topics, seed, iterations, min_df, max_df, TOP_TERMS, frequency)


def comparison_report(named: dict[str, DataFrame], doc_terms: DataFrame, outlier_counts: dict[str, DataFrame]) -> DataFrame:
    """Topics, outliers, coherence and diversity per model; inputs are ranked keyword tables.

    The documents are read once for all models, and only for words that a topic shows: ten per topic, so the driver can name them.
    """
    of = lambda tables, *columns: reduce(DataFrame.unionByName, [t.select("run_id", F.lit(m).alias("model"), *columns) for m, t in tables.items()])
    shown, key = written(of(named, "topic_index", "term", "rank"), "shown"), ["run_id", "model"]
    words = [r["term"] for r in shown.where(F.col("rank") <= TOP_TERMS).select("term").distinct().collect()]
    coherence = umass_coherence(shown, doc_terms.where(F.col("term").isin(words)), ("model",))
    report = shown.groupBy(*key).agg(F.count_distinct("topic_index").alias("n_topics"))
    report = report.join(coherence.groupBy(*key).agg(F.avg("coherence").alias("coherence_umass")), key, "left").join(topic_diversity(shown, ("model",)), key, "left")
    report = report.join(of(outlier_counts, "n_outliers"), key, "left") if outlier_counts else report.withColumn("n_outliers", F.lit(0).cast("bigint"))
    return report.na.fill(0, ["n_outliers"]).select("model", "run_id", "n_topics", "n_outliers", "coherence_umass", "diversity")


def dominant_geo(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Most frequent region and country per topic, nulls ignored; the first seen wins ties."""
    def mode(column: str) -> DataFrame:
        counts = docs.where(F.col(column).isNotNull()).groupBy("run_id", "topic_index", column).agg(
            F.count("*").alias("n"), F.min(order).alias("first")
        )
        return counts.groupBy("run_id", "topic_index").agg(F.max_by(column, F.struct("n", -F.col("first"))).alias(column))

    topics = docs.select("run_id", "topic_index").distinct()
    keys = ["run_id", "topic_index"]
    return topics.join(mode("region"), keys, "left").join(mode("country"), keys, "left")
