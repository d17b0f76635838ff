"""Seeds, query plans, relevance gates, expansion and snowball sampling over a document lake."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.constants import DEPTH_PROFILES, EXPANSION_STOP, MAX_SEED_QUERIES, PESTEL_LENSES, REGION_CONTEXT
from trendloom.functions.tables import written
from trendloom.functions.text import (
    EXPANSION_TOKEN,
    GATE_TOKEN,
    adjacent_pairs,
    expansion_words,
    gate_tokens,
    let,
    literal_array,
)
from trendloom.operators.dedup import batch_key
from trendloom.session import scratch_dir
from trendloom.streaming.stores import KeyedStore


def first_terms(terms: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Case-insensitive distinct terms in order of first appearance, at most `limit` (a size of the plan)."""
    clean = terms.withColumn("term", F.trim("term")).where(F.col("term") != "")
    firsts = clean.groupBy(F.lower("term").alias("folded")).agg(
        F.min_by("term", F.struct(*order)).alias("term"), F.min(F.struct(*order)).alias("first")
    )
    return firsts.orderBy("first").limit(limit).select("term", "first")


def merge_seeds(terms: DataFrame, limit: int = MAX_SEED_QUERIES) -> DataFrame:
    """terms: grp, ord, term; earlier groups win."""
    return first_terms(terms, ["grp", "ord"], limit).select("term", "first.grp", "first.ord")


def planned_queries(query: Column, region: Column, keywords: Column, holistic: Column) -> Column:
    """Query frontier of a request: focused query, keywords and, when asked for, the six lenses."""
    context = F.lit("")
    for name, words in REGION_CONTEXT.items():
        context = F.when(region == name, words).otherwise(context)

    def frontier(focused: Column) -> Column:
        lenses = F.transform(literal_array(PESTEL_LENSES), lambda lens: F.concat(focused, F.lit(" "), lens))
        chosen = F.when(holistic, lenses).otherwise(F.array().cast("array<string>"))
        trimmed = F.transform(F.concat(F.array(focused), keywords, chosen), lambda s: F.trim(s))
        return F.array_distinct(F.filter(trimmed, lambda s: s != ""))

    return let(F.trim(F.concat(query, F.lit(" "), context)), frontier)


def _keyword_terms(rows: DataFrame, top: int, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.posexplode(F.slice("keywords", 1, top)).alias("pos", "term"))


def seeds_from_feedback(feedback: DataFrame, trends: DataFrame, order: list[str], limit: int = 20) -> DataFrame:
    """Titles (corrected ones first-hand) and top keywords of confirmed and corrected trends."""
    useful = feedback.where(F.col("action").isin("confirm", "correct"))
    rows = useful.join(trends.select("trend_id", "title", "keywords"), "trend_id")
    fixed = (F.col("action") == "correct") & (F.col("field") == "title")
    titles = rows.select(*order, F.lit(-1).alias("pos"), F.when(fixed, F.col("new_value")).otherwise(F.col("title")).alias("term"))
    terms = titles.unionByName(_keyword_terms(rows, 3, order))
    return first_terms(terms, [*order, "pos"], limit)


def seeds_from_portfolio(canonicals: DataFrame, limit: int = 12) -> DataFrame:
    active = canonicals.where((F.col("status") == "active")).orderBy(F.desc("updated_at"), "canonical_id").limit(limit)
    return active.select("canonical_id", F.trim("title").alias("term")).where(F.col("term") != "")


def negative_terms(feedback: DataFrame, trends: DataFrame, canonicals: DataFrame, occurrences: DataFrame, order: list[str], limit: int = 20) -> DataFrame:
    """Top keywords of rejected trends, then of the latest topic of rejected portfolio entries."""
    keyed = trends.select("trend_id", "keywords")
    null = lambda c: F.lit(None).cast("string").alias(c)
    refused = feedback.where(F.col("action") == "reject").join(keyed, "trend_id")
    first = _keyword_terms(refused, 5, order).select(F.lit(0).alias("grp"), *order, null("entry"), "pos", "term")
    latest = occurrences.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.max_by("trend_id", F.struct("run_id", "occurrence_id")).alias("trend_id"))
    gone = canonicals.where(F.col("status") == "rejected").join(latest, "canonical_id").join(keyed, "trend_id")
    second = _keyword_terms(gone, 5, ["canonical_id"])
    zeros = [F.lit(0).cast(feedback.schema[c].dataType).alias(c) for c in order]
    second = second.select(F.lit(1).alias("grp"), *zeros, F.col("canonical_id").alias("entry"), "pos", "term")
    return first_terms(first.unionByName(second), ["grp", *order, "entry", "pos"], limit)


def relevant(docs: DataFrame, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """Lexical gate: drop documents with two or more excluded tokens, keep those sharing an included one.

    Both lists are query-sized (capped seeds and rejections), so they travel as literals.
    """
    wanted, unwanted = _token_set(include), _token_set(exclude)
    if not wanted:
        return docs
    tokens = gate_tokens(F.col("title"), F.col("text"))
    hits = lambda terms: F.size(F.array_intersect("_tokens", literal_array(sorted(terms))))
    rows = docs.withColumn("_tokens", tokens)
    if unwanted:
        rows = rows.where(hits(unwanted) < 2)
    return rows.where(hits(wanted) > 0).drop("_tokens")


def _token_set(terms) -> set[str]:
    return {t for term in terms for t in re.findall(GATE_TOKEN, (term or "").lower())}


def choose_gate(name: str, exclude: list[str]) -> str:
    """Rejections only count with an active gate, so `off` escalates when there are any."""
    return "keyword" if name == "off" and exclude else name


def keep_by_verdict(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """External verdicts per batch of documents; a batch without any verdict is kept whole.

    docs: batch_id, doc_id; verdicts: batch_id, doc_id for documents judged relevant, doc_id null for
    a batch judged without a hit.
    """
    judged = verdicts.select("batch_id").distinct().withColumn("judged", F.lit(True))
    chosen = verdicts.where("doc_id IS NOT NULL").select("batch_id", "doc_id", F.lit(True).alias("chosen")).distinct()
    rows = docs.join(judged, "batch_id", "left").join(chosen, ["batch_id", "doc_id"], "left")
    return rows.where(F.col("judged").isNull() | F.col("chosen")).drop("judged", "chosen")


def expansion_pairs(titles: DataFrame) -> DataFrame:
    """Adjacent word pairs of titles seen at least twice, most frequent first."""
    pairs = titles.select(F.explode(let(expansion_words(F.col("title"), EXPANSION_STOP), adjacent_pairs)).alias("p"))
    pairs = pairs.select("p.w1", "p.w2").where("w1 <> w2")
    return pairs.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n >= 2")


def expand_queries(titles: DataFrame, used: list[str], n: int = 4) -> DataFrame:
    """Up to n new two-word queries; pairs whose words were both searched already are skipped."""
    known = sorted({w.lower() for q in used for w in re.findall(EXPANSION_TOKEN, q or "")})
    pairs = expansion_pairs(titles)
    if known:
        pairs = pairs.where(~(F.col("w1").isin(*known) & F.col("w2").isin(*known)))
    return pairs.orderBy(F.desc("n"), "w1", "w2").limit(n).select(F.concat_ws(" ", "w1", "w2").alias("query"), "n")


def lake_search(docs: DataFrame, queries: list[str], per_query: int) -> DataFrame:
    """Best documents per query and source by shared tokens.

    All queries of a round are answered in one scan of the lake; the top-k per query and source is cut
    before the shuffle.
    """
    tokens = docs.withColumn("_tokens", gate_tokens(F.col("title"), F.col("text")))
    found = F.array(*[
        F.struct(F.lit(i).alias("query_no"), F.lit(q).alias("query"), F.size(F.array_intersect("_tokens", literal_array(sorted(_token_set([q]))))).alias("hits"))
        for i, q in enumerate(queries)
    ])
    hits = tokens.select("doc_id", "source_name", F.explode(F.filter(found, lambda x: x["hits"] > 0)).alias("q")).select("doc_id", "source_name", "q.*")
    best = Window.partitionBy("query_no", "source_name").orderBy(F.desc("hits"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_query)


class LakeIndex:
    """Postings and documents of a lake, written once; a search reads the postings of its tokens, a fetch the buckets of its documents.

    Postings are sorted by token and document over range partitions, so the files of a token are few, a frequent token has several, and
    the token filter skips all others by their statistics.
    """

    def __init__(self, docs: DataFrame, path: str | None = None):
        spark = docs.sparkSession
        path = path or scratch_dir(spark, "lake")
        every = docs.select("doc_id", "source_name", F.explode(gate_tokens(F.col("title"), F.col("text"))).alias("token"))
        every.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id").write.parquet(f"{path}/postings")
        self.postings = spark.read.schema(every.schema).parquet(f"{path}/postings")
        self.documents = KeyedStore(spark, f"{path}/documents", ["doc_id"], docs.schema)
        self.documents.put(docs, 0)
        self.sources = written(docs.select("source_name").distinct(), "sources")

    def search(self, queries: list[str], per_query: int) -> DataFrame:
        """Best documents per query and source by shared tokens; see `lake_search`."""
        asked = [(i, q, t) for i, q in enumerate(queries) for t in sorted(_token_set([q]))]
        terms = self.postings.sparkSession.createDataFrame(asked, "query_no int, query string, token string")
        mine = self.postings.where(F.col("token").isin(sorted({t for _, _, t in asked}))).join(F.broadcast(terms), "token")  # as many as the queries' words
        hits = mine.groupBy("doc_id", "source_name", "query_no", "query").agg(F.count("*").cast("int").alias("hits"))
        best = Window.partitionBy("query_no", "source_name").orderBy(F.desc("hits"), "doc_id")
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_query)

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Documents of `ids` (doc_id and other columns), joined to them."""
        return self.documents.lookup(ids.select("doc_id")).join(ids, "doc_id")


def snowball(
    docs: DataFrame | LakeIndex, seeds: list[str], profile: str = "standard", include: list[str] = (), exclude: list[str] = (), expand: int = 4,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Bounded snowball sample of the lake: documents, findings per round, source and query, queries used.

    Each round searches the new queries, drops documents already seen, applies the gate, fills the
    budget in search order and proposes new queries from the collected titles. The sample holds at
    most the budget of its profile. The lake is indexed once, or comes as an index, and a round reads what its queries
    and findings need; every round is written.
    """
    lake = docs if isinstance(docs, LakeIndex) else LakeIndex(docs)
    limits = DEPTH_PROFILES[profile]
    frontier = [s.strip() for s in seeds if s and s.strip()]
    used: list[str] = []
    sample = report = None
    collected = 0
    for round_no in range(1, limits["rounds"] + 1):
        done = {u.lower() for u in used}
        pending = [q for q in frontier if q.lower() not in done]
        if not pending or collected >= limits["max_docs"]:
            break
        used += pending
        found = written(lake.search(pending, limits["per_query"]), "found")
        counts = harvest(found, lake.sources, pending).withColumn("round", F.lit(round_no))
        report = counts if report is None else report.unionByName(counts)
        order = F.struct("query_no", "source_name", "rank")
        hits = found.groupBy("doc_id").agg(F.min(order).alias("turn"))
        batch = lake.fetch(hits).withColumn("doc_key", batch_key()).where(F.col("doc_key") != "")
        first = Window.partitionBy("doc_key").orderBy("turn", "doc_id")
        batch = batch.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1).drop("rn")
        if sample is not None:
            batch = batch.join(sample.select("doc_key"), "doc_key", "left_anti")
        kept = relevant(batch, list(include), list(exclude)) if include else batch
        taken = kept.orderBy("turn", "doc_id").limit(limits["max_docs"] - collected).withColumn("round", F.lit(round_no))
        sample = written(taken if sample is None else sample.unionByName(taken), "sample")
        collected = sample.count()
        if round_no < limits["rounds"] and collected < limits["max_docs"]:
            proposals = expand_queries(sample.select("title"), [*used, *seeds], expand)
            frontier += [r["query"] for r in proposals.collect() if r["query"] not in frontier]  # at most `expand` rows
    return sample, report, used


def harvest(found: DataFrame, sources: DataFrame, queries: list[str]) -> DataFrame:
    """Findings per source and query with zeros for pairs without a hit."""
    numbered = F.array(*[F.struct(F.lit(i).alias("query_no"), F.lit(q).alias("query")) for i, q in enumerate(queries)])
    grid = sources.select("source_name").distinct().select("source_name", F.explode(numbered).alias("q")).select("source_name", "q.*")
    counts = found.groupBy("query_no", "source_name").agg(F.count("*").alias("findings"))
    return grid.join(counts, ["query_no", "source_name"], "left").na.fill(0, ["findings"])
