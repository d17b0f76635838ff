"""Description, classification, scoring and dimension analysis of trends.

Lexicons are fixed and short, so hits are counted inside the row with array_intersect: no token
explode, no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.constants import (
    CATEGORIES,
    CATEGORY_DEFAULT_PESTEL,
    CATEGORY_LEXICON,
    MATURITY_IMPACT,
    PESTEL_DIMENSIONS,
    PESTEL_LEXICON,
    SUPPORTED_LANGUAGES,
)
from trendloom.functions.ordering import dense_positions
from trendloom.functions.text import blank_to_null, capitalize, let, lexicon_tokens, literal_array


def template_title(keywords: Column) -> Column:
    kept = F.filter(keywords, lambda k: k.isNotNull() & (k != ""))
    shown = F.array_join(F.transform(F.slice(kept, 1, 3), capitalize), ", ")
    return F.when(F.size(kept) > 0, shown).otherwise("Unlabeled trend")


def template_summary(keywords: Column, titles: Column) -> Column:
    """Focus terms plus the titled ones among the first three sources."""
    kept = F.filter(keywords, lambda k: k.isNotNull() & (k != ""))
    focus = F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, 5), ", ")).otherwise("the clustered documents")
    named = F.filter(F.slice(titles, 1, 3), lambda t: t.isNotNull() & (t != ""))
    sources = F.when(
        F.size(named) > 0, F.concat(F.lit(" Representative sources: "), F.array_join(named, "; "), F.lit("."))
    ).otherwise("")
    return F.concat(F.lit("This trend centers on "), focus, F.lit("."), sources)


def titled(evidence: Column) -> Column:
    """Evidence items with a title, reduced to title and url."""
    kept = F.filter(evidence, lambda e: e["title"].isNotNull() & (e["title"] != ""))
    return F.transform(kept, lambda e: F.struct(e["title"].alias("title"), e["url"].alias("url")))


def _hits(tokens: Column, terms) -> Column:
    return F.size(F.array_intersect(tokens, literal_array(terms)))


def category(tokens: Column, lexicon=None) -> Column:
    """Category with most distinct hits; lexicon order breaks ties, no hit means technology."""
    lexicon = CATEGORY_LEXICON if lexicon is None else lexicon
    scored = [
        F.struct(_hits(tokens, terms).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("c"))
        for i, (name, terms) in enumerate(lexicon.items())
    ]
    return let(F.array_max(F.array(*scored)), lambda best: F.when(best["n"] > 0, best["c"]).otherwise("technology"))


def pestel(tokens: Column, chosen_category: Column, lexicon=None) -> Column:
    """Up to three dimensions close to the strongest one; without hits the category decides."""
    lexicon = PESTEL_LEXICON if lexicon is None else lexicon
    scored = F.array(*[F.struct((-_hits(tokens, t)).alias("n"), F.lit(d).alias("d")) for d, t in lexicon.items()])

    def choose(ranked: Column) -> Column:
        highest = -F.element_at(ranked, 1)["n"]
        threshold = F.greatest(F.lit(1.0), F.bround(highest * F.lit(0.45), 0))
        kept = F.slice(F.filter(ranked, lambda x: -x["n"] >= threshold), 1, 3)
        return F.transform(kept, lambda x: x["d"])

    fallback = F.lit(None).cast("string")
    for name, dimension in CATEGORY_DEFAULT_PESTEL.items():
        fallback = F.when(chosen_category == name, dimension).otherwise(fallback)
    return let(let(F.array_sort(scored), choose), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(fallback)))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), value))


def positive_growth(growth: Column, periods: Column) -> Column:
    return F.when(periods >= 2, F.greatest(F.lit(0.0), growth)).otherwise(0.0)


def impact(maturity: Column, size: Column) -> Column:
    anchor = F.lit(5.0)
    for level, value in MATURITY_IMPACT.items():
        anchor = F.when(maturity == level, F.lit(value)).otherwise(anchor)
    return clamp(anchor + F.least(F.lit(2.0), size / 10))


def urgency(growth: Column, emergence: Column) -> Column:
    return clamp(F.lit(4.0) + F.least(F.lit(4.0), growth * 4) + F.coalesce(emergence * 2, F.lit(0.0)))


def uncertainty(n_sources: Column, emergence: Column) -> Column:
    return clamp(F.lit(6.0) - F.least(F.lit(3), n_sources) + F.coalesce(emergence * 3, F.lit(0.0)))


def radar_stage(impact_score: Column, urgency_score: Column) -> Column:
    return (
        F.when((impact_score >= 7.0) & (urgency_score >= 6.0), "act")
        .when((impact_score >= 5.5) | (urgency_score >= 6.5), "prepare")
        .otherwise("watch")
    )


def rationale(maturity: Column, size: Column, n_sources: Column, growth: Column) -> Column:
    # Eighths are the only values that sit exactly between two cents; those round to even.
    cents = F.when(growth * 8 == F.floor(growth * 8), F.bround(growth, 2)).otherwise(growth)
    return F.concat(
        F.lit("Heuristic: maturity="), F.coalesce(maturity, F.lit("None")), F.lit(", size="), size.cast("string"),
        F.lit(", sources="), n_sources.cast("string"), F.lit(", growth="), F.format_string("%.2f", cents), F.lit("."),
    )


def assess(signals: DataFrame) -> DataFrame:
    """Labels, scores, stage and rationale.

    Needs tokens, maturity, emergence, size, n_sources, growth and periods per row.
    """
    rows = signals.withColumn("growth_pos", positive_growth(F.col("growth"), F.col("periods")))
    rows = rows.withColumn("category", category(F.col("tokens")))
    rows = rows.withColumns({
        "pestel": pestel(F.col("tokens"), F.col("category")),
        "impact": impact(F.col("maturity"), F.col("size")),
        "urgency": urgency(F.col("growth_pos"), F.col("emergence")),
        "uncertainty": uncertainty(F.col("n_sources"), F.col("emergence")),
        "rationale": rationale(F.col("maturity"), F.col("size"), F.col("n_sources"), F.col("growth_pos")),
    })
    return rows.withColumn("radar_stage", radar_stage(F.col("impact"), F.col("urgency")))


def blend(base: DataFrame, judgements: DataFrame, key: str = "trend_id") -> DataFrame:
    """Mix in externally supplied judgements (all text columns; pestel as array<string>).

    A row without judgement, or with a score that is no number, stays as it is.
    """
    given = judgements.select(
        key, F.lit(True).alias("judged"), F.col("pestel").alias("j_pestel"), F.col("category").alias("j_category"),
        *[F.col(c).alias(f"j_{c}") for c in ("impact", "urgency", "uncertainty", "rationale")],
    )
    rows = base.join(given, key, "left")
    scores = {c: F.coalesce(F.col(f"j_{c}"), F.lit("5")).try_cast("double") for c in ("impact", "urgency", "uncertainty")}
    valid = F.coalesce("judged", F.lit(False))
    for score in scores.values():
        valid = valid & score.isNotNull()
    mix = lambda c, w: clamp(w * clamp(scores[c]) + (1 - w) * F.col(c))
    labels = F.slice(F.filter(F.coalesce("j_pestel", F.array().cast("array<string>")), lambda p: p.isin(*PESTEL_DIMENSIONS)), 1, 3)
    return rows.select(
        key,
        F.when(valid & (F.size(labels) > 0), labels).otherwise(F.col("pestel")).alias("pestel"),
        F.when(valid & F.col("j_category").isin(*CATEGORIES), F.col("j_category")).otherwise(F.col("category")).alias("category"),
        F.when(valid, mix("impact", 0.6)).otherwise(F.col("impact")).alias("impact"),
        F.when(valid, mix("urgency", 0.5)).otherwise(F.col("urgency")).alias("urgency"),
        F.when(valid, mix("uncertainty", 0.5)).otherwise(F.col("uncertainty")).alias("uncertainty"),
        F.when(valid, F.trim(F.coalesce("j_rationale", F.lit("")))).otherwise(F.col("rationale")).alias("rationale"),
    )


def route_calls(trends: DataFrame, budget: int, order: str = "topic_index") -> DataFrame:
    """Two expensive steps per trend, the first `budget` of a run in topic order; the rest falls back."""
    steps = trends.select("run_id", order, F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    numbered = dense_positions(steps, ["run_id"], [F.col(order), F.col("step")], "turn")
    return numbered.withColumn("route", F.when(F.col("turn") < budget, "external").otherwise("fallback")).drop("turn")


def source_counts(members: DataFrame) -> DataFrame:
    inside = members.where(~F.coalesce("is_outlier", F.lit(False)))
    return inside.groupBy("run_id", "topic_id").agg(
        F.greatest(F.count_distinct("source_id"), F.lit(1)).alias("n_sources")
    )


# ---------------------------------------------------------------- dimension analysis


def lexicon_hits(docs: DataFrame, lexicon=None) -> DataFrame:
    """(doc_id, dimension, terms) for every dimension a document mentions; one pass over the text."""
    lexicon = PESTEL_LEXICON if lexicon is None else lexicon
    tokens = docs.select("doc_id", lexicon_tokens(F.col("title"), F.col("text")).alias("tokens"))
    found = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.array_intersect("tokens", literal_array(t)).alias("terms"))
        for d, t in lexicon.items()
    ])
    return tokens.select("doc_id", F.explode(found).alias("f")).where(F.size("f.terms") > 0).select("doc_id", "f.*")


def dimension_coverage(members: DataFrame, hits: DataFrame) -> DataFrame:
    """Matched and total documents and relevance per topic for all six dimensions, zeros included."""
    keys = ["run_id", "topic_index"]
    totals = members.groupBy(*keys).agg(F.count("*").alias("total"))
    grid = totals.withColumn("dimension", F.explode(literal_array(PESTEL_DIMENSIONS)))
    matched = members.join(hits.select("doc_id", "dimension"), "doc_id").groupBy(*keys, "dimension").agg(F.count("*").alias("matched"))
    rows = grid.join(matched, [*keys, "dimension"], "left").na.fill(0, ["matched"])
    share = F.col("matched") / F.col("total")
    return rows.withColumn("relevance", F.bround(F.least(F.lit(10.0), 10 * F.sqrt(share)), 1))


def signal_terms(members: DataFrame, hits: DataFrame, n: int = 5) -> DataFrame:
    """Terms found in most documents of a topic, per dimension."""
    keys = ["run_id", "topic_index", "dimension"]
    found = members.join(hits, "doc_id").select(*keys, F.explode("terms").alias("term"))
    counted = found.groupBy(*keys, "term").agg(F.count("*").alias("n_docs"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n_docs"), "term")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def dimension_evidence(members: DataFrame, hits: DataFrame, n: int = 3) -> DataFrame:
    """Documents with most hits per dimension, dated and newer ones first."""
    keys = ["run_id", "topic_index", "dimension"]
    found = members.join(hits.withColumn("n_terms", F.size("terms")).drop("terms"), "doc_id")
    best = Window.partitionBy(*keys).orderBy(F.desc("n_terms"), F.col("published_at").desc_nulls_last(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def analysis_corpus(trends: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Texts a trend is analysed on: its member documents, else the titles of its evidence."""
    own = members.select("trend_id", F.col("doc_id").cast("string").alias("item"), "title", "text", "published_at")
    bare = trends.select("trend_id").join(own, "trend_id", "left_anti")
    cited = evidence.where(F.coalesce("title", F.lit("")) != "").join(bare, "trend_id", "left_semi")
    return own.unionByName(cited.select(
        "trend_id", F.concat(F.lit("e"), F.col("ord").cast("string")).alias("item"), "title", F.col("title").alias("text"),
        F.lit(None).cast("date").alias("published_at"),
    ))


def localize_terms(ranked: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Display labels for ranked terms; variants of a label collapse onto the best rank.

    `labels` is a (term, label) table supplied by the caller; unknown terms show as they are.
    """
    named = ranked.join(labels, "term", "left").withColumn("label", F.coalesce("label", "term"))
    return named.groupBy(*keys, "label").agg(F.min("rank").alias("rank"))


def resolve_texts(trends: DataFrame, translations: DataFrame) -> DataFrame:
    """Title, summary and rationale per trend and language; missing translations use the base text."""
    grid = trends.select("trend_id", "title", "summary", "rationale", F.explode(literal_array(SUPPORTED_LANGUAGES)).alias("language"))
    stored = translations.select(
        "trend_id", "language", F.lit(True).alias("found"), F.col("title").alias("t_title"),
        F.col("summary").alias("t_summary"), F.col("rationale").alias("t_rationale"),
    )
    rows = grid.join(stored, ["trend_id", "language"], "left")
    return rows.select(
        "trend_id", "language", F.when(F.col("found"), F.col("t_title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("found"), F.col("t_summary")).otherwise(F.col("summary")).alias("summary"),
        F.coalesce(blank_to_null(F.col("t_rationale")), "rationale").alias("rationale"),
    )


def translation_maps(texts: DataFrame) -> DataFrame:
    entry = F.struct("language", F.struct("title", "summary", "rationale").alias("text"))
    return texts.groupBy("trend_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("translations"))


def calibrate(scored: DataFrame) -> DataFrame:
    """Spread impact and urgency over the scale by rank; fewer than two rows stay untouched.

    Ranks run over the whole portfolio, so they come from range partitions and not from one window.
    """
    n = scored.agg(F.count("*").alias("n"))
    by_impact = scored.select("trend_id", F.coalesce("impact", F.lit(0.0)).alias("a"), "size")
    by_impact = dense_positions(by_impact, [], [F.col("a"), F.col("size"), F.col("trend_id")], "impact_rank")
    by_urgency = scored.select("trend_id", F.coalesce("urgency", F.lit(0.0)).alias("a"), F.coalesce("emergence", F.lit(0.0)).alias("b"))
    by_urgency = dense_positions(by_urgency, [], [F.col("a"), F.col("b"), F.col("trend_id")], "urgency_rank")
    rows = scored.join(by_impact.select("trend_id", "impact_rank"), "trend_id")
    rows = rows.join(by_urgency.select("trend_id", "urgency_rank"), "trend_id").join(n)
    spread = lambda rank: F.bround(3.2 + 6.3 * F.col(rank) / (F.col("n") - 1), 1)
    many = F.col("n") >= 2
    rows = rows.withColumns({
        "impact": F.when(many, spread("impact_rank")).otherwise(F.col("impact")),
        "urgency": F.when(many, spread("urgency_rank")).otherwise(F.col("urgency")),
        "uncertainty": F.when(many, F.bround(F.when(F.col("uncertainty") != 0, F.col("uncertainty")).otherwise(5.0), 1)).otherwise(F.col("uncertainty")),
    })
    stage = F.when(many, radar_stage(F.col("impact"), F.col("urgency"))).otherwise(F.col("radar_stage"))
    return rows.withColumn("radar_stage", stage).drop("impact_rank", "urgency_rank", "n")


def representative_documents(members: DataFrame, n: int = 8) -> DataFrame:
    """Newest documents of a topic (undated ones first, as a descending sort with nulls leading has it)."""
    inside = members.where(~F.coalesce("is_outlier", F.lit(False)))
    newest = Window.partitionBy("topic_id").orderBy(F.col("published_at").desc_nulls_first(), "doc_id", "tie")
    return inside.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def representative_titles(trends: DataFrame, members: DataFrame, evidence: DataFrame, n: int = 8) -> DataFrame:
    """trend_id, titles, from_evidence: titles of a topic's newest n documents, without any the titles of the trend's stored evidence.

    trends: trend_id, topic_id; evidence: trend_id, ord, title. Outliers and blank titles give none.
    """
    listed = lambda order: F.transform(F.array_sort(F.collect_list(F.struct(order, "title"))), lambda x: x["title"])
    newest = representative_documents(members, n).where("title <> ''").groupBy("topic_id").agg(listed("rank").alias("own"))
    rows = trends.select("trend_id", "topic_id").join(newest, "topic_id", "left")
    stored = evidence.where("title <> ''").join(rows.where("own IS NULL").select("trend_id"), "trend_id", "left_semi")
    rows = rows.join(stored.groupBy("trend_id").agg(listed("ord").alias("kept")), "trend_id", "left")
    titles = F.coalesce("own", "kept", F.array().cast("array<string>"))
    return rows.select("trend_id", titles.alias("titles"), (F.col("own").isNull() & F.col("kept").isNotNull()).alias("from_evidence"))


def chart_data(trends: DataFrame, assessments: DataFrame, timepoints: DataFrame) -> DataFrame:
    """One row per trend with its ordered time points, ranked by impact and uncertainty inside the run."""
    points = timepoints.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("period", "doc_count"))).alias("timepoints"))
    rows = trends.join(assessments, "trend_id", "left").join(points, "topic_id", "left")
    order = [F.desc(F.coalesce("impact", F.lit(0.0))), F.desc(F.coalesce("uncertainty", F.lit(0.0))), F.col("trend_id")]
    return dense_positions(rows, ["run_id"], order, "ord").withColumn("ord", (F.col("ord") + 1).cast("int"))


def distributions(rows: DataFrame, first_label_only: bool = False) -> DataFrame:
    """Counts per maturity, dimension, stage and category of every run in a single pass."""
    labels = F.coalesce("pestel", F.array().cast("array<string>"))
    if first_label_only:
        labels = F.array(F.coalesce(F.get(labels, F.lit(0)), F.lit("-")))
    facet = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    facets = F.concat(
        F.array(*[facet(c, F.col(c)) for c in ("maturity", "radar_stage", "category")]),
        F.transform(labels, lambda p: facet("pestel", p)),
    )
    return rows.select("run_id", F.explode(facets).alias("f")).groupBy("run_id", "f.facet", "f.value").agg(F.count("*").alias("n"))
