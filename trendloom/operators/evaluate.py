"""Overlap of discovered trends with a reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.constants import OVERLAP_STOP, OVERLAP_THRESHOLD
from trendloom.functions.joins import salted_join
from trendloom.functions.ordering import dense_positions
from trendloom.functions.tables import written
from trendloom.functions.text import overlap_tokens


def with_tokens(rows: DataFrame) -> DataFrame:
    """Add the evaluation token set of title and keywords (array<string>)."""
    return rows.withColumn("tokens", overlap_tokens(F.col("title"), F.col("keywords"), OVERLAP_STOP))


def known_tokens(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, n, own): of each row with n tokens the numbers, rarest first, of those that `known` (token, no) has; rows without any are left out."""
    sized = rows.select(*keys, F.size("tokens").alias("n"), "tokens")
    # explode_outer: for explode the optimizer adds a filter on the size, which would find a row's tokens twice.
    listed = sized.select(*keys, "n", F.explode_outer("tokens").alias("token")).join(known, "token")
    return listed.groupBy(*keys, "n").agg(F.array_sort(F.collect_list("no")).alias("own"))


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """(all of `rows`, no, rest): a row per token among the n - ceil(threshold * n) + 1 rarest, with the number of known tokens from it on.

    Tokens that no reference has are the rarest of all, so they fill the prefix first and need no row.
    """
    need = F.ceil(F.col("n") * threshold - 1e-9)
    wide = F.greatest(F.size("own") - need + 1, F.lit(0)).cast("int")
    placed = rows.select("*", F.posexplode(F.slice("own", F.lit(1), wide)).alias("place", "no"))
    return placed.withColumn("rest", F.size("own") - F.col("place")).drop("place")


def similar_pairs(trends: DataFrame, references: DataFrame, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """All (run, trend, reference) pairs whose Jaccard similarity reaches the threshold.

    Candidates share a token of both prefixes, which hold the rarest tokens of each set, so a token that most rows have proposes next to
    nothing. Sets of n and m tokens reach the threshold with threshold / (1 + threshold) * (n + m) common ones; from their rarest common
    token on both must hold as many, which the places tell before any set is looked at. The sets of the rest are compared as token numbers
    that the rows carry along; tokens that no reference has are common to no pair and only counted. A token that many trends have in their
    prefix is spread over salted groups. The known tokens are those of the curated list; the optimizer broadcasts them while small.
    """
    right = references.select("reference_id", "tokens")
    counts = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    numbered = dense_positions(counts, [], [F.col("df"), F.col("token")], "no")
    known = written(numbered.select("token", F.col("no").cast("int").alias("no")), "tokens")
    mine = prefixes(known_tokens(trends.select("run_id", "trend_id", "tokens"), ["run_id", "trend_id"], known), threshold)
    theirs = written(known_tokens(right, ["reference_id"], known), "references")
    posting = F.struct("reference_id", F.col("n").alias("m"), F.col("rest").alias("more"))
    by_token = prefixes(theirs, threshold).groupBy("no").agg(F.collect_list(posting).alias("refs"))  # of the curated list
    met = salted_join(mine, by_token, ["no"], "trend_id").select("run_id", "trend_id", "n", "own", "rest", F.inline("refs"))
    possible = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
    enough = F.least("rest", "more") >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9
    sets = met.where(possible & enough).join(theirs.select("reference_id", F.col("own").alias("others")), "reference_id")
    both = F.size(F.array_intersect("own", "others"))
    score = both / (F.col("n") + F.col("m") - both)
    return sets.select("run_id", "trend_id", "reference_id", score.alias("score")).where(F.col("score") >= threshold).distinct()


def best_matches(pairs: DataFrame) -> DataFrame:
    """Best trend per run and reference, the smaller id on ties; a trend may serve several references."""
    best = pairs.groupBy("run_id", "reference_id").agg(
        F.max_by(F.struct("trend_id", "score"), F.struct("score", -F.col("trend_id"))).alias("b")
    )
    return best.select("run_id", "reference_id", "b.trend_id", F.bround("b.score", 3).alias("score"))


def overlap_metrics(runs: DataFrame, trends: DataFrame, references: DataFrame, matches: DataFrame) -> DataFrame:
    """Recall over references and precision over trends for every run, zeros included."""
    n_refs = references.agg(F.count("*").alias("n_references"))
    n_trends = trends.groupBy("run_id").agg(F.count("*").alias("n_trends"))
    found = matches.groupBy("run_id").agg(
        F.count_distinct("reference_id").alias("n_matched"), F.count_distinct("trend_id").alias("n_used")
    )
    rows = runs.select("run_id").join(n_trends, "run_id", "left").join(found, "run_id", "left").join(n_refs)
    rows = rows.na.fill(0, ["n_trends", "n_matched", "n_used"])
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return rows.select(
        "run_id", "n_references", "n_trends", "n_matched", share("n_matched", "n_references").alias("recall"),
        share("n_used", "n_trends").alias("precision"),
    )


def missed_references(runs: DataFrame, references: DataFrame, matches: DataFrame) -> DataFrame:
    """References without a match, per run. Runs times the curated reference list is the size of the answer."""
    grid = runs.select("run_id").join(references.select("reference_id", "title"))
    return grid.join(matches, ["run_id", "reference_id"], "left_anti")


def novel_trends(trends: DataFrame, matches: DataFrame) -> DataFrame:
    return trends.join(matches, ["run_id", "trend_id"], "left_anti")
