"""Document identity, exact deduplication and near-duplicate marking."""

from __future__ import annotations

import math
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from trendloom.constants import NEAR_DUPLICATE_LOOKBACK, NEAR_DUPLICATE_RATIO
from trendloom.functions.joins import salted_join
from trendloom.functions.ordering import dense_positions
from trendloom.functions.tables import written
from trendloom.functions.text import (
    blank_to_null,
    canonicalize_url,
    content_fingerprint,
    extract_doi,
    identity_key,
    normalize_text,
)


def with_identity(docs: DataFrame) -> DataFrame:
    """Add doi, canonical_url, content_hash and normalized_identity."""
    docs = docs.withColumns({
        "doi": extract_doi(F.col("external_id"), F.col("url"), F.col("text")),
        "canonical_url": canonicalize_url(F.col("url")),
        "content_hash": content_fingerprint(F.col("title"), F.col("text")),
    })
    return docs.withColumn(
        "normalized_identity",
        identity_key(F.col("doi"), F.col("canonical_url"), F.col("source_name"), F.col("external_id"), F.col("content_hash")),
    )


def batch_key() -> Column:
    """Key of the batch deduplication: external id, else url, else title."""
    value = F.coalesce(*[blank_to_null(F.col(c)) for c in ("external_id", "url", "title")], F.lit(""))
    return F.lower(F.trim(value))


def dedupe_batch(docs: DataFrame, order: str = "seq") -> DataFrame:
    """First document per key; documents without a key are dropped.

    The rank filter is applied before the shuffle as well, so a key shared by a third of the batch
    sends one candidate row per map task.
    """
    keyed = docs.withColumn("doc_key", batch_key()).where(F.col("doc_key") != "")
    first = Window.partitionBy("doc_key").orderBy(order)
    return keyed.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1).drop("rn")


def identity_keys(docs: DataFrame, order: str = "seq") -> DataFrame:
    """Every identity a document can collide on, as (order, key) rows."""
    tagged = lambda tag, c: F.concat(F.lit(tag), c)
    keys = F.array_compact(F.array(
        tagged("id:", F.col("normalized_identity")), tagged("doi:", F.col("doi")),
        tagged("url:", F.col("canonical_url")), tagged("hash:", F.col("content_hash")),
        F.concat(F.lit("ext:"), F.col("source_name"), F.lit("|"), F.col("source_type"), F.lit("|"),
                 blank_to_null(F.col("external_id"))),
    ))
    return docs.select(order, F.explode(F.array_distinct(keys)).alias("key"))


IDENTITY = ("normalized_identity", "doi", "canonical_url", "content_hash")


def exact_dedupe(docs: DataFrame, store: DataFrame | None = None, order: str = "seq", taken: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents an ingest in `order` would keep: a document is dropped when any of its identities
    belongs to a document kept before it (or to the store, or is in `taken`: keys, or a function that finds those of given keys). A dropped document blocks nobody.

    Works on keys, never on pairs: in every round the documents that come first among the undecided
    on all their keys are kept, and whoever shares a key with them is dropped. Copies that agree on
    all keys fall to the first one up front by a partial aggregate. A key that many undecided documents share is
    spread over salted groups when they learn its first document, and when they learn that document's fate.
    A round writes one table, of the documents still undecided. Identities are computed once.
    """
    parts = [*IDENTITY, "source_name", "source_type", "external_id"]
    narrow = written(docs.select(order, *parts), "identities")
    keys = identity_keys(narrow.groupBy(*parts).agg(F.min(order).alias(order)), order)
    if store is not None:
        taken = identity_keys(store, order).select("key")
    if callable(taken):
        taken = taken(keys)
    if taken is not None:
        blocked = salted_join(keys, taken.select("key").distinct(), ["key"], order).select(order).distinct()
        keys = keys.join(blocked, order, "left_anti")
    winners = narrow.select(order).limit(0)
    while True:
        least = keys.groupBy("key").agg(F.min(order).alias("first"))
        claims = written(salted_join(keys, least, ["key"], order), "claims")
        if claims.isEmpty():
            break
        kept = claims.groupBy(order).agg(F.bool_and(F.col(order) == F.col("first")).alias("keep")).where("keep").select(F.col(order).alias("first"))
        decided = salted_join(claims.select(order, "first"), kept, ["first"], order).select(order).distinct()
        keys = claims.select(order, "key").join(decided, order, "left_anti")
        winners = winners.union(kept)
    found = narrow.join(winners, order, "left_semi").select(order, *IDENTITY)
    return docs.drop(*IDENTITY).join(found, order).select(docs.columns)


def lookback_pairs(docs: DataFrame, size: Callable[[str], Column], least: float, order: str = "seq", lookback: int = NEAR_DUPLICATE_LOOKBACK) -> DataFrame:
    """Each title with the titles of the `lookback` documents before it whose size is at least `least` of the larger of the two.

    `order` must be dense; `size` gives a title's size from its column name. Blocks of `lookback` documents and steps of the size's logarithm
    make the range join an equi-join: titles far apart in size never meet, and no block holds more than `lookback` documents on one side and
    twice that on the other. Titles are normalised once.
    """
    titles = docs.select(F.col(order).alias("seq"), normalize_text(F.col("title")).alias("norm_title"))
    titles = written(titles.withColumns({"chars": F.length("norm_title"), "size": size("norm_title")}), "titles")
    block = F.floor(F.col("seq") / lookback)
    # a hair wider than the ratio, so that titles at exactly the ratio are never two steps apart
    step = F.floor(F.ln(F.greatest("size", F.lit(1))) / (-math.log(least) * (1 + 1e-9))).cast("int")
    left = titles.where(F.col("chars") >= 20).withColumns({"block": block, "step": F.explode(F.array(step - 1, step, step + 1))})
    right = titles.select(
        F.col("seq").alias("other"), F.col("norm_title").alias("other_title"), F.col("chars").alias("other_chars"), F.col("size").alias("other_size"),
        step.alias("step"), F.explode(F.array(block, block + 1)).alias("block"),
    )
    near = (F.col("other") < F.col("seq")) & (F.col("other") >= F.col("seq") - lookback)
    alike = F.least("size", "other_size") / F.greatest("size", "other_size") >= least
    return left.join(right, ["block", "step"]).where(near & alike).drop("block", "step")


@F.pandas_udf(BooleanType())
def _alike(title: pd.Series, other: pd.Series, ratio: pd.Series) -> pd.Series:
    def check(a: str, b: str, least: float) -> bool:
        if a == b:
            return True
        matcher = SequenceMatcher(None, a, b)
        return matcher.quick_ratio() >= least and matcher.ratio() >= least

    return pd.Series([check(a, b, r) for a, b, r in zip(title, other, ratio)])


def near_duplicates(docs: DataFrame, order: str = "seq", ratio: float = NEAR_DUPLICATE_RATIO) -> DataFrame:
    """Newest of the preceding documents whose title is nearly the same; marks, never merges."""
    pairs = lookback_pairs(docs, F.length, ratio / (2 - ratio) * (1 - 1e-9), order)
    bound = 2 * F.least("chars", "other_chars") / (F.col("chars") + F.col("other_chars"))
    close = pairs.where(bound >= ratio).where(_alike("norm_title", "other_title", F.lit(ratio)))
    return close.groupBy("seq").agg(F.max("other").alias("near_duplicate_of"))


def near_duplicates_by_edits(docs: DataFrame, order: str = "seq", ratio: float = NEAR_DUPLICATE_RATIO) -> DataFrame:
    """Same marking on the edit distance of the UTF-8 bytes, without Python workers."""
    raw = lambda c: F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1")
    longest = F.greatest("size", "other_size")
    guess = F.floor(longest * (1 - ratio) + 1e-9).cast("int")
    allowed = F.when(1 - guess / longest >= ratio, guess).otherwise(guess - 1)
    pairs = lookback_pairs(docs, F.octet_length, ratio, order).withColumns({"a": raw("norm_title"), "b": raw("other_title"), "allowed": allowed})
    # The bounded distance walks a band as wide as the allowed edits and gives -1 beyond it.
    close = pairs.where(F.expr("CASE WHEN norm_title = other_title THEN 0 ELSE levenshtein(a, b, allowed) END >= 0"))
    return close.groupBy("seq").agg(F.max("other").alias("near_duplicate_of"))


def ingest(docs: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Raw documents to accepted ones: identity, exact dedupe, dense ids, near-duplicate marks.

    `store` holds accepted documents (doc_id and identity columns). Titles are compared with the most
    recent documents, so only the last few of the store take part.
    """
    known = None if store is None else store.withColumn("seq", F.col("doc_id"))
    kept = dense_positions(exact_dedupe(with_identity(docs), known), [], [F.col("seq")], "ingest_no")
    titles = kept.select("ingest_no", "title", F.lit(None).cast("bigint").alias("old_id"))
    offset, first_id = 0, 1
    if store is not None:
        tail = store.orderBy(F.desc("doc_id")).limit(NEAR_DUPLICATE_LOOKBACK)
        offset, newest = tail.agg(F.count("*"), F.coalesce(F.max("doc_id"), F.lit(0))).first()
        first_id = newest + 1
        rank = F.row_number().over(Window.orderBy("doc_id")) - 1  # at most `lookback` rows
        old = tail.select(rank.cast("bigint").alias("no"), "title", F.col("doc_id").alias("old_id"))
        titles = old.unionByName(titles.select((F.col("ingest_no") + offset).alias("no"), "title", "old_id"))
    else:
        titles = titles.withColumnRenamed("ingest_no", "no")
    marks = near_duplicates(titles, "no").where(F.col("seq") >= offset)
    other = titles.select(F.col("no").alias("near_duplicate_of"), "old_id")
    marked = marks.join(other, "near_duplicate_of").select(
        (F.col("seq") - offset).alias("ingest_no"),
        F.coalesce("old_id", F.col("near_duplicate_of") - offset + first_id).alias("near_duplicate_of_id"),
    )
    rows = kept.join(marked, "ingest_no", "left").withColumn("doc_id", F.col("ingest_no") + first_id)
    return rows.drop("ingest_no", "seq")


def extend_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Source dimension with unknown (name, type) pairs appended under fresh ids."""
    keys = ["source_name", "source_type"]
    fresh = docs.select(*keys).distinct().join(sources, keys, "left_anti")
    numbered = dense_positions(fresh, [], [F.col(k) for k in keys], "n")
    top = sources.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("top"))
    added = numbered.join(top).select((F.col("top") + F.col("n") + 1).alias("source_id"), *keys)
    return sources.select("source_id", *keys).unionByName(added)


