"""Operator 9, quality rules as a ledger of failure bits, native DataFrame functions only.

Every rule is evaluated once per text; the ledger keeps the measurements and one bit per failed rule. A policy is a named, versioned set of
rules: a text is kept if none of its bits fails, so policies and their ablations are bitwise questions to the stored ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.text import let

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

#: Rule name to failure condition over the measurements; the position is the bit. New rules go to the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "long_words": "word_chars > 25 * n_words",
}
#: Policy (name, version) to its rules.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("web", 1): ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    ("web", 2): tuple(RULES),
}


def mask(rules) -> int:
    """Bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def repeated_window_words(words: Column, size: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array, first occurrence included.

    Window hashes are sorted with their places; neighbours with equal hashes are repeats, and overlapping windows count a word once.
    """
    keys = F.transform(F.arrays_zip(F.slice(words, 1, size - 2), F.slice(words, 2, size - 2), F.slice(words, 3, size - 2)), lambda x: F.xxhash64(x["0"], x["1"], x["2"]))

    def places(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda s: F.sort_array(F.filter(F.transform(s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"])), lambda i: i.isNotNull())))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    count = let(keys, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), covered)))
    return F.when(size >= 3, count).otherwise(F.lit(0)).cast("long")


def ledger(documents: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `carry`, the measurements (long) and `failures` (long bit set) per input row; nothing is shuffled.

    Null and blank texts have no words and fail `few_words`. Ties and repeated rows do not matter: a row depends on its text alone. Names
    in `carry` must differ from the measurements; other input columns are left behind. An empty table gives an empty ledger.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = documents.select(*carry, text.alias("__t"))
    spaced = F.translate("__t", SPACES[1:], " " * (len(SPACES) - 1))
    split = base.select(
        *carry, "__t", F.array_remove(F.split(spaced, " "), "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("__l"), F.length("__t").alias("__n"),
    )
    measured = split.select(
        *carry, F.size("__w").cast("long").alias("n_words"), F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.col("__n") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("__w"), F.size("__w")).alias("n_repeat_words"), F.size("__l").cast("long").alias("n_lines"),
        (F.col("__n") - F.length(F.translate("__t", CAPITALS, ""))).cast("long").alias("n_capitals"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return measured.select(*carry, *MEASURES, reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long").alias("failures"))


def apply_policy(rows: DataFrame, name: str, version: int, kept: str = "kept") -> DataFrame:
    """Ledger rows with the policy's verdict."""
    return rows.withColumn(kept, F.col("failures").bitwiseAND(mask(POLICIES[name, version])) == 0)


def ablations(rows: DataFrame, name: str, version: int) -> DataFrame:
    """Per rule of a policy: texts that fail it, texts rejected by it alone, and texts kept without it. One pass of partial aggregates."""
    rules = POLICIES[name, version]
    whole = mask(rules)
    failed = F.col("failures").bitwiseAND(whole)
    counts = [F.count("*").alias("n_texts"), F.sum((failed == 0).cast("long")).alias("n_kept")]
    for r in rules:
        counts += [F.sum((failed.bitwiseAND(mask([r])) != 0).cast("long")).alias(f"f_{r}"), F.sum((failed == mask([r])).cast("long")).alias(f"o_{r}")]
    one = rows.agg(*counts)
    parts = [F.struct(F.lit(r).alias("rule"), F.coalesce(f"f_{r}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{r}", F.lit(0)).alias("n_only"), (F.coalesce("n_kept", F.lit(0)) + F.coalesce(f"o_{r}", F.lit(0))).alias("n_kept_without")) for r in rules]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def verdict_rows(documents: DataFrame, policy: tuple[str, int] = ("web", 2)) -> DataFrame:
    """The query's columns."""
    done = apply_policy(ledger(documents), *policy)
    base = F.col("failures").bitwiseAND(mask(POLICIES["base", 1])) != 0
    return done.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failures")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
v AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) x(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT t.doc_id, len(w.ws) AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t.text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
             coalesce(v.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines, len(regexp_extract_all(t.text, '[A-Z]')) AS n_capitals
      FROM t JOIN w USING (r) LEFT JOIN v USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                 + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
                 + CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
