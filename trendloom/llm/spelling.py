"""Operator 12, spelling variants by pivotal grams.

Words at one inserted, deleted or replaced code point are found through their bigrams, ordered from rare to frequent. A word's prefix is its
three rarest bigrams (with all that are as rare as the third); two disjoint ones of least frequency, chosen by dynamic programming, are its
pivots. One edit leaves a pivot whole, and of two near words at least one has a whole pivot in the other's prefix, so pivots are looked up
among prefixes in both directions. Position limits: the edit stands before, in, between, in or behind the two pivots, and each of these five
places leaves a known stretch beside a whole pivot, and the word's other end, as they are. A pivot is looked up with that stretch up to the
word's near end and with letters of the far end. Found pairs are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.graph import stored

LEAST_CHARS = 5
LEAST_COUNT = 3
DAMAGE = 97
FLUSH_WORDS = 400_000
#: (letters beside the pivot, letters of the far end) that a look-up may use, the strongest first.
REACHES = ((2, 2), (2, 0), (0, 2), (1, 1), (0, 0))
#: Bytes of A-Z and a-z; the code points U+00C0 to U+00FF are 0xC3 and one byte more.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_counts(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of runs of letters of at least `least_chars` code points, lower-cased in A-Z; `damage` deletes a code point of some runs.

    A run loses a code point if its crc32 with the document's id is a multiple of `damage` (0: none does). Null texts have no words; a null id reads
    as empty. Tasks count their own words and pass partial sums on, so a frequent word is one row per task.
    """
    run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least_chars)

    def count(batches):
        total: Counter = Counter()

        def flush():
            words = list(total)
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, text in zip(ids, batch.column("text").cast(pa.binary())):
                found = Counter(run.findall((text.as_py() or b"").translate(LOWERED)))
                if damage:
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for word in [w for w in found if zlib.crc32(w, start) % damage == 0]:
                        letters = word.decode()
                        at = zlib.crc32(word, start) % len(letters)
                        short = letters[:at] + letters[at + 1 :]
                        n = found.pop(word)
                        if len(short) >= least_chars:
                            total[short.encode()] += n
                total.update(found)
                if len(total) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """(rank from rare to frequent, frequency) of every bigram. Letters are 90 at most, so this table has 8,100 entries at most."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    counted = sorted((r["n"], r["gram"]) for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect())
    return {gram: (rank, n) for rank, (n, gram) in enumerate(counted)}


def prefix_and_pivots(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[int], tuple[int, int]]:
    """Positions of the prefix bigrams of a word of at least four letters, and those of its two disjoint pivots of least total frequency."""
    grams = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(rank for rank, _ in grams)[2]
    prefix = [i for i, (rank, _) in enumerate(grams) if rank <= last]
    best = (float("inf"), 0, 0)
    cheapest, waiting = (float("inf"), 0), []  # the cheapest prefix bigram that ends before position i
    for i in prefix:
        while waiting and waiting[0] + 2 <= i:
            j = waiting.pop(0)
            cheapest = min(cheapest, (grams[j][1], j))
        best = min(best, (cheapest[0] + grams[i][1], cheapest[1], i))
        waiting.append(i)
    return prefix, best[1:]


def with_grams(words: DataFrame) -> DataFrame:
    """(word, n, prefix, first, second): positions of the prefix bigrams and of the two pivots."""
    ranks = words.sparkSession.sparkContext.broadcast(gram_ranks(words))

    def choose(batches):
        for batch in batches:
            chosen = [prefix_and_pivots(word, ranks.value) for word in batch.column("word").to_pylist()]
            positions = pa.array([c[0] for c in chosen], pa.list_(pa.int32())), *(pa.array([c[1][k] for c in chosen], pa.int32()) for k in range(2))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *positions], names=["word", "n", "prefix", "first", "second"])

    return words.mapInArrow(choose, "word string, n long, prefix array<int>, first int, second int")


def key_of(side: str, at: str, more: str, far: str) -> str:
    """SQL: the bigram at position `at` with `more` letters towards the word's middle, all to its near end on `side`, and `far` letters of the other end."""
    if side == "L":
        return f"concat('L', left(word, {at} + 2 + {more}), '|', right(word, {far}))"
    return f"concat('R', left(word, {far}), '|', substring(word, {at} + 1 - ({more})))"


def prefix_keys(grams: DataFrame) -> DataFrame:
    """(key, other, other_n): everything under which a word's prefix bigrams can be looked up."""
    keys = [
        f"CASE WHEN {room} >= {more} THEN {key_of(side, 'g', str(more), str(far))} END"
        for side, room in (("L", "length(word) - g - 2"), ("R", "g"))
        for more, far in REACHES
    ]
    every = F.expr(f"explode(array_distinct(array_compact(flatten(transform(prefix, g -> array({', '.join(keys)}))))))")
    return grams.select(every.alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))


def pivot_keys(grams: DataFrame) -> DataFrame:
    """(key, word, n): one look-up for each place the edit can have: behind, before, between, in the second, in the first pivot."""

    def best(side: str, at: str, room: str, end: str) -> str:
        keys = "".join(f" WHEN {room} >= {more} AND {end} >= {far} THEN {key_of(side, at, str(more), str(far))}" for more, far in REACHES)
        return f"CASE{keys} END"

    gap = "second - first - 2"
    keys = [
        key_of("L", "second", "0", "0"), key_of("R", "first", "0", "0"), key_of("L", "first", "0", "2"),
        best("L", "first", gap, "length(word) - second - 2"), best("R", "second", gap, "first"),
    ]
    return grams.select(F.expr(f"explode(array_distinct(array({', '.join(keys)})))").alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: all pairs of `words` (word, n) that differ by exactly one code point.

    Spark sizes both sides by the words' file, not by the dozens of keys a word explodes into, and would broadcast them: the keys meet by a merge.
    """
    grams = stored(with_grams(words), "grams")
    near = (F.abs(F.length("word") - F.length("other")) <= 1) & (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)
    met = pivot_keys(grams).join(prefix_keys(grams).hint("merge"), "key").where(near)
    first = F.col("word") < F.col("other")
    pick = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    return met.select(pick("word", "other", "a"), pick("n", "other_n", "a_n"), pick("other", "word", "b"), pick("other_n", "n", "b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms` (word, form): the end of the chain of forms. Counts at least double along it, so pointer jumping takes few rounds."""
    ends = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ends.select(F.col("word").alias("at"), F.col("root").alias("onward"))
        moved = ends.join(onward.hint("merge"), ends["root"] == onward["at"], "left")
        fresh = stored(moved.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        done = fresh.where("moved").limit(1).count() == 0
        ends = fresh.select("word", "root")
        if done:
            return ends


def variant_groups(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least five code points and `least_count` occurrences.

    A word's form is its near word of most occurrences, the smallest of equals, if it has at least twice the word's; root follows forms to
    the last. Null and empty texts give nothing, repeated rows count each, an empty table gives an empty result; other columns don't matter.
    """
    words = stored(word_counts(documents, text_col, id_col, damage=damage).where(F.col("n") >= least_count), "words")
    pairs = stored(near_pairs(words), "near")
    links = pairs.union(pairs.select("b", "b_n", "a", "a_n")).toDF("word", "n", "near", "near_n")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    chosen = stored(links.groupBy("word", "n").agg(F.count("*").alias("n_near"), best), "chosen")
    has = -F.col("best.less") >= 2 * F.col("n")
    forms = chosen.select("word", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    ends = roots(forms.where("form IS NOT NULL").select("word", "form"))
    full = words.join(forms.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")  # files of words are a tenth of their room in memory
    return full.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM counted, crc
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), chosen AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN chosen c ON w.word = c.word
), chain AS (
  SELECT word, word AS last FROM forms
  UNION ALL
  SELECT chain.word, form FROM chain JOIN forms ON chain.last = forms.word WHERE form IS NOT NULL
)
SELECT f.word, f.form, c.last AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN (SELECT chain.word, chain.last FROM chain JOIN forms e ON chain.last = e.word WHERE e.form IS NULL) c ON f.word = c.word
"""
