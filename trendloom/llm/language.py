"""Operator 5, language identification with word-first backoff.

A known word adds its log frequency in every language. An unseen word falls back to its characters: at each place the longest known n-gram,
from five characters down to one, adds its log frequency instead.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.arrays import Rolling, slices, stream
from trendloom.llm.labelled import fold

SAMPLE_ROWS = 4000
NGRAM = 5
LEAST_WORD, LEAST_GRAM = 2, 3
UNKNOWN = "und"


def letter_tables(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its lower-case form where that is one code point."""
    chars = [chr(i) for i in range(top + 1)]
    letter = np.array([unicodedata.category(c)[0] == "L" for c in chars])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], dtype=np.uint32)
    return letter, lower


class Letters:
    """Words of rows as code-point ranges with rolling hashes."""

    tables: list = []

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        head = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        top = 0xFFFF if not len(points) or points.max() <= 0xFFFF else 0x10FFFF
        if not Letters.tables or len(Letters.tables[0]) <= top:
            Letters.tables[:] = [*letter_tables(top), stream(65536, 23)]
        letter, lower, values = Letters.tables
        inside = letter[points] if len(points) else np.zeros(0, bool)
        low = lower[points] if len(points) else points
        edge = np.zeros(len(points) + 1, dtype=bool)
        bounds = np.searchsorted(head, offs)
        edge[bounds] = True
        self.starts = np.flatnonzero(inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1]))
        self.ends = np.flatnonzero(inside & ~(np.concatenate((inside[1:], [False])) & ~edge[1:])) + 1
        self.rows = np.searchsorted(self.starts, bounds)
        self.roll = Rolling(values[low & 0xFFFF] + (low >> 16).astype(np.uint64))
        self.words = self.roll.ranges(self.starts, self.ends, 29)

    def grams(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.roll.ranges(at, at + n, 100 + n)


def places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which word, position) of every character."""
    size = ends - starts
    which = np.repeat(np.arange(len(starts)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + starts[which]


class Counts:
    """Counts per key and language, merged slice by slice so that memory follows the distinct keys."""

    def __init__(self, n_langs: int):
        self.names, self.counts = np.zeros(0, np.uint64), np.zeros((0, n_langs), np.int32)

    def add(self, keys: np.ndarray, lang: np.ndarray) -> None:
        fresh, code = np.unique(keys, return_inverse=True)
        names = np.union1d(self.names, fresh)
        counts = np.zeros((len(names), self.counts.shape[1]), np.int32)
        counts[np.searchsorted(names, self.names)] = self.counts
        np.add.at(counts, (np.searchsorted(names, fresh)[code], lang), 1)
        self.names, self.counts = names, counts

    def frequencies(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys seen at least `least` times and their smoothed log frequency per language."""
        keep = self.counts.sum(axis=1) >= least
        total = self.counts.sum(axis=0) + 0.5 * len(self.names)
        return self.names[keep], np.log((self.counts[keep] + 0.5) / total).astype(np.float32)


def train(rows: list[tuple[str, str]]):
    """(languages, word table, n-gram tables by length) from (text, language) rows."""
    langs = sorted({r[1] for r in rows})
    if not rows:
        return [], None, None
    number = {c: i for i, c in enumerate(langs)}
    words, grams = Counts(len(langs)), [Counts(len(langs)) for _ in range(NGRAM + 1)]
    for lo, hi, buf, offs in slices(pa.array([r[0] for r in rows], pa.string()), 1 << 21):
        text = Letters(buf, offs)
        lang = np.array([number[rows[i][1]] for i in range(lo, hi)], dtype=np.int64)
        of_word = np.repeat(lang, np.diff(text.rows))
        words.add(text.words, of_word)
        _, one = np.unique(text.words * np.uint64(len(langs)) + of_word.astype(np.uint64), return_index=True)  # n-grams from distinct words
        starts, ends = text.starts[one], text.ends[one]
        which, at = places(starts, ends)
        for n in range(1, NGRAM + 1):
            fits = at + n <= ends[which]
            grams[n].add(text.grams(at[fits], n), of_word[one][which[fits]])
    return langs, words.frequencies(LEAST_WORD), [None] + [grams[n].frequencies(LEAST_GRAM if n > 1 else 1) for n in range(1, NGRAM + 1)]


def lookup(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known, and the table row of each."""
    names = table[0]
    if not len(names):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return names[at] == keys, at


def totals(buf: np.ndarray, offs: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    """(rows, languages) sums of log frequencies, and letters' presence per row."""
    langs, word_table, gram_tables = model
    text = Letters(buf, offs)
    names, one, code = np.unique(text.words, return_index=True, return_inverse=True)
    score = np.zeros((len(names), len(langs)), dtype=np.float64)
    known, at = lookup(word_table, names)
    score[known] = word_table[1][at[known]]
    unseen = np.flatnonzero(~known)
    starts, ends = text.starts[one[unseen]], text.ends[one[unseen]]
    which, pos = places(starts, ends)
    for n in range(NGRAM, 0, -1):
        fits = np.flatnonzero(pos + n <= ends[which])
        hit, row = lookup(gram_tables[n], text.grams(pos[fits], n))
        for i in range(len(langs)):
            score[unseen, i] += np.bincount(which[fits[hit]], weights=gram_tables[n][1][row[hit], i], minlength=len(unseen))
        left = np.ones(len(pos), dtype=bool)
        left[fits[hit]] = False
        which, pos = which[left], pos[left]
    of_row = np.repeat(np.arange(len(offs) - 1), np.diff(text.rows))
    sums = np.stack([np.bincount(of_row, weights=score[code, i], minlength=len(offs) - 1) for i in range(len(langs))], axis=1)
    return sums, np.diff(text.rows) > 0


def with_language(documents: DataFrame, model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Input rows with the likeliest learned language and its posterior under equal priors.

    Texts that are null or have no letter are `und` with score 0, as is everything if nothing was learned. Equal sums go to the first
    language in alphabetical order. Input columns of the two names are replaced; an empty table stays empty.
    """
    rest = documents.drop(lang_col, score_col)
    old, schema = rest.columns, T.StructType(rest.schema.fields + [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        one = shared.value
        names = np.array([UNKNOWN, *one[0]], dtype=object)
        for batch in batches:
            pred, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for lo, hi, buf, offs in slices(batch.column(text_col)):
                if not one[0]:
                    pred.append(np.zeros(hi - lo, np.int64))
                    score.append(np.zeros(hi - lo))
                    continue
                sums, some = totals(buf, offs, one)
                post = np.exp(sums - sums.max(axis=1, keepdims=True))
                pred.append(np.where(some, sums.argmax(axis=1) + 1, 0))
                score.append(np.where(some, 1 / post.sum(axis=1), 0.0))
            columns = [*(batch.column(c) for c in old), pa.array(names[np.concatenate(pred)], pa.string()), pa.array(np.concatenate(score))]
            yield pa.RecordBatch.from_arrays(columns, names=[*old, lang_col, score_col])

    return rest.mapInArrow(run, schema)


def sample_per_language(documents: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """About `most` training rows in all, as many of each language as it has, chosen by id hash: the bound of what is learned from."""
    train = documents.where((fold(id_col, 5) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(train.groupBy(lang_col).count().collect())
    if not counts:
        return []
    share = most // len(counts)
    chance = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, share / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(1 << 20)) / float(1 << 20)
    return [(r[0], r[1]) for r in train.where(draw < chance[F.col(lang_col)]).select(text_col, lang_col).limit(2 * most).collect()]


def predicted_rows(documents: DataFrame) -> DataFrame:
    """The query's columns; learns from a bounded sample of rows whose crc32 remainder by 5 is not 0."""
    model = train(sample_per_language(documents, "doc_id", "text", "lang"))
    done = with_language(documents.select("doc_id", "text"), model)
    return done.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
