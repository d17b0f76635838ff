"""Operator 6, counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings is trained on a bounded sample. Every labelled sentence with an identity term is also seen
with the term swapped for another of its kind; labelled sentences without one are also seen with a term put in, and with the term swapped
there, the label unchanged. The squared change of the score is penalised, so group names carry no weight of their own.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.arrays import ALNUM, LOWER, SLICE_BYTES, hash_spans, mix, slices, word_spans
from trendloom.llm.graph import bounded_batches
from trendloom.llm.labelled import fold, sample_per_label

PER_LABEL = (4000, 4000)  # clean and toxic rows the model learns from at most
SENTENCES = 4000  # labelled sentences that give counterfactuals at most
FEATURES = 1500
SURE = 4.5  # root of the likelihood ratio statistic, above chance for some hundred thousand candidate features
BEGINNING = 5
THRESHOLD = 0.7

#: Terms that name groups; each tuple holds terms that can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "nonbinary", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus"), ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"), ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes"),
)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of all words and word beginnings, repeats included."""
    low = LOWER[buf]
    starts, ends, rows = word_spans(low, offs, ALNUM)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    short = np.minimum(ends, starts + BEGINNING)
    return np.concatenate((row, row)), np.concatenate((hash_spans(low, starts, ends), mix(hash_spans(low, starts, short) + np.uint64(1))))


def present(texts: list[str], known: np.ndarray) -> np.ndarray:
    """Dense presence matrix of the known (sorted) features."""
    x = np.zeros((len(texts), len(known)), dtype=np.float32)
    for lo, _, buf, offs in slices(pa.array(texts, pa.string()), SLICE_BYTES // 4):
        row, value = features(buf, offs)
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        hit = known[at] == value
        x[lo + row[hit], at[hit]] = 1
    return x


def swapped(sentence: str) -> list[str]:
    """The sentence with its identity terms replaced by the next and the last term of their group; none without such a term."""
    out = []
    words = sentence.split()
    for shift in (1, -1):
        changed = list(words)
        for group in IDENTITY_TERMS:
            for i, w in enumerate(words):
                bare = w.strip(".,;:!?\"'()").lower()
                if bare in group:
                    changed[i] = w.lower().replace(bare, group[(group.index(bare) + shift) % len(group)])
        if changed != words:
            out.append(" ".join(changed))
    return out


def counterfactuals(texts: list[str], most: int = SENTENCES) -> list[tuple[str, str]]:
    """(sentence, sentence that should score alike): identity terms swapped where there are some, else put in and swapped.

    Sentences are taken by a hash of their text, at most `most`; the term's group and place follow from the same hash.
    """
    hashed = lambda: ((zlib.crc32(s.encode()), s) for text in texts for s in re.split(r"[.!?\n]", text) if s.strip())
    hashes = np.unique(np.fromiter((h for h, _ in hashed()), dtype=np.uint32))
    last = hashes[min(most, len(hashes)) - 1] if len(hashes) else 0
    pairs = []
    for h, s in sorted({(h, s) for h, s in hashed() if h <= last}):
        words, group = s.split(), IDENTITY_TERMS[h % len(IDENTITY_TERMS)]
        changed = swapped(s)
        if not changed:
            at = h // 64 % (len(words) + 1)
            changed = [" ".join([*words[:at], group[(h // 8 + k) % len(group)], *words[at:]]) for k in range(2)]
        pairs += [(s, t) for t in changed]
        if len(changed) > 1:
            pairs.append((changed[0], changed[1]))
    return pairs


def feature_counts(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, sorted, with the number of toxic and of clean texts that hold each; slice by slice, repeats within a text count once."""
    names, counts = np.zeros(0, np.uint64), np.zeros((2, 0))
    for lo, _, buf, offs in slices(pa.array(texts, pa.string()), SLICE_BYTES // 4):
        row, value = features(buf, offs)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        some, code = np.unique(value[new], return_inverse=True)
        bad = np.bincount(code, weights=y[lo + row[new]], minlength=len(some))
        both = np.stack((bad, np.bincount(code, minlength=len(some)) - bad))
        joint, code = np.unique(np.concatenate((names, some)), return_inverse=True)
        old, names = counts, joint
        counts = np.zeros((2, len(joint)))
        counts[:, code[: old.shape[1]]] += old
        counts[:, code[old.shape[1] :]] += both
    return names, counts[0], counts[1]


def train(rows: list[tuple[str, int]], n_features: int = FEATURES, penalty: float = 5.0, decay: float = 3e-5, steps: int = 200):
    """(sorted feature hashes, weights, bias) from (text, label) rows; no rows of one label give a constant score."""
    y = np.array([r[1] for r in rows], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return np.zeros(1, np.uint64), np.zeros(1, np.float32), 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    texts = [r[0] for r in rows]
    names, pos, neg = feature_counts(texts, y)
    share, n = y.mean(), pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(pos > 0, pos * np.log(pos / (n * share)), 0) + np.where(neg > 0, neg * np.log(neg / (n * (1 - share))), 0)
    z = np.sqrt(2 * np.maximum(g, 0))
    best = np.argsort(-z, kind="stable")[:n_features]
    best = best[z[best] >= SURE]
    terms = [np.unique(features(b, o)[1]) for _, _, b, o in slices(pa.array([w for g in IDENTITY_TERMS for w in g], pa.string()))]
    known = np.unique(np.concatenate([names[best], *terms]))
    x = present(texts, known)
    pairs, pull = counterfactuals(texts) if penalty else [], np.zeros((len(known), len(known)), np.float32)
    for i in range(0, len(pairs), 1000):
        delta = present([t for _, t in pairs[i : i + 1000]], known) - present([s for s, _ in pairs[i : i + 1000]], known)
        pull += delta.T @ delta * (2 * penalty / len(pairs))
    w, b = np.zeros(len(known), np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
    for step in range(1, steps + 1):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        gw, gb = x.T @ g + decay * w + pull @ w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-6)  # a Python float keeps the arrays in 32 bits
    return known, w.astype(np.float32), float(b)


def with_score(documents: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Input rows with the probability that the text is toxic. Null and empty texts get the score of no words.

    An input column named `score_col` is replaced; an empty table stays empty.
    """
    rest = documents.drop(score_col)
    old, schema = rest.columns, T.StructType(rest.schema.fields + [T.StructField(score_col, T.DoubleType())])
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known, weights, bias = shared.value
        for batch in batches:
            total = np.full(len(batch), bias)
            for lo, hi, buf, offs in slices(batch.column(text_col), SLICE_BYTES // 4):
                row, value = features(buf, offs)
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = known[at] == value
                pair = np.unique(row[hit] * len(known) + at[hit])
                total[lo:hi] += np.bincount(pair // len(known), weights=weights[pair % len(known)], minlength=hi - lo)
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in old), pa.array(score)], names=[*old, score_col])

    return rest.mapInArrow(run, schema)


def learn(documents: DataFrame, labels: DataFrame, per_label: tuple[int, int] = PER_LABEL):
    """Model from at most `per_label` rows of each label, of rows whose crc32 remainder by 3 is not 1."""
    return train(sample_per_label(documents, labels, "toxic", "doc_id", "text", fold("doc_id", 3) != 1, per_label))


def scored_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    scored = with_score(documents.select("doc_id", "text"), learn(documents, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
