"""Scores of the trained models against plain loops over positions, dictionaries and sets."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_fixtures import awkward, documents  # noqa: F401

from trendloom.llm import language, quality_net, toxicity
from trendloom.llm.arrays import slices

DRAW = random.Random(31)
WORDS = ["".join(DRAW.choice("abcdeïé漢") for _ in range(DRAW.randrange(1, 12))) for _ in range(200)]


def some_texts(awkward, n=60):
    long = (2, 3, 700, 3000)
    return [(i, t) for i, t in awkward if i] + [(100 + i, " ".join(DRAW.choice(WORDS) for _ in range(long[i % 4]))) for i in range(n)] + [(500, "same rows"), (500, "same rows")]


def hashed(function, *texts):
    return [function(buf, offs) for _, _, buf, offs in slices(pa.array(texts, pa.string()))]


def test_quality_scores_equal_a_loop_over_positions(documents, awkward):
    rows = some_texts(awkward, 16)
    net = quality_net.train([(t or "", i % 2) for i, t in rows if len(t or "") < 20_000], epochs=1)
    p, zero = {k: v.astype(np.float64) for k, v in net.p.items()}, bytes(quality_net.STEP)

    def logit(text):
        raw = (text or "").encode()
        raw += bytes(-len(raw) % quality_net.STEP) if raw else zero
        blocks = [raw[i : i + quality_net.STEP] for i in range(0, len(raw), quality_net.STEP)] + [zero]
        seen = [np.concatenate([p["embed"][b] for b in block]) for block in blocks]
        response = [a @ p["left"] + b @ p["right"] for a, b in zip(seen, seen[1:])]
        chunks, at = [], 0
        while True:
            chunks.append(np.max(response[at : at + quality_net.POOL], axis=0))
            if at + quality_net.POOL >= len(response):
                break
            at += quality_net.STRIDE
        return np.mean([np.tanh(np.maximum(c + p["fb"], 0) @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0] for c in chunks])

    got = sorted(tuple(r) for r in quality_net.with_score(documents(rows), net).select("doc_id", "score").collect())
    expected = sorted((i, 1 / (1 + math.exp(-(net.scale * logit(t) + net.shift)))) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, expected)) < 1e-4


def test_toxicity_scores_equal_sums_over_sets_of_words(documents, awkward):
    rows = some_texts(awkward)
    labelled = [(f"{' '.join(DRAW.choice(WORDS) for _ in range(9))} {'vermin Scum' if i % 2 else 'garden'}", i % 2) for i in range(200)]
    known, weights, bias = toxicity.train(labelled)
    weight = dict(zip(known.tolist(), weights.astype(float).tolist()))

    def parts(text):
        low = "".join(c.lower() if c.isascii() else c if ord(c) >= 128 else c for c in text or "")
        return {w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in low).split(" ") if w}

    def expected(text):
        of_words = {int(v) for w in parts(text) for _, values in hashed(toxicity.features, w) for v in values}
        return 1 / (1 + math.exp(-max(-30, min(30, bias + sum(weight.get(v, 0.0) for v in of_words)))))

    rows = [(i, t) for i, t in rows if len(t or "") < 50_000] + [(600, "vermin SCUM"), (601, "Vermin,vermin;garden")]
    got = sorted(tuple(r) for r in toxicity.with_score(documents(rows), (known, weights, bias)).select("doc_id", "score").collect())
    want = sorted((i, expected(t)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want] and max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 1e-5
    assert dict(got)[600] > dict(got)[2]


def test_languages_equal_a_dictionary_scorer(documents, awkward):
    train = [(" ".join(DRAW.choice(WORDS[k::3]) for _ in range(80)) + " Ünique 漢字x", lang) for k, lang in enumerate(("de", "en", "fr")) for _ in range(4)]
    model, langs = language.train(train), ["de", "en", "fr"]

    def words(text):
        return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()

    seen, grams = Counter(), [Counter() for _ in range(language.NGRAM + 1)]
    for text, lang in train:
        seen.update((w, lang) for w in words(text))
    for w, lang in seen:
        for n in range(1, language.NGRAM + 1):
            grams[n].update((w[i : i + n], lang) for i in range(len(w) - n + 1))

    def table(counts, least):
        total, names = {g: sum(n for (_, x), n in counts.items() if x == g) for g in langs}, {k for k, _ in counts}
        kept = [k for k in names if sum(counts[k, g] for g in langs) >= least]
        return {k: [math.log((counts[k, g] + 0.5) / (total[g] + 0.5 * len(names))) for g in langs] for k in kept}

    known, by_size = table(seen, language.LEAST_WORD), [None] + [table(grams[n], language.LEAST_GRAM if n > 1 else 1) for n in range(1, language.NGRAM + 1)]

    def sums(text):
        out = np.zeros(len(langs))
        for w in words(text):
            if w in known:
                out += known[w]
                continue
            for i in range(len(w)):
                out += next((by_size[n][w[i : i + n]] for n in range(min(language.NGRAM, len(w) - i), 0, -1) if w[i : i + n] in by_size[n]), np.zeros(len(langs)))
        return out

    rows = some_texts(awkward) + [(700 + i, "".join(DRAW.choice("abcdeïéz漢 ") for _ in range(60))) for i in range(40)]
    for r in language.with_language(documents(rows), model).collect():
        total = sums(r["text"])
        if not words(r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        posterior = np.exp(total - total.max())
        best = max(posterior) / sum(posterior)
        assert abs(r["score"] - best) < 1e-3
        if best > 0.51 or sorted(posterior)[-2] < 0.99:
            assert r["lang_pred"] == langs[int(np.argmax(total))]


def test_scorers_replace_clashing_columns_and_keep_repeats(spark):
    df = spark.createDataFrame([(1, "a b", "old", "x"), (1, "a b", "old", "x"), (2, None, None, None)], "doc_id long, text string, score string, lang_pred string")
    for got in (
        quality_net.with_score(df, quality_net.Network()), toxicity.with_score(df, toxicity.train([("bad word", 1), ("good word", 0)] * 9)),
        language.with_language(df, language.train([("a b", "en"), ("c d", "de")] * 3)),
    ):
        rows = got.collect()
        assert len(rows) == 3 and dict(got.dtypes)["score"] == "double" and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
