import random

import numpy as np
import pytest
from llm_fixtures import awkward, documents  # noqa: F401

from trendloom.llm import exact_substring, near_dedup, substring
from trendloom.llm.arrays import segments


def corpus(seed, n=60, words=400, vocabulary=3000):
    rng = random.Random(seed)
    draw = lambda k: [f"v{rng.randrange(vocabulary)}" for _ in range(k)]
    passages = [draw(rng.randrange(45, 90)) for _ in range(5)]
    rows = []
    for i in range(n):
        text = draw(rng.randrange(1, words))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        rows.append((i * 3, " ".join(text)))
    rows.append((500, rows[3][1]))
    rows.append((501, rows[3][1] + " tail"))
    rows.append((502, "a b " * 300))
    return rows


def test_equal_windows_get_equal_anchors():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    tokens[250:330] = tokens[40:120]
    anchor, first, count, digest = segments(tokens, np.array([0, 400]), 50, 10, np.zeros(0, np.uint64))
    of = {int(f) + k: int(a) for a, f, n in zip(anchor, first, count) for k in range(n)}
    assert len(of) == 351
    assert all(of[40 + k] == of[250 + k] for k in range(31))


def test_substring_matches_brute_force(documents, awkward):
    rows = corpus(1) + [(1000 + i, t) for i, (d, t) in enumerate(awkward) if d]
    got = {r[0]: tuple(r[1:]) for r in substring.digest_rows(documents(rows)).collect()}
    assert got == substring.brute_force(rows, 50)


def test_suffix_array_matches_brute_force(documents, awkward):
    rows = corpus(2, n=25) + [(1000 + i, t) for i, (d, t) in enumerate(awkward) if d]
    got = {r[0]: tuple(r[1:]) for r in exact_substring.digest_rows(documents(rows)).collect()}
    assert got == exact_substring.brute_force([(d, (t or "").encode()) for d, t in rows], 100)


@pytest.mark.parametrize("op", [substring.remove_repeated_words, exact_substring.remove_repeated_bytes])
def test_passages_keep_odd_rows(documents, awkward, op):
    found = op(documents(awkward).selectExpr("*", "1 AS kept", "'x' AS n_removed"))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(awkward) and rows[None]["n_removed"] == 0 and rows[1]["n_removed"] == 0
    assert op(documents([])).count() == 0


@pytest.mark.parametrize("op, window", [(substring.remove_repeated_words, 50), (exact_substring.remove_repeated_bytes, 100)])
def test_passages_of_different_texts_of_one_id(documents, op, window):
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    p, q = words("p", 80), words("q", 80)
    rows = [(1, words("a", 200) + p + words("b", 9)), (1, words("c", 120)), (1, q + words("d", 60)), (4, words("e", 150) + q), (4, words("f", 170)), (4, p[:70] + words("g", 200))]
    rows = [(d, " ".join(w)) for d, w in rows + [rows[3], (7, words("h", 5) + p + words("i", 90) + q)]]
    tokens = str.split if window == 50 else str.encode
    windows = [(d, i, tuple(t[i : i + window])) for d, text in rows for t in [tokens(text)] for i in range(len(t) - window + 1)]
    first = {}
    for d, i, w in windows:
        first[w] = min(first.get(w, (d, i)), (d, i))
    want = []
    for d, text in rows:
        t, gone = tokens(text), set()
        for i in range(len(t) - window + 1):
            head = first[tuple(t[i : i + window])]
            if head[0] < d or (window == 100 and head < (d, i)):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(t) if i not in gone]
        want.append((d, text, " ".join(kept).encode() if window == 50 else bytes(kept), len(gone)))
    got = [(r["doc_id"], r["text"], r["kept"].encode() if window == 50 else bytes(r["kept"]), r["n_removed"]) for r in op(documents(rows)).collect()]
    assert sorted(got) == sorted(want) and sum(n > 0 for *_, n in want) == 4


def test_fm_index_ranks():
    rng = np.random.default_rng(3)
    sequence = np.concatenate([rng.integers(1, 9, 200), [0]])
    index = substring.FMIndex(sequence, 9, 4)
    order = sorted(range(len(sequence)), key=lambda i: list(sequence[i:]))
    assert index.suffixes.tolist() == order
    bwt = sequence[index.suffixes - 1]
    at = rng.integers(0, len(sequence) + 1, 50)
    symbol = rng.integers(0, 9, 50)
    assert index.rank(symbol, at).tolist() == [int((bwt[:i] == s).sum()) for s, i in zip(symbol, at)]


def test_near_duplicates_match_brute_force(documents, awkward):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(150)]
        for c in range(8):
            text = list(base)
            for _ in range(c):
                text[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(text)))
    rows += [(5000 + i, t) for i, (d, t) in enumerate(awkward) if d]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.class_rows(documents(rows)).collect()}
    assert got == near_dedup.brute_force(rows)


def test_near_duplicates_of_odd_tables(documents, awkward):
    assert near_dedup.class_rows(documents([])).count() == 0
    assert near_dedup.class_rows(documents(awkward)).count() == len(awkward) - 1


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = (np.sort(value[:220]), rng.integers(1, 5, 220)), (np.sort(value[60:300]), rng.integers(1, 5, 240))
    row = np.repeat([0, 1], [220, 240])
    sig = near_dedup.signatures(row, np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]).astype(float), 2, 4000)
    wa, wb = dict(zip(a[0].tolist(), a[1].tolist())), dict(zip(b[0].tolist(), b[1].tolist()))
    exact = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in set(wa) | set(wb)) for i in set(wa) & set(wb))
    assert abs(near_dedup.similarity(a, b) - exact) < 1e-9
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
