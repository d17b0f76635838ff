import random
import re
import zlib
from collections import Counter

import duckdb
from llm_fixtures import awkward, documents  # noqa: F401

from trendloom.llm import spelling

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[a-zA-ZÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    links = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in links.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return out


def test_groups_equal_brute_force_and_sql(spark, documents, awkward):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(5, 8))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaa", "Straße", "strasse", "ÉCOLE", "×÷×÷×"]
    rows = list(awkward) + [(50 + i, " ".join(rng.choices(vocabulary, [1 / (1 + k) for k in range(len(vocabulary))], k=60))) for i in range(120)]
    rows += [(3000 + i, "hello hello, hellp; jello-hallo hell") for i in range(12)] + [(7, "hello " * 40)] * 30 + [(9000, "hellos " * 3)]
    got = {tuple(r[c] for c in NAMES) for r in spelling.variant_groups(documents(rows)).collect()}
    want = by_hand(rows)
    assert got == want and any(r[1] and r[1] != r[2] for r in want) and sum(r[4] for r in want) > 100
    con = duckdb.connect()
    con.register("documents", documents(rows).toArrow())
    assert set(con.sql(spelling.ORACLE).project(", ".join(NAMES)).fetchall()) == want
    assert spelling.variant_groups(documents([])).count() == 0
    assert spelling.variant_groups(documents([(1, None), (2, "tiny")])).count() == 0


def test_pivots_are_disjoint_rare_and_in_the_prefix():
    rng = random.Random(13)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(4, 12))) for _ in range(300)]
    count = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    ranks = {g: (r, n) for r, (n, g) in enumerate(sorted((n, g) for g, n in count.items()))}
    for w in words:
        prefix, (a, b) = spelling.prefix_and_pivots(w, ranks)
        weight = lambda i: ranks[w[i : i + 2]][1]  # noqa: E731, B023
        pairs = [(i, j) for i in prefix for j in prefix if j - i >= 2]
        assert len(prefix) >= 3 and (a, b) in pairs and weight(a) + weight(b) == min(weight(i) + weight(j) for i, j in pairs)
        assert {ranks[w[i : i + 2]][0] for i in range(len(w) - 1) if i not in prefix}.isdisjoint({ranks[w[i : i + 2]][0] for i in prefix})


def test_damage_is_a_parameter(documents):
    rows = [(i, "planet planets") for i in range(400)]
    plain = {r["word"]: r["n"] for r in spelling.word_counts(documents(rows), damage=0).collect()}
    assert plain == {"planet": 400, "planets": 400}
    assert sum(r["n"] for r in spelling.word_counts(documents(rows), damage=2).collect()) < 800 + 1


def test_no_table_of_words_is_broadcast(spark, documents):
    """A file of words is small beside the keys they explode into, so Spark's size check would broadcast those."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([("planet", 9), ("planets", 3), ("plane", 2)], "word string, n long")
    pairs = spelling.near_pairs(words)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("planet", "planets"), ("plane", "planet")}
    groups = spelling.variant_groups(documents([(i, "planet planet planets") for i in range(9)]))
    assert "SortMergeJoin" in plan(pairs) and "SortMergeJoin" in plan(groups)
    assert "BroadcastHashJoin" not in plan(pairs) + plan(groups)
