import itertools
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from trendloom.operators import assignment as A
from trendloom.operators import match as M
from trendloom.operators import pairs as Q

PAIRS = "run_id long, cur string, known string, status string, score double"


def brute_force(gain):
    n, m = gain.shape
    if n > m:
        return max(sum(gain[r, c] for c, r in enumerate(p)) for p in itertools.permutations(range(n), m))
    return max(sum(gain[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(m), n))


def settled(gain):
    n, m = gain.shape
    owner, price, short = A.settle([(np.arange(m), gain[r]) for r in range(n)], np.full(n, -np.inf), np.zeros(m), np.full(m, -1))
    assert not short
    return owner, price


def best_total(gain):
    """Optimum of a larger matrix, rows not more than columns, through `settle` on the whole of it."""
    owner, _ = settled(gain)
    columns = np.flatnonzero(owner >= 0)
    assert len(columns) == len(gain)
    return gain[owner[columns], columns].sum()


def test_settling_a_block_is_optimal_with_supporting_prices():
    rnd = np.random.default_rng(1)
    for _ in range(150):
        n, m = sorted(rnd.integers(1, 7, 2))
        gain = np.round(rnd.random((n, m)), 2)
        owner, price = settled(gain)
        columns = np.flatnonzero(owner >= 0)
        assert sorted(owner[columns]) == list(range(n)) and gain[owner[columns], columns].sum() == pytest.approx(brute_force(gain))
        assert (price[owner < 0] == 0).all()
        for c in columns:
            assert gain[owner[c], c] - price[c] >= (gain[owner[c]] - price).max() - 1e-9


def test_one_to_one_over_many_runs(table):
    rnd = random.Random(2)
    rows, best = [], {}
    for run in range(12):
        n, m = rnd.randint(1, 5), rnd.randint(1, 6)
        gain = np.array([[round(rnd.random(), 3) for _ in range(m)] for _ in range(n)])
        rows += [(run, f"c{r}", f"k{c}", "active", float(gain[r, c])) for r in range(n) for c in range(m)]
        best[run] = (brute_force(gain), min(n, m))
    got = {}
    for run, cur, known, score in rows_of(M.one_to_one(table(rows, PAIRS)), "run_id", "cur", "known", "score"):
        got.setdefault(run, []).append((cur, known, score))
    for run, pairs in got.items():
        assert sum(p[2] for p in pairs) == pytest.approx(best[run][0]) and len(pairs) == best[run][1]
        assert len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == len(pairs)


def test_auction_between_blocks_reaches_the_optimum(spark):
    rnd = np.random.default_rng(4)
    gain = np.round(rnd.random((40, 60)) * rnd.random(60)[None, :], 3)  # some entries are wanted by all
    gain[:6] = gain[0]  # topics that compete for the same entries
    rows = [(1, f"t{r}", f"e{c}", float(gain[r, c])) for r in range(40) for c in range(60)] + [(2, "x", "e0", 0.5), (2, "y", "e0", 0.4)]
    df = spark.createDataFrame(rows, "run_id long, topic string, entry string, score double")
    for block_rows, width in ((A.BLOCK_ROWS, 4), (800, 4)):
        got = A.auction(df, epsilon=1e-3, block_rows=block_rows, least_width=width).collect()
        pairs = [(int(r["topic"][1:]), int(r["entry"][1:])) for r in got if r["run_id"] == 1]
        assert len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == 40
        assert sum(gain[p] for p in pairs) >= best_total(gain) - (40 * 2e-3 if block_rows < 1000 else 1e-6)
        assert [(r["topic"], r["entry"]) for r in got if r["run_id"] == 2] == [("x", "e0")]


def test_a_bid_is_worth_the_advantage_over_the_next_best():
    rows = pd.DataFrame({"run_id": 1, "topic": ["a", "a", "b", "b"], "entry": ["x", "y", "x", "y"], "score": [0.9, 0.2, 0.6, 0.5], "beyond": False, "price": [0.0, 0.1, 0.0, 0.1], "holder": [None, "other", None, "other"]})
    bids = {r.entry: (r.holder, round(r.price, 6)) for r in A.block_bids(rows, 1e-3).itertuples()}
    assert bids["x"][0] == "a" and bids["y"][0] == "b" and bids["y"][1] > 0.101


def inputs(spark, n_cur, n_known, seed=5):
    rnd = random.Random(seed)
    vector = lambda: [rnd.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(4)]
    words = lambda: [rnd.choice("abcdef") for _ in range(rnd.randrange(4))]
    cur = [(run, c, vector() if c else None, words()) for run in (1, 2) for c in range(n_cur)]
    known = [(run, f"k{k:03d}", "active", vector(), words()) for run in (1, 2) for k in range(n_known)]
    cur_docs = [(run, c, d) for run, c, _, _ in cur for d in rnd.sample(range(30), 3)]
    known_docs = [(run, k, d) for run, k, *_ in known for d in rnd.sample(range(30), 4)]
    frames = (
        spark.createDataFrame(cur, "run_id long, cur long, centroid array<double>, keywords array<string>"),
        spark.createDataFrame(known, "run_id long, known string, status string, centroid array<double>, keywords array<string>"),
        spark.createDataFrame(cur_docs, "run_id long, cur long, doc_id long"), spark.createDataFrame(known_docs, "run_id long, known string, doc_id long"),
    )

    def score(a, b):
        one, two = ({d for run, c, d in docs if (run, c) == key} for docs, key in ((cur_docs, a[:2]), (known_docs, b[:2])))
        v, w = a[2] or [0.0] * 4, b[3]
        size = (sum(x * x for x in v) * sum(x * x for x in w)) ** 0.5
        ratio = lambda p, q: len(p & q) / len(p | q) if p | q else 0.0
        return 0.65 * max(0.0, sum(x * y for x, y in zip(v, w)) / size if size else 0.0) + 0.2 * ratio(one, two) + 0.15 * ratio(set(a[3]), set(b[4]))

    return frames, {(a[0], a[1], b[1]): score(a, b) for a in cur for b in known if a[0] == b[0]}


def test_scores_and_the_strongest_of_them(spark):
    frames, want = inputs(spark, 5, 40)
    for at_once in (Q.TOPICS_AT_ONCE, 3):
        got = {(r["run_id"], r["cur"], r["known"]): r["score"] for r in Q.scored(*frames, topics_at_once=at_once).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        top = {(r["run_id"], r["cur"], r["known"]) for r in Q.scored(*frames, strongest=True, topics_at_once=at_once).collect()}
        for run, cur in {k[:2] for k in want}:
            ranked = sorted((k for k in want if k[:2] == (run, cur)), key=lambda k: (-round(got[k], 12), k[2]))
            assert {k for k in top if k[:2] == (run, cur)} == set(ranked[:5])
    plain = M.mutual_best(Q.scored(*frames))
    for r in plain.collect():
        mine = sorted((v for k, v in want.items() if k[:2] == (r["run_id"], r["cur"])), reverse=True)
        theirs = max(v for k, v in want.items() if (k[0], k[2]) == (r["run_id"], r["known"]))
        assert r["score"] == pytest.approx(mine[0]) == pytest.approx(theirs) and r["margin"] == pytest.approx(mine[0] - mine[1])


def test_tasks_pass_on_few_scores_of_a_large_portfolio(spark):
    topics = spark.createDataFrame([(1, c, [float(c == k) for k in range(4)], ["w"]) for c in range(4)], "run_id long, cur long, centroid array<double>, keywords array<string>")
    ids = spark.range(0, 100_000, 1, 8)
    known = ids.select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("known"), F.lit("active").alias("status"), F.array(*[F.rand(k) for k in range(4)]).alias("centroid"), F.array(F.lit("w")).alias("keywords"))
    none = spark.createDataFrame([], "run_id long, cur long, known long, doc_id long")
    strong = Q.scored(topics, known, none.select("run_id", "cur", "doc_id"), none.select("run_id", "known", "doc_id"), strongest=True)
    plan = strong._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert strong.groupBy("cur").count().where("count <> 4").count() == 0
    assert M.one_to_one(strong).count() == 4


def test_evidence_meets_both_topics_of_a_link_in_one_join(table):
    """Copies of a document count once, outliers do not."""
    links = table([(1, 10, None), (2, 11, 10), (3, 12, 11)], "occurrence_id long, topic_id long, prev_topic_id long")
    docs = table([(10, 1, False), (10, 1, False), (10, 2, False), (11, 2, False), (11, 3, False), (11, 3, False), (11, 4, True), (13, 9, False)], "topic_id long, doc_id long, is_outlier boolean")
    delta = M.evidence_delta(links, docs)
    assert rows_of(delta, "occurrence_id", "evidence_added", "evidence_removed") == [(1, 2, 0), (2, 1, 1), (3, 0, 2)]
    assert delta._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_reconciled_rows_are_not_joined_once_their_differences_are_made(spark):
    """The prevalence meets the trends before: nothing stands above the union of known and new trends but columns."""
    from trendloom.catalog import portfolio_queries as queries
    from trendloom.catalog.model import Model

    plan = queries.reconciled(Model(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join")
