import random

import duckdb
import pytest
from llm_fixtures import awkward  # noqa: F401
from pyspark.sql import functions as F

from trendloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        all_weights, part, left = sum(weight[s] for s in open_), left, 0.0
        for s in list(open_):
            target[s] += part * weight[s] / all_weights
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


@pytest.fixture
def corpus(spark, awkward):
    rng = random.Random(3)
    rows = [(i, t, "en", ("b", None, "é")[k % 3], 0) for k, (i, t) in enumerate(awkward)]
    rows += [(100 + i, "w " * rng.randrange(1, 60), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(600)]
    rows += [(7777, "again and again", "de", "a", 0)] * 400 + [(50, "", "en", "empty", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_taken_words(spark, corpus):
    got = mixing.taken_rows(corpus).collect()
    assert len(got) == corpus.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes, taken, longest = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
    want = by_hand(sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in got:
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], pytest.approx(want[r["source"]]))
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes) and sizes["empty"] == 0 == want["empty"]
    same = [r["copies"] for r in got if r["doc_id"] == 7777]
    assert max(same) - min(same) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_rows(corpus.repartition(7)).collect()))
    con = duckdb.connect()
    con.register("documents", corpus.toArrow())
    names = ["doc_id", "source", "size", "source_size", "target", "taken", "copies"]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got))) == sorted(map(str, con.sql(mixing.ORACLE).fetchall()))
    assert mixing.taken_rows(corpus.limit(0)).count() == 0


def test_mix_repeats_whole_rows_under_any_column_names(spark, corpus):
    odd = corpus.withColumns({"size": F.lit("mine"), "copies": F.lit(9), "target": F.lit("t"), "__sum": F.lit(True), "row": F.lit(1), "mix": F.lit(2)})
    rows = mixing.mixed(odd).collect()
    plan = mixing.taken_rows(corpus)
    assert rows[0].asDict().keys() == set(odd.columns) and {r["size"] for r in rows} == {"mine"}
    assert len(rows) == plan.agg(F.sum("copies")).first()[0]


def test_running_sums_cross_partitions(spark):
    rng = random.Random(5)
    rows = [(f"g{min(3, i % 7)}", rng.randrange(50), i, rng.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, a long, b long, v long").repartition(5)
    got = {(r["g"], r["b"]): r["s"] for r in mixing.running_sums(df, "g", "v", ["a", "b"], "s").collect()}
    total = {}
    for g, _, b, v in sorted(rows):
        total[g] = total.get(g, 0) + v
        assert got[(g, b)] == total[g]
    assert len(got) == 3000
