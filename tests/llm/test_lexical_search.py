import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import awkward, documents  # noqa: F401
from pyspark.sql import functions as F

from trendloom.llm import lexical_search as ls
from trendloom.llm.graph import stored


def terms_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(ls.TERM, lower)


def by_hand(docs, items, top=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms_of(text))
    out = set()
    for item, query in asked.items():
        scored = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in query.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])}
    return out


@pytest.fixture
def corpus(awkward):
    rng = random.Random(14)
    words = [f"t{k}" for k in range(60)] + ["Été", "漢字", "🙂", "x1"]
    rows = list(awkward) + [(100 + i, " ".join(rng.choices(words, [1 / (1 + k) for k in range(len(words))], k=rng.randrange(1, 80)))) for i in range(900)]
    items = [(i, ", ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(25)] + [(80, None), (81, " .,"), (82, "unheard of"), (3, "more of t1"), (83, "same text"), (84, "t0")]
    return rows, items


def test_top_documents_equal_brute_force_for_all_shard_sizes(spark, documents, corpus):
    rows, items = corpus
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = by_hand(rows, items)
    odd = documents(rows).withColumns({"terms": F.lit("mine"), "score": F.lit(3), "id": F.lit("z")})
    for size, per_call in ((ls.SHARD_TERMS, ls.ITEM_ROWS), (3000, 40)):
        index = stored(ls.index_shards(odd.repartition(3), shard_terms=size), "index")
        got = {tuple(r) for r in ls.search(index, asked, item_rows=per_call).collect()}
        assert got == want
    assert ls.ranked_rows(documents([]), asked).count() == 0 == ls.ranked_rows(documents(rows), asked.limit(0)).count()
    many = documents([(1, "same words")] * 3 + [(k, f"other {k}") for k in range(10, 30)])
    assert [tuple(r)[1:3] for r in ls.ranked_rows(many, spark.createDataFrame([(9, "words")], "item_id long, text string")).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 1)]


def test_blocks_stay_closed_when_bounds_reject_their_documents():
    rng, shard = random.Random(15), ls.ShardBuilder()
    for i in range(20000):
        shard.add(i, [f"c{rng.randrange(3)}".encode() for _ in range(rng.randrange(1, 30))] + ([b"rare"] if i % 2500 < 12 else []))
    n, total = 20000, shard.size
    built = ls.Shard(shard.row(), n, total)
    weigh = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * built.dfs[built.code[t]] + 1)))
    heap = built.search([(t, weigh(t)) for t in ("c0", "c1", "rare")], [], 10)
    everything = ls.Shard(shard.row(), n, total)
    scores = np.zeros(n, dtype=np.int64)
    for t in ("c0", "c1", "rare"):
        code = everything.code[t]
        for b in range(everything.first_block[code], everything.first_block[code + 1]):
            docs, impact = everything.block(code, b)
            scores[docs] += impact * weigh(t)
            assert impact.max() == everything.block_maxima(code)[b - everything.first_block[code]]
    best = np.lexsort((np.arange(n), -scores))[:10]
    assert heap == [(-int(scores[i]), False, int(i)) for i in best]
    assert len(built.open) < 0.5 * len(everything.open)


def test_packing_round_trip():
    rng = np.random.default_rng(16)
    values = np.concatenate([rng.integers(0, 1 << k, 50) for k in (1, 7, 8, 14, 15, 21, 28, 31)])
    data, at = ls.packed(values)
    assert (ls.unpacked(data) == values).all() and at[-1] == len(data) and (ls.unpacked(data[at[60] : at[200]]) == values[60:200]).all()
