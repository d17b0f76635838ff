"""One-to-one assignment of highest total score by an auction whose bidders are blocks.

Prices of entries and their holders are a table. In a round, topics without an entry, together with the holders of the entries they want
most, are dealt into blocks; a block settles its own competition at the prices it was given and bids for each entry it takes what the entry
is worth to the taker over the next best. The highest bid for an entry holds it, whoever loses bids again. Topics begin with their few
best entries; a block that cannot rule out that a better one lies beyond them asks for more and leaves the topic waiting. The total is at
most the number of topics times EPSILON below the best one, and a run whose contested topics fit one block takes a few rounds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.tables import written

EPSILON = 1e-7
BLOCK_ROWS = 500_000
LEAST_WIDTH = 16  # entries that a topic begins with at least; four times as many whenever they may not suffice
UNMATCHED = -1.0  # worth of staying alone, below every score
WANTED = 8  # entries of each waiting topic whose holders join the next round; doubles each round


def settle(lists: list[tuple[np.ndarray, np.ndarray]], beyond: np.ndarray, price: np.ndarray, owner: np.ndarray):
    """(owner, price, rows that need longer lists) after every row without a column was added by cheapest exchanges along chains of holders.

    `lists[r]`: columns of row r and their worth; `beyond[r]`: worth of its best column that is not listed, -inf if all are. `owner[c]` is the
    row that holds column c or -1; held columns have such prices that no row would rather have another. A chain ends at a column that no
    row holds, at its price. A row is left out if a column beyond a list on its chains might be nearer than that end.
    """
    owner, price, short = owner.copy(), price.copy(), set()
    held = {int(owner[c]): int(c) for c in np.flatnonzero(owner >= 0)}
    reach, via = np.full(len(price), np.inf), np.full(len(price), -1)
    for start in range(len(lists)):
        if start in held:
            continue
        touched, done, heap, end, doubtful = [], [], [], (np.inf, -1), []
        row, base, last = start, 0.0, -1
        gain = float((lists[start][1] - price[lists[start][0]]).max())
        while True:
            columns, worth = lists[row]
            offers = base + np.maximum(0.0, gain + price[columns] - worth)
            doubtful.append((base + max(0.0, gain - beyond[row]), row))
            free = owner[columns] < 0
            nearest = int(np.argmin(np.where(free, offers, np.inf)))
            if free[nearest] and offers[nearest] < end[0]:
                end = (float(offers[nearest]), int(columns[nearest]))
                via[end[1]] = last
            better = np.flatnonzero(~free & (offers < np.minimum(reach[columns], end[0])))
            reach[columns[better]], via[columns[better]] = offers[better], last
            touched.append(columns[better])
            for c, offer in zip(columns[better].tolist(), offers[better].tolist()):
                heapq.heappush(heap, (offer, c))
            while heap and (heap[0][0] > reach[heap[0][1]] or heap[0][1] in done):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end[0]:
                break
            base, last = heapq.heappop(heap)
            done.append(last)
            row = int(owner[last])
            gain = float(lists[row][1][lists[row][0] == last][0] - price[last])
        wider = {r for least, r in doubtful if least < end[0] and beyond[r] > -np.inf}
        if wider:
            short |= wider
        else:
            base, last = end
            for c in done:
                price[c] += max(0.0, base - reach[c])
            while last >= 0:
                before = int(via[last])
                owner[last] = start if before < 0 else owner[before]
                held[int(owner[last])] = last
                last = before
        for columns in touched:
            reach[columns] = np.inf
    return owner, price, short


def block_bids(rows: pd.DataFrame, epsilon: float) -> pd.DataFrame:
    """(run_id, entry, price, holder, kind) that a block bids: kind 1 an entry, 0 staying alone, -1 a topic that needs more entries.

    rows: run_id, topic, entry, score, beyond (true for the one row that tells the score of the best entry left out), price, holder.
    Entries held outside the block cost epsilon more. Each bid is raised by the taker's advantage over its next best entry.
    """
    rows = rows.sort_values(["topic", "score", "entry"], ascending=[True, False, True], kind="stable")
    topics, first = np.unique(rows["topic"].to_numpy(dtype=object).astype(str), return_index=True)
    inside = rows[~rows["beyond"]]
    code, entries = pd.factorize(inside["entry"], sort=True)
    n, m = len(topics), len(entries)
    place = {t: k for k, t in enumerate(topics)}
    price, owner = np.zeros(m + n), np.full(m + n, -1)
    lists: list = [([], []) for _ in range(n)]
    for t, c, s, p, h in zip(inside["topic"], code, inside["score"], inside["price"], inside["holder"]):
        lists[place[t]][0].append(c)
        lists[place[t]][1].append(s)
        if isinstance(h, str):
            owner[c] = place.get(h, -1)
            price[c] = p if owner[c] >= 0 else p + epsilon
    beyond = np.full(n, -np.inf)
    for t, s in rows[rows["beyond"]][["topic", "score"]].itertuples(index=False):
        beyond[place[t]] = s
    lists = [(np.array([*c, m + r]), np.array([*w, UNMATCHED])) for r, (c, w) in enumerate(lists)]
    owner, price, short = settle(lists, beyond, price, owner)
    out = [("", 0.0, topics[r], -1) for r in sorted(short)]
    for c in np.flatnonzero(owner >= 0):
        columns, worth = lists[owner[c]]
        profit = worth - price[columns]
        own = profit[columns == c][0]
        rest = max(profit[columns != c].max(initial=-np.inf), beyond[owner[c]])
        name = entries[c] if c < m else f"alone {topics[c - m]}"
        out.append((name, price[c] + (max(0.0, own - rest) if rest > -np.inf else 0.0) + epsilon, topics[owner[c]], int(c < m)))
    found = pd.DataFrame(out, columns=["entry", "price", "holder", "kind"])
    found.insert(0, "run_id", rows["run_id"].iloc[0])
    return found


def auction(scores: DataFrame, epsilon: float = EPSILON, block_rows: int = BLOCK_ROWS, least_width: int = LEAST_WIDTH) -> DataFrame:
    """(run_id, topic, entry) of `scores` (run_id, topic, entry as strings, score >= 0); every topic that can gets one entry of its own.

    Topics of a run begin with as many entries as fill one block of `block_rows`, `least_width` at least.
    """
    spark, key = scores.sparkSession, ["run_id", "topic"]
    own = Window.partitionBy(*key).orderBy(F.desc("score"), "entry")  # a topic's own entries, as many as its run has topics
    edges = written(scores.select(*key, "entry", "score", F.row_number().over(own).alias("place")), "edges")
    held = spark.createDataFrame([], "run_id bigint, entry string, price double, holder string, kind int")
    names = edges.where("place = 1").select(*key)
    width = names.groupBy("run_id").agg(F.greatest(F.lit(least_width), F.floor(F.lit(block_rows) / F.count("*")).cast("int") - 2).alias("width"))
    topics = written(names.join(width, "run_id"), "topics")
    active, wanted = topics, WANTED
    while True:
        priced = edges.join(active, key).where("place <= width + 1").withColumn("beyond", F.col("place") > F.col("width"))
        priced = written(priced.join(held.drop("kind"), ["run_id", "entry"], "left").withColumn("price", F.coalesce("price", F.lit(0.0))), "priced")
        blocks = priced.groupBy("run_id").agg((F.floor(F.count("*") / block_rows) + 1).alias("blocks"))
        favourite = priced.groupBy(*key).agg(F.max(F.struct(F.col("score") - F.col("price"), "entry")).alias("best")).join(blocks, "run_id")
        dealt = favourite.select(*key, F.pmod(F.xxhash64("best.entry"), F.col("blocks")).alias("block"))
        bids = priced.join(dealt, key).groupBy("run_id", "block").applyInPandas(lambda rows: block_bids(rows, epsilon), held.schema)
        bids = written(bids, "bids")
        kept = held.join(active.select("run_id", F.col("topic").alias("holder")), ["run_id", "holder"], "left_anti").select(held.columns)
        top = F.max(F.struct("price", "holder", "kind")).alias("top")
        held = written(kept.unionByName(bids.where("kind >= 0")).groupBy("run_id", "entry").agg(top).select("run_id", "entry", "top.*"), "held")
        wider = bids.where("kind < 0").select("run_id", F.col("holder").alias("topic")).distinct().withColumn("more", F.lit(4))
        topics = written(topics.join(wider, key, "left").select(*key, (F.col("width") * F.coalesce("more", F.lit(1))).alias("width")), "topics")
        waiting = written(topics.join(held.select("run_id", F.col("holder").alias("topic")), key, "left_anti"), "waiting")
        if not waiting.limit(1).count():
            return held.where("kind = 1").select("run_id", F.col("holder").alias("topic"), "entry")
        net = edges.join(waiting, key).join(held, ["run_id", "entry"], "left").withColumn("net", F.col("score") - F.coalesce("price", F.lit(0.0)))
        liked = Window.partitionBy(*key).orderBy(F.desc("net"), "entry")
        rivals = net.withColumn("liked", F.row_number().over(liked)).where((F.col("liked") <= wanted) & F.col("holder").isNotNull())
        names = waiting.select(*key).union(rivals.select("run_id", "holder")).union(wider.select(*key)).distinct()
        active, wanted = written(topics.join(names, key, "left_semi"), "active"), wanted * 2
