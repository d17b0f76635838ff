"""Operator 13, ranked lexical search by Block-Max MaxScore over shards.

Documents are indexed in shards of bounded size. A shard's posting lists are cut into blocks of 128; a block's documents and frequencies are
compressed, and beside it stand its last document and its impacts, the (frequency, length) pairs that no other of the block beats, so the
block's highest score follows for any corpus statistics. An item's lists are ordered by their highest score. Those that together cannot
reach the item's tenth score so far are not essential: documents come from the essential lists alone, the others' bounds and then the maxima
of the blocks concerned reject documents, and only blocks of documents still in question are decompressed. The best of all shards are merged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.graph import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHARD_TERMS = 2_000_000  # a shard closes with the document that brings its terms to this number
BLOCK = 128
FIRST_WINDOW = 256
ITEM_ROWS = 200_000  # (item, term) rows that go to the tasks at once
TOP = 10
SCHEMA = (
    "n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms array<string>, dfs array<int>, first_block binary, last_doc binary, "
    "doc_at binary, freq_at binary, docs binary, freqs binary, impact_at binary, impact_freq binary, impact_length binary"
)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative integers, seven bits a byte, low bits first, and the byte at which each begins (one more than values)."""
    size = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    at = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    out = np.zeros(at[-1], dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = ((values[some] >> (7 * k)) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, at


def unpacked(data: np.ndarray) -> np.ndarray:
    stops = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], stops[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, stops - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


@dataclass
class ShardBuilder:
    """Collects documents (id, terms with counts) and gives the shard's row."""

    ids: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    codes: list = field(default_factory=list)
    freqs: list = field(default_factory=list)
    names: dict = field(default_factory=dict)
    size: int = 0

    def add(self, doc_id, terms: list[bytes]) -> None:
        if not terms:
            return
        found, names = Counter(terms), self.names
        self.codes.append(np.fromiter((names.setdefault(t, len(names)) for t in found), dtype=np.int32, count=len(found)))
        self.freqs.append(np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.size += len(terms)

    def row(self) -> dict:
        names = sorted(self.names)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.names[t] for t in names]] = np.arange(len(names))
        term = rank[np.concatenate(self.codes)]
        order = np.argsort(term, kind="stable")
        doc = np.repeat(np.arange(len(self.ids)), [len(c) for c in self.codes])[order]
        freq, term = np.concatenate(self.freqs)[order], term[order]
        lengths = np.array(self.lengths, dtype=np.int64)
        dfs = np.bincount(term, minlength=len(names))
        per_term = -(-dfs // BLOCK)
        first_block = np.concatenate(([0], np.cumsum(per_term)))
        place = np.arange(len(term)) - np.repeat(np.cumsum(dfs) - dfs, dfs)
        block = first_block[term] + place // BLOCK
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        ends = np.append(starts[1:], len(block))
        gaps = np.diff(doc, prepend=-1)
        new_list = place == 0
        gaps[new_list] = doc[new_list] + 1
        docs, doc_at = packed(gaps)
        freqs, freq_at = packed(freq)
        length = lengths[doc]
        best = np.lexsort((length, -freq, block))  # by falling frequency; kept where shorter than all before in the block
        falling = length[best] + (block[-1] - block[best]) * (int(lengths.max()) + 1)
        shortest = np.minimum.accumulate(falling)
        kept = best[np.concatenate(([True], falling[1:] < shortest[:-1]))]
        impact_at = np.concatenate(([0], np.cumsum(np.bincount(block[kept], minlength=len(starts)))))
        i32 = lambda a: a.astype(np.int32).tobytes()
        return {
            "n_docs": len(self.ids), "n_terms": self.size, "doc_ids": self.ids, "lengths": i32(lengths), "terms": [t.decode() for t in names], "dfs": dfs.tolist(),
            "first_block": i32(first_block), "last_doc": i32(doc[ends - 1]), "doc_at": np.append(doc_at[starts], doc_at[-1]).tobytes(),
            "freq_at": np.append(freq_at[starts], freq_at[-1]).tobytes(), "docs": docs.tobytes(), "freqs": freqs.tobytes(),
            "impact_at": i32(impact_at), "impact_freq": i32(freq[kept]), "impact_length": i32(length[kept]),
        }


def index_shards(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row per shard; every document with a term is in exactly one. Null and empty texts are in none; a null id stays null."""
    schema = documents.sparkSession.createDataFrame([], SCHEMA).schema

    def build(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, shard = to_arrow_schema(schema), ShardBuilder()
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary())):
                shard.add(i, TERM_BYTES.findall((text.as_py() or b"").translate(LOWERED)))
                if shard.size >= shard_terms:
                    yield pa.RecordBatch.from_pylist([shard.row()], schema=arrow)
                    shard = ShardBuilder()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], schema=arrow)

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(build, schema)


class Shard:
    """One row of the index, searched with the corpus statistics n (documents) and total (terms)."""

    def __init__(self, row: dict, n: int, total: int):
        i32 = lambda name: np.frombuffer(row[name], dtype=np.int32)
        self.dfs, self.first_block, self.last_doc = row["dfs"], i32("first_block"), i32("last_doc")
        self.doc_at, self.freq_at = np.frombuffer(row["doc_at"], dtype=np.int64), np.frombuffer(row["freq_at"], dtype=np.int64)
        self.docs, self.freqs = np.frombuffer(row["docs"], dtype=np.uint8), np.frombuffer(row["freqs"], dtype=np.uint8)
        self.weight_of_length = lambda lengths: 25 + 75 * lengths.astype(np.int64) * n // total
        self.m = self.weight_of_length(i32("lengths"))
        self.impact_at, self.impact_freq, self.impact_length = i32("impact_at"), i32("impact_freq").astype(np.int64), i32("impact_length")
        self.code = {t: k for k, t in enumerate(row["terms"])}
        ids = row["doc_ids"]
        self.null = np.array([i is None for i in ids])
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.maxima: dict[int, np.ndarray] = {}

    @staticmethod
    def impact(freq: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * freq // (1000 * freq + 8 * m)

    def block_maxima(self, code: int) -> np.ndarray:
        if code not in self.maxima:
            a, b = self.first_block[code], self.first_block[code + 1]
            lo, hi = self.impact_at[a], self.impact_at[b]
            each = self.impact(self.impact_freq[lo:hi], self.weight_of_length(self.impact_length[lo:hi]))
            self.maxima[code] = np.maximum.reduceat(each, self.impact_at[a:b] - lo)
        return self.maxima[code]

    def block(self, code: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, decompressed once."""
        if block not in self.open:
            before = self.last_doc[block - 1] if block > self.first_block[code] else -1
            docs = np.cumsum(unpacked(self.docs[self.doc_at[block] : self.doc_at[block + 1]])) + before
            freq = unpacked(self.freqs[self.freq_at[block] : self.freq_at[block + 1]])
            self.open[block] = docs, self.impact(freq, self.m[docs])
        return self.open[block]

    def search(self, terms: list[tuple[str, int]], heap: list[tuple], top: int) -> list[tuple]:
        """`heap`, the best (-score, null id, id) so far in order, with this shard's documents merged in. `terms`: (term, weight times repeats)."""
        lists = []
        for term, weight in terms:
            if (code := self.code.get(term)) is not None and weight > 0:
                maxima = self.block_maxima(code) * weight
                lists.append((int(maxima.max()), code, weight, maxima, self.last_doc[self.first_block[code] : self.first_block[code + 1]]))
        lists.sort(key=lambda x: x[:2])
        bounds = np.cumsum([x[0] for x in lists])  # of a list and all below it
        lo, width = 0, FIRST_WINDOW
        while lists and lo < len(self.m):
            hi = min(lo + width, len(self.m))
            floor = -heap[-1][0] if len(heap) == top else 1
            essential = int(np.searchsorted(bounds, floor))  # lists below cannot reach the floor together
            if essential == len(lists):
                break
            score = np.zeros(hi - lo, dtype=np.int64)
            for _, code, weight, _, last in lists[essential:]:
                for k in range(int(np.searchsorted(last, lo)), min(len(last), int(np.searchsorted(last, hi - 1)) + 1)):
                    docs, impact = self.block(code, self.first_block[code] + k)
                    a, b = np.searchsorted(docs, (lo, hi))
                    score[docs[a:b] - lo] += impact[a:b] * weight
            some = np.flatnonzero(score)
            have = score[some]
            for j in range(essential - 1, -1, -1):
                left = have + bounds[j] >= floor
                some, have = some[left], have[left]
                if not len(some):
                    break
                _, code, weight, maxima, last = lists[j]
                at = np.searchsorted(last, some + lo)
                there = at < len(last)
                most = np.where(there, maxima[np.minimum(at, len(last) - 1)], 0) + (bounds[j - 1] if j else 0)
                left = have + most >= floor
                some, have, at, there = some[left], have[left], at[left], there[left]
                for k in np.unique(at[there]):
                    docs, impact = self.block(code, self.first_block[code] + k)
                    mine = np.flatnonzero(at == k)
                    spot = np.minimum(np.searchsorted(docs, some[mine] + lo), len(docs) - 1)
                    hit = docs[spot] == some[mine] + lo
                    have[mine[hit]] += impact[spot[hit]] * weight
            good = np.flatnonzero(have >= floor)
            if len(good):
                row = some[good] + lo
                first = np.lexsort((self.ids[row], -have[good]))[:top]
                heap = sorted(heap + [(-int(have[good[i]]), bool(self.null[row[i]]), int(self.ids[row[i]])) for i in first])[:top]
            lo, width = hi, width * 2
        return heap


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, repeats) of the items; rows that share an id are one item."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


def search(index: DataFrame, items: DataFrame, top: int = TOP, item_id_col: str = "item_id", item_text_col: str = "text", item_rows: int = ITEM_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents of highest score above 0, equal scores by doc_id, null last.

    `index` is a written table of `index_shards`. Items are taken in blocks of about `item_rows` terms, so what goes to the tasks at once is
    bounded by that and one item's text; each block runs over all shards. Items without terms and empty tables give no rows.
    """
    spark = index.sparkSession
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    terms = stored(item_terms(items, item_id_col, item_text_col), "items")
    listed = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select("x.terms", "x.dfs").toDF("term", "df")
    frequency = listed.groupBy("term").agg(F.sum("df").alias("df"))
    weighed = stored(terms.join(frequency, "term"), "weighed") if n else terms.withColumn("df", F.lit(0).cast("long")).limit(0)
    blocks = 1 + weighed.count() // item_rows
    found = None
    for block in range(blocks):
        rows = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").collect()
        asked: dict = {}
        for r in rows:
            weight = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
            asked.setdefault(r["item_id"], []).append((r["term"], weight * r["repeats"]))
        best = index.mapInArrow(_searcher(spark.sparkContext.broadcast(asked), n, total, top), "item_id long, doc_id long, score long")
        found = best if found is None else found.union(best)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _searcher(asked, n: int, total: int, top: int):
    def run(batches):
        heaps = {item: [] for item in asked.value}
        for batch in batches:
            for k in range(len(batch)):
                shard = Shard(batch.slice(k, 1).to_pylist()[0], n, total)
                for item, terms in asked.value.items():
                    heaps[item] = shard.search(terms, heaps[item], top)
        rows = [(item, None if null else i, -score) for item, heap in heaps.items() for score, null, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return run


def ranked_rows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The query's columns."""
    return search(stored(index_shards(documents), "index"), items)


ORACLE = rf"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents
), counted AS (
  SELECT doc_id, term, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term)
), corpus AS (
  SELECT count(DISTINCT doc_id) AS docs, CAST(sum(tf) AS BIGINT) AS total FROM counted
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, corpus GROUP BY term, docs
), asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term), corpus GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
