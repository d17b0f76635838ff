"""Operator 2, benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every word sequence of the items. A document's words stream through it, tracking the longest suffix that occurs in some
item; where it reaches the window length, or is a whole shorter item, the words behind it are hit.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.arrays import ALNUM, LOWER, hash_spans, slices, word_spans

WINDOW = 10
SHORT_ITEM = 5  # words of the shortest item that is cut out wherever it occurs
AUTOMATON_WORDS = 100_000


class SuffixAutomaton:
    """Generalised suffix automaton over integer words; `texts` are (item key, word ids)."""

    def __init__(self, texts: list[tuple[int, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, words in texts:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        items: list[set[int]] = [set() for _ in self.next]
        whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for (key, words), path in zip(texts, ends):
            if len(words) >= window:
                for s in path:
                    while s > 0 and key not in items[s]:
                        items[s].add(key)
                        s = self.link[s]
            elif words:
                s, m = path[-1], len(words)
                while self.length[self.link[s]] >= m:
                    s = self.link[s]
                whole[s].append((m, key))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.items: list[tuple[int, ...]] = [()] * len(self.next)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in order:
            up = self.link[s]
            self.short[s] = self.short[up] + tuple(whole[s])
            if self.length[s] >= window:
                self.items[s] = self.items[up] if self.length[up] >= window else tuple(sorted(items[s]))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._new({}, length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _new(self, moves: dict[int, int], length: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._new(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def stream(self, words: list[int], window: int):
        """Yield (end position, matched window length, item keys) for every window that ends in the stream."""
        nxt, link, length, items, short = self.next, self.link, self.length, self.items, self.short
        state = have = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            state = nxt[state].get(w, 0)
            have = have + 1 if state else 0
            if have >= window and items[state]:
                yield i, window, items[state]
            for m, key in short[state]:
                if m <= have:
                    yield i, m, (key,)


def item_words(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, as documents are hashed."""
    out = []
    for _, _, buf, offs in slices(pa.array(texts, pa.string())):
        low = LOWER[buf]
        starts, ends, rows = word_spans(low, offs, ALNUM)
        values = hash_spans(low, starts, ends)
        out += [values[a:b] for a, b in zip(rows[:-1], rows[1:])]
    return out


def automata(benchmark: DataFrame, window: int, most_words: int):
    """Yield (sorted word hashes, automaton, item names, shortest window) for groups of items of at most `most_words` words.

    Items stream to the driver one group at a time; a larger item set means more groups, not a larger broadcast.
    """
    group, size = [], 0

    def build():
        vocabulary = np.unique(np.concatenate([w for _, w in group]))
        coded = [(i, np.searchsorted(vocabulary, w).tolist()) for i, (_, w) in enumerate(group)]
        return vocabulary, SuffixAutomaton(coded, window), [n for n, _ in group], min(min(window, len(w)) for _, w in group)

    for row in benchmark.toLocalIterator():
        words = item_words([row[1] or ""])[0]
        step = max(window, most_words)
        for a in range(0, max(1, len(words) - window + 1), step):  # an item above the bound in overlapping parts
            part = words[a : a + step + window - 1]
            if not len(part):
                continue
            if group and size + len(part) > most_words:
                yield build()
                group, size = [], 0
            group.append((None if row[0] is None else str(row[0]), part))
            size += len(part)
    if group:
        yield build()


def contamination(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, most_words: int = AUTOMATON_WORDS
) -> DataFrame:
    """Input rows with n_words, n_hit (long), items (sorted array<string>), spans (array of word ranges a..b, end exclusive).

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters; null and empty texts have none. Windows are `window`
    consecutive words of an item, or the whole of a shorter one; repeated items and equal windows count once. Items without id mark words
    but are not listed; items without words never match; an empty benchmark hits nothing. Input columns of these names are replaced.
    """
    new = ["n_words", "n_hit", "items", "spans"]
    rest = documents.drop(*new)
    old = rest.columns
    span = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    schema = T.StructType(rest.schema.fields + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)])
    shared = [rest.sparkSession.sparkContext.broadcast(cloudpickle.dumps(x)) for x in automata(benchmark.select(item_col, item_text), window, most_words)]

    def run(batches):
        known_items = [pickle.loads(x.value) for x in shared]
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(text_col)):
                low = LOWER[buf]
                starts, ends, rows = word_spans(low, offs, ALNUM)
                values = hash_spans(low, starts, ends)
                hit = np.zeros(len(values) + 1, dtype=np.int32)
                names: list[set[str]] = [set() for _ in range(hi - lo)]
                for vocabulary, automaton, items, shortest in known_items:
                    code = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
                    known = vocabulary[code] == values
                    head = np.zeros(len(values) + 1, dtype=bool)
                    head[rows] = True
                    begin = np.flatnonzero(known & (head[:-1] | ~np.concatenate(([False], known[:-1]))))
                    stop = np.flatnonzero(known & (head[1:] | ~np.concatenate((known[1:], [False])))) + 1
                    for a, b in zip(begin.tolist(), stop.tolist()):
                        if b - a < shortest:
                            continue
                        row = int(np.searchsorted(rows, a, side="right")) - 1
                        for end, size, keys in automaton.stream(code[a:b].tolist(), window):
                            hit[a + end + 1 - size] += 1
                            hit[a + end + 1] -= 1
                            names[row].update(items[k] for k in keys if items[k] is not None)
                mask = np.cumsum(hit[:-1]) > 0
                sums = np.concatenate(([0], np.cumsum(mask)))
                edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
                spans, first, last = [], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for i in range(hi - lo):
                    a, b = rows[i], rows[i + 1]
                    lo_s, hi_s = np.searchsorted(last, a, side="right"), np.searchsorted(first, b, side="left")
                    spans.append([{"a": int(max(s, a) - a), "b": int(min(e, b) - a)} for s, e in zip(first[lo_s:hi_s], last[lo_s:hi_s])])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in old), pa.array(np.diff(rows)), pa.array((sums[rows[1:]] - sums[rows[:-1]]).astype(np.int64)), pa.array([sorted(n) for n in names], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                    names=[*old, *new],
                )

    return rest.mapInArrow(run, schema)


def remove_spans(found: DataFrame, text_col: str = "text", least_words: int = SHORT_ITEM, most_coverage: float = 0.5) -> DataFrame:
    """Rows of `contamination` with hit spans of at least `least_words` words cut out of the text; rows hit beyond `most_coverage` go.

    Spans below the window are whole short items; those below `least_words` are phrases that clean texts use too and are cut only from
    rows whose coverage exceeds half of `most_coverage`.
    """
    names, schema = found.columns, found.schema

    def run(batches):
        at = names.index(text_col)
        for batch in batches:
            spans, text = batch.column("spans"), batch.column(text_col)
            n, k = batch.column("n_words").to_numpy(), batch.column("n_hit").to_numpy()
            changed = {}
            for i in np.flatnonzero(k > 0).tolist():
                raw = text[i].as_py().encode()
                buf = np.frombuffer(raw, dtype=np.uint8)
                starts, ends, _ = word_spans(LOWER[buf], np.array([0, len(buf)]), ALNUM)
                keep, cut = [], 0
                for s in spans[i].as_py():
                    if s["b"] - s["a"] >= least_words or k[i] > most_coverage / 2 * n[i]:
                        keep.append(raw[cut : starts[s["a"]]])
                        cut = int(ends[s["b"] - 1])
                changed[i] = (b"".join(keep) + raw[cut:]).decode()
            if changed:
                mask = np.zeros(len(batch), dtype=bool)
                mask[list(changed)] = True
                out = pc.replace_with_mask(text, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], text.type))
                batch = batch.set_column(at, text_col, out)
            yield batch

    return found.where(F.col("n_hit") <= most_coverage * F.col("n_words")).mapInArrow(run, schema)


def digest_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    found = contamination(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(list_transform(range(greatest(1, len(ws) - 9)), lambda i: array_to_string(ws[i + 1 : i + 10], ' '))) AS w, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, r, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(len(ws) - n + 1), lambda k: array_to_string(ws[k + 1 : k + n], ' '))) AS w
       FROM d, sizes WHERE len(ws) >= n),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
c AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM h), range(10) t(k) WHERE k < n GROUP BY r),
x AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN x USING (r)
"""


def brute_force(documents, items, window: int = WINDOW) -> dict[int, tuple]:
    """Small reference for tests: dictionary of all windows."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known: dict = {}
    for key, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[i : i + window]), set()).add(str(key))
    sizes = {len(k) for k in known}
    out = {}
    for doc, text in documents:
        w = words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = known.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        joined = ",".join(sorted(names))
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit))
    return out
