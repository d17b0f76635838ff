"""Operator 10, byte-level BPE encoding and decoding with recursive DuckDB queries, one in-memory connection per partition.

A text is split into the tokenizer's pieces by code-point classes. Every distinct piece of a slice that is no token by itself becomes
token-position rows; the recursion joins neighbouring rows with the merge table and contracts each word's leftmost pair of least rank
until no pair is left. Decoding joins ids with the vocabulary and concatenates their bytes by ordered aggregation.

Pieces of any length go one way. Beyond the size of a word a piece is cut where no token's bytes in it span the cut, since no merge can cross there. What is longer
than a window is encoded in half-overlapping windows, which are joined at a token that both have: a sequence of tokens is the encoding of
its bytes if and only if every two neighbours are the encoding of theirs (the first merge across a border would also be made by the two
tokens alone), and every two neighbours of the joined sequence come from one window.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.arrays import Rolling, hash_spans, lists, raw_text, slices, stream

WORD_BYTES = 24  # shorter pieces are not cut first: looking for cuts would cost more than the steps it saves
WINDOW = 96  # bytes encoded together; half is a multiple of 2, 3 and 4 bytes, so runs of one character meet in step
BYTES_PER_QUERY = 200_000
CACHED_BYTES = 4_000_000
STEPS = 16  # a query keeps the rows of all its steps, so their number is bounded and words that need more go into the next query

# A row of a word is one number x: word << 40 | position << 20 | token. A pair's key: rank << 40 | position << 20 | next position.
NEXT = "SELECT it, (x >> 40)::INT AS w, x, lead(x) OVER (ORDER BY x) AS nx FROM"
PAIR = "LEFT JOIN merges m ON m.pair = CASE WHEN p.nx >> 40 = p.w THEN ((p.x & 1048575) << 20) | (p.nx & 1048575) END"
KEY = "it, w, x, (m.rank << 40) | (((x >> 20) & 1048575) << 20) | ((nx >> 20) & 1048575)"
ENCODE = f"""
WITH RECURSIVE s(it, w, x, key) AS (
    SELECT {KEY} FROM ({NEXT} (SELECT 0 AS it, x FROM start)) p {PAIR}
    UNION ALL
    SELECT {KEY} FROM ({NEXT} (
        SELECT it + 1 AS it, CASE WHEN key = best THEN (x & ~1048575) | (key >> 40) ELSE x END AS x
        FROM s JOIN (SELECT w, min(key) AS best FROM s WHERE it < {STEPS} GROUP BY w HAVING min(key) IS NOT NULL) b ON s.w = b.w
        WHERE (x >> 20) & 1048575 <> (best & 1048575))) p {PAIR}
)
SELECT x, s.it = {STEPS} AS more FROM s SEMI JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) l ON s.w = l.w AND s.it = l.it ORDER BY x
"""
DECODE = "SELECT doc, list(bytes ORDER BY pos) AS bytes FROM tokens JOIN vocab USING (id) GROUP BY doc ORDER BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(left << 20 | right, rank) of every split of a token into two tokens; bounded by the vocabulary's bytes."""
    pair, rank = [], []
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pair.append(a << 20 | b), rank.append(r)
    return np.array(pair, dtype=np.int64), np.array(rank, dtype=np.int64)


def class_table(top: int) -> np.ndarray:
    """Class of every code point up to top: 0 other, 1 letter, 2 number, 3 white space."""
    kinds = {"L": 1, "N": 2}
    table = np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(top + 1)], dtype=np.uint8)
    space = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[[i for i in space if i <= top]] = 3
    return table


def piece_starts(points: np.ndarray, row_starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Code-point positions where a piece of the standard splitting pattern starts, for rows laid end to end.

    Pieces are contractions ('s 't 're 've 'm 'll 'd), runs of letters, of numbers or of other signs with an optional space before, and
    runs of white space less the last one if something follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = table[points]
    first_of_row = np.zeros(n + 1, dtype=bool)
    first_of_row[row_starts] = True
    change = np.empty(n, dtype=bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= first_of_row[:-1]
    start = change.copy()
    last_space = np.zeros(n, dtype=bool)  # last white space of a run that something follows in its row
    last_space[:-1] = (kind[:-1] == 3) & (kind[1:] != 3) & ~first_of_row[1:-1]
    start[last_space] = True
    glued = np.zeros(n, dtype=bool)  # run starts that the space before belongs to
    glued[1:] = last_space[:-1] & (points[:-1] == 32)
    start[glued] = False
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first_of_row[quote + 1] & (kind[quote + 1] == 1)]
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(first_of_row[np.minimum(quote + 2, n)], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
        hit = single | double
        q, size = quote[hit], np.where(single[hit], 2, 3)
        start[q + 1] = False
        after = q + size
        after = after[after < n]
        start[after] = start[after] | (kind[after] == 1)
    return np.flatnonzero(start)


_VALUE = stream(256, 3)


def hashes_by_length(ranks: dict[bytes, int]) -> dict[int, np.ndarray]:
    """Sorted hashes of the tokens of two and more bytes, by length."""
    out = {}
    for size in sorted({len(t) for t in ranks} - {1}):
        buf = np.frombuffer(b"".join(t for t in ranks if len(t) == size), dtype=np.uint8)
        at = np.arange(0, len(buf), size)
        out[size] = np.sort(Rolling(_VALUE[buf]).ranges(at, at + size))
    return out


def cuts(buf: np.ndarray, offs: np.ndarray, hashes: dict[int, np.ndarray]) -> np.ndarray:
    """Row starts, and places within rows that no occurrence of a token spans; equal hashes of other bytes only leave a cut out."""
    n = len(buf)
    rolling, end = Rolling(_VALUE[buf]), np.repeat(offs[1:], np.diff(offs))
    spans = np.zeros(n + 2, dtype=np.int64)
    for size, known in hashes.items():
        at = np.flatnonzero(np.arange(size, n + size) <= end)
        value = rolling.ranges(at, at + size)
        at = at[known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value]
        spans += np.bincount(at + 1, minlength=n + 2) - np.bincount(at + size, minlength=n + 2)
    cut = np.cumsum(spans)[:n] == 0
    cut[offs[:-1]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Pieces to ids within one task; remembers a bounded number of pieces."""

    def __init__(self, ranks: dict[bytes, int], merges):
        import duckdb

        self.ranks, self.known, self.held = ranks, {}, 0
        self.table = class_table(0xFFFF)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        arrow = pa.table({"pair": merges[0], "rank": merges[1]})
        self.con.register("merge_arrow", arrow)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_arrow")
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.hashes = hashes_by_length(ranks)

    def remember(self, piece: bytes, ids: np.ndarray) -> None:
        self.known[piece] = ids
        self.held += len(piece)

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces that are not remembered."""
        if self.held > CACHED_BYTES:
            self.known.clear()
            self.held = 0
        rest = self.without_tokens(pieces)
        words = [p for p in rest if len(p) <= WORD_BYTES]
        rest = [p for p in rest if len(p) > WORD_BYTES]
        if not rest:
            return self.encode_parts(words)
        raw = b"".join(rest)
        offs = np.concatenate(([0], np.cumsum([len(p) for p in rest])))
        cut = cuts(np.frombuffer(raw, dtype=np.uint8), offs, self.hashes)
        parts = [raw[a:b] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(raw)])]
        self.encode_parts(list(dict.fromkeys(words + self.without_tokens(dict.fromkeys(parts)))))
        bounds = np.searchsorted(cut, offs).tolist()
        for p, a, b in zip(rest, bounds[:-1], bounds[1:]):
            if b - a > 1:
                self.remember(p, np.concatenate([self.known[x] for x in parts[a:b]]))

    def without_tokens(self, pieces) -> list[bytes]:
        """Pieces that are neither remembered nor tokens; tokens are remembered."""
        new = [p for p in pieces if p not in self.known]
        for p in new:
            if p in self.ranks:
                self.remember(p, np.array([self.ranks[p]], dtype=np.int32))
        return [p for p in new if p not in self.ranks]

    def encode_parts(self, parts: list[bytes]) -> None:
        half = WINDOW // 2
        windows = [[p[a : a + WINDOW] for a in range(0, max(1, len(p) - half), half)] for p in parts]
        distinct = list(dict.fromkeys(w for ws in windows for w in ws))
        found = dict(zip(distinct, self.contract(distinct)))
        for p, ws in zip(parts, windows):
            self.remember(p, found[p] if len(ws) == 1 else self.joined(p, ws, [found[w] for w in ws]))

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word by the recursion, in queries over words of about BYTES_PER_QUERY bytes."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        group = (np.cumsum(size) - size) // BYTES_PER_QUERY
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(group)) + 1):
            n = size[part]
            pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            x = np.repeat(np.arange(len(part)), n) << 40 | pos << 20 | self.byte[np.frombuffer(b"".join(words[i] for i in part), dtype=np.uint8)]
            while len(x):
                self.con.register("start", pa.table({"x": x}))
                rows = self.con.sql(ENCODE).to_arrow_table()
                x, more = rows.column("x").to_numpy(), rows.column("more").to_numpy()
                done = x[~more]
                which, first = np.unique(done >> 40, return_index=True)
                for w, ids in zip(which.tolist(), np.split((done & 1048575).astype(np.int32), first[1:])):
                    out[part[w]] = ids
                x = x[more]
        return out

    def joined(self, part: bytes, windows: list[bytes], ids: list[np.ndarray]) -> np.ndarray:
        """Ids of a part from those of its windows, changing over at the first token that a window shares with the one before."""
        half = WINDOW // 2
        flat, win = np.concatenate(ids).astype(np.int64), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        size, bytes_of = self.size[flat], np.array([len(w) for w in windows])
        at = np.cumsum(size) - size - (np.cumsum(bytes_of) - bytes_of)[win]
        late = at >= half
        before = (win[late] + 1) << 40 | (at[late] - half) << 20 | flat[late]
        both = np.flatnonzero(np.isin(win << 40 | at << 20 | flat, before))
        which, first = np.unique(win[both], return_index=True)
        if len(which) < len(ids) - 1:
            return self.in_turn(part)
        meet = at[both[first]]
        lo, hi = np.concatenate(([0], meet)), np.concatenate((meet + half, [WINDOW + 1]))
        return flat[(at >= lo[win]) & (at < hi[win])].astype(np.int32)

    def in_turn(self, part: bytes) -> np.ndarray:
        """As `joined` where some windows share no token: each window starts at a token of the one before, and grows until both agree on it."""
        out, start, width = [], 0, WINDOW
        ids = self.contract([part[:width]])[0]
        while start + width < len(part):
            ends = np.cumsum(self.size[ids])
            j = int(np.searchsorted(ends, width // 2, side="right"))  # first token that ends behind the middle
            if j:
                nxt = self.contract([part[start + int(ends[j - 1]) : start + int(ends[j - 1]) + width]])[0]
                if nxt[0] == ids[j]:
                    out.append(ids[:j])
                    start, ids = start + int(ends[j - 1]), nxt
                    continue
            width *= 2
            ids = self.contract([part[start : start + width]])[0]
        return np.concatenate([*out, ids])

    def rows(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and their number per row."""
        from_bytes = (buf & 0xC0) != 0x80
        where = np.flatnonzero(from_bytes)
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        if len(points) and points.max() >= len(self.table):
            self.table = class_table(0x10FFFF)
        start = where[piece_starts(points, np.searchsorted(where, offs), self.table)]
        end = np.concatenate((start[1:], [len(buf)]))[: len(start)]
        rows = np.searchsorted(start, offs)
        if not len(start):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offs) - 1, dtype=np.int64)
        _, first, which = np.unique(hash_spans(buf, start, end), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        pieces = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        self.learn(pieces)
        found = [self.known[p] for p in pieces]
        size = np.array([len(f) for f in found])
        flat, begin = np.concatenate(found), np.cumsum(size) - size
        per = size[which]
        at = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(begin[which], per)
        sums = np.concatenate(([0], np.cumsum(per)))
        return flat[at], sums[rows[1:]] - sums[rows[:-1]]


def encode(documents: DataFrame, ranks: dict[bytes, int], text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Input rows with `ids_col` array<int>. Null and empty texts give an empty array; an input column of that name is replaced.

    `ranks` must hold all 256 single bytes; its size bounds what is broadcast. Special tokens never occur: their strings are plain text.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((ranks, merge_table(ranks)))
    rest = documents.drop(ids_col)
    old, schema = rest.columns, T.StructType(rest.schema.fields + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(text_col)):
                flat, count = encoder.rows(buf, offs)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in old), lists(flat, count, pa.int32())], names=[*old, ids_col])

    return rest.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Input rows with `bytes_col` binary, the concatenated bytes of the ids; null and empty arrays give empty bytes.

    An id outside the vocabulary fails the task with a message, since no bytes stand for it.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rest = encoded.drop(bytes_col)
    old, schema = rest.columns, T.StructType(rest.schema.fields + [T.StructField(bytes_col, T.BinaryType())])

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        con.register("vocab_arrow", pa.table({"id": pa.array(list(shared.value.values()), pa.int32()), "bytes": pa.array(list(shared.value), pa.binary())}))
        con.execute("CREATE TABLE vocab AS SELECT * FROM vocab_arrow")
        for batch in batches:
            column = batch.column(ids_col).fill_null([])
            bounds, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
            bounds = bounds - bounds[0]
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 400_000, side="right")) - 1)
                hi = min(hi, len(batch))
                size = np.diff(bounds[lo : hi + 1])
                ids = flat[bounds[lo] : bounds[hi]].astype(np.int32)
                doc = np.repeat(np.arange(hi - lo, dtype=np.int32), size)
                con.register("tokens", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
                out = con.sql(DECODE).to_arrow_table().combine_chunks()
                texts = [b""] * (hi - lo)
                if len(out):
                    pieces = out.column("bytes").chunk(0)
                    cut = pieces.offsets.to_numpy()
                    value = pieces.values
                    data, at = raw_text(value)
                    if int(cut[-1] - cut[0]) != len(ids):
                        raise ValueError("an id is outside the vocabulary")
                    for d, a, b in zip(out.column("doc").to_pylist(), at[cut[:-1]].tolist(), at[cut[1:]].tolist()):
                        texts[d] = data[a:b].tobytes()
                elif len(ids):
                    raise ValueError("an id is outside the vocabulary")
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in old), pa.array(texts, pa.binary())], names=[*old, bytes_col])
                lo = hi

    return rest.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def digest_rows(documents: DataFrame, path: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text after a full round trip through encode and decode."""
    ranks = read_ranks(path or default_path())
    done = decode(encode(documents.select("doc_id", "text", *extra), ranks).drop("text"), ranks)
    return done.select(
        "doc_id", *extra, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

