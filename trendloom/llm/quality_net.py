"""Operator 3, document quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 16 bytes slide over the whole document in steps of 8; their responses are max-pooled over overlapping
chunks of 512 bytes; a small dense layer turns each chunk into a logit, and the mean logit of all chunks, rescaled on the training documents,
is the document's probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.arrays import slices
from trendloom.llm.labelled import fold, sample_per_label

PER_LABEL = (2500, 2500)
STEP, EMBED, FILTERS, HIDDEN = 8, 8, 32, 16
POOL, STRIDE = 63, 56
CHUNKS_PER_TEXT = 6
THRESHOLD = 0.3


def chunk_blocks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows as blocks of STEP, each row zero-padded and closed by one empty block; blocks per row."""
    size = np.diff(offs)
    blocks = np.maximum(1, -(-size // STEP)) + 1
    start = (np.cumsum(blocks) - blocks) * STEP
    padded = np.zeros(int(blocks.sum()) * STEP, dtype=np.uint8)
    padded[np.arange(len(buf)) + np.repeat(start - offs[:-1], size)] = buf
    return padded.reshape(-1, STEP), blocks


def chunk_bounds(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of overlapping pools over the filter positions of each row (one position less than blocks)."""
    positions = blocks - 1
    n = np.maximum(1, -(-(positions - (POOL - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(blocks)), n)
    begin = np.cumsum(blocks) - blocks
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = begin[row] + k * STRIDE
    return row, first, np.minimum(first + POOL, begin[row] + positions[row])


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)), "left": rng.normal(0, 0.12, (STEP * EMBED, FILTERS)), "right": rng.normal(0, 0.12, (STEP * EMBED, FILTERS)), "fb": np.zeros(FILTERS),
            "w1": rng.normal(0, 0.2, (FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.2, HIDDEN), "b2": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift = 1.0, 0.0

    def pooled(self, blocks: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Max-pooled filter responses per chunk."""
        p = self.p
        flat = p["embed"][blocks].reshape(len(blocks), -1)
        out = flat @ p["left"]
        out[:-1] += flat[1:] @ p["right"]
        edges = np.empty(2 * len(first), dtype=np.int64)
        edges[::2], edges[1::2] = first, end
        top = np.maximum.reduceat(np.concatenate((out, out[-1:])), edges, axis=0)[::2]
        return np.maximum(top + p["fb"], 0)

    def logits(self, top: np.ndarray) -> np.ndarray:
        return np.tanh(top @ self.p["w1"] + self.p["b1"]) @ self.p["w2"] + self.p["b2"][0]

    def document_logits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        blocks, per = chunk_blocks(buf, offs)
        row, first, end = chunk_bounds(per)
        z = self.logits(self.pooled(blocks, first, end))
        return np.bincount(row, weights=z, minlength=len(per)) / np.bincount(row, minlength=len(per))

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        """One Adam step on chunks x (n, POOL + 1 blocks, STEP bytes)."""
        p, n = self.p, len(x)
        flat = p["embed"][x].reshape(n, POOL + 1, -1)
        left, right = flat[:, :-1].reshape(n * POOL, -1), flat[:, 1:].reshape(n * POOL, -1)
        out = (left @ p["left"] + right @ p["right"]).reshape(n, POOL, FILTERS)
        arg = out.argmax(axis=1)
        top = np.take_along_axis(out, arg[:, None, :], axis=1)[:, 0] + p["fb"]
        act = np.maximum(top, 0)
        hid = np.tanh(act @ p["w1"] + p["b1"])
        z = hid @ p["w2"] + p["b2"][0]
        dz = ((1 / (1 + np.exp(-z)) - y) / n).astype(np.float32)
        g = {"w2": hid.T @ dz, "b2": dz.sum(keepdims=True)}
        dh = np.outer(dz, p["w2"]) * (1 - hid**2)
        g["w1"], g["b1"] = act.T @ dh, dh.sum(axis=0)
        dtop = (dh @ p["w1"].T) * (top > 0)
        g["fb"] = dtop.sum(axis=0)
        dout = np.zeros((n, POOL, FILTERS), dtype=np.float32)
        np.put_along_axis(dout, arg[:, None, :], dtop[:, None, :], axis=1)
        dout = dout.reshape(n * POOL, FILTERS)
        g["left"], g["right"] = left.T @ dout, right.T @ dout
        dflat = np.zeros_like(flat)
        dflat[:, :-1] += (dout @ p["left"].T).reshape(n, POOL, -1)
        dflat[:, 1:] += (dout @ p["right"].T).reshape(n, POOL, -1)
        by_byte = dflat.reshape(-1, EMBED)
        bytes_ = x.reshape(-1)
        g["embed"] = np.stack([np.bincount(bytes_, weights=by_byte[:, e], minlength=256) for e in range(EMBED)], axis=1)
        state["t"] = t = state.get("t", 0) + 1
        for k, grad in g.items():
            m, v = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            state[k] = m, v
            p[k] = (p[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def train(rows: list[tuple[str, int]], epochs: int = 6, batch: int = 64, seed: int = 3) -> Network:
    """Network from (text, label) rows: at most CHUNKS_PER_TEXT random chunks of each text per epoch; whole texts set the final scale."""
    net, rng = Network(), np.random.default_rng(seed)
    y = np.array([r[1] for r in rows], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        net.scale, net.shift = 0.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return net
    xs, ys = [], []
    for lo, hi, buf, offs in slices(pa.array([r[0] for r in rows], pa.string())):
        blocks, per = chunk_blocks(buf, offs)
        row, first, end = chunk_bounds(per)
        order = rng.permutation(len(row))
        order = order[np.argsort(row[order], kind="stable")]
        nth = np.arange(len(row)) - np.searchsorted(row[order], row[order], side="left")
        pick = order[nth < CHUNKS_PER_TEXT]
        at = np.minimum(first[pick, None] + np.arange(POOL + 1)[None, :], end[pick, None])
        xs.append(blocks[at])
        ys.append(y[lo + row[pick]])
    x, t = np.concatenate(xs), np.concatenate(ys)
    state: dict = {}
    for epoch in range(epochs):
        for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            net.step(x[i], t[i], state, 0.003 * 0.6**epoch)
    z = np.concatenate([net.document_logits(b, o) for _, _, b, o in slices(pa.array([r[0] for r in rows], pa.string()))])
    a, b = 1.0, 0.0
    for _ in range(300):  # rescale the mean logit
        e = 1 / (1 + np.exp(-(a * z + b))) - y
        a, b = a - 0.3 * float((e * z).mean()) - 0.001 * a, b - 0.3 * float(e.mean())
    net.scale, net.shift = a, b
    return net


def with_score(documents: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Input rows with the probability of label 1. Null and empty texts are one chunk of padding; whole texts are read whatever their length.

    An input column named `score_col` is replaced; an empty table stays empty.
    """
    rest = documents.drop(score_col)
    old, schema = rest.columns, T.StructType(rest.schema.fields + [T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, buf, offs in slices(batch.column(text_col), 1 << 18):
                z = net.scale * net.document_logits(buf, offs) + net.shift
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in old), pa.array(np.concatenate(scores))], names=[*old, score_col])

    return rest.mapInArrow(run, schema)


def scored_rows(documents: DataFrame, labels: DataFrame, per_label: tuple[int, int] = PER_LABEL) -> DataFrame:
    """The query's columns; learns from at most `per_label` rows of each label whose crc32 remainder by 5 is not 0."""
    net = train(sample_per_label(documents, labels, "quality", "doc_id", "text", fold("doc_id", 5) != 0, per_label))
    scored = with_score(documents.select("doc_id", "text"), net)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
