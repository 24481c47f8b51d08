"""Quality classifier: a byte-level convolutional network in numpy.

``FILTERS`` learned filters of four bytes slide over every byte of the text; their rectified
answers are max-pooled over chunks of ``2 * HALF`` bytes that overlap by half and cover the whole text,
averaged over the chunks, and combined by a logistic unit into one probability.  A filter's answer
is a sum of one weight per byte and place, so four bytes cost two look-ups in tables over byte pairs.

Fitting takes labelled rows only, at most ``max_rows`` of them (those with the smallest hash of the id), on
the driver: the sample is bounded by that parameter and by ``max_bytes`` a row (evenly spaced chunks of longer
texts).  Scoring reads whole texts in pieces of fixed size.

Defined cases: a null or empty text is one empty chunk and gets the score of the network's bias; no
labels at all, or labels of one kind, give a constant score (the smoothed share of label 1); repeated rows
and null ids get a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.util import prepare, tidy

WIDTH, FILTERS, HALF = 4, 16, 128
PIECE = 512 * HALF


class Network:
    """Weights: ``table[place, byte, filter]``, filter bias, output weights, output bias."""

    def __init__(self, table, bias, out, out_bias):
        self.table, self.bias, self.out, self.out_bias = table, bias, out, float(out_bias)
        self._pairs = None

    def pairs(self):
        if self._pairs is None:
            t = self.table.astype(np.float32)
            self._pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in (0, 2)]
        return self._pairs

    def halves(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Maxima of the filters over the places from ``bounds[2 * i]`` up to ``bounds[2 * i + 1]`` of ``data``."""
        a, b = self.pairs()
        code = data[:-1].astype(np.int32) * 256 + data[1:]
        act = a[code[:-2]]
        act += b[code[2:]]
        return np.maximum(np.maximum.reduceat(act, bounds, axis=0)[::2] + self.bias, 0)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per text: the mean over its chunks of the pooled filters."""
        n, pad = len(offsets) - 1, WIDTH
        sizes = np.diff(offsets)
        count = np.maximum(1, -(-sizes // HALF))
        rows = np.empty((int(count.sum()), FILTERS), np.float32)
        at, buf, starts, used, done = 0, [], [], 0, 0
        zero = np.zeros(pad, np.uint8)

        def flush():
            nonlocal buf, starts, used, done
            if starts:
                got = self.halves(np.concatenate([*buf, zero]), np.array(starts))
                rows[done : done + len(got)] = got
                done += len(got)
            buf, starts, used = [], [], 0

        for i in range(n):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            at = lo
            while True:
                end = min(hi, at + PIECE)
                piece = data[at : min(hi, end + pad)]
                fill = (end - at) + pad - len(piece)
                for b in range(0, max(1, end - at), HALF):
                    starts += [used + b, used + max(1, min(end - at, b + HALF))]
                buf += [piece, zero[:fill]]
                used += len(piece) + fill
                at = end
                if used >= PIECE:
                    flush()
                if at >= hi:
                    break
        flush()
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        chunks = rows.copy()
        if len(rows) > 1:
            chunks[:-1] = np.maximum(rows[:-1], rows[1:])
        last = first + count - 1
        alone = count == 1
        chunks[last] = np.where(alone[:, None], rows[last], 0)
        return np.add.reduceat(chunks, first, axis=0) / np.maximum(1, count - 1)[:, None] if n else np.zeros((0, FILTERS), np.float32)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.features(data, offsets).astype(np.float64) @ self.out + self.out_bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def constant(share: float) -> Network:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros((WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.zeros(FILTERS), np.log(p / (1 - p)))


def fit(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Network:
    """Stochastic gradient descent (Adam) on the logistic loss; classes weigh alike by half (square-root weights)."""
    y = np.asarray(labels, np.float64)
    n = len(y)
    if n == 0 or y.min() == y.max():
        return constant((y.sum() + 1) / (n + 2))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
    p = [table, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    share = y.mean()
    weight = np.where(y > 0, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    pad = WIDTH - 1
    coded = [np.concatenate([np.frombuffer(t, np.uint8), np.zeros(pad + (-len(t)) % HALF + (HALF if not t else 0), np.uint8)]) for t in texts]
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            g = [np.zeros_like(x) for x in p]
            for i in rows:
                c = coded[i]
                act = p[0][0][c[:-3]] + p[0][1][c[1:-2]] + p[0][2][c[2:-1]] + p[0][3][c[3:]]
                k = len(act) // HALF
                cube = act.reshape(k, HALF, FILTERS)
                best = cube.argmax(axis=1)
                top = np.maximum(np.take_along_axis(cube, best[:, None, :], 1)[:, 0, :] + p[1], 0)
                place = best + np.arange(k)[:, None] * HALF
                if k > 1:
                    right = top[1:] > top[:-1]
                    pooled = np.where(right, top[1:], top[:-1])
                    where = np.where(right, place[1:], place[:-1])
                else:
                    pooled, where = top, place
                f = pooled.mean(axis=0)
                s = 1 / (1 + np.exp(-np.clip(f @ p[2] + p[3][0], -40, 40)))
                d = float((s - y[i]) * weight[i]) / len(rows)
                g[2] += d * f
                g[3] += d
                live = (pooled > 0) * (d * p[2] / len(pooled))
                g[1] += live.sum(axis=0)
                col = np.broadcast_to(np.arange(FILTERS), where.shape)
                for j in range(WIDTH):
                    np.add.at(g[0][j], (c[where + j], col), live)
            step += 1
            for x, gx, mx, vx in zip(p, g, m, v):
                mx += 0.1 * (gx - mx)
                vx += 0.001 * (gx * gx - vx)
                x -= rate * (mx / (1 - 0.9**step)) / (np.sqrt(vx / (1 - 0.999**step)) + 1e-8)
    return Network(p[0], p[1], p[2].astype(np.float64), p[3][0])


def held_out(id_col):
    """The fold that never trains: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 1500, max_bytes: int = 16384) -> Network:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, of whole texts up to ``max_bytes``
    bytes (longer ones: evenly spaced chunks)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    sample = known.where(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    size = 2 * HALF
    raw = F.encode(F.coalesce("__text", F.lit("")), "UTF-8")
    n = F.length(raw)
    picks = max_bytes // size
    spread = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.substring(raw, (F.floor(i * (n - size) / (picks - 1)) + 1).cast("int"), F.lit(size)))
    short = F.when(n <= max_bytes, raw).otherwise(F.expr("null"))
    got = rows.select("__id", F.xxhash64("__text").alias("h"), "__y", short.alias("whole"), F.when(n > max_bytes, spread).alias("some")).limit(2 * max_rows).collect()
    got.sort(key=lambda r: (r["__id"], r["h"]))
    texts = [bytes(r["whole"]) if r["whole"] is not None else b"".join(bytes(b) for b in r["some"]) for r in got]
    return fit(texts, [r["__y"] for r in got])


def _scorer(net: Network):
    def run(batches):
        for batch in batches:
            for lo, hi in W.groups(batch.column(1)):
                s = net.score(*W.buffers(batch.column(1).slice(lo, hi - lo)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(s)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(_scorer(net)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the network takes for label 1, unchanged; whole rows pass through the scorer."""
    prepare(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi in W.groups(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(net.score(*W.buffers(part.column(at))) >= 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
